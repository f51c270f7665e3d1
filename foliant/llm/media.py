"""Content-addressed media payloads in tar shards, read back by byte ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import materialise, qualified, shared_path, side, trim
from foliant.sources.files import open_input, open_output

#: Samples in a row of the stored picture; a payload is padded to full rows.
WIDTH = 576
PAD = b"\xff"
#: Bytes of a PNG file up to the end of its IHDR chunk.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "doc_id long, digest string, shard string, offset long, length long"
PLACED = f"{INDEX}, t1 long, t2 long, shared boolean"
FEATURES = "width int, height int, bit_depth int, colour int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``WIDTH``."""
    return data + PAD * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """An 8-bit grey PNG, ``WIDTH`` samples wide, whose samples are the payload."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from a PNG's first ``HEADER`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    width, height, depth, colour = png_header(data[:HEADER])
    if (depth, colour) != (8, 0):
        raise ValueError("not an 8-bit grey picture")
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits in hex: which of 64 equal stretches of samples are brighter than the whole (exact integers)."""
    x = np.frombuffer(payload, np.uint8)
    cuts = np.arange(65, dtype=np.int64) * len(x) // 64
    sums = np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cuts])
    bright = sums * len(x) > int(x.sum(dtype=np.int64)) * np.diff(cuts)
    return np.packbits(bright).tobytes().hex()


def store(docs: DataFrame, folder: str, shard_bytes: int = 1 << 30) -> DataFrame:
    """Writes each different text's picture once to tar shards under ``folder``; gives the index (``INDEX``), one row for each row.

    Content decides: a text is known by 128 bits of hash, and of rows that
    share one only those of the smallest doc_id (nulls first) write it, so no
    payload is shuffled and one that a third of all rows share is stored
    once. The other rows get the place of that copy from the index. Should
    rows repeat a doc_id and a text in different tasks, the least place
    counts for all. A member is named by the SHA-256 of its bytes. A task
    writes its own shards (a new one after ``shard_bytes``). A repeated task
    attempt writes files of other names; only the files in the index, which
    is itself a written table, are ever read.
    """

    folder = qualified(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, have, at, part = TaskContext.get(), None, {}, 0, 0
        try:
            for batch in batches:
                rows = []
                for data, k1, k2 in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if (k1, k2) not in have:
                        media = to_png(pad(data.as_py() or b""))
                        digest = hashlib.sha256(media).hexdigest()
                        if out is None or at > shard_bytes:
                            if out:
                                out.write(bytes(1024))
                                out.close()
                            name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.tar"
                            out, at, part = open_output(name), 0, part + 1
                        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                        info.size = len(media)
                        fill = bytes(-len(media) % 512)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + fill)
                        have[k1, k2] = (digest, name, at + 512, len(media))
                        at += 512 + len(media) + len(fill)
                    rows.append(have[k1, k2])
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), *batch.columns[2:5]],
                    ["doc_id", "digest", "shard", "offset", "length", "t1", "t2", "shared"],
                )
        finally:
            if out:
                out.write(bytes(1024))
                out.close()
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    copied = materialise(named.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("t1", "t2", F.col("first.doc_id").alias("owner")), "copied")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    # the owner column is null both without copies and for a null id: a mark tells them apart
    rows = rows.join(side(copied.withColumn("shared", F.lit(True))), ["t1", "t2"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    writers = rows.where(~F.col("shared") | F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", "text", "t1", "t2", "shared")
    placed = materialise(writers.mapInArrow(run, PLACED), "media-places", f"{folder}/places")
    cols = ["digest", "shard", "offset", "length"]
    place = F.min(F.struct(*[F.col(c) for c in cols])).alias("place")
    once = placed.where("shared").groupBy("t1", "t2").agg(place)
    others = named.join(side(once), ["t1", "t2"]).select("doc_id", *[F.col(f"place.{c}").alias(c) for c in cols])
    return materialise(placed.where("not shared").select("doc_id", *cols).union(others), "media-index", f"{folder}/index")


def describe(index: DataFrame) -> DataFrame:
    """``index`` with metadata from header ranges and features from the stored bytes (``FEATURES``).

    Width, height, bit depth and colour type need the first bytes of a member
    only. Then the member's range is read once in a batch however many rows
    carry it, checked against its digest, and decoded.
    """
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, src = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest"))))
            found = {}
            for place in sorted(set(places)):
                shard, offset, length, digest = place
                if shard != uri:
                    if src:
                        src.close()
                    uri, src = shard, open_input(shard)
                src.seek(offset)
                head = png_header(src.read(HEADER))
                src.seek(offset)
                media = src.read(length)
                while len(media) < length:
                    media += src.read(length - len(media))
                sha = hashlib.sha256(media).hexdigest()
                if sha != digest:
                    raise OSError(f"{shard} at {offset}: content differs from its digest")
                payload = from_png(media)
                found[place] = (
                    *head, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha, feature(payload),
                )
            cols = list(zip(*[found[p] for p in places])) or [[]] * len(names)
            types = [pa.int32()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(c, t) for c, t in zip(cols, types)], batch.schema.names + names)

    return index.mapInArrow(run, f"{INDEX}, {FEATURES}")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Index and features of every row's text, stored as an 8-bit grey picture.

    Null texts count as empty; very long texts are stored whole; equal texts
    have equal values in all columns, shard and offset too; repeated rows and
    null ids stay; no rows give no rows; other columns are ignored.
    """
    return describe(store(docs, folder or shared_path(docs.sparkSession, "media")))
