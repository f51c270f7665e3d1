"""Token-id files: ids end to end, document boundaries and ids as Elias-Fano sequences."""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans.shared import materialise, qualified, shared_path, trim
from foliant.sources.files import open_input, open_output

MAGIC = b"FTOKEF01"
#: Trailer: bytes of boundaries and doc ids, documents, ids, documents with a null doc_id, bytes of an id, magic.
TRAILER = "<QQQQQI8s"
#: Bits of the upper bit vector between two entries of the select directory.
STRIDE = 512


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(range / length) bits a value.

    The low bits stand end to end; the high bits are a unary bit vector with
    a 32-bit count of ones for every ``STRIDE`` bits, by which ``select``
    finds one value without the others.
    """

    HEAD = "<QqBQQ"

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.ranks = n, base, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if n >= 1 << 32:
            raise ValueError("a file holds fewer than 2^32 documents")
        base = int(values[0]) if n else 0
        v = values.astype(np.int64).view(np.uint64) - np.int64(base).view(np.uint64)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n and int(v[-1]) >= n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % (STRIDE // 8), np.uint8)])
        ones = np.bitwise_count(high).reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype(np.uint32) if len(ones) else np.zeros(0, np.uint32)
        return cls(n, base, bits, low, high, ranks)

    def to_bytes(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.base, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, bits, lows, highs = struct.unpack_from(cls.HEAD, data)
        at = struct.calcsize(cls.HEAD)
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, base, bits, low, high, np.frombuffer(data, "<u4", highs * 8 // STRIDE, at + lows + highs))

    def select(self, i: int) -> int:
        """The i-th value, from one stride of the high bits and its own low bits."""
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        width = STRIDE // 8
        ones = np.flatnonzero(np.unpackbits(self.high[block * width : (block + 1) * width], bitorder="little"))
        high = block * STRIDE + int(ones[i - int(self.ranks[block])]) - i
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            some = self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes()
            low = (int.from_bytes(some, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)
        return ((high << self.low_bits) | low) + self.base

    def values(self) -> np.ndarray:
        """All values."""
        high = (np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)).astype(np.uint64)
        low = np.zeros(self.n, np.uint64)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                low |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return ((high << np.uint64(self.low_bits)) | low).view(np.int64) + self.base


class TokenFile:
    """Reads one file: all documents, or one without the others."""

    def __init__(self, uri: str):
        self.src = open_input(uri)
        self.src.seek(0, 2)
        end, tail = self.src.tell(), struct.calcsize(TRAILER)
        b, d, self.n_docs, self.n_ids, self.nulls, self.width, magic = struct.unpack(TRAILER, self._read(end - tail, tail))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.bounds = EliasFano.from_bytes(self._read(end - tail - d - b, b))
        self.doc_ids = EliasFano.from_bytes(self._read(end - tail - d, d))

    def _read(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        parts = []
        while n:
            got = self.src.read(n)
            if not got:
                raise EOFError
            parts.append(got)
            n -= len(got)
        return b"".join(parts)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        start, end = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def documents(self, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first document, starts, ends, ids of those documents): runs of about ``most`` ids."""
        bounds, at = self.bounds.values(), 0
        while at < self.n_docs:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            to = min(to, self.n_docs)
            first, last = int(bounds[at]), int(bounds[to])
            ids = np.frombuffer(self._read(first * self.width, (last - first) * self.width), f"<u{self.width}")
            yield at, bounds[at:to], bounds[at + 1 : to + 1], ids
            at = to

    def close(self) -> None:
        self.src.close()


class Remembered:
    """Ids of words by 128-bit hashes: an open-addressed table of arrays, a run of ids for each entry."""

    def __init__(self, most: int, kind: str):
        self.most, self.kind = most, kind
        self.mask = np.uint64((1 << (most + most // 3).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.k1, self.k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.entry = np.full(size, -1, np.int32)
        self.n, self.starts, self.lens = 0, np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(h1), -1, np.int32)
        rows, at = np.arange(len(h1)), (h1 & self.mask).astype(np.int64)
        while len(rows):
            got = self.entry[at]
            same = (self.k1[at] == h1[rows]) & (self.k2[at] == h2[rows]) & (got >= 0)
            out[rows[same]] = got[same]
            go = ~same & (got >= 0)
            rows, at = rows[go], (at[go] + 1) & int(self.mask)
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """New, different hashes with their ids end to end; together with the others at most ``most``."""
        n = len(h1)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : self.n + n] = lens
        names = np.arange(self.n, self.n + n, dtype=np.int32)
        self.n, self.used = self.n + n, self.used + len(ids)
        rows, at = np.arange(n), (h1 & self.mask).astype(np.int64)
        while len(rows):
            free = self.entry[at] < 0
            self.entry[at[free]] = names[rows[free]]  # of several that want a place one stays
            won = self.entry[at] == names[rows]
            self.k1[at[won]], self.k2[at[won]] = h1[rows[won]], h2[rows[won]]
            rows, at = rows[~won], (at[~won] + 1) & int(self.mask)


#: Bases of the two rolling hashes of a word's bytes, and the longest word that is hashed so (longer ones by BLAKE2).
BASES, LONG_WORD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 1 << 12


class Hasher:
    """128-bit hashes of the values of an Arrow string array, from prefix sums over its bytes."""

    def __init__(self, stretch: int = 1 << 18):
        self.stretch, self.powers = stretch, []
        for base in BASES:
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(stretch + LONG_WORD + 1, b, np.uint64)
                p[0] = 1
                self.powers.append(np.multiply.accumulate(p))

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ends``: n + 1 offsets into ``data``."""
        lens = np.diff(ends)
        out = [np.zeros(len(lens), np.uint64) for _ in BASES]
        at = 0
        while at < len(lens):
            if lens[at] > LONG_WORD:
                d = hashlib.blake2b(data[ends[at] : ends[at + 1]].tobytes(), digest_size=16).digest()
                out[0][at], out[1][at] = np.frombuffer(d, np.uint64)
                at += 1
                continue
            to = int(np.searchsorted(ends, ends[at] + self.stretch, side="right"))
            to = max(at + 1, min(len(lens), to - 1))
            if (long := np.flatnonzero(lens[at:to] > LONG_WORD)).size:
                to = at + int(long[0])
            some = data[ends[at] : ends[to]].astype(np.uint64) + np.uint64(1)
            s, e = ends[at:to] - ends[at], ends[at + 1 : to + 1] - ends[at]
            for k, h in enumerate(out):
                sums = np.zeros(len(some) + 1, np.uint64)
                np.cumsum(some * self.powers[2 * k][: len(some)], out=sums[1:])
                x = (sums[e] - sums[s]) * self.powers[2 * k + 1][s]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                h[at:to] = x ^ (x >> np.uint64(29))
            at = to
        return out[0], out[1]


class Encoder:
    """Whole texts to ids by the tokenizers library; what stands between two lone spaces is encoded once.

    A byte-level BPE splits text before a white-space run, so a text whose
    white space is single can be cut before each space or line feed and the
    parts' ids joined; so can the marks that end a word be cut from its last
    letter. Any other text, one with a special token's string or a NUL, and
    all texts of another kind of tokenizer are encoded whole. Texts stay in
    Arrow buffers: only parts that aren't remembered become strings. At most
    ``most`` parts are remembered, about 50 bytes each.
    """

    #: White space but lone spaces and line feeds, and the marks of parts.
    _WHOLE = r"[ \n]{2}|[\x00\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    #: Marks behind a Latin letter, at the end of a word.
    _TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?]+)([ \n]|$)"

    def __init__(self, path: str, end_id: int, width: int, most: int = 3 << 19):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        if max(end_id, *t.get_vocab(with_added_tokens=True).values()) >= 1 << (8 * width):
            raise ValueError(f"ids of this vocabulary need more than {width} bytes")
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.whole = "|".join([self._WHOLE, *map(_quoted, added)])
        self.kind, self.end = f"<u{width}", end_id
        self.known, self.hashes = Remembered(most, self.kind), Hasher()
        pre = t.pre_tokenizer
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256 and on
        plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
        self.bytes = [chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b))) for b in range(256)]
        self.splits = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and t.normalizer is None

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each); a few thousand results of the library are held at once."""
        ids, lens = array("Q"), array("q")
        for s in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[s : s + 4096], add_special_tokens=False):
                got = e.ids
                ids.extend(got)
                lens.append(len(got))
        return np.array(ids, self.kind), np.array(lens)

    def _learned(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``, of parts: a space and letters is one piece for the pre-tokenizer, so the library's model takes it as it is."""
        plain = [x.isalpha() and max(x) < "\u0500" for x in parts]  # letters in every version of Unicode
        simple = [k for k, x in enumerate(plain) if x]
        other = [k for k, x in enumerate(plain) if not x]
        byte, tokenize, ids, lens = self.bytes, self.tokenizer.model.tokenize, array("Q"), np.zeros(len(parts), np.int64)
        for k in simple:
            x = parts[k]
            got = [t.id for t in tokenize("\u0120" + (x if x.isascii() else "".join([byte[b] for b in x.encode()])))]
            ids.extend(got)
            lens[k] = len(got)
        more, n = self._encode([x.lstrip("\0\1") if x[:1] in ("\n", "\0", "\1") and x else " " + x for x in map(parts.__getitem__, other)])
        lens[other] = n
        place = np.concatenate([np.array(simple, np.int64), np.array(other, np.int64)])
        where = np.empty(len(parts), np.int64)
        where[place] = np.cumsum(lens[place]) - lens[place]
        every = np.concatenate([np.array(ids, self.kind), more])
        return every[np.repeat(where - (np.cumsum(lens) - lens), lens) + np.arange(len(every))], lens

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each): of parts that stand after a space, or bare behind a line feed or mark."""
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        h1, h2 = self.hashes(data, ends)
        entry = self.known.find(h1, h2)
        new = np.flatnonzero(entry < 0)
        if len(new):
            new = new[np.unique(h1[new] ^ (h2[new] * np.uint64(3)), return_index=True)[1]]
            if self.known.n + len(new) > self.known.most:
                self.known.clear()
                new = np.unique(h1 ^ (h2 * np.uint64(3)), return_index=True)[1]
            self.known.add(h1[new], h2[new], *self._learned(words.take(pa.array(new)).to_pylist()))
            entry = self.known.find(h1, h2)
        lens = self.known.lens[entry].astype(np.int64)
        before = np.cumsum(lens) - lens
        return self.known.ids[np.arange(int(lens.sum())) + np.repeat(self.known.starts[entry] - before, lens)], lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with the end id; how many ids each has). Null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole) if self.splits else pa.array([True] * len(texts), pa.bool_())
        alone, cut = np.flatnonzero(whole), np.flatnonzero(pc.invert(whole))
        counts = np.zeros(len(texts), np.int64)
        cuts = pc.replace_substring(pc.replace_substring_regex(texts.take(pa.array(cut)), self._TAIL, "\\1 \x01\\2\\3"), "\n", " \n")
        first, none = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
        parts = pc.split_pattern(pc.binary_join_element_wise(first, cuts, none), " ")
        words, firsts, step = parts.flatten(), parts.offsets.to_numpy().astype(np.int64), self.known.most // 4
        pieces, lens = [], []
        for s in range(0, len(words), step):
            ids, n = self._parts(words.slice(s, step))
            pieces.append(ids)
            lens.append(n)
        if len(cut):
            sums = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            counts[cut] = sums[firsts[1:]] - sums[firsts[:-1]]
        ids = np.concatenate([np.zeros(0, self.kind), *pieces])
        if len(alone):
            other, n = self._encode(texts.take(pa.array(alone)).to_pylist())
            counts[alone] = n
            at_cut, at_alone = np.cumsum(counts[cut]) - counts[cut], np.cumsum(n) - n
            where = np.empty(len(texts), np.int64)
            where[cut], where[alone] = at_cut, at_alone + len(ids)
            ids = np.concatenate([ids, other])[np.repeat(where - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        return np.insert(ids, np.cumsum(counts), self.end), counts + 1


def _quoted(text: str) -> str:
    """A pattern of RE2 that matches ``text`` itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _stretches(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes; a longer text stands alone."""
    sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """One encoder for each worker process; its memory of parts serves all its tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


FILES = "part int, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_bytes: int = 2, n_files: int | None = None) -> DataFrame:
    """Encodes all texts into ``n_files`` files in ascending doc_id order; gives ``FILES``, a written table.

    Texts are range-partitioned by doc_id (null first, ties by a hash of the
    text, so that rows without an id or with one id are dealt out too), and
    each task streams its ids to a file of its own attempt, about a megabyte
    of text at a time, then its boundaries and doc ids. ``n_files`` is the session's number of shuffle partitions by
    default. ``id_bytes`` is 2 or 4.
    """
    folder = qualified(docs.sparkSession, folder)
    n_files = n_files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, out, ends, ids, nulls, at, n = "", None, [], [], 0, 0, 0
        encoder = _encoder(tokenizer, end_id, id_bytes)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.ftok"
                out = open_output(path)
            for texts in _stretches(batch.column(1)):
                got, counts = encoder.encode(texts)
                out.write(got.tobytes())
                ends.append(at + np.cumsum(counts))
                at += len(got)
            col = batch.column(0)
            n, nulls = n + batch.num_rows, nulls + col.null_count
            ids.append(col.drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        bounds = EliasFano.of(np.concatenate([[0], *ends])).to_bytes()
        names = EliasFano.of(np.concatenate(ids).astype(np.int64)).to_bytes()
        out.write(bounds + names + struct.pack(TRAILER, len(bounds), len(names), n, at, nulls, id_bytes, MAGIC))
        out.close()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n_files, *order[:2]).sortWithinPartitions(*order).drop("tie")
    return materialise(placed.mapInArrow(run, FILES), "token-files", f"{folder}/files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path, position) of every document, from the files.

    ``start`` counts the ids of all documents before this one in all files;
    the counts by file, one row each, are summed in file order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
                f = TokenFile(path)
                names = f.doc_ids.values()
                for first, starts, ends, ids in f.documents():
                    wide, zero = ids.astype("<u4"), int(starts[0])
                    crcs = [zlib.crc32(wide[s:e]) for s, e in zip((starts - zero).tolist(), (ends - zero).tolist())]
                    place = np.arange(first, first + len(starts))
                    doc = pa.array(names[np.maximum(place - f.nulls, 0)] if len(names) else np.zeros(len(place), np.int64), mask=place < f.nulls)
                    cols = [doc, pa.array(starts + offset), pa.array(ends - starts), pa.array(crcs, pa.int64()), pa.array([path] * len(place)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "path", "position"])
                f.close()

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("offset"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return offsets.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long")


def token_documents(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_bytes: int = 2) -> DataFrame:
    """Writes token files of all texts and reads every document back from them.

    Null texts count as empty (the end id alone); very long texts are encoded
    whole; documents with a null doc_id come first; rows that repeat a doc_id
    stand side by side, in the order of a hash of their texts; no rows give no
    rows and no file; other columns are ignored. Ids that need more than
    ``id_bytes`` are refused.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder or shared_path(docs.sparkSession, "tokens"), id_bytes))
