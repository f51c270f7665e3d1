import hashlib
import json
import random
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import media
from foliant.llm.token_files import EliasFano, Encoder, TokenFile, read_token_files, token_documents, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_picture_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 9, "漢".encode() * 5000):
        payload = media.pad(data)
        assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
        png = media.to_png(payload)
        assert media.from_png(png) == payload
        assert media.png_header(png[: media.HEADER]) == (576, len(payload) // 576, 8, 0)


def test_every_text_is_stored_and_read_back(edge, empty, tmp_path):
    folder = f"file://{tmp_path}/m"
    got = media.media_columns(edge, folder).collect()
    texts = sorted(((r.doc_id, r.text) for r in edge.collect()), key=str)
    assert len(got) == len(texts)
    want = sorted((str(i), len((t or "").encode()), hashlib.sha256(media.pad((t or "").encode())).hexdigest(), zlib.crc32(media.pad((t or "").encode())[-32:])) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            member = next(m for m in tar if m.offset_data == r.offset)
            assert member.size == r.length and member.name.endswith(f"{r.digest}.png")
    places, shards = {}, {r.shard for r in got}
    for r in got:
        places.setdefault(r.payload_sha256, set()).add((r.shard, r.offset, r.media_sha256, r.feature))
    assert all(len(p) == 1 for p in places.values())
    members = 0
    for shard in shards:
        with tarfile.open(shard.removeprefix("file://")) as tar:
            members += len(tar.getmembers())
    # one member for each payload, but where rows repeat a doc_id and a text each task may hold one
    assert len(places) <= members <= len(places) + 1
    assert media.media_columns(empty, f"file://{tmp_path}/e").count() == 0


def test_feature_is_brightness_by_stretches():
    rng = random.Random(3)
    for n in (1, 2, 30):
        payload = bytes(rng.randrange(256) for _ in range(576 * n))
        cuts = [k * len(payload) // 64 for k in range(65)]
        mean = sum(payload) / len(payload)
        bits = "".join(str(int(sum(payload[a:b]) / (b - a) > mean)) for a, b in zip(cuts, cuts[1:]))
        assert media.feature(payload) == f"{int(bits, 2):016x}"


def test_copies_are_stored_once(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('text ', id % 700) end as text").repartition(7)
    index = media.store(df, f"file://{tmp_path}/m")
    assert index.count() == 3000
    assert index.select("shard", "offset").distinct().count() == index.select("digest").distinct().count() == df.select("text").distinct().count()


def test_changed_bytes_are_noticed(spark, edge, tmp_path):
    index = media.store(edge, f"file://{tmp_path}/c")
    row = index.first()
    path = row.shard.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[row.offset + row.length // 2] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        media.describe(index).collect()


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2, 3], [-7, -7, 0, 10**15], list(range(0, 100_000, 7))])
def test_elias_fano(values):
    ef = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert ef.values().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 50)):
        assert ef.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 15 * len(values)


def test_encoder_equals_the_library():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    pieces = ["hello", "World", "don't", "a.b", "x,", "..", " ", "  ", "\n", "\n\n", " \n", "\t", "漢字", "é", "12", "'s", " ", "<|endoftext|>", "!", "#$%", "\r\n", "\x00", "\x1c", "🙂"]
    texts = ["", " ", "a", *["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(600)]]
    texts += ["end. a, b;\nc!? d.", "x.", "\x01a", "a.) b.", "é.", "ж, ж.", "w" * 5000 + " b.", "İ. ẞ, Ω!"]
    want = [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]
    for most in (10**6, 50):
        encoder = Encoder(PATH, 2, 2, most)
        for _ in range(2):
            ids, counts = encoder.encode(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        ids, counts = encoder.encode(pa.array([None, "a"], pa.string()))
        assert counts.tolist() == [1, 2] and ids[0] == 2


def test_encoder_leaves_other_tokenizers_whole_and_checks_the_width(tmp_path):
    data = json.loads(open(PATH).read())
    data["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(data))
    encoder = Encoder(str(tmp_path / "t.json"), 2, 4)
    texts = ["one two", "", " x. y"]
    ids, counts = encoder.encode(pa.array(texts))
    assert not encoder.splits
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*e.ids, 2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        Encoder(PATH, 2, 1)


def test_token_files(spark, edge, corpus, empty, tmp_path):
    t = Tokenizer.from_file(PATH)
    for name, df in (("a", edge), ("b", corpus)):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(ids.tobytes())))
        files = write_token_files(df, PATH, 2, f"file://{tmp_path}/{name}", 2, 3)
        got = sorted(read_token_files(files).collect(), key=lambda r: r.start)
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert ids == sorted(ids)
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
        one = got[len(got) // 2]
        f = TokenFile(one.path)
        assert zlib.crc32(f.ids(one.position).astype("<u4").tobytes()) == one.ids_crc32
        f.close()
    assert token_documents(empty, PATH, 2, f"file://{tmp_path}/e").count() == 0
