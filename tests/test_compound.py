import struct

from foliant.sources import packages
from foliant.sources.compound import Compound, _rk
from foliant.sources.detect import suffix_of


def compound(streams):
    """A compound file of 512-byte sectors whose streams are all at least as long as the cutoff, or in the mini stream."""
    mini, mini_fat, where, big = b"", [], {}, []
    for name, data in streams.items():
        if len(data) < 4096:
            n = -(-len(data) // 64)
            where[name] = len(mini_fat), len(data)
            mini_fat += [len(mini_fat) + 1 + i for i in range(n - 1)] + [0xFFFFFFFE]
            mini += data.ljust(64 * n, b"\0")
        else:
            big.append((name, data))
    chains = [b""]  # directory comes first, once its length is known
    chains += [struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")] + [mini] + [d for _, d in big]
    n_dir = -(-(len(streams) + 1) // 4)
    starts, fat = [], []
    for k, c in enumerate(chains):
        n = n_dir if k == 0 else max(1, -(-len(c) // 512))
        starts.append(len(fat))
        fat += [len(fat) + 1 + i for i in range(n - 1)] + [0xFFFFFFFE]
    for (name, data), s in zip(big, starts[3:]):
        where[name] = s, len(data)
    n_fat = -(-(len(fat) + 4) // 128)
    fat_at = len(fat)
    fat += [0xFFFFFFFD] * n_fat
    fat += [0xFFFFFFFF] * (128 * n_fat - len(fat))

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, starts[2], len(mini)) + b"".join(entry(n, 2, *where[n]) for n in streams)
    body = directory.ljust(512 * n_dir, b"\0") + b"".join(c.ljust(512 * max(1, -(-len(c) // 512)), b"\0") for c in chains[1:]) + struct.pack(f"<{len(fat)}I", *fat)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", n_fat, 0, 0, 4096, starts[1], 1, 0xFFFFFFFE, 0)
    head = head[:44] + struct.pack("<IIIIIIII", n_fat, starts[0], 0, 4096, starts[1], 1, 0xFFFFFFFE, 0)
    difat = [fat_at + i for i in range(n_fat)]
    return (head + struct.pack(f"<{n_fat}I", *difat)).ljust(512, b"\xff") + body


def test_streams():
    data = compound({"A": b"x" * 100, "Big": bytes(range(256)) * 40})
    f = Compound(data)
    assert f.stream("a") == b"x" * 100 and f.stream("BIG") == bytes(range(256)) * 40


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_xls():
    text = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    sst = struct.pack("<II", 2, 2) + text("name") + struct.pack("<HB", 6, 0) + b"abc"
    globals_ = lambda at: record(0x809, bytes(16)) + record(0x85, struct.pack("<IBBBB", at, 0, 0, 1, 0) + b"S") + record(0xFC, sst) + record(0x3C, b"\0def") + record(0x0A, b"")
    at = len(globals_(0))
    sheet = record(0x809, bytes(16)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5))
    sheet += record(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2)) + record(0xE5, struct.pack("<HHHHH", 1, 2, 2, 0, 1)) + record(0x205, struct.pack("<HHHBB", 2, 0, 0, 1, 0)) + record(0x0A, b"")
    data = compound({"Workbook": (globals_(at) + sheet)})
    assert suffix_of(data) == "xls"
    (row,) = packages.parse(data)
    assert row[3] == "S" and row[7] == "name\tabcdef\n2.5\t7\nTRUE" and 'colspan="2"' in row[8]
    assert _rk((0xFFFFFFFF & (-5 << 2)) | 2) == -5 and _rk((250 << 2) | 3) == 2.5


def test_ppt():
    rec = lambda head, kind, body: struct.pack("<HHI", head, kind, len(body)) + body
    listed = rec(0, 1011, bytes(20)) + rec(0, 3999, struct.pack("<I", 0)) + rec(0, 4008, b"Title") + rec(0, 3999, struct.pack("<I", 1)) + rec(0, 4000, "a\rb".encode("utf-16-le")) + rec(0, 1011, bytes(20)) + rec(0, 4008, b"next")
    data = compound({"PowerPoint Document": rec(15, 1000, rec(15, 4080, listed))})
    assert [(r[2], r[5], r[7]) for r in packages.parse(data)] == [(0, "paragraph_title", "Title"), (0, "text", "a"), (0, "text", "b"), (1, "text", "next")]


def test_doc():
    text = "Head\rA\x13 HYPERLINK x\x14link\x15 b\rc1\x07c2\x07\x07tail\r"
    one, two = text[:9].encode("cp1252"), text[9:].encode("utf-16-le")
    word = bytearray(2048)
    struct.pack_into("<H", word, 10, 0x0200)
    struct.pack_into("<i", word, 0x4C, len(text))
    word[1024 : 1024 + len(one)] = one
    word[1200 : 1200 + len(two)] = two
    plc = struct.pack("<3i", 0, 9, len(text)) + struct.pack("<HIH", 0, 0x40000000 | 2048, 0) + struct.pack("<HIH", 0, 1200, 0)
    clx = b"\x01\x02\x00ab" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", word, 0x1A2, 4, len(clx))
    data = compound({"WordDocument": bytes(word), "1Table": b"\0" * 4 + clx})
    assert suffix_of(data) == "doc"
    assert [(r[5], r[7]) for r in packages.parse(data)] == [("text", "Head"), ("text", "Alink b"), ("table", "c1\tc2"), ("text", "tail")]


def test_damage_is_a_row():
    data = compound({"Workbook": b"\x09\x08\xff\xff"})
    assert packages.parse(data[:700])[0][-1] or packages.parse(data[:700]) == []
