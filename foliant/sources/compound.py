"""Compound files of the older office formats: streams, and the text of DOC, PPT and XLS."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

FREE = 0xFFFFFFF0  # sector numbers from here on are marks
MOST = 1 << 28


class Compound:
    """The streams of a compound file by lower-cased name; chains are followed within the file's own size."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError("not a compound file")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
        directory, self.cutoff, mini_fat, _, more, n_more = struct.unpack_from("<I4xIIIII", data, 48)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < FREE]
        for _ in range(n_more):
            block = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            fat_sectors += [s for s in block[:-1] if s < FREE]
            more = block[-1]
            if more >= FREE:
                break
        self.fat = [x for s in fat_sectors for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.mini_fat = self._numbers(self.chain(mini_fat)) if mini_fat < FREE else []
        self.entries = {}
        entries = self.chain(directory)
        mini = b""
        for at in range(0, len(entries) - 127, 128):
            n, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<II", entries, at + 116)
            name = entries[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace").lower()
            if kind == 5:
                mini = self.chain(start)[:size] if start < FREE else b""
            elif kind == 2:
                self.entries.setdefault(name, (start, size))
        self.mini = mini

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, start: int) -> bytes:
        out, seen = [], 0
        while start < FREE:
            if start >= len(self.fat) or seen * self.size > min(MOST, len(self.data)):
                raise ValueError("a broken chain")
            out.append(self.sector(start))
            start, seen = self.fat[start], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name.lower()]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], 0
        while start < FREE:
            if start >= len(self.mini_fat) or seen > len(self.mini_fat):
                raise ValueError("a broken chain")
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start, seen = self.mini_fat[start], seen + 1
        return b"".join(out)[:size]


def doc(data: bytes) -> Iterator[tuple]:
    """Paragraphs and table rows of a Word 97-2003 file, by its piece table; field codes are left out."""
    f = Compound(data)
    word = f.stream("WordDocument")
    if struct.unpack_from("<H", word, 10)[0] & 0x0100:
        raise ValueError("the file is encrypted")
    table = f.stream("1Table" if struct.unpack_from("<H", word, 10)[0] & 0x0200 else "0Table")
    (n_main,) = struct.unpack_from("<i", word, 0x4C)
    at, size = struct.unpack_from("<II", word, 0x1A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<h", clx, k + 1)[0]
    (size,) = struct.unpack_from("<I", clx, k + 1)
    pieces = clx[k + 5 : k + 5 + size]
    n = (len(pieces) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}i", pieces)
    parts = []
    for i in range(n):
        (fc,) = struct.unpack_from("<I", pieces, 4 * (n + 1) + 8 * i + 2)
        chars = ends[i + 1] - ends[i]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            parts.append(word[start : start + chars].decode("cp1252", "replace"))
        else:
            parts.append(word[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(parts)[:n_main]
    while (plain := re.sub(r"\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)) != text:
        text = plain
    row: list[str] = []
    rows: list[list[str]] = []
    for piece in re.findall(r"[^\r\x07]*[\r\x07]|[^\r\x07]+$", text):
        body, end = piece.rstrip("\r\x07"), piece[-1:]
        body = re.sub(r"[\x00-\x08\x0c\x0e-\x1f]", "", body.replace("\x0b", "\n").replace("\x1e", "-")).strip()
        if end == "\x07":
            if body or not row:
                row.append(body)
            elif row:  # an empty mark after cells ends the row
                rows.append(row)
                row = []
            continue
        if rows and not row:
            yield "rows", rows
            rows = []
        if body:
            yield "text", body
    if row:
        rows.append(row)
    if rows:
        yield "rows", rows


def ppt(data: bytes) -> Iterator[tuple[int, bool, str]]:
    """(slide, title, text) of the outline of a PowerPoint 97-2003 file."""
    stream = Compound(data).stream("PowerPoint Document")
    todo, slide, title = [(0, len(stream), False)], -1, False
    while todo:
        at, end, listed = todo.pop()
        if at + 8 > end:
            continue
        head, kind, size = struct.unpack_from("<HHI", stream, at)
        body, after = at + 8, at + 8 + size
        todo.append((after, end, listed))
        if head & 15 == 15:
            todo.append((body, min(after, end), listed or (kind == 4080 and head >> 4 == 0)))
        elif listed and kind == 1011:
            slide += 1
        elif listed and kind == 3999:
            title = struct.unpack_from("<I", stream, body)[0] in (0, 6)
        elif listed and kind in (4000, 4008):
            text = stream[body:after].decode("utf-16-le" if kind == 4000 else "latin-1", "replace")
            for line in re.split(r"[\r\x0b]", text):
                if line.strip():
                    yield max(slide, 0), title, line.strip()


class _Shared:
    """Reads the strings of an SST record and its continuations, where a string may be cut anywhere."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at == len(self.parts[self.part]):
                self.part, self.at = self.part + 1, 0
            some = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + some, n - len(some), self.at + len(some)
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at == len(self.parts[self.part]):  # a continuation says its width again
                self.part, self.at = self.part + 1, 1
                wide = self.parts[self.part][0] & 1
            some = min(n, (len(self.parts[self.part]) - self.at) // (2 if wide else 1))
            out.append(self.take(some * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= some
        self.take(4 * runs + extra)
        return "".join(out)


def _rk(v: int) -> float:
    x = float(v >> 2) if v & 2 and v < 1 << 31 else float((v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def xls(data: bytes) -> Iterator[tuple[int, str, dict[tuple[int, int], str], list[tuple[int, int, int, int]]]]:
    """(index, name, cells, merged ranges) of each visible sheet of a BIFF8 workbook."""
    from foliant.functions.formats import general

    f = Compound(data)
    book = f.stream("Workbook" if "workbook" in f.entries else "Book")

    def records(at: int) -> Iterator[tuple[int, bytes]]:
        while at + 4 <= len(book):
            kind, n = struct.unpack_from("<HH", book, at)
            yield kind, book[at + 4 : at + 4 + n]
            at += 4 + n
            if kind == 0x0A:
                return

    sheets, shared, open_sst = [], [], None
    for kind, body in records(0):
        if kind == 0x3C and open_sst is not None:
            open_sst.append(body)
            continue
        if kind == 0xFC:
            open_sst = [body]
        elif kind == 0x85:
            at, state, sort, n, flag = struct.unpack_from("<IBBBB", body)
            sheets.append((at, state, sort, body[8 : 8 + n * (1 + (flag & 1))].decode("utf-16-le" if flag & 1 else "latin-1")))
    if open_sst:
        (n,) = struct.unpack_from("<I", open_sst[0], 4)
        reader = _Shared([open_sst[0][8:], *open_sst[1:]])
        shared = [reader.text() for _ in range(n)]
    for k, (at, state, sort, name) in enumerate(sheets):
        if state or sort:
            continue
        cells, merged, waiting = {}, [], None
        for kind, body in records(at):
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06):
                row, col = struct.unpack_from("<HH", body)
            if kind == 0xFD:
                cells[row, col] = shared[struct.unpack_from("<I", body, 6)[0]]
            elif kind == 0x203:
                cells[row, col] = general(struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                cells[row, col] = general(_rk(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0xBD:
                row, col = struct.unpack_from("<HH", body)
                for i in range((len(body) - 6) // 6):
                    cells[row, col + i] = general(_rk(struct.unpack_from("<I", body, 6 + 6 * i)[0]))
            elif kind == 0x204:
                n, flag = struct.unpack_from("<HB", body, 6)
                cells[row, col] = body[9 : 9 + n * (1 + (flag & 1))].decode("utf-16-le" if flag & 1 else "latin-1")
            elif kind == 0x205 and not body[7]:
                cells[row, col] = "TRUE" if body[6] else "FALSE"
            elif kind == 0x06:
                if body[12:14] == b"\xff\xff":
                    waiting = (row, col) if body[6] == 0 else None
                else:
                    cells[row, col] = general(struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x207 and waiting:
                n, flag = struct.unpack_from("<HB", body)
                cells[waiting] = body[3 : 3 + n * (1 + (flag & 1))].decode("utf-16-le" if flag & 1 else "latin-1")
                waiting = None
            elif kind == 0xE5:
                for i in range(struct.unpack_from("<H", body)[0]):
                    r0, r1, c0, c1 = struct.unpack_from("<HHHH", body, 2 + 8 * i)
                    merged.append((r0, c0, r1, c1))
        yield k, name, {p: v for p, v in cells.items() if v}, merged
