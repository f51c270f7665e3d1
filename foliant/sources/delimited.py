"""Delimited text: encodings, delimiters, strict records and header rows."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Delimiters in order of preference, and how many records are looked at.
DELIMITERS = (",", ";", "\t", "|")
SAMPLE = 20

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def decode(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else GB18030 or Windows-1252, whichever reads with less oddity."""
    if data.startswith((b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")):
        raise ValueError("UTF-32 is not supported")
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig")
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    best = []
    for rank, name in enumerate(("cp1252", "gb18030")):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        odd = 10 * len(_CONTROL.findall(text)) + sum(c in "ÃÂ�¤¦§¨©ª«¬®¯±´¶·¸º»¼½¾¿Ð×" for c in text)
        best.append((odd, rank, text))
    if not best:
        raise ValueError("unknown encoding")
    return min(best)[2]


def sniff(text: str) -> tuple[str, str]:
    """(delimiter, text without its sep= line): the delimiter with the most records of one width, the wider one on a tie."""
    if m := re.match(r"(?i)sep=([,;\t|])(?:\r\n|\n|\r|$)", text):
        return m[1], text[m.end() :]
    found = []
    for rank, d in enumerate(DELIMITERS):
        widths = []
        try:
            for record in csv.reader(io.StringIO(text, newline=""), delimiter=d, strict=True):
                widths.append(max(1, len(record)))
                if len(widths) == SAMPLE:
                    break
        except csv.Error:
            continue
        if widths:
            width, times = max(Counter(widths).items(), key=lambda kv: (kv[1], kv[0]))
            if width > 1:
                found.append((times, width, -rank, d))
    return (max(found)[3] if found else ","), text


def records(data: bytes, delimiter: str | None = None) -> list[list[str]]:
    """All records; a malformed quote raises."""
    own, text = sniff(decode(data))
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or own, strict=True))


def read_cells(files: DataFrame) -> DataFrame:
    """(path, row, col, value) of files (path, content); a file that can't be read gives one row with its error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    for r, record in enumerate(records(bytes(data))):
                        rows += [(path, r, c, v, None) for c, v in enumerate(record)]
                except (ValueError, csv.Error) as e:
                    rows.append((path, -1, -1, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "row", "col", "value", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, row int, col int, value string, error string")
