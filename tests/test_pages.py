"""Page rules that SQL can't say, against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import page_tables
from foliant.operators.layout import xy_cut


def rows_of(boxes):
    """One after another by the middle: the nearest open row that fits."""
    heights = sorted(b - a for _, _, a, b in boxes)
    n = len(heights)
    near = max(0.75, 0.4 * (heights[(n - 1) // 2] + heights[n // 2]) / 2)
    rows, out = [], {}
    for i, _, a, b in sorted(boxes, key=lambda t: ((t[2] + t[3]) / 2, t[1], t[0])):
        fits = []
        for k, (lo, hi) in enumerate(rows):
            off, shared = abs((lo + hi) / 2 - (a + b) / 2), min(hi, b) - max(lo, a)
            if off <= near or (shared > 0 and shared >= 0.45 * min(hi - lo, b - a)):
                fits.append((off, -k))
        if fits:
            k = -min(fits)[1]
            rows[k] = (min(rows[k][0], a), max(rows[k][1], b))
        else:
            k = len(rows)
            rows.append((a, b))
        out[i] = k
    return out


def test_visual_rows(spark):
    rng = random.Random(1)
    data, want = [], {}
    for page in range(30):
        boxes = []
        for i in range(rng.randint(1, 40)):
            top = rng.choice([10, 24, 38, 52]) + rng.random() * 3
            boxes.append((i, rng.random() * 300, top, top + rng.choice([8.0, 10.0, 16.0])))
        data += [(page, i, x, a, x + 5, b) for i, x, a, b in boxes]
        want |= {(page, i): k for i, k in rows_of(boxes).items()}
    df = spark.createDataFrame(data, "page int, idx int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.idx): r.row for r in page_tables.visual_rows(df, ["page"]).collect()} == want


def test_similar_texts(spark):
    pairs = [("Page 12 of 40", "Page 13 of 40", True), ("Annual report", "Annual rapport", False), ("", "", True), ("same", "same", True), ("abcdefgh", "abcdefgx", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", page_tables.similar(F.col("a"), F.col("b"), 0.92)).collect())


def ordered(boxes):
    return xy_cut(np.array(boxes, float))


def test_reading_order_of_known_pages():
    two = [(0, 0, 90, 10), (110, 0, 200, 10), (0, 20, 90, 30), (110, 20, 200, 30)]
    assert ordered(two) == [0, 2, 1, 3]
    titled = [(0, -20, 200, -10), *two]
    assert ordered(titled) == [0, 1, 3, 2, 4]
    middle = [*two, (0, 40, 200, 50), (0, 60, 90, 70), (110, 60, 200, 70)]
    assert ordered(middle) == [0, 2, 1, 3, 4, 5, 6]
    assert ordered([(0, 0, 90, 10), (92, 0, 200, 10), (0, 20, 90, 30)]) == [0, 1, 2]  # two points are no gap between columns
    loose = [(0, 0, 100, 40), (110, 0, 200, 40), (0, 60, 100, 100), (110, 60, 200, 100)]
    assert ordered(loose) == [0, 2, 1, 3]
    packed = [(0, 0, 100, 47), (105, 0, 200, 47), (0, 52, 100, 100), (105, 52, 200, 100)]
    assert ordered(packed) == [0, 1, 2, 3]  # over 0.9 of the region is covered: rows first
    bridge = [(0, 0, 90, 10), (110, 0, 200, 10), (0, 20, 90, 30), (110, 20, 200, 30), (88, 12, 106, 18)]
    assert ordered(bridge) == [0, 4, 2, 1, 3]  # a narrow box doesn't hide the gap
    assert ordered([(0, 0, 1, 1)]) == [0]
