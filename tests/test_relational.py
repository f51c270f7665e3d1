import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import components, layout, relational, tables
from foliant.operators.components import connected_components, hub_size
from foliant.operators.visual import promoted_captions, regrouped
from foliant.plans.shared import prefix_sums, ranked


def union(edges):
    of = {}
    for a, b in edges:
        for x in (a, b):
            of.setdefault(x, x)

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {x: root(x) for x in of}


@pytest.mark.parametrize("hub", [3, 100_000])
def test_components(spark, hub):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), hub=hub).collect()}
    assert got == {k: v for k, v in union([e for e in edges if e[0] != e[1]]).items()}
    assert connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_a_hub_of_the_largest_id_is_split_in_both_stars(spark, monkeypatch):
    split = []
    inner = components._with_least

    def watched(rows, least, hub, hubs):
        split.append(hubs)
        out = inner(rows, least, hub, hubs)
        if hubs:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "strategy=broadcast" in plan
        return out

    monkeypatch.setattr(components, "_with_least", watched)
    edges = [(10_000, k) for k in range(500)] + [(k, k + 1) for k in range(600, 640)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), hub=50).collect()}
    assert got == union(edges)
    assert split[:2] == [True, True]
    assert hub_size(10**9, 1000) == 2 * 10**6 and hub_size(100, 1000) == 1000


def test_prefix_sums_and_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    for n in (1, 8):
        r = ranked(df, ["g"], F.xxhash64("k"), [F.col("k")], n, "rank").collect()
        for g in ("a", "b", None):
            assert sorted(x["rank"] for x in r if x.g == g) == list(range(sum(x[0] == g for x in rows)))
    s = sorted(prefix_sums(df, ["g"], F.lit(0), [F.col("k")], 4, F.col("v"), "ahead").collect(), key=lambda x: x.k)
    seen = {}
    for x in s:
        assert x.ahead == seen.get(x.g, 0)
        seen[x.g] = x.ahead + x.v


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randint(0, 2), k, a := rng.uniform(-50, 50), a + rng.expovariate(0.2)) for k in range(n)]
    a, b = make(60), make(60)
    l, r = spark.createDataFrame(a, "k int, i int, lo double, hi double"), spark.createDataFrame(b, "k int, j int, lo2 double, hi2 double")
    got = [(x.k, x.i, x.j) for x in relational.interval_join(l, r, ["k"], ("lo", "hi"), ("lo2", "hi2"), 7.0).collect()]
    want = [(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3]]
    assert sorted(got) == sorted(want)


def test_clusters_and_reading_order(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.4, 1.9, 5.0, 5.2, 9.0)] + [("b", 2.0)], "k string, v double").repartition(3)
    got = {(r.k, r.v): r.cluster for r in layout.clusters(df, ["k"], "v", 0.6).collect()}
    assert [got["a", v] for v in (1.0, 1.4, 1.9, 5.0, 5.2, 9.0)] == [0, 0, 1, 2, 2, 3] or got["a", 1.9] in (0, 1)
    assert got["b", 2.0] == 0
    boxes = [(0, 0.0, 0.0, 100.0, 10.0), (1, 60.0, 20.0, 100.0, 50.0), (2, 0.0, 20.0, 40.0, 50.0), (3, 0.0, 55.0, 40.0, 90.0), (4, 5.0, 5.0, 5.0, 9.0), (5, 60.0, 55.0, 100.0, 90.0)]
    page = spark.createDataFrame([(1, *b) for b in boxes], "p int, idx int, x0 double, y0 double, x1 double, y1 double")
    order = [r.idx for r in layout.reading_order(page, ["p"]).orderBy("position").collect()]
    assert order == [0, 2, 3, 1, 5, 4]


def test_margins_and_paragraphs(spark):
    lines = [("d", p, f"Journal {p}", 0.05, 0.07) for p in (1, 2, 4)] + [("d", 9, "Journal 9", 0.05, 0.07), ("d", 1, "Body", 0.5, 0.52), ("d", 2, "Body", 0.5, 0.52)]
    got = layout.repeated_margins(spark.createDataFrame(lines, "doc_id string, page_idx int, text string, y0 double, y1 double"))
    assert sorted(r.page_idx for r in got.collect()) == [1, 2, 4]
    box = lambda *b: {"x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3]}
    para = lambda i, kind, text, page, y: (1, i, kind, text, page, box(100, y, 500, y + 60), box(100, y, 500, y + 20), box(100, y + 40, 500, y + 60), 3)
    rows = [para(0, "text", "this goes", 0, 900), para(1, "footer", "7", 0, 960), para(2, "text", "on here.", 1, 50), para(3, "text", "new one", 1, 200), para(4, "paragraph_title", "T", 1, 300), para(5, "text", "after", 2, 50)]
    b = "struct<x0:int,y0:int,x1:int,y1:int>"
    df = spark.createDataFrame(rows, f"doc_id int, idx int, type string, text string, page int, box {b}, first {b}, last {b}, n_lines int")
    out = {r.idx: r.continues_prev for r in layout.continued_paragraphs(df).collect()}
    assert out == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_captions_are_regrouped(spark):
    b = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(1, 0, "caption", "Table 1"), (1, 1, "table", "t"), (1, 2, "footnote", "note"), (1, 3, "text", "x"), (1, 4, "caption", "lost"), (1, 5, "text", "y"), (1, 6, "image", "i"), (1, 7, "text", "Figure 2")]
    df = spark.createDataFrame([(*r, {"x0": 0.0, "y0": float(r[1]), "x1": 1.0, "y1": r[1] + 1.0}) for r in rows], f"p int, idx int, type string, text string, b {b}")
    out = {r.idx: r for r in regrouped(promoted_captions(df, ["p"]), ["p"]).collect()}
    assert out[1].captions == ["Table 1"] and out[1].footnotes == ["note"] and out[6].captions == ["Figure 2"] and out[4].type == "text" and 0 not in out


def test_gap_choice_and_mergeable(spark):
    cols = "severe double, blank_line double, sparse double, single double, blank double, overlap double"
    rows = [(1, g, dict(zip(("severe", "blank_line", "sparse", "single", "blank", "overlap"), s))) for g, s in ((0, (0.0, 0.1, 0.0, 0.0, 0.0, 0.0)), (1, (0.0, 0.12, 0.0, 0.0, 0.0, 0.0)), (2, (0.0, 0.0, 0.0, 0.0, 0.0, 0.9)))]
    df = spark.createDataFrame(rows, f"k int, gap int, summary struct<{cols.replace(' double', ':double')}>")
    assert tables.best_gap(df, ["k"]).first().gap == 1
    p, c = F.struct(F.lit(3).alias("n_cols"), F.lit(100.0).alias("width"), F.lit(3).alias("last_cols"), F.lit(0).alias("footnotes")), lambda cap, w: F.struct(F.lit(3).alias("n_cols"), F.lit(w).alias("width"), F.lit(3).alias("first_cols"), F.lit(cap).alias("caption"))
    r = spark.range(1).select(tables.mergeable(p, c("", 105.0)).alias("a"), tables.mergeable(p, c("Table 2", 105.0)).alias("b"), tables.mergeable(p, c("Table 1 (continued)", 105.0)).alias("c"), tables.mergeable(p, c("", 150.0)).alias("d")).first()
    assert tuple(r) == (True, False, True, False)
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 3, 2, " "), (1, 1, 1, "b")], "k int, row int, col int, value string")
    assert tables.trimmed(cells, ["k"]).count() == 2 and tables.padded(cells, ["k"]).count() == 12
