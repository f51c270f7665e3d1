"""Range joins, islands, lookups behind barriers and choices with a veto, as DataFrame patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bins(lo: Column, hi: Column, width: float) -> Column:
    """The numbers of the bins that [lo, hi] touches."""
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: float, most: int = 64) -> DataFrame:
    """Pairs whose closed ranges meet, by equal (keys, bin): each pair once, in the bin where the later range starts.

    Both sides are copied to each bin of ``width`` that they touch, so rows
    meet only neighbours; no side is paired with all of the other. A range
    over ``most`` bins long goes to wider bins of its own size class (each
    ``most`` times the last), where it meets shorter ranges by theirs, so a
    row has at most ``most`` + 1 copies for each class that is present.
    """
    (a, b), (c, d) = left_range, right_range

    def classed(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
        bins_ = F.greatest(F.lit(1.0), (F.col(hi) - F.col(lo)) / width)
        return df.withColumn(name, F.greatest(F.lit(0), F.ceil(F.log(float(most), bins_)) - 1).cast("int"))

    l, r = classed(left, a, b, "__lc"), classed(right, c, d, "__rc")
    top = l.agg(F.max("__lc")).first()[0] or 0, r.agg(F.max("__rc")).first()[0] or 0
    classes = F.sequence(F.lit(0), F.lit(max(top)))
    wide = F.lit(float(width)) * F.pow(F.lit(float(most)), F.col("__class"))

    def dealt(df: DataFrame, lo: str, hi: str, own: str) -> DataFrame:
        d_ = df.withColumn("__class", F.explode(F.filter(classes, lambda k: k >= F.col(own))))
        return d_.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / wide).cast("long"), F.floor(F.col(hi) / wide).cast("long"))))

    pairs = dealt(l, a, b, "__lc").join(dealt(r, c, d, "__rc"), [*keys, "__class", "__bin"])
    meets = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__class") == F.greatest("__lc", "__rc"))
    first = F.floor(F.greatest(F.col(a), F.col(c)) / wide).cast("long")
    return pairs.where(meets & (first == F.col("__bin"))).drop("__bin", "__class", "__lc", "__rc")


def point_in_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points with the closed ranges they lie in; only ranges are copied to bins."""
    p = points.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))
    r = ranges.withColumn("__bin", F.explode(bins(F.col(lo), F.col(hi), width)))
    return p.join(r, [*keys, "__bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("__bin")


def islands(df: DataFrame, keys: list[str], value: str, step: float = 1) -> DataFrame:
    """(keys, lo, hi, n): runs of different values that are at most ``step`` apart."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct()
    d = d.withColumn("__new", F.when(F.col(value) - F.lag(value).over(w) <= step, 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(w))
    return d.groupBy(*keys, "__run").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n")).drop("__run")


def merged_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, touch: float = 0) -> DataFrame:
    """(keys, lo, hi): the union of closed intervals; those at most ``touch`` apart are one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__new", F.when(F.col(lo) <= before + touch, 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("__run")


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """(keys, longest): the most consecutive rows for which ``flag`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__f", flag).withColumn("__g", F.row_number().over(w) - F.sum(F.col("__f").cast("int")).over(w))
    runs = d.groupBy(*keys, "__g").agg(F.sum(F.col("__f").cast("int")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def last_behind_barrier(df: DataFrame, keys: list[str], order: str, wanted: Column, barrier: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the last earlier row that is wanted, unless a barrier row stands between."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__epoch", F.coalesce(F.sum(barrier.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*keys, "__epoch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.last(F.when(wanted, value), ignorenulls=True).over(inner)).drop("__epoch")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its keys at or before it.

    Both sides are one sorted stream and the values are carried forward: one
    shuffle, no pairs. A left row without an earlier right row has nulls.
    """
    packed = F.struct(F.col(right_at).alias("at"), *[F.col(v) for v in values])
    l = left.withColumn("__at", F.col(left_at)).withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType))
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), packed.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, F.col("__r.at").alias(f"{right_at}_asof"), *[F.col(f"__r.{v}").alias(f"{v}_asof") for v in values])


def best_with_veto(df: DataFrame, keys: list[str], score: str, kind: str, least: float, gap: float, ties: list[Column]) -> DataFrame:
    """The best row of each key at or over ``least``, unless one of another kind scores within ``gap`` of it."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(score) >= least).withColumn("__rank", F.row_number().over(w.orderBy(F.desc(score), *ties)))
    d = d.withColumn("__best", F.max(F.when(F.col("__rank") == 1, F.struct(score, kind))).over(w))
    rival = (F.col(kind) != F.col("__best")[kind]) & (F.col("__best")[score] - F.col(score) < gap)
    d = d.withColumn("__veto", F.max(rival).over(w))
    return d.where((F.col("__rank") == 1) & ~F.col("__veto")).drop("__rank", "__best", "__veto")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual_nearest(df: DataFrame, keys: list[str], a: str, b: str, distance: str) -> DataFrame:
    """Pairs (a, b) that are each other's nearest; the smaller name wins a tie."""
    best = lambda me, other: df.groupBy(*keys, me).agg(F.min(F.struct(distance, other)).alias("m")).select(*keys, me, F.col(f"m.{other}").alias(other))
    return best(a, b).join(best(b, a), [*keys, a, b])


def maximal_sets(df: DataFrame, keys: list[str], name: str, members: str) -> DataFrame:
    """Without rows whose set of members is a proper part of another's of the same keys.

    A part shares its rarest member with the whole, so rows meet by that
    member alone.
    """
    each = df.select(*keys, name, F.explode(members).alias("__m"))
    counts = each.groupBy(*keys, "__m").agg(F.count(F.lit(1)).alias("__c"))
    rare = each.join(counts, [*keys, "__m"]).groupBy(*keys, name).agg(F.min(F.struct("__c", "__m")).alias("r")).select(*keys, name, F.col("r.__m").alias("__m"))
    small = df.join(rare, [*keys, name]).select(*keys, "__m", F.col(name).alias("__small"), F.col(members).alias("__set"))
    large = each.join(df, [*keys, name]).select(*keys, "__m", F.col(members).alias("__of"))
    inside = small.join(large, [*keys, "__m"]).where((F.size("__set") < F.size("__of")) & (F.size(F.array_except("__set", "__of")) == 0))
    gone = inside.select(*keys, F.col("__small").alias(name)).distinct()
    return df.join(gone, [*keys, name], "left_anti")


def first_by(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """The first row of each key: what a dictionary keeps that ignores later entries."""
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("v"))
    return got.select(*keys, *[F.col(f"v.{x}").alias(x) for x in values])


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """(keys, mode, weight): the value with the most weight; the smaller value wins a tie."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    return top_k(sums, keys, [F.desc("weight"), F.asc(value)], 1).select(*keys, F.col(value).alias("mode"), "weight")


def _ranked_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, upto): different values with the number of rows up to and with each; rows are counted before anything is sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("__upto", F.sum("__c").over(w.orderBy(value))).withColumn("__n", F.sum("__c").over(w))


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """(keys, out): the sample at rank round-half-even((n - 1) q), from counts of the different values."""
    rank = F.bround((F.col("__n") - 1) * F.lit(float(q)))
    return _ranked_counts(df, keys, value).where(F.col("__upto") > rank).groupBy(*keys).agg(F.min(value).alias(out))


def linear_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``qs``): quantiles interpolated between the two samples around rank (n - 1) q."""
    d = _ranked_counts(df, keys, value)
    parts = []
    for name, q in qs.items():
        at = (F.col("__n") - 1) * F.lit(float(q))
        low = F.min(F.when(F.col("__upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value)))
        parts.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return d.groupBy(*keys).agg(*parts)


def nearest_value(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """(keys, a, b): for each left (name, value) the right name of the nearest value; the smaller name wins a tie.

    Both sides are one stream sorted by value, along which the last right
    value before and the first one after are carried: no pairs.
    """
    (an, av), (bn, bv) = a, b
    one = right.groupBy(*keys, bv).agg(F.min(bn).alias("__b"))
    r = one.select(*keys, F.col(bv).alias("__v"), F.struct(F.col(bv).alias("v"), F.col("__b").alias("b")).alias("__r"), F.lit(0).alias("__side"))
    l = left.select(*keys, F.col(av).alias("__v"), F.col(an), F.lit(1).alias("__side"))
    w = Window.partitionBy(*keys)
    # equal values come first on either way
    before = F.last("__r", ignorenulls=True).over(w.orderBy("__v", "__side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__r", ignorenulls=True).over(w.orderBy(F.desc("__v"), "__side").rowsBetween(Window.unboundedPreceding, 0))
    d = l.unionByName(r, allowMissingColumns=True).withColumn("__p", before).withColumn("__q", after).where("__side = 1")
    off = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col("__v") - F.col(x)["v"]).alias("d"), F.col(x)["b"].alias("b")))
    best = F.least(F.coalesce(off("__p"), off("__q")), F.coalesce(off("__q"), off("__p")))
    return d.withColumn("__m", best).where("__m is not null").select(*keys, an, F.col("__m.b").alias(bn))


def mutual_nearest_values(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of names that are each other's nearest by value; see ``nearest_value``."""
    return nearest_value(left, right, keys, a, b).join(nearest_value(right, left, keys, b, a), [*keys, a[0], b[0]])


def later_within(df: DataFrame, keys: list[str], at: str, reach: int, out: str) -> DataFrame:
    """Rows with ``out``: the whole number ``at`` of each row of equal keys that comes 1 to ``reach`` later; rows meet only such neighbours."""
    later = df.select(*keys, F.explode(F.array(*[F.col(at) - k for k in range(1, reach + 1)])).alias(at), F.col(at).alias(out))
    return df.join(later, [*keys, at])


def without(df: DataFrame, claimed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't claimed; a null key never is."""
    return df.join(claimed.select(*on).distinct(), on, "left_anti")


def distinct_union(parts: list[DataFrame]) -> DataFrame:
    """All different rows of several tables, by the names of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
