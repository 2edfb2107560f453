"""Exact, linearly interpolated quantiles (the pandas / DuckDB
``quantile_cont`` definition: rank h = (n - 1) p, value
x[floor h] + (x[floor h + 1] - x[floor h]) * frac h), overall or per group.

One distributed path serves every size. The distinct values are counted,
dealt out by range, and each range learns how many rows of its group lie in
the ranges before it; a running sum inside the range then gives every value
its ranks. A wanted rank is found by comparison, so nothing but one row per
column and probability ever reaches the driver, and no task holds a whole
column or a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

APPROX_ACCURACY = 10_000


def _same(left: DataFrame, right: DataFrame, names) -> Column:
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"_{n}"])
    return cond


def ranked_values(df: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by..., value, n, lo, hi, total): each distinct value of a group with its
    count, its 0-based ranks [lo, hi) and the group's number of non-NULL rows.
    A group of NULLs keeps one row with total 0."""
    counted = df.groupBy(*by, value).agg(F.count(value).alias("n"))
    ranged = counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # written, so that the parts stay as they are
    own = ["part", *by]
    sums = ranged.groupBy(*own).agg(F.sum("n").alias("m"))  # one row per range and group
    group = Window.partitionBy(*by)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in own],
                       (F.sum("m").over(group.orderBy("part")) - F.col("m")).alias("before"),
                       F.sum("m").over(group).alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy(value))
    inside = ranged.withColumn("upto", upto)
    joined = inside.join(sums, _same(inside, sums, own))
    hi = F.col("before") + F.col("upto")
    return joined.select(*by, value, "n", (hi - F.col("n")).alias("lo"), hi.alias("hi"), "total")


def at_probability(p: float, value: str = "v") -> Column:
    """Aggregate over :func:`ranked_values`: the quantile of a group."""
    h = (F.col("total") - 1) * F.lit(float(p))
    k0 = F.floor(h)
    k1 = F.least(k0 + 1, F.col("total") - 1)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col(value)))

    return at(k0) + (at(k1) - at(k0)) * F.max(h - k0)


def group_quantiles(df: DataFrame, by: list[str], value: str, probs, names) -> DataFrame:
    """by..., n and one column per probability."""
    ranked = ranked_values(df.select(*by, F.col(value).cast("double").alias("v")), by)
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), *[
        at_probability(p).alias(c) for p, c in zip(probs, names, strict=True)])


def exact_quantiles(df: DataFrame, cols, probs) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]}; NULLs ignored; all-NULL column -> None."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    entries = [F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.k", "e.v")
    found = group_quantiles(long, ["k"], "v", probs, [f"q{i}" for i in range(len(probs))])
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in found.collect()}  # one row per column
    return {c: got.get(i, [None] * len(probs)) for i, c in enumerate(cols)}


# Parts of an interval that one counting pass of a descent tells apart.
DESCENT_PARTS = 512


def values_at_ranks(df: DataFrame, col: str, ranks) -> dict[int, float]:
    """{0-based rank: value} among the values in ascending order (NULL and NaN are none), by
    descent: each pass counts the open intervals in DESCENT_PARTS parts and
    notes the smallest and largest value of each; an interval is done when these
    are equal. Nothing is sorted, shuffled or written; a pass hands the driver
    at most that many rows per wanted rank. Meant for a persisted column."""
    v = F.col(col).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    found, open_ = {}, {}
    for r in ranks:
        open_.setdefault((whole["lo"], whole["hi"]), []).append((r, r))     # (wanted, rank inside the interval)
    while open_:
        for (lo, hi), wanted in list(open_.items()):
            if lo == hi:
                found.update({r: lo for r, _ in wanted})
                del open_[lo, hi]
        if not open_:
            break
        ends = sorted(open_)
        interval, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(ends):
            inside = (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))
            # halves first: the difference of two doubles may overflow
            share = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            inner = F.floor(F.nanvl(share, F.lit(0.0)) * DESCENT_PARTS).cast("int")
            # the ends have parts of their own, so every pass narrows an interval, infinite ends too
            place = (F.when(F.col("v") == F.lit(lo), 0).when(F.col("v") == F.lit(hi), DESCENT_PARTS - 1)
                     .otherwise(F.greatest(F.lit(1), F.least(inner, F.lit(DESCENT_PARTS - 2)))))
            interval, part = F.when(inside, i).otherwise(interval), F.when(inside, place).otherwise(part)
        counted = (rows.select("v", interval.alias("i"), part.alias("p")).where("i is not null").groupBy("i", "p")
                   .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        following: dict = {}
        for i, end in enumerate(ends):
            before = 0
            for c in sorted((c for c in counted if c["i"] == i), key=lambda c: c["lo"]):
                for r, inner in open_[end]:
                    if before <= inner < before + c["n"]:
                        following.setdefault((c["lo"], c["hi"]), []).append((r, inner - before))
                before += c["n"]
        open_ = following
    return found


def descent_quantiles(df: DataFrame, col: str, probs) -> list[float | None]:
    """Exact quantiles of one persisted column, by :func:`values_at_ranks`."""
    v = F.col(col).cast("double")
    n = df.agg(F.count(F.when(~F.isnan(v), v)).alias("n")).first()["n"]
    if not n:
        return [None] * len(probs)
    wanted = []
    for p in probs:
        h = (n - 1) * float(p)
        wanted.append((int(h), min(int(h) + 1, n - 1), h - int(h)))
    at = values_at_ranks(df, col, sorted({k for w in wanted for k in w[:2]}))
    return [at[a] + (at[b] - at[a]) * share for a, b, share in wanted]


def approx_quantiles(df: DataFrame, cols, probs, accuracy: int = APPROX_ACCURACY):
    cols = list(cols)
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols, probs, exact: bool = True):
    return exact_quantiles(df, cols, probs) if exact else approx_quantiles(df, cols, probs)
