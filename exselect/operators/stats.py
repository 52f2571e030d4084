"""Ranks, correlations, paired tests and binned summaries that never put a group into one task.

Average ranks come from counts of distinct values: equal values collapse before any shuffle, the
distinct values are cut at global quantiles into buckets, each bucket is ordered on its own, and the
bucket totals (a few hundred rows per key) carry the counts across. A value shared by a third of all
rows is one row here.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from exselect.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
HOT_SHARE = 1000  # a value is hot if it holds more than 1/HOT_SHARE of the rows


def value_ranks(
    counts: DataFrame, keys: list[str], x: str, n: str, edges: list[float]
) -> DataFrame:
    """Add `rank`, the average rank of x within keys, to distinct counts(keys, x, n)."""
    middle = (F.col(n) + 1) / 2
    if not edges:
        ahead = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("rank", F.coalesce(F.sum(n).over(ahead), F.lit(0)) + middle)
    splits = [-math.inf, *sorted(set(edges)), math.inf]
    placed = Bucketizer(splits=splits, inputCol=x, outputCol="_bucket").transform(counts)
    own = Window.partitionBy(*keys, "_bucket").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(n).over(own), F.lit(0)))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*keys, "_bucket").agg(F.sum(n).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(totals, [*keys, "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_local") + middle)
        .drop("_before", "_local", "_bucket")
    )


def bucket_edges(df: DataFrame, x: str, rows: int, per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Global quantiles of x, as many as buckets of `per_bucket` rows are needed."""
    buckets = max(1, -(-rows // per_bucket))
    if buckets == 1:
        return []
    steps = [i / buckets for i in range(1, buckets)]
    return df.approxQuantile(x, steps, 0.1 / buckets)


def _join_ranks(pairs: DataFrame, ranks: DataFrame, keys: list[str], x: str, out: str, total: int) -> DataFrame:
    """Attach the rank of x to pairs(keys, x, ...).

    `ranks._m` is the number of pairs of a value. A value with more than 1/HOT_SHARE of all pairs is
    hot; there are at most HOT_SHARE of those, so they are broadcast and only the others shuffled.
    """
    on = [*keys, x]
    ranks = ranks.select(*on, "_m", F.col("rank").alias(out))
    most = ranks.agg(F.max("_m")).first()[0] or 0
    if most * HOT_SHARE <= max(total, HOT_SHARE * ROWS_PER_BUCKET):
        return pairs.join(ranks.drop("_m"), on)
    is_hot = F.col("_m") * HOT_SHARE > total
    hot = F.broadcast(ranks.where(is_hot).drop("_m"))
    cold = ranks.where(~is_hot).drop("_m")
    joined = pairs.join(hot, on).unionByName(pairs.join(hot.select(*on), on, "left_anti").join(cold, on))
    return cut_lineage(joined)


def spearman(
    df: DataFrame, keys: list[str], x: str, y: str, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(keys, rho, n) over rows where both values are present; rho is null for fewer than two rows.

    Pairs (x, y) are counted and kept, ranks are joined to distinct pairs, and Pearson's formula is a
    sum with weights, so all steps combine in the tasks.
    """
    present = df.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y))
    if not keys:
        return spearman(present.withColumn("_all", F.lit(0)), ["_all"], x, y, per_bucket).drop("_all")
    pairs = cut_lineage(
        present.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_w"))
    )
    total = pairs.count()
    ranked = pairs
    for side, out in (("_x", "_rx"), ("_y", "_ry")):
        counts = pairs.groupBy(*keys, side).agg(F.sum("_w").alias("_n"), F.count("*").alias("_m"))
        ranks = value_ranks(counts, keys, side, "_n", bucket_edges(pairs, side, total, per_bucket))
        ranked = _join_ranks(ranked, ranks, keys, side, out, total)
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    spread = F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n))
    return sums.select(*keys, F.when((n >= 2) & (spread > 0), cov / spread).alias("rho"), "n")


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def student_upper(t: float, freedom: float) -> float:
    """P(T > t): half the regularised incomplete beta function, or Hill's normal expansion for large samples."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if t < 0:
        return 1.0 - student_upper(-t, freedom)
    if freedom > 1000:  # the expansion's error falls with the third power of the degrees of freedom
        a = freedom - 0.5
        b, y = 48.0 * a * a, a * math.log1p(t * t / freedom)
        tail = (((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0
        return 0.5 * math.erfc((tail / b + 1.0) * math.sqrt(y) / math.sqrt(2.0))
    return 0.5 * _beta_share(freedom / 2, 0.5, freedom / (freedom + t * t), t * t / (freedom + t * t))


def _beta_share(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta function at x, rest = 1 - x, by its continued fraction."""
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(b, a, rest, x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)) / a
    c, k = 1.0, 1
    fraction = d = 1.0 / (1.0 - (a + b) * x / (a + 1))
    while True:
        k += 1
        m = k // 2
        if k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + term * d)
        c = 1.0 + term / c
        fraction *= c * d
        if abs(c * d - 1.0) < 4e-16:
            return scale * fraction


@F.pandas_udf(DoubleType())
def _student_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([
        math.nan if t_ is None or f is None or f < 1 else student_upper(t_, f)
        for t_, f in zip(t, freedom)
    ])


def paired_t(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Paired t-test, alternative a > b: (keys, n, t, p_value)."""
    difference = F.col(a) - F.col(b)
    sums = (
        df.where(difference.isNotNull() & ~F.isnan(difference))
        .groupBy(*(keys or []))
        .agg(F.count("*").alias("n"), F.avg(difference).alias("_mean"), F.stddev_samp(difference).alias("_sd"))
    )
    return sums.withColumn("t", F.try_divide(F.col("_mean"), F.col("_sd") / F.sqrt("n"))).withColumn(
        "p_value", _student_p("t", (F.col("n") - 1).cast("double"))
    ).drop("_mean", "_sd")


EXACT_RANKS = 50  # up to so many differences without ties the null distribution is counted out


@lru_cache(maxsize=EXACT_RANKS + 1)
def rank_sum_tail(n: int) -> list[float]:
    """P(W+ >= w) for w = 0 .. n (n + 1) / 2 if all 2^n signs are as likely: sums of subsets of 1 .. n, counted rank by rank."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for w, count in enumerate(ways):
            longer[w + rank] += count
        ways = longer
    tail, total = [], 0
    for count in reversed(ways):
        total += count
        tail.append(total / 2**n)
    return tail[::-1]


@F.pandas_udf(DoubleType())
def _signed_rank_p(n: pd.Series, w_plus: pd.Series, plain: pd.Series, z: pd.Series) -> pd.Series:
    def one(n_, w, exact, z_):
        if exact and n_ <= EXACT_RANKS:
            return rank_sum_tail(int(n_))[int(w)]
        return None if z_ is None or math.isnan(z_) else 0.5 * math.erfc(z_ / math.sqrt(2.0))

    return pd.Series([one(*row) for row in zip(n, w_plus, plain, z)], dtype="float64")


def wilcoxon(
    df: DataFrame, a: str, b: str, keys: list[str] | None = None, per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Signed-rank test, alternative a > b: (keys, n, w_plus, z, p_value); zeros are dropped.

    z is corrected for ties. The p-value is that of z, but up to EXACT_RANKS differences, none of them zero or tied,
    it comes from the exact null distribution of rank sums. Everything is a sum over distinct |a - b|, so no
    rank goes back to a row.
    """
    keys = keys or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    signed = df.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d").isNotNull() & ~F.isnan("_d")).withColumn("_abs", F.abs("_d"))
    every = cut_lineage(signed.groupBy(*keys, "_abs").agg(
        F.count("*").alias("_n"), F.sum((F.col("_d") > 0).cast("bigint")).alias("_plus")
    ))
    counts = every.where("_abs != 0")
    ranks = value_ranks(counts, keys, "_abs", "_n", bucket_edges(counts, "_abs", counts.count(), per_bucket))
    size = F.col("_n").cast("double")
    sums = ranks.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.col("rank") * F.col("_plus")).alias("w_plus"),
        F.sum(size * size * size - size).alias("_ties"),
    )
    zeros = every.where("_abs = 0").select(*keys, F.lit(True).alias("_zeros"))
    sums = sums.join(zeros, keys, "left")  # one row per key
    n = F.col("n").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(variance))
    plain = (F.col("_ties") == 0) & F.col("_zeros").isNull()
    return sums.withColumn("z", z).withColumn("p_value", _signed_rank_p("n", "w_plus", plain, "z")).drop("_ties", "_all", "_zeros")


def fraction_larger(df: DataFrame, a: str, b: str, out: str = "pct_larger") -> DataFrame:
    """Percentage of rows with a > b among rows where both are present."""
    both = F.col(a).isNotNull() & ~F.isnan(a) & F.col(b).isNotNull() & ~F.isnan(b)
    return df.where(both).agg((F.avg((F.col(a) > F.col(b)).cast("double")) * 100).alias(out))


def fisher_z(df: DataFrame, keys: list[str], category: str, base: str, tail: str = "upper") -> DataFrame:
    """Compare each category's correlation with the base category's inside `keys`.

    `df(keys, category, rho, n)` holds one row per group. "upper" tests z > 0, "lower" z < 0.
    """
    naive = df.where(F.col(category) == base).select(
        *keys, F.col("rho").alias("_rho0"), F.col("n").alias("_n0")
    )
    difference = F.atanh("_rho0") - F.atanh("rho")
    error = F.sqrt(1.0 / (F.col("_n0") - 3) + 1.0 / (F.col("n") - 3))
    z = difference / error
    p = normal_cdf("z_stat")
    return (
        df.join(naive, keys).where((F.col("n") > 3) & (F.col("_n0") > 3))
        .withColumn("diff", difference).withColumn("z_stat", z)
        .withColumn("p_value", 1.0 - p if tail == "upper" else p)
        .withColumn("significant", F.col("p_value") < 0.05)
        .drop("_rho0", "_n0")
    )


def significant_categories(tested: DataFrame, key: str, category: str) -> DataFrame:
    """(key, categories): significant categories per key in numeric order, joined by commas."""
    found = tested.where("significant").select(key, F.struct(F.col(category).cast("double").alias("v"), category).alias("s"))
    return found.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda s: s[category]), ",").alias("categories")
    )


def log_bin_edges(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 log-spaced edges; the lower end is kept above zero."""
    return list(np.logspace(math.log10(max(low, 1e-10)), math.log10(high), bins + 1))


def right_closed_bin(column: Column | str, edges: list[float]) -> Column:
    """Bin number from 0 for bins (e_i, e_i+1], the first one including its lower end; null outside."""
    column = F.col(column) if isinstance(column, str) else column
    below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < column))
    inside = (column >= edges[0]) & (column <= edges[-1])
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def reliability_bins(
    df: DataFrame, score: str, outcome: str, bins: int = 20, threshold: float = 0.0
) -> DataFrame:
    """(bin, mean_score, accuracy, n): does score > 1 agree with outcome > threshold?

    A ratio outcome such as the JSD ratio wants threshold 1.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(outcome).isNotNull() & ~F.isnan(outcome))
    low, high = rows.agg(F.min(score), F.max(score)).first()
    if high is None or high <= 0:  # no rows, or none that logarithmic bins can hold
        return df.sparkSession.createDataFrame([], "bin int, mean_score double, accuracy double, n long")
    edges = log_bin_edges(low, high, bins)
    edges[0], edges[-1] = min(edges[0], max(low, 1e-10)), max(edges[-1], high)
    agree = ((F.col(score) > 1) == (F.col(outcome) > threshold)).cast("double")
    return (
        rows.withColumn("bin", right_closed_bin(score, edges)).where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.avg(score).alias("mean_score"), F.avg(agree).alias("accuracy"), F.count("*").alias("n"))
    )


def percentiles(df: DataFrame, x: str, shares: list[float], per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Exact linearly interpolated percentiles of a column (shares from 0 to 1).

    The positions are looked up in the counts of distinct values; at most two values per share leave
    the cluster.
    """
    counts = cut_lineage(
        df.where(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    ).withColumn("_all", F.lit(0))
    total, distinct = counts.agg(F.sum("_n"), F.count("*")).first()
    if not total:
        return [math.nan] * len(shares)
    places = [share * (total - 1) for share in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    ranked = value_ranks(counts, ["_all"], "_x", "_n", bucket_edges(counts, "_x", distinct, per_bucket))
    first = F.col("rank") - (F.col("_n") + 1) / 2
    spans = ranked.select("_x", first.alias("_from"), (first + F.col("_n")).alias("_to"))
    hit = F.exists(F.array(*[F.lit(float(w)) for w in wanted]), lambda w: (w >= F.col("_from")) & (w < F.col("_to")))
    found = [tuple(row) for row in spans.where(hit).collect()]

    def at(place: int) -> float:
        return next(value for value, low, high in found if low <= place < high)

    out = []
    for p in places:
        low = at(int(p))
        out.append(low + (p - int(p)) * (at(min(int(p) + 1, total - 1)) - low))
    return out


def percentile_filter(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """Rows between two linearly interpolated percentiles (shares from 0 to 1)."""
    first, last = percentiles(df, x, [low, high])
    return df.where((F.col(x) >= first) & (F.col(x) <= last))


def equal_width_bin(column: str, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; the last bin includes the upper end."""
    if high == low:
        return F.lit(0).cast("bigint")
    place = F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins))
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("bigint")


def hist2d(df: DataFrame, x: str, y: str, bins: int = 200, keys: list[str] | None = None) -> DataFrame:
    """(keys, bx, by, n): counts of the occupied cells over the common range of all rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    x0, x1, y0, y1 = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return (
        rows.select(*(keys or []), equal_width_bin(x, x0, x1, bins).alias("bx"), equal_width_bin(y, y0, y1, bins).alias("by"))
        .groupBy(*(keys or []), "bx", "by")
        .agg(F.count("*").alias("n"))
    )


def marginals(cells: DataFrame) -> DataFrame:
    """(axis, bin, n) from the occupied cells."""
    sides = F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("bx").alias("bin")),
        F.struct(F.lit("y").alias("axis"), F.col("by").alias("bin")),
    ))
    return cells.select(sides.alias("s"), "n").groupBy("s.axis", "s.bin").agg(F.sum("n").alias("n"))


def describe_column(df: DataFrame, x: str) -> DataFrame:
    """One row: count, mean, std, min, quartiles and max of a column, without nulls and NaN."""
    df = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    quartiles = percentiles(df, x, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        *[F.lit(q).alias(name) for name, q in zip(("p25", "p50", "p75"), quartiles)], F.max(x).alias("max"),
    )
