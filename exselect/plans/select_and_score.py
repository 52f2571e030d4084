"""From vectors to scored selections, for one setting or a whole grid."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exselect.functions.labels import describe
from exselect.operators import coders, greedy, ranking
from exselect.operators.scoring import SORT_TYPES, top_influence
from exselect.plans.grid import GROUND_SIZE, KS, LAMBDAS, SEEDS, SIGNLESS_ORDERS
from exselect.session import cut_lineage

COLUMNS = ["method", "sort_type", "k", "m", "lambda", "seed", "test_id", "rank", "train_id"]
TYPES = {"method": "string", "sort_type": "string", "k": "int", "m": "int", "lambda": "double",
         "seed": "int", "test_id": "bigint", "rank": "int", "train_id": "bigint"}


def _shaped(df: DataFrame, **fixed) -> DataFrame:
    """Selection rows with all setting columns; the ones a method lacks stay null."""
    for name, value in fixed.items():
        df = df.withColumn(name, F.lit(value))
    for name in COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
    return df.select(*[F.col(c).cast(TYPES[c]).alias(c) for c in COLUMNS])


def prefixes(ranked: DataFrame, ks: Iterable[int]) -> DataFrame:
    """The first k rows of every ranking, for each k: a row belongs to all k that reach its rank."""
    wide = F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k >= F.col("rank"))
    return ranked.withColumn("k", F.explode(wide))


def select_all(
    top: DataFrame,
    train: DataFrame,
    test: DataFrame,
    ks: Iterable[int] = KS,
    lambdas: Iterable[float] = LAMBDAS,
    seeds: Iterable[int] = SEEDS,
    m: int = GROUND_SIZE,
    signed: bool = True,
    query_vectors: DataFrame | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Selections of the whole grid from the ground sets `top(sort_type, test_id, rank, train_id, score)`.

    The ground sets are ranked once and kept; every method and every smaller k reads them.
    """
    ks = sorted(ks)
    fitting = [k for k in ks if k <= m]
    orders = SORT_TYPES if signed else SIGNLESS_ORDERS
    top = top.where(F.col("sort_type").isin(*orders))
    ground = greedy.ground_sets(top.where(F.col("rank") <= m), train)
    queries = query_vectors if query_vectors is not None else test
    picked = greedy.all_methods(ground, queries, fitting, lambdas, m, digits=digits).withColumn(
        "lambda", F.when(F.col("method") == "facility_location", F.col("parameter"))
    )
    found = [
        _shaped(ranking.self_selection(test), method="self", k=1),
        _shaped(prefixes(top, ks), method="top_k"),
        _shaped(picked, m=m),
    ]
    for seed in seeds:
        drawn = ranking.random_k(train, test, ks[-1], seed)
        found.append(_shaped(prefixes(drawn, ks), method="random"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumn("selection", describe(*[F.col(c) for c in COLUMNS[:6]]))


def score_selections(
    selections: DataFrame, train: DataFrame, test: DataFrame, coder_names=coders.ACTIVE_CODERS
) -> DataFrame:
    """One record per (test, selection, coder); a selection of the test row itself reads the test side."""
    # Ids of both sides are told apart by their last bit.
    own = (F.col("method") == "self").cast("bigint")
    keyed = selections.select("test_id", "selection", "rank", (F.col("train_id") * 2 + own).alias("train_id"))
    both = train.select((F.col("train_id") * 2).alias("train_id"), "vec").unionByName(
        test.select((F.col("test_id") * 2 + 1).alias("train_id"), "vec")
    )
    return coders.fit(coders.gram(keyed, both, test), coder_names)


def score_pending(
    selections: DataFrame, train: DataFrame, test: DataFrame, done: DataFrame, coder_names=coders.ACTIVE_CODERS
) -> DataFrame:
    """Records of a run that goes on from stored ones: `done(test_id, selection, linear_coder, ...)`.

    A selection with a record of every coder is left out before any vector is read; one with some of them is scored
    anew and only the missing records come back, so that appending the result never repeats a record.
    """
    names = list(coder_names)
    stored = done.where(F.col("linear_coder").isin(*names)).select("test_id", "selection", "linear_coder").distinct()
    whole = stored.groupBy("test_id", "selection").count().where(F.col("count") == len(names)).drop("count")
    left = selections.join(whole, ["test_id", "selection"], "left_anti")
    return score_selections(left, train, test, names).join(stored, ["test_id", "selection", "linear_coder"], "left_anti")


def explained_share(test: DataFrame, train: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """For each test vector: its k most influential train vectors and how much of it they explain."""
    top = top_influence(test, train, k, ["most_influential"], digits=digits)
    selections = top.withColumn("selection", F.lit(f"Top-{k}"))
    fitted = coders.fit(coders.gram(selections, train, test), ["MSECoder", "MSECoderProjUSimp"])
    return coders.require_complete(fitted, ["pred_gain", "mse", "l1", "l2"])


def stored_ground_sets(
    test: DataFrame, train: DataFrame, m: int = GROUND_SIZE, ks: Iterable[int] = KS, **options
) -> DataFrame:
    """Ground sets of all four orders, ranked once and cut from their plan before many methods read them.

    Ranks go on to the largest k, so top-k is full where k exceeds m; the greedy methods read the first m.
    """
    return cut_lineage(top_influence(test, train, max(m, *ks), SORT_TYPES, **options))
