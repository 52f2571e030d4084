"""Greedy subset selection inside a ground set: weighted facility location, DIVINE and AIDE.

A ground set is the top-m of one test row and order, so a group holds m vectors, m a parameter of the
method. The whole grid of one ground set (lambda, gamma, k) is solved in one pass over its group.
Ties go to the lower rank in the ground set. `digits` rounds what is compared, so that the order of a
floating-point sum cannot flip equal candidates.
"""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exselect.operators.scoring import SORT_TYPES, as_matrix, doubles, gather_vectors
from exselect.session import spread

# Sign and shape of a score when it acts as a cost; importance is the opposite.
COSTS = {
    "most_helpful": lambda s: s,
    "most_harmful": lambda s: -s,
    "most_influential": lambda s: -np.abs(s),
    "least_influential": np.abs,
}
GAMMAS = tuple(np.logspace(-4, 5, 20))  # fixed values of the method
PICKS = "sort_type string, test_id bigint, k int, rank int, train_id bigint"


def cosine_similarity(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1.0, norm)
    return unit @ unit.T


def cosine_distance(similarity: np.ndarray) -> np.ndarray:
    distance = 1.0 - similarity
    np.fill_diagonal(distance, 0.0)
    return distance


def scaled(values: np.ndarray, low: float, high: float) -> np.ndarray:
    span = values.max() - values.min()
    return np.full(len(values), float(low)) if span == 0 else low + (values - values.min()) / span * (high - low)


TIE_DIGITS = 12  # beyond them values of equal candidates differ by rounding only, whatever `digits`


def _rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    return np.round(values, TIE_DIGITS if digits is None else digits)


def _greedy(size: int, k: int, runs: int, value_of, take, digits: int | None) -> np.ndarray:
    """Repeatedly take the open candidate of the largest value, for several parameters side by side.

    `value_of()` gives a (runs, size) table of values; the result lists each run's picks in order.
    """
    k = min(k, size)
    picks = np.empty((runs, k), np.int64)
    closed = np.zeros((runs, size), bool)
    for step in range(k):
        values = _rounded(value_of(), digits)
        values[closed] = -np.inf
        best = values.argmax(axis=1)
        picks[:, step] = best
        closed[np.arange(runs), best] = True
        take(best)
    return picks


class _Coverage:
    """Facility-location gains: sum_i max(sim_ij - covered_i, 0), one row of `covered` per run.

    A pick lowers the gains only through the points it covers better, fewer with each pick.
    """

    def __init__(self, similarity: np.ndarray, runs: int):
        self.similarity = similarity
        self.covered = np.zeros((runs, len(similarity)))
        self.gains = np.repeat(np.maximum(similarity, 0.0).sum(axis=0)[None], runs, axis=0)
        self.runs = np.arange(runs)[:, None]

    def gain(self) -> np.ndarray:
        return self.gains

    def take(self, best: np.ndarray) -> None:
        after = np.maximum(self.covered, self.similarity[:, best].T)
        run, point = np.nonzero(after > self.covered)
        before = self.covered[run, point][:, None]
        lost = np.maximum(self.similarity[point], before)
        np.minimum(lost, after[run, point][:, None], out=lost)
        lost -= before
        self.gains -= (run == self.runs).astype(float) @ lost
        self.covered = after


LAZY_FROM = 512  # from this many candidates on, gains are worked out when a candidate comes up, not for all at each step


def _lazy(similarity: np.ndarray, k: int, value, digits: int | None) -> np.ndarray:
    """Greedy picks of one run by coverage: `value(gain, j)` rises with the gain of candidate j.

    Gains only fall as picks are added, so an earlier gain bounds the present one. The queue holds such bounds; the
    first candidate whose gain is of the present step beats all others, whatever their gains are now. Ties go to the lower
    rank, as in the plain rule.
    """
    covered = np.zeros(len(similarity))

    def entry(j: int, step: int) -> tuple[float, int, int]:
        gain = np.maximum(similarity[:, j] - covered, 0.0).sum()
        return -float(_rounded(np.array([value(gain, j)]), digits)[0]), j, step

    queue = [entry(j, 0) for j in range(similarity.shape[1])]
    heapify(queue)
    picks = []
    while len(picks) < k:
        _, j, step = queue[0]
        if step < len(picks):
            heapreplace(queue, entry(j, len(picks)))
            continue
        heappop(queue)
        picks.append(j)
        np.maximum(covered, similarity[:, j], out=covered)
    return np.array(picks, np.int64)


def facility_picks(similarity, cost, k, lambdas, digits=None) -> np.ndarray:
    """Largest (gain + 1)^lam / cost^(1 - lam), per lambda."""
    if len(cost) >= LAZY_FROM:
        k = min(k, len(cost))
        return np.stack([_lazy(similarity, k, lambda gain, j, x=x: (gain + 1.0) ** x / cost[j] ** (1.0 - x), digits) for x in map(float, lambdas)])
    lam = np.asarray(lambdas, float)[:, None]
    coverage = _Coverage(similarity, len(lam))
    weight = cost[None] ** (1.0 - lam)
    return _greedy(len(cost), k, len(lam), lambda: (coverage.gain() + 1.0) ** lam / weight, coverage.take, digits)


def divine_picks(similarity, importance, k, gammas, digits=None) -> np.ndarray:
    """Largest importance + gamma * redundancy gain, the gain being -(2 sum_{j in S} S_ij + S_ii)."""
    gamma = np.asarray(gammas, float)[:, None]
    overlap = np.repeat(np.diag(similarity)[None], len(gamma), axis=0)

    def take(best):
        np.add(overlap, 2.0 * similarity[best], out=overlap)

    return _greedy(len(importance), k, len(gamma), lambda: importance - gamma * overlap, take, digits)


def aide_picks(similarity, influence, closeness, ks, alpha, beta, gamma, digits=None) -> np.ndarray:
    """Largest alpha |s| + beta cos + gamma f(k) * facility gain, f(k) = 1 - 1/(k (k-1)), f(1) = 1.

    One run per k, all to the largest k; the caller cuts each run at its own k.
    """
    factor = np.array([1.0 if k == 1 else 1.0 - 1.0 / (k * (k - 1)) for k in ks])[:, None]
    fixed = alpha * influence + beta * closeness
    if len(influence) >= LAZY_FROM:
        most = min(max(ks), len(influence))
        return np.stack([_lazy(similarity, most, lambda gain, j, x=x: fixed[j] + gamma * x * gain, digits) for x in factor[:, 0].tolist()])
    coverage = _Coverage(similarity, len(factor))
    return _greedy(
        len(influence), max(ks), len(factor), lambda: fixed + gamma * factor * coverage.gain(), coverage.take, digits
    )


def ground_sets(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ground sets with their vectors, from `top(sort_type, test_id, rank, train_id, score)`."""
    return gather_vectors(top.select("sort_type", "test_id", "rank", "train_id", "score"), vectors)


class _Group:
    """One ground set in rank order."""

    def __init__(self, table: pa.Table):
        self.table = table = table.sort_by("rank")
        self.sort_type = table["sort_type"][0].as_py()
        self.test_id = table["test_id"][0].as_py()
        self.ids = table["train_id"].to_numpy()
        self.score = table["score"].to_numpy()
        self.vectors = as_matrix(table["vec"])
        self.cosine = cosine_similarity(self.vectors)
        self.distance = cosine_distance(self.cosine)

    def picks(self, found, extra: dict[str, pa.DataType]) -> pa.Table:
        """Rows of (picks, k, extra values...)."""
        found = list(found)
        sizes = [len(picks) for picks, *_ in found]
        total = sum(sizes)

        def repeated(values, kind):
            return pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(found)), sizes)))

        data = {
            "sort_type": pa.array([self.sort_type], pa.string()).take(pa.array(np.zeros(total, np.int64))),
            "test_id": np.full(total, self.test_id, np.int64),
            "k": repeated([row[1] for row in found], pa.int32()),
            "rank": np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]),
            "train_id": self.ids[np.concatenate([picks for picks, *_ in found])],
        }
        for at, (name, kind) in enumerate(extra.items()):
            data[name] = repeated([row[2 + at] for row in found], kind)
        return pa.table(data)


def _no_picks(extra: dict[str, pa.DataType]) -> pa.Table:
    kinds = {"sort_type": pa.string(), "test_id": pa.int64(), "k": pa.int32(), "rank": pa.int32(), "train_id": pa.int64(), **extra}
    return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def _facility(group, ks, lambdas, m, digits):
    cost = scaled(COSTS[group.sort_type](group.score), 1.0, m)
    for lam, order in zip(lambdas, facility_picks(group.cosine, cost, ks[-1], lambdas, digits)):
        yield from ((order[:k], k, lam) for k in ks)


def _divine(group, ks, gammas, digits):
    distance = group.distance
    importance = scaled(-COSTS[group.sort_type](group.score), 0.0, 1.0)
    orders = divine_picks(distance.max() - distance, importance, ks[-1], gammas, digits)
    for k in ks:
        picks = orders[:, :k]
        apart = distance[picks[:, :, None], picks[:, None, :]].mean(axis=(1, 2))
        best = int(np.argmax(_rounded(apart, 9 if digits is None else digits)))
        yield orders[best][:k], k, gammas[best]


def _aide(group, query, ks, weights, digits):
    norms = np.linalg.norm(group.vectors, axis=1) * np.linalg.norm(query) + 1e-10
    closeness = group.vectors @ query / norms
    similarity = group.distance.max() - group.distance
    for k, order in zip(ks, aide_picks(similarity, np.abs(group.score), closeness, ks, *weights, digits)):
        yield order[:k], k


def facility_location(
    ground: DataFrame, ks: Iterable[int], lambdas: Iterable[float], m: int, digits: int | None = None
) -> DataFrame:
    """Selections for every (lambda, k); the picks for k are a prefix of those for the largest k."""
    ks, lambdas = sorted(ks), tuple(float(x) for x in lambdas)

    def solve(table: pa.Table) -> pa.Table:
        group = _Group(table)
        return group.picks(_facility(group, ks, lambdas, m, digits), {"lambda": pa.float64()})

    return spread(ground, "sort_type", "test_id").groupBy("sort_type", "test_id").applyInArrow(
        solve, PICKS + ", lambda double"
    )


def divine(
    ground: DataFrame, ks: Iterable[int], gammas: Iterable[float] = GAMMAS, digits: int | None = None
) -> DataFrame:
    """Selections for every k, each with the gamma of the most spread-out picks (first gamma on ties)."""
    ks, gammas = sorted(ks), tuple(float(x) for x in gammas)

    def solve(table: pa.Table) -> pa.Table:
        group = _Group(table)
        return group.picks(_divine(group, ks, gammas, digits), {"gamma": pa.float64()})

    return spread(ground, "sort_type", "test_id").groupBy("sort_type", "test_id").applyInArrow(
        solve, PICKS + ", gamma double"
    )


def aide(
    ground: DataFrame,
    query_vectors: DataFrame,
    ks: Iterable[int],
    alpha: float = 0.2,
    beta: float = 0.8,
    gamma: float = 0.5,
    digits: int | None = None,
) -> DataFrame:
    """Selections for every k; each k is its own run since the facility factor depends on k.

    `query_vectors(test_id, vec)` is the side the closeness is measured to; the test vectors by
    default, or any other table with those ids.
    """
    ks = sorted(ks)
    only = ground.where(F.col("sort_type") == "most_influential")

    def solve(table: pa.Table) -> pa.Table:
        group, query = _group_and_query(table)
        return group.picks(_aide(group, query, ks, (alpha, beta, gamma), digits), {}) if group else _no_picks({})

    return spread(_with_query(only, query_vectors, ["most_influential"]), "sort_type", "test_id").groupBy(
        "sort_type", "test_id"
    ).applyInArrow(solve, PICKS)


def _with_query(ground: DataFrame, query_vectors: DataFrame, orders: Iterable[str]) -> DataFrame:
    """Ground sets of `orders`, each with its query vector as one more row, of rank 0: the vectors meet no join on their way."""
    queries = query_vectors.where(F.col("test_id").isNotNull()).select(
        "test_id", F.explode(F.array(*[F.lit(order) for order in orders])).alias("sort_type"), F.lit(0).alias("rank"),
        F.lit(None).cast("bigint").alias("train_id"), F.lit(None).cast("double").alias("score"), doubles().alias("vec"),
    )
    return ground.unionByName(queries)


def _group_and_query(table: pa.Table) -> tuple[_Group | None, np.ndarray]:
    """A ground set and its query vector; no group if there is none but the query.

    Of a query that comes several times, each brings the first row of the ground set again, as a join would.
    """
    table = table.sort_by("rank")
    first, second = np.searchsorted(table["rank"].to_numpy(), [1, 2])
    if first == table.num_rows:
        return None, np.empty(0)
    query = as_matrix(table["vec"].slice(0, 1))[0] if first else np.empty(0)
    return _Group(pa.concat_tables([table.slice(first, second - first)] * max(1, first) + [table.slice(second)])), query


def all_methods(
    ground: DataFrame,
    query_vectors: DataFrame,
    ks: Iterable[int],
    lambdas: Iterable[float],
    m: int,
    gammas: Iterable[float] = GAMMAS,
    aide_weights: tuple[float, float, float] = (0.2, 0.8, 0.5),
    digits: int | None = None,
) -> DataFrame:
    """Facility location, DIVINE and AIDE of each ground set in one pass: the vectors travel once.

    Adds `method` and `parameter`, which is lambda or gamma and null for AIDE.
    """
    ks, lambdas, gammas = sorted(ks), tuple(map(float, lambdas)), tuple(map(float, gammas))
    extra = {"parameter": pa.float64(), "method": pa.string()}

    def solve(table: pa.Table) -> pa.Table:
        group, query = _group_and_query(table)
        if group is None:
            return _no_picks(extra)
        found = [(*f, "facility_location") for f in _facility(group, ks, lambdas, m, digits)]
        found += [(*f, "divine") for f in _divine(group, ks, gammas, digits)]
        if group.sort_type == "most_influential":
            found += [(*f, None, "aide") for f in _aide(group, query, ks, aide_weights, digits)]
        return group.picks(found, extra)

    return spread(_with_query(ground, query_vectors, SORT_TYPES), "sort_type", "test_id").groupBy(
        "sort_type", "test_id"
    ).applyInArrow(solve, PICKS + ", parameter double, method string")


def ground_similarity(ground: DataFrame) -> DataFrame:
    """Per ground set: mean cosine over all pairs and the largest cosine distance, for inspection."""

    def solve(table: pa.Table) -> pa.Table:
        group = _Group(table)
        return pa.table({
            "sort_type": [group.sort_type], "test_id": pa.array([group.test_id], pa.int64()),
            "mean_similarity": [float(group.cosine.mean())], "max_distance": [float(group.distance.max())],
        })

    return ground.groupBy("sort_type", "test_id").applyInArrow(
        solve, "sort_type string, test_id bigint, mean_similarity double, max_distance double"
    )


def nearest_ground_point(ground: DataFrame, points: DataFrame, metric: str = "cosine") -> DataFrame:
    """For every picked point of a test, the nearest ground-set row of that test.

    Two copies of a query never meet: the ground set of a test (m rows) and its points (k rows) share
    one group, and only the winner of each point leaves it.
    """

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            a, b = left.sort_by("rank"), right.sort_by("rank")
            x, y = as_matrix(a["vec"]), as_matrix(b["vec"])
            if metric == "cosine":
                unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y)]
                distance = 1.0 - unit[0] @ unit[1].T
            else:
                distance = np.sqrt(np.maximum(
                    np.square(x).sum(1)[:, None] - 2.0 * x @ y.T + np.square(y).sum(1), 0.0))
            near = np.argmin(np.round(distance, 9), axis=0)
            return pa.table({
                "test_id": b["test_id"], "rank": b["rank"].cast(pa.int32()), "train_id": b["train_id"],
                "nearest_id": a["train_id"].take(pa.array(near)),
                "distance": distance[near, np.arange(len(near))],
            })
        return pa.table({
            "test_id": pa.array([], pa.int64()), "rank": pa.array([], pa.int32()),
            "train_id": pa.array([], pa.int64()), "nearest_id": pa.array([], pa.int64()),
            "distance": pa.array([], pa.float64()),
        })

    fields = ["test_id", "rank", "train_id", "vec"]
    # Fresh columns: both sides may stem from the same ranking.
    return ground.select(*fields).groupBy("test_id").cogroup(
        points.select(*fields).toDF(*fields).groupBy("test_id")
    ).applyInArrow(solve, "test_id bigint, rank int, train_id bigint, nearest_id bigint, distance double")
