"""Linear coders: how well a combination of selected vectors rebuilds the test vector.

With A the k selected vectors, g the test vector and A' = Q R, every coder and every score needs only
R (k x k), c = Q'g, the row sums of A and a few sums of g. `gram` builds that record per selection in
one group per test row, so vectors shared by many selections of a test travel once. The solvers never
see the width of the vectors. K = R'R and b = R'c; using R keeps the condition number unsquared.
Records of one size are solved together as stacks; the few whose selection is not clearly of full rank
are solved one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exselect.operators.scoring import as_matrix, doubles, gather_vectors, with_scalar
from exselect.session import cut_lineage, is_cut, spread

GRAM_FIELDS = (
    "width int, size int, r array<double>, c array<double>, s array<double>, "
    "sum_g double, var_g double, rest double"
)
# Variance is guarded as in the published score.
GAIN_EPS = 1e-8
# Values of the matrices that are factored or solved together.
STACK_VALUES = 1 << 18


def gram(
    selections: DataFrame, train: DataFrame, test: DataFrame, key: str = "selection"
) -> DataFrame:
    """(test_id, key, ...) with one record per selection `selections(test_id, key, rank, train_id)`.

    The distinct (test, train) pairs pick up their vectors once; a group holds one test row's pairs.
    """
    selections = selections.select("test_id", key, "rank", "train_id")
    selections = selections if is_cut(selections) else cut_lineage(selections)
    vectors = gather_vectors(selections.select("test_id", "train_id").distinct(), train)
    own = test.select("test_id", F.lit(None).cast("bigint").alias("train_id"), doubles().alias("vec"))
    rows = vectors.select("test_id", "train_id", "vec").unionByName(own)
    picks = selections.groupBy("test_id", key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "train_id"))), lambda p: p["train_id"])
        .alias("ids")
    )

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _gram_table(key, left, [], [])
        ids = right["train_id"].to_pylist()
        place = {i: at for at, i in enumerate(ids)}
        vectors = as_matrix(right["vec"])
        picks = list(map(tuple, left["ids"].to_pylist()))
        known = _factored(vectors, vectors[place[None]], {chosen: [place[i] for i in chosen] for chosen in picks})
        return _gram_table(key, left, *zip(*(known[chosen] for chosen in picks)))

    # Fresh columns: both sides stem from the same selections.
    rows = spread(rows.toDF(*rows.columns), "test_id")
    return spread(picks, "test_id").groupBy("test_id").cogroup(rows.groupBy("test_id")).applyInArrow(
        build, f"test_id bigint, {key} string, {GRAM_FIELDS}"
    )


def _factored(vectors: np.ndarray, g: np.ndarray, picks: dict[tuple, list[int]]) -> dict[tuple, tuple[tuple, tuple]]:
    """(R, c, row sums) and (width, size, sum, variance, rest) of the picked rows of `vectors`, by their ids.

    Many settings pick the same rows in the same order, or the first of them: the factors of the first rows stand at the
    start of those of all. With g as one more column, R holds c and what is left of g.
    """
    width, total, variance = len(g), g.sum(), g.var()
    sums = vectors.sum(axis=1)
    known, lengths = {}, sorted({len(chosen) for chosen in picks}, reverse=True)
    for at, size in enumerate(lengths):
        new = [chosen for chosen in picks if len(chosen) == size and chosen not in known]
        stack = max(1, STACK_VALUES // (width * (size + 1)))
        for low in range(0, len(new), stack):
            part = new[low:low + stack]
            columns = np.empty((len(part), width, size + 1))
            columns[:, :, :size] = vectors[[picks[chosen] for chosen in part]].transpose(0, 2, 1)
            columns[:, :, size] = g
            for chosen, r in zip(part, np.linalg.qr(columns, mode="r")):
                c = r[:, size]
                for shorter in lengths[at:]:
                    first = chosen[:shorter]
                    if first in picks and first not in known:
                        rows = min(width, shorter)
                        known[first] = (
                            (r[:rows, :shorter].ravel(), c[:rows], sums[picks[first]]),
                            (width, shorter, total, variance, c[rows:] @ c[rows:]),
                        )
    return known


def _gram_table(key: str, left: pa.Table, parts: Sequence, numbers: Sequence) -> pa.Table:
    width, size, sum_g, var_g, rest = np.array(numbers).T if numbers else np.empty((5, 0))
    r, c, s = zip(*parts) if parts else ((), (), ())

    def lists(rows):
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0)))

    return pa.table({
        "test_id": left["test_id"].cast(pa.int64()) if numbers else pa.array([], pa.int64()),
        key: left[key].cast(pa.string()) if numbers else pa.array([], pa.string()),
        "width": width.astype(np.int32), "size": size.astype(np.int32), "r": lists(r), "c": lists(c),
        "s": lists(s), "sum_g": sum_g, "var_g": var_g, "rest": rest,
    })


def gram_products(records: DataFrame) -> DataFrame:
    """Add K = R'R (row by row) and b = R'c to gram records, as array columns."""
    rows = (F.size("r") / F.col("size")).cast("int")

    def column(i):
        """Column i (from 0) of R."""
        return F.transform(F.sequence(F.lit(0), rows - 1), lambda p: F.get("r", p * F.col("size") + i))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)

    every = F.sequence(F.lit(0), F.col("size") - 1)
    return records.withColumn(
        "gram_k", F.flatten(F.transform(every, lambda i: F.transform(every, lambda j: dot(column(i), column(j)))))
    ).withColumn("gram_b", F.transform(every, lambda i: dot(column(i), F.col("c"))))


def project_simplex(column):
    """Column expression: nearest point of {t >= 0, sum t = 1}, by sorting.

    One pass over the sorted entries tracks (sum - 1) / count; it rises while entries still exceed it,
    so its largest value is the shift.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(float("-inf")).alias("tau"))

    def step(acc, x):
        total, n = acc["sum"] + x, acc["n"] + 1
        return F.struct(total.alias("sum"), n.alias("n"), F.greatest(acc["tau"], (total - 1.0) / n).alias("tau"))

    tau = F.aggregate(F.reverse(F.array_sort(column)), start, step, lambda acc: acc["tau"])
    return with_scalar(column, tau, lambda x, shift: F.greatest(x - shift, F.lit(0.0)))


def soft_threshold(column, weight: float = 0.5):
    """Column expression: shrink every entry by weight * sum(t); the sum may be negative."""
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)
    return with_scalar(
        column, total * weight, lambda x, cut: F.signum(x) * F.greatest(F.abs(x) - cut, F.lit(0.0))
    )


class Problem:
    """One selection's reduced least-squares problem."""

    def __init__(self, r: np.ndarray, c: np.ndarray, width: int):
        self.r, self.c, self.width = r, c, width
        self.k = r.T @ r
        self.b = r.T @ c
        self._least = self._pinv = None

    def solve(self, target: np.ndarray) -> np.ndarray:
        """Least squares of smallest norm, R t ~ target; R is triangular unless k exceeds the width."""
        r = self.r
        if r.shape[0] == r.shape[1] and _clearly_full_rank(r):
            return np.linalg.solve(r, target)
        if self._pinv is None:
            self._pinv = np.linalg.pinv(r, rcond=max(self.width, r.shape[1]) * np.finfo(float).eps)
        return self._pinv @ target

    def least(self) -> np.ndarray:
        if self._least is None:
            self._least = self.solve(self.c)
        return self._least


def _clearly_full_rank(triangle: np.ndarray, share: float = 1e-6) -> bool:
    pivots = np.abs(np.diag(triangle))
    return bool(pivots.min() > share * pivots.max())


def simplex(t: np.ndarray) -> np.ndarray:
    desc = np.sort(t)[::-1]
    tau = ((np.cumsum(desc) - 1.0) / np.arange(1, len(t) + 1)).max()
    return np.maximum(t - tau, 0.0)


def shrink(t: np.ndarray, weight: float = 0.5) -> np.ndarray:
    return np.sign(t) * np.maximum(np.abs(t) - weight * t.sum(), 0.0)


def sparse_simplex(t: np.ndarray, keep: float = 0.5) -> np.ndarray:
    """Support of max(1, int(keep n)) entries grown greedily, then shifted to sum 1 without clamping."""
    size = max(1, int(keep * len(t)))
    support = [int(np.argmax(t))]
    while len(support) < size:
        level = (t[support].sum() - 1.0) / len(support)
        away = np.abs(t - level)
        away[support] = -np.inf
        support.append(int(np.argmax(away)))
    out = np.zeros(len(t))
    out[support] = t[support] - (t[support].sum() - 1.0) / size
    return out


def klt(p: Problem) -> np.ndarray:
    """Fit the part of g inside the span of the centred selection; the null direction is dropped.

    The differences to the last vector span the same space as the centred vectors.
    """
    if p.r.shape[1] == 1:
        return np.zeros(1)
    steps = p.r[:, :-1] - p.r[:, -1:]
    if steps.shape[0] >= steps.shape[1]:
        basis, triangle = np.linalg.qr(steps)
    if steps.shape[0] < steps.shape[1] or not _clearly_full_rank(triangle):
        u, sigma, _ = np.linalg.svd(p.r - p.r.mean(axis=1, keepdims=True), full_matrices=False)
        tol = max(p.width, len(sigma)) * np.finfo(float).eps * max(sigma.max(initial=0.0), np.linalg.norm(p.r))
        basis = u[:, sigma > tol]
    return p.solve(basis @ (basis.T @ p.c))


def ridge(p: Problem, lam: float = 0.7) -> np.ndarray:
    return np.linalg.solve(p.k + lam * np.eye(len(p.b)), p.b)


def _pivoted(design: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Non-negative solution by exchanging all wrong entries at once; None if that cycles.

    The normal equations pick the support; one refinement step on it restores their lost digits.
    """
    normal, right = design.T @ design, design.T @ target
    free = np.linalg.solve(design, target) > 0 if design.shape[0] == design.shape[1] else right > 0
    tol = 1e-10 * max(np.abs(right).max(), 1e-300)
    for _ in range(20):
        t = np.zeros(len(right))
        if free.any():
            block = normal[np.ix_(free, free)]
            t[free] = np.linalg.solve(block, right[free])
        slope = normal @ t - right
        wrong = (free & (t < 0)) | (~free & (slope < -tol))
        if not wrong.any():
            if free.any():
                t[free] += np.linalg.solve(block, (design.T @ (target - design @ t))[free])
            return np.maximum(t, 0.0)
        free = free ^ wrong
    return None


def nonnegative(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """min |design t - target| over t >= 0; exact for a full-rank design."""
    t = _pivoted(design, target)
    return _active_set(design, target) if t is None else t


def _active_set(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The same, entry by entry: slower, but it always ends."""
    size = design.shape[1]
    t, free = np.zeros(size), np.zeros(size, bool)
    gradient = design.T @ target
    tol = 10 * np.finfo(float).eps * np.abs(design).sum(axis=0).max() * size * max(np.abs(target).max(), 1e-300)
    for _ in range(3 * size + 10):
        if free.all() or gradient[~free].max() <= tol:
            break
        free[np.argmax(np.where(free, -np.inf, gradient))] = True
        while True:
            trial = np.zeros(size)
            trial[free] = np.linalg.lstsq(design[:, free], target, rcond=None)[0]
            bad = free & (trial <= 0)
            if not bad.any():
                break
            step = (t[bad] / (t[bad] - trial[bad])).min()
            t = t + step * (trial - t)
            free &= t > 1e-14 * max(t.max(), 1e-300)
            t[~free] = 0.0
        t = trial
        gradient = design.T @ (target - design @ t)
    else:
        raise ArithmeticError("non-negative fit did not settle")
    return t


def nonnegative_ridge(p: Problem, lam: float = 0.7) -> np.ndarray:
    """The damped normal matrix is the design: min |(K + lam I) t - b| over t >= 0."""
    return nonnegative(p.k + lam * np.eye(len(p.b)), p.b)


def lasso_path(g: np.ndarray, h: np.ndarray, l1: float) -> np.ndarray:
    """min t'Gt - 2h't + l1 |t| for positive definite G, along the exact path of solutions for falling weights.

    From the weight at which all entries are 0, the solution moves along a line until an entry outside reaches the
    weight with its slope and joins, or an entry inside reaches 0 and drops; each piece is solved, none is searched.
    """
    size = len(h)
    t, slope = np.zeros(size), 2.0 * h
    weight = np.abs(slope).max(initial=0.0)
    if weight <= l1:
        return t
    inside = [int(np.argmax(np.abs(slope)))]
    signs = [np.sign(slope[inside[0]])]
    # Both sides of an event are lines that have met there, so the entry it was about cannot repeat it on the next piece.
    joined, dropped = inside[0], (-1, 0.0)
    while True:
        at, s = np.array(inside, int), np.array(signs)
        block = g[np.ix_(at, at)]
        # t = base - weight * turn on the entries inside, slope = rest - weight * lean on the others.
        base, turn = np.linalg.solve(block, np.stack([h[at], s / 2.0], axis=1)).T if len(at) else (np.zeros(0), np.zeros(0))
        rest, lean = 2.0 * (h - g[:, at] @ base), -2.0 * (g[:, at] @ turn)
        nearest, event = l1, None
        outside = np.ones(size, bool)
        outside[at] = False
        for sign in (1.0, -1.0):  # rest - w * lean = sign * w
            with np.errstate(divide="ignore", invalid="ignore"):
                meets = rest / (sign + lean)
            leaves = 1.0 + sign * lean > 1e-12  # beyond the weight below, not above
            for j in np.flatnonzero(outside & leaves & (meets > l1) & (meets <= weight * (1 + 1e-9))):
                if meets[j] > nearest and (j, sign) != dropped:
                    nearest, event = float(meets[j]), (int(j), sign)
        with np.errstate(divide="ignore", invalid="ignore"):
            zeros = base / turn
        for k in np.flatnonzero((s * turn < 0) & (zeros > l1) & (zeros <= weight * (1 + 1e-9))):
            if zeros[k] > nearest and at[k] != joined:
                nearest, event = float(zeros[k]), (int(at[k]), 0.0)
        if event is None:
            t[at] = base - l1 * turn
            return t
        weight, (j, sign) = min(nearest, weight), event
        if sign:
            inside.append(j)
            signs.append(sign)
            joined, dropped = j, (-1, 0.0)
        else:
            k = inside.index(j)
            joined, dropped = -1, (j, signs[k])
            del inside[k], signs[k]


def softplus_square(t: np.ndarray, weight: float) -> tuple[float, np.ndarray, np.ndarray]:
    """weight * sum softplus(-t)^2 with its first and second derivatives."""
    soft, share = np.logaddexp(0.0, -t), np.exp(-np.logaddexp(0.0, t))
    return weight * (soft @ soft), -2.0 * weight * soft * share, 2.0 * weight * (share * share + soft * share * (1.0 - share))


def violation(g: np.ndarray, h: np.ndarray, l1: float, t: np.ndarray, more: np.ndarray | float = 0.0) -> float:
    """How far t is from the optimality conditions of t'Gt - 2h't + l1 |t|, and a smooth term with gradient `more`."""
    slope = 2.0 * (g @ t - h) + more
    return float(np.where(t != 0, np.abs(slope + l1 * np.sign(t)), np.maximum(np.abs(slope) - l1, 0.0)).max(initial=0.0))


def _net(p: Problem, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """G, h and how much of a slope rounding may leave."""
    g, h = p.k / p.width + l2 * np.eye(len(p.b)), p.b / p.width
    return g, h, 1e-8 * max(1.0, np.abs(h).max(initial=0.0), np.abs(g).max(initial=0.0))


def elastic_net(p: Problem, l1: float = 0.3, l2: float = 0.7) -> np.ndarray:
    """Mean squared error + l1 |t| + l2 t^2: the end of the exact path, checked by the optimality conditions."""
    g, h, limit = _net(p, l2)
    t = lasso_path(g, h, l1)
    if violation(g, h, l1, t) > limit:
        raise ArithmeticError("the path does not end at an optimum: are vectors repeated and is l2 0?")
    return t


def penalised_net(p: Problem, l1: float = 0.3, l2: float = 0.7, weight: float = 0.5) -> np.ndarray:
    """Elastic net plus weight * sum softplus(-t)^2, which discourages negative entries.

    The smooth term is replaced by its parabola at t, the path gives the best t for it, and so on while that lowers
    the loss; the optimality conditions decide.
    """
    g, h, limit = _net(p, l2)

    def loss(t: np.ndarray) -> float:
        return t @ g @ t - 2.0 * (h @ t) + l1 * np.abs(t).sum() + softplus_square(t, weight)[0]

    t = np.zeros(len(h))
    while True:
        _, first, second = softplus_square(t, weight)
        off = violation(g, h, l1, t, first)
        if off <= limit:
            return t
        move = lasso_path(g + np.diag(second) / 2.0, h - first / 2.0 + second * t / 2.0, l1) - t
        now, part = loss(t), 1.0
        if violation(g, h, l1, t + move, softplus_square(t + move, weight)[1]) > off / 2.0:  # near the optimum losses differ by rounding only
            while part > 1e-9 and loss(t + part * move) >= now:
                part /= 2.0
        if part <= 1e-9:
            raise ArithmeticError("no step lowers the loss of the penalised net")
        t = t + part * move


# The names under which records carry each coder.
CODERS = {
    "MSECoderProjUSimpSparse": lambda p: sparse_simplex(p.least()),
    "MSECoderProjUSimp": lambda p: simplex(p.least()),
    "KLTCoder": klt,
    "MSECoder": lambda p: p.least().copy(),
    "MSECoderNNLSL2": nonnegative_ridge,
    "MSECoderProjUSimpSparseSoftThresh": lambda p: simplex(shrink(p.least())),
    # Available, not in the active set.
    "MSECoderL2": ridge,
    "MSECoderElasticNet": elastic_net,
    "MSECoderLemon": penalised_net,
    "CosineCoder": lambda p: p.least().copy(),
}
ACTIVE_CODERS = (
    "MSECoderProjUSimpSparse", "MSECoderProjUSimp", "KLTCoder", "MSECoder", "MSECoderNNLSL2",
    "MSECoderProjUSimpSparseSoftThresh",
)


class Stack:
    """Reduced problems of one size, each with a triangular R clearly of full rank."""

    def __init__(self, r: np.ndarray, c: np.ndarray):
        self.r, self.c = r, c
        turned = r.transpose(0, 2, 1)
        self.k = turned @ r
        self.b = (turned @ c[:, :, None])[:, :, 0]
        self.least = _back(r, c)


def _back(r: np.ndarray, target: np.ndarray) -> np.ndarray:
    """R t = target for a stack of upper triangles."""
    t = np.empty_like(target)
    for i in reversed(range(target.shape[1])):
        t[:, i] = (target[:, i] - np.einsum("nj,nj->n", r[:, i, i + 1:], t[:, i + 1:])) / r[:, i, i]
    return t


def _forward(r: np.ndarray, target: np.ndarray) -> np.ndarray:
    """R't = target for a stack of upper triangles."""
    t = np.empty_like(target)
    for i in range(target.shape[1]):
        t[:, i] = (target[:, i] - np.einsum("nj,nj->n", r[:, :i, i], t[:, :i])) / r[:, i, i]
    return t


def _simplex_rows(t: np.ndarray) -> np.ndarray:
    desc = np.sort(t, axis=1)[:, ::-1]
    tau = ((np.cumsum(desc, axis=1) - 1.0) / np.arange(1, t.shape[1] + 1)).max(axis=1, keepdims=True)
    return np.maximum(t - tau, 0.0)


def _shrink_rows(t: np.ndarray, weight: float = 0.5) -> np.ndarray:
    return np.sign(t) * np.maximum(np.abs(t) - weight * t.sum(axis=1, keepdims=True), 0.0)


def _sparse_simplex_rows(t: np.ndarray, keep: float = 0.5) -> np.ndarray:
    size, rows = max(1, int(keep * t.shape[1])), np.arange(len(t))
    support = np.zeros(t.shape, bool)
    best = t.argmax(axis=1)
    total = np.zeros(len(t))
    for count in range(1, size + 1):
        support[rows, best] = True
        total += t[rows, best]
        away = np.abs(t - ((total - 1.0) / count)[:, None])
        away[support] = -np.inf
        best = away.argmax(axis=1)
    return np.where(support, t - ((total - 1.0) / size)[:, None], 0.0)


def _klt_rows(p: Stack) -> np.ndarray:
    """As `klt`: n with R'n = 1 stands on all differences of the selection, so c loses its part along n."""
    if p.c.shape[1] == 1:
        return np.zeros(p.c.shape)
    n = _forward(p.r, np.ones(p.c.shape))
    share = (n * p.c).sum(axis=1) / (n * n).sum(axis=1)
    return p.least - share[:, None] * _back(p.r, n)


def _solved(matrices: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return np.linalg.solve(matrices, targets[:, :, None])[:, :, 0]


def _nonnegative_ridge_rows(p: Stack, lam: float = 0.7) -> np.ndarray:
    """As `nonnegative_ridge`, the exchanges of all problems side by side; entries outside the support are held at 0."""
    design = p.k + lam * np.eye(p.b.shape[1])
    normal, right = design @ design, (design @ p.b[:, :, None])[:, :, 0]
    free = _solved(design, p.b) > 0
    tol = 1e-10 * np.maximum(np.abs(right).max(axis=1, keepdims=True), 1e-300)
    out, left = np.empty(p.b.shape), np.arange(len(right))
    for _ in range(20):
        block = np.where(free[:, :, None] & free[:, None, :], normal[left], np.eye(p.b.shape[1]))
        t = _solved(block, right[left] * free)
        slope = (normal[left] @ t[:, :, None])[:, :, 0] - right[left]
        wrong = (free & (t < 0)) | (~free & (slope < -tol[left]))
        more = wrong.any(axis=1)
        done = left[~more]
        if len(done):
            d, x = design[done], t[~more]
            off = p.b[done] - (d @ x[:, :, None])[:, :, 0]
            x = x + _solved(block[~more], (d @ off[:, :, None])[:, :, 0] * free[~more])
            out[done] = np.maximum(x, 0.0)
        left, free = left[more], (free ^ wrong)[more]
        if not len(left):
            return out
    for i in left:
        out[i] = _active_set(design[i], p.b[i])
    return out


# The coders that solve a stack at once; others go through its problems one by one.
STACKED = {
    "MSECoderProjUSimpSparse": lambda p: _sparse_simplex_rows(p.least),
    "MSECoderProjUSimp": lambda p: _simplex_rows(p.least),
    "KLTCoder": _klt_rows,
    "MSECoder": lambda p: p.least,
    "MSECoderNNLSL2": _nonnegative_ridge_rows,
    "MSECoderProjUSimpSparseSoftThresh": lambda p: _simplex_rows(_shrink_rows(p.least)),
    "CosineCoder": lambda p: p.least,
}


def _ragged(column: pa.ListArray):
    """Row accessor of a list column without leaving numpy."""
    flat = column.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return lambda at: flat[ends[at]:ends[at + 1]]


def _fitted(names: tuple[str, ...], p: Problem, s: np.ndarray, sum_g: float, var_g: float, rest: float) -> tuple[np.ndarray, np.ndarray]:
    """(coders x k coefficients, coders x (pred_gain, mse, l1, l2, cosine)) of one record."""
    ts = np.array([CODERS[name](p) for name in names])
    off = p.c - ts @ p.r.T
    mse = ((off * off).sum(axis=1) + rest) / p.width
    mean = (sum_g - ts @ s) / p.width
    length = np.sqrt((p.c @ p.c + rest) * ((ts @ p.k) * ts).sum(axis=1))
    gain = var_g / (np.maximum(mse - mean * mean, 0.0) + GAIN_EPS)
    cosine = np.divide(ts @ p.b, length, out=np.zeros(len(ts)), where=length != 0)
    return ts, np.stack([gain, mse, np.abs(ts).sum(axis=1), (ts * ts).sum(axis=1), cosine], axis=1)


def _fitted_stack(
    names: tuple[str, ...], r: np.ndarray, c: np.ndarray, s: np.ndarray, width: np.ndarray, sum_g: np.ndarray, var_g: np.ndarray, rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """`_fitted` of records of one size, one record after the other along the first axis."""
    ts, marks = np.empty((len(r), len(names), r.shape[2])), np.empty((len(r), len(names), 5))
    pivots = np.abs(np.diagonal(r, axis1=1, axis2=2))
    clear = pivots.min(axis=1) > 1e-6 * pivots.max(axis=1) if r.shape[1] == r.shape[2] else np.zeros(len(r), bool)
    for i in np.flatnonzero(~clear):
        ts[i], marks[i] = _fitted(names, Problem(r[i], c[i], int(width[i])), s[i], sum_g[i], var_g[i], rest[i])
    if not clear.any():
        return ts, marks
    r, c, s, width, sum_g, var_g, rest = (x[clear] for x in (r, c, s, width, sum_g, var_g, rest))
    p = Stack(r, c)
    t = np.stack([
        STACKED[name](p) if name in STACKED else np.array([CODERS[name](Problem(*of)) for of in zip(r, c, width.tolist())]) for name in names
    ], axis=1)
    off = c[:, None] - t @ r.transpose(0, 2, 1)
    mse = ((off * off).sum(axis=2) + rest[:, None]) / width[:, None]
    mean = (sum_g[:, None] - (t @ s[:, :, None])[:, :, 0]) / width[:, None]
    length = np.sqrt(((c * c).sum(axis=1) + rest)[:, None] * ((t @ p.k) * t).sum(axis=2))
    gain = var_g[:, None] / (np.maximum(mse - mean * mean, 0.0) + GAIN_EPS)
    cosine = np.divide((t @ p.b[:, :, None])[:, :, 0], length, out=np.zeros(length.shape), where=length != 0)
    ts[clear], marks[clear] = t, np.stack([gain, mse, np.abs(t).sum(axis=2), (t * t).sum(axis=2), cosine], axis=2)
    return ts, marks


def fit(records: DataFrame, coders: Iterable[str] = ACTIVE_CODERS, key: str = "selection") -> DataFrame:
    """One row per (record, coder) with t, pred_gain, mse, l1, l2 and the cosine of the rebuilt vector."""
    names = tuple(coders)

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            r_all, c_all, s_all = (_ragged(batch[name]) for name in ("r", "c", "s"))
            width, size = batch["width"].to_numpy(), batch["size"].to_numpy()
            sum_g, var_g, rest = (batch[name].to_numpy() for name in ("sum_g", "var_g", "rest"))
            test = batch["test_id"].to_pylist()
            known, which, shapes = {}, np.empty(batch.num_rows, np.int64), {}
            for at in range(batch.num_rows):
                if at and test[at] != test[at - 1]:
                    known.clear()
                r = r_all(at)
                record = (int(width[at]), int(size[at]), sum_g[at], var_g[at], rest[at], r.tobytes(), c_all(at).tobytes(), s_all(at).tobytes())
                which[at] = known.setdefault(record, at)  # settings that pick the same rows have the same record
                if which[at] == at:
                    shapes.setdefault((len(r) // int(size[at]), int(size[at])), []).append(at)
            found, scores = [None] * batch.num_rows, np.empty((batch.num_rows, len(names), 5))
            for (rows, columns), all_of in shapes.items():
                stack = max(1, STACK_VALUES // (rows * columns))
                for low in range(0, len(all_of), stack):
                    part = all_of[low:low + stack]
                    ts, scores[part] = _fitted_stack(
                        names, np.array([r_all(at) for at in part]).reshape(-1, rows, columns), *(np.array([of(at) for at in part]) for of in (c_all, s_all)),
                        width[part], sum_g[part], var_g[part], rest[part],
                    )
                    for at, t in zip(part, ts):
                        found[at] = t
            found, scores = [found[at] for at in which], scores[which].reshape(-1, 5)
            source = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
            gain, mse, l1, l2, cosine = scores.T
            ends = np.concatenate([[0], np.cumsum(np.repeat(size, len(names)))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "test_id": batch["test_id"].take(source), key: batch[key].take(source),
                "linear_coder": pa.array(names * batch.num_rows, pa.string()),
                "pred_gain": gain, "mse": mse, "l1": l1, "l2": l2, "cosine": cosine,
                "t": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([t.ravel() for t in found]))),
            })

    return records.mapInArrow(
        solve,
        f"test_id bigint, {key} string, linear_coder string, pred_gain double, mse double, "
        "l1 double, l2 double, cosine double, t array<double>",
    )


def reconstruction(fitted: DataFrame, selections: DataFrame, train: DataFrame, key: str = "selection") -> DataFrame:
    """Rebuilt vectors A't, for inspection: weighted vectors added by the JVM summarizer."""
    weights = fitted.select("test_id", key, "linear_coder", F.posexplode("t").alias("pos", "w"))
    picked = gather_vectors(selections.select("test_id", key, "rank", "train_id"), train).withColumn(
        "pos", F.col("rank") - 1
    )
    return (
        weights.join(picked, ["test_id", key, "pos"])
        .withColumn("part", F.transform("vec", lambda x: x * F.col("w")))
        .groupBy("test_id", key, "linear_coder")
        .agg(Summarizer.sum(array_to_vector("part")).alias("v"))
        .withColumn("rebuilt", vector_to_array("v"))
        .drop("v")
    )


def require_complete(records: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pass the records on; a null or NaN in `columns` fails the job when the row is read."""
    missing = F.lit(False)
    kinds = dict(records.dtypes)
    for name in columns:
        missing = missing | F.col(name).isNull()
        if kinds[name] in ("double", "float"):
            missing = missing | F.isnan(name)
    return records.where(
        F.when(missing, F.raise_error(F.lit("record contains missing values")).cast("boolean")).otherwise(True)
    )
