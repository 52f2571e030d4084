"""Scoring of every (test, train) pair and top-k selection fused into the scan of the train side.

The train side is the one that grows: it is scanned in place and never shuffled. The test side is
measured first; if it fits the broadcast limit each task multiplies its train batches with the whole
test matrix. Beyond the limit the test side is cut into hashed blocks that fit, one scan each, and
every block's result is stored before the next block is shared. Top-k keeps at most k rows per test
and order in each task, so the dense matrix never exists; many tests are worked off some at a time
against a held chunk of train rows, so a task's candidates are bounded too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exselect.session import broadcast_limit, cut_lineage, small_side, union_all

# Order of each selection family: what makes a score come first.
SORT_KEYS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "most_helpful": lambda s: s,
    "most_harmful": lambda s: -s,
    "least_influential": np.abs,
    "most_influential": lambda s: -np.abs(s),
}
SORT_TYPES = tuple(SORT_KEYS)

Batches = Iterable[tuple[np.ndarray, np.ndarray]]
Work = Callable[[np.ndarray, np.ndarray, Batches], Iterator[pa.RecordBatch]]

# Upper sizes of a selection row and of an id in a broadcast table.
SELECTION_BYTES, ID_BYTES = 128, 32
# A kept candidate in a task, and the scores a task computes at a time.
CANDIDATE_BYTES, SCORES_PER_STEP = 32, 1 << 19
# Pairs a task lets wait for a merge, rows it sorts or looks at together, and rows of a batch it gives back.
WAITING_PAIRS, ROWS_IN, ROWS_OUT = 1 << 15, 1 << 18, 1 << 16
# Candidates and tests a task keeps at a time; beyond them, train vectors it holds for one range of tests after the other. A key.
KEPT_BYTES, RANGE_TESTS, CHUNK_BYTES, KEY_BYTES = 8 << 20, 2048, 64 << 20, 8
SCORE_SCHEMA = "test_id bigint, train_id bigint, score double"
CANDIDATE_SCHEMA = "sort_type string, test_id bigint, train_id bigint, score double, sort_key double"


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal-width vectors as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(column)
    if rows and flat.size % rows:
        raise ValueError("vectors of one table must have one width")
    return flat.reshape(rows, -1)


def doubles(column: str = "vec"):
    """Vector column widened to double before any arithmetic."""
    return F.col(column).cast("array<double>")


def row_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_scalar(array, scalar, fn):
    """transform(array, x -> fn(x, scalar)) with the scalar computed once per row, not per entry."""
    return F.zip_with(array, F.array_repeat(scalar, F.size(array)), fn)


def normalized(df: DataFrame, column: str = "vec", eps: float = 1e-10) -> DataFrame:
    """Unit vectors: v / (|v| + eps)."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda total, x: total + x * x)) + F.lit(eps)
    return df.withColumn(column, with_scalar(column, norm, lambda x, n: x / n))


def adam_precondition(
    blocks: DataFrame, state: DataFrame, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8
) -> DataFrame:
    """Replace each block's vector g by (b1 m + (1-b1) g) / sqrt(b2 v + (1-b2) g^2 + eps).

    `state(block, m, v)` holds one row per block, the number of weight tensors of a model.
    """
    moved = F.zip_with("vec", "m", lambda g, m: beta1 * m + (1 - beta1) * g)
    scale = F.zip_with("vec", "v", lambda g, v: F.sqrt(beta2 * v + (1 - beta2) * g * g + eps))
    return (
        blocks.join(state, "block")
        .withColumn("vec", F.zip_with(moved, scale, lambda a, b: a / b))
        .drop("m", "v")
    )


def scan_against(
    test: DataFrame, train: DataFrame, work: Work, schema: str, state_bytes: int = 0, whole: bool = False, store: bool = True
) -> DataFrame:
    """Run `work(test_ids, test_matrix, train_batches)` over all pairs of the two vector tables.

    `test(test_id, vec)`, `train(train_id, vec)`. See the module text for the two ways. `state_bytes`
    is what `work` keeps per test row; it counts towards the size of a block. Train batches come in pieces
    that make SCORES_PER_STEP scores with all tests, or `whole`, as Spark sends them. Without `store` the blocks stay shared
    and are scanned when the result is read: for pair tables, which are larger than all blocks together.
    """
    spark = train.sparkSession
    test = test.select("test_id", doubles().alias("vec"))
    train = train.select("train_id", doubles().alias("vec"))
    rows, width = test.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not rows:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(rows * (width * 8 + state_bytes) / broadcast_limit(spark))
    if blocks <= 1:
        return _scan_block(test, train, work, schema, whole)[0]
    done = []
    for block in range(blocks):
        part = test.where(F.pmod(F.xxhash64("test_id"), F.lit(blocks)) == block)
        found, shared = _scan_block(part, train, work, schema, whole)
        if store:
            found = cut_lineage(found)
            shared.destroy()
        done.append(found)
    return union_all(done)


def _scan_block(test: DataFrame, train: DataFrame, work: Work, schema: str, whole: bool):
    """One scan of the train side against a test block within the broadcast limit."""
    side = test.orderBy("test_id").toArrow()
    matrix = as_matrix(side["vec"]) if side.num_rows else np.empty((0, 0))
    shared = train.sparkSession.sparkContext.broadcast((side["test_id"].to_numpy(), matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        if len(ids):
            steps = (b for b in batches if b.num_rows) if whole else row_slices(batches, max(1, SCORES_PER_STEP // len(ids)))
            yield from work(ids, matrix, ((b["train_id"].to_numpy(), as_matrix(b["vec"])) for b in steps))

    return train.mapInArrow(scan, schema), shared


def _candidate_order(test: np.ndarray, key: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Order by test, key and train id; the ids are compared only where keys of a test are equal."""
    order = np.argsort(key)
    order = order[np.argsort(test[order], kind="stable")]
    test, key = test[order], key[order]
    same = np.append(False, (test[1:] == test[:-1]) & (key[1:] == key[:-1]))
    if same.any():
        tied = np.flatnonzero(same | np.append(same[1:], False))
        rows = order[tied]
        order[tied] = rows[np.lexsort((train[rows], np.cumsum(~same)[tied]))]
    return order


class TopK:
    """The k best (key, train_id) of every (order, test).

    Pairs within the bounds wait and are merged many at a time. What is kept lies in ranges of tests, and a merge sorts one
    range after the other, so that it needs little beside what is kept. `bound` has, per order, a key for each test that no
    pair of the result is beyond; it is kept up to date in place.
    """

    def __init__(self, test_ids: np.ndarray, k: int, sort_types: Iterable[str], bound: dict[str, np.ndarray] | None = None):
        self.test_ids = test_ids
        self.k = k
        # Places in a range have 16 bits, which are sorted in linear time.
        self.ends = np.append(np.arange(0, len(test_ids), min(1 << 16, max(1, ROWS_IN // k))), len(test_ids)).astype(np.int32)
        # Per range: places in test_ids, train ids and scores, by test, key and train id.
        empty = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))
        self.best = {name: [empty] * (len(self.ends) - 1) for name in sort_types}
        self.waiting = {name: [] for name in self.best}
        self.bound = {name: np.full(len(test_ids), np.inf) for name in self.best} if bound is None else bound

    def add(self, train_ids: np.ndarray, scores: np.ndarray) -> None:
        """`scores` has one row per train id and one column per test id."""
        for name, found in self.waiting.items():
            keys, bound = SORT_KEYS[name](scores), self.bound[name]
            if len(train_ids) > self.k:  # a first bound; merges bring it nearer
                free = np.flatnonzero(bound == np.inf)
                if len(free):
                    bound[free] = np.fmin(np.inf, np.partition(keys[:, free], self.k - 1, axis=0)[self.k - 1])
            # NaN compares false and drops out, as it does in a smallest-k over a column.
            at = np.flatnonzero(keys <= bound)
            if len(at):
                row, col = np.divmod(at, scores.shape[1])
                found.append((col.astype(np.int32), train_ids[row], scores[row, col]))
                kept = sum(len(part[0]) for part in self.best[name])
                if sum(len(part[0]) for part in found) >= max(WAITING_PAIRS, kept):
                    self._merge(name)

    def _merge(self, name: str) -> None:
        new = [np.concatenate(parts) for parts in zip(*self.waiting[name])]
        self.waiting[name].clear()
        if len(self.best[name]) > 1:
            order = np.argsort(new[0], kind="stable")
            new = [part[order] for part in new]
        cuts = np.searchsorted(new[0], self.ends) if len(self.best[name]) > 1 else [0, len(new[0])]
        for at, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if low == high:
                continue
            test, train, score = (np.concatenate([kept, part[low:high]]) for kept, part in zip(self.best[name][at], new))
            key, first = SORT_KEYS[name](score), self.ends[at]
            order = _candidate_order((test - first).astype(np.uint16), key, train)
            test = test[order]
            counts = np.bincount(test - first)
            place = np.arange(len(test)) - (np.cumsum(counts) - counts)[test - first]
            last = place == self.k - 1
            self.bound[name][test[last]] = key[order[last]]
            keep = place < self.k
            order = order[keep]
            self.best[name][at] = (test[keep], train[order], score[order])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for name, ranges in self.best.items():
            if self.waiting[name]:
                self._merge(name)
            for best in ranges:
                for at in range(0, len(best[0]), ROWS_OUT):
                    test, train, score = (part[at:at + ROWS_OUT] for part in best)
                    yield pa.RecordBatch.from_pydict({
                        "sort_type": pa.array([name] * len(test), pa.string()),
                        "test_id": pa.array(self.test_ids[test], pa.int64()),
                        "train_id": pa.array(train, pa.int64()),
                        "score": pa.array(score, pa.float64()),
                        "sort_key": pa.array(SORT_KEYS[name](score), pa.float64()),
                    })


def rank_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """Merge per-task candidates: at most k per (sort_type, test) leave each map task again."""
    order = Window.partitionBy("sort_type", "test_id").orderBy("sort_key", "train_id")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("sort_type", "test_id", "rank", "train_id", "score")
    )


def _scores(left: np.ndarray, right: np.ndarray, digits: int | None) -> np.ndarray:
    """Scores of all pairs of the rows of two matrices."""
    scores = left @ right.T
    np.negative(scores, out=scores)
    return scores if digits is None else np.round(scores, digits, out=scores)


#: The vectors and digits of pair tables that no one has read yet: what needs few of the pairs need not have all of them as rows.
_UNREAD: WeakKeyDictionary[DataFrame, tuple[DataFrame, DataFrame, int | None]] = WeakKeyDictionary()


def dot_influence(
    test: DataFrame, train: DataFrame, normalize: bool = False, digits: int | None = None
) -> DataFrame:
    """Dense influence table, score = -(g_test . g_train); negative means helpful.

    Its size is tests x train by definition; selections should use `top_influence` instead. `top_k` of the table itself ranks
    the pairs in the tasks that score them, `of_pairs` scores the train rows of the pairs.
    """
    if normalize:
        test, train = normalized(test), normalized(train)

    def work(ids: np.ndarray, matrix: np.ndarray, batches: Batches) -> Iterator[pa.RecordBatch]:
        for train_ids, vectors in batches:
            scores = _scores(matrix, vectors, digits)
            yield pa.RecordBatch.from_pydict({
                "test_id": np.repeat(ids, len(train_ids)),
                "train_id": np.tile(train_ids, len(ids)),
                "score": scores.ravel(),
            })

    table = scan_against(test, train, work, SCORE_SCHEMA, store=False)
    _UNREAD[table] = test, train, digits
    return table


def of_pairs(influence: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The rows of a pair table whose (test_id, train_id) are in `pairs`, of at most `rows` rows.

    Of a table that `dot_influence` has still to make, only train rows with an id in `pairs` are scored.
    """
    if influence in _UNREAD:
        test, train, digits = _UNREAD[influence]
        ids = pairs.select("train_id").distinct()
        influence = dot_influence(test, train.join(small_side(ids, rows, ID_BYTES), "train_id", "left_semi"), digits=digits)
    return influence.join(small_side(pairs, rows, SELECTION_BYTES), ["test_id", "train_id"], "left_semi")


def _chunks(batches: Batches, most: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Train batches in lists of some `most` bytes of vectors; a list is emptied before the next one is filled."""
    chunk, size = [], 0
    for train_ids, vectors in batches:
        chunk.append((train_ids, vectors))
        size += vectors.nbytes
        if size >= most:
            yield chunk
            chunk.clear()
            size = 0
    if chunk:
        yield chunk


def top_influence(
    test: DataFrame,
    train: DataFrame,
    k: int,
    sort_types: Iterable[str] = SORT_TYPES,
    normalize: bool = False,
    digits: int | None = None,
    sample_fraction: float | None = None,
) -> DataFrame:
    """The k first train rows per test and order, ties by train id.

    With `sample_fraction` a first pass over a sample of the train rows finds, per test and order, the
    k-th best sampled key. The k-th best of any subset bounds the k-th best of the whole from behind,
    so the second pass drops only pairs that cannot rank. The result is the same; the rows that leave
    the tasks fall from (tasks x k) to about (k / fraction) per test. Use it when tasks are many.
    """
    names = tuple(sort_types)
    if normalize:
        test, train = normalized(test), normalized(train)
    bounds = {}
    if sample_fraction:
        seen = top_influence(test, train.sample(sample_fraction, 17), k, names, False, digits)
        key = {"most_helpful": F.col("score"), "most_harmful": -F.col("score"),
               "least_influential": F.abs("score"), "most_influential": -F.abs("score")}
        which = F.coalesce(*[F.when(F.col("sort_type") == n, key[n]) for n in names])
        # One row per (order, test): as bounded as the test side that is measured below.
        last = seen.where(F.col("rank") == k).select("sort_type", "test_id", which.alias("bound"))
        rows = test.count() * len(names)
        if rows * 24 <= broadcast_limit(train.sparkSession):
            for name, test_id, bound in last.toLocalIterator():
                bounds.setdefault(name, {})[test_id] = bound

    return rank_candidates(_scan_first(test, train, k, names, digits, bounds), k)


def _scan_first(
    test: DataFrame, train: DataFrame, k: int, names: tuple[str, ...], digits: int | None,
    bounds: dict[str, dict[int, float]] | None = None,
) -> DataFrame:
    """At most k pairs per test and order of each chunk of train rows, with their keys; every pair is scored, none is stored."""

    def work(ids: np.ndarray, matrix: np.ndarray, batches: Batches) -> Iterator[pa.RecordBatch]:
        bound = {name: np.full(len(ids), np.inf) for name in names}
        for name, known in (bounds or {}).items():
            bound[name][:] = [known.get(int(i), np.inf) for i in ids]
        some = min(RANGE_TESTS, max(1, KEPT_BYTES // (k * len(names) * CANDIDATE_BYTES)))
        for chunk in [batches] if len(ids) <= some else _chunks(batches, CHUNK_BYTES):
            for low in range(0, len(ids), some):
                part = slice(low, low + some)
                best = TopK(ids[part], k, names, {name: keys[part] for name, keys in bound.items()})
                rows = max(1, SCORES_PER_STEP // len(ids[part]))
                for train_ids, vectors in chunk:
                    for at in range(0, len(train_ids), rows):
                        best.add(train_ids[at:at + rows], _scores(vectors[at:at + rows], matrix[part], digits))
                yield from best.batches()

    return scan_against(test, train, work, CANDIDATE_SCHEMA, len(names) * KEY_BYTES, whole=True)


class _FirstRows:
    """The first k rows of every test_id by (sort_key, train_id), nulls first, of an Arrow table that comes in pieces."""

    def __init__(self, k: int, schema: pa.Schema):
        self.k, self.kept, self.waiting, self.ids, self.bound = k, schema.empty_table(), [], None, None

    def add(self, rows: pa.Table) -> None:
        if self.ids is not None:
            place = pc.index_in(rows["test_id"], value_set=self.ids).combine_chunks()
            known = place.is_valid().to_numpy(zero_copy_only=False)
            limit = np.where(known, self.bound[place.fill_null(0).to_numpy()], np.inf)
            # A null key comes before all others.
            rows = rows.filter(pa.array(rows["sort_key"].combine_chunks().fill_null(-np.inf).to_numpy() <= limit))
        self.waiting.append(rows)
        if sum(part.num_rows for part in self.waiting) >= max(ROWS_IN, self.kept.num_rows // 2):
            self.merge()

    def merge(self) -> None:
        rows = pa.concat_tables([self.kept, *self.waiting]).combine_chunks()
        self.waiting.clear()
        keys = [(name, "ascending") for name in ("test_id", "sort_key", "train_id")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        if rows.num_rows:
            test = pc.dictionary_encode(rows["test_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
            start = np.flatnonzero(np.append(True, test[1:] != test[:-1]))
            place = np.arange(len(test)) - np.repeat(start, np.diff(np.append(start, len(test))))
            last = rows.filter(pa.array(place == self.k - 1))
            if last.num_rows:
                self.ids = last["test_id"].combine_chunks()
                self.bound = last["sort_key"].combine_chunks().fill_null(-np.inf).to_numpy()
            rows = rows.filter(pa.array(place < self.k))
        self.kept = rows


def _first_in_tasks(influence: DataFrame, k: int, sort_type: str) -> DataFrame:
    """At most k rows per test and task, with their keys and no sort or spill of the others. NaN scores drop out."""
    found = influence.select("test_id", "train_id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, parts = None, 0, []

        def keyed() -> pa.Table:
            table = pa.Table.from_batches(parts).combine_chunks()
            table = table.filter(pc.fill_null(pc.invert(pc.is_nan(table["score"])), True)).combine_chunks()
            score = table["score"].cast(pa.float64())
            size = pc.abs(score) if "influential" in sort_type else score
            return table.append_column("sort_key", pc.negate(size) if sort_type in ("most_harmful", "most_influential") else size)

        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_IN:
                table = keyed()
                first = first or _FirstRows(k, table.schema)
                first.add(table)
                rows, parts = 0, []
        if parts:
            table = keyed()
            first = first or _FirstRows(k, table.schema)
            first.add(table)
        if first:
            first.merge()
            yield from first.kept.to_batches(max_chunksize=ROWS_OUT)

    return found.mapInArrow(run, found.withColumn("sort_key", F.lit(None).cast("double")).schema)


def top_k(influence: DataFrame, k: int, sort_type: str) -> DataFrame:
    """Top-k of a stored influence table; NaN scores never rank. Each task sends on its first k rows per test.

    The pairs of a table that `dot_influence` has still to make are ranked in the tasks that score them.
    """
    if sort_type not in SORT_KEYS:
        raise KeyError(sort_type)
    if influence in _UNREAD:
        test, train, digits = _UNREAD[influence]
        return rank_candidates(_scan_first(test, train, k, (sort_type,), digits), k)
    return rank_candidates(_first_in_tasks(influence, k, sort_type).withColumn("sort_type", F.lit(sort_type)), k)


def explanation_rows(influence: DataFrame, tests: DataFrame) -> DataFrame:
    """The score rows of the listed tests; on a table partitioned by test_id the scan is pruned."""
    return influence.join(tests.select("test_id"), "test_id", "left_semi")


def gather_vectors(selections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of selected train rows, keyed as in `selections`; `rank` keeps the pick order.

    The selections are ids, few against the vectors: they are kept and counted, and the vectors are
    only scanned, not shuffled, if the ids fit the broadcast limit. Beyond it the distinct train ids,
    smaller again, thin out the vectors before the join.
    """
    vectors = vectors.select("train_id", doubles().alias("vec"))
    kept = cut_lineage(selections)
    rows = kept.count()
    if rows * SELECTION_BYTES > broadcast_limit(vectors.sparkSession):
        ids = kept.select("train_id").distinct()
        vectors = vectors.join(small_side(ids, rows, ID_BYTES), "train_id", "left_semi")
    return vectors.join(small_side(kept, rows, SELECTION_BYTES), "train_id")
