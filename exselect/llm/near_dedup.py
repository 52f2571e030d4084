"""Near duplicates by an LSH forest over MinHash signatures (operator 7).

Documents with equal shingle sets form a class; one signature per class is hung into several sorted orders (trees).
Round 1 takes neighbours in each order that share the opening of the order, confirms them on full sets and
joins them into components. Round 2 looks at every region (documents with a common opening) that still holds several
components: signatures tell which documents could reach another component, and their full sets decide. Large regions
are compared in blocks, spread over tasks; what leaves a task is links that join components, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.exact_dedup import filed
from exselect.llm.tables import parts, stored
from exselect.session import small_side

DEPTH = 8
LEAST_TREES, MOST_TREES, DEEPEST = 16, 32, 4
MISS = 8e-6  # most of the pairs at the threshold that may share no opening
ERRORS = 4.1  # standard errors of the estimate from trees x DEPTH values
BLOCK = 256
WORDS_KEPT = 500_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Forest:
    """Number of sorted orders, length of an opening, and how far an estimate may lie below the threshold."""

    trees: int
    opening: int
    margin: float


@cache
def forest_for(percent: int) -> Forest:
    """The deepest opening that keeps the share of missed pairs at the threshold below MISS with MOST_TREES orders at most,
    and as many orders as that takes; an opening of one value may take more."""
    share = percent / 100
    for opening in range(DEEPEST, 0, -1):
        part = min(1 - 1e-9, max(1e-2, share**opening))
        trees = max(LEAST_TREES, math.ceil(math.log(MISS) / math.log1p(-part)))
        if trees <= MOST_TREES:
            break
    return Forest(trees, opening, ERRORS * math.sqrt(share * (1 - share) / (trees * DEPTH)))


@cache
def _multipliers(trees: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, (2, trees * DEPTH), np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `width` are one shingle, none are none.

    Words are split on ASCII white space after A-Z are lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _stir(out * _MIX[0] + h[k:len(h) - width + 1 + k] * _MIX[1] + _MIX[2])
    return np.unique(out)


def signature(values: np.ndarray, trees: int) -> np.ndarray:
    """Smallest value of each of trees x DEPTH hash functions."""
    multipliers = _multipliers(trees)
    best = np.full(trees * DEPTH, 2**64 - 1, np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start:start + 4096, None] * multipliers[0] + multipliers[1]
        best = np.minimum(best, (part ^ (part >> np.uint64(32))).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


_SIGNED = "doc_id long, row long, n_shingles long, class binary, signature binary"


def signed(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """(doc_id, row, n_shingles, class, signature) per document; row tells rows apart that differ in id or text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch, sizes, classes, signatures = whole.slice(k, 1000), [], [], []
                for text in batch.column(2).to_pylist():
                    values = shingles(text, width)
                    sizes.append(len(values))
                    classes.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    signatures.append(signature(values, trees).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                    names=["doc_id", "row", "n_shingles", "class", "signature"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, _SIGNED)


def _regions(values: np.ndarray, opening: int) -> np.ndarray:
    """Hash of the opening of each order: (rows, trees)."""
    region = np.arange(values.shape[1], dtype=np.uint64)[None, :] * _MIX[2] + _MIX[1]
    for d in range(opening):
        region = _stir(region * _MIX[0] + values[:, :, d])
    return region


def _values(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), trees, DEPTH)


def entries(classes: DataFrame, of: Forest) -> DataFrame:
    """Each class once per tree: (region, rest, id, n): hash of the opening and the values that order the region."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                values = _values(batch.column(2), of.trees)
                rest = values[:, :, of.opening:].astype(">u4").reshape(-1, DEPTH - of.opening)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_regions(values, of.opening).astype(np.int64).ravel()), pa.array([r.tobytes() for r in rest], pa.binary()),
                     pa.array(np.repeat(np.array(batch.column(0)), of.trees)), pa.array(np.repeat(np.array(batch.column(1)), of.trees))],
                    names=["region", "rest", "id", "n"])

    return classes.select("id", "n_shingles", "signature").mapInArrow(run, "region long, rest binary, id long, n long")


def compact(classes: DataFrame, of: Forest) -> DataFrame:
    """(id, short): per id the low byte of each signature value and four bytes of each opening."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                values = _values(batch.column(1), of.trees)
                low = (values & 0xFF).astype(np.uint8).reshape(len(values), -1)
                opening = np.ascontiguousarray(_regions(values, of.opening).astype("<u4")).view(np.uint8)
                short = [row.tobytes() for row in np.concatenate([low, opening], axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["id", "short"])

    return classes.select("id", "signature").mapInArrow(run, "id long, short binary")


def _pairs_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(r) for r in rows], pa.int64()), pa.array([max(r) for r in rows], pa.int64())], names=["a", "b"])


def neighbours(forest: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) next to each other in a region of some order, whose sizes allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if last and last[0] == row[0] and 100 * min(last[2], row[2]) >= percent * max(last[2], row[2]):
                    out.append((last[1], row[1]))
                last = row
            if out:
                yield _pairs_of(out)

    ordered = forest.select("region", "rest", "id", "n").repartition(parts(forest.sparkSession), "region")
    ordered = ordered.sortWithinPartitions("region", "rest", "id").select("region", "id", "n")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns; a run has the rows of two blocks of a region at most."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, group in groupby(rows, key=lambda r: r[:keys]):
        yield list(group)


def unsettled(forest: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(region, x, y, id, component): per pair of blocks of a region, the documents whose signature allows a link to
    another component there. Two documents are looked at in the first order in which they share a region only."""
    spark, of = forest.sparkSession, forest_for(percent)
    named = forest.select("region", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("x != y").select("region", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = stored(named.join(mixed, "region"), "near-mixed")
    rows = rows.join(compact(classes.join(rows.select("id").distinct(), "id", "left_semi"), of), "id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("region", "id", "n", "component", "short", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    size = of.trees * DEPTH
    least = (percent / 100 - of.margin) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            region, x, y = group[0][:3]
            n, component, own = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 7))
            short = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(group), -1)
            low, opening = short[:, :size], np.ascontiguousarray(short[:, size:]).view("<u4")
            tree = int(np.argmax(opening[0] == np.uint32(region & 0xFFFFFFFF)))
            open_to = np.zeros(len(group), bool)
            first, second = np.flatnonzero(own == x), np.flatnonzero(own == y)
            for at, k in enumerate(first):
                j = second if x != y else second[at + 1:]
                j = j[(component[j] != component[k]) & (100 * np.minimum(n[j], n[k]) >= percent * np.maximum(n[j], n[k]))]
                j = j[(low[j] == low[k]).sum(axis=1) >= least]
                j = j[~(opening[j, :tree] == opening[k, :tree]).any(axis=1)]
                if len(j):
                    open_to[k] = True
                    open_to[j] = True
            rows = [group[k] for k in np.flatnonzero(open_to)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (0, 1, 2, 3, 5, 7)], schema=pa.schema([
                    ("region", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("id", pa.int64()), ("component", pa.int64()), ("own", pa.int32())]))

    dealt = rows.repartition(parts(spark), "region", "x", "y").sortWithinPartitions("region", "x", "y", "id")
    return dealt.select("region", "x", "y", "id", "n", "component", "short", "own").mapInArrow(
        run, "region long, x int, y int, id long, component long, own int")


def shingle_sets(needed: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, values) of the classes in `needed`: only texts of documents that stand for one are read into sets."""
    wanted = stored(classes.join(needed.select("id").distinct(), "id").select("id", "row", "class"), "near-wanted")
    texts = docs.select("row", "text").join(small_side(wanted, wanted.count(), 64), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c for s, c in zip(sets, batch.column(2).to_pylist())]
                ids = [i for i, ok in zip(batch.column(0).to_pylist(), same) if ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([s for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))], names=["id", "values"])

    return stored(texts.select("id", "text", "class").mapInArrow(run, "id long, values array<long>").dropDuplicates(["id"]), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("values").alias("of_a")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("values").alias("of_b")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    both = both.withColumn("union", F.size("of_a") + F.size("of_b") - F.col("shared"))
    return both.where(100 * F.col("shared") >= percent * F.col("union")).select("a", "b")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each set on the left with each on the right, from the shingles that both sides have."""
    sides = []
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for sets in (left, right):
        of, values = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        place = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        keep = both[place] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(place[keep], kind="stable")
        sides.append((of[keep][order], place[keep][order]))
    out, step = np.zeros((len(left), len(right)), np.float32), 8192
    for start in range(0, len(both), step):
        tables = []
        for sets, (of, place) in zip((left, right), sides):
            a, b = np.searchsorted(place, [start, start + step])
            table = np.zeros((len(sets), min(step, len(both) - start)), np.float32)
            table[of[a:b], place[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def settled(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within a pair of blocks, from full sets: as many as join what can be joined there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            _, x, y = group[0][:3]
            first = [r for r in group if r[5] == x]
            second = [r for r in group if r[5] == y]
            if not first or not second:
                continue
            sets_of = [[np.array(r[6], np.int64) for r in side] for side in (first, second)]
            n, m = (np.array([len(v) for v in side]) for side in sets_of)
            of_n, of_m = (np.array([r[4] for r in side], np.int64) for side in (first, second))
            shared = _shared(*sets_of)
            good = 100 * shared >= percent * (n[:, None] + m[None, :] - shared)
            component = np.concatenate([of_n, of_m])
            root = {int(c): int(c) for c in component}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out = []
            for i, j in zip(*np.nonzero(good & (of_n[:, None] != of_m[None, :]))):
                p, q = find(int(of_n[i])), find(int(of_m[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((first[i][3], second[j][3]))
            if out:
                yield _pairs_of(out)

    rows = open_rows.join(sets, "id").repartition(parts(sets.sparkSession), "region", "x", "y")
    rows = rows.sortWithinPartitions("region", "x", "y", "id").select("region", "x", "y", "id", "component", "own", "values")
    return rows.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id in a link; alternating large and small stars."""
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "near-links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = stored(small.select("e.u", "e.v").where("u != v").distinct(), "near-links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("component"))


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, keep_row) of (doc_id, row, text); row must tell rows apart that matter.

    Of a component the row with the smallest (id, row) stays, null ids last.
    """
    of = forest_for(percent)
    rows = stored(signed(docs, width, of.trees), "near-signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n_shingles", "signature")).alias("one")
    classes = stored(rows.where("n_shingles > 0").groupBy("class").agg(one).select(
        F.monotonically_increasing_id().alias("id"), "class", "one.no_id", "one.doc_id", "one.row", "one.n_shingles", "one.signature"), "near-classes")
    forest = entries(classes, of)
    pairs = stored(neighbours(forest, percent), "near-pairs")
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), classes, docs, width)
    links = stored(confirmed(pairs, sets, percent), "near-links")
    labels = components(links)
    rest = stored(unsettled(forest, labels, classes, percent), "near-unsettled")
    if not rest.isEmpty():
        links = links.unionByName(settled(rest, shingle_sets(rest, classes, docs, width), percent))
        labels = components(links)
    named = classes.select("id", "class", "no_id", "doc_id", "row").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "row")).alias("least"))
    by_class = stored(named.select("class", "component").join(least, "component").select(
        "class", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keep_row")), "near-components")
    out = rows.drop("signature").join(by_class, "class", "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "row", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(empty, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of `width`-word shingles have 100 x intersection >= percent x union; a
    component is named by its smallest doc_id and the row with that id is kept. Null or empty text and text without
    words has no shingles, links with nothing and is kept. Null ids never name a component that holds another id.
    Repeated rows are members like any other; rows that share the smallest id are all kept. Other columns are not carried.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = grouped(docs.withColumn("row", F.xxhash64("doc_id", "text")), width, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per component, with all their columns. Only the places of dropped rows move."""
    docs = filed(docs)
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    out = grouped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), place.alias("row")), width, percent)
    dropped = stored(out.where("row != keep_row").select(F.col("row").alias("_row")), "near-dropped")
    placed = docs.select(F.struct("*").alias("whole"), place.alias("_row"))
    return placed.join(small_side(dropped, dropped.count(), 16), "_row", "left_anti").select("whole.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
