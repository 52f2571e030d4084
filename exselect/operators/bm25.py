"""BM25 influence of a corpus on queries.

The corpus grows, the queries are few. Only corpus terms that occur in a query matter, so the query
postings (with idf) are measured, shared with the tasks, and the corpus is scored in one scan without
a shuffle: a term held by a third of all documents costs arithmetic, not a hot partition. Queries
beyond the broadcast limit take one scan per block that fits; `bm25_join`, an equi-join on the salted
term, has no limit at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exselect.operators.scoring import (
    CANDIDATE_BYTES, CANDIDATE_SCHEMA, SCORE_SCHEMA, SCORES_PER_STEP, TopK, rank_candidates, row_slices,
)
from exselect.session import broadcast_limit, cut_lineage, small_side, union_all

POSTING_BYTES = 64  # test id, position and an average term, generously
SALTS = 16
DOCS_PER_STEP = 512
VARIANTS = {"reference": 1.0, "standard": 0.0}  # constant added to the denominator


def term_frequency(docs: DataFrame, id_col: str) -> DataFrame:
    """(doc, term, tf) from a terms array; counts combine before the shuffle."""
    return docs.select(id_col, F.explode("terms").alias("term")).groupBy(id_col, "term").agg(
        F.count("*").alias("tf")
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): documents holding each term, counted without first building tf."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df")
    )


def with_idf(df: DataFrame, total_docs: int) -> DataFrame:
    """ln((N - df + 0.5) / (df + 0.5) + 1)."""
    n = F.lit(float(total_docs))
    return df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def corpus_stats(corpus: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length in terms."""
    row = corpus.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()
    return row["n"], row["avgdl"] or 1.0


def query_postings(queries: DataFrame, corpus: DataFrame, total_docs: int) -> DataFrame:
    """(test_id, term, idf) for every distinct query term the corpus knows."""
    pairs = queries.select("test_id", F.explode(F.array_distinct("terms")).alias("term"))
    vocabulary = pairs.select("term").distinct()
    rows = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    known = corpus.select(F.explode(F.array_distinct("terms")).alias("term")).join(
        small_side(vocabulary, rows, POSTING_BYTES), "term", "left_semi"
    )
    idf = with_idf(known.groupBy("term").agg(F.count("*").alias("df")), total_docs)
    return pairs.join(idf.select("term", "idf"), "term").select("test_id", "term", "idf")


class _QueryIndex:
    """Distinct query terms grouped by term, as flat arrays for vectorised scoring."""

    def __init__(self, test_ids: np.ndarray, pairs: pa.Table):
        self.test_ids = test_ids
        coded = pairs["term"].combine_chunks().dictionary_encode()
        self.terms = coded.dictionary
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.query = np.searchsorted(test_ids, pairs["test_id"].to_numpy())[order]
        self.count = np.bincount(code, minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.idf = np.zeros(len(self.terms))

    def occurrences(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term code, tf) of the query terms in a batch of documents."""
        size = len(self.terms)
        if not size:
            return (np.empty(0, np.int64),) * 3
        lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.terms), -1).to_numpy()
        known = np.flatnonzero(code >= 0)
        doc = np.repeat(np.arange(len(terms), dtype=np.int64), lengths)[known]
        pair, tf = np.unique(doc * size + code[known], return_counts=True)
        return *np.divmod(pair, size), tf

    def scores(self, terms: pa.ListArray, norm: np.ndarray, k1: float) -> np.ndarray:
        """Documents x queries; `norm` is the length part of each document's denominator."""
        shape = (len(terms), len(self.test_ids))
        doc, code, tf = self.occurrences(terms)
        weight = self.idf[code] * tf * (k1 + 1.0) / (tf + norm[doc])
        fan = self.count[code]
        ends = np.cumsum(fan)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - fan, fan)
        query = self.query[np.repeat(self.start[code], fan) + within]
        cell = np.repeat(doc, fan) * shape[1] + query
        return np.bincount(
            cell, weights=np.repeat(weight, fan), minlength=shape[0] * shape[1]
        ).reshape(shape)


def _corpus_counts(corpus: DataFrame, shared, step: int) -> tuple[int, float, pa.Table]:
    """(documents, mean length, df by term code) in one scan: each task adds up its own counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df = np.zeros(len(index.terms), np.int64)
        docs = length = 0
        for part in row_slices(batches, step):
            df += np.bincount(index.occurrences(part["terms"])[1], minlength=len(df))
            docs += part.num_rows
            length += len(part["terms"].flatten())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "code": np.concatenate([[-2, -1], seen]), "n": np.concatenate([[length, docs], df[seen]]),
        })

    counts = corpus.select("terms").mapInArrow(count, "code bigint, n bigint")
    table = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    special = dict(zip(table["code"].to_pylist(), table["n"].to_pylist()))
    docs = special.get(-1, 0)
    return docs, (special.get(-2, 0) / docs if docs else 1.0) or 1.0, table.filter(pc.field("code") >= 0)


def _scan(queries, corpus, k1, b, variant, consume, schema, state_bytes=0):
    """Shared-postings scans: one, or one per block of queries that fits the broadcast limit.

    `state_bytes` is what `consume` keeps per query. None if even a single query does not fit.
    """
    tests, terms, longest = queries.agg(
        F.count("*"), F.sum(F.size("terms")), F.max(F.size("terms"))
    ).first()
    limit = broadcast_limit(corpus.sparkSession)
    if not tests or (longest or 0) * POSTING_BYTES > limit:
        return None
    blocks = -(-(tests * (8 + state_bytes) + (terms or 0) * POSTING_BYTES) // limit)
    if blocks <= 1:
        return _scan_block(queries, corpus, k1, b, variant, consume, schema)[0]
    done = []
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("test_id"), F.lit(blocks)) == block)
        found, shared = _scan_block(part, corpus, k1, b, variant, consume, schema)
        done.append(cut_lineage(found))
        shared.destroy()
    return union_all(done)


def _scan_block(queries, corpus, k1, b, variant, consume, schema):
    spark = corpus.sparkSession
    pairs = queries.select("test_id", F.explode(F.array_distinct("terms")).alias("term"))
    ids = np.sort(queries.select("test_id").toArrow()["test_id"].to_numpy())
    index = _QueryIndex(ids, pairs.toArrow())
    step = min(DOCS_PER_STEP, max(1, SCORES_PER_STEP // max(1, len(ids))))
    counting = spark.sparkContext.broadcast(index)
    total, avgdl, known = _corpus_counts(corpus, counting, step)
    counting.destroy()
    df = known["n"].to_numpy()
    index.idf[known["code"].to_numpy()] = np.log((total - df + 0.5) / (df + 0.5) + 1.0)
    shared = spark.sparkContext.broadcast(index)
    extra = VARIANTS[variant]

    def scored(batches: Iterator[pa.RecordBatch]):
        for part in row_slices(batches, step):
            length = pc.list_value_length(part["terms"]).to_numpy(zero_copy_only=False)
            norm = extra + k1 * (1.0 - b + b * length / avgdl)
            yield part["train_id"].to_numpy(), shared.value.scores(part["terms"], norm, k1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from consume(shared.value.test_ids, scored(batches))

    return corpus.select("train_id", "terms").mapInArrow(scan, schema), shared


def bm25_join(
    queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, variant: str = "reference"
) -> DataFrame:
    """Non-zero scores by an equi-join on the term, for queries of any size.

    Query postings within the broadcast limit go to the corpus terms, which are dealt out once, by document: counts,
    join and sums stay there. Beyond the limit the term is salted by document: a term of a third of the corpus is spread
    over SALTS tasks, at the price of SALTS copies of the query postings, which are the smaller side.
    """
    total, avgdl = corpus_stats(corpus)
    rows = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    postings = cut_lineage(query_postings(queries, corpus, total))
    small = rows * POSTING_BYTES <= broadcast_limit(corpus.sparkSession)
    terms = corpus.select("train_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(
        small_side(postings.select("term").distinct(), rows, POSTING_BYTES), "term", "left_semi")
    counts = (terms.repartition("train_id") if small else terms).groupBy("train_id", "dl", "term").agg(F.count("*").alias("tf"))
    norm = VARIANTS[variant] + k1 * (1.0 - b + b * F.col("dl") / avgdl)
    weight = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + norm)
    if small:
        joined = counts.join(F.broadcast(postings), "term")
    else:
        counts = counts.withColumn("salt", F.pmod(F.xxhash64("train_id"), F.lit(SALTS)).cast("int"))
        salted = postings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = counts.join(salted, ["term", "salt"])
    return joined.groupBy("test_id", "train_id").agg(F.sum(weight).alias("score"))


def densify(scores: DataFrame, tests: DataFrame, train: DataFrame) -> DataFrame:
    """Add the zero pairs of a stored sparse table, which "least influential" needs.

    Both sides are id columns only. The tests are spread over the train ids as one measured array, block by block; the
    scores of a train id meet it as one array, so that pairs are made after the join and none is shuffled. Null tests have no pairs.
    """
    rows = tests.count()
    blocks = max(1, -(-rows * 8 // broadcast_limit(scores.sparkSession)))
    block = F.pmod(F.xxhash64("test_id"), F.lit(blocks)).alias("block")
    copies = tests.groupBy("test_id").agg(F.count("*").alias("copies"))
    lists = copies.select("test_id", block).groupBy("block").agg(F.collect_list("test_id").alias("tests"))
    keys = ["train_id"] if blocks == 1 else ["train_id", "block"]
    known = scores.join(small_side(copies.select("test_id"), rows, 16), "test_id", "left_semi")
    pair = F.struct("test_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    found = known.select("train_id", block, pair.alias("pair")).groupBy(*keys).agg(F.collect_list("pair").alias("found"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    spread = train.select("train_id", F.explode(every).alias("block"))
    both = spread.join(found, keys, "left").join(small_side(lists, rows, 8), "block")
    found = F.coalesce("found", F.expr("filter(array(named_struct('test_id', try_element_at(tests, 1), 'score', 0.0D)), x -> false)"))
    zeros = F.transform(F.array_except("tests", found["test_id"]), lambda t: F.struct(t.alias("test_id"), F.lit(0.0).alias("score")))
    pairs = both.select("train_id", F.explode(F.concat(found, zeros)).alias("pair")).select("pair.test_id", "train_id", "pair.score")
    repeated = cut_lineage(copies.where("copies > 1 AND test_id IS NOT NULL"))
    if not repeated.isEmpty():  # every row of a repeated id has its own pairs
        more = repeated.select(F.col("test_id").alias("_id"), F.expr("sequence(1L, copies)").alias("_each"))
        pairs = pairs.join(small_side(more, rows, 32), F.col("test_id") == F.col("_id"), "left")
        pairs = pairs.withColumn("_one", F.explode(F.coalesce("_each", F.array(F.lit(1).cast("bigint")))))
    return pairs.select("test_id", "train_id", "score")


def bm25(
    queries: DataFrame,
    corpus: DataFrame,
    k1: float = 1.5,
    b: float = 0.75,
    variant: str = "reference",
    dense: bool = False,
) -> DataFrame:
    """(test_id, train_id, score); sum over distinct query terms, query counts ignored."""

    def emit(ids: np.ndarray, scored) -> Iterator[pa.RecordBatch]:
        for train_ids, scores in scored:
            if dense:
                doc, query = (axis.ravel() for axis in np.indices(scores.shape))
            else:
                doc, query = np.nonzero(scores)
            yield pa.RecordBatch.from_pydict({
                "test_id": ids[query], "train_id": train_ids[doc], "score": scores[doc, query],
            })

    scores = _scan(queries, corpus, k1, b, variant, emit, SCORE_SCHEMA)
    if scores is None:
        scores = bm25_join(queries, corpus, k1, b, variant)
        scores = densify(scores, queries, corpus) if dense else scores
    return scores


def _rounded(score: Column, digits: int | None) -> Column:
    """Half to even on the scaled value, as numpy rounds in the scan."""
    if digits is None:
        return score
    scale = F.lit(10.0 ** abs(digits))
    return F.rint(score * scale) / scale if digits >= 0 else F.rint(score / scale) * scale


def bm25_top(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    sort_types: Iterable[str] = ("most_influential", "least_influential"),
    k1: float = 1.5,
    b: float = 0.75,
    variant: str = "reference",
    digits: int | None = None,
) -> DataFrame:
    """Top-k per query fused into the corpus scan; absent pairs take part with score 0."""
    names = tuple(sort_types)

    def best(ids: np.ndarray, scored) -> Iterator[pa.RecordBatch]:
        kept = TopK(ids, k, names)
        for train_ids, scores in scored:
            kept.add(train_ids, scores if digits is None else np.round(scores, digits))
        yield from kept.batches()

    found = _scan(queries, corpus, k1, b, variant, best, CANDIDATE_SCHEMA, k * len(names) * CANDIDATE_BYTES)
    if found is not None:
        return rank_candidates(found, k)
    scores = densify(bm25_join(queries, corpus, k1, b, variant), queries, corpus)
    score = _rounded(F.col("score"), digits)
    key = {"most_helpful": score, "most_harmful": -score, "most_influential": -F.abs(score), "least_influential": F.abs(score)}
    both = F.explode(F.array(*[
        F.struct(F.lit(n).alias("sort_type"), key[n].alias("sort_key")) for n in names
    ]))
    return rank_candidates(
        scores.select(both.alias("o"), "test_id", "train_id", score.alias("score")).select(
            "o.sort_type", "test_id", "train_id", "score", "o.sort_key"
        ),
        k,
    )
