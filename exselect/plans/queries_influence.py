"""Queries: influence tables, BM25, curvature, projections and splits."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
import zlib

from pyspark.sql import functions as F

from exselect.operators import bm25, curvature, scoring
from exselect.plans.registry import (
    DIGITS, INFLUENCE_SQL, SQL_KEYS, VECTORS_SQL, benchmark_items, documents, query, sql_terms, vectors,
)
from exselect.sources import splits
from exselect.sources.readers import read_table

TOP = 5
BLOCKS = 4
CUT_SQL = f"cut AS (SELECT (max(len(vec)) + {BLOCKS - 1}) // {BLOCKS} AS st FROM tr)"


def _layout(train):
    """Equal blocks over the width that the vectors have."""
    return curvature.even_layout(train.agg(F.max(F.size("vec"))).first()[0] or 0, BLOCKS)


def ranked_sql(source: str, order: str, k: int = TOP) -> str:
    return f"""SELECT test_id, rank, train_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY {SQL_KEYS[order]}, train_id) AS rank FROM {source})
WHERE rank <= {k}"""


def _ranked(df):
    return df.select("test_id", F.col("rank").cast("bigint").alias("rank"), "train_id", "score")


def _register_orders():
    for order in scoring.SORT_TYPES:

        @query(f"dot_top_{order}", f"WITH {INFLUENCE_SQL} {ranked_sql('inf', order)}")
        def run(spark, sf, order=order):
            test, train = vectors(spark, sf)
            return _ranked(scoring.top_influence(test, train, TOP, [order], digits=DIGITS))


_register_orders()


@query("dot_top_sampled_bounds", f"WITH {INFLUENCE_SQL} {ranked_sql('inf', 'most_influential')}")
def dot_top_sampled_bounds(spark, sf):
    test, train = vectors(spark, sf)
    return _ranked(scoring.top_influence(test, train, TOP, ["most_influential"], digits=DIGITS, sample_fraction=0.2))


@query(
    "dot_matrix_summary",
    f"""WITH {INFLUENCE_SQL} SELECT test_id, count(*) AS pairs, min(score) AS lowest, max(score) AS highest,
round(avg(score), 8) AS mean_score FROM inf GROUP BY test_id""",
)
def dot_matrix_summary(spark, sf):
    test, train = vectors(spark, sf)
    return scoring.dot_influence(test, train, digits=DIGITS).groupBy("test_id").agg(
        F.count("*").alias("pairs"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        F.round(F.avg("score"), 8).alias("mean_score"),
    )


@query(
    "explanation_rows_of_label_heads",
    f"""WITH {INFLUENCE_SQL}, heads AS (SELECT min(id) AS test_id FROM v WHERE is_test GROUP BY label)
SELECT inf.* FROM inf SEMI JOIN heads USING (test_id)""",
)
def explanation_rows_of_label_heads(spark, sf):
    test, train = vectors(spark, sf)
    label = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("test_id"), "label")
    heads = test.join(label, "test_id").groupBy("label").agg(F.min("test_id").alias("test_id"))
    return scoring.dot_influence(scoring.explanation_rows(test, heads), train, digits=DIGITS)


@query(
    "cosine_top_most_influential",
    f"""WITH {VECTORS_SQL},
nte AS (SELECT test_id, list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-10)) AS vec FROM te),
ntr AS (SELECT train_id, list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-10)) AS vec FROM tr),
cosine AS (SELECT test_id, train_id, round(-list_dot_product(nte.vec, ntr.vec), 9) AS score FROM nte, ntr)
{ranked_sql('cosine', 'most_influential')}""",
)
def cosine_top_most_influential(spark, sf):
    test, train = vectors(spark, sf)
    return _ranked(scoring.top_influence(test, train, TOP, ["most_influential"], normalize=True, digits=DIGITS))


@query(
    "adam_preconditioned_norms",
    f"""WITH {VECTORS_SQL}, {CUT_SQL},
x AS (SELECT train_id, unnest(range(1, len(vec) + 1)) AS j, unnest(vec) AS g FROM tr),
s AS (SELECT j, avg(g) AS m, avg(g * g) AS v FROM x GROUP BY j),
p AS (SELECT train_id, (j - 1) // st AS b, (0.9 * m + (1 - 0.9) * g) / sqrt(0.999 * v + (1 - 0.999) * g * g + 1e-8) AS u
      FROM x JOIN s USING (j), cut)
SELECT train_id, 'b' || b::VARCHAR AS block, round(sqrt(sum(u * u)), 7) AS norm FROM p GROUP BY train_id, b""",
)
def adam_preconditioned_norms(spark, sf):
    """Moments are the mean and mean square of the train vectors, one row per block."""
    _, train = vectors(spark, sf)
    blocks = curvature.to_blocks(train, "train_id", _layout(train))
    state = blocks.groupBy("block").agg(
        Summarizer.metrics("mean", "normL2", "count").summary(array_to_vector("vec")).alias("s")
    ).select(
        "block", vector_to_array("s.mean").alias("m"),
        F.transform(vector_to_array("s.normL2"), lambda x: x * x / F.col("s.count")).alias("v"),
    )
    moved = scoring.adam_precondition(blocks, state)
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    return moved.select("train_id", "block", F.round(F.sqrt(square), 7).alias("norm"))


DAMPING_SQL = f"""{CUT_SQL},
xb AS (SELECT train_id, vec[st * b + 1 : st * (b + 1)] AS g, b FROM tr, cut, range({BLOCKS}) r(b) WHERE st * b < len(vec)),
lam AS (SELECT b, avg(list_dot_product(g, g) / len(g)) / 10 AS lam FROM xb GROUP BY b)"""


@query(
    "block_damping",
    f"WITH {VECTORS_SQL}, {DAMPING_SQL} SELECT 'b' || b::VARCHAR AS block, round(lam, 10) AS lam FROM lam",
)
def block_damping(spark, sf):
    _, train = vectors(spark, sf)
    return curvature.block_damping(train, _layout(train)).select("block", F.round("lam", 10).alias("lam"))


CURVATURE_SQL = f"""{VECTORS_SQL}, {DAMPING_SQL},
tb AS (SELECT test_id, vec[st * b + 1 : st * (b + 1)] AS t, b FROM te, cut, range({BLOCKS}) r(b) WHERE st * b < len(vec)),
share AS (SELECT test_id, b, train_id, list_dot_product(t, g) / (lam + list_dot_product(g, g)) AS c, g
          FROM tb JOIN xb USING (b) JOIN lam USING (b)),
folded AS (SELECT test_id, b, j, sum(c * x) AS f FROM (
             SELECT test_id, b, c, unnest(range(1, len(g) + 1)) AS j, unnest(g) AS x FROM share) GROUP BY ALL),
h AS (SELECT test_id, b, j, t[j] / lam - f / ((SELECT count(*) FROM tr) * lam) AS h
      FROM folded JOIN tb USING (test_id, b) JOIN lam USING (b)),
hv AS (SELECT test_id, list(h ORDER BY b, j) AS vec FROM h GROUP BY test_id)"""


@query(
    "curvature_vector_sums",
    f"""WITH {CURVATURE_SQL} SELECT test_id, len(vec)::BIGINT AS width, round(list_sum(vec), 6) AS total FROM hv""",
)
def curvature_vector_sums(spark, sf):
    test, train = vectors(spark, sf)
    h = curvature.curvature_vectors(test, train, _layout(train))
    return h.select(
        "test_id", F.size("vec").cast("bigint").alias("width"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 6).alias("total"),
    )


@query(
    "curvature_top_most_helpful",
    f"""WITH {CURVATURE_SQL},
inf AS (SELECT test_id, train_id, round(-list_dot_product(hv.vec, tr.vec), 6) AS score FROM hv, tr)
{ranked_sql('inf', 'most_helpful')}""",
)
def curvature_top_most_helpful(spark, sf):
    test, train = vectors(spark, sf)
    h = curvature.curvature_vectors(test, train, _layout(train))
    return _ranked(scoring.top_influence(h, train, TOP, ["most_helpful"], digits=6))


@query(
    "blocked_round_trip",
    f"WITH {VECTORS_SQL} SELECT train_id, len(vec)::BIGINT AS width, vec[17] AS at17, vec[64] AS at64, round(list_sum(vec), 6) AS total FROM tr",
)
def blocked_round_trip(spark, sf):
    """Flat to blocked and back."""
    _, train = vectors(spark, sf)
    layout = _layout(train)
    flat = curvature.to_flat(curvature.to_blocks(train, "train_id", layout), "train_id", layout)
    return flat.select(
        "train_id", F.size("vec").cast("bigint").alias("width"), F.get("vec", F.lit(16)).alias("at17"),
        F.get("vec", F.lit(63)).alias("at64"), F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 6).alias("total"),
    )


@query(
    "projection_budget",
    """WITH d AS (SELECT p_brand AS block, sum(p_size)::BIGINT AS dim FROM part GROUP BY p_brand),
s AS (SELECT block, dim, least(dim, floor(8192 * dim / sum(dim) OVER ())) AS share FROM d)
SELECT block, dim, (CASE WHEN share <= 512 THEN dim ELSE greatest(512, round_even(share / 512, 0) * 512) END)::BIGINT AS proj_dim
FROM s""",
)
def projection_budget(spark, sf):
    dims = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("block")).agg(F.sum("p_size").alias("dim"))
    return curvature.projection_budget(dims).select("block", "dim", "proj_dim")


def _sign_sql() -> str:
    """The generator's cubic polynomials in SQL: coefficients of each column, then the parity at each row."""
    p, steps = curvature.PRIME, curvature.SIGN_STEPS
    names = [name for name, _, _ in curvature.even_layout(BLOCKS, BLOCKS)]
    bases = ", ".join(f"({i}, {(42 * steps[0] + zlib.crc32(name.encode())) % p})" for i, name in enumerate(names))
    sql = f"""WITH {VECTORS_SQL},
b(block, base) AS (VALUES {bases}),
w AS (SELECT max(len(vec)) // {BLOCKS} AS width FROM tr),
c AS (SELECT block, base, width, unnest(range(width // 2)) AS col FROM b, w WHERE block % 2 = 0),
k0 AS (SELECT block, width, col, k, (col * 4 + k + base) % {p} AS x FROM c, range(4) r(k)),
"""
    for i, step in enumerate(steps):
        sql += f"k{i + 1} AS (SELECT block, width, col, k, (x * x % {p} + x * {step} % {p} + {step}) % {p} AS x FROM k{i}),\n"
    return sql + f"""f AS (SELECT block, width, col, max(x) FILTER (k = 0) AS c0, max(x) FILTER (k = 1) AS c1, max(x) FILTER (k = 2) AS c2,
  max(x) FILTER (k = 3) AS c3 FROM k{len(steps)} GROUP BY ALL),
s AS (SELECT block, width, col, r, 1 - 2 * ((((c0 * (r + 1) + c1) % {p} * (r + 1) + c2) % {p} * (r + 1) + c3) % {p} % 2) AS sign
  FROM (SELECT *, unnest(range(width)) AS r FROM f)),
e AS (SELECT train_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS spot FROM tr),
o AS (SELECT train_id, spot // width AS block, spot % width AS r, v, width FROM e, w),
placed AS (
  SELECT train_id, s.block, s.col, sum(v * sign) / sqrt(any_value(s.width) // 2) AS value FROM o JOIN s ON o.block = s.block AND o.r = s.r GROUP BY ALL
  UNION ALL SELECT train_id, block, r, v FROM o WHERE block % 2 = 1)
SELECT train_id, (row_number() OVER (PARTITION BY train_id ORDER BY block, col) - 1)::INTEGER AS place, round(value, 8) AS value FROM placed"""


@query("sign_projection", _sign_sql())
def sign_projection(spark, sf):
    """Two blocks are projected, two keep their width; one row per value."""
    _, train = vectors(spark, sf)
    layout = _layout(train)
    dims = {name: width if i % 2 else width // 2 for i, (name, _, width) in enumerate(layout)}
    projected = curvature.sign_projection(train, "train_id", layout, dims)
    return projected.select("train_id", F.posexplode("vec").alias("place", "value")).withColumn("value", F.round("value", 8))


@query(
    "low_precision_error",
    f"""WITH {VECTORS_SQL} SELECT train_id, round(sum(abs(x - (x / 3)::FLOAT::DOUBLE * 3)), 10) AS error
FROM (SELECT train_id, unnest(vec) AS x FROM tr) GROUP BY train_id""",
)
def low_precision_error(spark, sf):
    """What 32-bit storage loses on a third of each vector."""
    _, train = vectors(spark, sf)
    third = train.select("train_id", F.transform("vec", lambda x: x / 3).alias("vec"))
    kept = curvature.low_precision(third, "train_id").withColumnRenamed("vec", "low")
    loss = F.aggregate(
        F.zip_with("vec", "low", lambda x, y: F.abs(x - y.cast("double") * 3)), F.lit(0.0), lambda t, x: t + x
    )
    return train.join(kept, "train_id").select("train_id", F.round(loss, 10).alias("error"))


# --- BM25 ------------------------------------------------------------------------------------------

BM25_SQL = f"""
d AS (SELECT doc_id AS train_id, {sql_terms('text')} AS terms FROM documents),
q AS (SELECT item_id AS test_id, {sql_terms('text')} AS terms FROM benchmark),
dl AS (SELECT train_id, len(terms) AS dl FROM d),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT train_id, term, count(*) AS tf FROM (SELECT train_id, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM df, n),
qt AS (SELECT DISTINCT test_id, term FROM (SELECT test_id, unnest(terms) AS term FROM q))"""


def bm25_sql(extra: float) -> str:
    return f"""{BM25_SQL},
hit AS (SELECT test_id, train_id, sum(idf * tf * 2.5 / (tf + {extra} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s
        FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (train_id), n GROUP BY ALL),
inf AS (SELECT q.test_id, d.train_id, round(coalesce(s, 0), 9) AS score
        FROM q CROSS JOIN d LEFT JOIN hit ON hit.test_id = q.test_id AND hit.train_id = d.train_id)"""


def _register_bm25():
    for order, variant, extra in (
        ("most_influential", "reference", 1.0), ("least_influential", "reference", 1.0),
        ("most_influential", "standard", 0.0),
    ):

        @query(f"bm25_{variant}_top_{order}", f"WITH {bm25_sql(extra)} {ranked_sql('inf', order)}")
        def run(spark, sf, order=order, variant=variant):
            return _ranked(bm25.bm25_top(
                benchmark_items(spark, sf), documents(spark, sf), TOP, [order], variant=variant, digits=DIGITS
            ))


_register_bm25()


@query(
    "bm25_sparse_summary",
    f"""WITH {bm25_sql(1.0)} SELECT test_id, count(*) AS documents, max(score) AS best, round(sum(score), 6) AS total
FROM inf WHERE score <> 0 GROUP BY test_id""",
)
def bm25_sparse_summary(spark, sf):
    scores = bm25.bm25(benchmark_items(spark, sf), documents(spark, sf))
    return scores.select("test_id", F.round("score", 9).alias("score")).where("score <> 0").groupBy("test_id").agg(
        F.count("*").alias("documents"), F.max("score").alias("best"), F.round(F.sum("score"), 6).alias("total")
    )


@query(
    "bm25_join_densified_summary",
    f"""WITH {bm25_sql(1.0)} SELECT test_id, count(*) AS documents, sum((score = 0)::BIGINT)::BIGINT AS zeros,
round(sum(score), 6) AS total FROM inf GROUP BY test_id""",
)
def bm25_join_densified_summary(spark, sf):
    """The term join and the added zero pairs, summed per query."""
    queries, corpus = benchmark_items(spark, sf), documents(spark, sf)
    scores = bm25.densify(bm25.bm25_join(queries, corpus), queries, corpus)
    return scores.select("test_id", F.round("score", 9).alias("score")).groupBy("test_id").agg(
        F.count("*").alias("documents"), F.sum((F.col("score") == 0).cast("bigint")).alias("zeros"),
        F.round(F.sum("score"), 6).alias("total"),
    )


@query(
    "term_statistics",
    f"WITH {BM25_SQL} SELECT term, df::BIGINT AS df, round(idf, 9) AS idf FROM idf",
)
def term_statistics(spark, sf):
    docs = documents(spark, sf)
    total = read_table(spark, sf, "documents").count()
    return bm25.with_idf(bm25.document_frequency(docs), total).select("term", "df", F.round("idf", 9).alias("idf"))


@query(
    "term_frequency_by_document",
    f"""WITH {BM25_SQL} SELECT train_id, count(*) AS distinct_terms, sum(tf)::BIGINT AS length, max(tf) AS most
FROM tf GROUP BY train_id""",
)
def term_frequency_by_document(spark, sf):
    tf = bm25.term_frequency(documents(spark, sf), "train_id")
    return tf.groupBy("train_id").agg(
        F.count("*").alias("distinct_terms"), F.sum("tf").alias("length"), F.max("tf").alias("most")
    )


# --- splits ----------------------------------------------------------------------------------------

@query(
    "take_split_disjoint",
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS i,
count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN i < least(100, n) THEN 'test' ELSE 'train' END AS split
FROM o WHERE i < least(100, n) + floor(n * 0.25)""",
)
def take_split_disjoint(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    return splits.take_split(docs, "doc_id", {"test": 100, "train": 0.25}).select("doc_id", "split")


@query(
    "take_split_overlapping",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS i,
row_number() OVER (ORDER BY md5('84:' || doc_id::VARCHAR), doc_id) AS j, count(*) OVER () AS n FROM documents)
SELECT doc_id, 'train' AS split FROM a WHERE i <= floor(n * 0.1)
UNION ALL SELECT doc_id, 'test' FROM a WHERE j <= least(100, n)""",
)
def take_split_overlapping(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id")
    return splits.take_split(docs, "doc_id", {"train": 0.1, "test": 100}, disjoint=False).select("doc_id", "split")


@query(
    "row_numbers",
    "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS idx FROM events",
)
def row_numbers(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "value")
    return splits.with_index(events, "value", "event_id").select("event_id", "idx")


@query(
    "split_summary",
    f"""WITH {VECTORS_SQL} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS n,
round(count(*) / (SELECT count(*) FROM v), 9) AS share FROM v GROUP BY is_test""",
)
def split_summary(spark, sf):
    rows = read_table(spark, sf, "embeddings").select("vec_id")
    return splits.split_summary(splits.hash_split(rows, "vec_id", 0.2), rows.count()).withColumn(
        "share", F.round("share", 9)
    )
