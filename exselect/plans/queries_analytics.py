"""Queries: validation metrics, completeness checks, statistics and reports."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from exselect.functions.labels import decibel, extract_k
from exselect.operators import analytics, checks, greedy, ranking, scoring, stats, validation
from exselect.plans.queries_influence import ranked_sql
from exselect.plans.registry import (
    DIGITS, ESTIMATORS, INFLUENCE_SQL, SCORING_SQL, VALIDATION_SQL, VECTORS_SQL, query, scoring_records, validation_records, vectors,
)
from exselect.session import cut_lineage, union_all
from exselect.sources.readers import read_table
from exselect.sources.results import pending, upsert_values
from exselect.sources.splits import with_index

DATASET = "train_dataset, train_split, test_dataset, test_split"
# Descriptions shared by the SQL twins: k, text without k, fixed text, order, seed.
DERIVED_SQL = SCORING_SQL + """,
d0 AS (SELECT *, CASE WHEN explanation_type LIKE '%sanity%' THEN 1 ELSE regexp_extract(explanation_type, '^(?:Top-)?([0-9]+)', 1)::INTEGER END AS k FROM scoring),
d1 AS (SELECT * EXCLUDE (explanation_type), explanation_type AS raw, regexp_replace(explanation_type, '\\b' || k::VARCHAR || '\\b', 'X') AS explanation_type_no_k,
 CASE WHEN explanation_type LIKE 'Top-%' AND explanation_type LIKE '%facility%' THEN explanation_type[5:]
 WHEN explanation_type LIKE '%AIDE%' THEN explanation_type[1:-2] || ' most influential (scores with largest absolute value).' ELSE explanation_type END AS explanation_type FROM d0),
d AS (SELECT *, CASE WHEN explanation_type LIKE '%largest absolute%' THEN 'scores with largest absolute value' WHEN explanation_type LIKE '%positive%' THEN 'most positive scores'
 WHEN explanation_type LIKE '%negative%' THEN 'most negative scores' WHEN explanation_type LIKE '%zero%' THEN 'scores closest to zero' ELSE '-' END AS sort_type,
 coalesce(TRY_CAST(regexp_extract(explanation_type, 'seed ([0-9]+)', 1) AS INTEGER), -1) AS seed, 1 / (pred_gain + 1e-20) AS nmse FROM d1)"""


def derived(spark, sf):
    return analytics.with_derived_columns(scoring_records(spark, sf))


# --- token distributions -----------------------------------------------------------------------------

TOKENS_SQL = """
mean AS (SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(x) AS m FROM (
  SELECT unnest(range(1, len(vec) + 1)) AS j, unnest(vec) AS x FROM tr) GROUP BY j)),
mixed AS (SELECT test_id, vec, list_transform(range(1, len(vec) + 1), lambda i: (te.vec[i] + mean.m[i]) / 2) AS after, (len(m) + 3) // 4 AS st FROM te, mean),
sl AS (SELECT test_id AS doc_id, pos, vec[st * pos + 1 : st * (pos + 1)] AS b, after[st * pos + 1 : st * (pos + 1)] AS a
  FROM mixed, range(4) r(pos) WHERE st * pos < len(vec)),
ex AS (SELECT doc_id, pos, list_transform(b, lambda x: exp(x)) AS b, list_transform(a, lambda x: exp(x)) AS a FROM sl),
tp AS (SELECT doc_id, pos, list_transform(b, lambda x: x / list_sum(b)) AS pb, list_transform(a, lambda x: x / list_sum(a)) AS pa FROM ex),
pm AS (SELECT *, list_transform(range(1, len(pb) + 1), lambda i: (pb[i] + pa[i]) / 2) AS pm FROM tp)"""


def token_probs(spark, sf):
    """Distributions of each test vector's four slices, before and after mixing with the train mean."""
    test, train = vectors(spark, sf)
    centre = train.select(Summarizer.mean(array_to_vector("vec")).alias("m")).first()["m"].toArray()
    mean = F.array(*[F.lit(float(x)) for x in centre])
    return _sliced(test.withColumn("after", F.zip_with("vec", mean, lambda x, m: (x + m) / 2)), len(centre))


def selection_token_probs(spark, sf, k=5):
    """The same with the mean of the k most influential train vectors of each test vector."""
    test, train = vectors(spark, sf)
    top = scoring.top_influence(test, train, k, ["most_influential"], digits=DIGITS)
    picked = greedy.ground_sets(top, train).groupBy("test_id").agg(Summarizer.mean(array_to_vector("vec")).alias("m"))
    mixed = test.join(picked.select("test_id", vector_to_array("m").alias("m")), "test_id")
    width = train.agg(F.max(F.size("vec"))).first()[0] or 4
    return _sliced(mixed.withColumn("after", F.zip_with("vec", "m", lambda x, m: (x + m) / 2)), width)


def _sliced(mixed, width):
    step = -(-width // 4)
    pos = F.explode(F.sequence(F.lit(0), F.lit(-(-width // step) - 1)))
    parts = mixed.select("test_id", "vec", "after", pos.alias("pos"))
    cut = parts.select(
        F.col("test_id").alias("doc_id"), "pos", F.slice("vec", F.col("pos") * step + 1, F.lit(step)).alias("b"),
        F.slice("after", F.col("pos") * step + 1, F.lit(step)).alias("a"),
    )
    return cut.select(
        "doc_id", "pos", validation.softmax("b").alias("p_before"), validation.softmax("a").alias("p_after")
    )


def _kl(p: str, q: str) -> str:
    return f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: {p}[i] * (ln({p}[i]) - ln({q}[i] + 1e-12))))"


@query(
    "divergences_as_published",
    f"""WITH {VECTORS_SQL}, {TOKENS_SQL} SELECT doc_id, round(avg(0.5 * {_kl('pm', 'pb')} + 0.5 * {_kl('pm', 'pa')}), 9) AS jsd,
round(avg({_kl('pb', 'pa')}), 9) AS kld FROM pm GROUP BY doc_id""",
)
def divergences_as_published(spark, sf):
    return validation.divergences(token_probs(spark, sf)).select(
        "doc_id", F.round("jsd", 9).alias("jsd"), F.round("kld", 9).alias("kld")
    )


SELECTION_TOKENS_SQL = f"""
sel AS ({ranked_sql('inf', 'most_influential', 5)}),
own AS (SELECT test_id, list(m ORDER BY j) AS m FROM (SELECT test_id, j, avg(x) AS m FROM (
  SELECT test_id, unnest(range(1, len(vec) + 1)) AS j, unnest(vec) AS x FROM sel JOIN tr USING (train_id)) GROUP BY 1, 2) GROUP BY 1),
mixed AS""" + TOKENS_SQL.split("mixed AS", 1)[1].replace("mean.m[i]", "own.m[i]").replace("FROM te, mean)", "FROM te JOIN own USING (test_id))")


@query(
    "masked_metrics_of_selections",
    f"""WITH {INFLUENCE_SQL}, {SELECTION_TOKENS_SQL},
kept AS (SELECT * FROM pm WHERE list_max(pb) < 0.5)
SELECT t.doc_id, jsd, kld, log_p_before, log_p_after, delta_log_p FROM (SELECT DISTINCT doc_id FROM pm) t LEFT JOIN (
  SELECT doc_id, round(avg(0.5 * {_kl('pm', 'pb')} + 0.5 * {_kl('pm', 'pa')}), 9) AS jsd, round(avg({_kl('pb', 'pa')}), 9) AS kld,
    round(sum(ln(list_max(pb))), 8) AS log_p_before, round(sum(ln(list_max(pa))), 8) AS log_p_after, round(sum(ln(list_max(pa))) - sum(ln(list_max(pb))), 8) AS delta_log_p
  FROM kept GROUP BY doc_id) USING (doc_id)""",
)
def masked_metrics_of_selections(spark, sf):
    """Before and after mixing with the own selection, over the tokens that are not near certain."""
    tokens = cut_lineage(selection_token_probs(spark, sf).withColumn("unmasked", F.array_max("p_before") < 0.5))
    apart = validation.divergences(tokens, mask="unmasked").select("doc_id", F.round("jsd", 9).alias("jsd"), F.round("kld", 9).alias("kld"))
    logs = tokens.select("doc_id", "unmasked", F.log(F.array_max("p_before")).alias("log_p_before"), F.log(F.array_max("p_after")).alias("log_p_after"))
    change = validation.delta_log_p(logs, mask="unmasked")
    names = ("log_p_before", "log_p_after", "delta_log_p")
    return apart.join(change.select("doc_id", *[F.round(c, 8).alias(c) for c in names]), "doc_id")


@query(
    "jsd_textbook",
    f"""WITH {VECTORS_SQL}, {TOKENS_SQL} SELECT doc_id, round(avg(0.5 * {_kl('pb', 'pm')} + 0.5 * {_kl('pa', 'pm')}), 9) AS jsd FROM pm GROUP BY doc_id""",
)
def jsd_textbook(spark, sf):
    return validation.jsd(token_probs(spark, sf), "standard").select("doc_id", F.round("jsd", 9).alias("jsd"))


@query(
    "log_probability_change",
    f"""WITH {VECTORS_SQL}, {TOKENS_SQL} SELECT doc_id, round(sum(ln(list_max(pb))), 8) AS log_p_before, round(sum(ln(list_max(pa))), 8) AS log_p_after,
round(sum(ln(list_max(pa))) - sum(ln(list_max(pb))), 8) AS delta_log_p FROM tp GROUP BY doc_id""",
)
def log_probability_change(spark, sf):
    tokens = token_probs(spark, sf).select(
        "doc_id", F.log(F.array_max("p_before")).alias("log_p_before"), F.log(F.array_max("p_after")).alias("log_p_after")
    )
    out = validation.delta_log_p(tokens)
    return out.select("doc_id", *[F.round(c, 8).alias(c) for c in ("log_p_before", "log_p_after", "delta_log_p")])


# --- selection against random ------------------------------------------------------------------------------

PAIRS_SQL = VALIDATION_SQL + f""",
vk AS (SELECT *, CASE WHEN explanation_type LIKE '%sanity%' THEN 1 ELSE regexp_extract(explanation_type, '^(?:Top-)?([0-9]+)', 1)::INTEGER END AS k FROM validation),
sel AS (SELECT * FROM vk WHERE explanation_type NOT LIKE '%random examples with seed%'),
rnd AS (SELECT * FROM vk WHERE explanation_type LIKE '%random examples with seed%'),
pairs AS (SELECT s.document_idx, s.model, s.estimator, s.k, s.explanation_type, s.delta_log_p AS d1, r.delta_log_p AS d0, s.jsd AS j1, r.jsd AS j0, s.kld AS k1, r.kld AS k0
  FROM sel s JOIN rnd r ON s.document_idx = r.document_idx AND s.model = r.model AND s.estimator = r.estimator AND s.k = r.k),
vs AS (SELECT *, d1 - d0 AS score_log_p, j1 / j0 AS score_jsd, k1 - k0 AS score_kld FROM pairs)"""


def pairs(spark, sf):
    records = validation_records(spark, sf)
    return validation.validation_scores(analytics.pair_with_random(records.withColumn("k", extract_k("explanation_type"))))


@query(
    "selection_against_random",
    f"""WITH {PAIRS_SQL} SELECT model, estimator, k, count(*) AS n, round(avg(score_log_p), 8) AS log_p, round(avg(score_jsd), 8) AS jsd,
round(avg(score_kld), 8) AS kld FROM vs GROUP BY ALL""",
)
def selection_against_random(spark, sf):
    return pairs(spark, sf).groupBy("model", "estimator", "k").agg(
        F.count("*").alias("n"), F.round(F.avg("validation_score_log_p"), 8).alias("log_p"),
        F.round(F.avg("validation_score_jsd"), 8).alias("jsd"), F.round(F.avg("validation_score_kld"), 8).alias("kld"),
    )


ATTACHED_SQL = PAIRS_SQL + ", " + DERIVED_SQL + """,
rr AS (SELECT vs.*, d.linear_coder, d.pred_gain, d.mse FROM vs LEFT JOIN d ON vs.document_idx = d.document_idx AND vs.model = d.model
  AND vs.estimator = d.estimator AND vs.k = d.k AND vs.explanation_type = d.raw)"""


def attached(spark, sf):
    scoring = scoring_records(spark, sf).withColumn("k", extract_k("explanation_type"))
    return analytics.attach_scores(pairs(spark, sf), scoring)


@query(
    "pairs_with_scores",
    f"""WITH {ATTACHED_SQL} SELECT estimator, linear_coder, count(*) AS n, round(avg(pred_gain), 8) AS pred_gain, round(avg(score_log_p), 8) AS log_p
FROM rr GROUP BY ALL""",
)
def pairs_with_scores(spark, sf):
    return attached(spark, sf).groupBy("estimator", "linear_coder").agg(
        F.count("*").alias("n"), F.round(F.avg("pred_gain"), 8).alias("pred_gain"),
        F.round(F.avg("validation_score_log_p"), 8).alias("log_p"),
    )


SANITY_SQL = PAIRS_SQL + ", s AS (SELECT * FROM vs WHERE explanation_type LIKE '%sanity%')"


def sanity(spark, sf):
    return checks.both_present(
        pairs(spark, sf).where(F.col("explanation_type_selection").contains("sanity")),
        ["delta_log_p_selection", "delta_log_p_random"],
    )


@query(
    "sanity_paired_t",
    f"""WITH {SANITY_SQL} SELECT count(*) AS n, round(avg(d1 - d0) / (stddev_samp(d1 - d0) / sqrt(count(*))), 7) AS t FROM s""",
)
def sanity_paired_t(spark, sf):
    return stats.paired_t(sanity(spark, sf), "delta_log_p_selection", "delta_log_p_random").select(
        "n", F.round("t", 7).alias("t")
    )


@query(
    "sanity_signed_rank",
    f"""WITH {SANITY_SQL}, x AS (SELECT d1 - d0 AS d FROM s WHERE d1 <> d0), a AS (SELECT abs(d) AS a, count(*) AS n, sum((d > 0)::BIGINT) AS p FROM x GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY a) - n + (n + 1) / 2 AS rank FROM a), t AS (SELECT sum(n)::BIGINT AS n, sum(rank * p)::DOUBLE AS w_plus, sum(n * n * n - n)::DOUBLE AS ties FROM r)
SELECT n, w_plus, round((w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 8) AS z FROM t""",
)
def sanity_signed_rank(spark, sf):
    return stats.wilcoxon(sanity(spark, sf), "delta_log_p_selection", "delta_log_p_random").select(
        "n", "w_plus", F.round("z", 8).alias("z")
    )


@query(
    "sanity_p_values",
    f"""WITH {SANITY_SQL},
t AS (SELECT estimator, count(*) AS n, avg(j1 - j0) / (stddev_samp(j1 - j0) / sqrt(count(*))) AS t, count(*) - 1 AS v FROM s WHERE j1 IS NOT NULL AND j0 IS NOT NULL GROUP BY 1),
x AS (SELECT estimator, j1 - j0 AS d FROM s WHERE j1 <> j0), a AS (SELECT estimator, abs(d) AS a, count(*) AS n, sum((d > 0)::BIGINT) AS p FROM x GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY estimator ORDER BY a) - n + (n + 1) / 2 AS rank FROM a),
w AS (SELECT estimator, sum(n)::DOUBLE AS n, sum(rank * p)::DOUBLE AS w_plus, sum(n * n * n - n)::DOUBLE AS ties FROM r GROUP BY 1),
z AS (SELECT estimator, (w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM w),
i AS (SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END / 12000 AS share, k / 4000 AS f FROM range(4001) q(k)),
pt AS (SELECT estimator, n, 0.5 - any_value(t) * sum(share * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + f * f * t * t / v)) / sqrt(v * pi())) AS p
  FROM t, i GROUP BY 1, 2),
pz AS (SELECT estimator, 0.5 - any_value(z) * sum(share * exp(-f * f * z * z / 2)) / sqrt(2 * pi()) AS p FROM z, i GROUP BY 1)
SELECT pt.estimator, pt.n, round(pt.p, 7) AS p_t, round(pz.p, 7) AS p_w FROM pt JOIN pz ON pt.estimator IS NOT DISTINCT FROM pz.estimator""",
)
def sanity_p_values(spark, sf):
    """p-values of both tests per estimator."""
    rows = sanity(spark, sf)
    t = stats.paired_t(rows, "jsd_selection", "jsd_random", ["estimator"]).withColumnRenamed("p_value", "p_t")
    w = stats.wilcoxon(rows, "jsd_selection", "jsd_random", ["estimator"]).select("estimator", F.col("p_value").alias("p_w"))
    return t.join(w, "estimator").select("estimator", "n", F.round("p_t", 7).alias("p_t"), F.round("p_w", 7).alias("p_w"))


@query("sanity_fraction_larger", f"WITH {SANITY_SQL} SELECT round(avg((d1 > d0)::INTEGER) * 100, 8) AS pct_larger FROM s")
def sanity_fraction_larger(spark, sf):
    return stats.fraction_larger(sanity(spark, sf), "delta_log_p_selection", "delta_log_p_random").select(
        F.round("pct_larger", 8).alias("pct_larger")
    )


RANKS = """rk AS (SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY {x})) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2 AS rx,
(rank() OVER (PARTITION BY {keys} ORDER BY {y})) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2 AS ry FROM {source}),
sp AS (SELECT {keys}, corr(rx, ry) AS rho, count(*) AS n FROM rk GROUP BY {keys})"""


@query(
    "rank_correlation_by_model_and_estimator",
    "WITH " + ATTACHED_SQL + ", c AS (SELECT * FROM rr WHERE linear_coder = 'MSECoderProjUSimp'), "
    + RANKS.format(keys="model, estimator", x="pred_gain", y="score_log_p", source="c")
    + " SELECT model, estimator, round(rho, 8) AS rho, n FROM sp",
)
def rank_correlation_by_model_and_estimator(spark, sf):
    rows = attached(spark, sf).where("linear_coder = 'MSECoderProjUSimp'")
    out = stats.spearman(rows, ["model", "estimator"], "pred_gain", "validation_score_log_p")
    return out.withColumn("rho", F.round("rho", 8))


@query(
    "rank_correlation_overall",
    "WITH l AS (SELECT 1 AS one, l_extendedprice AS x, l_discount AS y FROM lineitem), "
    + RANKS.format(keys="one", x="x", y="y", source="l") + " SELECT round(rho, 8) AS rho, n FROM sp",
)
def rank_correlation_overall(spark, sf):
    """One group over all order lines; a discount is shared by every eleventh of them."""
    rows = read_table(spark, sf, "lineitem").select("l_extendedprice", "l_discount")
    return stats.spearman(rows, [], "l_extendedprice", "l_discount").select(F.round("rho", 8).alias("rho"), "n")


@query(
    "rank_correlation_at_large_gain",
    "WITH " + ATTACHED_SQL + ", c AS (SELECT * FROM rr WHERE linear_coder = 'MSECoderProjUSimp' AND pred_gain > 1), "
    + RANKS.format(keys="estimator", x="pred_gain", y="score_jsd", source="c") + " SELECT estimator, round(rho, 8) AS rho, n FROM sp",
)
def rank_correlation_at_large_gain(spark, sf):
    rows = attached(spark, sf).where("linear_coder = 'MSECoderProjUSimp' AND pred_gain > 1")
    return stats.spearman(rows, ["estimator"], "pred_gain", "validation_score_jsd").withColumn("rho", F.round("rho", 8))


CATEGORY_SQL = """CASE WHEN explanation_type LIKE '%facility%' THEN regexp_extract(explanation_type, 'lambda=(.*)', 1)
WHEN explanation_type LIKE '%DIVINE%' OR explanation_type LIKE '%AIDE%' THEN 'Other' ELSE 'Naive' END"""


@query(
    "fisher_z_by_lambda",
    "WITH " + DERIVED_SQL + f", c AS (SELECT *, {CATEGORY_SQL} AS cat FROM d WHERE pred_gain > 1), c2 AS (SELECT * FROM c WHERE cat NOT IN ('Other', 'Naive')), "
    + RANKS.format(keys="estimator, cat", x="pred_gain", y="l1", source="c2")
    + """, z AS (SELECT s.estimator, s.cat, s.n, (atanh(b.rho) - atanh(s.rho)) / sqrt(1 / (b.n - 3) + 1 / (s.n - 3)) AS z
FROM sp s JOIN sp b ON s.estimator = b.estimator AND b.cat = '0.0')
SELECT estimator, cat, n, round(z, 7) + 0.0 AS z_stat, z > 1.6448536269514722 AS significant FROM z""",
)
def fisher_z_by_lambda(spark, sf):
    return _fisher(spark, sf).select(
        "estimator", "cat", "n", (F.round("z_stat", 7) + 0.0).alias("z_stat"), "significant"
    )


def _fisher(spark, sf):
    rows = derived(spark, sf).where("pred_gain > 1").withColumnRenamed("category", "cat")
    rho = stats.spearman(rows.where(~F.col("cat").isin("Other", "Naive")), ["estimator", "cat"], "pred_gain", "l1")
    return stats.fisher_z(rho, ["estimator"], "cat", "0.0")


@query(
    "fisher_z_on_validation_score",
    "WITH " + ATTACHED_SQL + f", c AS (SELECT *, {CATEGORY_SQL} AS cat FROM rr WHERE pred_gain > 1), c2 AS (SELECT * FROM c WHERE cat NOT IN ('Other', 'Naive')), "
    + RANKS.format(keys="estimator, cat", x="pred_gain", y="score_log_p", source="c2")
    + """, z AS (SELECT s.estimator, s.cat, s.n, (atanh(b.rho) - atanh(s.rho)) / sqrt(1 / (b.n - 3) + 1 / (s.n - 3)) AS z
FROM sp s JOIN sp b ON s.estimator = b.estimator AND b.cat = '0.0' WHERE s.n > 3 AND b.n > 3)
SELECT estimator, cat, n, tail, round(z, 7) + 0.0 AS z_stat,
CASE tail WHEN 'upper' THEN z > 1.6448536269514722 ELSE z < -1.6448536269514722 END AS significant
FROM z, (VALUES ('upper'), ('lower')) t(tail)""",
)
def fisher_z_on_validation_score(spark, sf):
    """Both tails of the comparison with lambda 0, for the correlation of gain and validation score."""
    rows = attached(spark, sf).where("pred_gain > 1")
    names = analytics.description_table(scoring_records(spark, sf)).select(
        F.col("raw").alias("explanation_type_selection"), F.col("category").alias("cat"))
    rows = rows.join(names, "explanation_type_selection").where(~F.col("cat").isin("Other", "Naive"))
    rho = stats.spearman(rows, ["estimator", "cat"], "pred_gain", "validation_score_log_p")
    return union_all([
        stats.fisher_z(rho, ["estimator"], "cat", "0.0", tail).select(
            "estimator", "cat", "n", F.lit(tail).alias("tail"), (F.round("z_stat", 7) + 0.0).alias("z_stat"), "significant")
        for tail in ("upper", "lower")
    ])


@query(
    "significant_lambdas",
    "WITH " + DERIVED_SQL + f", c AS (SELECT *, {CATEGORY_SQL} AS cat FROM d WHERE pred_gain > 1), c2 AS (SELECT * FROM c WHERE cat NOT IN ('Other', 'Naive')), "
    + RANKS.format(keys="estimator, cat", x="pred_gain", y="l1", source="c2")
    + """, z AS (SELECT s.estimator, s.cat, (atanh(b.rho) - atanh(s.rho)) / sqrt(1 / (b.n - 3) + 1 / (s.n - 3)) AS z
FROM sp s JOIN sp b ON s.estimator = b.estimator AND b.cat = '0.0' WHERE s.n > 3 AND b.n > 3)
SELECT estimator, tail, string_agg(cat, ',' ORDER BY cat::DOUBLE) AS categories FROM z, (VALUES ('upper'), ('lower')) t(tail)
WHERE CASE tail WHEN 'upper' THEN z > 1.6448536269514722 ELSE z < -1.6448536269514722 END GROUP BY ALL""",
)
def significant_lambdas(spark, sf):
    """Lambdas whose correlation is significantly above or below the naive one, per estimator, at the published level."""
    rows = derived(spark, sf).where("pred_gain > 1").withColumnRenamed("category", "cat")
    rho = cut_lineage(stats.spearman(rows.where(~F.col("cat").isin("Other", "Naive")), ["estimator", "cat"], "pred_gain", "l1"))
    return union_all([
        stats.significant_categories(stats.fisher_z(rho, ["estimator"], "cat", "0.0", tail), "estimator", "cat").select(
            "estimator", F.lit(tail).alias("tail"), "categories")
        for tail in ("upper", "lower")
    ])


@query(
    "reliability_bins",
    """WITH l AS (SELECT l_extendedprice / 23457.0 AS g, l_discount - 0.05 AS o FROM lineitem),
e AS (SELECT log10(min(g)) AS lo, log10(max(g)) AS hi FROM l),
b AS (SELECT g, o, least(greatest(ceil((log10(g) - lo) / (hi - lo) * 20) - 1, 0), 19)::INTEGER AS bin FROM l, e)
SELECT bin, round(avg(g), 8) AS mean_score, round(avg(((g > 1) = (o > 0))::INTEGER), 8) AS accuracy, count(*) AS n FROM b GROUP BY bin""",
)
def reliability_bins(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 23457.0).alias("g"), (F.col("l_discount") - 0.05).alias("o")
    )
    return stats.reliability_bins(rows, "g", "o").select(
        "bin", F.round("mean_score", 8).alias("mean_score"), F.round("accuracy", 8).alias("accuracy"), "n"
    )


@query(
    "percentile_range",
    """SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem
WHERE l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.05) FROM lineitem) AND l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.9) FROM lineitem)
GROUP BY l_returnflag""",
)
def percentile_range(spark, sf):
    kept = stats.percentile_filter(read_table(spark, sf, "lineitem"), "l_extendedprice", 0.05, 0.9)
    return kept.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


HIST_SQL = """l AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l),
h AS (SELECT f, least(greatest(floor((x - x0) / ((x1 - x0) / 200)), 0), 199)::BIGINT AS bx,
least(greatest(floor((y - y0) / ((y1 - y0) / 200)), 0), 199)::BIGINT AS "by", count(*) AS n FROM l, r GROUP BY ALL)"""


@query("histogram_2d", f"WITH {HIST_SQL} SELECT f, bx, \"by\", n FROM h")
def histogram_2d(spark, sf):
    lines = read_table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "f")
    return stats.hist2d(lines, "l_quantity", "l_extendedprice", 200, ["f"])


@query(
    "histogram_marginals",
    f"""WITH {HIST_SQL} SELECT 'x' AS axis, bx AS bin, sum(n)::BIGINT AS n FROM h GROUP BY bx UNION ALL SELECT 'y', "by", sum(n)::BIGINT FROM h GROUP BY "by" """,
)
def histogram_marginals(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return stats.marginals(stats.hist2d(lines, "l_quantity", "l_extendedprice", 200))


@query(
    "describe_values",
    """SELECT count(value) AS count, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std, min(value) AS min,
round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50, round(quantile_cont(value, 0.75), 7) AS p75, max(value) AS max FROM events""",
)
def describe_values(spark, sf):
    out = stats.describe_column(read_table(spark, sf, "events"), "value")
    return out.select("count", *[F.round(c, 7).alias(c) for c in ("mean", "std")], "min",
                      *[F.round(c, 7).alias(c) for c in ("p25", "p50", "p75")], "max")


# --- completeness -----------------------------------------------------------------------------------------------

SCORING_KEYS = ", ".join(checks.SCORING_KEYS)


@query(
    "incomplete_groups",
    f"""WITH {SCORING_SQL} SELECT {SCORING_KEYS}, count(*) AS n FROM scoring GROUP BY {SCORING_KEYS} HAVING count(*) <> 2""",
)
def incomplete_groups(spark, sf):
    return checks.incomplete_groups(scoring_records(spark, sf), checks.SCORING_KEYS, 2)


MISSING_SQL = f"""{SCORING_SQL}, {VALIDATION_SQL}, a AS (SELECT DISTINCT explanation_type, model, estimator FROM scoring),
b AS (SELECT DISTINCT explanation_type, model, estimator FROM validation WHERE jsd > 0.085), m AS (SELECT * FROM a EXCEPT SELECT * FROM b)"""


def _missing(spark, sf):
    """Settings that never have a validation record with a JSD above 0.085."""
    return checks.missing_settings(scoring_records(spark, sf), validation_records(spark, sf).where("jsd > 0.085"))


@query("missing_settings", f"WITH {MISSING_SQL} SELECT * FROM m")
def missing_settings(spark, sf):
    return _missing(spark, sf)


@query(
    "missing_settings_by_column",
    f"""WITH {MISSING_SQL} SELECT DISTINCT 'explanation_type' AS "column", explanation_type AS value FROM m
UNION SELECT 'model', model FROM m UNION SELECT 'estimator', estimator FROM m""",
)
def missing_settings_by_column(spark, sf):
    return checks.missing_by_column(_missing(spark, sf))


@query(
    "distinct_settings",
    f"WITH {SCORING_SQL} SELECT count(*) AS settings FROM (SELECT DISTINCT explanation_type, model, estimator FROM scoring)",
)
def distinct_settings(spark, sf):
    return checks.setting_count(scoring_records(spark, sf))


@query(
    "open_results",
    f"""WITH {SCORING_SQL}, {VALIDATION_SQL} SELECT s.estimator, count(*) AS n FROM scoring s WHERE NOT EXISTS (SELECT 1 FROM validation v
WHERE v.jsd > 0.05 AND v.document_idx = s.document_idx AND v.explanation_type = s.explanation_type) GROUP BY s.estimator""",
)
def open_results(spark, sf):
    """Scoring records without a finished validation record of the same key."""
    done = validation_records(spark, sf).where("jsd > 0.05")
    return pending(scoring_records(spark, sf), done, ["document_idx", "explanation_type"]).groupBy("estimator").agg(
        F.count("*").alias("n")
    )


@query(
    "stored_values",
    """SELECT regexp_replace(p_name, '[0-9]', '', 'g') AS label, CASE WHEN bool_or(p_size > 40) THEN 'new' ELSE 'old' END AS value FROM part GROUP BY 1""",
)
def stored_values(spark, sf):
    parts = read_table(spark, sf, "part").select(F.concat("p_name", F.col("p_size").cast("string")).alias("label"), "p_size")
    stored = parts.where("p_size <= 40").select("label", F.lit("old").alias("value")).distinct()
    new = parts.where("p_size > 40").select("label", F.lit("new").alias("value")).distinct()
    return upsert_values(stored, new)


# --- reports -----------------------------------------------------------------------------------------------------

@query(
    "coefficient_shares_macro",
    f"""WITH {DERIVED_SQL}, s AS (SELECT *, ((t0 <> 0)::INTEGER + (t1 <> 0)::INTEGER + (t2 <> 0)::INTEGER) / 3 AS nz, ((t0 < 0)::INTEGER + (t1 < 0)::INTEGER + (t2 < 0)::INTEGER) / 3 AS ng FROM d),
i AS (SELECT model, {DATASET}, estimator, seed, linear_coder, explanation_type, explanation_type_no_k, k, avg(l1) AS l1, avg(l2) AS l2, avg(nz) AS nz, avg(ng) AS ng FROM s GROUP BY ALL),
o AS (SELECT k, linear_coder, avg(l1) AS l1, avg(l2) AS l2, avg(nz) AS nz, avg(ng) AS ng FROM i GROUP BY ALL),
u AS (SELECT k::VARCHAR AS k, linear_coder, l1, l2, nz, ng FROM o UNION ALL SELECT 'macro_avg', linear_coder, avg(l1), avg(l2), avg(nz), avg(ng) FROM o GROUP BY linear_coder)
SELECT k, linear_coder, round(l1, 8) AS l1, round(l2, 8) AS l2, round(nz, 8) AS prop_nonzero, round(ng, 8) AS prop_negative FROM u""",
)
def coefficient_shares_macro(spark, sf):
    rows = analytics.coefficient_shares(derived(spark, sf))
    inner = ["model", *analytics.DATASET_KEYS, "estimator", "seed", "linear_coder", "explanation_type", "explanation_type_no_k", "k"]
    values = ["l1", "l2", "prop_nonzero", "prop_negative"]
    table = analytics.macro_average(rows, inner, ["k", "linear_coder"], values, total="k")
    return table.select("k", "linear_coder", *[F.round(v, 8).alias(v) for v in values])


COHORT_SQL = DERIVED_SQL + """, c AS (SELECT * FROM d WHERE linear_coder = 'MSECoderProjUSimp' AND explanation_type NOT LIKE '%lambda=0.0%')"""


@query(
    "cohort_gain",
    f"""WITH {COHORT_SQL} SELECT explanation_type, count(*) AS n, round(10 * log10(avg(pred_gain)), 8) AS gain_db, round(avg(nmse), 8) AS nmse
FROM c WHERE k = 10 AND estimator LIKE 'LESS%' GROUP BY explanation_type""",
)
def cohort_gain(spark, sf):
    rows = analytics.cohort(derived(spark, sf), "MSECoderProjUSimp", 10, ESTIMATORS[0])
    return rows.groupBy("explanation_type").agg(
        F.count("*").alias("n"), F.round(decibel(F.avg("pred_gain")), 8).alias("gain_db"), F.round(F.avg("nmse"), 8).alias("nmse")
    )


# Short labels of the SQL twins.
LABEL_SQL = """CASE WHEN {x} LIKE '%sanity%' THEN 'Test instance' WHEN {x} LIKE '%random%' THEN 'random'
WHEN {x} LIKE '%facility%' THEN ' FL ' || replace(regexp_extract({x}, '(least|most) (influential|helpful|harmful)', 0), 'influential', 'inf.') || ' $\\lambda=' ||
  (CASE regexp_extract({x}, 'lambda=([0-9.]+)', 1) WHEN '0.0' THEN '0' WHEN '1.0' THEN '1' ELSE regexp_extract({x}, 'lambda=([0-9.]+)', 1)[2:] END) || '$'
WHEN {x} LIKE '%DIVINE%' THEN ' DIVINE ' || replace(regexp_extract({x}, '(least|most) (influential|helpful|harmful)', 0), 'influential', 'inf.')
WHEN {x} LIKE '%AIDE%' THEN ' AIDE' ELSE replace(regexp_extract({x}, '(least|most) (influential|helpful|harmful)', 0), 'influential', 'inf.') END"""
MODEL_SQL = "CASE WHEN model LIKE 'OLMo%' THEN 'Olmo2-1B' WHEN model LIKE 'Qwen%' THEN 'Qwen2.5-0.5B' ELSE 'Llama-3.2-1B' END"


def _selection_sql(model: str, model_name: str) -> str:
    return f"""WITH {COHORT_SQL},
i AS (SELECT {model} {DATASET}, estimator, seed, linear_coder, explanation_type, explanation_type_no_k, k, sort_type, avg(pred_gain) AS g FROM c GROUP BY ALL),
n AS (SELECT {model_name} split_part(estimator, ':', 1) AS estimator, {LABEL_SQL.format(x='explanation_type')} AS label, sort_type, g, k FROM i),
a AS (SELECT {model} estimator, label, sort_type, avg(g) AS g, avg(k) AS k FROM n GROUP BY ALL),
p AS (SELECT {model} CASE WHEN label LIKE '%random%' THEN '-' ELSE estimator END AS estimator, label, sort_type, g, k FROM a)
SELECT {model} estimator, label AS explanation_type, sort_type, round(avg(g), 8) AS pred_gain, round(avg(k), 8) AS k FROM p GROUP BY {model} estimator, label, sort_type"""


@query("selection_table", _selection_sql("", ""))
def selection_table(spark, sf):
    table = analytics.selection_table(analytics.cohort(derived(spark, sf), "MSECoderProjUSimp"))
    return table.withColumn("pred_gain", F.round("pred_gain", 8)).withColumn("k", F.round("k", 8))


@query("selection_table_by_model", _selection_sql("model,", MODEL_SQL + " AS model,"))
def selection_table_by_model(spark, sf):
    table = analytics.selection_table(analytics.cohort(derived(spark, sf), "MSECoderProjUSimp"), with_model=True)
    return table.withColumn("pred_gain", F.round("pred_gain", 8)).withColumn("k", F.round("k", 8))


@query(
    "formatted_report",
    """SELECT l_returnflag, l_linestatus, round(10 * log10(avg(l_extendedprice)), 8) AS gain, printf('%.2f dB', 10 * log10(avg(l_extendedprice))) AS gain_text
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def formatted_report(spark, sf):
    table = read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("gain"))
    return analytics.report(table, "gain").withColumn("gain", F.round("gain", 8))


AUC_SQL = COHORT_SQL + f""",
pt AS (SELECT model, {DATASET}, estimator, linear_coder, explanation_type_no_k, k, avg(pred_gain) AS y FROM c GROUP BY ALL),
lg AS (SELECT *, (k - lag(k) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM pt WINDOW w AS (PARTITION BY model, estimator, linear_coder, explanation_type_no_k ORDER BY k)),
area AS (SELECT model, estimator, linear_coder, explanation_type_no_k, sum(part) AS auc FROM lg GROUP BY ALL HAVING count(*) >= 2)"""


@query("gain_area_over_k", f"WITH {AUC_SQL} SELECT model, estimator, explanation_type_no_k, round(auc, 7) AS auc FROM area")
def gain_area_over_k(spark, sf):
    rows = analytics.cohort(derived(spark, sf), "MSECoderProjUSimp")
    keys = ["model", *analytics.DATASET_KEYS, "estimator", "linear_coder", "explanation_type_no_k"]
    return analytics.auc(rows, keys).select("model", "estimator", "explanation_type_no_k", F.round("auc", 7).alias("auc"))


@query(
    "gain_area_table",
    f"""WITH {AUC_SQL}, x AS (SELECT estimator, auc, CASE WHEN explanation_type_no_k LIKE '%random%' THEN 'random' ELSE {LABEL_SQL.format(x="replace(explanation_type_no_k, 'X', '2202')")} END AS label FROM area)
SELECT label AS explanation_type_no_k, estimator, round(avg(auc), 7) AS auc_pred_gain FROM x GROUP BY label, estimator""",
)
def gain_area_table(spark, sf):
    rows = analytics.cohort(derived(spark, sf), "MSECoderProjUSimp")
    return analytics.auc_table(rows, with_model=False).withColumn("auc_pred_gain", F.round("auc_pred_gain", 7))


RATIO_SQL = DERIVED_SQL + f""",
s0 AS (SELECT *, CASE WHEN explanation_type LIKE '%by facility location%' THEN 'facility_location' WHEN explanation_type LIKE '%by DIVINE%' THEN 'divine'
  WHEN explanation_type LIKE '%by AIDE%' THEN 'aide' WHEN explanation_type LIKE 'Top-%' THEN 'top_k' END AS method FROM d WHERE linear_coder = 'MSECoderProjUSimp'),
s1 AS (SELECT model, estimator, linear_coder, k, method, sort_type, explanation_type, avg(pred_gain) AS g FROM s0 WHERE method IS NOT NULL GROUP BY ALL),
ratio AS (SELECT a.model, a.estimator, a.k, a.method, a.explanation_type AS setting, a.g AS fl, b.g AS naive, a.g / b.g AS ratio, 1 - a.g / b.g AS reduction
  FROM s1 a JOIN s1 b ON a.method <> 'top_k' AND b.method = 'top_k' AND a.model = b.model AND a.estimator = b.estimator AND a.k = b.k AND a.sort_type = b.sort_type)"""


def _ratios(spark, sf):
    rows = derived(spark, sf).where("linear_coder = 'MSECoderProjUSimp'")
    return analytics.gain_ratio(rows, ["model", "estimator", "linear_coder", "k"])


@query(
    "gain_ratio_to_naive",
    f"""WITH {RATIO_SQL} SELECT model, estimator, k, method, setting, round(fl, 8) AS fl, round(naive, 8) AS naive, round(ratio, 8) AS pred_gain_ratio,
round(reduction, 8) AS pred_gain_reduction_pct FROM ratio""",
)
def gain_ratio_to_naive(spark, sf):
    return _ratios(spark, sf).select(
        "model", "estimator", "k", "method", "setting",
        *[F.round(c, 8).alias(c) for c in ("fl", "naive", "pred_gain_ratio", "pred_gain_reduction_pct")],
    )


@query(
    "gain_improvement_bars",
    f"""WITH {RATIO_SQL} SELECT k, estimator, model, method, CASE method WHEN 'divine' THEN 42 WHEN 'aide' THEN 111 ELSE regexp_extract(setting, 'lambda=([0-9.]+)', 1)::DOUBLE END AS lam,
round(avg((ratio - 1) * 100), 6) AS pct FROM ratio WHERE setting LIKE '%largest absolute%' OR setting LIKE '%AIDE%' GROUP BY ALL""",
)
def gain_improvement_bars(spark, sf):
    bars = analytics.ratio_bars(_ratios(spark, sf))
    method = F.when(F.col("label").contains("FL"), "facility_location").when(F.col("label").contains("DIVINE"), "divine").otherwise("aide")
    return bars.select("k", "estimator", "model", method.alias("method"), F.col("lambda").alias("lam"), F.round("pct", 6).alias("pct"))


@query(
    "task_score_matrix",
    """SELECT model, round((coalesce(click, 0) + coalesce(error, 0) + coalesce(purchase, 0) + coalesce(signup, 0) + coalesce(view, 0)) / ((click IS NOT NULL)::INTEGER + (error IS NOT NULL)::INTEGER
 + (purchase IS NOT NULL)::INTEGER + (signup IS NOT NULL)::INTEGER + (view IS NOT NULL)::INTEGER), 8) AS Avg, round(click, 8) AS click, round(error, 8) AS error, round(purchase, 8) AS purchase, round(signup, 8) AS signup, round(view, 8) AS view
FROM (SELECT user_id AS model, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error, avg(value) FILTER (event_type = 'purchase') AS purchase,
avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id)""",
)
def task_score_matrix(spark, sf):
    rows = read_table(spark, sf, "events").withColumnRenamed("user_id", "model")
    tasks = ["click", "error", "purchase", "signup", "view"]
    table = analytics.score_matrix(rows, "model", "event_type", "value", tasks)
    return table.select("model", *[F.round(c, 8).alias(c) for c in ("Avg", *tasks)])


@query(
    "wide_and_long_scores",
    "SELECT user_id AS test_id, event_type_id AS train_id, round(avg(value), 8) AS score FROM (SELECT user_id, value, length(event_type) AS event_type_id FROM events) GROUP BY ALL",
)
def wide_and_long_scores(spark, sf):
    """A score table to wide form and back."""
    scores = read_table(spark, sf, "events").groupBy(
        F.col("user_id").alias("test_id"), F.length("event_type").cast("bigint").alias("train_id")
    ).agg(F.round(F.avg("value"), 8).alias("score"))
    return analytics.long_influence(analytics.wide_influence(scores)).where(F.col("score").isNotNull())


@query(
    "best_per_task",
    """SELECT user_id, event_type, round(value, 8) AS value, value = max(value) OVER (PARTITION BY event_type) AS is_best
FROM (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL)""",
)
def best_per_task(spark, sf):
    rows = analytics.best_per_task(read_table(spark, sf, "events"), "user_id", "event_type", "value")
    return rows.select("user_id", "event_type", F.round("value", 8).alias("value"), "is_best")


@query(
    "own_and_external",
    """SELECT p_brand, p_type, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'external' ELSE 'own' END AS type, count(*) AS n
FROM part WHERE NOT contains(p_brand, '#2') GROUP BY p_brand, p_type""",
)
def own_and_external(spark, sf):
    table = read_table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return analytics.own_first(analytics.model_filter(table, "p_brand", "#2"), "p_type", ["ECONOMY", "PROMO"])


@query(
    "primary_scores",
    """SELECT n_name AS model, 'suite' || n_regionkey::VARCHAR AS task_suite, c_mktsegment || ':' || (c_custkey % 7)::VARCHAR AS alias, c_acctbal AS primary_score,
CASE WHEN c_acctbal > 0 THEN c_custkey END AS num_instances, CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 100, 6) END AS share FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def primary_scores(spark, sf):
    """Customers of a nation as benchmark scores of a model; only positive ones have task details."""
    customers = read_table(spark, sf, "customer").join(
        F.broadcast(read_table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    alias = F.concat("c_mktsegment", F.lit(":"), (F.col("c_custkey") % 7).cast("string"))
    details = F.struct(
        alias.alias("alias"), F.col("c_custkey").alias("num_instances"),
        F.create_map(F.lit("share"), F.col("c_acctbal") / 100).alias("metrics"),
    )
    metrics = customers.select(
        F.concat("n_name", F.lit("/"), F.col("c_custkey").cast("string")).alias("file"), F.col("n_name").alias("model"),
        F.concat(F.lit("suite"), F.col("n_regionkey").cast("string")).alias("task_suite"),
        F.array(F.concat(alias, F.lit(": "), F.col("c_acctbal").cast("string"))).alias("all_primary_scores"),
        F.when(F.col("c_acctbal") > 0, F.array(details)).otherwise(F.array().cast("array<struct<alias:string,num_instances:bigint,metrics:map<string,double>>>")).alias("tasks"),
    )
    return analytics.primary_scores(metrics).select(
        "model", "task_suite", "alias", "primary_score", "num_instances", F.round(F.col("metrics")["share"], 6).alias("share")
    )


@query(
    "model_index",
    """WITH m AS (SELECT user_id AS model, event_type AS task, round(avg(value), 2) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL)
SELECT model, count(*) AS results, min(task) AS first_task FROM m GROUP BY model""",
)
def model_index(spark, sf):
    """Nested records per model; counted and read back from their JSON."""
    scores = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("task")).agg(
        F.round(F.avg("value"), 2).alias("value")
    )
    known = spark.createDataFrame(
        [(t, "multiple-choice", t.upper(), t[:3]) for t in ("click", "purchase", "signup", "view")],
        "task string, task_type string, dataset_name string, dataset_type string",
    )
    shape = "struct<name: bigint, results: array<struct<task: struct<type: string, name: string>>>>"
    records = analytics.model_index(scores, F.broadcast(known)).withColumn("r", F.from_json("record", shape))
    return records.select(
        "model", F.size("r.results").cast("bigint").alias("results"),
        F.get("r.results", F.lit(0))["task"]["name"].alias("first_task"),
    )


@query(
    "extreme_selections",
    f"""WITH {DERIVED_SQL}, c AS (SELECT estimator, document_idx, explanation_type, pred_gain FROM d WHERE explanation_type LIKE '%Top-5%' AND pred_gain > 0),
e AS (SELECT estimator, max(pred_gain) AS hi, min(pred_gain) AS lo FROM c GROUP BY estimator)
SELECT 'highest' AS side, estimator, hi AS pred_gain FROM e UNION ALL SELECT 'lowest', estimator, lo FROM e""",
)
def extreme_selections(spark, sf):
    rows = derived(spark, sf).where(F.col("explanation_type").contains("Top-5") & (F.col("pred_gain") > 0))
    return ranking.extreme_selections(rows.select("estimator", "document_idx", "pred_gain"), "estimator", "pred_gain").select(
        "side", "estimator", "pred_gain"
    )


@query(
    "gain_lookup",
    """SELECT o_orderkey, round(10 * log10(o_totalprice), 8) AS gain_db FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def gain_lookup(spark, sf):
    """The one record of every urgent order."""
    orders = read_table(spark, sf, "orders")
    wanted = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    records = orders.select("o_orderkey", F.col("o_totalprice").alias("gain"))
    return analytics.gain_lookup(records, wanted, ["o_orderkey"], "gain").withColumn("gain_db", F.round("gain_db", 8))


@query("linear_map_2d")
def linear_map_2d(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    coords = analytics.linear_map(rows, "id", 2, normalize=True)
    return coords.select(
        "id", F.round(F.get("coords", F.lit(0)), 6).alias("x"), F.round(F.get("coords", F.lit(1)), 6).alias("y")
    )


@query(
    "linear_map_variance",
    """WITH RECURSIVE e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
l AS (SELECT id, sqrt(sum(x * x)) AS l FROM e GROUP BY 1),
u AS (SELECT e.id, i, CASE WHEN l > 0 THEN x / l ELSE x END AS x FROM e JOIN l USING (id)),
d AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM u),
c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM d a JOIN d b USING (id) GROUP BY 1, 2),
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY 1)),
p1 AS (SELECT 0 AS n, list_transform(m, lambda r: 1.0::DOUBLE / len(m) + r[1]) AS v FROM m
  UNION ALL SELECT n + 1, list_transform(y, lambda q: q / sqrt(list_dot_product(y, y)))
  FROM (SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM p1, m WHERE n < 3000)),
v1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS s FROM p1, m WHERE n = 3000),
m2 AS MATERIALIZED (SELECT list_transform(m, lambda r, i: list_transform(r, lambda q, j: q - s * v[i] * v[j])) AS m FROM m, v1),
p2 AS (SELECT 0 AS n, list_transform(m, lambda r: 1.0::DOUBLE / len(m) + r[1]) AS v FROM m2
  UNION ALL SELECT n + 1, list_transform(y, lambda q: q / sqrt(list_dot_product(y, y)))
  FROM (SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM p2, m2 WHERE n < 3000))
SELECT 1 AS component, round(s, 7) AS variance FROM v1
UNION ALL SELECT 2, round(list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))), 7) FROM p2, m2 WHERE n = 3000""",
)
def linear_map_variance(spark, sf):
    """Against power iteration on the covariance."""
    rows = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return analytics.map_variance(rows, "id", 2, normalize=True).withColumn("variance", F.round("variance", 7))


@query(
    "rows_drawn_with_replacement",
    """WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
p AS (SELECT d AS draw, ('0x' || substr(md5('42:' || d::VARCHAR), 1, 8))::BIGINT % n AS idx FROM range(50) r(d), n)
SELECT draw, doc_id FROM p JOIN i USING (idx)""",
)
def rows_drawn_with_replacement(spark, sf):
    docs = with_index(read_table(spark, sf, "documents").select("doc_id"), "doc_id")
    return analytics.sampled_rows(docs, "doc_id", 50, 42)
