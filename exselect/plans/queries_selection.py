"""Queries: selections, linear coders and the whole grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from exselect.operators import coders, greedy, ranking, scoring
from exselect.plans import grid as grids
from exselect.plans.queries_influence import ranked_sql
from exselect.plans.registry import DIGITS, INFLUENCE_SQL, VECTORS_SQL, query, vectors
from exselect.plans.select_and_score import (
    explained_share, score_pending, score_selections, select_all, stored_ground_sets,
)
from exselect.sources.readers import read_table
from exselect.sources.results import pending
from exselect.session import cut_lineage

M = 20  # ground set of the greedy queries
COST_SQL = {"most_helpful": "score", "most_harmful": "-score", "most_influential": "-abs(score)",
            "least_influential": "abs(score)"}


def _ground(spark, sf, order, m=M):
    test, train = vectors(spark, sf)
    top = scoring.top_influence(test, train, m, [order], digits=DIGITS)
    return test, train, top


@query(
    "random_selection",
    f"""WITH {VECTORS_SQL}, p AS (SELECT train_id, row_number() OVER (ORDER BY md5('10:' || train_id::VARCHAR), train_id) AS rank FROM tr)
SELECT 10 AS seed, test_id, rank::INTEGER AS rank, train_id FROM p, te WHERE rank <= 10""",
)
def random_selection(spark, sf):
    test, train = vectors(spark, sf)
    return ranking.random_k(train, test, 10, 10)


@query(
    "random_selection_costs",
    f"""WITH {INFLUENCE_SQL}, p AS (SELECT train_id, row_number() OVER (ORDER BY md5('42:' || train_id::VARCHAR), train_id) AS rank FROM tr)
SELECT test_id, rank::INTEGER AS rank, train_id, score AS cost FROM p JOIN inf USING (train_id) WHERE rank <= 5""",
)
def random_selection_costs(spark, sf):
    test, train = vectors(spark, sf)
    drawn = ranking.random_k(train, test, 5, 42)
    return ranking.random_costs(drawn, scoring.dot_influence(test, train, digits=DIGITS)).select(
        "test_id", "rank", "train_id", "cost"
    )


@query("self_selection", f"WITH {VECTORS_SQL} SELECT test_id, 1 AS rank, test_id AS train_id, 0.0::DOUBLE AS cost FROM te")
def self_selection(spark, sf):
    return ranking.self_selection(vectors(spark, sf)[0])


@query(
    "stored_top_k",
    f"WITH {INFLUENCE_SQL} {ranked_sql('inf', 'least_influential', 7)}",
)
def stored_top_k(spark, sf):
    """Top-k of an influence table that is already there."""
    test, train = vectors(spark, sf)
    table = scoring.dot_influence(test, train, digits=DIGITS)
    return scoring.top_k(table, 7, "least_influential").select(
        "test_id", F.col("rank").cast("bigint").alias("rank"), "train_id", "score"
    )


@query(
    "cost_scaling",
    f"""WITH {INFLUENCE_SQL}, g AS ({ranked_sql('inf', 'most_influential', M)})
SELECT test_id, train_id, round(1 + (-abs(score) - min(-abs(score)) OVER w) / (max(-abs(score)) OVER w - min(-abs(score)) OVER w) * {M - 1}, 7) AS cost
FROM g WINDOW w AS (PARTITION BY test_id)""",
)
def cost_scaling(spark, sf):
    _, _, top = _ground(spark, sf, "most_influential")
    raw = top.withColumn("raw", -F.abs("score"))
    return ranking.min_max(raw, ["test_id"], "raw", 1, M, "cost").select(
        "test_id", "train_id", F.round("cost", 7).alias("cost")
    )


def ground_sql(order: str, m: int = M) -> str:
    """Ground sets with vectors, scaled costs, and cosines of the pairs inside each."""
    c = COST_SQL[order]
    return f"""{INFLUENCE_SQL}, g0 AS ({ranked_sql('inf', order, m)}),
g AS (SELECT g0.*, vec, {c} AS c, min({c}) OVER w AS c0, max({c}) OVER w AS c1 FROM g0 JOIN tr USING (train_id)
      WINDOW w AS (PARTITION BY test_id)),
pr AS MATERIALIZED (SELECT i.test_id, i.rank AS i, j.rank AS j, list_cosine_similarity(i.vec, j.vec) AS cs,
       CASE WHEN i.rank = j.rank THEN 0 ELSE 1 - list_cosine_similarity(i.vec, j.vec) END AS ds
       FROM g i JOIN g j USING (test_id))"""


def facility_sql(order: str) -> str:
    return f"""WITH {ground_sql(order)},
lams AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS lam),
cost AS (SELECT test_id, rank AS j, 1 + (c - c0) / (c1 - c0) * {M - 1} AS cost FROM g),
gain1 AS (SELECT test_id, j, sum(greatest(cs, 0)) AS gain FROM pr GROUP BY ALL),
one AS (SELECT test_id, lam, j, round(pow(gain + 1, lam) / pow(cost, 1 - lam), 9) AS val FROM gain1 JOIN cost USING (test_id, j), lams),
p1 AS (SELECT test_id, lam, j AS p FROM (SELECT *, row_number() OVER (PARTITION BY test_id, lam ORDER BY val DESC, j) AS n FROM one) WHERE n = 1),
gain2 AS (SELECT p1.test_id, lam, a.j, sum(greatest(a.cs - greatest(b.cs, 0), 0)) AS gain
          FROM p1 JOIN pr a ON a.test_id = p1.test_id JOIN pr b ON b.test_id = p1.test_id AND b.i = a.i AND b.j = p1.p
          WHERE a.j <> p1.p GROUP BY ALL),
two AS (SELECT test_id, lam, j, round(pow(gain + 1, lam) / pow(cost, 1 - lam), 9) AS val FROM gain2 JOIN cost USING (test_id, j)),
p2 AS (SELECT test_id, lam, j AS p FROM (SELECT *, row_number() OVER (PARTITION BY test_id, lam ORDER BY val DESC, j) AS n FROM two) WHERE n = 1),
picks AS (SELECT 1 AS k, 1 AS rank, * FROM p1 UNION ALL SELECT 2, 1, * FROM p1 UNION ALL SELECT 2, 2, * FROM p2)
SELECT picks.test_id, lam, k, picks.rank, train_id FROM picks JOIN g ON g.test_id = picks.test_id AND g.rank = p"""


def _register_facility():
    for order in ("most_influential", "most_helpful", "most_harmful", "least_influential"):

        @query(f"facility_location_{order}", facility_sql(order))
        def run(spark, sf, order=order):
            _, train, top = _ground(spark, sf, order)
            picks = greedy.facility_location(greedy.ground_sets(top, train), [1, 2], grids.LAMBDAS, M, DIGITS)
            return picks.select("test_id", F.col("lambda").alias("lam"), "k", "rank", "train_id")


_register_facility()


@query(
    "facility_location_without_coverage",
    f"""WITH {INFLUENCE_SQL} SELECT test_id, rank::INTEGER AS rank, train_id
FROM ({ranked_sql('inf', 'most_harmful', 10)})""",
)
def facility_location_without_coverage(spark, sf):
    """At lambda 0 only the cost counts: the picks are the first of the ground set, in its order."""
    _, train, top = _ground(spark, sf, "most_harmful")
    picks = greedy.facility_location(greedy.ground_sets(top, train), [10], [0.0], M, DIGITS)
    return picks.select("test_id", "rank", "train_id")


def divine_sql(order: str) -> str:
    return f"""WITH {ground_sql(order)},
gams AS (SELECT i, pow(10.0::DOUBLE, -4 + 9.0::DOUBLE * i / 19) AS gam FROM range(20) r(i)),
md AS (SELECT test_id, max(ds) AS md FROM pr GROUP BY test_id),
imp AS (SELECT test_id, rank AS j, (c1 - c) / (c1 - c0) AS imp FROM g),
p1 AS (SELECT test_id, arg_max(j, imp) AS p FROM imp GROUP BY test_id),
two AS (SELECT p1.test_id, gams.i, p, imp.j, ds, round(imp - gam * (md + 2 * (md - ds)), 9) AS val
        FROM p1 JOIN imp USING (test_id) JOIN md USING (test_id)
        JOIN pr ON pr.test_id = p1.test_id AND pr.i = p AND pr.j = imp.j, gams WHERE imp.j <> p),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id, i ORDER BY val DESC, j) AS n FROM two) WHERE n = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(ds / 2, 9) DESC, i) AS nn FROM p2) WHERE nn = 1),
picks AS (SELECT 1 AS k, 1 AS rank, test_id, p FROM p1 UNION ALL SELECT 2, 1, test_id, p FROM p1 UNION ALL SELECT 2, 2, test_id, j FROM best)
SELECT picks.test_id, k, picks.rank, train_id FROM picks JOIN g ON g.test_id = picks.test_id AND g.rank = p"""


def _register_divine():
    for order in ("most_influential", "most_helpful", "most_harmful", "least_influential"):

        @query(f"divine_{order}", divine_sql(order))
        def run(spark, sf, order=order):
            _, train, top = _ground(spark, sf, order)
            return greedy.divine(greedy.ground_sets(top, train), [1, 2], digits=DIGITS).select(
                "test_id", "k", "rank", "train_id"
            )


_register_divine()


@query(
    "aide_picks",
    f"""WITH {ground_sql('most_influential')},
md AS (SELECT test_id, max(ds) AS md FROM pr GROUP BY test_id),
fixed AS (SELECT test_id, rank AS j, 0.2 * abs(score) + 0.8 * list_dot_product(g.vec, te.vec)
          / (sqrt(list_dot_product(g.vec, g.vec)) * sqrt(list_dot_product(te.vec, te.vec)) + 1e-10) AS fix
          FROM g JOIN te USING (test_id)),
gain1 AS (SELECT test_id, j, sum(md - ds) AS gain FROM pr JOIN md USING (test_id) GROUP BY ALL),
ks AS (SELECT unnest([1, 2]) AS k),
one AS (SELECT test_id, k, j, round(fix + 0.5 * (CASE k WHEN 1 THEN 1 ELSE 0.5 END) * gain, 9) AS val FROM gain1 JOIN fixed USING (test_id, j), ks),
p1 AS (SELECT test_id, k, j AS p FROM (SELECT *, row_number() OVER (PARTITION BY test_id, k ORDER BY val DESC, j) AS n FROM one) WHERE n = 1),
gain2 AS (SELECT p1.test_id, a.j, sum(greatest((md - a.ds) - (md - b.ds), 0)) AS gain
          FROM p1 JOIN md USING (test_id) JOIN pr a ON a.test_id = p1.test_id
          JOIN pr b ON b.test_id = p1.test_id AND b.i = a.i AND b.j = p1.p WHERE k = 2 AND a.j <> p1.p GROUP BY ALL),
two AS (SELECT test_id, j, round(fix + 0.25 * gain, 9) AS val FROM gain2 JOIN fixed USING (test_id, j)),
p2 AS (SELECT test_id, j AS p FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY val DESC, j) AS n FROM two) WHERE n = 1),
picks AS (SELECT test_id, k, 1 AS rank, p FROM p1 UNION ALL SELECT test_id, 2, 2, p FROM p2)
SELECT picks.test_id, k, picks.rank, train_id FROM picks JOIN g ON g.test_id = picks.test_id AND g.rank = p""",
)
def aide_picks(spark, sf):
    test, train, top = _ground(spark, sf, "most_influential")
    return greedy.aide(greedy.ground_sets(top, train), test, [1, 2], digits=DIGITS).select(
        "test_id", "k", "rank", "train_id"
    )


PUBLISHED_M, STEPS = 100, 5


def stepped_sql(start: str, cover: str, value: str) -> str:
    """Greedy steps one by one over runs (test_id, run): the largest value, then the lower rank.

    `start` defines `state1(test_id, run, i, held)`, what each element of the ground set holds before any pick, and
    `fixed(test_id, run, j, ...)`; `cover` is what an element holds after a pick at (held, pr), `value` what a pick is worth.
    """
    sql = start
    for n in range(1, STEPS + 1):
        taken = " ".join(f"AND NOT EXISTS (FROM p{q} WHERE p{q}.test_id = f.test_id AND p{q}.run = f.run AND p{q}.p = f.j)" for q in range(1, n))
        sql += f""",
w{n} AS MATERIALIZED (SELECT s.test_id, s.run, pr.j, sum(CASE WHEN pr.i = pr.j THEN held ELSE 0 END) AS own, sum(greatest(pr.cover - held, 0)) AS gain
  FROM state{n} s JOIN pv pr ON pr.test_id = s.test_id AND pr.i = s.i GROUP BY ALL),
p{n} AS MATERIALIZED (SELECT test_id, run, j AS p FROM (SELECT f.test_id, f.run, f.j,
  row_number() OVER (PARTITION BY f.test_id, f.run ORDER BY round({value}, 9) DESC, f.j) AS n FROM fixed f JOIN w{n} w USING (test_id, run, j) WHERE true {taken}) WHERE n = 1),
state{n + 1} AS MATERIALIZED (SELECT s.test_id, s.run, s.i, {cover} AS held FROM state{n} s JOIN p{n} USING (test_id, run)
  JOIN pv pr ON pr.test_id = s.test_id AND pr.i = s.i AND pr.j = p{n}.p)"""
    picks = " UNION ALL ".join(f"SELECT test_id, run, {n} AS rank, p FROM p{n}" for n in range(1, STEPS + 1))
    return f"WITH {sql}, picks AS ({picks}) "


_PUBLISHED = {order: ground_sql(order, PUBLISHED_M) for order in COST_SQL}


@query(
    "facility_location_at_published_size",
    stepped_sql(
        f"""{_PUBLISHED['most_influential']}, pv AS (SELECT test_id, i, j, cs AS cover FROM pr),
lams AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS run),
state1 AS (SELECT test_id, run, rank AS i, 0.0::DOUBLE AS held FROM g, lams),
fixed AS (SELECT test_id, run, rank AS j, 1 + (c - c0) / (c1 - c0) * {PUBLISHED_M - 1} AS cost FROM g, lams)""",
        "greatest(held, pr.cover)", "pow(gain + 1, f.run) / pow(cost, 1 - f.run)")
    + "SELECT picks.test_id, run AS lam, picks.rank, train_id FROM picks JOIN g ON g.test_id = picks.test_id AND g.rank = p",
)
def facility_location_at_published_size(spark, sf):
    """Ground sets of 100, five picks, against a twin that takes them one by one."""
    _, train, top = _ground(spark, sf, "most_influential", PUBLISHED_M)
    picks = greedy.facility_location(greedy.ground_sets(top, train), [STEPS], grids.LAMBDAS, PUBLISHED_M, DIGITS)
    return picks.select("test_id", F.col("lambda").alias("lam"), "rank", "train_id")


@query(
    "divine_at_published_size",
    stepped_sql(
        f"""{_PUBLISHED['most_harmful']}, md AS (SELECT test_id, max(ds) AS md FROM pr GROUP BY test_id),
pv AS (SELECT test_id, i, j, 2 * (md - ds) AS cover FROM pr JOIN md USING (test_id)),
gams AS (SELECT i AS run, pow(10.0::DOUBLE, -4 + 9.0::DOUBLE * i / 19) AS gam FROM range(20) r(i)),
state1 AS (SELECT test_id, run, rank AS i, md AS held FROM g JOIN md USING (test_id), gams),
fixed AS (SELECT test_id, run, rank AS j, (c1 - c) / (c1 - c0) AS imp, gam FROM g, gams)""",
        "held + pr.cover", "imp - gam * own")
    + """, apart AS (SELECT a.test_id, a.run, round(avg(ds), 9) AS apart FROM picks a JOIN picks b USING (test_id, run)
  JOIN pr ON pr.test_id = a.test_id AND pr.i = a.p AND pr.j = b.p GROUP BY ALL),
best AS (SELECT test_id, run FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY apart DESC, run) AS n FROM apart) WHERE n = 1)
SELECT picks.test_id, picks.rank, train_id FROM picks JOIN best USING (test_id, run) JOIN g ON g.test_id = picks.test_id AND g.rank = p""",
)
def divine_at_published_size(spark, sf):
    _, train, top = _ground(spark, sf, "most_harmful", PUBLISHED_M)
    return greedy.divine(greedy.ground_sets(top, train), [STEPS], digits=DIGITS).select("test_id", "rank", "train_id")


@query(
    "aide_at_published_size",
    stepped_sql(
        f"""{_PUBLISHED['most_influential']}, md AS (SELECT test_id, max(ds) AS md FROM pr GROUP BY test_id),
pv AS (SELECT test_id, i, j, md - ds AS cover FROM pr JOIN md USING (test_id)),
state1 AS (SELECT test_id, 1 AS run, rank AS i, 0.0::DOUBLE AS held FROM g),
fixed AS (SELECT test_id, 1 AS run, rank AS j, 0.2 * abs(score) + 0.8 * list_dot_product(g.vec, te.vec)
  / (sqrt(list_dot_product(g.vec, g.vec)) * sqrt(list_dot_product(te.vec, te.vec)) + 1e-10) AS fix FROM g JOIN te USING (test_id))""",
        "greatest(held, pr.cover)", f"fix + 0.5 * {1 - 1 / (STEPS * (STEPS - 1))} * gain")
    + "SELECT picks.test_id, picks.rank, train_id FROM picks JOIN g ON g.test_id = picks.test_id AND g.rank = p",
)
def aide_at_published_size(spark, sf):
    test, train, top = _ground(spark, sf, "most_influential", PUBLISHED_M)
    return greedy.aide(greedy.ground_sets(top, train), test, [STEPS], digits=DIGITS).select("test_id", "rank", "train_id")


@query(
    "ground_set_similarity",
    f"""WITH {ground_sql('most_helpful')} SELECT test_id, round(avg(cs), 9) AS mean_similarity, round(max(ds), 9) AS max_distance
FROM pr GROUP BY test_id""",
)
def ground_set_similarity(spark, sf):
    _, train, top = _ground(spark, sf, "most_helpful")
    return greedy.ground_similarity(greedy.ground_sets(top, train)).select(
        "test_id", F.round("mean_similarity", 9).alias("mean_similarity"), F.round("max_distance", 9).alias("max_distance")
    )


@query(
    "nearest_ground_point",
    f"""WITH {INFLUENCE_SQL}, g AS (SELECT r.*, vec FROM ({ranked_sql('inf', 'most_influential', M)}) r JOIN tr USING (train_id)),
pt AS (SELECT r.*, vec FROM ({ranked_sql('inf', 'most_harmful', 5)}) r JOIN tr USING (train_id)),
d AS (SELECT pt.test_id, pt.rank, pt.train_id, g.train_id AS nearest_id,
      round(1 - list_dot_product(g.vec, pt.vec) / sqrt(list_dot_product(g.vec, g.vec)) / sqrt(list_dot_product(pt.vec, pt.vec)), 9) AS dist, g.rank AS gr
      FROM pt JOIN g USING (test_id))
SELECT test_id, rank::INTEGER AS rank, train_id, nearest_id FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id, rank ORDER BY dist, gr) AS n FROM d) WHERE n = 1""",
)
def nearest_ground_point(spark, sf):
    test, train = vectors(spark, sf)
    top = scoring.top_influence(test, train, M, ["most_influential", "most_harmful"], digits=DIGITS)
    both = greedy.ground_sets(top, train)
    points = both.where("sort_type = 'most_harmful' AND rank <= 5")
    return greedy.nearest_ground_point(both.where("sort_type = 'most_influential'"), points).drop("distance")


# --- coders ----------------------------------------------------------------------------------------

PAIR_SQL = f"""{INFLUENCE_SQL}, top AS ({ranked_sql('inf', 'most_influential', 2)}),
ab AS (SELECT a.test_id, x.vec AS a1, y.vec AS a2, te.vec AS g FROM top a JOIN top b USING (test_id)
       JOIN tr x ON x.train_id = a.train_id JOIN tr y ON y.train_id = b.train_id JOIN te USING (test_id)
       WHERE a.rank = 1 AND b.rank = 2),
k AS (SELECT *, list_dot_product(a1, a1) AS k11, list_dot_product(a1, a2) AS k12, list_dot_product(a2, a2) AS k22,
      list_dot_product(a1, g) AS b1, list_dot_product(a2, g) AS b2 FROM ab)"""

CODER_SQL = f"""WITH {PAIR_SQL},
least AS (SELECT *, (k22 * b1 - k12 * b2) / (k11 * k22 - k12 * k12) AS t1, (k11 * b2 - k12 * b1) / (k11 * k22 - k12 * k12) AS t2,
  k11 + 0.7 AS m11, k22 + 0.7 AS m22, k11 - 2 * k12 + k22 AS w2, k11 - k12 AS w1a, k12 - k22 AS w2a, b1 - b2 AS wg FROM k),
soft AS (SELECT *, sign(t1) * greatest(abs(t1) - 0.5 * (t1 + t2), 0) AS s1, sign(t2) * greatest(abs(t2) - 0.5 * (t1 + t2), 0) AS s2,
  (m22 * b1 - k12 * b2) / (m11 * m22 - k12 * k12) AS u1, (m11 * b2 - k12 * b1) / (m11 * m22 - k12 * k12) AS u2,
  greatest((m11 * b1 + k12 * b2) / (m11 * m11 + k12 * k12), 0) AS n1, greatest((k12 * b1 + m22 * b2) / (k12 * k12 + m22 * m22), 0) AS n2 FROM least),
c AS (
  SELECT test_id, g, a1, a2, 'MSECoder' AS linear_coder, t1, t2 FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'MSECoderProjUSimp',
    greatest(t1 - greatest(greatest(t1, t2) - 1, (t1 + t2 - 1) / 2), 0), greatest(t2 - greatest(greatest(t1, t2) - 1, (t1 + t2 - 1) / 2), 0) FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'MSECoderProjUSimpSparseSoftThresh',
    greatest(s1 - greatest(greatest(s1, s2) - 1, (s1 + s2 - 1) / 2), 0), greatest(s2 - greatest(greatest(s1, s2) - 1, (s1 + s2 - 1) / 2), 0) FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'MSECoderProjUSimpSparse', CASE WHEN t1 >= t2 THEN 1 ELSE 0 END, CASE WHEN t1 >= t2 THEN 0 ELSE 1 END FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'KLTCoder',
    (k22 * w1a - k12 * w2a) * wg / w2 / (k11 * k22 - k12 * k12), (k11 * w2a - k12 * w1a) * wg / w2 / (k11 * k22 - k12 * k12) FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'MSECoderL2', u1, u2 FROM soft
  UNION ALL SELECT test_id, g, a1, a2, 'MSECoderNNLSL2',
    CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN r1 <= r2 THEN n1 ELSE 0 END,
    CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN r1 <= r2 THEN 0 ELSE n2 END
    FROM (SELECT *, pow(m11 * n1 - b1, 2) + pow(k12 * n1 - b2, 2) AS r1, pow(k12 * n2 - b1, 2) + pow(m22 * n2 - b2, 2) AS r2 FROM soft)),
r AS (SELECT *, list_transform(range(1, len(g) + 1), lambda i: g[i] - t1 * a1[i] - t2 * a2[i]) AS rest FROM c)
SELECT test_id, linear_coder, round(t1, 7) + 0.0 AS t1, round(t2, 7) + 0.0 AS t2,
  round(list_aggregate(g, 'var_pop') / (list_aggregate(rest, 'var_pop') + 1e-8), 7) AS pred_gain,
  round(list_dot_product(rest, rest) / len(rest), 9) AS mse, round(abs(t1) + abs(t2), 7) AS l1, round(t1 * t1 + t2 * t2, 7) AS l2
FROM r"""


@query(
    "scores_of_a_resumed_run",
    f"""SELECT * FROM ({CODER_SQL}) JOIN (SELECT test_id, vec[1] > 0 AS stored FROM ({'WITH ' + VECTORS_SQL} SELECT * FROM te)) USING (test_id)
WHERE linear_coder IN ({", ".join(f"'{c}'" for c in coders.ACTIVE_CODERS)}) AND NOT stored AND linear_coder <> 'KLTCoder'""".replace(
        "SELECT * FROM (", "SELECT test_id, linear_coder, t1, t2, pred_gain, mse FROM (", 1),
)
def scores_of_a_resumed_run(spark, sf):
    """Tests whose first coordinate is positive have all records already, the others that of one coder."""
    test, train, top = _ground(spark, sf, "most_influential", 2)
    chosen = top.select("test_id", "rank", "train_id", F.lit("top_k").alias("method"), F.lit("Top-2").alias("selection"))
    coder = F.explode(F.array(*[F.lit(c) for c in coders.ACTIVE_CODERS])).alias("linear_coder")
    done = test.select("test_id", F.lit("Top-2").alias("selection"), coder, (F.get("vec", F.lit(0)) > 0).alias("whole"))
    found = score_pending(chosen, train, test, done.where("whole OR linear_coder = 'KLTCoder'"))
    return found.select(
        "test_id", "linear_coder", (F.round(F.get("t", F.lit(0)), 7) + 0.0).alias("t1"), (F.round(F.get("t", F.lit(1)), 7) + 0.0).alias("t2"),
        F.round("pred_gain", 7).alias("pred_gain"), F.round("mse", 9).alias("mse"))


@query("coder_scores_of_pairs", CODER_SQL)
def coder_scores_of_pairs(spark, sf):
    """All coders on the two most influential vectors, against closed forms."""
    test, train, top = _ground(spark, sf, "most_influential", 2)
    records = coders.gram(top.withColumn("selection", F.lit("Top-2")), train, test)
    fitted = coders.fit(records, (*coders.ACTIVE_CODERS, "MSECoderL2"))
    return coders.require_complete(fitted, ["pred_gain", "mse"]).select(
        "test_id", "linear_coder", (F.round(F.get("t", F.lit(0)), 7) + 0.0).alias("t1"),
        (F.round(F.get("t", F.lit(1)), 7) + 0.0).alias("t2"), F.round("pred_gain", 7).alias("pred_gain"),
        F.round("mse", 9).alias("mse"), F.round("l1", 7).alias("l1"), F.round("l2", 7).alias("l2"),
    )


@query(
    "gram_products",
    f"""WITH {PAIR_SQL} SELECT test_id, round(k11, 8) AS k11, round(k12, 8) AS k12, round(k22, 8) AS k22,
round(b1, 8) AS b1, round(b2, 8) AS b2, round(list_sum(a1), 8) AS s1, round(list_sum(g), 8) AS sum_g FROM k""",
)
def gram_products(spark, sf):
    test, train, top = _ground(spark, sf, "most_influential", 2)
    records = coders.gram_products(coders.gram(top.withColumn("selection", F.lit("Top-2")), train, test))

    def at(name, i):
        return F.round(F.get(name, F.lit(i)), 8)

    return records.select(
        "test_id", at("gram_k", 0).alias("k11"), at("gram_k", 1).alias("k12"), at("gram_k", 3).alias("k22"),
        at("gram_b", 0).alias("b1"), at("gram_b", 1).alias("b2"), at("s", 0).alias("s1"),
        F.round("sum_g", 8).alias("sum_g"),
    )


def least_squares_sql(k: int) -> str:
    """Least-squares rest by Gram-Schmidt over the k selected vectors, one step per vector."""
    steps = [f"""o0 AS (SELECT test_id, te.vec AS g, te.vec AS rest, list(tr.vec ORDER BY rank) AS vs
FROM ({ranked_sql('inf', 'most_influential', k)}) r JOIN tr USING (train_id) JOIN te USING (test_id) GROUP BY test_id, te.vec)"""]
    for i in range(1, k + 1):
        steps.append(f"""u{i} AS (SELECT *, list_dot_product(vs[{i}], vs[{i}]) AS nn FROM o{i - 1}),
o{i} AS (SELECT test_id, g, list_transform(range(1, len(g) + 1), lambda p: rest[p] - list_dot_product(rest, vs[{i}]) / nn * vs[{i}][p]) AS rest,
  list_transform(vs, lambda w: list_transform(range(1, len(g) + 1), lambda p: w[p] - list_dot_product(w, vs[{i}]) / nn * vs[{i}][p])) AS vs FROM u{i})""")
    return f"WITH {INFLUENCE_SQL}, " + ",\n".join(steps) + f"""
SELECT test_id, round(list_aggregate(g, 'var_pop') / (list_aggregate(rest, 'var_pop') + 1e-8), 7) AS pred_gain,
round(list_dot_product(rest, rest) / len(rest), 9) AS mse FROM o{k}"""


@query("explained_share_least_squares", least_squares_sql(5))
def explained_share_least_squares(spark, sf):
    test, train = vectors(spark, sf)
    return explained_share(test, train, 5, DIGITS).where("linear_coder = 'MSECoder'").select(
        "test_id", F.round("pred_gain", 7).alias("pred_gain"), F.round("mse", 9).alias("mse")
    )


@query(
    "simplex_projection",
    f"""WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS j, unnest(embedding)::DOUBLE * 10 AS t FROM embeddings),
s AS (SELECT *, sum(t) OVER (PARTITION BY vec_id ORDER BY t DESC, j ROWS UNBOUNDED PRECEDING) AS c,
      row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, j) AS i FROM x),
tau AS (SELECT vec_id, max((c - 1) / i) AS tau FROM s GROUP BY vec_id)
SELECT vec_id, round(sum(greatest(t - tau, 0)), 9) AS total, sum((t - tau > 1e-12)::BIGINT)::BIGINT AS positive, round(max(t - tau), 9) AS largest
FROM x JOIN tau USING (vec_id) GROUP BY vec_id""",
)
def simplex_projection(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("t")
    )
    out = rows.select("vec_id", coders.project_simplex(F.col("t")).alias("p"))
    return out.select(
        "vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9).alias("total"),
        F.size(F.filter("p", lambda x: x > 1e-12)).cast("bigint").alias("positive"),
        F.round(F.array_max("p"), 9).alias("largest"),
    )


@query(
    "soft_thresholding",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS t FROM embeddings), s AS (SELECT vec_id, sum(t) AS s FROM x GROUP BY vec_id)
SELECT vec_id, round(sum(sign(t) * greatest(abs(t) - 0.1 * s, 0)), 9) + 0.0 AS total FROM x JOIN s USING (vec_id) GROUP BY vec_id""",
)
def soft_thresholding(spark, sf):
    rows = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))
    shrunk = rows.select("vec_id", coders.soft_threshold(F.col("t"), 0.1).alias("p"))
    total = F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9) + 0.0
    return shrunk.select("vec_id", total.alias("total"))


@query(
    "rebuilt_vectors",
    f"""WITH {PAIR_SQL}, t AS (SELECT *, (k22 * b1 - k12 * b2) / (k11 * k22 - k12 * k12) AS t1,
(k11 * b2 - k12 * b1) / (k11 * k22 - k12 * k12) AS t2 FROM k)
SELECT test_id, round(list_sum(a1) * t1 + list_sum(a2) * t2, 7) AS total FROM t""",
)
def rebuilt_vectors(spark, sf):
    test, train, top = _ground(spark, sf, "most_influential", 2)
    chosen = top.withColumn("selection", F.lit("Top-2"))
    fitted = coders.fit(coders.gram(chosen, train, test), ["MSECoder"])
    rebuilt = coders.reconstruction(fitted, chosen, train)
    return rebuilt.select("test_id", F.round(F.aggregate("rebuilt", F.lit(0.0), lambda a, x: a + x), 7).alias("total"))


# --- the grid ----------------------------------------------------------------------------------------

GRID_SQL = """kk AS (SELECT unnest([1, 5, 10, 25]) AS k),
sets AS (SELECT 'self' AS method, 1 AS k, 1 AS n UNION ALL SELECT 'top_k', k, 4 FROM kk UNION ALL SELECT 'random', k, 5 FROM kk
UNION ALL SELECT 'facility_location', k, 20 FROM kk UNION ALL SELECT 'divine', k, 4 FROM kk UNION ALL SELECT 'aide', k, 1 FROM kk)"""


@query(
    "grid_selection_sizes",
    f"""WITH {VECTORS_SQL}, {GRID_SQL} SELECT method, k, (n * k * (SELECT count(*) FROM te))::BIGINT AS picks,
(n * (SELECT count(*) FROM te))::BIGINT AS selections FROM sets""",
)
def grid_selection_sizes(spark, sf):
    """The whole grid of selections, counted per method and k."""
    test, train = vectors(spark, sf)
    chosen = select_all(stored_ground_sets(test, train), train, test)
    return chosen.groupBy("method", "k").agg(
        F.count("*").alias("picks"), F.sum((F.col("rank") == 1).cast("bigint")).alias("selections")
    )


@query(
    "grid_score_records",
    f"""WITH {VECTORS_SQL}, {GRID_SQL}, c AS (SELECT unnest(['MSECoderProjUSimpSparse', 'MSECoderProjUSimp', 'KLTCoder', 'MSECoder',
'MSECoderNNLSL2', 'MSECoderProjUSimpSparseSoftThresh']) AS linear_coder)
SELECT linear_coder, (SELECT sum(n) * (SELECT count(*) FROM te) FROM sets)::BIGINT AS records, true AS complete FROM c""",
)
def grid_score_records(spark, sf):
    """Every coder on every selection of the grid; no score may be missing."""
    test, train = vectors(spark, sf)
    chosen = cut_lineage(select_all(stored_ground_sets(test, train), train, test))
    scored = coders.require_complete(score_selections(chosen, train, test), ["pred_gain", "mse", "l1", "l2"])
    return scored.groupBy("linear_coder").agg(
        F.count("*").alias("records"), F.min(F.col("pred_gain") > 0).alias("complete")
    )


@query(
    "pending_settings",
    f"""WITH {VECTORS_SQL}, {GRID_SQL} SELECT method, sum(n * (SELECT count(*) FROM te) - CASE WHEN method = 'self' THEN (SELECT count(*) FROM te) ELSE 0 END)::BIGINT AS open
FROM sets GROUP BY method HAVING open > 0""",
)
def pending_settings(spark, sf):
    """Settings of every test row whose result is not stored yet; the sanity check is."""
    test, _ = vectors(spark, sf)
    grid = grids.settings_of_tests(test, grids.settings(spark))
    done = grid.where("method = 'self'")
    keys = ["test_id", "method", "sort_type", "k", "m", "lambda", "seed"]
    return pending(grid, done, keys).groupBy("method").agg(F.count("*").alias("open"))


@query("selection_relevance_of_all_coders")
def selection_relevance_of_all_coders(spark, sf):
    """Also the coders outside the active set, on the ten most helpful vectors."""
    test, train, top = _ground(spark, sf, "most_helpful", 10)
    records = coders.gram(top.withColumn("selection", F.lit("Top-10")), train, test)
    return coders.fit(records, coders.CODERS).select(
        "test_id", "linear_coder", F.round("pred_gain", 6).alias("pred_gain"), F.round("mse", 8).alias("mse"),
        F.round("cosine", 6).alias("cosine"),
    )
