import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from exselect import session
from exselect.operators import coders, greedy, ranking, scoring
from exselect.plans import grid
from exselect.plans.select_and_score import score_selections, select_all

RNG = np.random.default_rng(9)
TEST, TRAIN = RNG.normal(size=(4, 10)), RNG.normal(size=(40, 10))


def table(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} bigint, vec array<double>")


@pytest.fixture(scope="module")
def sides(spark):
    return table(spark, TEST, "test_id"), table(spark, TRAIN, "train_id")


@pytest.fixture(scope="module")
def ground(sides):
    return greedy.ground_sets(scoring.top_influence(*sides, 12, digits=9), sides[1]).cache()


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def by_group(df):
    out = {}
    for r in df.orderBy("rank").collect():
        key = (r["sort_type"], r["test_id"], r["k"], r["lambda"] if "lambda" in df.columns else None)
        out.setdefault(key, []).append(r["train_id"])
    return out


def ground_of(ground, order, test):
    rows = ground.where((F.col("sort_type") == order) & (F.col("test_id") == test)).orderBy("rank").collect()
    return [r["train_id"] for r in rows], np.array([r["score"] for r in rows]), np.array([r["vec"] for r in rows])


def slow_facility(ids, cost, sim, k, lam):
    picks, covered = [], [0.0] * len(ids)
    for _ in range(k):
        best = None
        for j in range(len(ids)):
            if j in picks:
                continue
            gain = sum(max(sim[i][j] - covered[i], 0.0) for i in range(len(ids)))
            value = (gain + 1) ** lam / cost[j] ** (1 - lam)
            if best is None or value > best[0] + 1e-12:
                best = (value, j)
        picks.append(best[1])
        covered = [max(c, sim[i][best[1]]) for i, c in enumerate(covered)]
    return [ids[j] for j in picks]


def test_facility_location_equals_plain_loops(ground):
    found = by_group(greedy.facility_location(ground, [1, 3, 6], [0.0, 0.5, 1.0], 12))
    assert len(found) == 4 * 4 * 3 * 3
    for order, test in itertools.product(("most_helpful", "most_influential"), range(4)):
        ids, score, vec = ground_of(ground, order, test)
        raw = score if order == "most_helpful" else -np.abs(score)
        cost = 1 + (raw - raw.min()) / (raw.max() - raw.min()) * 11
        for lam, k in itertools.product((0.0, 0.5, 1.0), (1, 3, 6)):
            assert found[order, test, k, lam] == slow_facility(ids, cost, cosines(vec), k, lam)
        assert found[order, test, 6, 0.0] == ids[:6]


def test_divine_is_the_widest_gamma(ground):
    found = by_group(greedy.divine(ground, [1, 4]))
    for order, test in itertools.product(scoring.SORT_TYPES, range(4)):
        ids, score, vec = ground_of(ground, order, test)
        distance = 1 - cosines(vec)
        np.fill_diagonal(distance, 0)
        sim = distance.max() - distance
        cost = greedy.COSTS[order](score)
        importance = (cost.max() - cost) / (cost.max() - cost.min())
        best = None
        for gamma in np.logspace(-4, 5, 20):
            picks = []
            for _ in range(4):
                gains = [-np.inf if i in picks else importance[i] - gamma * (sim[i, i] + 2 * sum(sim[i, j] for j in picks)) for i in range(12)]
                picks.append(int(np.argmax(gains)))
            spread = distance[np.ix_(picks, picks)].mean()
            if best is None or spread > best[0] + 1e-9:
                best = (spread, picks)
        assert found[order, test, 4, None] == [ids[i] for i in best[1]]
        assert found[order, test, 1, None] == ids[:1]


def test_aide_runs_once_per_k(ground, sides):
    found = by_group(greedy.aide(ground, sides[0], [1, 2, 5]))
    assert {key[0] for key in found} == {"most_influential"}
    for test, k in itertools.product(range(4), (1, 2, 5)):
        ids, score, vec = ground_of(ground, "most_influential", test)
        query = TEST[test]
        close = vec @ query / (np.linalg.norm(vec, axis=1) * np.linalg.norm(query) + 1e-10)
        distance = 1 - cosines(vec)
        np.fill_diagonal(distance, 0)
        sim = distance.max() - distance
        factor = 1 if k == 1 else 1 - 1 / (k * (k - 1))
        picks, covered = [], np.zeros(12)
        for _ in range(k):
            value = [-np.inf if j in picks else 0.2 * abs(score[j]) + 0.8 * close[j] + 0.5 * factor * np.maximum(sim[:, j] - covered, 0).sum() for j in range(12)]
            picks.append(int(np.argmax(value)))
            covered = np.maximum(covered, sim[:, picks[-1]])
        assert found["most_influential", test, k, None] == [ids[j] for j in picks]


def test_all_methods_equal_the_single_ones(ground, sides):
    both = greedy.all_methods(ground, sides[0], [1, 3], [0.0, 0.5], 12)
    keys = ["sort_type", "test_id", "k", "rank", "train_id"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    fl = both.where("method = 'facility_location'").select(*keys, "parameter")
    assert rows(fl) == rows(greedy.facility_location(ground, [1, 3], [0.0, 0.5], 12).select(*keys, "lambda"))
    assert rows(both.where("method = 'divine'").select(*keys, "parameter")) == rows(greedy.divine(ground, [1, 3]).select(*keys, "gamma"))
    assert rows(both.where("method = 'aide'").select(*keys)) == rows(greedy.aide(ground, sides[0], [1, 3]).select(*keys))


def test_constant_cost_and_copies(spark):
    top = spark.createDataFrame([("most_helpful", 0, i + 1, i, 1.0) for i in range(5)], "sort_type string, test_id bigint, rank int, train_id bigint, score double")
    vec = table(spark, np.ones((5, 3)), "train_id")
    picks = greedy.facility_location(greedy.ground_sets(top, vec), [5], [0.5], 5, digits=9).orderBy("rank")
    assert [r["train_id"] for r in picks.collect()] == [0, 1, 2, 3, 4]


def test_nearest_ground_point_euclidean(ground):
    points = ground.where("sort_type = 'most_helpful' AND rank <= 3")
    found = greedy.nearest_ground_point(ground.where("sort_type = 'most_influential'"), points, "euclidean").collect()
    assert len(found) == 12
    for r in found:
        ids, _, vec = ground_of(ground, "most_influential", r["test_id"])
        distance = np.linalg.norm(vec - TRAIN[r["train_id"]], axis=1)
        assert r["distance"] == pytest.approx(distance.min(), abs=1e-6)
        assert distance[ids.index(r["nearest_id"])] == pytest.approx(distance.min(), abs=1e-9)


def test_random_k_is_shared_by_all_tests(sides):
    drawn = ranking.random_k(sides[1], sides[0], 6, 3).collect()
    per_test = {t: [r["train_id"] for r in sorted(drawn, key=lambda r: r["rank"]) if r["test_id"] == t] for t in range(4)}
    assert len(set(map(tuple, per_test.values()))) == 1 and len(set(per_test[0])) == 6
    other = ranking.random_k(sides[1], sides[0], 6, 9).where("test_id = 0").orderBy("rank").collect()
    assert [r["train_id"] for r in other] != per_test[0]


def test_min_max_of_a_constant_is_the_lower_bound(spark):
    rows = spark.createDataFrame([(0, 3.0), (0, 3.0), (1, 1.0), (1, 5.0)], "g int, x double")
    got = sorted(r["y"] for r in ranking.min_max(rows, ["g"], "x", 1, 2, "y").collect())
    assert got == [1.0, 1.0, 1.0, 2.0]


# --- coders ------------------------------------------------------------------------------------------

def fitted(spark, a, g, names):
    train, test = table(spark, a, "train_id"), table(spark, [g], "test_id")
    chosen = spark.createDataFrame([(0, "s", i + 1, i) for i in range(len(a))], "test_id bigint, selection string, rank int, train_id bigint")
    rows = coders.fit(coders.gram(chosen, train, test), names).collect()
    return {r["linear_coder"]: r for r in rows}


def direct_scores(a, g, t):
    rest = g - a.T @ t
    return g.var() / (rest.var() + 1e-8), np.mean(rest ** 2), np.abs(t).sum(), np.square(t).sum()


def check_scores(a, g, found):
    for r in found.values():
        got = (r["pred_gain"], r["mse"], r["l1"], r["l2"])
        np.testing.assert_allclose(got, direct_scores(a, g, np.array(r["t"])), rtol=1e-6, atol=1e-10)


def test_every_coder_and_its_scores(spark):
    a, g = TRAIN[:6], TEST[0] + 0.3 * TRAIN[:6].sum(axis=0)
    found = fitted(spark, a, g, coders.CODERS)
    check_scores(a, g, found)
    t = {name: np.array(r["t"]) for name, r in found.items()}
    least = np.linalg.pinv(a.T) @ g
    k, b = a @ a.T, a @ g
    np.testing.assert_allclose(t["MSECoder"], least, rtol=1e-8)
    np.testing.assert_allclose(t["MSECoderL2"], np.linalg.solve(k + 0.7 * np.eye(6), b), rtol=1e-8)
    simplex = t["MSECoderProjUSimp"]
    assert simplex.min() >= 0 and simplex.sum() == pytest.approx(1)
    # The projection is the nearest point: no other point of the simplex comes closer.
    for _ in range(200):
        other = RNG.dirichlet(np.ones(6))
        assert np.linalg.norm(simplex - least) <= np.linalg.norm(other - least) + 1e-9
    sparse = t["MSECoderProjUSimpSparse"]
    assert np.count_nonzero(sparse) <= 3 and sparse.sum() == pytest.approx(1)
    assert t["MSECoderProjUSimpSparseSoftThresh"].sum() == pytest.approx(1)
    # Non-negative ridge: optimality conditions of the least-squares problem over t >= 0.
    m = k + 0.7 * np.eye(6)
    slope = m.T @ (m @ t["MSECoderNNLSL2"] - b)
    assert t["MSECoderNNLSL2"].min() >= 0 and slope.min() > -1e-7 and abs(slope @ t["MSECoderNNLSL2"]) < 1e-6
    centred = a - a.mean(axis=0)
    _, sigma, vh = np.linalg.svd(centred, full_matrices=False)
    basis = vh[sigma > 1e-10]
    np.testing.assert_allclose(t["KLTCoder"], np.linalg.pinv(a.T) @ (basis.T @ (basis @ g)), rtol=1e-7, atol=1e-10)
    for name, weights in (("MSECoderElasticNet", 0.0), ("MSECoderLemon", 0.5)):
        def loss(x):
            soft = np.log1p(np.exp(-x))
            return np.mean((g - a.T @ x) ** 2) + 0.3 * np.abs(x).sum() + 0.7 * (x @ x) + weights * (soft @ soft)
        best = loss(t[name])
        assert all(loss(t[name] + 1e-3 * RNG.normal(size=6)) >= best - 1e-9 for _ in range(100))
    assert all(found["MSECoder"]["mse"] <= r["mse"] + 1e-12 for r in found.values())
    assert all(found["CosineCoder"]["cosine"] >= r["cosine"] - 1e-9 for r in found.values())


def test_singular_and_wide_selections(spark):
    copies = np.vstack([TRAIN[0], TRAIN[0], np.zeros(10)])
    found = fitted(spark, copies, TEST[0], coders.ACTIVE_CODERS)
    check_scores(copies, TEST[0], found)
    np.testing.assert_allclose(found["MSECoder"]["t"], np.linalg.pinv(copies.T) @ TEST[0], atol=1e-9)
    many = TRAIN[:25]  # more vectors than dimensions
    found = fitted(spark, many, TEST[1], coders.ACTIVE_CODERS)
    check_scores(many, TEST[1], found)
    assert found["MSECoder"]["mse"] < 1e-12


def test_single_vector(spark):
    found = fitted(spark, TEST[:1], TEST[0], coders.ACTIVE_CODERS)
    assert found["MSECoder"]["t"] == pytest.approx([1.0]) and found["KLTCoder"]["t"] == pytest.approx([0.0])
    assert found["MSECoder"]["pred_gain"] == pytest.approx(TEST[0].var() / 1e-8, rel=1e-6)


def test_nonnegative_by_both_ways():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        a = rng.normal(size=(8, 12))
        m, b = a @ a.T + 0.7 * np.eye(8), a @ rng.normal(size=12)
        np.testing.assert_allclose(coders.nonnegative(m, b), coders._active_set(m, b), atol=1e-7)


def test_native_projections_equal_numpy(spark):
    rows = [(i, [float(x) for x in RNG.normal(size=5)]) for i in range(30)] + [(30, [0.9, 0.4, -0.2])]
    df = spark.createDataFrame(rows, "id int, t array<double>").select(
        "id", "t", coders.project_simplex(F.col("t")).alias("p"), coders.soft_threshold(F.col("t")).alias("s"))
    for r in df.collect():
        np.testing.assert_allclose(r["p"], coders.simplex(np.array(r["t"])), atol=1e-12)
        np.testing.assert_allclose(r["s"], coders.shrink(np.array(r["t"])), atol=1e-12)


def test_missing_values_fail(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),)], "pred_gain double")
    with pytest.raises(Exception, match="missing values"):
        coders.require_complete(rows, ["pred_gain"]).collect()


# --- the grid ----------------------------------------------------------------------------------------

def test_grid_sizes(spark):
    assert grid.settings(spark).count() == 137
    assert grid.settings(spark, signed=False).count() == 81
    full = grid.full_grid(spark, ["a", "b", "c"], ["e1", "e2"], ["e3"])
    assert full.count() == 1065 and full.distinct().count() == 1065
    assert grid.settings(spark, m=10).where("k > m").count() == 0


def test_every_setting_is_selected_and_scored(spark, sides):
    test, train = sides
    top = scoring.top_influence(test, train, 12, digits=9)
    chosen = select_all(top, train, test, ks=(1, 3), lambdas=(0.0, 1.0), seeds=(42, 10), m=12).cache()
    wanted = grid.settings(spark, (1, 3), (0.0, 1.0), (42, 10), 12)
    keys = ["method", "sort_type", "k", "m", "lambda", "seed", "selection"]
    assert sorted(map(str, chosen.select(*keys).distinct().collect())) == sorted(map(str, wanted.select(*keys).collect()))
    sizes = chosen.groupBy("test_id", "selection").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    assert sizes.where("n <> k").count() == 0
    scored = score_selections(chosen, train, test, ["MSECoder"])
    assert scored.count() == 4 * wanted.count()
    own = scored.where("selection LIKE '%sanity%'").collect()
    assert all(r["t"] == pytest.approx([1.0]) for r in own)
    assert scored.agg(F.max("pred_gain")).first()[0] == max(r["pred_gain"] for r in own)


class _Reduced:
    """What the nets read of a problem."""

    def __init__(self, r, c):
        self.k, self.b, self.width = r.T @ r, r.T @ c, len(c)


@pytest.mark.parametrize("l2", [0.7, 0.01])
def test_nets_end_where_the_optimality_conditions_hold(l2):
    rng = np.random.default_rng(9)
    for trial in range(120):
        size, width, l1 = rng.integers(1, 26), rng.choice([3, 40, 200]), rng.choice([0.0, 0.001, 0.05, 0.3, 2.0])
        r = rng.normal(size=(width, size)) * rng.choice([0.1, 1, 5])
        if trial % 5 == 0 and size > 1:
            r[:, 1] = r[:, 0]
        p = _Reduced(r, rng.normal(size=width) * 3 + r @ rng.normal(size=size))
        g, h, _ = coders._net(p, l2)
        scale = max(1.0, np.abs(g).max(), np.abs(h).max())
        t = coders.elastic_net(p, l1, l2)
        assert coders.violation(g, h, l1, t) <= 1e-7 * scale
        u = coders.penalised_net(p, l1, l2, 0.5)
        assert coders.violation(g, h, l1, u, coders.softplus_square(u, 0.5)[1]) <= 1e-7 * scale
        loss = lambda x: x @ g @ x - 2 * h @ x + l1 * np.abs(x).sum()
        assert all(loss(t) <= loss(t + rng.normal(size=size) * s) for s in (1e-4, 1e-2, 1) for _ in range(5))


def test_path_drops_entries_on_its_way():
    """A fixed problem on which an entry enters, leaves and stays out: the end equals an exhaustive search over supports and signs."""
    import itertools
    rng = np.random.default_rng(0)
    dropped = 0
    for _ in range(200):
        base = rng.normal(size=(4, 4))
        g = base @ base.T + 0.01 * np.eye(4)
        h = rng.normal(size=4)
        l1 = 0.05
        best, found = np.inf, None
        for signs in itertools.product([-1, 0, 1], repeat=4):
            s = np.array(signs)
            on = s != 0
            t = np.zeros(4)
            if on.any():
                t[on] = np.linalg.solve(g[np.ix_(on, on)], h[on] - l1 * s[on] / 2)
            if (t * s >= 0).all() and (loss := t @ g @ t - 2 * h @ t + l1 * np.abs(t).sum()) < best:
                best, found = loss, t
        np.testing.assert_allclose(coders.lasso_path(g, h, l1), found, atol=1e-8)
        dropped += (coders.lasso_path(g, h, 2 * l1) != 0).sum() > (found != 0).sum()
    assert dropped


@pytest.mark.parametrize("m,k", [(100, 25), (5000, 25)])
def test_lazy_greedy_picks_are_plain_greedy_picks(m, k, monkeypatch):
    rng = np.random.default_rng(m)
    base = rng.normal(size=(m, 6))
    base[m // 2:] = base[:m - m // 2]  # ties
    base /= np.linalg.norm(base, axis=1)[:, None]
    similarity, cost, fixed = base @ base.T, rng.uniform(1, m, m).round(2), rng.random(m).round(2)
    lambdas, ks = [0.0, 0.5, 1.0], [1, 2, k]

    def plain(value):
        covered, picks = np.zeros(m), []
        for _ in range(k):
            values = np.round(value(np.maximum(similarity - covered[:, None], 0.0).sum(axis=0)), 9)
            values[picks] = -np.inf
            picks.append(int(values.argmax()))
            covered = np.maximum(covered, similarity[:, picks[-1]])
        return picks

    monkeypatch.setattr(greedy, "LAZY_FROM", 1)
    for lam, got in zip(lambdas, greedy.facility_picks(similarity, cost, k, lambdas, 9)):
        assert got.tolist() == plain(lambda gain, lam=lam: (gain + 1) ** lam / cost ** (1 - lam))
    got = greedy.aide_picks(similarity, fixed, fixed, ks, 0.2, 0.8, 0.5, 9)
    for n, picks in zip(ks, got):
        f = 1.0 if n == 1 else 1 - 1 / (n * (n - 1))
        assert picks.tolist() == plain(lambda gain, f=f: 0.2 * fixed + 0.8 * fixed + 0.5 * f * gain)


def test_resumed_scores_are_the_missing_ones(spark):
    """Ids of both sides may meet, negative ones included; partly stored selections give what is missing."""
    from exselect.plans.select_and_score import score_pending, score_selections
    rng = np.random.default_rng(2)
    ids = [-2, -1, 0, 1, 2, 3]
    train = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in ids], "train_id bigint, vec array<double>")
    test = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in ids[:4]], "test_id bigint, vec array<double>")
    chosen = [(t, "Self", 1, t, "self") for t in ids[:4]] + [(t, "Top-2", r, i, "top_k") for t in ids[:4] for r, i in ((1, 3), (2, -t))]
    chosen = spark.createDataFrame(chosen, "test_id bigint, selection string, rank int, train_id bigint, method string")
    names = ["MSECoder", "MSECoderProjUSimp"]
    every = score_selections(chosen, train, test, names)
    rows = {(r.test_id, r.selection, r.linear_coder): [round(x, 9) for x in r.t] for r in every.collect()}
    assert len(rows) == 16 and all(rows[t, "Self", c] == [1.0] for t in ids[:4] for c in names)
    for stored in ("false", "true", "test_id < 0", "linear_coder = 'MSECoder'", "selection = 'Self' OR (linear_coder = 'MSECoder' AND test_id = 1)"):
        left = {(r.test_id, r.selection, r.linear_coder): [round(x, 9) for x in r.t] for r in score_pending(chosen, train, test, every.where(stored), names).collect()}
        done = {(r.test_id, r.selection, r.linear_coder) for r in every.where(stored).collect()}
        assert left == {k: v for k, v in rows.items() if k not in done}


def test_random_costs_share_the_drawn_pairs_only(spark):
    """The pair table is thinned out where it lies; a drawn pair without a score has no cost."""
    drawn = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 7), (None, 1, 7)], "test_id bigint, rank int, train_id bigint")
    table = spark.createDataFrame([(1, 7, 0.5), (1, 9, 0.1), (2, 7, -1.0), (2, 7, -2.0), (None, 7, 3.0)], "test_id bigint, train_id bigint, score double")
    found = ranking.random_costs(drawn, table)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found.select("test_id", "rank", "train_id", "cost").collect()), key=key) == sorted(
        [(1, 1, 7, 0.5), (1, 2, 8, None), (2, 1, 7, -1.0), (2, 1, 7, -2.0), (None, 1, 7, None)], key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "strategy=broadcast" in plan


def test_random_costs_score_the_drawn_rows_only(spark, sides):
    """Of a pair table in the making only drawn train rows are scored, with repeated ids on both sides; the costs are those of the whole table."""
    test, train = sides
    test, train = test.union(test.where("test_id = 1")), train.union(train.where("train_id in (4, 7)"))
    drawn = spark.createDataFrame([(t, r, i) for t in (0, 1, 3, 9) for r, i in ((1, 7), (2, 30 + t), (3, 99))] + [(2, 1, None)], "test_id bigint, rank int, train_id bigint")
    made = scoring.dot_influence(test, train, digits=9)
    found = ranking.random_costs(drawn, made)
    stored = ranking.random_costs(drawn, scoring.dot_influence(test, train, digits=9).localCheckpoint())
    assert sorted(map(str, found.collect())) == sorted(map(str, stored.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan[:plan.index("MapInArrow")] and "Join LeftSemi" in plan[plan.index("MapInArrow"):]


def test_equal_selections_are_fitted_once(spark, sides):
    """Settings that pick the same rows in the same order share a fit; another order or test has its own."""
    test, train = sides
    rows = [(t, s, n, i) for t in (0, 1) for s, ids in (("a", [3, 5, 9]), ("b", [3, 5, 9]), ("c", [5, 3, 9]), ("d", [3])) for n, i in enumerate(ids, 1)]
    chosen = spark.createDataFrame(rows, "test_id bigint, selection string, rank int, train_id bigint")
    got = {(r.test_id, r.selection, r.linear_coder): r for r in coders.fit(coders.gram(chosen, train, test), coders.CODERS).collect()}
    assert len(got) == 2 * 4 * len(coders.CODERS)
    for (t, s, name), r in got.items():
        a, g = TRAIN[{"a": [3, 5, 9], "b": [3, 5, 9], "c": [5, 3, 9], "d": [3]}[s]].T, TEST[t]
        off = g - a @ np.array(r.t)
        np.testing.assert_allclose([r.mse, r.l1, r.l2], [off @ off / 10, np.abs(r.t).sum(), np.square(r.t).sum()], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(r.pred_gain, g.var() / (off.var() + 1e-8), rtol=1e-9)
        whole = np.linalg.norm(g) * np.linalg.norm(a @ np.array(r.t))
        assert r.cosine == pytest.approx(g @ a @ np.array(r.t) / whole if whole > 1e-12 else 0.0, abs=1e-9)
        if name == "MSECoder":
            np.testing.assert_allclose(r.t, np.linalg.lstsq(a, g, rcond=None)[0], rtol=1e-8)
    p = coders.Problem(np.eye(2), np.ones(2), 4)
    ts, marks = coders._fitted(("MSECoder", "KLTCoder"), p, np.ones(2), 2.0, 1.0, 0.0)
    assert ts.shape == (2, 2) and marks.shape == (2, 5)


def test_stacked_records_equal_single_solves(monkeypatch):
    """Factors and solutions of many selections at once: prefixes, repeated and zero vectors, more rows than the width, a query that is picked."""
    monkeypatch.setattr(coders, "STACK_VALUES", 600)
    rng = np.random.default_rng(21)
    names = tuple(coders.CODERS)
    vectors = rng.normal(size=(60, 16)) + 0.5
    vectors[3], vectors[8] = vectors[5], 0.0
    for g in (rng.normal(size=16), vectors[9].copy()):
        chosen = [tuple(rng.choice(np.arange(6, 60), size, replace=False).tolist()) for size in (1, 2, 5, 5, 9, 9, 20) for _ in range(4)] + [(3, 5, 7), (8, 1), (8,), (9, 4)]
        chosen = list(dict.fromkeys(chosen + [ids[:size] for ids in chosen for size in (1, 2, 5) if len(ids) > size]))
        known = coders._factored(vectors, g, {ids: list(ids) for ids in chosen})
        assert list(known) != chosen and set(known) == set(chosen)
        for size in {len(ids) for ids in chosen}:
            some = [known[ids] for ids in chosen if len(ids) == size]
            r, c, s = (np.array([record[0][at] for record in some]) for at in range(3))
            width, _, sum_g, var_g, rest = np.array([record[1] for record in some]).T
            rows = min(16, size)
            ts, marks = coders._fitted_stack(names, r.reshape(-1, rows, size), c, s, width, sum_g, var_g, rest)
            for at, ids in enumerate(ids for ids in chosen if len(ids) == size):
                a = vectors[list(ids)].T
                q, triangle = np.linalg.qr(a)
                off = g - q @ (q.T @ g)
                np.testing.assert_allclose(r[at].reshape(rows, size).T @ c[at], a.T @ g, atol=1e-10)
                assert rest[at] == pytest.approx(off @ off, abs=1e-10)
                t, mark = coders._fitted(names, coders.Problem(triangle, q.T @ g, 16), a.sum(axis=0), g.sum(), g.var(), off @ off)
                if 3 not in ids:  # of equal vectors either may be taken
                    np.testing.assert_allclose(ts[at], t, rtol=1e-6, atol=1e-8)
                np.testing.assert_allclose(marks[at][:, 1:], mark[:, 1:], rtol=1e-6, atol=1e-7)


def test_a_checkpoint_is_not_written_again(spark, sides, monkeypatch):
    """Columns of a checkpoint are read as they are; anything else is cut from its plan."""
    test, train = sides
    rows = [(t, "a", n, i) for t in (0, 1) for n, i in enumerate((3, 5), 1)]
    chosen = spark.createDataFrame(rows, "test_id bigint, selection string, rank int, train_id bigint")
    cut = session.cut_lineage(chosen)
    assert session.is_cut(cut) and session.is_cut(cut.select("test_id", (F.col("train_id") * 2).alias("x")))
    assert not any(map(session.is_cut, (chosen, cut.where("rank = 1"), cut.withColumn("x", F.rand()), cut.unionByName(cut), cut.distinct())))
    written = []
    monkeypatch.setattr(coders, "cut_lineage", lambda df: written.append(df) or session.cut_lineage(df))
    from_cut = coders.gram(cut, train, test).collect()
    assert not written and sorted(from_cut) == sorted(coders.gram(chosen, train, test).collect()) and len(written) == 1


def test_query_vectors_come_as_rows_of_the_ground_sets(spark, sides, ground):
    """No join meets the vectors; a repeated query brings the first row again, a query without a ground set has no picks."""
    test, _ = sides
    more = test.where("test_id < 2").union(test.where("test_id = 1")).union(spark.createDataFrame([(77, [1.0] * 10)], "test_id bigint, vec array<double>"))
    left = ground.where("test_id < 2 AND sort_type IN ('most_influential', 'most_harmful')")
    found = greedy.all_methods(left, more, [1, 3], [0.5], 12, digits=9)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r["method"], r["sort_type"], r["test_id"], r["k"]), []).append(r["train_id"])
    assert len(got) == 2 * 2 * 2 * 2 + 2 * 2
    joined = left.join(more.select("test_id", F.lit(1).alias("rank"), F.col("vec").alias("query")), ["test_id", "rank"], "left")
    for (method, order, t, k), ids in got.items():
        rows = sorted(joined.where((F.col("sort_type") == order) & (F.col("test_id") == t)).collect(), key=lambda r: r["rank"])
        assert len(rows) == 12 + t
        vec, score = np.array([r["vec"] for r in rows]), np.array([r["score"] for r in rows])
        query, cosine = TEST[t], greedy.cosine_similarity(vec)
        distance = greedy.cosine_distance(cosine)
        if method == "facility_location":
            picks = greedy.facility_picks(cosine, greedy.scaled(greedy.COSTS[order](score), 1.0, 12), 3, [0.5], 9)[0][:k]
        elif method == "aide":
            closeness = vec @ query / (np.linalg.norm(vec, axis=1) * np.linalg.norm(query) + 1e-10)
            picks = greedy.aide_picks(distance.max() - distance, np.abs(score), closeness, [k], 0.2, 0.8, 0.5, 9)[0]
        else:
            continue
        assert ids == [rows[at]["train_id"] for at in picks[:k]]
    assert "Join" not in greedy.aide(spark.createDataFrame(left.rdd, left.schema), more, [1])._jdf.queryExecution().optimizedPlan().toString()


def test_gains_follow_what_is_covered():
    """Gains kept up to date equal those worked out anew, with copies and a zero vector, for runs that pick differently."""
    rng = np.random.default_rng(31)
    vectors = rng.normal(size=(30, 6))
    vectors[4], vectors[9] = vectors[2], 0.0
    similarity = greedy.cosine_similarity(vectors)
    coverage, covered = greedy._Coverage(similarity, 3), np.zeros((3, 30))
    for _ in range(12):
        want = np.maximum(similarity[None] - covered[:, :, None], 0.0).sum(axis=1)
        np.testing.assert_allclose(coverage.gain(), want, atol=1e-12)
        best = rng.integers(0, 30, 3)
        coverage.take(best)
        covered = np.maximum(covered, similarity[:, best].T)
