import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exselect.operators import analytics, checks, stats, validation

RNG = np.random.default_rng(3)


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module")
def values(spark):
    """Three groups; one value holds a third of all rows."""
    x = np.where(RNG.random(900) < 0.34, 1.5, RNG.normal(size=900).round(1))
    y = (x + RNG.normal(size=900)).round(1)
    g = RNG.integers(0, 3, 900)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)]
    return rows, spark.createDataFrame(rows + [(0, None, 1.0), (1, float("nan"), 2.0)], "g int, x double, y double").repartition(4)


@pytest.mark.parametrize("per_bucket", [10 ** 6, 40])
def test_spearman(values, per_bucket, monkeypatch):
    rows, df = values
    if per_bucket == 40:  # buckets and the hot-value join
        monkeypatch.setattr(stats, "ROWS_PER_BUCKET", 0)
        monkeypatch.setattr(stats, "HOT_SHARE", 20)
    got = {r["g"]: (r["rho"], r["n"]) for r in stats.spearman(df, ["g"], "x", "y", per_bucket).collect()}
    for g in range(3):
        x, y = np.array([(a, b) for k, a, b in rows if k == g]).T
        assert got[g][1] == len(x)
        assert got[g][0] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-12)
    x, y = np.array([(a, b) for _, a, b in rows]).T
    whole = stats.spearman(df, [], "x", "y", per_bucket).first()
    assert whole["rho"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-12) and whole["n"] == 900


def test_spearman_edge_groups(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 3.0), (3, 1.0, 5.0), (3, 2.0, 9.0)], "g int, x double, y double")
    assert {r["g"]: r["rho"] for r in stats.spearman(df, ["g"], "x", "y").collect()} == {1: None, 2: None, 3: 1.0}


@pytest.mark.parametrize("per_bucket", [10 ** 6, 25])
def test_wilcoxon(values, per_bucket):
    rows, df = values
    d = np.array([a - b for _, a, b in rows])
    d = d[d != 0]
    r = ranks(np.abs(d))
    plus, n = r[d > 0].sum(), len(d)
    _, ties = np.unique(np.abs(d), return_counts=True)
    z = (plus - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - (ties ** 3 - ties).sum() / 2) / 24)
    got = stats.wilcoxon(df, "x", "y", per_bucket=per_bucket).first()
    assert got["n"] == n and got["w_plus"] == pytest.approx(plus)
    assert got["z"] == pytest.approx(z, abs=1e-9) and got["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-12)


def test_paired_t(values):
    rows, df = values
    d = np.array([a - b for _, a, b in rows])
    got = stats.paired_t(df, "x", "y").first()
    assert got["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
    # Table values of the t distribution.
    assert stats.student_upper(1.812, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.student_upper(-1.812, 10) == pytest.approx(0.95, abs=1e-4)
    assert stats.student_upper(2.0, 1) == pytest.approx(0.5 - math.atan(2.0) / math.pi, abs=1e-10)
    assert stats.student_upper(1.96, 10000) == pytest.approx(0.025, abs=2e-4)
    assert stats.student_upper(0.0, 5) == pytest.approx(0.5)


@pytest.mark.parametrize("per_bucket", [10 ** 6, 30])
def test_percentiles(values, per_bucket):
    rows, df = values
    x = [a for _, a, _ in rows]
    shares = [0.0, 0.05, 0.25, 0.5, 0.913, 1.0]
    np.testing.assert_allclose(stats.percentiles(df, "x", shares, per_bucket), np.quantile(x, shares), atol=1e-12)
    kept = stats.percentile_filter(df.where("x IS NOT NULL AND NOT isnan(x)"), "x", 0.1, 0.9)
    low, high = np.quantile(x, [0.1, 0.9])
    assert kept.count() == sum(low <= v <= high for v in x)


def test_fraction_larger(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (2.0, 1.0), (float("nan"), 1.0), (None, 1.0), (1.0, 1.0)], "a double, b double")
    assert stats.fraction_larger(df, "a", "b").first()[0] == 50.0


def test_fisher_z(spark):
    df = spark.createDataFrame([("e", "0.0", -0.2, 103), ("e", "0.5", -0.6, 103), ("e", "1.0", 0.1, 103)], "e string, cat string, rho double, n bigint")
    up = {r["cat"]: r for r in stats.fisher_z(df, ["e"], "cat", "0.0").collect()}
    z = (math.atanh(-0.2) - math.atanh(-0.6)) / math.sqrt(0.02)
    assert up["0.5"]["z_stat"] == pytest.approx(z) and up["0.5"]["significant"] and not up["1.0"]["significant"]
    low = stats.fisher_z(df, ["e"], "cat", "0.0", tail="lower")
    assert stats.significant_categories(low, "e", "cat").first()["categories"] == "1.0"


def test_reliability_bins(spark):
    score = np.concatenate([[0.01, 100.0], 10 ** RNG.uniform(-2, 2, 500)])
    outcome = RNG.normal(size=502)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(score, outcome)], "s double, o double")
    got = {r["bin"]: r for r in stats.reliability_bins(df, "s", "o", 20, threshold=0.3).collect()}
    edges = np.logspace(-2, 2, 21)
    place = np.maximum(np.searchsorted(edges, score, side="left") - 1, 0)
    place = np.minimum(place, 19)
    assert sum(r["n"] for r in got.values()) == 502
    for b in range(20):
        inside = place == b
        assert got[b]["n"] == inside.sum() and got[b]["mean_score"] == pytest.approx(score[inside].mean())
        assert got[b]["accuracy"] == pytest.approx(((score > 1) == (outcome > 0.3))[inside].mean())


def test_hist2d(values):
    rows, df = values
    x, y = np.array([(a, b) for _, a, b in rows]).T
    want, _, _ = np.histogram2d(x, y, bins=13)
    got = np.zeros((13, 13))
    cells = stats.hist2d(df, "x", "y", 13)
    for r in cells.collect():
        got[r["bx"], r["by"]] = r["n"]
    # Values on an inner edge may fall on either side of it by rounding; the totals may not differ.
    assert got.sum() == want.sum() and np.abs(got - want).sum() <= 0.02 * want.sum()
    assert stats.marginals(cells).groupBy("axis").sum("n").collect()[0][1] == 900


def test_divergences(spark):
    p, q = RNG.dirichlet(np.ones(5), 6), RNG.dirichlet(np.ones(5), 6)
    p[0, 0], q[1] = 0.0, p[1]
    rows = [(i // 3, i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(p, q))]
    df = spark.createDataFrame(rows, "doc_id int, pos int, p_before array<double>, p_after array<double>")

    def kl(a, b):
        return sum(x * (math.log(x) - math.log(y + 1e-12)) for x, y in zip(a, b) if x > 0)

    m = (p + q) / 2
    published = [0.5 * kl(c, a) + 0.5 * kl(c, b) for a, b, c in zip(p, q, m)]
    textbook = [0.5 * kl(a, c) + 0.5 * kl(b, c) for a, b, c in zip(p, q, m)]
    got = {r["doc_id"]: r for r in validation.divergences(df).collect()}
    for doc in (0, 1):
        assert got[doc]["jsd"] == pytest.approx(np.mean(published[3 * doc:3 * doc + 3]))
        assert got[doc]["kld"] == pytest.approx(np.mean([kl(a, b) for a, b in zip(p, q)][3 * doc:3 * doc + 3]))
    standard = {r["doc_id"]: r["jsd"] for r in validation.jsd(df, "standard").collect()}
    assert standard[1] == pytest.approx(np.mean(textbook[3:])) and abs(published[1]) < 1e-9
    soft = df.select("pos", validation.softmax("p_before").alias("s")).orderBy("pos").collect()
    np.testing.assert_allclose(soft[2]["s"], np.exp(p[2]) / np.exp(p[2]).sum())


def test_log_p(spark):
    df = spark.createDataFrame([(1, -1.0, -0.5), (1, -2.0, -1.0), (2, -3.0, -4.0)], "doc_id int, log_p_before double, log_p_after double")
    assert {r["doc_id"]: r["delta_log_p"] for r in validation.delta_log_p(df).collect()} == {1: 1.5, 2: -1.0}
    assert {r["doc_id"]: r["log_p"] for r in validation.document_log_p(df, "log_p_after").collect()} == {1: -1.5, 2: -4.0}


def test_checks(spark):
    left = spark.createDataFrame([("a", "m", "e"), ("a", "m", "e"), ("b", "m", "e")], "explanation_type string, model string, estimator string")
    right = left.where("explanation_type = 'a'")
    assert [tuple(r) for r in checks.missing_settings(left, right).collect()] == [("b", "m", "e")]
    assert sorted(map(tuple, checks.missing_by_column(checks.missing_settings(left, right)).collect())) == [
        ("estimator", "e"), ("explanation_type", "b"), ("model", "m")]
    assert [tuple(r) for r in checks.incomplete_groups(left, checks.SETTING_KEYS, 2).collect()] == [("b", "m", "e", 1)]
    assert checks.require_settings(left, 2).count() == 1
    with pytest.raises(Exception, match="expected 3 settings"):
        checks.require_settings(left, 3).collect()
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (1.0, float("nan"))], "a double, b double")
    assert checks.both_present(df, ["a", "b"]).count() == 1


def record(text, coder, gain, model="m", estimator="LESSEstimator: x", doc=0):
    return (text, model, estimator, doc, "d", "train", "d", "test", coder, gain, 0.1, 1.0, 1.0, [0.5, 0.0, -0.5, 1.0])


FIELDS = ("explanation_type string, model string, estimator string, document_idx bigint, train_dataset string, train_split string, "
          "test_dataset string, test_split string, linear_coder string, pred_gain double, mse double, l1 double, l2 double, t array<double>")
ABS = "most influential (scores with largest absolute value)"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record(f"Top-5 {ABS}", "C", 2.0), record(f"Top-5 {ABS}", "C", 4.0, doc=1), record(f"Top-10 {ABS}", "C", 5.0),
        record(f"5 by facility location from Top-100 {ABS}. lambda=0.5", "C", 6.0), record("5 by AIDE from Top-100.", "C", 1.5),
        record(f"Top-5 by facility location from Top-100 {ABS}. lambda=0.0", "C", 9.0),
        record("5 random examples with seed 42", "C", 1.0), record("5 random examples with seed 3", "C", 3.0),
    ]
    return analytics.with_derived_columns(spark.createDataFrame(rows, FIELDS)).cache()


def test_derived_columns_and_cohort(records):
    by_text = {r["explanation_type"]: r for r in records.collect()}
    fl = by_text[f"5 by facility location from Top-100 {ABS}. lambda=0.0"]  # the stray prefix is gone
    assert (fl["k"], fl["method"], fl["order"], fl["lambda"], fl["seed"]) == (5, "facility_location", "most_influential", 0.0, -1)
    aide = by_text[f"5 by AIDE from Top-100 {ABS}."]
    assert (aide["method"], aide["order"], aide["sort_type"]) == ("aide", "most_influential", "scores with largest absolute value")
    assert analytics.cohort(records, "C", 5).count() == 6 and analytics.cohort(records, "C", 10, "none").count() == 0


def test_ratio_and_area(records):
    ratio = {r["method"] + str(r["setting"])[-4:]: r for r in analytics.gain_ratio(records, ["model", "estimator", "linear_coder", "k"]).collect()}
    assert len(ratio) == 3
    assert ratio["facility_location=0.5"]["pred_gain_ratio"] == pytest.approx(2.0)
    assert ratio["facility_location=0.0"]["pred_gain_reduction_pct"] == pytest.approx(-2.0)
    area = analytics.auc(records.where("method = 'top_k'"), ["model", "explanation_type_no_k"]).collect()
    assert len(area) == 1 and area[0]["auc"] == pytest.approx(5 * (3.0 + 5.0) / 2)
    table = analytics.selection_table(records).collect()
    assert [(r["estimator"], r["pred_gain"]) for r in table if "random" in r["explanation_type"]] == [("-", 2.0)]


def test_shares_and_macro(records):
    rows = analytics.coefficient_shares(records)
    first = rows.first()
    assert (first["prop_nonzero"], first["prop_negative"]) == (0.75, 0.25)
    macro = {(r["k"], r["linear_coder"]): r["pred_gain"] for r in analytics.macro_average(
        records, ["k", "linear_coder", "explanation_type"], ["k", "linear_coder"], ["pred_gain"], "k").collect()}
    k5 = np.mean([3.0, 6.0, 1.5, 9.0, 1.0, 3.0])
    assert macro["5", "C"] == pytest.approx(k5) and macro["macro_avg", "C"] == pytest.approx((k5 + 5.0) / 2)


def test_reports(spark, records):
    lines = [r["pred_gain_text"] for r in analytics.report(records.where("method = 'top_k'"), "pred_gain", "flt").collect()]
    assert lines == ["2.00", "4.00", "5.00"]
    assert analytics.report(spark.createDataFrame([(0.256,)], "x double"), "x", "pct").first()["x_text"] == "25.60%"
    df = spark.createDataFrame([("m1", "a", 1.0), ("m1", "b", 3.0), ("m2", "a", 5.0)], "m string, t string, v double")
    matrix = {r["m"]: r for r in analytics.score_matrix(df, "m", "t", "v").collect()}
    assert (matrix["m1"]["Avg"], matrix["m2"]["Avg"], matrix["m2"]["b"]) == (2.0, 5.0, None)
    assert {(r["m"], r["t"]): r["is_best"] for r in analytics.best_per_task(df, "m", "t", "v").collect()} == {
        ("m1", "a"): False, ("m1", "b"): True, ("m2", "a"): True}
    assert [r["m"] for r in analytics.own_first(df.select("m").distinct(), "m", ["m1"]).collect()] == ["m2", "m1"]
    assert analytics.model_filter(df.select("m", "t", "v"), "m", "m1").count() == 1


def test_pairs_and_scores(spark):
    cols = ("explanation_type string, model string, estimator string, train_dataset string, train_split string, test_dataset string, "
            "test_split string, k int, document_idx bigint, delta_log_p double, jsd double, kld double")
    make = lambda text, doc, v: (text, "m", "e", "d", "a", "d", "b", 5, doc, v, v, v)
    rows = [make("Top-5 x", 1, 4.0), make("Top-5 x", 2, 1.0), make("5 random examples with seed 42", 1, 2.0), make("5 random examples with seed 3", 1, 8.0)]
    pairs = validation.validation_scores(analytics.pair_with_random(spark.createDataFrame(rows, cols)))
    got = sorted((r["validation_score_log_p"], r["validation_score_jsd"]) for r in pairs.collect())
    assert got == [(-4.0, 0.5), (2.0, 2.0)]
    scoring = spark.createDataFrame([("Top-5 x", "m", "e", "d", "a", "d", "b", 5, 1, 7.0)],
                                    cols.split(", delta_log_p")[0] + ", pred_gain double")
    assert [r["pred_gain"] for r in analytics.attach_scores(pairs, scoring).collect()] == [7.0, 7.0]


def test_gain_lookup_wants_one_record(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 1.0), (2, 2.0)], "id int, pred_gain double")
    one = analytics.gain_lookup(rows, rows.where("id = 1"), ["id"])
    assert one.first()["pred_gain_db"] == 10.0
    with pytest.raises(Exception, match="exactly one record"):
        analytics.gain_lookup(rows, rows.where("id = 2").limit(1), ["id"]).collect()


def test_linear_map(spark):
    rows = RNG.normal(size=(50, 6)) * np.array([9, 4, 1, 1, 1, 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, vec array<double>")
    got = np.array([r["coords"] for r in analytics.linear_map(df, "id").orderBy("id").collect()])
    centred = rows - rows.mean(axis=0)
    _, _, vh = np.linalg.svd(centred, full_matrices=False)
    want = centred @ np.array([w * np.sign(w[np.abs(w).argmax()]) for w in vh[:2]]).T
    np.testing.assert_allclose(got, want, atol=1e-6)


def test_wide_long_and_samples(spark):
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, -1.0), (2, 10, 2.0)], "test_id bigint, train_id bigint, score double")
    wide = analytics.wide_influence(scores)
    assert sorted(wide.columns) == ["10", "11", "test_id"]
    back = analytics.long_influence(wide).where("score IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scores.collect()))
    numbered = spark.range(20).select(F.col("id").alias("doc"), F.col("id").alias("idx"))
    drawn = analytics.sampled_rows(numbered, "doc", 30, 1)
    assert drawn.count() == 30 and drawn.select("draw").distinct().count() == 30


def test_masked_tokens_do_not_count(spark):
    rows = [(1, True, -1.0, -0.5, [0.5, 0.5], [0.25, 0.75]), (1, False, -9.0, -9.0, [1.0, 0.0], [0.0, 1.0]),
            (1, None, -9.0, -9.0, [1.0, 0.0], [0.0, 1.0]), (2, False, -1.0, -1.0, [0.5, 0.5], [0.5, 0.5])]
    tokens = spark.createDataFrame(rows, "doc_id int, own boolean, log_p_before double, log_p_after double, p_before array<double>, p_after array<double>")
    assert {r.doc_id: r.delta_log_p for r in validation.delta_log_p(tokens, mask="own").collect()} == {1: 0.5, 2: None}
    assert {r.doc_id: r.log_p for r in validation.document_log_p(tokens, "log_p_before", "own").collect()} == {1: -1.0, 2: None}
    both = {r.doc_id: r for r in validation.divergences(tokens, mask="own").collect()}
    alone = validation.divergences(tokens.where("own")).first()
    assert (both[1].jsd, both[1].kld) == (alone.jsd, alone.kld) and both[2].jsd is None
    assert {r.doc_id: r.jsd for r in validation.jsd(tokens, mask="own").collect()}[1] == alone.jsd
    assert {r.doc_id: r.kld for r in validation.kld(tokens, mask="own").collect()}[1] == alone.kld


def test_small_signed_rank_tests_are_counted_out(spark):
    """Against all sign patterns; with ties or zeros the normal value stays, and groups do not mix."""
    import itertools
    rows, want = [], {}
    for g, d in enumerate([[1.0], [-2.0, 1.0, 3.5], [0.3, -0.1, 2.0, 5.0, -7.0, 1.5, 0.9], [1.0, 1.0, -2.0], [0.0, 1.0, 2.0, -3.0]]):
        rows += [(g, x, 0.0) for x in d]
        kept = [x for x in d if x]
        order = sorted(map(abs, kept))
        if len(set(order)) == len(kept) == len(d):
            w = sum(order.index(abs(x)) + 1 for x in kept if x > 0)
            sums = [sum(r for r, s in zip(range(1, len(kept) + 1), signs) if s) for signs in itertools.product([0, 1], repeat=len(kept))]
            want[g] = sum(s >= w for s in sums) / len(sums)
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g int, x double, y double"), "x", "y", ["g"]).collect()}
    assert set(want) == {0, 1, 2} and all(got[g].p_value == pytest.approx(p, abs=1e-12) for g, p in want.items())
    assert all(got[g].p_value == pytest.approx(0.5 * math.erfc(got[g].z / math.sqrt(2)), abs=1e-12) for g in (3, 4))
    tail = stats.rank_sum_tail(50)
    assert tail[0] == 1.0 and tail[-1] == 2.0**-50 and tail[638] == pytest.approx(0.5, abs=1e-9)


def test_linear_map_of_wide_vectors(spark, monkeypatch):
    """Wider than the directions that are kept, over many partitions that merge as a tree."""
    monkeypatch.setattr(analytics, "MERGED_AT_ONCE", 2)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(120, 80)) * np.append([30, 20, 10], np.full(77, 1.0)) @ np.linalg.qr(rng.normal(size=(80, 80)))[0] + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, vec array<double>").repartition(7)
    got = np.array([r["coords"] for r in analytics.linear_map(df, "id", 3).orderBy("id").collect()])
    centred = rows - rows.mean(axis=0)
    _, s, vh = np.linalg.svd(centred, full_matrices=False)
    want = centred @ np.array([w * np.sign(w[np.abs(w).argmax()]) for w in vh[:3]]).T
    np.testing.assert_allclose(got, want, atol=1e-6)
    np.testing.assert_allclose([r.variance for r in analytics.map_variance(df, "id", 3).collect()], s[:3] ** 2 / 119, rtol=1e-9)


@pytest.mark.parametrize("directions", [256, 24])
def test_linear_map_of_nearly_equal_variances(spark, monkeypatch, directions):
    """Rows as wide as the directions that are taken at once, and wider ones."""
    monkeypatch.setattr(analytics, "MAP_ROUNDS", 40)
    monkeypatch.setattr(analytics, "MAP_DIRECTIONS", directions, raising=False)
    rng = np.random.default_rng(8)
    sizes = np.append([1.02, 1.01], np.linspace(1.0, 0.99, 58))
    u = rng.normal(size=(150, 60))
    rows = np.linalg.qr(u - u.mean(axis=0))[0] * sizes @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, vec array<double>").repartition(3)
    got = np.array([r["coords"] for r in analytics.linear_map(df, "id", 2).orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(np.linalg.norm(got, axis=0)), sizes[:2], rtol=1e-9)
    vh = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2]
    want = rows @ np.array([w * np.sign(w[np.abs(w).argmax()]) for w in vh[:2]]).T
    np.testing.assert_allclose(got, want, atol=1e-7)
    np.testing.assert_allclose([r.variance for r in analytics.map_variance(df, "id", 2).collect()], sizes[:2] ** 2 / 149, rtol=1e-9)
