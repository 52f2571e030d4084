import tracemalloc

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from exselect.operators import bm25, curvature, scoring

RNG = np.random.default_rng(5)
TEST, TRAIN = RNG.normal(size=(7, 12)), RNG.normal(size=(60, 12))
TRAIN[11] = TRAIN[3]  # an exact copy: ties go to the lower id
TRAIN[20] = 0.0


def table(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} bigint, vec array<double>")


@pytest.fixture(scope="module")
def sides(spark):
    return table(spark, TEST, "test_id"), table(spark, TRAIN, "train_id").repartition(5)


def brute(scores, key, k):
    """(test, rank, train) by sorting the whole row."""
    out = []
    for t, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda j: (key(round(row[j], 9)), j))[:k]
        out += [(t, r + 1, j) for r, j in enumerate(order)]
    return out


KEYS = {"most_helpful": lambda s: s, "most_harmful": lambda s: -s, "least_influential": abs, "most_influential": lambda s: -abs(s)}


def picks(df, order=None):
    rows = df.collect() if order is None else df.where(df.sort_type == order).collect()
    return sorted((r["test_id"], r["rank"], r["train_id"]) for r in rows)


def test_top_influence_equals_sorting(sides):
    found = scoring.top_influence(*sides, 6, digits=9).cache()
    for order, key in KEYS.items():
        assert picks(found, order) == brute(-TEST @ TRAIN.T, key, 6)


def test_sampled_bounds_change_nothing(sides):
    whole = scoring.top_influence(*sides, 4, digits=9)
    bounded = scoring.top_influence(*sides, 4, digits=9, sample_fraction=0.4)
    assert sorted(whole.collect()) == sorted(bounded.collect())


def test_tiles_equal_broadcast(sides, small_broadcast):
    whole = sorted(scoring.top_influence(*sides, 5, digits=9).collect())
    dense = sorted(scoring.dot_influence(*sides, digits=9).collect())
    small_broadcast(300)
    assert sorted(scoring.top_influence(*sides, 5, digits=9).collect()) == whole
    assert sorted(scoring.dot_influence(*sides, digits=9).collect()) == dense
    assert len(dense) == TEST.shape[0] * TRAIN.shape[0]


def test_k_beyond_the_train_side(sides):
    found = scoring.top_influence(*sides, 100, ["most_helpful"], digits=9)
    assert picks(found) == brute(-TEST @ TRAIN.T, KEYS["most_helpful"], 60)


def test_cosine_of_zero_vector_is_zero(sides):
    rows = scoring.dot_influence(*sides, normalize=True).where("train_id = 20").collect()
    assert {r["score"] for r in rows} <= {0.0, -0.0}


def test_stored_top_k_drops_nan(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 2, float("nan")), (0, 3, 2.0), (0, 4, -1.0)], scoring.SCORE_SCHEMA)
    assert picks(scoring.top_k(rows, 3, "most_harmful")) == [(0, 1, 1), (0, 2, 3), (0, 3, 4)]


def test_fused_top_k_drops_nan(spark):
    bad = TRAIN.copy()
    bad[5, 0] = np.nan
    found = scoring.top_influence(table(spark, TEST, "test_id"), table(spark, bad, "train_id"), 60, ["most_helpful"])
    assert found.where("train_id = 5").count() == 0 and found.count() == 7 * 59


def test_adam_precondition(spark):
    blocks = spark.createDataFrame([(1, "a", [1.0, -2.0])], "id bigint, block string, vec array<double>")
    state = spark.createDataFrame([("a", [0.5, 0.5], [0.1, 0.2])], "block string, m array<double>, v array<double>")
    got = scoring.adam_precondition(blocks, state).first()["vec"]
    g, m, v = np.array([1.0, -2.0]), 0.5, np.array([0.1, 0.2])
    np.testing.assert_allclose(got, (0.9 * m + 0.1 * g) / np.sqrt(0.999 * v + 0.001 * g * g + 1e-8))


# --- curvature ---------------------------------------------------------------------------------------

LAYOUT = [("a", 0, 5), ("b", 5, 7)]


def curvature_by_loop():
    out = np.zeros_like(TEST)
    for _, start, width in LAYOUT:
        cut = slice(start, start + width)
        g, v = TRAIN[:, cut], TEST[:, cut]
        lam = np.mean([np.mean(row ** 2) for row in g]) / 10
        for t in range(len(v)):
            total = np.zeros(width)
            for row in g:
                total += v[t] - (v[t] @ row) / (lam + row @ row) * row
            out[t, cut] = total / (len(g) * lam)
    return out


@pytest.mark.parametrize("limit", [None, 300])
def test_curvature_vectors(sides, small_broadcast, limit):
    if limit:
        small_broadcast(limit)
    rows = curvature.curvature_vectors(*sides, LAYOUT).orderBy("test_id").collect()
    np.testing.assert_allclose([r["vec"] for r in rows], curvature_by_loop(), rtol=1e-9)


def test_blocks_round_trip(sides):
    flat = curvature.to_flat(curvature.to_blocks(sides[1], "train_id", LAYOUT), "train_id", LAYOUT)
    assert sorted(map(tuple, [(r[0], tuple(r[1])) for r in flat.collect()])) == [(i, tuple(map(float, row))) for i, row in enumerate(TRAIN)]


def test_even_layout_covers_every_width():
    for width in range(40):
        layout = curvature.even_layout(width, 4)
        assert [i for _, start, n in layout for i in range(start, start + n)] == list(range(width))
        assert len(layout) <= 4


def test_projection_budget(spark):
    dims = spark.createDataFrame([("a", 100), ("b", 6000), ("c", 20000)], "block string, dim bigint")
    got = {r["block"]: r["proj_dim"] for r in curvature.projection_budget(dims).collect()}
    assert got == {"a": 100, "b": 2048, "c": 6144}


def test_sign_projection_keeps_lengths(spark):
    rows = RNG.normal(size=(40, 64))
    got = curvature.sign_projection(table(spark, rows, "train_id").repartition(3), "train_id", [("w", 0, 64)], {"w": 48})
    vec = {r["train_id"]: np.array(r["vec"]) for r in got.collect()}
    assert all(len(v) == 48 for v in vec.values())
    ratio = [vec[i] @ vec[i] / (row @ row) for i, row in enumerate(rows)]
    assert 0.8 < np.mean(ratio) < 1.2
    same = curvature.sign_matrix(42, "w", 64, 48)
    np.testing.assert_allclose(vec[7], rows[7] @ same)


def test_low_precision(spark):
    rows = table(spark, np.array([[1.0, 1.00390625, 3.14159265, -2.7182818]]), "train_id")
    assert curvature.low_precision(rows, "train_id", "bfloat16").first()["vec"] == [1.0, 1.0, 3.140625, -2.71875]
    assert curvature.low_precision(rows, "train_id").first()["vec"][2] == pytest.approx(3.14159265, abs=1e-6)


# --- BM25 --------------------------------------------------------------------------------------------

DOCS = ["a b a c", "b b d", "", "e f g a a a", "c", "a b c d e f"]
QUERIES = ["a c a", "zzz", "b e d", ""]


def bm25_by_loop(extra):
    docs = [d.split() for d in DOCS]
    mean = np.mean([len(d) for d in docs])
    out = np.zeros((len(QUERIES), len(docs)))
    for q, text in enumerate(QUERIES):
        for term in set(text.split()):
            df = sum(term in d for d in docs)
            idf = np.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
            for i, d in enumerate(docs):
                if term in d:
                    out[q, i] += idf * d.count(term) * 2.5 / (d.count(term) + extra + 1.5 * (0.25 + 0.75 * len(d) / mean))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    make = lambda rows, name: spark.createDataFrame([(i, t.split()) for i, t in enumerate(rows)], f"{name} bigint, terms array<string>")
    return make(QUERIES, "test_id"), make(DOCS, "train_id").repartition(3)


def as_matrix(df):
    out = np.zeros((len(QUERIES), len(DOCS)))
    for r in df.collect():
        out[r["test_id"], r["train_id"]] = r["score"]
    return out


@pytest.mark.parametrize("variant, extra", [("reference", 1.0), ("standard", 0.0)])
@pytest.mark.parametrize("limit", [None, 100, 250])
def test_bm25(texts, small_broadcast, variant, extra, limit):
    if limit:
        small_broadcast(limit)
    dense = bm25.bm25(*texts, variant=variant, dense=True)
    assert dense.count() == len(QUERIES) * len(DOCS)
    np.testing.assert_allclose(as_matrix(dense), bm25_by_loop(extra), rtol=1e-12)
    sparse = bm25.bm25(*texts, variant=variant)
    assert sparse.where("score = 0").count() == 0
    np.testing.assert_allclose(as_matrix(sparse), bm25_by_loop(extra), rtol=1e-12)


@pytest.mark.parametrize("limit", [None, 100, 250])
def test_bm25_top_counts_absent_pairs(texts, small_broadcast, limit):
    if limit:
        small_broadcast(limit)
    found = bm25.bm25_top(*texts, 4, digits=9).cache()
    for order in ("most_influential", "least_influential"):
        assert picks(found, order) == brute(bm25_by_loop(1.0), KEYS[order], 4)


@pytest.mark.parametrize("limit", [None, 100, 250])
def test_bm25_top_knows_every_order_on_both_sides_of_the_limit(texts, small_broadcast, limit):
    if limit:
        small_broadcast(limit)
    found = bm25.bm25_top(*texts, 4, list(KEYS), digits=9).cache()
    for order in ("most_helpful", "most_harmful", "most_influential", "least_influential"):
        assert picks(found, order) == brute(bm25_by_loop(1.0), KEYS[order], 4)
    assert bm25.bm25_top(texts[0].limit(0), texts[1], 4, list(KEYS)).count() == 0


@pytest.mark.parametrize("digits", [0, 2, -1])
def test_bm25_rounds_as_the_scan_does(spark, digits):
    values = [0.125, 0.375, 0.5, 1.5, 2.5, 25.0, 35.0, -0.125, 0.3]
    rounded = spark.createDataFrame([(v,) for v in values], "score double").select(bm25._rounded(F.col("score"), digits))
    assert [r[0] for r in rounded.collect()] == np.round(values, digits).tolist()


def test_term_tables(texts):
    df = {r["term"]: r["df"] for r in bm25.document_frequency(texts[1]).collect()}
    assert df == {"a": 3, "b": 3, "c": 3, "d": 2, "e": 2, "f": 2, "g": 1}
    tf = {(r["train_id"], r["term"]): r["tf"] for r in bm25.term_frequency(texts[1], "train_id").collect()}
    assert tf[0, "a"] == 2 and tf[3, "a"] == 3 and len(tf) == 16


def test_signs_come_from_tiles_of_bounded_size(monkeypatch):
    rows = RNG.normal(size=(3, 5000))
    want = rows @ curvature.sign_matrix(1, "w", 5000, 96)
    made = []
    real = curvature.sign_tile
    monkeypatch.setattr(curvature, "TILE_SIGNS", 4096)
    monkeypatch.setattr(curvature, "sign_tile", lambda c, r: made.append(len(c) * len(r)) or real(c, r))
    np.testing.assert_allclose(curvature._signed(rows, 1, "w", 96), want)
    assert max(made) <= 4096 and sum(made) == 5000 * 96


def test_signs_are_balanced_and_uncorrelated():
    signs = curvature.sign_matrix(42, "w", 4000, 64) * 8
    assert set(np.unique(signs)) == {-1.0, 1.0} and abs(signs.mean()) < 0.01
    of_columns = signs.T @ signs / 4000 - np.eye(64)
    of_rows = signs[:200] @ signs[:200].T / 64 - np.eye(200)
    assert abs(of_columns).max() < 0.1 and abs(of_rows).max() < 0.75
    assert abs(signs[:, 0] @ (curvature.sign_matrix(42, "v", 4000, 64)[:, 0] * 8)) < 300
    assert not (curvature.sign_matrix(43, "w", 4000, 64) * 8 == signs).all()
    wide = curvature._signed(np.ones((1, 10**7)), 42, "w", 2)
    assert np.isfinite(wide).all()


def test_stored_top_k_keeps_the_first_rows_in_the_tasks(spark, monkeypatch):
    """Against a plain sort, with ties, NaN and nulls; the pairs are thinned out before the shuffle."""
    monkeypatch.setattr(scoring, "ROWS_IN", 40)
    rng = np.random.default_rng(3)
    rows = [(int(t), int(i), float(s)) for t, i, s in zip(rng.integers(0, 5, 900), rng.integers(0, 400, 900), rng.integers(-9, 9, 900) / 4)]
    rows += [(1, 1000, None), (1, None, -9.0), (None, 1, 0.5), (None, 2, 0.25), (2, 5, float("nan"))]
    table = spark.createDataFrame(rows, "test_id bigint, train_id bigint, score double").repartition(3)
    key = {"most_helpful": lambda s: s, "most_harmful": lambda s: -s, "least_influential": abs, "most_influential": lambda s: -abs(s)}
    first = lambda x: (x is not None, x or 0)
    for name, of in key.items():
        want = {}
        for t, i, s in sorted((r for r in rows if r[2] is None or r[2] == r[2]),
                              key=lambda r: (first(r[0]), first(None if r[2] is None else of(r[2])), first(r[1]))):
            want.setdefault(t, []).append((i, s))
        found = scoring.top_k(table, 4, name)
        got = sorted((first(r.test_id), r.rank, r.train_id, None if r.score is None else of(r.score)) for r in found.collect())
        assert got == sorted((first(t), n, i, None if s is None else of(s)) for t, have in want.items() for n, (i, s) in enumerate(have[:4], 1))
        assert "MapInArrow" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("together", [1 << 18, 100])
def test_candidates_leave_the_tasks_in_small_batches(monkeypatch, together):
    """Whatever the order of the pieces, with ties and NaN; no piece that leaves is as large as what is kept."""
    monkeypatch.setattr(scoring, "ROWS_IN", together)
    monkeypatch.setattr(scoring, "WAITING_PAIRS", together)
    rng = np.random.default_rng(5)
    ids, train = np.arange(3000) * 2, rng.permutation(200)
    scores = np.round(rng.normal(size=(200, 3000)), 1)
    scores[rng.random(scores.shape) < 0.01] = np.nan
    best = scoring.TopK(ids, 30, ["most_influential", "most_harmful"])
    for at in range(0, 200, 23):
        best.add(train[at:at + 23], scores[at:at + 23])
    batches = list(best.batches())
    assert max(b.num_rows for b in batches) <= scoring.ROWS_OUT
    rows = [r for b in batches for r in b.to_pylist()]
    for name, key in (("most_influential", -np.abs(scores)), ("most_harmful", -scores)):
        for t in (0, 17, 2999):
            order = np.lexsort((train, key[:, t]))[:30]
            assert [r["train_id"] for r in rows if r["sort_type"] == name and r["test_id"] == ids[t]] == train[order].tolist()


def test_candidates_in_a_task_do_not_grow_with_the_tests(spark, monkeypatch):
    """Four times the tests need no more memory in a task, and their candidates hold the first k of each."""
    works = []
    monkeypatch.setattr(scoring, "scan_against", lambda test, train, work, *rest, **named: works.append(work))
    monkeypatch.setattr(scoring, "rank_candidates", lambda candidates, k: candidates)
    scoring.top_influence(None, spark.range(0), 100, ["most_influential"], digits=9)
    rng = np.random.default_rng(7)
    test, train = rng.normal(size=(24000, 3)), rng.normal(size=(500, 3))
    peaks = []
    for n in (6000, 24000):
        ids, found = np.arange(n) + 10, {}
        tracemalloc.start()
        for batch in works[0](ids, test[:n], ((np.arange(at, at + 20), train[at:at + 20]) for at in range(0, 500, 20))):
            if n == 24000 and batch["test_id"][0].as_py() <= 13:
                found.update({t: batch.filter(pc.equal(batch["test_id"], t))["train_id"].to_pylist() for t in (10, 11, 12, 13)})
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]
    scores = np.round(-(train @ test[:4].T), 9)
    assert found == {10 + t: np.lexsort((np.arange(500), -np.abs(scores[:, t])))[:100].tolist() for t in range(4)}


@pytest.mark.parametrize(("kept", "chunk"), [(1, 1), (3 * 4 * 6 * 32, 12 * 8 * 9), (1, 1 << 20)])
def test_ranges_of_tests_and_chunks_of_vectors_change_nothing(spark, sides, monkeypatch, kept, chunk):
    """Ties, NaN, an empty partition and sampled bounds, with several ranges of tests and chunks in a task."""
    monkeypatch.setattr(scoring, "KEPT_BYTES", kept)
    monkeypatch.setattr(scoring, "CHUNK_BYTES", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = scoring.top_influence(*sides, 6, digits=9).cache()
        for order, key in KEYS.items():
            assert picks(found, order) == brute(-TEST @ TRAIN.T, key, 6)
        bounded = scoring.top_influence(*sides, 6, digits=9, sample_fraction=0.4)
        assert sorted(bounded.collect()) == sorted(found.collect())
        bad = TRAIN.copy()
        bad[5, 0] = np.nan
        few = table(spark, bad, "train_id").repartition(3, F.lit(1))
        want = brute(-TEST @ np.delete(TRAIN, 5, axis=0).T, KEYS["most_helpful"], 59)
        assert picks(scoring.top_influence(sides[0], few, 60, ["most_helpful"], digits=9)) == [(t, r, j + (j >= 5)) for t, r, j in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("limit", [None, 24])
def test_zero_pairs_are_made_after_the_join(spark, small_broadcast, limit):
    """Repeated ids and null train ids keep their pairs, null tests have none, scores of other queries stay out; no pair is dealt by both ids."""
    if limit:
        small_broadcast(limit)
    tests = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,), (None,), (5,)], "test_id bigint")
    train = spark.createDataFrame([(10,), (11,), (11,), (None,)], "train_id bigint")
    scores = spark.createDataFrame([(1, 10, 0.5), (2, 11, -1.0), (2, 11, 2.0), (None, 10, 3.0), (4, 10, 9.0), (3, None, 1.0), (3, 10, None)],
                                   "test_id bigint, train_id bigint, score double")
    want = tests.where("test_id IS NOT NULL").crossJoin(train).join(scores, ["test_id", "train_id"], "left").select("test_id", "train_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    found = bm25.densify(scores, tests, train)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert bm25.densify(scores, tests.where("test_id IS NULL"), train).isEmpty()
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "test_id bigint, terms array<string>")
    corpus = spark.createDataFrame([(7, ["a", "a", "b"]), (7, ["a", "a", "b"]), (8, ["c"])], "train_id bigint, terms array<string>")
    plan = bm25.bm25_join(queries, corpus)._jdf.queryExecution().executedPlan().toString()
    assert limit or "hashpartitioning(test_id" not in plan


@pytest.mark.parametrize("limit", [None, 300])
def test_top_k_of_a_table_in_the_making_ranks_where_pairs_are_scored(spark, sides, small_broadcast, monkeypatch, limit):
    """The same rows as from the stored table, with ties, repeated ids and NaN, but no pair leaves the task that scores it."""
    monkeypatch.setattr(scoring, "RANGE_TESTS", 3)
    bad = TRAIN.copy()
    bad[5, 0] = np.nan
    train = table(spark, bad, "train_id").union(sides[1].where("train_id in (3, 20)")).repartition(3)
    test = sides[0].union(sides[0].where("test_id = 2"))
    if limit:
        small_broadcast(limit)
    stored = scoring.dot_influence(test, train, digits=9).localCheckpoint()
    for name in KEYS:
        found = scoring.top_k(scoring.dot_influence(test, train, digits=9), 6, name)
        assert sorted(found.collect()) == sorted(scoring.top_k(stored, 6, name).collect())
        if not limit:
            assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    part = scoring.dot_influence(test, train, digits=9).where("train_id > 30")
    assert sorted(scoring.top_k(part, 4, "most_harmful").collect()) == sorted(scoring.top_k(stored.where("train_id > 30"), 4, "most_harmful").collect())


def test_merges_of_candidates_keep_every_tie(monkeypatch):
    """Bounds come from the first rows and from merges; equal keys on both sides of a merge go by the id."""
    monkeypatch.setattr(scoring, "WAITING_PAIRS", 7)
    rng = np.random.default_rng(11)
    scores = rng.integers(-3, 4, size=(300, 5)).astype(float)
    train = rng.permutation(300)
    best = scoring.TopK(np.arange(5), 8, KEYS)
    for at in range(0, 300, 31):
        best.add(train[at:at + 31], scores[at:at + 31])
    rows = [r for b in best.batches() for r in b.to_pylist()]
    for name, key in KEYS.items():
        for t in range(5):
            want = sorted(range(300), key=lambda i: (key(scores[i, t]), train[i]))[:8]
            assert [r["train_id"] for r in rows if r["sort_type"] == name and r["test_id"] == t] == train[want].tolist()
