import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from exselect.operators.analytics import model_index, primary_scores
from exselect.sources import readers, results, splits
from exselect.streaming.merge import merge_arrivals

RECORDS = "id bigint, setting string, gain double"


def write_parts(spark, folder, start, stop):
    """One small Parquet file per row."""
    for i in range(start, stop):
        spark.createDataFrame([(i, f"s{i % 3}", i / 2)], RECORDS).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")


def test_merge_of_small_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    write_parts(spark, source, 0, 6)
    (source / "junk.parquet").write_bytes(b"not a parquet file")
    bad = results.merge_small_files(spark, str(source), str(target), RECORDS, files=2)
    assert [r["path"].rsplit("/", 1)[-1] for r in bad.collect()] == ["junk.parquet"]
    assert sorted(r["id"] for r in spark.read.parquet(str(target)).collect()) == list(range(6))
    assert len(list(target.glob("*.parquet"))) == 2


def test_merge_drops_broken_files_whole_and_keeps_partitions(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(200000).selectExpr("id", "concat('s', id % 3) AS setting", "id / 2.0D AS gain", "cast(id % 2 AS string) AS estimator")
    results.append_records(rows.coalesce(1), source, ["estimator"])
    results.append_records(spark.createDataFrame([(None, None, 1.0, "2")], RECORDS + ", estimator string"), source, ["estimator"])
    broken = next((tmp_path / "in" / "estimator=1").glob("*.parquet"))
    data = bytearray(broken.read_bytes())
    data[len(data) // 2:len(data) // 2 + 4000] = b"\xff" * 4000
    broken.write_bytes(bytes(data))
    for crc in broken.parent.glob(".*.crc"):
        crc.write_bytes(b"")
    bad = results.merge_small_files(spark, source, target, RECORDS + ", estimator string")
    assert [r.path.rsplit("/", 1)[-1] for r in bad.collect()] == [broken.name]
    merged = spark.read.parquet(target)
    assert {(r.estimator, r["count"]) for r in merged.groupBy("estimator").count().collect()} == {("0", 100000), ("2", 1)}


def test_arrivals_are_merged_once(spark, tmp_path):
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_parts(spark, source, 0, 3)
    merge_arrivals(spark, source, target, state, RECORDS, ["id", "setting"]).awaitTermination(120)
    assert spark.read.parquet(target).count() == 3
    write_parts(spark, source, 2, 5)  # row 2 arrives again
    merge_arrivals(spark, source, target, state, RECORDS, ["id", "setting"]).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]


def test_arrivals_keep_null_keys_and_partitions_and_list_damaged_files(spark, tmp_path):
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = [(None, "a", 1.0, "x"), (1, None, 2.0, "x"), (1, None, 2.0, "x"), (2, "b", 3.0, "y")]
    schema = RECORDS + ", estimator string"
    results.append_records(spark.createDataFrame(rows, schema), source, ["estimator"])
    (tmp_path / "in" / "estimator=y" / "junk.parquet").write_bytes(b"not a parquet file")
    for _ in range(2):
        merge_arrivals(spark, source, target, state, schema, ["id", "setting"]).awaitTermination(120)
    assert sorted(map(str, map(tuple, spark.read.parquet(target).collect()))) == sorted(map(str, {*rows}))
    assert [r.path.rsplit("/", 1)[-1] for r in spark.read.parquet(target + "_damaged").collect()] == ["junk.parquet"]


def test_resume_skips_stored_settings(spark, tmp_path):
    grid = spark.createDataFrame([("top_k", 5, None), ("top_k", 10, None), ("fl", 5, 0.5), ("fl", 5, 1.0)], "method string, k int, lambda double")
    stored = grid.where("k = 5 AND (lambda IS NULL OR lambda = 0.5)").withColumn("test_id", F.lit(1))
    results.append_selections(stored, str(tmp_path / "sel"))
    done = spark.read.parquet(str(tmp_path / "sel"))
    left = results.pending(grid, done, ["method", "k", "lambda"])
    assert sorted(map(str, left.collect())) == sorted(map(str, grid.where("k = 10 OR lambda = 1.0").collect()))


def test_named_values(spark):
    old = spark.createDataFrame([("gainAt5", "1"), ("gainAtTen", "2")], "label string, value string")
    new = spark.createDataFrame([("gainAt", "3")], "label string, value string")
    merged = results.upsert_values(old, new)
    assert {r["label"]: r["value"] for r in merged.collect()} == {"gainAt": "3", "gainAtTen": "2"}
    assert "\\newcommand{\\gainAt}{3}" in [r["value"] for r in results.as_commands(merged).collect()]


def test_metrics_tree(spark, tmp_path):
    for suite, model, score in (("s1", "m1_x", 0.5), ("s1", "m2", 0.7), ("s2", "m1_x", 0.1)):
        folder = tmp_path / "eval" / suite / model
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text(json.dumps({
            "all_primary_scores": [f"a:b: {score}", "c: 1"],
            "tasks": [{"alias": "a:b", "num_instances": 9, "metrics": {"acc": score, "f1": 1.0}}],
        }, indent=1))
    metrics = readers.read_metrics(spark, str(tmp_path / "eval"))
    got = {(r["task_suite"], r["model"], r["alias"]): r for r in primary_scores(metrics).collect()}
    assert len(got) == 6
    assert got["s2", "m1_x", "a:b"]["primary_score"] == 0.1 and got["s2", "m1_x", "a:b"]["metrics"]["acc"] == 0.1
    assert got["s1", "m2", "c"]["num_instances"] is None


def test_model_index(spark):
    scores = spark.createDataFrame([("m", "BoolQ", 0.5), ("m", "zz", 0.1), ("m", "ARC", 0.25)], "model string, task string, value double")
    tasks = spark.createDataFrame([("BoolQ", "qa", "BoolQ", "boolq"), ("ARC", "mc", "Arc", "arc")], "task string, task_type string, dataset_name string, dataset_type string")
    record = json.loads(model_index(scores, tasks).first()["record"])
    assert record["name"] == "m" and [r["task"]["name"] for r in record["results"]] == ["ARC", "BoolQ"]
    assert record["results"][1]["metrics"] == [{"type": "accuracy", "value": 0.5}]


CORPORA = {
    "aqua": (False, {"question": " q ", "options": ["A)1", "B)2"], "correct": "B"}, ("q\nAnswer Choices: (A) 1 (B) 2", "B")),
    "math": (True, {"question": "q", "answer": "x"}, ("q", "x")),
    "gsm8k": (False, {"question": "q ", "answer": "so\n#### 1,200.0"}, ("q", "1200")),
    "svamp": (True, {"Body": " b", "Question": "c ", "Answer": 3.0}, ("b c", "3")),
    "mmlu_physics": (True, {"question": "q", "choices": ["w", "x", "y", "z"], "answer": 2}, ("q\nAnswer Choices: (A) w (B) x (C) y (D) z", "C")),
    "sat": (True, {"question": "q", "answer": "D"}, ("q", "D")),
}


@pytest.mark.parametrize("corpus", CORPORA)
def test_corpora(spark, tmp_path, corpus):
    whole, row, want = CORPORA[corpus]
    path = tmp_path / "data.json"
    path.write_text(json.dumps([row]) if whole else json.dumps(row) + "\n\n")
    got = readers.read_corpus(spark, corpus, str(path))
    assert tuple(got.first())[:2] == want
    assert readers.corpus_summary(got).first()["n"] == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]


def test_row_numbers_and_splits(spark):
    df = spark.range(200).select(F.col("id").alias("doc"), (F.col("id") % 7).alias("x")).repartition(6)
    numbered = splits.with_index(df, "x", "doc").orderBy("idx").collect()
    assert [r["idx"] for r in numbered] == list(range(200))
    assert [(r["x"], r["doc"]) for r in numbered] == sorted((i % 7, i) for i in range(200))
    taken = splits.take_split(df, "doc", {"test": 30, "train": 0.5})
    assert {r["split"]: r["count"] for r in taken.groupBy("split").count().collect()} == {"test": 30, "train": 100}
    assert taken.select("doc").distinct().count() == 130
    again = splits.take_split(df, "doc", {"test": 30, "train": 0.5})
    assert sorted(map(str, taken.collect())) == sorted(map(str, again.collect()))
    free = splits.take_split(df, "doc", {"train": 150, "test": 500}, disjoint=False)
    assert free.count() == 350 and free.where("split = 'test'").select("doc").distinct().count() == 200
    twice = df.union(df.where("doc < 3")).unionByName(spark.createDataFrame([(None, 1)], "doc long, x long"))
    for size in (*range(2, 8), 203, 204):  # 1 is a share
        halves = splits.take_split(twice, "doc", {"test": size, "train": 1.0})
        assert {r["split"]: r["count"] for r in halves.groupBy("split").count().collect()} == {
            k: n for k, n in (("test", size), ("train", 204 - size)) if n}
    part = splits.select_split(splits.with_index(df.withColumn("split", F.lit("train")), "doc"), "train[5:9]")
    assert sorted(r["doc"] for r in part.collect()) == [5, 6, 7, 8]
    labelled = splits.hash_split(df, "doc", 0.25)
    assert 25 < labelled.where("split = 'test'").count() < 75
    summary = {r["split"]: r["n"] for r in splits.split_summary(labelled, 200).collect()}
    assert sum(summary.values()) == 200
    with pytest.raises(ValueError):
        splits.split_size(10, 0)


def test_only_damage_is_listed_and_other_failures_lose_nothing(spark, tmp_path, monkeypatch):
    """A full disk in a task fails the batch; run again, the same files are merged, and the ledger tells of each once."""
    source, target, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_parts(spark, Path(source), 0, 4)
    whole = sorted(Path(source).rglob("part-*.parquet"))
    cut = whole[0].read_bytes()
    (Path(source) / "cut.parquet").write_bytes(cut[:len(cut) // 2])
    real = results.decoded

    def full(content):
        raise OSError(28, "No space left on device")

    with monkeypatch.context() as patch:
        patch.setattr(results, "decoded", full)
        with pytest.raises(Exception, match="No space left"):
            merge_arrivals(spark, source, target, state, RECORDS, ["id", "setting"]).awaitTermination(120)
        with pytest.raises(Exception, match="No space left"):
            results.merge_small_files(spark, source, str(tmp_path / "merged"), RECORDS)
    assert results.decoded is real and spark.read.parquet(target).count() == 0
    assert not Path(target + "_damaged").exists() and not Path(target + "_ledger").exists()
    merge_arrivals(spark, source, target, state, RECORDS, ["id", "setting"]).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3]
    ledger = {r.path.rsplit("/", 1)[-1]: (r.outcome, r.rows, r.batch) for r in spark.read.parquet(target + "_ledger").collect()}
    assert ledger.pop("cut.parquet")[0] == "damaged" and set(ledger.values()) == {("whole", 1, 0)} and len(ledger) == len(whole)


def test_a_file_that_is_gone_fails_the_merge(spark, tmp_path):
    write_parts(spark, tmp_path / "in", 0, 3)
    rows, ledger = results.whole_files(spark, [str(p) for p in (tmp_path / "in").rglob("part-*.parquet")], RECORDS, str(tmp_path / "in"))
    assert ledger.count() == 3 and {r.outcome for r in ledger.collect()} == {"whole"}
    next((tmp_path / "in").rglob("part-*.parquet")).unlink()
    with pytest.raises(Exception):
        rows.collect()
