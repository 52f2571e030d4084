"""Summaries of scoring, validation and benchmark records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exselect.functions import labels
from exselect.functions.chat import as_messages
from exselect.operators.curvature import sign_columns, sign_tile
from exselect.operators.scoring import as_matrix, doubles, normalized
from exselect.session import cut_lineage, small_side

DATASET_KEYS = ["train_dataset", "train_split", "test_dataset", "test_split"]
PAIR_KEYS = ["model", "estimator", *DATASET_KEYS, "k", "document_idx"]
UNITS = {"pct": ("%.2f%%", 100.0), "sci": ("%.2e", 1.0), "flt": ("%.2f", 1.0), "dB": ("%.2f dB", 1.0)}


def _means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


DESCRIPTION_BYTES = 1024


def description_table(records: DataFrame) -> DataFrame:
    """Every distinct description with the columns that reports read from it.

    Records share a few hundred descriptions, so they are parsed once each, not once per record. The
    table is kept and counted; it is broadcast only if it is as small as expected.
    """
    text = F.col("raw")
    parsed = (
        records.select(F.col("explanation_type").alias("raw")).distinct()
        .withColumn("k", labels.extract_k(text))
        .withColumn("explanation_type_no_k", labels.replace_k(text, "k"))
        .withColumn("explanation_type", labels.facility_location_hotfix(text, with_aide=True))
    )
    parsed = with_setting(cut_lineage(parsed))
    table = cut_lineage(
        parsed.withColumn("sort_type", labels.get_sort_type("explanation_type"))
        .withColumn("seed", F.coalesce(labels.extract_seed(text), F.lit(-1)))
        .withColumn("lambda", labels.get_lambda(text))
        .withColumn("category", labels.categorize(text))
    )
    return small_side(table, table.count(), DESCRIPTION_BYTES)


def with_derived_columns(records: DataFrame) -> DataFrame:
    """Records with the columns of their description and the NMSE."""
    raw = records.withColumnRenamed("explanation_type", "raw")
    return raw.join(description_table(records), "raw").drop("raw").withColumn("nmse", labels.nmse("pred_gain"))


def with_setting(rows: DataFrame) -> DataFrame:
    """Typed columns (method, order) of a description, the keys of the pairing with naive top-k."""
    text = F.col("explanation_type")
    method = (
        F.when(text.contains("by facility location"), F.lit("facility_location"))
        .when(text.contains("by DIVINE"), F.lit("divine"))
        .when(text.contains("by AIDE"), F.lit("aide"))
        .when(text.startswith("Top-"), F.lit("top_k"))
    )
    order = F.coalesce(
        *[F.when(text.contains(words), F.lit(name)) for name, words in labels.ORDER_TEXT.items()],
        F.when(text.contains("by AIDE"), F.lit("most_influential")),
    )
    return rows.withColumn("method", method).withColumn("order", order)


def coefficient_shares(records: DataFrame, column: str = "t") -> DataFrame:
    """Share of non-zero and of negative coefficients."""
    size = F.size(column)
    return records.withColumn(
        "prop_nonzero", F.size(F.filter(column, lambda x: x != 0)) / size
    ).withColumn("prop_negative", F.size(F.filter(column, lambda x: x < 0)) / size)


def macro_average(
    df: DataFrame, inner_keys: list[str], outer_keys: list[str], values: list[str], total: str | None = None
) -> DataFrame:
    """Mean per inner key, then the unweighted mean of those per outer key.

    `total` names an outer key over which one more unweighted mean is appended as "macro_avg" rows;
    a rollup would weight by rows.
    """
    table = _means(_means(df, inner_keys, values), outer_keys, values)
    if total is None:
        return table
    rest = [key for key in outer_keys if key != total]
    labelled = table.withColumn(total, F.col(total).cast("string"))
    whole = _means(table, rest, values).withColumn(total, F.lit("macro_avg"))
    return labelled.unionByName(whole.select(labelled.columns))


def cohort(
    records: DataFrame, coder: str, k: int | None = None, estimator: str | None = None
) -> DataFrame:
    """Records of one coder without lambda=0.0 settings, optionally of one k and estimator."""
    out = records.where((F.col("linear_coder") == coder) & ~F.col("explanation_type").contains("lambda=0.0"))
    if k is not None:
        out = out.where(F.col("k") == k)
    return out if estimator is None else out.where(F.col("estimator") == estimator)


def selection_table(records: DataFrame, with_model: bool = False, value: str = "pred_gain") -> DataFrame:
    """Mean gain per estimator (and model), method and order; random rows pool over estimators."""
    model = ["model"] if with_model else []
    fine = [*model, *DATASET_KEYS, "estimator", "seed", "linear_coder", "explanation_type",
            "explanation_type_no_k", "k", "sort_type"]
    coarse = ["estimator", "explanation_type", *model, "sort_type"]
    table = _means(records, fine, [value])
    table = table.withColumn(
        "explanation_type", labels.rename_explanation_type(labels.rename_random("explanation_type"), False)
    ).withColumn("estimator", labels.rename_estimator("estimator"))
    if with_model:
        table = table.withColumn("model", labels.rename_model("model"))
    table = _means(table, coarse, [value, "k"])
    pooled = F.when(F.col("explanation_type").contains("random"), F.lit("-")).otherwise(F.col("estimator"))
    return _means(table.withColumn("estimator", pooled), coarse, [value, "k"])


def report(table: DataFrame, value: str, unit: str = "dB", sort: bool = True) -> DataFrame:
    """Table with the value as text, smallest first; dB turns the value into decibels before."""
    text, factor = UNITS[unit]
    if unit == "dB":
        table = table.withColumn(value, labels.decibel(value))
    table = table.withColumn(f"{value}_text", F.format_string(text, F.col(value) * factor))
    return table.orderBy(F.col(value).asc_nulls_last()) if sort else table


def auc(df: DataFrame, keys: list[str], x: str = "k", y: str = "pred_gain", out: str = "auc") -> DataFrame:
    """Trapezoid area of the mean of y over x per key; keys with fewer than two x are dropped.

    The window runs over means, one row per (key, x).
    """
    points = _means(df, [*keys, x], [y])
    along = Window.partitionBy(*keys).orderBy(x)
    width = F.col(x) - F.lag(x).over(along)
    height = (F.col(y) + F.lag(y).over(along)) / 2
    return (
        points.withColumn("_part", width * height)
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.sum("_part").alias(out))
        .where(F.col("_n") >= 2)
        .drop("_n")
    )


def auc_table(records: DataFrame, with_model: bool = True, value: str = "pred_gain") -> DataFrame:
    """Mean area per (model,) method and estimator; all random settings share one label."""
    keys = ["model", *DATASET_KEYS, "estimator", "linear_coder", "explanation_type_no_k"]
    areas = auc(records, keys, "k", value, f"auc_{value}")
    method = F.when(F.col("explanation_type_no_k").contains("random"), F.lit("random")).otherwise(
        F.col("explanation_type_no_k")
    )
    areas = areas.withColumn(
        "explanation_type_no_k", labels.rename_explanation_type(labels.rename_random(method), False)
    ).withColumn("model", labels.rename_model("model"))
    group = ["explanation_type_no_k", "estimator"]
    return _means(areas, ["model", *group] if with_model else group, [f"auc_{value}"])


def gain_ratio(records: DataFrame, keys: list[str], value: str = "pred_gain") -> DataFrame:
    """Mean gain of every setting beside its naive top-k of the same k and order, with both ratios.

    One grouped mean over all settings, then an equi-join of the group table with its naive rows:
    the settings are never scanned one by one. The records carry the columns of their description.
    """
    means = _means(
        records.where(F.col("method").isNotNull()), [*keys, "method", "order", "explanation_type"], [value]
    )
    naive = means.where(F.col("method") == "top_k").select(*keys, "order", F.col(value).alias("naive"))
    return (
        means.where(F.col("method") != "top_k")
        .select(*keys, "method", "order", F.col("explanation_type").alias("setting"), F.col(value).alias("fl"))
        .join(naive, [*keys, "order"])
        .where(F.col("fl").isNotNull() & F.col("naive").isNotNull())
        .withColumn(f"{value}_ratio", F.try_divide("fl", "naive"))
        .withColumn(f"{value}_reduction_pct", 1 - F.try_divide("fl", "naive"))
    )


def ratio_bars(ratios: DataFrame, value: str = "pred_gain_ratio") -> DataFrame:
    """Percent improvement per (k, estimator, setting label, model, lambda), in plotting order."""
    chosen = ratios.where(F.col("setting").contains("largest absolute") | F.col("setting").contains("AIDE"))
    own = ~(F.col("setting").contains("DIVINE") | F.col("setting").contains("AIDE"))
    table = (
        chosen.withColumn("lambda", labels.get_lambda("setting", method_codes=True))
        .withColumn("own", own)
        .withColumn("label", labels.rename_explanation_type("setting"))
        .withColumn("pct", (F.col(value) - 1) * 100)
    )
    keys = ["k", "estimator", "label", "model", "lambda", "own"]
    return _means(table, keys, ["pct"]).orderBy(F.desc("own"), "k", "lambda")


def split_random(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selections, random draws)."""
    random = F.col("explanation_type").contains("random examples with seed")
    return records.where(~random), records.where(random)


def pair_with_random(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every selection record beside every random draw of the same key (one per seed)."""
    keys = keys or PAIR_KEYS
    selections, random = split_random(records)
    values = [c for c in records.columns if c not in keys]

    def suffixed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*keys, *[F.col(f"`{c}`").alias(f"{c}_{suffix}") for c in values])

    return suffixed(selections, "selection").join(suffixed(random, "random"), keys)


def attach_scores(pairs: DataFrame, scoring: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join of scoring records on the pair key and the description of the selection."""
    keys = keys or PAIR_KEYS
    right = scoring.withColumnRenamed("explanation_type", "explanation_type_selection")
    clash = [c for c in right.columns if c in pairs.columns and c not in keys and c != "explanation_type_selection"]
    for name in clash:
        right = right.withColumnRenamed(name, f"{name}_scoring")
    return pairs.join(right, [*keys, "explanation_type_selection"], "left")


def primary_scores(metrics: DataFrame) -> DataFrame:
    """(model, task_suite, alias, primary_score, num_instances, metrics) from benchmark metrics rows.

    "alias: score" is split at its last colon; task details join by alias within one file.
    """
    entry = F.explode("all_primary_scores").alias("entry")
    scores = metrics.select("file", "model", "task_suite", entry).select(
        "file", "model", "task_suite",
        F.regexp_extract("entry", "(?s)^(.*): (.*)$", 1).alias("alias"),
        F.regexp_extract("entry", "(?s)^(.*): (.*)$", 2).try_cast("double").alias("primary_score"),
    )
    tasks = metrics.select("file", F.explode("tasks").alias("t")).select(
        "file", "t.alias", "t.num_instances", "t.metrics"
    )
    return scores.join(tasks, ["file", "alias"], "left")


def score_matrix(
    df: DataFrame, row: str, col: str, val: str, columns: list[str] | None = None, avg: str | None = "Avg"
) -> DataFrame:
    """Mean of val with one column per task; `avg` adds the mean over a row's non-null cells."""
    grouped = df.groupBy(row)
    table = (grouped.pivot(col, columns) if columns else grouped.pivot(col)).agg(F.avg(val))
    if avg is None:
        return table
    cells = [F.col(f"`{c}`") for c in table.columns if c != row]
    some = F.filter(F.array(*cells), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda t, x: t + x), F.size(some))
    return table.select(row, mean.alias(avg), *cells)


def wide_influence(influence: DataFrame, train_ids: list[int] | None = None) -> DataFrame:
    """Long scores to one row per test and one column per train id, for export."""
    grouped = influence.groupBy("test_id")
    return (grouped.pivot("train_id", train_ids) if train_ids else grouped.pivot("train_id")).agg(F.first("score"))


def long_influence(wide: DataFrame) -> DataFrame:
    """Wide scores back to (test_id, train_id, score)."""
    columns = [c for c in wide.columns if c != "test_id"]
    return wide.unpivot("test_id", [F.col(f"`{c}`") for c in columns], "train_id", "score").select(
        "test_id", F.col("train_id").cast("bigint").alias("train_id"), "score"
    )


def best_per_task(df: DataFrame, row: str, col: str, val: str) -> DataFrame:
    """Mean per (row, task) with a flag on the best of each task.

    The best values are joined back as one row per task instead of a window over each task's rows.
    """
    means = _means(df, [row, col], [val])
    best = means.groupBy(col).agg(F.max(val).alias("_best"))
    return means.join(best, col).withColumn("is_best", F.col(val) == F.col("_best")).drop("_best")


def own_first(table: DataFrame, row: str, external: list[str]) -> DataFrame:
    """Add type own/external and order own rows first."""
    kind = F.when(F.col(row).isin(*external), F.lit("external")).otherwise(F.lit("own"))
    return table.withColumn("type", kind).orderBy(F.col("type").desc(), row)


def model_filter(table: DataFrame, row: str, pattern: str) -> DataFrame:
    """Drop rows whose name contains the pattern; columns after the first two in sorted order."""
    columns = table.columns[:2] + sorted(table.columns[2:])
    return table.where(~F.col(row).contains(pattern)).select(*[F.col(f"`{c}`") for c in columns])


def model_index(scores: DataFrame, task_map: DataFrame, row: str = "model") -> DataFrame:
    """(model, record): JSON with one result per known task.

    `scores(model, task, value)`; `task_map(task, task_type, dataset_name, dataset_type)` is a table of
    a few dozen benchmark names.
    """
    result = F.struct(
        F.struct(F.col("task_type").alias("type"), F.col("task").alias("name")).alias("task"),
        F.struct(F.col("dataset_type").alias("type"), F.col("dataset_name").alias("name")).alias("dataset"),
        F.array(F.struct(F.lit("accuracy").alias("type"), F.col("value"))).alias("metrics"),
    )
    return (
        scores.where(F.col("value").isNotNull()).join(task_map, "task")
        .groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("task").alias("k"), result.alias("r")))).alias("rs"))
        .select(row, F.to_json(F.struct(
            F.col(row).alias("name"), F.transform("rs", lambda x: x["r"]).alias("results")
        )).alias("record"))
    )


def gain_lookup(records: DataFrame, wanted: DataFrame, keys: list[str], value: str = "pred_gain") -> DataFrame:
    """Gain in dB of each wanted key; the job fails for a key with another number than one record."""
    found = wanted.select(*keys).join(records, keys, "left").groupBy(*keys).agg(
        F.count(value).alias("_n"), F.first(value, ignorenulls=True).alias(value)
    )
    alone = F.when(F.col("_n") == 1, labels.decibel(value)).otherwise(
        F.raise_error(F.lit("a key must have exactly one record")).cast("double")
    )
    return found.select(*keys, alias_db(alone, value))


def alias_db(column: Column, value: str) -> Column:
    return column.alias(f"{value}_db")


MERGED_AT_ONCE = 16
MAP_ROUNDS = 500
MAP_DIRECTIONS = 256  # up to this width all directions are taken at once; of wider rows so many are kept at most


def _merged_factors(factors: DataFrame, parts: int, size: int) -> list[np.ndarray]:
    """[R, W] of all tasks' (part, r, w): R of their stacked rows, by QR of two at a time, W their sum; a tree of MERGED_AT_ONCE."""
    def join(found: Iterator[tuple[bytes, bytes]]) -> list[np.ndarray]:
        r, w = np.zeros((0, size)), 0.0
        for more_r, more_w in found:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(more_r).reshape(-1, size)]), mode="r")
            w = w + np.frombuffer(more_w).reshape(size, -1)
        return [r, w]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]  # MERGED_AT_ONCE at most, up to chance
        for part in sorted({row["part"] for row in rows}):
            r, w = join((row["r"], row["w"]) for row in rows if row["part"] == part)
            yield pa.RecordBatch.from_pylist([{"part": part, "r": r.tobytes(), "w": w.tobytes()}])

    while parts > MERGED_AT_ONCE:
        parts = -(-parts // MERGED_AT_ONCE)
        factors = factors.withColumn("part", F.col("part") % parts).repartition(parts, "part").mapInArrow(run, factors.schema)
    return join((row["r"], row["w"]) for row in factors.collect())


def principal_axes(rows: DataFrame, centre: np.ndarray, components: int, oversampling: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(width x components axes, variance along each) of rows(vec) around `centre`, by a randomised range finder.

    A scan multiplies the rows with some directions, keeps the triangle of the products' QR factors, merged as a tree, and
    what the rows give back through them. Rows up to MAP_DIRECTIONS wide are multiplied with as many directions as they are
    wide: one scan has the axes, however near their variances are. Wider rows start with a few random directions and each
    scan adds those in which the rows give back something new (a block Krylov space), until the directions hold the axes;
    at MAP_DIRECTIONS the best of them go on. The driver and each task hold width x MAP_DIRECTIONS numbers at most.
    """
    width = len(centre)
    most = min(width, max(MAP_DIRECTIONS, 4 * (components + oversampling)))
    step = width if width <= most else components + oversampling
    basis = np.linalg.qr(sign_tile(sign_columns(seed, "map", np.arange(step)), np.arange(width)))[0] if step < width else np.eye(width)

    def scan(around: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, w = np.zeros((0, around.shape[1])), np.zeros((around.shape[1], width))
            for batch in batches:
                if batch.num_rows:
                    part = as_matrix(batch["vec"]) - centre
                    product = part @ around
                    r = np.linalg.qr(np.vstack([r, product]), mode="r")
                    w += product.T @ part
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "r": r.tobytes(), "w": w.tobytes()}])

        return run

    total, parts = rows.count(), rows.rdd.getNumPartitions()
    for _ in range(MAP_ROUNDS):
        size = basis.shape[1]
        r, w = _merged_factors(rows.select("vec").mapInArrow(scan(basis), "part long, r binary, w binary"), parts, size)
        given = np.linalg.lstsq(r.T, w, rcond=1e-12)[0] if len(r) == size else np.linalg.pinv(r.T) @ w
        _, values, axes = np.linalg.svd(r @ basis.T if size == width else given, full_matrices=False)
        found = axes[:components].T
        rest = axes.T - basis @ (basis.T @ axes.T)
        if size == width or np.abs(rest[:, :components]).max(initial=0.0) < 1e-10:
            signs = np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] >= 0, 1.0, -1.0)
            return found * signs, values[:components] ** 2 / max(1, total - 1)
        if size + step > most:
            basis = np.linalg.qr(axes.T[:, :most // 2])[0]
            continue
        # What the leading axes have beyond the directions comes first; the others only fill up.
        new = np.linalg.svd(rest * (values / max(values[0], 1e-300)), full_matrices=False)[0][:, :step]
        basis = np.linalg.qr(np.hstack([basis, new]))[0]
    raise ArithmeticError("the axes do not settle: the variance along the last one is that along many others")


def linear_map(vectors: DataFrame, id_col: str, components: int = 2, normalize: bool = False) -> DataFrame:
    """(id, coords): principal components of the centred vectors, each with its largest weight positive."""
    rows = vectors.select(id_col, doubles().alias("vec"))
    rows = normalized(rows) if normalize else rows
    # One vector of the data's width leaves the cluster, and the few directions of each round.
    centre = rows.select(Summarizer.mean(array_to_vector("vec")).alias("m")).first()["m"].toArray()
    axes, _ = principal_axes(rows, centre, components)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coords = (as_matrix(batch["vec"]) - centre) @ axes
                yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(list(coords), pa.list_(pa.float64()))], names=[id_col, "coords"])

    schema = rows.select(id_col, F.array().cast("array<double>").alias("coords")).schema
    return rows.select(id_col, "vec").mapInArrow(place, schema)


def map_variance(vectors: DataFrame, id_col: str, components: int = 2, normalize: bool = False) -> DataFrame:
    """(component, variance): what each axis of `linear_map` explains."""
    rows = vectors.select(id_col, doubles().alias("vec"))
    rows = normalized(rows) if normalize else rows
    centre = rows.select(Summarizer.mean(array_to_vector("vec")).alias("m")).first()["m"].toArray()
    _, variance = principal_axes(rows, centre, components)
    return vectors.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(variance, 1)], "component int, variance double")


def selected_chats(selections: DataFrame, conversations: DataFrame, turns: int = 2) -> DataFrame:
    """The first turns of each selected chat, in pick order; other chats are left out before turns are gathered."""
    wanted = selections.select(F.col("train_id").alias("conv_id")).distinct()
    chats = as_messages(conversations.join(wanted, "conv_id", "left_semi"), first=turns).withColumnRenamed("conv_id", "train_id")
    return selections.join(chats, "train_id")


def sampled_rows(df: DataFrame, id_col: str, draws: int, seed: int) -> DataFrame:
    """`draws` rows drawn with replacement: draw i takes the row numbered hash(seed, i) mod n.

    `df` carries its row number in `idx`.
    """
    total = df.count()
    picks = df.sparkSession.range(draws).select(
        F.col("id").alias("draw"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10)
         .cast("bigint") % F.lit(total)).alias("idx"),
    )
    return df.join(F.broadcast(picks), "idx").select("draw", id_col)
