"""Hierarchical empirical Bayes document filter (operator 9).

Two targets, low quality and toxicity, share one scheme. The document's evidence is a log likelihood ratio: a
logistic regression over the features (words, word openings, style classes) that the labelled rows show to matter. Its prior is the rate of
its path (host and language), shrunk towards the rate of its host, which is shrunk towards the global rate; the
strength of each shrinkage is fitted to the spread of the rates. A document is rejected when either posterior passes
the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import stored
from exselect.session import small_side

TARGETS = ("low_quality", "toxic")
STYLE = "\0"  # opens the name of a style feature: no word holds it
LONG_WORD = 30
INTERCEPT = STYLE + "1"


def _share_class(share: float) -> int:
    """0 for none, then one class per doubling from 1 in 64."""
    return 0 if share <= 0 else max(1, min(7, 7 + math.ceil(math.log2(min(1.0, share)))))


def describe(text: str | None) -> tuple[set[str], set[str], list[str]]:
    """Distinct lower-case words, their openings of five letters, and style classes. Null is empty."""
    text = text or ""
    words = text.split()
    if not words:
        return set(), set(), [STYLE + "empty"]
    n = len(words)
    bare = set(text.lower().replace(".", " ").replace(",", " ").replace(STYLE, " ").split())
    stops = text.count(".") + text.count(",")
    shares = {
        "marks": (n - sum(map(str.isalnum, words)) - stops) / n, "upper": sum(map(str.isupper, words)) / n,
        "again": sum(map(eq, words, islice(words, 1, None))) / n, "few": 1 - len(set(words)) / n if n >= 20 else 0.0,
        "long": sum(map(LONG_WORD.__lt__, map(len, words))) / n,
    }
    return bare, {w[:5] for w in bare}, [f"{STYLE}{name}{_share_class(share)}" for name, share in shares.items()]


def features(text: str | None) -> list[str]:
    words, openings, style = describe(text)
    return [*words, *("^" + o for o in openings), *style]


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most about `sample_rows` labelled documents, chosen by a hash of the id: (doc_id, text, low_quality, toxic)."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(marks, sample_rows, 32), "doc_id")


def fit_evidence(sample: DataFrame, least_documents: int = 8, least_g: float = 30.0, penalty: float = 0.02) -> dict[str, dict[str, float]]:
    """Weights of a logistic regression per target, over the features whose dependence on it is beyond doubt (G statistic).

    The intercept has the sample's base rate taken off, so a sum of weights is a log likelihood ratio. Copies of a
    text count once. The sample is bounded, so what comes back to the driver is too.
    """
    sample = stored(sample.dropDuplicates(["text", *TARGETS]).select("text", *TARGETS), "labelled")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, low, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                names = features(text)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([low] * len(names), pa.int32()), pa.array([toxic] * len(names), pa.int32())],
                                                 names=["feature", *TARGETS])

    totals = sample.agg(*[f(F.col(t)).alias(f"{t}_{n}") for t in TARGETS for n, f in (("pos", F.sum), ("all", F.count))]).first()
    counts = sample.mapInArrow(emit, "feature string, low_quality int, toxic int").groupBy("feature").agg(
        *[f(F.col(t)).alias(f"{t}_{n}") for t in TARGETS for n, f in (("a", F.sum), ("n", F.count))])
    counts = counts.where(F.greatest(*[f"{t}_n" for t in TARGETS]) >= least_documents)
    gs = []
    for target in TARGETS:
        positive, everything = totals[f"{target}_pos"] or 0, totals[f"{target}_all"] or 0
        a, n = F.coalesce(F.col(f"{target}_a"), F.lit(0)).cast("double"), F.col(f"{target}_n").cast("double")

        def term(seen: Column, group: int, n: Column = n, everything: int = everything) -> Column:
            return F.when((seen > 0) & (n > 0), seen * F.log(seen * everything / (n * group))).otherwise(0.0)

        mixed = 0 < positive < everything
        gs.append((2 * (term(a, positive) + term(n - a, everything - positive)) if mixed else F.lit(0.0)).alias(target))
    kept = counts.select("feature", *gs).where(F.greatest(*TARGETS) >= least_g).collect()
    places = {t: {r["feature"]: k for k, r in enumerate(x for x in kept if x[t] >= least_g)} for t in TARGETS}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = [features(t) for t in batch.column(0).to_pylist()]
                for k, t in enumerate(TARGETS, 1):
                    known = [([places[t][f] for f in row if f in places[t]], y)
                             for row, y in zip(found, batch.column(k).to_pylist()) if y is not None]
                    packed = [y for _, y in known], [len(x) for x, _ in known], [f for x, _ in known for f in x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t]), *(pa.array([np.array(x, "<i4").tobytes()], pa.binary()) for x in packed)],
                        names=["target", "label", "n", "at"])

    # Packed: the driver holds four bytes per feature of the sample, not an object.
    rows = sample.mapInArrow(index, "target string, label binary, n binary, at binary").collect()
    out = {}
    for t in TARGETS:
        y, lengths, at = (np.frombuffer(b"".join(r[c] for r in rows if r["target"] == t), "<i4") for c in ("label", "n", "at"))
        weights = _logistic(y, lengths, at, len(places[t]), penalty) if 0 < y.sum() < len(y) else None
        out[t] = {} if weights is None else {INTERCEPT: weights[-1]} | {f: weights[k] for f, k in places[t].items()}
    return out


def _logistic(y: np.ndarray, lengths: np.ndarray, at: np.ndarray, size: int, penalty: float, rounds: int = 400) -> list[float]:
    """Weights, then the intercept less the base rate's logit; full gradients, each weight with its own step.

    y: label per row; lengths: features per row; at: the features of all rows, one row after the other.
    """
    y, at, of = y.astype(float), at.astype(np.intp), np.repeat(np.arange(len(y)), lengths)
    base = math.log(y.mean() / (1 - y.mean()))
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = base
    for k in range(1, rounds + 1):
        score = np.bincount(of, w[at], len(y)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        slope = np.append(np.bincount(at, error[of], size) + penalty * w[:-1], error.sum()) / len(y)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        w -= 0.1 / (1 + k / 100) * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-9)
    w[-1] -= base
    return w.tolist()


def _strength(rates: DataFrame, rate: str, n: str, prior: Column) -> float:
    """Pseudo-count of the beta prior by moments: the spread of the rates beyond what sampling explains."""
    row = rates.agg(
        F.sum(F.col(n) * (F.col(rate) - prior) ** 2).alias("spread"), F.sum(prior * (1 - prior)).alias("noise"),
        F.sum(F.col(n) * prior * (1 - prior)).alias("scale"), F.count(F.lit(1)).alias("sites")).first()
    extra = (row["spread"] or 0.0) - (row["noise"] or 0.0)
    if not row["sites"] or extra <= 0:
        return 1e6  # no spread beyond chance: every site has the rate above it
    return max(1.0, (row["scale"] or 0.0) / extra)


def site_priors(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Shrunk rates of both targets by host and by path, over all labelled rows, and the global rates."""
    sites = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).alias("low_quality"), "toxic")
    sums = [f(F.col(t)).alias(f"{t}_{n}") for t in TARGETS for n, f in (("a", F.sum), ("n", F.count))]
    by_path = sites.join(marks, "doc_id").groupBy("host", "path").agg(*sums).persist()
    more = [F.sum(f"{t}_{n}").alias(f"{t}_{n}") for t in TARGETS for n in "an"]
    total = by_path.agg(*more).first()
    world = {t: ((total[f"{t}_a"] or 0) + 0.5) / (total[f"{t}_n"] + 1.0) if total[f"{t}_n"] else 0.0 for t in TARGETS}
    hosts = by_path.groupBy("host").agg(*more)
    paths = by_path
    for t in TARGETS:
        a, n = F.coalesce(F.col(f"{t}_a"), F.lit(0)), F.col(f"{t}_n")
        raw = hosts.where(n > 0).select((a / n).alias("rate"), n.alias("n"))
        k = _strength(raw, "rate", "n", F.lit(world[t]))
        hosts = hosts.withColumn(f"{t}_host", (a + k * world[t]) / (n + k))
    hosts = hosts.select("host", *[f"{t}_host" for t in TARGETS])
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]).persist()
    for t in TARGETS:
        a, n = F.coalesce(F.col(f"{t}_a"), F.lit(0)), F.col(f"{t}_n")
        raw = paths.where(n > 0).select((a / n).alias("rate"), n.alias("n"), F.col(f"{t}_host").alias("up"))
        k = _strength(raw, "rate", "n", F.col("up"))
        paths = paths.withColumn(f"{t}_path", (a + k * F.col(f"{t}_host")) / (n + k))
    return hosts, paths.select("host", "path", *[f"{t}_path" for t in TARGETS]), world


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = 20_000,
             threshold: float = 0.25, text: str = "text") -> DataFrame:
    """Adds evidence and posterior of both targets and `rejected` to every row of docs, which keeps its own columns.

    labels: (doc_id, quality, toxic), 0 or 1; a null label says nothing, of several rows for a document the worst
    counts in the sample. The evidence is fitted on at most about `sample_rows` labelled documents, the priors on all
    of them. Null or empty text has one feature of its own; a null host or path is a site like any other; hosts
    without labels have the global rate. Without labels nothing is rejected. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    new = [f"{t}_{n}" for t in TARGETS for n in ("evidence", "posterior")] + ["rejected"]
    docs = docs.drop(*new)
    named = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    sample = labelled(named, labels, sample_rows)
    weights = spark.sparkContext.broadcast(fit_evidence(sample))  # bounded by the sample
    hosts, paths, world = site_priors(docs, labels, host, path)
    at = docs.columns.index(text)
    schema = docs.select("*", *[F.lit(0.0).alias(f"{t}_evidence") for t in TARGETS]).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [weights.value[t] for t in TARGETS]
        known = tables[0].keys() | tables[1].keys()
        openings = {f[1:] for f in known if f[0] == "^"}
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch, sums = whole.slice(k, 1000), ([], [])
                for text in batch.column(at).to_pylist():
                    words, starts, style = describe(text)
                    found = [INTERCEPT, *(words & known), *("^" + o for o in starts & openings), *style]
                    for table, out in zip(tables, sums):
                        out.append(math.fsum(table.get(f, 0.0) for f in found))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in sums)], schema=pa.schema(
                    [*batch.schema, *[pa.field(f"{t}_evidence", pa.float64()) for t in TARGETS]]))

    scored = docs.mapInArrow(score, schema)
    keys = docs.columns
    scored = scored.withColumn("_host", F.col(host)).withColumn("_path", F.col(path))
    host_side = hosts.select(F.col("host").alias("_h"), *[F.col(f"{t}_host").alias(f"_{t}_host") for t in TARGETS])
    path_side = paths.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), *[F.col(f"{t}_path").alias(f"_{t}_path") for t in TARGETS])
    scored = scored.join(small_side(host_side, host_side.count(), 200), F.col("_host").eqNullSafe(F.col("_h")), "left")
    scored = scored.join(small_side(path_side, path_side.count(), 300),
                         F.col("_host").eqNullSafe(F.col("_ph")) & F.col("_path").eqNullSafe(F.col("_pp")), "left")
    posterior = {
        t: 1 / (1 + F.exp(-(F.col(f"{t}_evidence") + _logit(F.coalesce(f"_{t}_path", f"_{t}_host", F.lit(world[t]))))))
        for t in TARGETS}
    bad = F.lit(False)
    for t in TARGETS:
        bad = bad | (posterior[t] >= threshold)
    return scored.select(*keys, *[F.col(f"{t}_evidence") for t in TARGETS],
                         *[posterior[t].alias(f"{t}_posterior") for t in TARGETS], bad.alias("rejected"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", *[F.round(f"{t}_posterior", 6).alias(f"{t}_posterior") for t in TARGETS], "rejected",
        (~F.col("rejected")).alias("kept"))
