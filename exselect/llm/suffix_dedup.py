"""Removal of repeated byte strings with sharded suffix arrays (operator 5).

Every string of `length` bytes is put down to its anchor, the gram in it with the smallest hash, so equal strings have
equal anchors. Neighbouring strings with one anchor form a segment. Segments whose anchor gram occurs once hold
nothing repeated. The others meet by gram: equal segments are counted before they move and travel once; the distinct
ones of a gram are laid side by side in shards, whose suffix arrays are sorted by induction and whose permuted common
prefixes show the repeated starts. The strings of a gram with very many different segments are put down to longer grams, and
at last to themselves; only these segments are touched again, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.exact_dedup import filed
from exselect.llm.suffixes import repeated_starts
from exselect.llm.tables import measured_side, parts, stored

GRAM = 48
SHARD_BYTES = 2 << 20
HOT_LEAST = 2048  # different segments of a gram that meet in one task
FREQUENT = 4096  # segments of a gram in all: from here on they are found by a table of such grams

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_LAST = _U(2**64 - 1)
_HIGH = _U(0xFFFFFFFF << 32)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each run of `gram` bytes."""
    if not _POWERS or len(_POWERS[0]) < len(data) + 1:
        size = max(1 << 17, 2 * len(data))
        _POWERS[:] = [_powers(size, _BASE), _powers(size, pow(_BASE, -1, 2**64))]
    up, down = _POWERS
    total = np.append(_U(0), np.cumsum((data.astype(np.uint64) + _U(1)) * up[:len(data)]))
    n = len(data) - gram + 1
    h = (total[gram:] - total[:n]) * down[:n]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.append(x, np.full(-n % width, _LAST)).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def segments(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's gram hash, first start, number of starts) of each segment of a text."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    keyed = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    anchor = sliding_least(keyed, length - gram + 1) & _U(0xFFFFFFFF)
    starts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return h[anchor[starts].astype(np.int64)], starts, np.diff(np.append(starts, len(anchor)))


def level_grams(length: int, gram: int) -> list[int]:
    """Lengths of anchors: each leaves about a quarter of the places of the one before, the last is the string itself."""
    out = [gram]
    while out[-1] < length:
        out.append(length - (length - out[-1]) // 4)
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, place, gram) of every segment; place is the segment's number in its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = [segments(_bytes(t), length, gram)[0] for t in batch.column(1).to_pylist()]
                counts = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                     pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
                     pa.array(np.concatenate(found).view(np.int64))], names=["row", "place", "gram"])

    return docs.select("row", "text").mapInArrow(run, "row binary, place int, gram long")


def shared_anchors(found: DataFrame) -> DataFrame:
    """(row, places) of the segments whose gram occurs more than once. Frequent grams are few, and their segments are not gathered."""
    counts = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-grams")
    frequent = measured_side(counts.where(F.col("n") >= FREQUENT).select("gram"), F.lit(8))
    rare = found.join(frequent, "gram", "left_anti").join(counts.where(F.col("n") < FREQUENT), "gram", "left_semi")
    shared = rare.unionByName(found.join(frequent, "gram", "left_semi"))
    return shared.groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("places"))


def occurrences(docs: DataFrame, chosen: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, start, count, gram, content, text) of the chosen segments; the bytes come once per task and content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        kinds = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("count", pa.int32()), ("gram", pa.int64()), ("content", pa.binary()), ("text", pa.binary())])
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch, out = whole.slice(k, 64), []
                for row, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                    data = _bytes(text)
                    grams, starts, counts = segments(data, length, gram)
                    grams = grams.view(np.int64)
                    for p in places:
                        a, n = int(starts[p]), int(counts[p])
                        piece = data[a:a + n + length - 1]
                        content = xxhash.xxh3_128_digest(piece)
                        new = content not in sent
                        if new:
                            if len(sent) >= 500_000:
                                sent.clear()
                            sent.add(content)
                        out.append((row, a, n, int(grams[p]), content, piece if new else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    texts = docs.select("row", "text").join(measured_side(chosen, 16 + 4 * F.size("places")), "row")
    return texts.select("row", "text", "places").mapInArrow(
        run, "row binary, start long, count int, gram long, content binary, text binary")


def parted(distinct: DataFrame, length: int, gram: int) -> DataFrame:
    """(content, start, gram, part, times, text): the segments of `distinct` cut anew by longer anchors; `part` is the content of a cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("content", pa.binary()), ("start", pa.int64()), ("gram", pa.int64()), ("part", pa.binary()), ("times", pa.int64()), ("text", pa.binary())])
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out = []
                for content, times, data in zip(*(c.to_pylist() for c in whole.slice(k, 256).columns)):
                    grams, starts, counts = segments(data, length, gram)
                    for g, a, n in zip(grams.view(np.int64).tolist(), starts.tolist(), counts.tolist()):
                        piece = data[a:a + n + length - 1]
                        out.append((content, a, g, xxhash.xxh3_128_digest(piece), times, piece))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return distinct.select("content", "times", "text").mapInArrow(
        run, "content binary, start long, gram long, part binary, times long, text binary")


def _ranges(flags: np.ndarray) -> bytes:
    """(first, end) of the runs of true flags, packed."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.astype("<u4").tobytes()


def repeated_in_segments(distinct: DataFrame, length: int) -> DataFrame:
    """(content, ranges): packed ranges of repeated starts in each distinct segment that has any.

    `distinct`: (gram, content, times, text). A segment seen several times is repeated throughout; where a gram has
    several segments, their suffixes are sorted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([np.frombuffer(r[3], np.uint8) for r in rows], length)
            out = [(r[1], _ranges(np.ones_like(f) if r[2] > 1 else f)) for r, f in zip(rows, found) if r[2] > 1 or f.any()]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], names=["content", "ranges"])

        rows = (row for batch in batches for k in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)))
        shard, size = [], 0
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)  # HOT_LEAST segments at most
            if len(group) == 1:
                if group[0][2] > 1:
                    starts = len(group[0][3]) - length + 1
                    yield pa.RecordBatch.from_arrays([pa.array([group[0][1]], pa.binary()), pa.array([_ranges(np.ones(starts, bool))], pa.binary())], names=["content", "ranges"])
                continue
            shard += group
            size += sum(len(r[3]) for r in group)
            if size >= SHARD_BYTES:
                yield flush(shard)
                shard, size = [], 0
        if shard:
            yield flush(shard)

    dealt = distinct.repartition(parts(distinct.sparkSession), "gram").sortWithinPartitions("gram", "content")
    return dealt.select("gram", "content", "times", "text").mapInArrow(run, "content binary, ranges binary")


def merged(spans: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, ranges): packed edges of the maximal runs of `spans` (array of start and ranges from there); ends move by `reach`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                pairs = np.concatenate([np.frombuffer(x["ranges"], "<u4").astype(np.int64).reshape(-1, 2) + x["start"] for x in found])
                pairs = pairs[np.argsort(pairs[:, 0])]
                ends = np.maximum.accumulate(pairs[:, 1] + reach)
                opens = np.append(True, pairs[1:, 0] > ends[:-1])
                last = np.append(np.flatnonzero(opens)[1:] - 1, len(ends) - 1)
                out.append(np.stack([pairs[opens, 0], ends[last]], axis=1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "ranges"])

    gathered = spans.groupBy(key).agg(F.collect_list(F.struct("start", "ranges")).alias("spans"))
    return gathered.mapInArrow(run, f"{key} binary, ranges binary")


def repeated_contents(distinct: DataFrame, length: int, grams: list[int]) -> DataFrame:
    """(content, ranges) of the contents that hold repeated starts, from the stored table (gram, content, times, text).

    Grams with more than HOT_LEAST contents are not laid side by side: their contents are cut anew by the next length
    of anchors. Strings of the last one are anchors themselves, so that all contents of a gram are equal.
    """
    hot = stored(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_LEAST).select("gram"), "repeat-hot")
    if len(grams) == 1 or hot.isEmpty():
        return repeated_in_segments(distinct, length)
    hot = measured_side(hot, F.lit(8))
    cuts = stored(parted(distinct.join(hot, "gram", "left_semi"), length, grams[1]), "repeat-parts")
    finer = cuts.groupBy("gram", F.col("part").alias("content")).agg(F.sum("times").alias("times"), F.max("text").alias("text"))
    found = stored(repeated_contents(stored(finer, "repeat-distinct"), length, grams[1:]), "repeat-found")
    back = cuts.select("content", "start", "part").join(
        measured_side(found.withColumnRenamed("content", "part"), 16 + F.octet_length("ranges")), "part")
    return repeated_in_segments(distinct.join(hot, "gram", "left_anti"), length).unionByName(merged(back, "content", 0))


def drop_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Every byte of a text (UTF-8; null is empty) that lies in a string of `length` bytes which also starts anywhere else
    in the table, the same text included, is removed; strings never cross rows and are judged on the input. Repeated
    rows repeat each other. Null ids and clashing or extra columns do no harm; other columns are not carried. The texts
    are scanned three times, whatever repeats.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = stored_rows(docs)
    found = stored(anchors(docs, length, gram), "repeat-anchors")
    chosen = stored(shared_anchors(found), "repeat-chosen")
    seen = stored(occurrences(docs, chosen, length, gram), "repeat-occurrences")
    distinct = stored(seen.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("times"), F.max("text").alias("text")), "repeat-distinct")
    repeated = stored(repeated_contents(distinct, length, level_grams(length, gram)), "repeat-found")
    spans = seen.select("row", "start", "content").join(measured_side(repeated, 16 + F.octet_length("ranges")), "content")
    spans = stored(merged(spans, "row", length - 1).withColumnRenamed("ranges", "removed"), "repeat-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, out = whole.slice(k, 256), []
                for doc, body, found in zip(*(c.to_pylist() for c in batch.columns)):
                    data = _bytes(body)
                    if not found:
                        out.append((doc, len(data), 0, 0, data))
                        continue
                    edges = [0, *np.frombuffer(found, "<u4").tolist(), len(data)]
                    kept = b"".join([data[a:b] for a, b in zip(edges[0::2], edges[1::2])])
                    out.append((doc, len(data), len(data) - len(kept), len(edges) // 2 - 1, kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = docs.join(measured_side(spans, F.octet_length("removed")), "row", "left")
    return marked.select("doc_id", "text", "removed").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def stored_rows(docs: DataFrame) -> DataFrame:
    """Rows with a number that does not change between scans: place in its file, or of a written copy."""
    placed = filed(docs)
    return placed.select("*", F.unhex(F.md5(F.concat_ws(":", "_metadata.file_path", "_metadata.row_index"))).alias("row"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

