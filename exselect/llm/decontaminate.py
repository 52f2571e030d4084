"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance (operator 10).

An item that occurs in a text with at most k edits leaves one of its k + 1 pieces untouched. Pieces are found exactly
with one automaton over the text; each hit names a window of the text, in which Myers' bit-vector algorithm finds the
smallest edit distance of the whole item. One narrow pass over the documents per block of items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import stored

ERROR_RATE = 0.06
BLOCK_CHARS = 8 << 20
_OTHER = re.compile(r"[\W_]+")

_HITS = "row long, item_id long, distance int, start long, end long"


def folded(text: str | None) -> str:
    """Lower case, letters and digits only, with one space between words and at both ends."""
    return _OTHER.sub(" ", f" {(text or '').lower()} ")


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces that cover the item, as even in length as can be."""
    edges = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance, at most `most`, of the item to a substring of text, and where the first such one ends."""
    m = len(item)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, None
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & ones
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & ones, (mh << 1) & ones
        plus, minus = mh | ~(xv | ph) & ones, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
            if not score:
                break
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.automaton, self.items = ahocorasick.Automaton(), []
        ids: dict[str, dict[int, None]] = {}  # an id may have several texts, and a text several ids
        for item_id, text in items:
            item = folded(text).strip()
            if item:
                ids.setdefault(f" {item} ", {})[item_id] = None
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for number, (item, own) in enumerate(ids.items()):
            errors = budget(item, rate)
            masks: dict[str, int] = {}
            for k, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << k
            self.items.append((item, masks, errors, tuple(own)))
            for offset, piece in pieces(item, errors):
                by_piece.setdefault(piece, []).append((number, offset))
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item_id in the folded text, whichever of its texts that is."""
        if not self.items:
            return []
        text = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                item, _, errors, _ = self.items[number]
                first = end + 1 - length - offset
                a, b = max(0, first - errors), min(len(text), first + len(item) + errors)
                own = windows.setdefault(number, [])
                if own and a <= own[-1][1] and b >= own[-1][0]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        out: dict[int, tuple[int, int, int]] = {}
        for number, own in windows.items():
            item, masks, errors, ids = self.items[number]
            best = None
            for a, b in own:
                found = myers(item, masks, text[a:b], errors if best is None else best[0] - 1)
                if found:
                    best = (found[0], a + found[1])
                    if not found[0]:
                        break
            if best:
                place = (best[0], max(0, best[1] - len(item)), best[1])
                for item_id in ids:
                    out[item_id] = min(place, out.get(item_id, place))
        return [(item_id, *place) for item_id, place in out.items()]


def _items(benchmark: DataFrame, null_ids: bool) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    return items if null_ids else items.where("item_id is not null")


def _chars(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int, rate: float) -> DataFrame:
    """_HITS of docs(row, text). With several blocks row has to be unique: the texts of one id may lie in different blocks."""
    context = docs.sparkSession.sparkContext
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = context.broadcast([(r.item_id, r.text) for r in block.collect()])  # about block_chars characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                found = [(r, *hit) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(t)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                        names=["row", "item_id", "distance", "start", "end"])

        found = docs.mapInArrow(run, _HITS)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    best = out.groupBy("row", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    return best.select("row", "item_id", "best.*")


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, row: str = "row", text: str = "text",
            block_chars: int = BLOCK_CHARS, null_ids: bool = False) -> DataFrame:
    """(row, item_id, distance, start, end): each item that a text holds with at most rate x length edits, at its best place.

    Texts and items are `folded` first, so case, punctuation and spacing cost no edits; start is exact up to the
    edits. Items that are empty after folding, and null items, match nothing; null text is empty. Texts without an id
    match nothing by default; with `null_ids` they match under a null item_id, all together. Items with equal
    text match each under its own id; an id with several texts matches by any of them, at the least distance. The items
    go out in blocks of `block_chars` characters, one scan of docs each; several blocks scan a stored copy with row numbers.
    """
    items = stored(_items(benchmark, null_ids).dropDuplicates(["item_id", "text"]), "benchmark")
    blocks = max(1, -(-_chars(items) // block_chars))
    docs = docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    if blocks == 1:
        return _in_blocks(docs, items, 1, rate)
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    hits = _in_blocks(docs.select(F.col("_row").alias("row"), "text"), items, blocks, rate).withColumnRenamed("row", "_row")
    return docs.select("_row", "row").join(hits, "_row").select("row", "item_id", "distance", "start", "end")


def flagged(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text: str = "text", null_ids: bool = False) -> DataFrame:
    """`docs` with `benchmark_items`: array of (item_id, distance), empty for clean rows. An own column of that name is replaced.

    With `null_ids` benchmark texts without an id are matched too and listed first, under a null item_id.
    One block of items needs one narrow pass; several blocks are matched first and joined by row.
    """
    docs = docs.drop("benchmark_items")
    kind = "array<struct<item_id:bigint,distance:int>>"
    items = _items(benchmark, null_ids)
    chars = _chars(items)
    if chars > BLOCK_CHARS:
        items = stored(items.dropDuplicates(["item_id", "text"]), "benchmark")
        rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        hits = _in_blocks(rows.select(F.col("_row").alias("row"), F.col(text).alias("text")), items, -(-_chars(items) // BLOCK_CHARS), rate)
        hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "distance"))).alias("benchmark_items"))
        out = rows.join(hits, rows["_row"] == hits["row"], "left").drop("_row", "row")
        return out.withColumn("benchmark_items", F.coalesce("benchmark_items", F.array().cast(kind)))
    shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])  # at most BLOCK_CHARS
    schema = docs.withColumn("benchmark_items", F.array().cast(kind)).schema
    at = docs.columns.index(text)
    listed = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                hits = [[{"item_id": i, "distance": d} for i, d, _, _ in sorted(matcher.find(t), key=lambda h: (h[0] is not None, h))] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, listed)], schema=pa.schema(
                    [*batch.schema, pa.field("benchmark_items", listed)]))

    return docs.mapInArrow(run, schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)
    return out.select(
        "doc_id", F.transform("benchmark_items", lambda h: h["item_id"]).alias("item_ids"),
        F.array_min(F.transform("benchmark_items", lambda h: h["distance"])).alias("least_distance"),
        (F.size("benchmark_items") > 0).alias("contaminated"))
