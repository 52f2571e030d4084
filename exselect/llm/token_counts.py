"""Token counts without token ids (operator 2).

Each task turns a bounded batch of texts into pre-token frequencies, dealt by a hash of the pre-token: one row per
batch and slice of the vocabulary, so a frequent word costs a row per batch and not one per document. A slice counts
the pieces of each of its distinct pre-tokens once, joins the counts to the frequencies and sends one sum per
document back to the batch.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import parts, shuffled
from exselect.llm.wordbpe import byte_symbols, default_path, pretokenizer

BATCH_CHARS = 24 << 20
SLICES_PER_PARTITION = 4
PIECES_KEPT = 400_000

_FREQUENCIES = "batch long, slice int, words binary, postings binary, docs binary, sizes binary, special binary, nulls binary"
_SUMS = "batch long, sums binary, docs binary, sizes binary, nulls binary"


def _numbers(values, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, kind).tobytes(), 1)


def _array(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


class _Batch:
    """Pre-token frequencies of the documents seen so far."""

    def __init__(self, splitter):
        self.splitter, self.chars = splitter, 0
        self.ids, self.sizes, self.special, self.nulls, self.tokens = [], [], [], [], []
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.plain: dict[str, int] = defaultdict()
        self.plain.default_factory = self.plain.__len__

    def add(self, doc_id: int | None, text: str) -> None:
        words, pretokens, special = [], [], 0
        for found, whole, token in self.splitter.segments(text):
            (words if whole else pretokens).extend(found)
            special += token is not None
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(text.encode()))
        self.special.append(special)
        self.tokens.append((np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)),
                            np.fromiter(map(self.plain.__getitem__, pretokens), np.int64, len(pretokens))))
        self.chars += len(text) + 64

    def rows(self, number: int, slices: int) -> Iterator[dict]:
        yield {"batch": number, "slice": -1 - number % slices, "docs": _numbers(self.ids, "<i8"), "sizes": _numbers(self.sizes, "<i8"),
               "special": _numbers(self.special, "<i8"), "nulls": _numbers(self.nulls, "u1")}
        # Words on white space, and how often each holds which pre-token.
        of_word = [self.splitter.of_word(w) for w in self.words]
        lengths = np.array([len(p) for p in of_word] or [0], np.int64)
        flat = np.array([self.plain[p] for found in of_word for p in found], np.int64)
        begins = np.cumsum(lengths) - lengths
        keys = []
        for doc, (words, pretokens) in enumerate(self.tokens):
            n = lengths[words]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append(np.concatenate([flat[np.repeat(begins[words], n) + inside], pretokens]) << 32 | doc)
        keys, counts = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
        of = keys >> 32
        names = list(self.plain)
        place = np.array([zlib.crc32(p.encode()) % slices for p in names], np.int64)
        order = np.argsort(place[of], kind="stable") if len(of) else of
        of, docs, counts = of[order], (keys & 0xFFFFFFFF)[order], counts[order]
        edges = np.searchsorted(place[of], np.arange(slices + 1)) if len(of) else np.zeros(slices + 1, np.int64)
        for k in range(slices):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            distinct, local = np.unique(of[a:b], return_inverse=True)
            steps = np.diff(local, prepend=0)  # 0 or 1, as pairs are sorted by pre-token
            yield {"batch": number, "slice": k,
                   "words": zlib.compress(" ".join([names[i] for i in distinct]).encode(), 1),
                   "postings": b"".join(len(x).to_bytes(4, "little") + x for x in (
                       _numbers(steps, "u1"), _numbers(docs[a:b], "<u4"), _numbers(counts[a:b], "<u4")))}


def _record(row: dict, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=kinds)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def frequencies(docs: DataFrame, path: str, slices: int) -> DataFrame:
    """(batch, slice): pre-tokens of the slice in the batch and their per-document frequencies, packed."""

    def run(batches):
        splitter, kinds, number = pretokenizer(path), _arrow(_FREQUENCIES), TaskContext.get().partitionId() << 32
        batch = _Batch(splitter)
        for arrow in batches:
            for doc_id, text in zip(arrow.column(0).to_pylist(), arrow.column(1).to_pylist()):
                batch.add(doc_id, text or "")
                if batch.chars >= BATCH_CHARS:
                    for row in batch.rows(number, slices):
                        yield _record(row, kinds)
                    number, batch = number + 1, _Batch(splitter)
        if batch.ids:
            for row in batch.rows(number, slices):
                yield _record(row, kinds)

    return docs.mapInArrow(run, _FREQUENCIES)


def _piece_counter(path: str):
    model, symbols = pretokenizer(path).lib.model, byte_symbols()
    known: dict[str, int] = {}

    def count(pretoken: str) -> int:
        n = known.get(pretoken)
        if n is None:
            if len(known) >= PIECES_KEPT:
                known.clear()
            n = known[pretoken] = len(model.tokenize("".join([symbols[b] for b in pretoken.encode()])))
        return n

    return count


def token_counts(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens; no ids are made.

    Null text counts as empty: 0 and 0. Strings of special tokens in a text count one each. Rows with a null or
    repeated doc_id stay, one result each; other columns are not carried. The input must be a repeatable scan.
    """
    path = tokenizer or default_path()
    spark = docs.sparkSession
    slices = SLICES_PER_PARTITION * parts(spark)

    def sums(batches):
        count, kinds = _piece_counter(path), _arrow(_SUMS)
        for arrow in batches:
            for row in arrow.to_pylist():
                out = {"batch": row["batch"], "docs": row["docs"], "sizes": row["sizes"], "nulls": row["nulls"]}
                if row["slice"] < 0:
                    out["sums"] = row["special"]
                else:
                    words = zlib.decompress(row["words"]).decode().split(" ")  # no pre-token holds white space
                    pieces = np.array([count(w) for w in words], np.int64)
                    at, columns = 0, []
                    for kind in ("u1", "<u4", "<u4"):
                        n = int.from_bytes(row["postings"][at:at + 4], "little")
                        columns.append(_array(row["postings"][at + 4:at + 4 + n], kind))
                        at += 4 + n
                    steps, of_doc, times = columns
                    out["sums"] = _numbers(np.bincount(of_doc, pieces[np.cumsum(steps, dtype=np.int64)] * times), "<i8")
                yield _record(out, kinds)

    def totals(batches):
        base, total = {}, {}
        for arrow in batches:
            for row in arrow.to_pylist():
                more, now = _array(row["sums"], "<i8"), total.get(row["batch"])
                if now is None:
                    total[row["batch"]] = more.copy()
                elif len(more) <= len(now):
                    now[:len(more)] += more
                else:
                    (grown := more.copy())[:len(now)] += now
                    total[row["batch"]] = grown
                if row["docs"] is not None:
                    base[row["batch"]] = (row["docs"], row["sizes"], row["nulls"])
        for batch, (ids, sizes, nulls) in base.items():
            ids, sizes, nulls = _array(ids, "<i8"), _array(sizes, "<i8"), _array(nulls, "u1").astype(bool)
            now = total[batch]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=nulls), pa.array(sizes), pa.array(now[:len(ids)])], names=["doc_id", "n_bytes", "n_tokens"])

    table = frequencies(docs.select(F.col(doc_id).cast("long"), text), path, slices)
    summed = shuffled(table, "slice").mapInArrow(sums, _SUMS)
    return shuffled(summed, "batch").mapInArrow(totals, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
