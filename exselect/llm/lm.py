"""Language-model scores from sharded Elias-Fano tries of word pairs (operator 8).

The model is trained on the rows that are not held out: P(w | u) = (c(u, w) + mu P(w)) / (c(u) + mu), with P(w) the smoothed share of w
(the base model) and a document's end as the context of its start. Tasks turn bounded batches of texts into word lists
and numbered tokens; words are counted in slices of the vocabulary and the counts go back to the batches; pairs go,
counted per document, to shards by (context, part of the followers), where the trie is built and queried; sums per
document come back. Nothing of the corpus passes through the driver but two totals, and no key is dealt whole: a
frequent context is spread over shards and a frequent pair is one entry per batch.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.elias_fano import Trie
from exselect.llm.tables import parts, stored

BATCH_CHARS = 5 << 20
BATCH_DOCS = 1 << 16
SHARD_TOKENS = 2_000_000
FOLLOWER_PARTS = 64
SLICES_PER_PARTITION = 2

_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _pack(values, kind: str | None = None) -> bytes:
    """Compressed bytes, or numbers with their first bytes first, then their second ones, and so on."""
    if kind is not None:
        values = np.ascontiguousarray(values, kind)
        values = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(values)


def _open(data: bytes, kind: str | None = None):
    data = zstandard.ZstdDecompressor().decompress(data)
    if kind is None:
        return data
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def held_out(doc_id: int | None) -> bool:
    """A null id counts as the empty text, which trains."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


_BATCH = "batch long, ids binary, nulls binary, held binary, lengths binary, tokens binary, words binary, trained binary, train_tokens long"


def batches_of(docs: DataFrame) -> DataFrame:
    """One row per bounded batch of texts: its documents, its words, its tokens as places in the word list (0: the end)."""
    kinds = _schema(_BATCH)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def start():
            words: dict[bytes, int] = defaultdict()
            words.default_factory = words.__len__
            words[b""]
            return words, [], [], 0

        def flush(words, ids, tokens) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens)
            held = np.array([held_out(i) for i in ids])
            trained = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(words))
            return pa.RecordBatch.from_pylist([{
                "batch": number, "ids": _pack([i or 0 for i in ids], "<i8"), "nulls": _pack([i is None for i in ids], "u1"),
                "held": _pack(held, "u1"), "lengths": _pack(lengths, "<i8"), "tokens": _pack(flat, "<u4"), "words": _pack(b"\n".join(words)),
                "trained": _pack(trained, "<i8"), "train_tokens": int(trained.sum())}], schema=kinds)

        words, ids, tokens, chars = start()
        for batch in arrow:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(doc_id)
                tokens.append(np.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)), 0))
                chars += len(text or "") + 64
                if chars >= BATCH_CHARS or len(ids) >= BATCH_DOCS:
                    yield flush(words, ids, tokens)
                    number += 1
                    words, ids, tokens, chars = start()
        if ids:
            yield flush(words, ids, tokens)

    return docs.mapInArrow(run, _BATCH)


_WORDS = "batch long, slice int, places binary, words binary, trained binary"
_COUNTS = "batch long, slice int, places binary, counts binary, numbers binary, known long"


def sliced_words(table: DataFrame, slices: int) -> DataFrame:
    kinds = _schema(_WORDS)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for number, words, trained in zip(*(c.to_pylist() for c in batch.columns)):
                words, trained = _open(words).split(b"\n"), _open(trained, "<i8")
                place = np.array([zlib.crc32(w) % slices for w in words])
                order = np.argsort(place, kind="stable")
                edges = np.searchsorted(place[order], np.arange(slices + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    own = order[edges[k]:edges[k + 1]]
                    yield pa.RecordBatch.from_pylist([{
                        "batch": number, "slice": int(k), "places": _pack(_deltas(own), "<u4"),
                        "words": _pack(b"\n".join([words[i] for i in own])), "trained": _pack(trained[own], "<i8")}], schema=kinds)

    return table.select("batch", "words", "trained").mapInArrow(run, _WORDS)


def _runs(arrow: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    rows = (row for batch in arrow for k in range(0, batch.num_rows, 16) for row in batch.slice(k, 16).to_pylist())
    return groupby(rows, key=lambda r: r[key])


def counted(words: DataFrame, slices: int) -> DataFrame:
    """Per batch and slice: corpus count and number of each of its words. `known`: words of the slice that training holds, once per slice."""
    kinds = _schema(_COUNTS)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in _runs(arrow, "slice"):
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            held = []
            for row in group:  # one slice of the vocabulary
                names = _open(row["words"]).split(b"\n")
                held.append((row["batch"], row["places"], np.fromiter(map(numbers.__getitem__, names), np.int64, len(names)), _open(row["trained"], "<i8")))
            counts = np.zeros(len(numbers), np.int64)
            for _, _, own, trained in held:
                counts[own] += trained
            if (len(numbers) + 1) * slices >= 2**32:
                raise OverflowError("more than 4 billion distinct words: word numbers have 32 bits")
            known = int((counts > 0).sum())
            for batch, places, own, _ in held:
                yield pa.RecordBatch.from_pylist([{
                    "batch": batch, "slice": k, "places": places, "counts": _pack(counts[own], "<i8"),
                    "numbers": _pack(own * slices + k, "<u4"), "known": known}], schema=kinds)
                known = 0

    dealt = words.repartition(parts(words.sparkSession), "slice").sortWithinPartitions("slice", "batch")
    return dealt.mapInArrow(run, _COUNTS)


_PAIRS = ("batch long, shard int, contexts binary, followers binary, context_counts binary, follower_counts binary, "
          "trained binary, n_docs binary, docs binary, times binary, base binary")


def pairs_of(table: DataFrame, counts: DataFrame, shards: int, total: int, known_words: int) -> DataFrame:
    """Per batch and shard: its word pairs with corpus counts of both words, and their documents. `base` rows (shard < 0)
    carry the documents themselves with their base scores."""
    kinds = _schema(_PAIRS)
    room = total + 0.5 * (known_words + 1)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _runs(arrow, "batch"):
            first = next(group)
            flat, lengths, held = _open(first["tokens"], "<u4").astype(np.int64), _open(first["lengths"], "<i8"), _open(first["held"], "u1").astype(bool)
            size = int(flat.max()) + 1
            count, name = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for row in group:
                places = np.cumsum(_open(row["places"], "<u4"), dtype=np.uint32)
                count[places], name[places] = _open(row["counts"], "<i8"), _open(row["numbers"], "<u4")
            doc = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(doc, np.log10((count[flat] + 0.5) / room), len(lengths))
            n_known = np.bincount(doc, count[flat] > 0, len(lengths)).astype("<i8")
            yield pa.RecordBatch.from_pylist([{
                "batch": number, "shard": -1 - int(number % shards), "base": b"".join(
                    len(x).to_bytes(4, "little") + x for x in (first["ids"], first["nulls"], first["held"], first["lengths"], _pack(n_known, "<i8"), _pack(base, "<f8")))}],
                schema=kinds)
            # The end of a document is the context of its start.
            before = np.append(0, flat[:-1])
            order = np.argsort(name)
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            pair = rank[before] * size + rank[flat]
            if size * size >= 2**63 // len(lengths):  # a single text beyond all bounds
                kinds_of_pair, pair = np.unique(pair, return_inverse=True)
            else:
                kinds_of_pair = None
            key, times = np.unique(pair * len(lengths) + doc, return_counts=True)
            pair, of = key // len(lengths), key % len(lengths)
            named = pair if kinds_of_pair is None else kinds_of_pair[pair]
            u, w = order[named // size], order[named % size]
            mixed = (name[u].astype(np.uint64) * np.uint64(FOLLOWER_PARTS) + (name[w] % FOLLOWER_PARTS).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
            by_shard = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)):
                own = by_shard[edges[k]:edges[k + 1]]
                starts = np.flatnonzero(np.append(True, pair[own][1:] != pair[own][:-1]))
                a, b = u[own[starts]], w[own[starts]]
                yield pa.RecordBatch.from_pylist([{
                    "batch": number, "shard": int(k), "contexts": _pack(_deltas(name[a]), "<u4"), "followers": _pack(name[b], "<u4"),
                    "context_counts": _pack(count[a], "<u4"), "follower_counts": _pack(count[b], "<u4"),
                    "trained": _pack(np.add.reduceat(times[own] * ~held[of[own]], starts), "<u4"),
                    "n_docs": _pack(np.diff(np.append(starts, len(own))), "<u4"), "docs": _pack(of[own], "<u2"), "times": _pack(times[own], "<u4")}], schema=kinds)

    nothing = {c: F.lit(None) for c in ("places", "counts", "numbers")}
    left = table.select("batch", F.lit(-1).alias("slice"), "ids", "nulls", "held", "lengths", "tokens", *[v.cast("binary").alias(c) for c, v in nothing.items()])
    right = counts.select("batch", "slice", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "nulls", "held", "lengths", "tokens")], *nothing)
    dealt = left.unionByName(right).repartition(parts(table.sparkSession), "batch").sortWithinPartitions("batch", "slice")
    return dealt.mapInArrow(run, _PAIRS)


_SUMS = "batch long, shard int, docs binary, sums binary, base binary"


def scored(pairs: DataFrame, total: int, known_words: int, mu: float) -> DataFrame:
    """Per shard: build its trie from the training counts, look its pairs up, and sum per document."""
    kinds = _schema(_SUMS)
    room = total + 0.5 * (known_words + 1)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in _runs(arrow, "shard"):
            if k < 0:
                for row in group:
                    yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "shard": k, "base": row["base"]}], schema=kinds)
                continue
            rows = []
            for row in group:  # the pairs of one shard
                u = np.cumsum(_open(row["contexts"], "<u4"), dtype=np.uint32).astype(np.uint64)
                w, cu, cw, trained = (_open(row[c], "<u4") for c in ("followers", "context_counts", "follower_counts", "trained"))
                rows.append((row["batch"], u << np.uint64(32) | w, cu, cw, trained, row["n_docs"], row["docs"], row["times"]))
            every = np.concatenate([r[1] for r in rows])
            keys, first, place = np.unique(every, return_index=True, return_inverse=True)
            cu, cw = (np.concatenate([r[c] for r in rows])[first].astype(float) for c in (2, 3))
            count = np.bincount(place, np.concatenate([r[4] for r in rows]), len(keys))
            share = (cw + 0.5) / room
            seen = count > 0
            context, follower = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            trie = Trie(context[seen], follower[seen], np.log10((count + mu * share) / (cu + mu))[seen], np.log10(mu / (cu + mu))[seen])
            known, log_p, backoff = (np.concatenate(x) for x in zip(*(
                trie.find(context[i:i + 200_000], follower[i:i + 200_000]) for i in range(0, len(keys), 200_000))))
            # A context whose known followers lie in other shards has no entry here; its backoff follows from its count.
            backoff = np.where(backoff == 0, np.log10(mu / (cu + mu)), backoff)
            value = np.where(known, log_p, backoff + np.log10(share))
            at = 0
            for batch, own, _, _, _, n_docs, docs, times in rows:
                of = value[place[at:at + len(own)]]
                at += len(own)
                docs, local = np.unique(_open(docs, "<u2").astype(np.uint32), return_inverse=True)
                sums = np.bincount(local, np.repeat(of, _open(n_docs, "<u4")) * _open(times, "<u4"), len(docs))
                yield pa.RecordBatch.from_pylist([{"batch": batch, "shard": k, "docs": _pack(_deltas(docs), "<u4"), "sums": _pack(sums, "<f8")}], schema=kinds)

    dealt = pairs.repartition(parts(pairs.sparkSession), "shard").sortWithinPartitions("shard", "batch")
    return dealt.mapInArrow(run, _SUMS)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, mu: float = 400.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out and do not train. Tokens are the words between ASCII
    white space with A-Z lower-cased, then one end. Null text is empty: one token, the end. Null ids train; repeated
    rows count and are scored each. Words training does not hold have the base model's share for an unknown word.
    Other columns are not carried. The input must be a repeatable scan.
    """
    spark = docs.sparkSession
    slices = SLICES_PER_PARTITION * parts(spark)
    table = stored(batches_of(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "lm-batches")
    counts = stored(counted(sliced_words(table, slices), slices), "lm-counts")
    total = table.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    known = counts.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    shards = max(parts(spark), -(-total // SHARD_TOKENS))
    sums = scored(pairs_of(table, counts, shards, total, known), total, known, mu)
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _runs(arrow, "batch"):
            columns, score = None, None
            for row in group:  # base rows have the lowest shard
                if row["base"] is not None:
                    columns, at = [], 0
                    for kind in ("<i8", "u1", "u1", "<i8", "<i8", "<f8"):
                        n = int.from_bytes(row["base"][at:at + 4], "little")
                        columns.append(_open(row["base"][at + 4:at + 4 + n], kind))
                        at += 4 + n
                    score = np.zeros(len(columns[0]))
                else:
                    score[np.cumsum(_open(row["docs"], "<u4"), dtype=np.uint32)] += _open(row["sums"], "<f8")
            ids, nulls, held, lengths, n_known, base = columns
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=nulls.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(n_known),
                pa.array(np.full(len(ids), total)), pa.array(base), pa.array(score)], schema=kinds)

    return sums.repartition(parts(spark), "batch").sortWithinPartitions("batch", "shard").mapInArrow(run, _SCORES)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
