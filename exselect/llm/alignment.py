"""Alignment of two tokenizers over a corpus (operator 13).

A text is cut into chunks (white space and what follows it) that no token of either tokenizer crosses. Distinct chunks
are tokenized once per batch, side by side: character offsets of the one library and the proto spans of the other are the
coarse cuts, and where tokens share a character (split multibyte characters, byte fallback) their decoded bytes refine
them. A document is the sequence of its chunks. Linked id pairs are gathered per bounded batch of documents, counted over
the corpus in slices of the second vocabulary, and the counts go back to the batches; no pair of a document travels alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import parts, stored
from exselect.llm.wordbpe import byte_symbols

BATCH_CHARS = 6 << 20
CHUNKS_KEPT = 600_000
JOINED_CHARS = 8192
LONGEST_KEPT = 64
SLICES_PER_PARTITION = 2

_CHUNK = re.compile("[ \n\t]+[^ \n\t]*|[^ \n\t]+")
#: White space beyond space, line feed and tab: texts that hold it are not cut.
_ODD_SPACE = re.compile("[\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]")
_CROSSING = re.compile("[^ \n\t][ \n\t]")


class Aligned(NamedTuple):
    """Tokens of one chunk: its groups as text, token counts, and linked ids (second id x 2^32 + first id), one per link."""

    groups: str
    n_a: int
    n_b: int
    n_groups: int
    links: tuple[int, ...]


def token_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Byte offset at which each token ends, from the spans and byte counts of tokens.

    A span's end is a cut where it is beyond its start and the next span starts at or behind it. Tokens between two cuts
    share characters; there their bytes decide. None if spans and bytes contradict each other.
    """
    done = np.cumsum(sizes)
    cut = (ends > starts) & (np.append(starts[1:], ends[-1:]) >= ends)
    return done if (done[cut] == ends[cut]).all() else None


class Aligner:
    """Both tokenizers. The first encodes a space and the text; the second adds the space itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_a = {i: bytes(of_symbol[c] for c in s) for s, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in of_symbol for c in s)}
        self.b = SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.sizes_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.b.serialized_model_proto())
        splitter = self.a.pre_tokenizer
        # Cut before white space only if no token of either side can hold white space behind another character.
        self.cuts = (
            type(splitter).__name__ == "ByteLevel" and splitter.use_regex and self.a.normalizer is None
            and not spec.normalizer_spec.precompiled_charsmap and spec.normalizer_spec.add_dummy_prefix
            and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.escape_whitespaces
            and not any(_CROSSING.search(p.replace("▁", " ")) for p in names))
        self.known: dict[str, Aligned | None] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces of a space and the text, in order; one piece where cuts are not safe."""
        text = " " + text
        return _CHUNK.findall(text) if self.cuts and not _ODD_SPACE.search(text) else [text]

    def _tokens_a(self, text: str) -> tuple[np.ndarray, np.ndarray | None]:
        encoding = self.a.encode(text, add_special_tokens=False)
        ids = np.array(encoding.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if not text.isascii():  # characters to bytes
            data = np.frombuffer(text.encode(), np.uint8)
            spans = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[spans]
        return ids, token_ends(spans[:, 0], spans[:, 1], self.sizes_a[ids])

    def _tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray | None]:
        """The library's own space stands for the first one of the text."""
        pieces = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids, ends = np.array([p.id for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64) + 1
        if not len(ids):  # nothing but the space
            ids, ends = np.array([self.space]), np.array([1])
        # Spans lie side by side, so each begins where the one before ends.
        return ids, token_ends(np.append(0, ends[:-1]), ends, self.sizes_b[ids])

    def _side_by_side(self, chunks: list[str]) -> list[Aligned | None]:
        """Chunks that follow one another from a space on, tokenized as one text."""
        text = "".join(chunks)
        data = text.encode("utf-8", "surrogatepass")
        ids_a, ends_a = self._tokens_a(text)
        ids_b, ends_b = self._tokens_b(text)
        spelled = [b"".join(map(of.__getitem__, ids.tolist())) == data for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        if not all(spelled):
            if len(chunks) == 1:
                return [None]
            parts = [chunks[:len(chunks) // 2], chunks[len(chunks) // 2:]]  # which of them is it?
            return [x for part in parts for x in self._aligned(part)]
        if ends_a is None or ends_b is None:
            raise ValueError(f"spans contradict the bytes of tokens in {text[:80]!r}")
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = (ids_b[last_b] << 32 | ids_a[last_a]).tolist()
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, a, b = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            groups.append(f"{names_a[a] if x == a + 1 else ','.join(names_a[a:x])}|{names_b[b] if y == b + 1 else ','.join(names_b[b:y])}")
            a, b = x, y
        ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        at = np.searchsorted(cuts, ends)
        if not (cuts[np.minimum(at, len(cuts) - 1)] == ends).all():
            raise ValueError(f"a token crosses a cut in {text[:80]!r}")
        out, k = [], 0
        for stop, n_a, n_b in zip((at + 1).tolist(), np.diff(last_a[at] + 1, prepend=0).tolist(), np.diff(last_b[at] + 1, prepend=0).tolist()):
            out.append(Aligned(";".join(groups[k:stop]), n_a, n_b, stop - k, tuple(links[k:stop])))
            k = stop
        return out

    def _aligned(self, chunks: list[str]) -> list[Aligned | None]:
        """A chunk that starts with another white space follows one that is left out again."""
        if not chunks:
            return []
        return self._side_by_side(chunks) if chunks[0][0] == " " else self._side_by_side([" x", *chunks])[1:]

    def align(self, chunks: list[str]) -> list[Aligned | None]:
        """Tokens of each chunk; None where the tokens' bytes are not those of the chunk."""
        out = [self.known.get(c, 0) for c in chunks]
        new = [k for k, found in enumerate(out) if found == 0]
        alone = [k for k in new if chunks[k][-1] in " \n\t" or _ODD_SPACE.search(chunks[k])]  # white space at an end would join on
        together = sorted(set(new).difference(alone))
        batches, size = [[k] for k in alone], JOINED_CHARS
        for k in together:
            size += len(chunks[k])
            if size > JOINED_CHARS:
                batches.append([])
                size = len(chunks[k])
            batches[-1].append(k)
        for own in batches:
            for k, found in zip(own, self._aligned([chunks[k] for k in own])):
                out[k] = found
                if len(chunks[k]) <= LONGEST_KEPT:
                    if len(self.known) >= CHUNKS_KEPT:
                        self.known.clear()
                    self.known[chunks[k]] = found
        return out

    def align_text(self, text: str) -> Aligned | None:
        """A whole text at once, without cuts."""
        return self.align([" " + text])[0] if text else None


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _pack(values, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, kind).tobytes())


def _open(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


_BATCH = ("batch long, slice int, pairs binary, totals binary, ids binary, nulls binary, numbers binary, digests binary, "
          "spread binary, docs binary, times binary")


class _Batch:
    """Documents seen so far, as numbers of their distinct chunks."""

    def __init__(self):
        self.chunks: dict[str, int] = defaultdict()
        self.chunks.default_factory = self.chunks.__len__
        self.ids, self.texts, self.of, self.chars = [], [], [], 0

    def add(self, doc_id: int | None, text: str, tools: Aligner) -> None:
        cut = tools.chunks(text) if text else []
        self.ids.append(doc_id)
        self.texts.append(text)
        self.of.append(np.fromiter(map(self.chunks.__getitem__, cut), np.int64, len(cut)))
        self.chars += len(text) + 64

    def rows(self, number: int, slices: int, tools: Aligner) -> Iterator[dict]:
        found = tools.align(list(self.chunks))
        bad = np.array([f is None for f in found] or [False])
        for doc in [d for d, of in enumerate(self.of) if len(of) > 1 and bad[of].any()]:
            found.append(tools.align_text(self.texts[doc]))  # as a whole its bytes may come out right
            self.of[doc] = np.array([len(found) - 1])
        nothing = Aligned("", 0, 0, 0, ())
        self.of = [of if len(of) and all(found[k] is not None for k in of.tolist()) else of[:0] for of in self.of]
        found = [f or nothing for f in found]
        names = [f.groups for f in found]
        sizes = np.array([f[1:4] for f in found] or [(0, 0, 0)], np.int64)
        lengths = np.array([len(f.links) for f in found] or [0], np.int64)
        flat = np.fromiter(chain.from_iterable(f.links for f in found), np.int64, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        pairs, flat = np.unique(flat, return_inverse=True)
        of_slice = (((pairs >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slices
        order = np.argsort(of_slice, kind="stable")  # by slice, then by pair
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        pairs, of_slice, flat = pairs[order], of_slice[order], rank[flat]
        keys, digests, numbers = [], [], []
        for doc, of in enumerate(self.of):
            numbers.append(sizes[of].sum(axis=0))
            digests.append(hashlib.sha256(";".join([names[k] for k in of.tolist()]).encode()).digest() if len(of) else b"\0" * 32)
            n = lengths[of]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append(flat[np.repeat(begins[of], n) + inside] << 32 | doc)
        keys, times = np.unique(np.concatenate(keys), return_counts=True)
        of_pair, docs = keys >> 32, keys & 0xFFFFFFFF
        total = np.zeros(len(pairs), np.int64)  # a pair of a text whose bytes come out wrong has no link
        np.add.at(total, of_pair, times)
        yield {"batch": number, "slice": -1, "ids": _pack([i or 0 for i in self.ids], "<i8"), "nulls": _pack([i is None for i in self.ids], "u1"),
               "numbers": _pack(np.array(numbers), "<i8"), "digests": b"".join(digests), "spread": _pack(_deltas(of_pair), "<u4"),
               "docs": _pack(docs, "<u4"), "times": _pack(times, "<u4")}
        edges = np.searchsorted(of_slice, np.arange(slices + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[k], edges[k + 1])
            yield {"batch": number, "slice": k, "pairs": _pack(_deltas(pairs[own]), "<i8"), "totals": _pack(total[own], "<i8")}


def batches_of(docs: DataFrame, a_path: str, b_path: str, slices: int) -> DataFrame:
    """Per bounded batch of texts: a row (slice -1) with its documents and which pairs they hold, and a row per slice with its pairs."""
    kinds = _schema(_BATCH)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number, batch = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, _Batch()
        for whole in arrow:
            for k in range(0, whole.num_rows, 256):
                for doc_id, text in zip(*(c.to_pylist() for c in whole.slice(k, 256).columns)):
                    batch.add(doc_id, text or "", tools)
                    if batch.chars >= BATCH_CHARS:
                        for row in batch.rows(number, slices, tools):
                            yield pa.RecordBatch.from_pylist([row], schema=kinds)
                        number, batch = number + 1, _Batch()
        if batch.ids:
            for row in batch.rows(number, slices, tools):
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return docs.mapInArrow(run, _BATCH)


def _runs(arrow: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    rows = (row for batch in arrow for k in range(0, batch.num_rows, 16) for row in batch.slice(k, 16).to_pylist())
    return groupby(rows, key=lambda r: r[key])


_COUNTS = "batch long, slice int, counts binary, best binary"


def counted(table: DataFrame) -> DataFrame:
    """Per batch and slice: corpus counts of its pairs, and whether a count is the highest of its second id.

    A slice holds whole second ids. Its rows come twice: first the totals, which are added up one row at a time, then the
    pairs of each batch, which get their counts.
    """
    kinds = _schema(_COUNTS)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in _runs(arrow, "slice"):
            count: dict[int, int] = defaultdict(int)  # distinct pairs of one slice
            keys = None
            for row in group:
                pairs = np.cumsum(_open(row["pairs"], "<i8"))
                if row["totals"] is not None:
                    for pair, n in zip(pairs.tolist(), _open(row["totals"], "<i8").tolist()):
                        count[pair] += n
                    continue
                if keys is None:
                    keys = np.array(sorted(count), np.int64)
                    counts = np.array([count[p] for p in keys.tolist()], np.int64)
                    starts = np.flatnonzero(np.append(True, (keys[1:] >> 32) != (keys[:-1] >> 32)))
                    top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))
                    best = counts == top
                at = np.searchsorted(keys, pairs)
                yield pa.RecordBatch.from_pylist([{"batch": row["batch"], "slice": k, "counts": _pack(counts[at], "<i8"), "best": _pack(best[at], "u1")}], schema=kinds)

    rows = table.where("slice >= 0").select("batch", "slice", "pairs", F.explode(F.array(F.lit(False), F.lit(True))).alias("again"), "totals")
    rows = rows.withColumn("totals", F.when(~F.col("again"), F.col("totals")))
    dealt = rows.repartition(parts(table.sparkSession), "slice").sortWithinPartitions("slice", "again", "batch")
    return dealt.mapInArrow(run, _COUNTS)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `a_path` is a byte-level BPE of the tokenizers library, `b_path` a sentencepiece model with byte fallback. Null and
    empty texts, and texts whose tokens do not spell a space and the text on both sides, have zeros and an empty digest,
    and their tokens count nowhere. Rows with null or repeated ids are rows like any other, repeated texts count each time. Very long
    texts are handled whole. Other columns are not carried; an empty table gives an empty result. The input must be a
    repeatable scan.
    """
    import public_tokenizers

    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = stored(batches_of(source, a_path, b_path, SLICES_PER_PARTITION * parts(spark)), "align-batches")
    empty = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _runs(arrow, "batch"):
            first, counts, best = next(group), [np.zeros(0, np.int64)], [np.zeros(0, "u1")]
            for row in group:  # in order of slices, as the batch numbered its pairs
                counts.append(_open(row["counts"], "<i8"))
                best.append(_open(row["best"], "u1"))
            counts, best = np.concatenate(counts), np.concatenate(best).astype(np.int64)
            ids, nulls = _open(first["ids"], "<i8"), _open(first["nulls"], "u1").astype(bool)
            numbers = _open(first["numbers"], "<i8").reshape(-1, 3)
            of_pair = np.cumsum(_open(first["spread"], "<u4"), dtype=np.int64)
            docs_of, times = _open(first["docs"], "<u4").astype(np.int64), _open(first["times"], "<u4").astype(np.int64)
            sums = np.zeros((3, len(ids)), np.int64)
            for k, weight in enumerate((times, times * best[of_pair], times * counts[of_pair])):
                np.add.at(sums[k], docs_of, weight)
            digests = [first["digests"][32 * k:32 * k + 32].hex() if n else "" for k, n in enumerate(numbers[:, 0].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=nulls), *(pa.array(numbers[:, k]) for k in range(3)), *(pa.array(s) for s in sums), pa.array(digests, pa.string())],
                schema=empty)

    head = ["batch", "slice", "ids", "nulls", "numbers", "digests", "spread", "docs", "times"]
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("counts", "best")]
    left = table.where("slice < 0").select(*head, *nothing)
    right = counted(table).select("batch", "slice", *[F.lit(None).cast("binary").alias(c) for c in head[2:]], "counts", "best")
    dealt = left.unionByName(right).repartition(parts(spark), "batch").sortWithinPartitions("batch", "slice")
    return dealt.mapInArrow(run, _RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
