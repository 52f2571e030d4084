"""BPE encoding and decoding of whole texts (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.wordbpe import default_path, merges, pretokenizer

WORDS_KEPT = 400_000
LONGEST_KEPT = 48


class _Words(dict):
    """Packed ids by word. Bounded: it starts over when full, which costs time only."""

    def __init__(self, path: str):
        super().__init__()
        self.of_word, self.encode = pretokenizer(path).of_word, merges(path).encode

    def pack(self, pretokens: list[str]) -> bytes:
        return np.array([i for p in pretokens for i in self.encode(p)], "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self.pack(self.of_word(word))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def packed_ids(text: str, path: str) -> bytes:
    """Token ids of one text as little-endian unsigned 32-bit integers."""
    words = _words(path)
    out = []
    for found, whole, special in pretokenizer(path).segments(text):
        out.extend(map(words.__getitem__, found) if whole else [words.pack([p]) for p in found])
        if special is not None:
            out.append(special.to_bytes(4, "little"))
    return b"".join(out)


def decoded(packed: bytes, path: str) -> str:
    """Vocabulary strings of the ids, joined as the library joins tokens when a vocabulary names no decoder: by a space."""
    return " ".join(map(merges(path).strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Adds `bpe_ids` (binary, little-endian unsigned 32-bit ids) and `bpe_text` (what decoding them gives) to each row.

    One narrow pass, no shuffle; words already encoded in the same Python worker are looked up. Null or empty text:
    no ids and an empty string. Strings of special tokens inside a text become those tokens, as the library does.
    Repeated rows stay; the other columns are kept as they are (an own `bpe_ids` or `bpe_text` column is replaced).
    """
    path = tokenizer or default_path()
    docs = docs.drop("bpe_ids", "bpe_text")
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(b"").alias("bpe_ids"), F.lit("").alias("bpe_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = [packed_ids(t or "", path) for t in batch.column(at).to_pylist()]
                texts = pa.array([decoded(i, path) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), texts],
                                                 names=[*batch.schema.names, "bpe_ids", "bpe_text"])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.floor(F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"), F.sha2(F.encode("bpe_text", "UTF-8"), 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
