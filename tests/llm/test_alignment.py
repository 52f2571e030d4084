"""Token alignment against a plain loop over whole texts, encoded by the libraries."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from exselect.llm import alignment
from exselect.llm.wordbpe import byte_symbols


def _plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_symbol = {c: k for k, c in enumerate(byte_symbols())}
    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(of_symbol[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends = []
        for own in (bytes_a, bytes_b):
            at, out = 0, []
            for x in own:
                at += len(x)
                out.append(at)
            ends.append(out)
        where = dict(zip(ends[1], ids_b))
        links = [(where[e], x) for x, e in zip(ids_a, ends[0]) if e in where]
        groups, last = [], 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, end) if last < e <= cut) for ids, end in zip((ids_a, ids_b), ends)))
            last = cut
        count.update(links)
        docs.append((doc_id, ids_a, ids_b, groups, links))
    best = collections.Counter()
    for (y, _), n in count.items():
        best[y] = max(best[y], n)
    for doc_id, ids_a, ids_b, groups, links in docs:
        yield (doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else "")


ODD = [None, "", " ", "  two  spaces ", "\n", "a\n\nb\tc \n d", "x\r\ny\r", "nb\xa0sp  em", "<|endoftext|> <s></s> <0x41>", "a▁b", "▁", "é é ﬁ ½", "😀😀 👩‍👩‍👧 가각 \U0001F9FF\U00010348",
       "don't I'LL we've 1234,5", "\0 \x01\x7f", "q" * 5000, " ".join("wörter" for _ in range(3000)), "same text", "same text", "﻿bom", "tab\there"]


@pytest.mark.parametrize("chars", [300, 6 << 20])
def test_alignment_equals_whole_texts(spark, chars, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", chars)
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x2000, 0x2070), 32, 32, 10, rng.randrange(0x4E00, 0x5000), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(60)) for _ in range(60)]
    plain = [" ".join(rng.choice(["the", "of,", "naïve", "Straße.\nNext", "token", "  ", "1999", "über"]) for _ in range(40)) for _ in range(30)]
    rows = [(None if k == 4 else k % 90, t) for k, t in enumerate(ODD + odd + plain)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, batch string").repartition(3)
    got = alignment.alignments(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _plain(rows)))
    assert alignment.alignments(df.limit(0)).count() == 0


def test_ends_follow_spans_and_bytes():
    def ends(spans, sizes):
        found = alignment.token_ends(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), np.array(sizes))
        return None if found is None else found.tolist()

    assert ends([(0, 2), (2, 6), (5, 6), (5, 6), (6, 7)], [2, 2, 1, 1, 1]) == [2, 4, 5, 6, 7]
    assert ends([(0, 0), (0, 0), (0, 3)], [1, 1, 1]) == [1, 2, 3]
    assert ends([(0, 2)], [3]) is None


def test_chunks_side_by_side_are_chunks_alone():
    tools = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    chunks = [" the", "\nNext", " ", "\t", " wörter,", "  two", " a▁b", "\n\n", " 😀", " \U00010348x", " <s>", " end"]
    assert tools.cuts and [tools._aligned([c])[0] for c in chunks] == tools.align(chunks)
    assert tools.align(chunks)[6] is None
