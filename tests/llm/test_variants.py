"""Spelling variants against all pairs of words, compared letter by letter."""

import collections
import random
import re
import zlib

import pytest

from exselect.llm import variants


def _distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def _plain(rows, least=7, count=2, factor=10):
    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and _distance_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield (w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]])


@pytest.mark.parametrize("least_frequent,kept,at_once", [(192, 300_000, 200_000), (3, 50, 7), (1, 400, 1000)])
def test_variants_equal_all_pairs(spark, monkeypatch, least_frequent, kept, at_once):
    monkeypatch.setattr(variants, "LEAST_FREQUENT", least_frequent)
    monkeypatch.setattr(variants, "WORDS_KEPT", kept)
    monkeypatch.setattr(variants, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefé×ñ") for _ in range(rng.randrange(7, 13))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "abababab", "Strasse" * 9, "x" * 64, "y" * 65, "y" * 66, "z" * 300]

    def worse(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]])

    pool = [*stems * 12]
    pool += [v for w in stems for v in [worse(w) for _ in range(4)] for _ in range(rng.choice([1, 2, 3, 14]))]
    pool += [worse(worse(w)) for w in stems for _ in range(4)] * 2
    pool += ["keywordsx"] * 900 + ["keywordsxx"] * 60 + ["keywordsxxx"] * 3
    rng.shuffle(pool)
    rows = [(k, ", ".join(pool[k::120]).replace("a", rng.choice("aA"))) for k in range(120)] + [(None, None), (5, ""), (None, "é" * 9 + " 日本語abcdefgh " * 2), (7, "same words here repeated"), (7, "same words here repeated")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = variants.spelling_variants(df, rewrite=variants.dropped_letter).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = list(_plain(rows))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_every_pair_of_near_words_has_a_common_key():
    rng = random.Random(5)
    for _ in range(60):
        words = list({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randrange(6, 10))) for _ in range(80)})
        counts = collections.Counter(s[k:k + z] for w in words for s in [b"\0" + w + b"\0"] for z in (2, 3, 4) for k in range(len(s) - z + 1))
        grams = variants.Grams({g: n for g, n in counts.items() if n > rng.choice([2, 8, 30, 200])})
        keys = {w: grams.keys(w) for w in words}
        for a in words:
            for b in words:
                if a < b and variants.one_edit(a, b):
                    assert keys[a] & keys[b], (a, b)


def test_one_edit():
    rng = random.Random(6)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) for _ in range(120)]
    assert all(variants.one_edit(a.encode(), b.encode()) == (a != b and _distance_one(a, b)) for a in words for b in words)


def test_no_words(spark):
    df = spark.createDataFrame([(1, "short one"), (2, None)], "doc_id long, text string")
    assert variants.spelling_variants(df).count() == 0 and variants.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(df, least_length=5)
