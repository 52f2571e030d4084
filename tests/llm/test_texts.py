"""Archives, token counts, BPE, secrets: against the libraries themselves or plain loops, on awkward rows."""

import base64
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from exselect.llm import bpe, secrets, token_counts, warc
from exselect.llm.wordbpe import default_path

TEXTS = [None, "", "  ", "don't I'LL we'Ve", "<|endoftext|>a<|startoftext|> b <|ENDOFTEXT|>", "é café ÅΟΔΥΣΣΕΥΣ İ ǅ", "x\0y \x1c z\x85w",
         "²³ ¼ ٣ 一二三 日本語 👍🏽", "a" * 3000, "가각", "same text", "same text"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x600), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(50)) for _ in range(60)]
    rows = [(None if i == 3 else i % 70, t, "x") for i, t in enumerate(TEXTS + odd)]
    return spark.createDataFrame(rows, "doc_id long, text string, bpe_ids string").repartition(3).persist()


def test_bpe_equals_library(texts):
    lib = Tokenizer.from_file(default_path())
    rows = bpe.encode(texts).collect()
    assert len(rows) == texts.count()
    for row in rows:
        ids = lib.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["bpe_ids"], "<u4").tolist() == ids
        assert row["bpe_text"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(texts.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [200, 24 << 20])
def test_token_counts_equal_library(texts, chars, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_CHARS", chars)
    lib = Tokenizer.from_file(default_path())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in texts.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(texts).collect()) == want
    assert token_counts.token_counts(texts.limit(0)).count() == 0


MARK = "WARC/1.1\r\n"
PAGES = [(1, "u", "x" * 1000 + MARK + "y"), (2, None, None), (3, "u\r\nEvil: 1", ""), (4, "u", MARK * 5), (5, "u", "é\r\n" * 900), (6, "u", "\r\n\r\n" + MARK),
         (None, "u", "dup"), (7, "u", "dup"), (7, "u", "dup"), (8, "u", "dup"), (9, "u", "WARC/1.1\r"), (10, "u", "q" * 99 + MARK + "q")]


@pytest.mark.parametrize("compression,size", [("gzip", 100), ("none", 7), ("none", 1 << 20)])
def test_archives_round_trip(spark, tmp_path, compression, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "archives")
    back = warc.archive_pages(pages, path, compression=compression, chunk_bytes=size).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in back) == sorted((str(i), len((h or "").encode()), sha(h)) for i, _, h in PAGES)
    types = {(r.page_id, r.record_type, r.refers_to) for r in back if r.page_id in (None, 2, 3, 7, 8)}
    assert types == {(None, "revisit", 8), (2, "revisit", 3), (3, "response", None), (7, "revisit", 8), (8, "response", None)}
    if compression == "none":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        split = warc.payloads(warc.read_archives(spark, path)).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(map(str, split)) == sorted(map(str, back))


def test_segments_are_told_before_they_are_parsed(spark, tmp_path):
    pages = spark.createDataFrame([*PAGES, (20, "u", "about warc-segment-number: 1")], "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    whole = warc.archive_pages(pages, path, chunk_bytes=100).collect()
    all_records, few = warc.read_archives(spark, path), warc.read_archives(spark, path, segments_only=True)
    number = F.col("header").getItem("warc-segment-number")
    assert few.count() < all_records.count() and few.where(number.isNotNull()).count() == all_records.where(number.isNotNull()).count() > 0
    assert sorted(map(str, whole)) == sorted(map(str, warc.payloads(all_records).collect()))


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    back = warc.archive_pages(pages, str(tmp_path / "a"), min_bytes=4).collect()
    assert {r.record_type for r in back} == {"response"}
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_broken_archive_is_refused(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="broken record"):
        warc.payloads(warc.read_archives(spark, str(tmp_path / "x.warc"))).collect()


def _spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for of in (secrets.HEX_CLASS, secrets.BASE64_CLASS):
        for m in re.finditer(f"[{of.pattern}]{{24,}}", text):
            run = m.group()
            if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(re.search(a, run) for a in secrets.ALLOWED):
                continue
            covered = [False] * len(run)
            for i in range(len(run) - 23):
                window = run[i:i + 24]
                if -sum(window.count(c) / 24 * math.log2(window.count(c) / 24) for c in set(window)) >= of.threshold - 1e-10:
                    covered[i:i + 24] = [True] * 24
            out += [(m.start() + p.start(), secrets.KINDS.index(of.kind), m.start() + p.end(), of.kind)
                    for p in re.finditer("1+", "".join("01"[c] for c in covered))]
    return sorted(out)


def test_secrets_equal_plain_loops(spark):
    rng, chars = random.Random(3), string.ascii_letters + string.digits + "+/_=-"
    word = lambda a, b, of=chars: "".join(rng.choice(of) for _ in range(rng.randrange(a, b)))
    rows = [None, "", "é😀 token = 'abc123def'", "secret=token : abcdefgh API_KEY:\"x.y.z.9\"", "AKIA" * 9 + "X1", "x" * 20000 + " token=1234567",
            word(300, 301, "0123456789abcdefABC"), "aaaa1111" * 20 + word(30, 31) + "b2" * 40, "3f2504e0-4f89-11d3-9a0c-0305e82c3301"]
    rows += [" ".join(word(5, 90) for _ in range(8)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, secrets int")
    for row in secrets.scan(df).collect():
        assert [tuple(s) for s in row.secrets] == _spans(row.text or ""), row.text
    assert secrets.scan(df.limit(0)).count() == 0
    assert "Python" not in secrets.scan(df.select("doc_id", F.col("text")))._jdf.queryExecution().toString()


def _key_spans(text):
    blank, out = text, []
    for pattern, size in secrets.DUMMIES.items():
        blank = re.sub(pattern, " " * size, blank)
    for of in secrets.KEY_CLASSES:
        for m in re.finditer(f"[{of.pattern}]{{16,}}", blank):
            run = m.group()
            if not all(re.search(h, run) for h in of.holds) or any(re.search(a, run) for a in secrets.ALLOWED_RUNS):
                continue
            covered = [False] * len(run)
            for i in range(len(run) - 15):
                window = run[i:i + 16]
                if -sum(window.count(c) / 16 * math.log2(window.count(c) / 16) for c in set(window)) >= of.threshold - 1e-10:
                    covered[i:i + 16] = [True] * 16
            out += [(m.start() + p.start(), secrets.KINDS.index(of.kind), m.start() + p.end(), of.kind)
                    for p in re.finditer("1+", "".join("01"[c] for c in covered))]
    return out


def test_keys_of_every_alphabet_are_found(spark, tmp_path):
    rng = random.Random(8)
    alphabets = {"entropy_hex": "0123456789abcdef", "entropy_lower": string.ascii_lowercase + string.digits,
                 "entropy_upper": string.ascii_uppercase + "234567", "entropy_base64": string.ascii_letters + string.digits + "+/"}
    rows, keys = [], []
    for kind, of in alphabets.items():
        for size in (20, 24, 32):
            for _ in range(25):
                keys.append((kind, "".join(rng.choice(of) for _ in range(size))))
                rows.append(f"é {keys[-1][1]} end")
    key = "x7Gq" + "".join(rng.choice(alphabets["entropy_base64"]) for _ in range(36))
    block = "".join(rng.choice(alphabets["entropy_base64"]) for _ in range(3000))
    long = [f"EXAMPLE_KEY={key}==", f"{block[:1500]}Dummy{block[1500:]}"]
    none = ["3f2504e0-4f89-11d3-9a0c-0305e82c3301", "x" * 40 + "1", "some-words-put-together-2024", "0123456789ABCDEF" * 2, "AnExtraordinarilyLongWord",
            "2024-01-31T23-59-59", "", None]
    rows += long + none
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in secrets.op3_secrets(spark, str(tmp_path)).collect()}
    for i, text in enumerate(rows):
        base = [s for s in _spans(text or "") if s[1] < 3]
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + _key_spans(text or ""))), text
    missed = [k for i, k in enumerate(keys) if k[0] not in got[i]]
    assert len(missed) <= 0.03 * len(keys), missed
    n = len(keys)
    assert "entropy_base64:12:52" in got[n] and f"entropy_base64:0:1500,entropy_base64:1505:{len(long[1])}" in got[n + 1]
    assert not any(got[n + 2 + i] for i in range(len(none)))


def test_runs_of_a_million_characters(spark):
    """Each kind of run at full length: the matcher must not recurse and positions must not be copied per match."""
    texts = {"parts": ("a-1-" * 250_000, 0), "dashes": ("-" * 10**6, 0), "words": ("some words. " * 83_000, 0),
             "access": ("AKIA" * 250_000, 1), "assignments": ("token=abcdef1 " * 71_428, 71_428)}
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string").repartition(4)
    got = secrets.scan(df, window=secrets.KEY_WINDOW, allow=secrets.ALLOWED_RUNS, classes=secrets.KEY_CLASSES, dummies=secrets.DUMMIES)
    found = {r.doc_id: (r.n, r.end) for r in got.selectExpr("doc_id", "size(secrets) AS n", "try_element_at(secrets, -1).end AS end").collect()}
    assert {k: n for k, (n, _) in found.items()} == {k: n for k, (_, n) in texts.items()}
    assert found["access"][1] == 10**6 and found["assignments"][1] == 14 * 71_428 - 1
