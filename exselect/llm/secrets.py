"""Secret scan (operator 3). DataFrame functions only, one narrow pass, no shuffle.

Base kinds are found by pattern. The method adds, per character class, the parts of candidate strings in which every
character lies in a window of high Shannon entropy; the window slides with incremental counts, so a step costs two
counts whatever the window. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the task.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper"]
BASE = KINDS[:3]

#: Candidates that are no secrets whatever their entropy: identifiers, dates, words joined by punctuation, alphabets, dummies.
#: No group is repeated without a bound: Java's matcher would recurse once per repeat, and runs may have any length.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}([T_-]?[0-9]{2}-?[0-9]{2}-?[0-9]{2})?$",
    r"^(?!.*([A-Za-z][0-9]|[0-9][A-Za-z])).*[A-Za-z0-9][=+/_-]+[A-Za-z0-9]",
    r"(?i)example|dummy|placeholder|x{6}|0{8}",
    r"(?i)abcdefghijkl|0123456789abcdef",
]


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    characters: str
    pattern: str
    threshold: float
    #: Patterns that a run has to hold.
    holds: tuple[str, ...] = ("[0-9]", "[A-Za-z]")


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX_CLASS = CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", "0-9a-fA-F", 3.0)
BASE64_CLASS = CharacterClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", "A-Za-z0-9+/_=-", 4.0)

#: For keys from 16 characters: thresholds that at most about 0.4 % of the windows of random keys of 16, 32, 32 and 62 symbols miss.
#: "=" only pads, so it parts names from values. Mixed case counts like a digit where it is not that of words put together.
KEY_WINDOW = 16
BLOCK = 64
KEY_CLASSES = (
    CharacterClass("entropy_hex", HEX_CLASS.characters, HEX_CLASS.pattern, 2.5),
    CharacterClass("entropy_lower", _DIGITS + _LOWER, "0-9a-z", 3.0),
    CharacterClass("entropy_upper", _DIGITS + _LOWER.upper(), "0-9A-Z", 3.0),
    CharacterClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", "A-Za-z0-9+/_-", 3.25,
                   ("[A-Za-z]", "[0-9]|[a-z][A-Z]{2}|[a-z][A-Z][a-z][A-Z]")),
)
#: The patterns of ALLOWED that fit whole runs only, and the others as pieces of fixed length.
ALLOWED_RUNS = ALLOWED[:3]
DUMMIES = {"(?i)example": 7, "(?i)dummy": 5, "(?i)placeholder": 11, "(?i)x{6}": 6, "0{8}": 8, "(?i)abcdefghijkl": 12, "(?i)0123456789abcdef": 16}


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"),
                    end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def running(sizes: Column) -> Column:
    """Running sums of an array of integers, block by block, so that no long array is copied at each step."""
    def sums(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")), lambda acc: acc["out"])

    def shifted(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return bound(ends, lambda ends: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(b, lambda n: n + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))))

    def blocked(sizes: Column) -> Column:
        count = F.ceil(F.size(sizes) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: sums(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(sizes) > 0, bound(blocks, shifted)).otherwise(F.array().cast("array<int>"))

    return bound(sizes, blocked)


def placed(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (match, value, start, end) of the leftmost non-overlapping matches, from the texts between them."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    pairs = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("match"),
        F.regexp_extract_all(text, regex, F.lit(value_group)).alias("value"))

    def with_ends(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["match"])))
        return bound(ends, lambda ends: F.transform(pairs, lambda p, i: F.struct(
            p["match"].alias("match"), p["value"].alias("value"), (F.get(ends, i) - F.char_length(p["match"])).alias("start"), F.get(ends, i).alias("end"))))

    return bound(pairs, with_ends)


def found(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters."""
    long = F.filter(placed(text, pattern, value_group), lambda m: F.char_length(m["value"]) >= least)
    return F.when(text.rlike(pattern), F.transform(long, lambda m: _span(kind, m["start"], m["end"]))).otherwise(_none())


def _allowed(value: Column, allow: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in allow:
        hit = hit | value.rlike(pattern)
    return hit


def bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def high_entropy(value: Column, start: Column, of: CharacterClass, window: int) -> Column:
    """Spans of `value` covered by windows whose entropy in bits reaches the class's threshold, touching ones merged.

    S = sum of c log2 c over the characters of the window changes by the one that comes in and the one that goes out;
    the entropy is log2(window) - S / window.
    """
    size, none = len(of.characters), F.lit(-1)
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    least = window * (math.log2(window) - of.threshold)  # S at the threshold

    def changed(counts: Column, place: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), place - 1), F.array(F.get(counts, place - 1) + by), F.slice(counts, place + 1, F.lit(size)))

    def slide(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            comes, goes, full = F.get(places, i), F.get(places, i - window), i >= window

            def entered(counts: Column) -> Column:
                n = F.get(acc["counts"], comes - 1)
                m = F.get(counts, goes - 1)
                s = acc["s"] + F.get(terms, n + 1) - F.get(terms, n)
                return F.struct(
                    F.when(full, changed(counts, goes, -1)).otherwise(counts).alias("counts"),
                    F.when(full, s + F.get(terms, m - 1) - F.get(terms, m)).otherwise(s).alias("s"))

            def judged(now: Column) -> Column:
                good = (i >= window - 1) & (now["s"] <= F.lit(least + 1e-9))
                first, end = i - (window - 1), i + 1
                joins = good & (acc["close"] >= first)
                starts = good & (acc["close"] < first)
                done = starts & (acc["close"] >= 0)
                return F.struct(
                    now["counts"].alias("counts"), now["s"].alias("s"),
                    F.when(starts, first).otherwise(acc["open"]).alias("open"),
                    F.when(joins | starts, end).otherwise(acc["close"]).alias("close"),
                    F.when(done, F.concat(acc["out"], F.array(_span(of.kind, start + acc["open"], start + acc["close"]))))
                    .otherwise(acc["out"]).alias("out"))

            return bound(bound(changed(acc["counts"], comes, 1), entered), judged)

        zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("s"), none.alias("open"), none.alias("close"), _none().alias("out"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1), zero, step,
            lambda acc: F.when(acc["close"] < 0, acc["out"]).otherwise(
                F.concat(acc["out"], F.array(_span(of.kind, start + acc["open"], start + acc["close"])))))

    chars = F.slice(F.split(value, "(?!^)"), F.lit(1), F.char_length(value))
    return bound(F.transform(chars, lambda c: F.call_function("instr", F.lit(of.characters), c)), slide)


def entropy_spans(text: Column, of: CharacterClass, window: int, allow: list[str]) -> Column:
    """Spans in the maximal runs of the class that hold what it asks for, have `window` characters and are not allowed."""
    pattern = f"(?<![{of.pattern}])[{of.pattern}]{{{window},}}"
    candidates = F.filter(
        placed(text, pattern), lambda c: reduce(and_, [c["match"].rlike(h) for h in of.holds]) & ~_allowed(c["match"], allow))
    spans = F.flatten(F.transform(candidates, lambda c: high_entropy(c["match"], c["start"], of, window)))
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def blanked(text: Column, dummies: dict[str, int]) -> Column:
    """`text` with blanks for each match of the patterns, which have the given numbers of characters."""
    out = text
    for pattern, size in dummies.items():
        out = F.regexp_replace(out, pattern, " " * size)
    return F.when(text.rlike("|".join(f"({p})" for p in dummies)), out).otherwise(text)


def scan(docs: DataFrame, text: str = "text", window: int = 24, allow: list[str] | None = None,
         classes: tuple[CharacterClass, ...] = (HEX_CLASS, BASE64_CLASS), dummies: dict[str, int] | None = None) -> DataFrame:
    """Adds `secrets`: array of (start, kind_no, end, kind), by start and then kind. An own `secrets` column is replaced.

    Null or empty text has none; repeated rows are scanned each. Kinds may overlap. `allow` (patterns over a whole
    candidate) only silences the entropy kinds; matches of the base kinds always stay. `dummies` (pattern: characters)
    part the runs of the entropy kinds and silence nothing beside themselves.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    allow = ALLOWED if allow is None else allow
    docs = docs.drop("secrets").withColumn("_runs", blanked(body, dummies) if dummies else body)
    spans = F.concat(
        found(body, ASSIGN, "assign", 2, 6), found(body, ACCESS, "access"), found(body, HEX, "hex"),
        *[entropy_spans(F.col("_runs"), of, window, allow) for of in classes])
    return docs.withColumn("secrets", F.array_sort(spans)).drop("_runs")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found_in = scan(docs, window=KEY_WINDOW, allow=ALLOWED_RUNS, classes=KEY_CLASSES, dummies=DUMMIES)

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(BASE))
    return found_in.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                           joined(F.col("secrets")).alias("spans"))
