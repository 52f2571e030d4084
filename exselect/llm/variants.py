"""Spelling variants by an index of variable-length grams (operator 12).

Grams that are too frequent are lengthened until they are rare or have the greatest length: the dictionary of frequent grams says
where. A word is decomposed into the longest grams of that dictionary that do not lie within one another. For each
word the number of grams that one edit can affect is bounded; a word one edit away shares all others, so it is found in
one of the lists of the word's rarest grams, as many as can be affected and one more. Unaffected grams keep their
place from the start of the word, if they stand left of the edit, or from its end, and so does all that stands on that side
of them: lists are merged by that part. Where such a part holds frequent grams only, its list is split by what is left
of the other part without one letter. Words that meet are compared.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.tables import shuffled, stored

SHORTEST, LONGEST = 2, 4
LEAST_FREQUENT = 256
DICTIONARY = 1 << 12
LONG_WORD = 64
WORDS_KEPT = 300_000
PAIRS_AT_ONCE = 200_000

_END = b"\0"
_LETTERS = {*range(0x61, 0x7B), *range(0xC0, 0x100)}
#: Latin-1: A-Z in lower case, other letters as they are, a space for all else.
_FOLD = bytes(c if c in _LETTERS else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

Rewrite = Callable[[int | None], Callable[[bytes], bytes]]


def word_counts(docs: DataFrame, least_length: int, rewrite: Rewrite | None = None) -> DataFrame:
    """(word, n) of all maximal runs of letters, A-Z in lower case, that have at least `least_length` letters after `rewrite`.

    `rewrite(doc_id)` gives the function that each distinct run (Latin-1) of the document goes through; it may shorten it.
    """
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = [w.decode("latin-1") for w in counts], list(counts.values())
            counts.clear()
            for k in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k:k + 10_000]), pa.array(n[k:k + 10_000], pa.int64())], names=["word", "n"])

        for batch in arrow:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter([w for w in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= least_length])
                change = rewrite(doc_id) if rewrite else bytes
                for word, n in found.items():
                    word = change(word)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= WORDS_KEPT:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame) -> dict[bytes, int]:
    """Grams of SHORTEST to LONGEST letters, ends of words included, that are too frequent to be looked up.

    A gram is frequent beyond 1 / DICTIONARY of all letters, so that there are at most DICTIONARY of each length.
    """
    letters = words.agg(F.coalesce(F.sum(F.length("word") + 2), F.lit(0))).first()[0]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])
            counts.clear()
            return out

        for batch in arrow:
            for word in batch.column(0).to_pylist():
                s = _END + word.encode("latin-1") + _END
                for size in range(SHORTEST, LONGEST + 1):
                    counts.update([s[k:k + size] for k in range(len(s) - size + 1)])
                if len(counts) >= WORDS_KEPT:
                    yield flush()
        yield flush()

    grams = words.select("word").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = max(LEAST_FREQUENT, letters // DICTIONARY)
    return {bytes(r.gram): r.n for r in grams.where(F.col("n") > most).collect()}


class Grams:
    """Decomposition by a dictionary of frequent grams: these, if shorter than LONGEST, are lengthened by any letter."""

    def __init__(self, frequent: dict[bytes, int]):
        self.frequent = frequent
        self.tails = {g[k:] for g in frequent if len(g) < LONGEST for k in range(1, len(g))}

    def spans(self, s: bytes) -> list[tuple[int, int]]:
        """(start, end) of the longest gram at each place, without those that lie within an earlier one."""
        out, covered = [], 0
        for start in range(len(s) - SHORTEST + 1):
            end = start + SHORTEST
            while end < len(s) and end - start < LONGEST and s[start:end] in self.frequent:
                end += 1
            if end > covered:
                out.append((start, end))
                covered = end
        return out

    def affected(self, s: bytes, spans: list[tuple[int, int]]) -> int:
        """The most grams that one replaced, deleted or inserted letter can change.

        Those that hold the place; to its left, those from the first place on where the letters up to the edit are the
        start of a longer gram; to its right, those up to the last place to which the letters behind it are the end of a longer one.
        """
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        frequent, tails, n, most = self.frequent, self.tails, len(s), 0
        for i in range(1, n):
            first = i - 1
            for k in range(max(0, i - LONGEST + 1), i - 1):
                if s[k:i] in frequent:
                    first = k
                    break
            left = min(bisect_left(starts, first), bisect_right(ends, i))
            # The gap before letter i, and the letter itself.
            for behind, right in ((i, bisect_left(starts, i)), (i + 1, bisect_right(starts, i))):
                last = behind + 1
                for k in range(min(n, behind + LONGEST - 1), behind + 1, -1):
                    if s[behind:k - 1] in tails:
                        last = k
                        break
                changed = max(bisect_right(ends, last), right) - left
                if changed > most:
                    most = changed
        return most

    def keys(self, word: bytes) -> set[bytes]:
        """What a word is listed under; two words that differ by one letter have a key in common."""
        out: set[bytes] = set()
        if len(word) > LONG_WORD:
            for size in (len(word), len(word) - 1):  # one half of the shorter word is left as it is
                out |= {b"%d<" % size + word[:size // 2], b"%d>" % size + word[-(size - size // 2):]}
        if len(word) <= LONG_WORD + 1:
            s = _END + word + _END
            spans = self.spans(s)
            size = [self.frequent.get(s[a:b], 0) for a, b in spans]
            rarest = sorted(range(len(spans)), key=lambda k: (size[k], s[slice(*spans[k])], k))[:self.affected(s, spans) + 1]
            rare = [k for k, n in enumerate(size) if not n]
            for k in rarest:
                a, b = spans[k]
                for side, part, rest, few in ((b"<", s[:b], s[b:-1], rare and rare[0] <= k), (b">", s[a:], s[1:a], rare and rare[-1] >= k)):
                    if few:
                        out.add(side + part)
                    else:
                        out.add(side + part + b"\1" + rest)
                        out.update([side + part + b"\1" + rest[:j] + rest[j + 1:] for j in range(len(rest))])
        return out


def listed(words: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(key, word, n): each word under the hashes of its keys."""
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, digest = Grams(frequent), xxhash.xxh3_64_intdigest
        for whole in arrow:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                keys = [list(map(digest, grams.keys(w.encode("latin-1")))) for w in batch.column(0).to_pylist()]
                times = [len(x) for x in keys]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), times))
                flat = np.array([x for own in keys for x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


class _Words:
    """Words of at most LONG_WORD + 2 letters as rows of a table, and which letters each holds an odd number of times."""

    def __init__(self, words: list[bytes]):
        lengths = np.array([len(w) for w in words])
        self.width = int(lengths.max(initial=0)) + 1
        self.lengths = lengths.astype(np.int16)
        self.table = np.frombuffer(b"".join([w.ljust(self.width, _END) for w in words]), np.uint8).reshape(-1, self.width)
        bit = np.left_shift(np.uint64(1), np.arange(256, dtype=np.uint64) & np.uint64(63))
        bit[0] = 0
        self.odd = np.bitwise_xor.reduce(bit[self.table], axis=1)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """one_edit for pairs of rows. One edit changes two of the odd letters at most."""
        out = np.zeros(len(i), bool)
        may = np.flatnonzero((np.abs(self.lengths[i] - self.lengths[j]) < 2) & (np.bitwise_count(self.odd[i] ^ self.odd[j]) < 3))
        i, j = i[may], j[may]
        swap = self.lengths[i] < self.lengths[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        same = self.lengths[i] == self.lengths[j]
        out[may[same]] = (self.table[i[same]] != self.table[j[same]]).sum(axis=1) == 1
        long, short = self.table[i[~same]], self.table[j[~same]]
        first = (long != short).argmax(axis=1)
        differ = long[:, 1:] != short[:, :-1]
        last = np.where(differ.any(axis=1), self.width - 2 - differ[:, ::-1].argmax(axis=1), -1)
        out[may[~same]] = last < first
        return out


def near_words(lists: DataFrame) -> DataFrame:
    """(word, near, near_n): words one edit apart, both ways; a pair that meets in several lists may come several times."""
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.asarray(table["key"])
            twice = np.flatnonzero(keys[1:] == keys[:-1])
            own = np.union1d(twice, twice + 1)
            if not len(own):
                return
            table, keys = table.take(pa.array(own)), keys[own]
            names = table["word"].to_pylist()
            words = [w.encode("latin-1") for w in names]
            long = np.array([len(w) > LONG_WORD + 2 for w in words])
            short = _Words([b"" if x else w for w, x in zip(words, long.tolist())])
            names, counts = pa.array(names, pa.string()), table["n"].combine_chunks()
            i, step = np.arange(len(keys)), 1
            near_i, near_j = [], []
            while True:
                i = i[i + step < len(keys)]
                i = i[keys[i] == keys[i + step]]
                if not len(i):
                    break
                for k in range(0, len(i), PAIRS_AT_ONCE):
                    a, b = i[k:k + PAIRS_AT_ONCE], i[k:k + PAIRS_AT_ONCE] + step
                    near = np.zeros(len(a), bool)
                    slow = long[a] | long[b]
                    near[~slow] = short.near(a[~slow], b[~slow])
                    near[slow] = [one_edit(words[x], words[y]) for x, y in zip(a[slow].tolist(), b[slow].tolist())]
                    near_i.append(a[near])
                    near_j.append(b[near])
                step += 1
            a, b = np.concatenate(near_i), np.concatenate(near_j)
            for k in range(0, len(a), 10_000):
                x, y = (pa.array(np.append(p[k:k + 10_000], q[k:k + 10_000])) for p, q in ((a, b), (b, a)))
                yield pa.RecordBatch.from_arrays([names.take(x), names.take(y), counts.take(y)], names=["word", "near", "near_n"])

        held: list[pa.RecordBatch] = []  # whole batches, and the list that is still open
        for batch in arrow:
            keys = np.asarray(batch.column(0))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held.append(batch.slice(0, last) if last else batch)
            if last:
                yield from found(pa.Table.from_batches(held))
                held = [batch.slice(last)]
        if held:
            yield from found(pa.Table.from_batches(held))

    return shuffled(lists, "key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far each round."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, rewrite: Rewrite | None = None,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, of at least `least_length` letters and
    `least_count` occurrences. Words are near if they differ by one inserted, deleted or replaced letter. The form is the
    near word of most occurrences (of equal ones the first in code-point order) if it has `factor` times as many as the word,
    else null; the root is the last word that forms lead to, the word itself if there is none. Null and empty texts have no words, null ids are no
    matter, repeated rows count each time, texts and words may be of any length. Other columns are not carried.
    """
    if least_length + 2 < 2 * LONGEST:
        raise ValueError(f"words under {2 * LONGEST - 2} letters may have no gram that an edit leaves as it is")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = stored(word_counts(source, least_length, rewrite).where(F.col("n") >= least_count), "variant-words")
    pairs = near_words(listed(words, frequent_grams(words)))
    # A word of k letters has at most some 115 (k + 1) near words.
    near = pairs.groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near")).alias("near"))
    near = near.select("word", F.size("near").alias("n_near"), F.array_min("near").alias("best"))
    best, size = F.col("best.near"), -F.col("best.less")
    strong = size >= F.col("n") * factor
    found = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, best).alias("form"), F.when(strong, size).alias("form_n")),
        "variant-forms")
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def dropped_letter(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The query's misspellings: a run loses a letter where 31 divides the crc32 of `<doc_id>:<run>` in UTF-8."""
    begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
        if h % 31:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1:]

    return change


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=dropped_letter)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
