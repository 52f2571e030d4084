"""Pre-tokens and merges of a BPE vocabulary whose words end in a suffix, exactly as the tokenizers library gives them."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Tokenizer


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case character by character: no rule for a sigma at the end of a word."""
    return text.replace("Σ", "σ").lower()


class Pretokenizer:
    """Texts into pre-tokens (normalised strings).

    The quick way lower-cases, splits on white space and takes the pattern's matches within each word. A character
    is trusted to it only after the library itself has treated that character the same way; texts with any other
    character, or not in composed form, go through the library's own normaliser and splitter.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.bytes_of = {ord(c): b for b, c in enumerate(byte_symbols())}
        self.trusted: set[str] = set()
        self.odd: set[str] = set()

    def by_library(self, text: str) -> list[str]:
        pieces = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[ord(c)] for c in p).decode() for p, _ in pieces]

    def of_word(self, word: str) -> list[str]:
        return self.pattern.findall(word)

    def _same(self, c: str) -> bool:
        if not unicodedata.is_normalized("NFC", c):
            return True  # never reaches the quick way
        if c.isspace():
            return self.lib.normalizer.normalize_str(c) == " "
        low = lower(c)
        probe = "".join(x + x + "a" + x + "!" + x + "1" + x for x in low)
        quick = [p for w in probe.split() for p in self.of_word(w)]
        return self.lib.normalizer.normalize_str(c) == low and self.by_library(probe) == quick

    def quick(self, text: str) -> bool:
        seen = set(text)
        for c in seen - self.trusted - self.odd:
            (self.trusted if self._same(c) else self.odd).add(c)
        return (text.isascii() or unicodedata.is_normalized("NFC", text)) and (not self.odd or seen.isdisjoint(self.odd))

    def segments(self, text: str) -> list[tuple[list[str], bool, int | None]]:
        """(words, whether they still hold several pre-tokens, id of the special token that follows) in order."""
        out, at = [], 0
        ends = [(m.start(), m.end(), self.special[m.group()]) for m in self.special_pattern.finditer(text)] if "<" in text else []
        for start, end, token in [*ends, (len(text), len(text), None)]:
            part = text[at:start]
            out.append((lower(part).split(), True, token) if self.quick(part) else (self.by_library(part), False, token))
            at = end
        return out


class Merges:
    """Merge ranks as a priority queue over a doubly linked list of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + suffix] for c in byte_symbols()]
        self.rank: dict[int, tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], (k, vocab[a + b]))

    def encode(self, pretoken: str) -> list[int]:
        """Take the lowest rank, leftmost first; an entry is stale once either of its symbols has changed."""
        data = pretoken.encode()
        if not data:
            return []
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n, rank = len(symbols), self.rank
        queue = []
        for i in range(n - 1):
            pair = symbols[i] << 32 | symbols[i + 1]
            if pair in rank:
                queue.append((rank[pair][0], i, pair))
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != pair:
                continue  # stale
            symbols[i], symbols[j] = rank[pair][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] << 32 | symbols[k]
                if pair in rank:
                    heapq.heappush(queue, (rank[pair][0], i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] << 32 | symbols[i]
                if pair in rank:
                    heapq.heappush(queue, (rank[pair][0], h, pair))
        return [s for s in symbols if s >= 0]


@lru_cache(maxsize=2)
def pretokenizer(path: str) -> Pretokenizer:
    return Pretokenizer(path)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)
