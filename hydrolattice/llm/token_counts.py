"""Token counts of byte-level BPE texts by merging on a heap and a linked list, without token ids."""

from __future__ import annotations

import hashlib
import heapq
import json
from pathlib import Path

import regex
from pyspark.sql import DataFrame

from .shared import map_texts, process_wide

#: The published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = 20
_PLACE = 32  # bits of a place in a word
_AT = (1 << _PLACE) - 1
MAX_CACHED = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of one vocabulary file (the JSON of a byte-level BPE)."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        model = data["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or data.get("normalizer") or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE without normalizer is expected")
        added = data.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.prefix = data["pre_tokenizer"].get("add_prefix_space", False)
        number = byte_letters()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[number[left] << _SHIFT | number[right]] = rank
            self.made.append(number.setdefault(left + right, len(number)))
        self.pattern = regex.compile(PATTERN)
        self.spaced = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0]) (?=[^\s\x1c-\x1f\x85\xa0])")
        self.of_word: dict[str, int] = {}
        self.of_chunk: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Symbols left after popping the lowest-rank adjacent pair until none is left: symbols minus merges."""
        n = len(word)
        if n < 2:
            return n
        symbols, rank, made = list(word), self.rank, self.made
        pairs = [rank.get(a << _SHIFT | b, -1) for a, b in zip(word, word[1:])]  # rank of the pair that starts at each symbol
        pairs.append(-1)
        heap = [r << _PLACE | i for i, r in enumerate(pairs) if r >= 0]
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heapq.heappop(heap)
            i = top & _AT
            now = pairs[i]
            if now != top >> _PLACE and (now < 0 or made[now] != made[top >> _PLACE]):
                continue  # one side has merged elsewhere
            merges += 1
            symbols[i] = symbol = made[now]
            j = after[i]
            after[i] = k = after[j]
            pairs[j] = -1
            if k < n:
                before[k] = i
                pairs[i] = r = rank.get(symbol << _SHIFT | symbols[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << _PLACE | i)
            else:
                pairs[i] = -1
            h = before[i]
            if h >= 0:
                pairs[h] = r = rank.get(symbols[h] << _SHIFT | symbol, -1)
                if r >= 0:
                    heapq.heappush(heap, r << _PLACE | h)
        return n - merges

    def chunk(self, chunk: str) -> int:
        total, known = 0, self.of_word
        for word in [chunk] if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else self.pattern.findall(chunk):
            count = known.get(word)
            if count is None:
                count = self.merged(word.encode())
                if len(word) <= 64:
                    known[word] = count
            total += count
        if len(chunk) <= 64:
            self.of_chunk[chunk] = total
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. No pre-token crosses a single space between two visible characters,
        so each distinct chunk between such spaces is counted once and looked up afterwards."""
        if not text:
            return 0
        if self.prefix and not text[0].isspace():
            text = " " + text
        pieces = text.split(" ")
        words, breaks = text.split(), len(pieces) - 1 + text.count("\n")
        if len(words) != breaks + 1 or sum(map(len, words)) + breaks != len(text):  # other space characters, runs, or one at an end
            pieces = self.spaced.split(text)
        known = self.of_chunk
        total = self.chunk(pieces[0])
        for piece in pieces[1:]:
            piece = " " + piece
            count = known.get(piece)
            total += self.chunk(piece) if count is None else count
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token."""
        for known in (self.of_word, self.of_chunk):
            if len(known) > MAX_CACHED:
                known.clear()
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_counts(docs: DataFrame, keep: list[str], vocabulary_path: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The file is read on the driver and goes to the tasks with the function. Missing and empty texts have 0 bytes and 0
    tokens; repeated rows stay.
    """
    vocabulary = Path(vocabulary_path).read_text()

    def build():
        counter = process_wide(f"merges {hashlib.sha256(vocabulary.encode()).hexdigest()}", lambda: MergeCounter(vocabulary))

        def compute(texts: list[str]):
            counts = [counter.count(t) for t in texts]
            return [len(t.encode()) for t in texts], counts, [c > limit for c in counts]

        return compute

    return map_texts(docs, text, keep, "n_bytes bigint, n_tokens bigint, over_limit boolean", build)
