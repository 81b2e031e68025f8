"""Token counts by byte-pair merging on a heap and a linked list; no token ids are made.

The symbols of a pretoken form a doubly linked list.  A heap holds every adjacent pair that has a merge rank.  The
lowest rank (leftmost on ties) is popped again and again; a pair whose symbols have changed meanwhile is skipped.  The
count is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq

import regex
from pyspark.sql import DataFrame

from depthlens.llm import byte_level
from depthlens.llm.text import Memo, made_once, map_batches, texts

#: Fixed value: the pattern by which the public byte-level vocabulary cuts text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space of that pattern (Unicode White_Space).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


class Merges:
    """Merge ranks over small integers: symbols 0-255 are bytes, 256 + r is what the merge of rank r makes."""

    def __init__(self, merges: list[tuple[str, str]], symbols: list[str]):
        number = {s: i for i, s in enumerate(symbols)}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault(number[a] << 32 | number[b], r)
            number.setdefault(a + b, 256 + r)
        self.makes = [number[a + b] for a, b in merges]

    def merged_length(self, word: bytes) -> int:
        """Number of tokens that ``word`` becomes."""
        n = len(word)
        if n < 2:
            return n
        rank, makes, symbols = self.rank.get, self.makes, [*word, -1]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]  # n: a stop that is part of no pair
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(word[i] << 32 | word[i + 1])) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if rank(symbols[i] << 32 | symbols[j]) != r:
                continue  # its symbols have changed since
            joined = symbols[i] = makes[r]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            count -= 1
            if (r := rank(joined << 32 | symbols[k])) is not None:
                heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 32 | joined)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return count


class Counter:
    """Counts tokens of texts for one vocabulary; words and blank-separated parts are memoized."""

    def __init__(self, vocabulary: str):
        _, merges, special = byte_level.parse(vocabulary)
        self.merges = Merges(merges, byte_level.byte_symbols())
        self.pattern = regex.compile(PRETOKENS)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = Memo(self._word, 96 << 20)
        self.parts = Memo(self._part)

    def _word(self, word: str) -> int:
        return self.merges.merged_length(word.encode())

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def _part(self, part: str) -> int:
        """Tokens of a blank and ``part``; -1 if white space at its edges ties it to its neighbours."""
        if not part or part[0] in _SPACE or part[-1] in _SPACE:
            return -1
        return self._plain(" " + part)

    def _text(self, text: str) -> int:
        """A blank before a character that is no white space always starts a pretoken: parts are independent."""
        first, *rest = text.split(" ")
        if first and first[-1] in _SPACE:
            return self._plain(text)
        counts = list(map(self.parts.__getitem__, rest))
        if counts and min(counts) < 0:
            return self._plain(text)
        return self._plain(first) + sum(counts)

    def count(self, text: str) -> int:
        """Special strings inside a text are one token each, as is the tokenizer's default."""
        if self.special is None or not self.special.search(text):
            return self._text(text)
        return sum(map(self._text, self.special.split(text))) + len(self.special.findall(text))

    def trim(self):
        self.words.trim()
        self.parts.trim()


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One pass, no shuffle.  Null and empty texts count 0; repeated rows are counted each; other columns are not read.
    """
    text, digest = byte_level.read_vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def run(c):
        counter = made_once(("count", digest), lambda: Counter(shared.value))
        counts = [counter.count(t.decode()) if t else 0 for t in c["text"]]
        counter.trim()
        return {
            "doc_id": c["doc_id"], "n_bytes": [len(t) if t else 0 for t in c["text"]], "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    return map_batches(texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
