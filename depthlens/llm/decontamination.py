"""Benchmark decontamination with suffix arrays over the training texts.

Each piece of a training partition is a shard: its words are numbered by the benchmark's vocabulary (0: in no item), and
the suffixes that can begin a match (their first two words stand together at the start of a test suffix) are sorted.
Every test suffix is found in every shard by binary search; the range it spans in the suffix array gives all places
where it occurs.  Occurrences that continue each other on one diagonal are one verbatim match, with its place and length.

The benchmark is read in blocks of bounded size (usually one), each of them broadcast; documents are never shuffled to
meet it.
"""

from __future__ import annotations

import hashlib
from itertools import repeat
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from depthlens.llm.text import made_once, map_batches, texts

#: Text bytes of the benchmark that one broadcast block may hold.
BLOCK_BYTES = 8 << 20
#: Bytes of words: digits, letters (lower-cased) and everything beyond ASCII; other bytes separate.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class TestSuffixes:
    """Windows of one benchmark block: every suffix of ``width`` words, and short items whole."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        self.width, self.vocabulary = width, {}
        number = self.vocabulary.setdefault
        coded = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(t)], np.uint32) for _, t in items]
        rows, lengths, owner, offset = [], [], [], []
        for i, c in enumerate(coded):
            for s in range(max(1, len(c) - width + 1) if len(c) else 0):
                w = c[s : s + width]
                rows.append(np.pad(w, (0, width - len(w))))
                lengths.append(len(w))
                owner.append(i)
                offset.append(s)
        grid = np.array(rows, np.uint32).reshape(-1, width)
        lengths = np.array(lengths, np.int64)
        distinct, which = np.unique(np.column_stack([grid, lengths.astype(np.uint32)]), axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.length = distinct[:, width].astype(np.int64)
        low = distinct[:, :width]
        inside = np.arange(width) < self.length[:, None]
        self.low, self.high = keys(low), keys(np.where(inside, low, 0xFFFFFFFF).astype(np.uint32))
        by = np.argsort(which, kind="stable")
        self.owner, self.offset = np.array(owner, np.int64)[by], np.array(offset, np.int64)[by]
        self.first = np.searchsorted(which[by], np.arange(len(distinct) + 1))
        self.ids = [i for i, _ in items]
        # what a suffix must begin with to be in the suffix array
        self.alone = np.zeros(len(self.vocabulary) + 1, bool)
        self.alone[low[self.length == 1, 0]] = True
        self.bits = 1 << max(16, int(8 * len(distinct) + 1).bit_length())
        self.pair = np.zeros(self.bits, bool)
        two = low[self.length >= 2].astype(np.int64)
        if len(two):
            self.pair[self._pair(two[:, 0], two[:, 1])] = True

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) % self.bits

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (place, window) with a window's occurrence in ``codes``, which ends in ``width`` zeros."""
        n = len(codes) - self.width
        begins = (codes[:n] > 0) & (codes[1 : n + 1] > 0) & self.pair[self._pair(codes[:n], codes[1 : n + 1])]
        at = np.flatnonzero(begins | self.alone[codes[:n]])
        if not len(at) or not len(self.length):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffixes = keys(codes[at[:, None] + np.arange(self.width)].astype(np.uint32))
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        lo, hi = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at[order[np.repeat(lo, n) + inside]], window


def keys(grid: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * grid.shape[1]}").reshape(-1)


class Shard:
    """Occurrences of all windows in a piece of documents."""

    def __init__(self, tests: TestSuffixes, texts: list[bytes | None]):
        coded = [tests.code(words_of(t)) for t in texts]
        gap = np.zeros(tests.width, np.int64)
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        codes = np.concatenate([x for c in coded for x in (c, gap[:1])] + [gap])
        self.tests = tests
        place, self.window = tests.search(codes)
        self.doc = np.searchsorted(self.begins, place, side="right") - 1
        self.start = place - self.begins[self.doc]
        marks = np.zeros(len(codes) + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + tests.length[self.window], -1)
        self.hit = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])  # hit words before each place

    def intervals(self) -> dict[int, np.ndarray]:
        """Per document with hits: the stretches of hit words (first, end)."""
        out, order = {}, np.lexsort((self.start, self.doc))
        doc, lo = self.doc[order], self.start[order]
        hi = lo + self.tests.length[self.window[order]]
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, [d, d + 1])
            ends = np.maximum.accumulate(hi[a:b])
            cut = np.flatnonzero(lo[a + 1 : b] > ends[:-1]) + 1
            out[d] = np.column_stack([lo[a:b][np.concatenate([[0], cut])], ends[np.concatenate([cut - 1, [b - a - 1]])]])
        return out

    def hits(self) -> np.ndarray:
        return self.hit[self.begins + self.sizes] - self.hit[self.begins]

    def items(self) -> list[list]:
        """Per document the ids of the items that have a window in it."""
        t, out = self.tests, [[] for _ in self.sizes]
        pair = np.unique(self.doc * max(1, len(t.length)) + self.window)
        doc, window = np.divmod(pair, max(1, len(t.length)))
        for d, w in zip(doc.tolist(), window.tolist()):
            out[d] += [t.ids[i] for i in t.owner[t.first[w] : t.first[w + 1]].tolist()]
        return [sorted({str(i) for i in x if i is not None}) for x in out]

    def matches(self):
        """(document, item, first word in the document, in the item, length in words) of maximal verbatim matches."""
        t = self.tests
        n = t.first[self.window + 1] - t.first[self.window]
        one = np.repeat(np.arange(len(n)), n)
        use = t.first[self.window][one] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, start, length = self.doc[one], self.start[one], t.length[self.window[one]]
        item, offset = t.owner[use], t.offset[use]
        order = np.lexsort((start, start - offset, item, doc))
        doc, item, start, offset, length = (x[order] for x in (doc, item, start, offset, length))
        if not len(doc):
            return
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (start[1:] - offset[1:] == start[:-1] - offset[:-1])
        new = np.flatnonzero(np.concatenate([[True], ~(same & (start[1:] == start[:-1] + 1))]))
        last = np.append(new[1:], len(doc)) - 1
        for a, b in zip(new.tolist(), last.tolist()):
            yield int(doc[a]), t.ids[int(item[a])], int(start[a]), int(offset[a]), int(start[b] + length[b] - start[a])


def _blocks(benchmark: DataFrame) -> list:
    """Broadcast blocks of the benchmark with a key of their own; each holds about ``BLOCK_BYTES`` of text at most."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES) or 1
    parts = [items] if count == 1 else [items.filter(_block(count) == b) for b in range(count)]
    context = benchmark.sparkSession.sparkContext
    return [(uuid4().hex, context.broadcast([(r.item_id, bytes(r.text)) for r in p.toLocalIterator()])) for p in parts]


def _block(count: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(count))


def _tests(block, width: int) -> TestSuffixes:
    key, items = block
    return made_once(("tests", key, width), lambda: TestSuffixes(items.value, width))


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Maximal verbatim matches: doc_id, item_id, doc_start, item_start, n_words (places in words, from 0).

    Matches have ``width`` words or more, or are a whole shorter item.  Null and empty texts and items match nothing; a
    repeated document or item row gives its matches again.
    """
    id_type = benchmark.schema["item_id"].dataType.simpleString()

    def finder(block):
        def run(c):
            found = list(Shard(_tests(block, width), c["text"]).matches())
            cols = list(zip(*found)) or [[]] * 5
            return {
                "doc_id": [c["doc_id"][d] for d in cols[0]], "item_id": list(cols[1]), "doc_start": list(cols[2]),
                "item_start": list(cols[3]), "n_words": list(cols[4]),
            }
        return run

    schema = f"doc_id long, item_id {id_type}, doc_start long, item_start long, n_words long"
    out = None
    for block in _blocks(benchmark):
        part = map_batches(texts(docs), finder(block), schema)
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window (``width`` consecutive words of an item, or the whole of a shorter
    one).  Null and empty texts have no words; items without words have no window; item ids count once, null ids not at
    all.  One block: one pass without shuffle.  More blocks: the hit stretches of each are merged per document row.
    """
    blocks = _blocks(benchmark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(blocks) == 1:
        def whole(c):
            s = Shard(_tests(blocks[0], width), c["text"])
            return _digest(c["doc_id"], s.sizes.tolist(), s.hits().tolist(), s.items())

        return map_batches(texts(docs), whole, schema)

    def part(block):
        def run(c):
            s = Shard(_tests(block, width), c["text"])
            found, items = s.intervals(), s.items()
            at = sorted(found)
            return {
                "doc_id": [c["doc_id"][d] for d in at], "text_hash": [c["text_hash"][d] for d in at],
                "hits": [found[d].tobytes() for d in at], "items": [items[d] for d in at],
            }
        return run

    keyed = texts(docs, F.xxhash64("text").alias("text_hash"))
    found = None
    for block in blocks:
        one = map_batches(keyed, part(block), "doc_id long, text_hash long, hits binary, items array<string>")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("doc_id", "text_hash").agg(
        F.collect_set("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    sizes = map_batches(
        keyed, lambda c: {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "n_words": [len(words_of(t)) for t in c["text"]]},
        "doc_id long, text_hash long, n_words long",
    ).alias("d")
    f = found.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    joined = sizes.join(f, same, "left").select("d.doc_id", "d.n_words", "f.hits", "f.items")

    def merge(c):
        return _digest(c["doc_id"], c["n_words"], [_total(h) for h in c["hits"]], [i or [] for i in c["items"]])

    return map_batches(joined, merge, schema)


def _total(stretches: list[bytes] | None) -> int:
    at = n = 0
    for lo, hi in sorted(map(tuple, np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 2) for h in stretches]).tolist())) if stretches else []:
        n += max(0, hi - max(lo, at))
        at = max(at, hi)
    return n


def _digest(ids, words, hits, items) -> dict:
    return {
        "doc_id": ids, "n_words": words, "n_hit": hits, "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [h > 0 for h in hits],
    }


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark.

    One pass per block of the benchmark, no shuffle.  Rows with null or empty texts stay.
    """
    for block in _blocks(benchmark):
        def clean(batches, block=block):
            for batch in batches:
                hits = Shard(_tests(block, width), batch.column("__text").to_pylist()).hits()
                yield batch.take(np.flatnonzero(hits == 0)).drop_columns(["__text"])

        docs = docs.withColumn("__text", F.col("text").cast("binary")).mapInArrow(clean, docs.schema)
    return docs
