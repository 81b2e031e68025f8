"""Toxicity by a classifier chain.

Categories are predicted one after the other; the linear model of each sees the words of a document and the logits of
the categories before it.  In training those logits come from models that have not seen the row (out-of-fold), so later
links learn from predictions as they will meet them.  Rows are drawn from the labels up to a bound per class and weighted
back to the classes' shares; prediction is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from depthlens.llm.text import Memo, made_once, map_batches, texts

BITS = 18
#: Labelled rows per class of the last category that the chain is fitted on.
PER_CLASS = 2_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _indices(word: bytes) -> tuple[int, ...]:
    """The word and its beginnings of 4, 5 and 6 bytes: insults come with many endings."""
    parts = [b"=" + word] + [word[:n] for n in (4, 5, 6) if len(word) >= n]
    return tuple(zlib.crc32(p) & ((1 << BITS) - 1) for p in parts)


def word_features(texts: list[bytes | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the distinct words and word beginnings of each text, one text after the other, and their numbers."""
    found = [
        set(chain.from_iterable(map(memo.__getitem__, set(t.translate(_LETTERS).split())))) if t else () for t in texts
    ]
    sizes = np.array([len(f) for f in found], np.int64)
    out = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
    memo.trim()
    return out, sizes


class Link(NamedTuple):
    """Linear model of one category: word weights, weights of the logits before it, intercept."""

    words: np.ndarray
    before: np.ndarray
    intercept: float


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def logits(link: Link, index: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return row_sums(link.words[index], sizes) + before @ link.before + link.intercept


def telling_words(col: np.ndarray, positive: np.ndarray, n1: int, n0: int, least_rows: int, deviations: float) -> np.ndarray:
    """Words whose shares of positive and negative rows differ by ``deviations`` standard errors or more."""
    a = np.bincount(col[positive], minlength=1 << BITS)
    both = np.bincount(col, minlength=1 << BITS)
    share = both / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12))
    return np.flatnonzero((both >= least_rows) & (np.abs(a / n1 - (both - a) / n0) >= deviations * error))


def fit_link(index, sizes, before, y, weight, steps: int = 150, ridge: float = 5e-5, least_rows: int = 4, deviations: float = 4.5) -> Link:
    """Weighted logistic regression by Adam on the words that tell the classes apart; others keep weight 0."""
    total = weight.sum()
    k = before.shape[1]
    positive = (weight * y).sum()
    if total == 0 or positive in (0, total):  # one class only: its share is all there is to learn
        return Link(np.zeros(1 << BITS, np.float32), np.zeros(k), 20.0 if total and positive == total else -20.0)
    used = weight > 0
    row = np.repeat(np.arange(len(sizes)), sizes)
    seen = used[row]
    n1 = int((used & (y > 0.5)).sum())
    names = telling_words(index[seen], y[row[seen]] > 0.5, n1, int(used.sum()) - n1, least_rows, deviations)
    place = np.full(1 << BITS, -1)
    place[names] = np.arange(len(names))
    keep = (place[index] >= 0) & seen
    col, row = place[index[keep]], row[keep]
    n = np.bincount(row, minlength=len(sizes))
    theta = np.zeros(len(names) + k + 1)
    theta[-1] = np.log(positive / (total - positive))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = row_sums(theta[col], n) + before @ theta[len(names) : -1] + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        g = np.concatenate([np.bincount(col, error[row], minlength=len(names)), error @ before, [error.sum()]])
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    words = np.zeros(1 << BITS, np.float32)
    words[names] = theta[: len(names)]
    return Link(words, theta[len(names) : -1], float(theta[-1]))


def frequent_features(texts: list[bytes | None], least_rows: int = 4, step: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` without those of fewer than ``least_rows`` texts, which no link would use; built in small steps."""
    memo, parts, sizes = Memo(_indices, 16 << 20), [], []
    for lo in range(0, len(texts), step):
        index, n = word_features(texts[lo : lo + step], memo)
        parts.append(index.astype(np.int32))
        sizes.append(n)
    index, sizes = np.concatenate(parts or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])
    keep = np.bincount(index, minlength=1 << BITS)[index] >= least_rows
    before = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(sizes)
    return index[keep], before[ends] - before[ends - sizes]


def fit_chain(texts: list[bytes | None], labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> list[Link]:
    """One link per column of ``labels`` (rows x categories, NaN: unknown); ``fold`` numbers the rows' folds."""
    index, sizes = frequent_features(texts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    before, links = np.zeros((len(sizes), 0)), []
    for j in range(labels.shape[1]):
        known = ~np.isnan(labels[:, j])
        y, w = np.where(known, labels[:, j], 0.0), np.where(known, weight, 0.0)
        links.append(fit_link(index, sizes, before, y, w))
        if j + 1 < labels.shape[1]:
            unseen = np.zeros(len(sizes))
            for f in np.unique(fold):
                out = fold == f
                held = fit_link(index, sizes, before, y, np.where(out, 0.0, w))
                unseen[out] = logits(held, index[out[row]], sizes[out], before[out])
            before = np.column_stack([before, np.clip(unseen, -10, 10)])
    return links


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], per_class: int) -> DataFrame:
    """doc_id, text, one column per category, weight: at most ``per_class`` rows of either class of the last category.

    Rows are taken in the order of a hash of the id.  Several labels of one id count as their largest.
    """
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.max(F.expr(e).cast("double")).alias(n) for n, e in categories.items()]
    )
    last = list(categories)[-1]
    counts = {r[0]: r[1] for r in one.groupBy((F.col(last) > 0).alias("c")).count().collect()}
    picked = None
    for c in (True, False):
        some = one.filter((F.col(last) > 0) == F.lit(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = some.withColumn("weight", F.lit(max(1.0, counts.get(c, 0) / per_class)))
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * per_class narrow rows: a proven bound
    return texts(docs).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """Per document row: doc_id, ``p_<category>`` for each link of the chain, rejected (the last one's >= threshold).

    ``categories``: name -> SQL expression over ``labels`` that is 1, 0 or null.  Null and empty texts have no words and
    get each category's intercept; without labels, or without positive ones, nothing is rejected.
    """
    rows = training_rows(docs, labels, categories, per_class).toArrow().sort_by("doc_id")
    names = list(categories)
    y = np.column_stack([rows.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(np.float64)
    fold = np.array([zlib.crc32(str(d).encode()) % 5 for d in rows.column("doc_id").to_pylist()])
    links = fit_chain(rows.column("text").to_pylist(), y, rows.column("weight").to_numpy().astype(np.float64), fold)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(link) for link in links])

    def run(c):
        index, sizes = word_features(c["text"], made_once("toxic words", lambda: Memo(_indices)))
        before, out = np.zeros((len(sizes), 0)), {"doc_id": c["doc_id"]}
        for name, link in zip(names, shared.value):
            z = logits(Link(*link), index, sizes, before)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out[f"p_{name}"] = p.tolist()
            before = np.column_stack([before, np.clip(z, -10, 10)])
        out["rejected"] = (p >= threshold).tolist()
        return out

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", rejected boolean"
    return map_batches(texts(docs), run, schema)
