"""Hard negatives by Kronecker-packed inner products.

Components are small integers (a scaled floor), so many exact products fit into one machine word: the components of several
candidates are biased to be non-negative and put side by side into separated fields of one wide integer; one multiplication by
an anchor's component then multiplies them all, and the sum over the components holds every candidate's score in its
field, from which the bias is taken off.  Fields are as wide as the block's largest possible sum; where two or more fit
below 2**53 the wide integers are exact doubles and a matrix product does the multiplications, and beyond that Python's integers of
any width.  Nothing is rounded.

Anchors are a stated query set against all rows.  They are taken in blocks of bounded size; a block is
broadcast, and the table is scanned twice without moving a vector: once for each anchor's best rows of its own label (its positives),
once for each positive's best rows of other labels inside its score range.  A task keeps the best few per anchor only, so
what is shuffled is at most a few rows per anchor and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from depthlens.operators.ordered import top_k
from depthlens.session import write_table

#: Anchors, and components of anchors, of one broadcast block.
BLOCK_ANCHORS, BLOCK_COMPONENTS = 16_384, 4 << 20
#: Candidates and anchors multiplied at a time.
ROWS, TILE = 4096, 256
#: Scores beyond this size count as this size.
MOST_SCORE = (1 << 63) // 128

_LOW = -(1 << 62)
_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantized(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each component as doubles that hold integers; shorter vectors are filled up with zeros."""
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    sizes = np.diff(np.asarray(vectors.offsets))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows, int64) of matrices of integers; missing components count as zero."""
    d, n = min(anchors.shape[1], rows.shape[1]), len(rows)
    a, c = anchors[:, :d], rows[:, :d]
    if not d or not n or not len(a):
        return np.zeros((len(a), n), np.int64)
    bias = int(np.abs(c).max())
    sums = np.abs(a).sum(axis=1).max()
    most = 2 * bias * (int(sums) if sums < 1 << 52 else max(sum(map(int, r)) for r in np.abs(a)))
    bits = max(1, (2 * most).bit_length())
    fields = 52 // bits
    if fields and max(bias, most) < 1 << 52:
        kind = lambda x: x  # noqa: E731 - integers up to 2**53 are exact doubles
        one = 1.0
    else:  # wider than a word: Python's integers
        kind, fields, one = np.vectorize(int, otypes=[object]), 16, 1
    a, c = kind(a), kind(c)
    width = -(-n // fields)
    biased = np.zeros((fields * width, d), a.dtype)
    biased[:n] = c + bias * one
    words = sum(biased[k * width : (k + 1) * width] * (one * 2 ** (bits * k)) for k in range(fields))
    shift = sum(2 ** (bits * k) for k in range(fields))
    wide = a @ words.T + most * shift * one  # every field is non-negative now: one multiplication per anchor component
    unbias = (most + bias * a.sum(axis=1))[:, None]
    if a.dtype == object:
        out = np.concatenate([(wide >> bits * k) & ((1 << bits) - 1) for k in range(fields)], axis=1)[:, :n] - unbias
        return np.clip(out, -MOST_SCORE, MOST_SCORE).astype(np.int64)
    wide, unbias = wide.astype(np.int64), unbias.astype(np.int64)
    out = np.concatenate([(wide >> bits * k) & ((1 << bits) - 1) for k in range(fields)], axis=1)[:, :n] - unbias
    return np.clip(out, -MOST_SCORE, MOST_SCORE)


class Best:
    """The ``k`` best (score, id) of each row: higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), _LOW, np.int64)
        self.ids = np.full((rows, k), np.iinfo(np.int64).max, np.int64)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray):
        """Candidates ``ids`` (ascending) with ``scores`` (rows of ``at`` x candidates) where ``allowed``."""
        least, last = self.scores[at, -1:], self.ids[at, -1:]
        allowed = allowed & ((scores > least) | ((scores == least) & (ids < last)))
        rows = np.flatnonzero(allowed.any(axis=1))
        if not len(rows):
            return
        s, k = np.where(allowed[rows], scores[rows], _LOW), min(self.k, len(ids))
        edge = np.partition(s, -k, axis=1)[:, -k, None]
        above, tied = s > edge, (s == edge) & (edge > _LOW)
        take = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        r, c = np.nonzero(take)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        new_s = np.full((len(rows), k), _LOW, np.int64)
        new_i = np.full((len(rows), k), np.iinfo(np.int64).max, np.int64)
        new_s[r, place], new_i[r, place] = s[r, c], ids[c]
        own = np.arange(len(self.scores))[at][rows]
        all_s, all_i = np.hstack([self.scores[own], new_s]), np.hstack([self.ids[own], new_i])
        order = np.lexsort((all_i, -all_s), axis=1)[:, : self.k]
        self.scores[own], self.ids[own] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)


def _usable(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    x = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _candidates(batches, scale: float):
    """Pieces (ids ascending, labels, components) of at most ``ROWS`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            piece = batch.slice(lo, ROWS)
            ids, labels = (piece.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], quantized(piece.column("embedding"), scale)[order]


def _positives(rows: DataFrame, anchors, k: int, scale: float) -> DataFrame:
    """Per anchor number: the best ``k`` rows of each task with its label and another id."""

    def run(batches):
        a_ids, a_labels, a = anchors.value
        best = Best(len(a_ids), k)
        for ids, labels, q in _candidates(batches, scale):
            for lo in range(0, len(a_ids), TILE):
                at = slice(lo, lo + TILE)
                allowed = (labels == a_labels[at, None]) & (ids != a_ids[at, None])
                best.offer(at, packed_scores(a[at], q), ids, allowed)
        r, c = np.nonzero(best.scores > _LOW)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(best.scores[r, c]), pa.array(best.ids[r, c])], names=["anchor", "score", "vec_id"])

    return rows.mapInArrow(run, "anchor long, score long, vec_id long")


def _negatives(rows: DataFrame, anchors, positives, k: int, low_percent: int, scale: float) -> DataFrame:
    """Per anchor number and positive number: the best ``k`` rows of each task with another label inside the positive's range."""

    def run(batches):
        a_ids, a_labels, a = anchors.value
        p_scores, _ = positives.value  # anchors x positives; _LOW where there is none
        best = [Best(len(a_ids), k) for _ in range(p_scores.shape[1])]
        for ids, labels, q in _candidates(batches, scale):
            for lo in range(0, len(a_ids), TILE):
                at = slice(lo, lo + TILE)
                scores = packed_scores(a[at], q)
                other = labels != a_labels[at, None]
                for p, keep in enumerate(best):
                    top = p_scores[at, p, None]
                    keep.offer(at, scores, ids, other & (scores <= top) & (100 * scores >= low_percent * top) & (top > _LOW))
        for p, keep in enumerate(best):
            r, c = np.nonzero(keep.scores > _LOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r), pa.array(np.full(len(r), p)), pa.array(keep.scores[r, c]), pa.array(keep.ids[r, c])], names=["anchor", "positive", "score", "vec_id"]
            )

    return rows.mapInArrow(run, "anchor long, positive long, score long, vec_id long")


def _anchor_blocks(anchors: DataFrame, scale: float):
    """Distinct anchors in blocks of bounded size: (ids, labels, components) each."""
    n, components = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    count = max(-(-n // BLOCK_ANCHORS), -(-components // BLOCK_COMPONENTS))
    block = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(max(1, count)))
    for i in range(count):
        t = anchors.filter(block == i).toArrow().combine_chunks()
        if t.num_rows:
            lists = t.column("embedding").chunk(0)
            yield t.column("vec_id").to_numpy(), t.column("label").to_numpy(), quantized(lists, scale)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, embedding).

    Components count as floor(scale * x), scores are integer inner products; higher scores come first, ties by smaller vec_id.  An
    anchor's positives are its first ``positives`` rows of the same label and another id; a positive's negatives the first
    ``negatives`` rows of another label with a score from ``low_percent`` percent of the positive's score up to that score (both included;
    empty below zero).

    Rows with a null id, label, vector or component, or a component that is not finite once scaled, take no part.  Vectors
    may differ in length: missing components count as zero, and an empty vector scores 0.  Rows that repeat an id are
    rows of their own as positives and negatives; equal anchor rows give their results once.  Scores beyond ``MOST_SCORE`` count as that.  No
    anchor, or an empty table, gives no rows.
    """
    sc, used = rows.sparkSession.sparkContext, _usable(rows, scale)
    out = rows.sparkSession.createDataFrame([], _SCHEMA)
    order = [F.col("score").desc(), F.col("vec_id")]
    # written: the blocks are read one by one
    anchors = write_table(used.filter(is_anchor).distinct(), "anchors")
    for block in _anchor_blocks(anchors, scale):
        shared, size = sc.broadcast(block), len(block[0])
        best = top_k(_positives(used, shared, positives, scale), ["anchor"], order, positives).toArrow()
        scores, ids = np.full((size, positives), _LOW, np.int64), np.zeros((size, positives), np.int64)
        at = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
        scores[at], ids[at] = best.column("score").to_numpy(), best.column("vec_id").to_numpy()
        pairs = sc.broadcast((scores, ids))
        found = top_k(_negatives(used, shared, pairs, negatives, low_percent, scale), ["anchor", "positive"], order, negatives)

        def named(batches, shared=shared, pairs=pairs):
            a_ids, (scores, ids) = shared.value[0], pairs.value
            for b in batches:
                r, p = b.column("anchor").to_numpy(), b.column("positive").to_numpy()
                columns = [pa.array(a_ids[r]), pa.array(ids[r, p]), b.column("rank"), b.column("vec_id"), pa.array(scores[r, p]), b.column("score")]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        out = out.unionByName(write_table(found.mapInArrow(named, _SCHEMA), "negatives"))
    return out


HARD_NEGATIVES_SQL = """WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(c.q)) + 1), lambda i: a.q[i] * c.q[i])), 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM used WHERE vec_id % 100 = 0) a JOIN used c ON a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
