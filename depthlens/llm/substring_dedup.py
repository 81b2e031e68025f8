"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Every window of every text is hashed; the hashes are dealt by value over the shuffle partitions as packed arrays (about
ten bytes a window), sorted there, and a window whose hash also occurs in a document with a smaller id is reported
back to its document.  Reported windows merge into maximal intervals, which are cut from the text.

Copies inside one packed piece are settled before the shuffle: only the copy with the smallest document id travels, so
a passage that a third of all documents share is sent once per piece and not once per document.

The hash has 64 bits.  Among N windows a given window is taken for a repeat by chance with probability N / 2**64
(5e-10 for the windows of 30 GB of text).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from depthlens.llm.text import hash_words, made_once, map_batches, mix, texts, word_hashes

#: Fixed value: base of the polynomial, odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Windows of one packed piece (about 8 bytes each are held several times while it is packed).
PIECE_WINDOWS = 1_500_000


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of all windows of ``width`` values: sum of words[p + i] * BASE**(width - 1 - i) modulo 2**64.

    Prefix sums over powers of the inverse base give every window by one subtraction.
    """
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(down), dtype=np.uint64)])
        up = np.full(n - width + 1, BASE, np.uint64)
        up[0] = pow(BASE, width - 1, 1 << 64)
        return mix((sums[width:] - sums[: n - width + 1]) * np.cumprod(up))


def removal_intervals(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, text_hash (tells apart rows that share an id), and the maximal intervals to remove, as packed pairs of
    first word and end, of every document with a window that also starts in a document with a smaller id.

    Repeated windows return to their documents in one packed record per pair of partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _even_keys(spark, parts)
    keyed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = texts(keyed, F.hash("text").alias("text_hash"))

    def pack(batches):
        memo = made_once("words", word_hashes)
        held, windows = [], 0
        for batch in batches:
            ids, raw, tags = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                words = raw[i].as_py().split()
                if len(words) >= width:
                    h = window_hashes(hash_words(words, memo), width)
                    held.append((ids[i].as_py(), tags[i].as_py(), h))
                    windows += len(h)
                if windows >= PIECE_WINDOWS:
                    yield from _packed(held, buckets)
                    held, windows = [], 0
            memo.trim()
        if held:
            yield from _packed(held, buckets)

    packed = keyed.mapInArrow(pack, "bucket int, docs binary, hashes binary, low binary, high binary, wide binary, local binary")
    repeated = packed.repartition(parts, "bucket").mapInArrow(_matched(buckets), "bucket int, docs binary, starts binary")

    def merge(batches):
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ids, tags, first, end = _unpack_docs(r["docs"])
                at = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["starts"]), np.int32)
                for d, t, lo, hi in zip(ids.tolist(), tags.tolist(), first.tolist(), end.tolist()):
                    starts.setdefault((d, t), []).append(np.cumsum(at[lo:hi]))
        found = [(d, t, covered(np.concatenate(x), width).tobytes()) for (d, t), x in starts.items()]
        columns = list(zip(*found)) or [[], [], []]
        types = (pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_hash", "intervals"])

    return repeated.repartition(parts, "bucket").mapInArrow(merge, "doc_id long, text_hash int, intervals binary")


def _even_keys(spark, parts: int) -> np.ndarray:
    """One key for each of ``parts`` shuffle partitions, so that buckets come out evenly; any keys give right results."""
    slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(0, 24 * parts).groupBy(slot.alias("slot")).agg(F.min("id").alias("key")).collect()
    keys = np.arange(parts, dtype=np.int32) + 24 * parts
    for r in found:
        keys[r.slot] = r.key
    return keys


def _packed(held, buckets: np.ndarray):
    """Rows to deal: one per bucket with the smallest-id copy of each hash, and one with what is settled."""
    ids = np.array([d for d, _, _ in held], np.int64)
    tags = np.array([t for _, t, _ in held], np.int32)
    lengths = np.array([len(h) for _, _, h in held])
    row = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
    hashes = np.concatenate([h for _, _, h in held])
    start = (np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    # per hash the copy of the smallest id; other copies of a larger id are repeats already
    order = np.lexsort((ids[row], hashes))
    h = hashes[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(first) - 1
    least = ids[row[order]][first][group]
    later = order[ids[row[order]] > least]
    later.sort()
    stays = np.ones(len(hashes), bool)
    stays[later] = False
    if len(later):
        yield _record(int(buckets[hashes[0] % np.uint64(len(buckets))]), ids, tags, local=_runs(row[later], start[later]))
    at = np.flatnonzero(stays)
    bucket = (hashes[at] % np.uint64(len(buckets))).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    at, bucket = at[by], bucket[by]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    ends = np.cumsum(lengths)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        a = at[lo:hi]
        step = np.diff(a, prepend=0)  # places in the piece, ascending: small steps
        wide = step > 0xFFFF
        step16 = np.where(wide, 0xFFFF, step).astype(np.uint16)
        wide |= step16 == 0xFFFF
        yield _record(
            int(buckets[bucket[lo]]), ids, tags, lengths=ends, hashes=hashes[a].tobytes(), low=(step16 & 0xFF).astype(np.uint8).tobytes(),
            high=(step16 >> 8).astype(np.uint8).tobytes(), wide=step[wide].astype(np.int64).tobytes(), used=row[a],
        )


def _record(bucket, ids, tags, lengths=None, hashes=b"", low=b"", high=b"", wide=b"", used=None, local=b""):
    if used is None:
        docs = _pack_docs(ids, tags)
    else:  # only the documents that have a window here, with their places in the piece
        rows = np.unique(used)
        ends = lengths[rows]
        docs = _pack_docs(ids[rows], tags[rows], ends - np.diff(lengths, prepend=0)[rows], ends)
    names = ("bucket", "docs", "hashes", "low", "high", "wide", "local")
    types = (pa.int32(), *[pa.binary()] * 6)
    values = (bucket, docs, hashes, low, high, wide, local)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=list(names))


def _pack_docs(ids, tags, first=None, end=None) -> bytes:
    """Ids, tags and places column by column; ascending columns as differences, which compress well."""
    zero = np.zeros(len(ids), np.int32)
    columns = [np.diff(ids, prepend=0), tags, zero if first is None else np.diff(first, prepend=0).astype(np.int32)]
    columns.append(zero if end is None else (end - first).astype(np.int32))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.tobytes() for c in columns))


def _unpack_docs(packed: bytes):
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // 20
    ids = np.cumsum(np.frombuffer(raw, np.int64, n))
    tags, first, size = np.frombuffer(raw, np.int32, 3 * n, 8 * n).reshape(3, n)
    first = np.cumsum(first, dtype=np.int64)
    return ids, tags, first, first + size


def _runs(row: np.ndarray, start: np.ndarray) -> bytes:
    """(row, first start, count) of runs of consecutive starts, as 32-bit values."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    at = np.flatnonzero(new)
    return np.column_stack([row[at], start[at], np.diff(at, append=len(row))]).astype(np.int32).tobytes()


def _settled(r: dict, buckets: np.ndarray):
    """Records of the repeats that were settled inside one piece."""
    runs = np.frombuffer(r["local"], np.int32).reshape(-1, 3)
    n = runs[:, 2]
    starts = np.repeat(runs[:, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids, tags, _, _ = _unpack_docs(r["docs"])
    return _by_target(ids, tags, np.repeat(runs[:, 0], n), starts.astype(np.int32), buckets)


def _matched(buckets: np.ndarray):
    """All pieces of a partition's bucket: sort the hashes and report windows with a smaller id elsewhere."""

    def run(batches):
        ids, tags, hashes, rows, starts, n = [], [], [], [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["local"]:
                    yield from _settled(r, buckets)
                    continue
                of, tag, first, end = _unpack_docs(r["docs"])
                step = np.frombuffer(r["low"], np.uint8).astype(np.int64) | np.frombuffer(r["high"], np.uint8).astype(np.int64) << 8
                step[step == 0xFFFF] = np.frombuffer(r["wide"], np.int64)
                place = np.cumsum(step)
                row = np.searchsorted(end, place, side="right")
                rows.append((row + n).astype(np.int32))
                starts.append((place - first[row]).astype(np.int32))
                hashes.append(np.frombuffer(r["hashes"], np.uint64))
                ids.append(of)
                tags.append(tag)
                n += len(of)
        if not n:
            return
        ids, tags, row, start = map(np.concatenate, (ids, tags, rows, starts))
        h = np.concatenate(hashes)
        del hashes, rows, starts
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.minimum.reduceat(ids[row[order]], first)
        hit = order[ids[row[order]] > np.repeat(least, np.diff(first, append=len(h)))]
        hit.sort()
        yield from _by_target(ids, tags, row[hit], start[hit], buckets)

    return run


def _by_target(ids, tags, row, start, buckets: np.ndarray):
    """Starts by document (``row`` ascending, starts ascending within), one record per bucket that documents hash to."""
    if not len(row):
        return
    cuts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
    docs = row[cuts[:-1]]
    target = (mix(ids[docs].astype(np.uint64) ^ tags[docs].astype(np.uint64)) % np.uint64(len(buckets))).astype(np.int64)
    step = np.diff(start, prepend=0)
    step[cuts[:-1]] = start[cuts[:-1]]  # differences within a document
    z = zstandard.ZstdCompressor(level=1)
    for t in np.unique(target).tolist():
        some = np.flatnonzero(target == t)
        size = cuts[some + 1] - cuts[some]
        end = np.cumsum(size)
        steps = np.concatenate([step[cuts[i] : cuts[i + 1]] for i in some.tolist()]).astype(np.int32)
        packed = _pack_docs(ids[docs[some]], tags[docs[some]], end - size, end)
        values = ((buckets[t], pa.int32()), (packed, pa.binary()), (z.compress(steps.tobytes()), pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["bucket", "docs", "starts"])


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals (first word, end) that the windows at ``starts`` cover."""
    at = np.unique(starts).astype(np.int64)
    cut = np.flatnonzero(at[1:] > at[:-1] + width) + 1
    return np.column_stack([at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + width])


def _with_intervals(docs: DataFrame, width: int) -> DataFrame:
    """Texts travel compressed to the intervals of their row; rows with a null id or text have none."""
    def squeeze(c):
        z = zstandard.ZstdCompressor(level=1)
        return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "body": [z.compress(t) if t else None for t in c["text"]]}

    bodies = map_batches(texts(docs, F.hash("text").alias("text_hash")), squeeze, "doc_id long, text_hash int, body binary")
    return bodies.join(removal_intervals(docs, width), ["doc_id", "text_hash"], "left")


def _keep(words: list[bytes], intervals: bytes | None) -> list[bytes]:
    pairs = np.frombuffer(intervals, np.int64).reshape(-1, 2).tolist() if intervals else []
    kept, at = [], 0
    for lo, hi in pairs:
        kept += words[at:lo]
        at = hi
    return kept + words[at:] if pairs else words


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Texts without repeated windows: doc_id, n_words, n_removed, kept (the words left, joined by one blank).

    A word goes if a window over it also starts in a document with a smaller id, judged on the input.  Null texts and
    texts below ``width`` words lose nothing; rows that share an id never remove each other's words; rows with a null
    id neither lose words nor cost others any.
    """
    return map_batches(_with_intervals(docs, width), _cut(lambda kept: kept.decode()), "doc_id long, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of what is kept in place of it."""
    digest = _cut(lambda kept: hashlib.sha256(kept).hexdigest())
    return map_batches(
        _with_intervals(docs, width), lambda c: (o := digest(c)) | {"kept_sha256": o["kept"]},
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


def _cut(show):
    def run(c):
        z = zstandard.ZstdDecompressor()
        out = {"doc_id": c["doc_id"], "n_words": [], "n_removed": [], "kept": []}
        for body, intervals in zip(c["body"], c["intervals"]):
            words = z.decompress(body).split() if body else []
            kept = _keep(words, intervals)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(show(b" ".join(kept)))
        return out

    return run
