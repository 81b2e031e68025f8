"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Every document is a sequence of line ids.  A suffix starts at each line; its rank by its first ``k`` lines comes from
sorting the pairs (rank of the first k/2 lines, rank of the k/2 lines behind them) of all suffixes, so depth doubles each
round.  Suffixes that share a rank are an interval of the suffix array whose common prefix has ``k`` lines or more:
a run of lines that occurs several times.  Suffixes alone in their interval take no further part, which leaves only
repeated lines after the first round.  In each interval the copy that comes first (smallest document id, then line)
stays, the others delete their ``k`` lines; what the rounds delete merges into maximal runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from depthlens.llm.text import map_batches
from depthlens.session import write_table

_SUFFIX = ("doc_id", "text_hash", "ln")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ln, h1, h2, words) of all lines; rows of one id and text count once, null ids not at all."""
    some = docs.filter("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lines = some.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.select(
        *_SUFFIX, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )


def _ranked(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes that share ``by`` with others: their rank (in the order of ``by``) and whether they come first.

    Groups are counted with partial sums and sorted by range; the sorted, written groups are numbered in their order.
    """
    groups = suffixes.groupBy(*by).agg(F.min(F.struct(*_SUFFIX)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    numbered = write_table(
        groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks"
    )
    joined = suffixes.join(numbered.drop("n"), by)
    return joined.select(*_SUFFIX, "rank", "words", (F.struct(*_SUFFIX) == F.col("first")).alias("is_first"))


def repeated_suffixes(docs: DataFrame):
    """Yield (depth, suffixes): for depths 1, 2, 4, ... the suffixes whose first ``depth`` lines occur elsewhere too."""
    lines = line_table(docs).dropDuplicates(list(_SUFFIX))
    alive = write_table(_ranked(lines, ["h1", "h2"]), "suffixes")
    depth = 1
    while not alive.isEmpty():
        yield depth, alive
        ahead = alive.select(
            "doc_id", "text_hash", (F.col("ln") - depth).alias("ln"), F.col("rank").alias("rank2"), F.col("words").alias("words2")
        )
        pairs = alive.select(*_SUFFIX, F.col("rank").alias("rank1"), "words").join(ahead, list(_SUFFIX))
        pairs = write_table(pairs.withColumn("words", F.col("words") + F.col("words2")).drop("words2"), "pairs")
        alive = write_table(_ranked(pairs, ["rank1", "rank2"]), "suffixes")
        depth *= 2


def removal_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """(doc_id, text_hash, runs): maximal runs of lines to delete, as packed pairs of first line and end.

    A line goes if it lies in a run of ``min_lines`` lines (a power of two) that occurs at an earlier place, or if it has
    ``min_words`` words or more and occurs at an earlier place itself.
    """
    found = None
    for depth, suffixes in repeated_suffixes(docs):
        if depth >= min_lines or depth == 1:
            later = suffixes.filter("NOT is_first" if depth >= min_lines else f"NOT is_first AND words >= {min_words}")
            later = later.select("doc_id", "text_hash", "ln", F.lit(depth).alias("depth"))
            found = later if found is None else found.unionByName(later)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, runs binary")
    listed = found.groupBy("doc_id", "text_hash").agg(F.collect_list("ln").alias("ln"), F.collect_list("depth").alias("depth"))
    return map_batches(
        listed, lambda c: {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "runs": [_merged(a, b) for a, b in zip(c["ln"], c["depth"])]},
        "doc_id long, text_hash long, runs binary",
    )


def _merged(starts: list[int], depths: list[int]) -> bytes:
    lo = np.array(starts, np.int64)
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate((lo + np.array(depths, np.int64))[order])
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return np.column_stack([lo[np.concatenate([[0], cut])], hi[np.concatenate([cut - 1, [len(lo) - 1]])]]).tobytes()


def _kept(text: str | None, runs: bytes | None) -> tuple[str | None, int, int, int, int]:
    """Text left, lines, lines removed, runs, longest run."""
    lines = text.split("\n") if text else []
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2).tolist() if runs else []
    if not pairs:
        return text, len(lines), 0, 0, 0
    kept, at = [], 0
    for lo, hi in pairs:
        kept += lines[at:lo]
        at = hi
    kept += lines[at:]
    return "\n".join(kept), len(lines), len(lines) - len(kept), len(pairs), max(hi - lo for lo, hi in pairs)


def _with_runs(docs: DataFrame, *options) -> DataFrame:
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    runs = removal_runs(docs, *options).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text"), F.col("runs").alias("__runs"))
    return keyed.join(runs, (F.col("doc_id") == F.col("__doc")) & (F.col("__hash") == F.col("__text")), "left").drop("__doc", "__text", "__hash")


def line_digests(docs: DataFrame, min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, n_runs, longest_run (lines), kept_sha256 (of the text left).

    Null and empty texts have no lines.  Rows of one id and text are one document; null ids lose nothing.
    """

    def run(c):
        out = [_kept(t, r) for t, r in zip(c["text"], c["__runs"])]
        return {
            "doc_id": c["doc_id"], "n_lines": [x[1] for x in out], "n_removed": [x[2] for x in out], "n_runs": [x[3] for x in out],
            "longest_run": [x[4] for x in out], "kept_sha256": [hashlib.sha256((x[0] or "").encode()).hexdigest() for x in out],
        }

    slim = _with_runs(docs.select("doc_id", "text"), min_lines, min_words)
    return map_batches(slim, run, "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that is left; rows whose every line went are dropped.

    ``n_chars``, where there is such a column, is set to the new length.  Null and empty texts stay as they are.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            texts, runs = batch.column("text").to_pylist(), batch.column("__runs").to_pylist()
            out = [_kept(t, r) for t, r in zip(texts, runs)]
            batch = batch.drop_columns(["__runs"])
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array([x[0] for x in out], pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
            left = np.array([not x[2] or x[2] < x[1] for x in out], bool)
            yield pa.RecordBatch.from_pydict(columns).take(np.flatnonzero(left))

    return _with_runs(docs, min_lines, min_words).mapInArrow(run, docs.schema)


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
  FROM documents WHERE text <> ''),
w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY ln) AS after,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l),
r AS (
  SELECT *, words >= 8 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, ln) > 1 AS alone,
    after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, ln) > 1 AS pair
  FROM w),
g AS (
  SELECT *, alone OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY ln), false) AS gone FROM r),
i AS (
  SELECT *, ln - row_number() OVER (PARTITION BY doc_id, gone ORDER BY ln) AS island FROM g),
runs AS (
  SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run
  FROM (SELECT doc_id, island, count(*) AS n FROM i WHERE gone GROUP BY ALL) GROUP BY ALL),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS kept
  FROM i GROUP BY ALL)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
