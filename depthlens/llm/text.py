"""Helpers shared by the text operators: Arrow maps over documents, words, stable hashes."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Documents of one Arrow batch are handled in pieces of about this many bytes, so that memory does not follow the
#: number of rows in a batch.
PIECE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more) -> DataFrame:
    """``doc_id``, the text as UTF-8 bytes (``text``), and ``more``; other columns never travel to Python."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply ``fn`` (columns as lists -> columns as lists) to pieces of each Arrow batch of ``df``.

    Rows become Python objects piece by piece: about ``PIECE_BYTES`` of all columns together, or one row.
    """
    names, types = df.columns, None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(row_bytes(batch)):
                piece = batch.slice(lo, hi - lo)
                out = fn({n: piece.column(i).to_pylist() for i, n in enumerate(names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], t) for n, t in types], names=[n for n, _ in types]
                    )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = [(f.name, f.type) for f in to_arrow_schema(_parse_datatype_string(schema))]
    return df.mapInArrow(run, schema)


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and byte strings of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PIECE_BYTES`` bytes."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES)) + 1
        yield lo, min(hi, len(sizes))
        lo = hi


def object_bytes(x) -> int:
    """About how many bytes a small object (number, string, tuple of those) takes."""
    return sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if type(x) is tuple else 0)


class Memo(dict):
    """A memo bounded in bytes: ``make`` fills missing keys, ``trim`` ages entries once half of ``limit`` is reached.

    Entries have two generations.  The older one is dropped when the younger is full, and what is asked for in
    between moves on to the younger, so frequent keys stay.
    """

    def __init__(self, make: Callable, limit: int = 48 << 20):
        super().__init__()
        self.make, self.limit, self.bytes, self.old = make, limit, 0, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.bytes += 104 + object_bytes(key) + object_bytes(value)
        return value

    def trim(self):
        if self.bytes > self.limit // 2:
            self.old = dict(self)
            self.clear()
            self.bytes = 0


def word_hashes() -> Memo:
    """Word bytes -> stable 64-bit hash."""
    return Memo(xxhash.xxh3_64_intdigest)


def hash_words(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_MADE: dict = {}


def made_once(key, make: Callable):
    """One object per Python worker and ``key`` (models, vocabularies, memos).

    Spark uses a worker again for later stages, so only the newest object is kept: when another key is asked for, the memory of
    the one before goes back to the system.
    """
    if key not in _MADE:
        if _MADE:
            _MADE.clear()
            give_back()
        _MADE[key] = make()
    return _MADE[key]


def give_back():
    """Return freed memory of this process to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
