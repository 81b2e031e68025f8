"""MinHash near-dedup: bands propose candidates, odd sketches check them, full shingle sets confirm them.

Every document gives one signature: 128 MinHash samples over its set of 5-word shingles, 32 band keys of four samples
each, and an odd sketch - a bitmap in which every sample toggles one bit, so that the population count of the XOR of two
sketches estimates in how many samples (and so in how much of the union) two sets differ.

Equal sets are one class, joined by their smallest document id.  Classes that share a band key are compared, but never
as all pairs of a bucket:

1. every member against the bucket's smallest id (a star); pairs whose sketches are close are confirmed on full sets,
   and confirmed links join components;
2. buckets whose members lie in one component are done.  In the others a member outside the largest component becomes
   the next star's centre; a few rounds of this;
3. what is left of a bucket is compared across its components only, in pairs of blocks of bounded size: the members outside the
   largest component against all, those of the largest component not among each other.  The task of a pair of blocks has
   the texts too.  It looks at a pair of members if no earlier band of the two is equal (so in one bucket only), if their
   set sizes allow the similarity, and if their sketches are close; it confirms the pair on the full sets, and keeps a
   union-find: it emits confirmed links between members that were not connected yet, so fewer links than members,
   however many pairs are similar.

Two sets of similarity 0.8 share no band key with probability (1 - 0.8**4)**32 < 5e-8, of 0.85 < 1e-10.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from depthlens.llm.components import components
from depthlens.llm.text import hash_words, made_once, map_batches, mix, texts, word_hashes
from depthlens.session import write_table

SAMPLES, ROWS, SKETCH_BITS = 128, 4, 512
BANDS = SAMPLES // ROWS
#: Pairs go to the full sets while the sketches' estimate is above the threshold less this margin (about seven times
#: the standard error at 0.8).
MARGIN = 0.27
#: Members, and shingles of members, of one block of step 3.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text; of all words where it has fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words, made_once("words", word_hashes))
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, np.uint64(width))
        for i in range(width):
            out = mix(out) + h[i : len(h) - width + 1 + i]
        return np.unique(mix(out))


def _seeds(salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def min_hashes(elements: np.ndarray) -> np.ndarray:
    """Smallest value of each of ``SAMPLES`` hash functions over the elements."""
    a = (_seeds(1) | np.uint64(1)).astype(np.uint32)
    b = _seeds(2).astype(np.uint32)
    x = (elements >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(x), 1024):
            v = (x[lo : lo + 1024, None] ^ b) * a
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x85EBCA6B)
            np.minimum(best, v.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for i in range(ROWS):
            key = mix(key + samples.reshape(BANDS, ROWS)[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bitmap in which each (sample number, value) toggles one bit."""
    with np.errstate(over="ignore"):
        bit = mix(_seeds(3) + samples) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def most_bits(similarity: float) -> int:
    """Largest XOR population count at which the estimated similarity is still ``similarity``."""
    differing = 2 * SAMPLES * (1 - similarity)  # elements in which the two sets of samples differ
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS)))


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XOR population counts of sketches (rows of 64-bit words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set), bands, sketch of every document row."""

    def run(c):
        out = {"doc_id": c["doc_id"], "n_shingles": [], "set_hash": [], "bands": [], "sketch": []}
        for t in c["text"]:
            s = shingles(t, width)
            samples = min_hashes(s)
            out["n_shingles"].append(len(s))
            with np.errstate(over="ignore"):
                sums = np.array([mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (11, 23)])
            out["set_hash"].append(sums.tobytes())
            out["bands"].append(band_keys(samples).tolist() if len(s) else [])
            out["sketch"].append(odd_sketch(samples) if len(s) else b"")
        made_once("words", word_hashes).trim()
        return out

    return map_batches(texts(docs), run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def _close(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b) whose sketches are close."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for n in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).take(np.flatnonzero(sketch_distance(a, b) <= most))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, bodies: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * |intersection| >= percent * |union|."""
    import zstandard

    side = lambda x: bodies.select(F.col("doc_id").alias(x), F.col("body").alias(f"body_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(c):
        z, seen, keep = zstandard.ZstdDecompressor(), {}, []

        def full(d, body):
            if d not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[d] = shingles(z.decompress(body), width)
            return seen[d]

        for i, (a, b) in enumerate(zip(c["a"], c["b"])):
            x, y = full(a, c["body_a"][i]), full(b, c["body_b"][i])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        return {"a": [c["a"][i] for i in keep], "b": [c["b"][i] for i in keep]}

    return map_batches(joined.select("a", "b", "body_a", "body_b"), run, "a long, b long")


def _bodies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Compressed texts of the documents ``ids`` (doc_id), one per id."""
    import zstandard

    def squeeze(c):
        z = zstandard.ZstdCompressor(level=1)
        return {"doc_id": c["doc_id"], "body": [z.compress(t or b"") for t in c["text"]]}

    packed = map_batches(texts(docs.filter("doc_id IS NOT NULL")), squeeze, "doc_id long, body binary")
    return packed.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


class Block:
    """Members of one task (one or two blocks of a bucket): finds confirmed links between its components."""

    def __init__(self, key, i, j, own, ids, comp, n, sketches, bands, bodies, percent: int, width: int, most: int):
        self.key, self.ids, self.n, self.sketches, self.bands, self.bodies = key, ids, n, sketches, bands, bodies
        self.percent, self.width, self.most = percent, width, most
        self.left = np.flatnonzero(own == i)
        self.right = self.left if i == j else np.flatnonzero(own != i)
        self.label = np.unique(comp, return_inverse=True)[1]
        self.sets: dict[int, np.ndarray] = {}

    def full(self, k: int) -> np.ndarray:
        if k not in self.sets:
            import zstandard

            self.sets[k] = shingles(zstandard.ZstdDecompressor().decompress(self.bodies[k].as_py()), self.width)
        return self.sets[k]

    def links(self):
        """Pairs of members that are linked and were not connected by the task's components and links so far."""
        n, label, percent = self.n, self.label, self.percent
        for k in self.left.tolist():
            near = self.right[self.right > k] if self.right is self.left else self.right
            near = near[label[near] != label[k]]
            near = near[100 * np.minimum(n[near], n[k]) >= percent * np.maximum(n[near], n[k])]
            near = near[sketch_distance(self.sketches[k], self.sketches[near]) <= self.most]
            if not len(near):
                continue
            band = int(np.argmax(self.bands[k] == self.key))
            near = near[np.argmax(self.bands[near] == self.bands[k], axis=1) == band]
            for c in near.tolist():
                if label[c] == label[k]:
                    continue
                both = _same(self.full(k), self.full(c))
                if 100 * both >= percent * (len(self.full(k)) + len(self.full(c)) - both):
                    label[label == label[c]] = label[k]
                    yield int(self.ids[k]), int(self.ids[c])


def _blocked_links(mixed: DataFrame, sketches: DataFrame, bodies: DataFrame, percent: int, width: int, most: int) -> DataFrame:
    """Step 3: links (a, b) across components of the buckets ``mixed`` (key, doc_id, comp)."""
    mixed = mixed.join(sketches.select("doc_id", "n_shingles"), "doc_id")
    by = mixed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    stats = by.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    slots = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    stats = stats.select(
        "key", F.col("top.comp").alias("top"), slots(F.col("top.n"), F.col("top.w")).alias("m_top"),
        slots(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("m_rest"),
    )
    x = mixed.join(stats, "key").withColumn("rest", F.col("comp") != F.col("top"))
    slot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("rest"), F.col("m_rest")).otherwise(F.col("m_top"))).cast("int")
    # blocks are numbered: those of the rest from 0, those of the largest component from m_rest; a task has two of them
    x = x.withColumn("own", slot + F.when(F.col("rest"), 0).otherwise(F.col("m_rest")))
    others = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("m_rest") + F.col("m_top") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("m_rest") - 1)
    )
    x = x.withColumn("other", F.explode(others)).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "comp"
    )
    x = x.join(sketches, "doc_id").join(bodies, "doc_id")

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in itertools.chain(batches, [None]):
            # tasks lie one behind the other; the last of a batch may go on in the next
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = np.concatenate([[0], cuts, [len(key)] if batch is None else []]).astype(np.int64)
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                t = table.slice(a, b - a).combine_chunks()
                own, ids, comp, n = (t.column(c).to_numpy() for c in ("own", "doc_id", "comp", "n_shingles"))
                s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(b - a, -1)
                bands = t.column("bands").chunk(0).flatten().to_numpy().reshape(b - a, -1)
                found += Block(key[a], i[a], j[a], own, ids, comp, n, s, bands, t.column("body"), percent, width, most).links()
            made_once("words", word_hashes).trim()
            held = None if batch is None else table.slice(int(cuts[-1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, rounds: int = 2) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; ``component_id`` is the
    smallest id reachable and ``kept`` marks its own row.  Documents without words (null, empty) have no shingles and
    are linked with nothing.  Rows that share an id are one document in the graph; each keeps its own ``n_shingles``.
    Rows with a null id are linked with nothing, have a null component and are kept.
    """
    most = most_bits(percent / 100 - MARGIN)
    sig = write_table(signatures(docs, width), "signatures")
    known = sig.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = write_table(
        known.groupBy("n_shingles", "set_hash").agg(
            F.min(F.struct("doc_id", "bands", "sketch")).alias("r"), F.count("*").alias("n")
        ).select("n_shingles", "set_hash", F.col("r.doc_id").alias("doc_id"), F.col("r.bands").alias("bands"), F.col("r.sketch").alias("sketch"), "n"),
        "classes",
    )
    copies = known.join(classes.filter("n > 1").select("n_shingles", "set_hash", F.col("doc_id").alias("first")), ["n_shingles", "set_hash"])
    links = write_table(copies.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).filter("n > 1")
    members = write_table(banded.join(shared.select("key", "centre"), "key"), "buckets")
    ids = members.select("doc_id").distinct()
    sketches = write_table(classes.select("doc_id", "n_shingles", "sketch", "bands").join(ids, "doc_id", "left_semi"), "sketches")
    bodies = write_table(_bodies(docs, ids), "bodies")
    members = members.withColumns({"comp": F.col("doc_id"), "centre_comp": F.col("centre")})
    for step in range(rounds):
        star = members.filter("comp <> centre_comp").select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b"))
        pairs = write_table(_close(_with_sketches(star.distinct(), sketches), most), "close")
        links = links.unionByName(write_table(_confirmed(pairs, bodies, percent, width), "links"))
        comps = write_table(components(links), "components")
        # from now on the components stand for all links found so far
        links = comps.filter("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
        # a centre has met its whole bucket
        rest = members.filter("doc_id <> centre").select("key", "doc_id").join(
            comps.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left"
        ).withColumn("comp", F.coalesce("comp", "doc_id"))
        open_keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        members = write_table(rest.join(open_keys.select("key"), "key", "left_semi"), "open")
        if members.isEmpty():
            break
        if step + 1 < rounds:
            members = members.join(_centres(members, step), "key")
    else:
        found = write_table(_blocked_links(members.select("key", "doc_id", "comp"), sketches, bodies, percent, width, most), "links")
        comps = write_table(components(links.unionByName(found)), "components")
    nodes = comps.select(F.col("node").alias("doc_id"), "comp")
    return sig.join(nodes, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("comp", "doc_id"), F.lit(True)).alias("kept"),
    )


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _centres(members: DataFrame, step: int) -> DataFrame:
    """The next centre of each bucket: a member of the largest component but one."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "key", F.lit(step))).alias("pick"))
    top = by.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"))
    second = by.join(top, "key").filter("comp <> top.comp").groupBy("key").agg(F.max(F.struct("n", "comp", "pick")).alias("s"))
    return second.select("key", F.col("s.pick").alias("centre"), F.col("s.comp").alias("centre_comp"))


def keep_one_of_each(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the row(s) with its smallest id; see ``near_duplicates``."""
    gone = near_duplicates(docs, percent, width).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
