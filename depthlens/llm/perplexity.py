"""Quality rules with an n-gram language model per language.

Texts are read as UTF-8 bytes, so case, marks, line ends and every script count.  Spark counts the n-grams of six bytes of all
documents per language; what it gathers grows with the corpus.  The model is modified Kneser-Ney (three discounts per
language and order from counts of counts, continuation counts below the highest order), built order by order with grouped counts and
joins on (language, context) and (language, shorter n-gram): at most 256 rows share a context, so no key is hot.

A document must not vouch for itself: every n-gram has the probability it would have if it had been seen once less.  An
n-gram that only one place of the corpus holds falls back to its shorter ones, again without that place.

The probabilities of all n-grams are one table, sorted by n-gram.  It is read in blocks of bounded size; a block is broadcast as
sorted arrays, one pass over the documents looks their n-grams up, and what the blocks find adds up.  Documents
outside their language's band of log perplexity are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from depthlens.llm.text import map_batches, mix, texts
from depthlens.session import write_table

ORDER = 6
#: n-grams gathered in a task before they are counted, distinct ones kept there, and n-grams of one broadcast block.
GATHER, KEEP, BLOCK_GRAMS = 2 << 20, 3 << 19, 6 << 20
#: n-grams looked up together.
LOOK_UP = 1 << 20
#: Languages whose bands are broadcast; beyond it the planner joins them.
MOST_BANDS = 100_000
#: Probabilities count as this at least.
LEAST_P = 1e-12
_PAD = b"\n" * (ORDER - 1)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Fixed value: characters that count as symbols.
_MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def gram_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram (bytes as one number) that ends at every byte of every text, line ends standing before it; the bytes of each text."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    s = np.frombuffer(b"".join(_PAD + (t or b"") for t in texts), np.uint8)
    codes = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for i in range(ORDER):
        codes <<= 8
        codes |= s[i : i + len(codes)]
    begins = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)  # places of codes where a text begins
    keep = np.ones(len(codes), bool)
    gaps = begins[1:, None] - np.arange(1, ORDER)
    keep[gaps[gaps >= 0]] = False
    return codes[keep], sizes


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; a null language is ``und``.  Tasks sum up before anything is shuffled."""

    def merged(parts):
        """Sorted distinct n-grams of (n-grams, counts) and their sums."""
        grams, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(grams, kind="stable")
        grams, at = grams[order], np.flatnonzero(np.diff(grams[order], prepend=-1))
        return grams[at], np.add.reduceat(counts[order], at)

    def run(batches):
        raw, size, held = {}, 0, {}  # by language: n-grams not counted yet; counted ones

        def count():
            for lang, parts in raw.items():
                new = np.unique(np.concatenate(parts), return_counts=True)
                if len(new[0]):
                    held[lang] = merged([held[lang], new]) if lang in held else new
            raw.clear()

        def emitted():
            for lang, (grams, counts) in held.items():
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(grams), np.int32)), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            langs, column = batch.column("lang").to_pylist(), batch.column("text")
            for lo in range(0, len(langs), 256):
                some, near = column.slice(lo, 256).to_pylist(), langs[lo : lo + 256]
                for lang in set(near):
                    codes, _ = gram_codes([t for t, g in zip(some, near) if g == lang])
                    raw.setdefault(lang, []).append(codes)
                    size += len(codes)
                if size >= GATHER:
                    count()
                    size = 0
                    if sum(len(g) for g, _ in held.values()) >= KEEP:
                        yield from emitted()
                        held.clear()
        count()
        yield from emitted()

    with_lang = texts(docs.filter("text IS NOT NULL"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return with_lang.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(levels: list[DataFrame]) -> DataFrame:
    """lang, order, d1, d2, d3 from counts of counts; 0.5, 1, 1.5 where those are degenerate."""
    parts = [
        t.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]).withColumn("order", F.lit(order))
        for order, t in enumerate(levels, 1)
    ]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y, usable = n1 / (n1 + 2 * n2), F.least(n1, n2, n3, n4) > 0
    clip = lambda x, top, other: F.when(usable, F.least(F.greatest(x, F.lit(0.0)), F.lit(top))).otherwise(F.lit(other))
    return all_parts.select(
        "lang", "order", clip(1 - 2 * y * F.try_divide(n2, n1), 1.0, 0.5).alias("d1"), clip(2 - 3 * y * F.try_divide(n3, n2), 2.0, 1.0).alias("d2"),
        clip(3 - 4 * y * F.try_divide(n4, n3), 3.0, 1.5).alias("d3"),
    )


def language_model(docs: DataFrame) -> DataFrame:
    """(lang, gram, p, q): probability of each n-gram's last byte after the others; q as if it had been seen once less."""
    levels = [write_table(count_grams(docs), "grams")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct bytes before the shorter n-gram
        levels.append(write_table(levels[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(F.count("*").alias("n")), "grams"))
    levels.reverse()
    steps = write_table(discounts(levels), "discounts")
    below = None
    for order, t in enumerate(levels, 1):
        d = steps.filter(F.col("order") == order).drop("order")
        # a row per language: the planner broadcasts it, or splits a hot language where there are very many
        t = t.join(d, "lang").withColumns({
            "context": F.shiftright("gram", 8), "shorter": F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1),
            "cut": _cut(F.col("n")), "cut_less": _cut(F.col("n") - 1),
        })
        contexts = t.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        t = t.join(contexts, ["lang", "context"])
        if below is None:
            t = t.withColumns({"p_below": F.lit(1 / 256), "q_below": F.lit(1 / 256)})
        else:
            t = t.join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("p_below"), F.col("q").alias("q_below")), ["lang", "shorter"])
        n, total, freed = F.col("n"), F.col("total"), F.col("freed")
        under = F.when(n == 1, F.col("q_below")).otherwise(F.col("p_below"))
        less = (n - 1 - F.col("cut_less") + (freed - F.col("cut") + F.col("cut_less")) * under) / (total - 1)
        below = write_table(t.select(
            "lang", "gram", ((n - F.col("cut") + freed * F.col("p_below")) / total).alias("p"),
            F.when(total == 1, under).otherwise(F.try_divide(less * (total - 1), total - 1)).alias("q"),
        ), "probabilities")
    return below


def _cut(n):
    return F.when(n <= 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def gram_blocks(model: DataFrame):
    """The log probabilities q in blocks: language -> (sorted n-grams, values), at most about ``BLOCK_GRAMS`` n-grams each."""
    count = -(-model.count() // BLOCK_GRAMS)
    block = F.pmod(F.xxhash64("gram"), F.lit(max(1, count)))
    for i in range(count):
        t = model.filter(block == i).select("lang", "gram", F.log(F.greatest("q", F.lit(LEAST_P))).cast("float").alias("v")).toArrow()
        lang, grams, v = t.column("lang").combine_chunks().dictionary_encode(), t.column("gram").to_numpy(), t.column("v").to_numpy()
        codes = lang.indices.to_numpy()
        order = np.lexsort((grams, codes))
        cuts = np.searchsorted(codes[order], np.arange(len(lang.dictionary) + 1))
        yield {name: (grams[order[a:b]], v[order[a:b]]) for name, a, b in zip(lang.dictionary.to_pylist(), cuts[:-1], cuts[1:])}


def base_measures(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)

    def per_text(marked):
        total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return total[ends] - total[ends - sizes]

    split = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    h = np.fromiter((x for w in split for x in map(hash, w)), np.int64, int(n.sum())).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        a, c, e = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        with np.errstate(over="ignore"):
            key = mix(mix(mix(h[:-2] + a) * c + h[1:-1]) * e + h[2:] + row[2:].astype(np.uint64))
        at = np.flatnonzero(row[2:] == row[:-2])
        order = at[np.argsort(key[at], kind="stable")]
        twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        for p in (order[twin], order[twin + 1]):
            for i in range(3):
                repeated[p + i] = True
    words_before = np.concatenate([[0], np.cumsum(repeated)])
    last = np.cumsum(n)
    duplicates = []
    for t in texts:
        seen, d = set(), 0
        for line in t.split(b"\n") if t else ():
            if line and not line.isspace():
                if line in seen:
                    d += 1
                seen.add(line)
        duplicates.append(d)
    return {
        "n_words": n, "word_chars": per_text(~_BLANK[b] & ((b & 0xC0) != 0x80)), "n_symbols": per_text(_MARKS[b]),
        "n_dup_lines": np.array(duplicates, np.int64), "n_repeat_words": words_before[last] - words_before[last - n],
    }


def _log_sums(c: dict, block: dict) -> list[float]:
    """Sum of the block's log probabilities over the n-grams of each text, ``LOOK_UP`` n-grams at a time."""
    out = [0.0] * len(c["text"])
    for lang in set(c["lang"]).intersection(block):
        grams, values = block[lang]
        rows, size = [], 0
        for i, g in enumerate([*c["lang"], lang]):
            end = i == len(out)
            if not end and g == lang and c["text"][i]:
                rows.append(i)
                size += len(c["text"][i])
            if rows and (end or size >= LOOK_UP):
                codes, sizes = gram_codes([c["text"][r] for r in rows])
                total = np.zeros(len(codes) + 1)
                for lo in range(0, len(codes), LOOK_UP):
                    distinct, back = np.unique(codes[lo : lo + LOOK_UP], return_inverse=True)
                    place = np.minimum(np.searchsorted(grams, distinct), len(grams) - 1)
                    total[lo + 1 : lo + 1 + len(back)] = np.where(grams[place] == distinct, values[place], 0.0)[back]
                np.cumsum(total, out=total)
                ends = np.cumsum(sizes)
                for r, x in zip(rows, (total[ends] - total[ends - sizes]).tolist()):
                    out[r] = x
                rows, size = [], 0
    return out


def scores(docs: DataFrame) -> DataFrame:
    """Base measures and ``log_perplexity`` (natural log, per byte; null without text) of every document row."""
    base = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_sum double"
    columns = texts(docs, F.coalesce("lang", F.lit("und")).alias("lang"))
    key = [F.xxhash64("doc_id", "lang", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id", "lang").alias("k2")]
    sc, found, rest = docs.sparkSession.sparkContext, None, []
    for i, block in enumerate(gram_blocks(language_model(docs))):
        shared = sc.broadcast(block)
        if i:

            def more(c, shared=shared):
                return {"k1": c["k1"], "k2": c["k2"], "more": _log_sums(c, shared.value)}

            # equal rows have equal sums
            rest.append(write_table(map_batches(columns.select("*", *key), more, "k1 long, k2 long, more double").dropDuplicates(["k1", "k2"]), "sums"))
            continue

        def first(c, shared=shared):
            out = {k: v.tolist() for k, v in base_measures(c["text"]).items()}
            return out | {
                "doc_id": c["doc_id"], "lang": c["lang"], "n_bytes": [len(t or b"") for t in c["text"]], "log_sum": _log_sums(c, shared.value),
                "k1": c["k1"], "k2": c["k2"],
            }

        found = map_batches(columns.select("*", *key), first, base + ", k1 long, k2 long")
    if found is None:  # no text at all
        def bare(c):
            out = {k: v.tolist() for k, v in base_measures(c["text"]).items()}
            return out | {"doc_id": c["doc_id"], "lang": c["lang"], "n_bytes": [0] * len(c["text"]), "log_sum": [0.0] * len(c["text"])}

        found = map_batches(columns, bare, base)
    if rest:
        more = rest[0]
        for r in rest[1:]:
            more = more.unionByName(r)
        found = found.join(more.groupBy("k1", "k2").agg(F.sum("more").alias("more")), ["k1", "k2"], "left")
        found = found.withColumn("log_sum", F.col("log_sum") + F.coalesce("more", F.lit(0.0))).drop("more")
    return found.drop("k1", "k2").withColumn("log_perplexity", F.when(F.col("n_bytes") > 0, -F.col("log_sum") / F.col("n_bytes"))).drop("log_sum")


def language_bands(s: DataFrame, above: float, sampling: float) -> DataFrame:
    """lang, q1, q2, q3 of the log perplexity, and ``high``: the upper bound of its deviation from q2 times the root of the bytes."""
    quartiles = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
    good = s.filter("NOT base_failed AND log_perplexity IS NOT NULL")
    middle = _few(good.groupBy("lang").agg(quartiles("log_perplexity").alias("q")).select("lang", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]))
    z = (F.col("log_perplexity") - F.col("q2")) * F.sqrt("n_bytes")
    far = good.join(middle, "lang").groupBy("lang").agg(quartiles(z).alias("z"))
    width = F.greatest(F.col("z")[2] - F.col("z")[0], F.lit(sampling))
    return _few(middle.join(far.select("lang", (F.col("z")[2] + above * width).alias("high")), "lang"))


def _few(rows: DataFrame) -> DataFrame:
    """A row per language: broadcast only while they are few."""
    rows = write_table(rows, "bands")
    return F.broadcast(rows) if rows.count() <= MOST_BANDS else rows


def quality_verdicts(docs: DataFrame, spread: float = 4.0, above: float = 2.0, least: float = 0.06, sampling: float = 1.5) -> DataFrame:
    """Base measures and verdict of every document row.

    ``base_failed``: n_words < 50 or more than half of the words in repeated 3-word windows.  ``kept``: not failed, and
    the log perplexity lies in the language's band, which comes from the quartiles over all documents that did not fail.  Lower bound:
    the first quartile less ``spread`` times their distance (``least`` at least, so that a third of equal documents does not narrow
    it) and 4 over the root of the text's bytes.  Upper bound: short texts scatter more, so deviations from the median are
    compared times the root of the bytes; beyond their third quartile plus ``above`` times their distance
    (``sampling`` at least) a text is too surprising, if it lies ``least`` above the third quartile as well.
    Null and empty texts fail; repeated rows count as often as they come; a null language is ``und``.
    """
    s = scores(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    s = write_table(s, "scores")
    root = F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    banded = s.join(language_bands(s, above, sampling), "lang", "left").withColumns({
        "lower": F.col("q1") - F.greatest(spread * (F.col("q3") - F.col("q1")), F.lit(least)) - 4.0 / root,
        "upper": F.greatest(F.col("q2") + F.col("high") / root, F.col("q3") + least),
    })
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return banded.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "lang", "log_perplexity", "lower", "upper",
    )
