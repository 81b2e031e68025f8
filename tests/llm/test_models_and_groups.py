"""Near-dedup against brute force; the trained operators by held-out accuracy and by their defined edge results."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthlens.llm import language_crf, near_dedup, perplexity, toxicity
from depthlens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, comp long, key long, sketch string"


def shingle_set(text, width=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(rows, percent=85):
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for i, a in sets:
        for j, b in sets:
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two"), (8, "long " + "very long text " * 9000)]
    for g in range(6):
        base = [word() for _ in range(120)]
        for k in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(120)] = word()
            rows.append((100 * (g + 1) + k, " ".join(copy)))
            if g % 2:
                base = copy  # a chain that drifts away
    return rows


@pytest.mark.parametrize("rounds", [1, 2])
def test_near_duplicates_equal_brute_force(spark, rounds):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, None, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    want, text = groups(rows), dict(rows)
    for r in near_dedup.near_duplicates(df, rounds=rounds).collect():
        assert r.n_shingles == len(shingle_set(text[r.doc_id]))
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    if rounds == 2:
        kept = near_dedup.keep_one_of_each(df)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
        assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_template_texts_give_fewer_links_than_members(spark, monkeypatch):
    """A bucket of texts of similarity 0.7 to 0.9 from one template: result as by brute force, and blocks emit confirmed links only."""
    rng = random.Random(9)
    core = [f"c{i}" for i in range(400)]
    rows = []
    for d in range(260):
        text = list(core)
        for at in rng.sample(range(400), rng.choice([4, 14, 16, 18, 20])):
            text[at] = f"x{d}_{at}"
        rows.append((d, " ".join(text)))
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame([(i, t, None, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    emitted = []

    def counted(mixed, *args, made=near_dedup._blocked_links):
        out = made(mixed, *args)
        emitted.append((out.count(), mixed.select("doc_id").distinct().count(), out.distinct().count()))
        return out

    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    monkeypatch.setattr(near_dedup, "_blocked_links", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, rounds=1).collect()}
    assert got == groups(rows)
    links, members, different = emitted[0]
    assert links == different and links < 3 * members


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (3, 4), (4, 3), (200, 199)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.95, 0.85, 0.7):
        n = 1000
        shared = int(2 * n * similarity / (1 + similarity))
        x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = near_dedup.min_hashes(x[:n]), near_dedup.min_hashes(x[n - shared :])
        z = near_dedup.sketch_distance(*(np.frombuffer(near_dedup.odd_sketch(s), np.uint64) for s in (a, b)))
        bits = near_dedup.SKETCH_BITS
        estimate = 1 + bits / 4 * math.log(1 - 2 * z / bits) / near_dedup.SAMPLES
        assert abs(estimate - similarity) < 0.15
        assert abs((a == b).mean() - similarity) < 0.15


def toxic_rows(n=400):
    rng = random.Random(1)
    for i in range(n):
        words = [f"plain{rng.randrange(60)}" for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["vile", "nasty", "vileness"])
        yield i, " ".join(words), int(i % 4 == 0)


def test_chain_learns_and_defines_edges(spark):
    rows = list(toxic_rows())
    docs = spark.createDataFrame([(i, t, "x", 1, 2, "s") for i, t, _ in rows] + [(1000, None, "x", 1, 2, "s"), (1001, "", "x", 1, 2, "s")], SCHEMA)
    labels = spark.createDataFrame([(i, (i % 3) % 2, t) for i, _, t in rows if i % 2 == 0 or i % 8 == 5] + [(0, None, None)], "doc_id long, quality int, toxic int")
    categories = {"low_quality": "1 - quality", "toxic": "toxic"}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, categories).collect()}
    truth = {i: bool(t) for i, _, t in rows}
    unseen = [i for i in truth if i % 2 and i % 8 != 5] + [i for i in truth if i % 2 == 0]
    assert np.mean([got[i].rejected == truth[i] for i in unseen]) > 0.98
    assert len(got) == 402 and not got[1000].rejected and not got[1001].rejected and 0 <= got[5].p_low_quality <= 1
    nothing = toxicity.toxicity(docs, labels.limit(0), categories)
    assert nothing.filter("rejected").count() == 0 and nothing.count() == 402


def test_chain_uses_out_of_fold_logits():
    texts = [("good " if i % 2 else "bad ").encode() + b"cdefg"[i % 5 : i % 5 + 1] for i in range(200)]
    y = np.array([[i % 2, i % 2] for i in range(200)], float)
    links = toxicity.fit_chain(texts, y, np.ones(200), np.arange(200) % 5)
    assert len(links) == 2 and links[0].before.shape == (0,) and links[1].before.shape == (1,) and links[1].before[0] > 0


def brute_forward_backward(emission, start, transition):
    from itertools import product

    n, k = emission.shape
    p = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        s = start[path[0]] + sum(emission[t, path[t]] for t in range(n)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
        for t in range(n):
            p[t, path[t]] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    grid, lengths = rng.normal(size=(3, 5, 3)), np.array([5, 3, 1])
    start, transition = rng.normal(size=3), rng.normal(size=(3, 3))
    p, _ = language_crf.forward_backward(grid, lengths, start, transition)
    for lane, n in enumerate(lengths):
        np.testing.assert_allclose(p[lane, :n], brute_forward_backward(grid[lane, :n], start, transition), atol=1e-9)
        assert (p[lane, n:] == 0).all()


def test_languages_on_held_out_and_switched_texts(spark):
    rng = random.Random(2)
    parts = {"aa": ["tor", "bel", "kan"], "bb": ["éu", "ouf", "ré"]}
    make = lambda g, n: " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(g, 30), g) for i in range(300) for g in [("aa", "bb")[i % 2]]]
    rows += [(400, None, "aa"), (401, "", None), (402, "12 -- ¿?", "bb"), (None, make("bb", 9), "bb"), (403, make("aa", 30) + " " + make("bb", 30), None)]
    docs = spark.createDataFrame([(i, t, g, 1, 2, "s") for i, t, g in rows], SCHEMA)
    got = {r.doc_id: r for r in language_crf.languages(docs).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g in rows[:300]]) > 0.98
    assert [got[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and got[400].score == 0
    assert got[None].lang_pred == "bb" and not got[None].held_out and got[403].switched > 0.3
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert {r.lang_pred for r in language_crf.languages(docs.limit(0)).collect()} == set()
    assert language_crf.languages(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def kneser_ney_by_loops(texts, order):
    """Modified Kneser-Ney of all n-grams of ``texts``: {gram: (p, q)}; q from counts in which the gram has been seen once less."""
    top = {}
    for t in texts:
        s = b"\n" * (order - 1) + t
        for i in range(len(t)):
            top[s[i : i + order]] = top.get(s[i : i + order], 0) + 1
    levels = [top]
    for _ in range(order - 1):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)
    levels.reverse()

    def cut_of(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))]

    cuts = [cut_of(c) for c in levels]
    followers = [{} for _ in levels]
    for k, counts in enumerate(levels):
        for g, c in counts.items():
            followers[k].setdefault(g[:-1], []).append(c)

    def p(k, g, without):
        """``without``: one occurrence of the gram less."""
        if k < 0:
            return 1 / 256
        c, d = levels[k][g], cuts[k]
        cs = list(followers[k][g[:-1]])
        if without:
            cs.remove(c)
            cs.append(c - 1)
        if sum(cs) == 0:
            return p(k - 1, g[1:], True)
        own = c - 1 if without else c
        freed = sum(d[min(x, 3)] for x in cs)
        return (own - d[min(own, 3)] + freed * p(k - 1, g[1:], without and c == 1)) / sum(cs)

    return {g: (p(order - 1, g, False), p(order - 1, g, True)) for g in top}


def test_model_equals_loops_and_sums_to_one(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé \n") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["aaaa aaaa", "", None]
    docs = spark.createDataFrame([(i, t, "xx" if i % 3 else None, 1, 2, "s") for i, t in enumerate(texts)], SCHEMA)
    got = {(r.lang, r.gram.to_bytes(perplexity.ORDER)): (r.p, r.q) for r in perplexity.language_model(docs).collect()}
    want = {}
    for lang in ("xx", "und"):
        mine = [t.encode() for i, t in enumerate(texts) if t and (i % 3 > 0) == (lang == "xx")]
        want |= {(lang, g): pq for g, pq in kneser_ney_by_loops(mine, perplexity.ORDER).items()}
    assert got.keys() == want.keys()
    for k, pq in want.items():
        np.testing.assert_allclose(got[k], pq, rtol=1e-9)
    # of a context of which every follower is known the probabilities and what is left for others make one
    for lang in ("xx", "und"):
        sums = {}
        for (at, g), (p, _) in got.items():
            if at == lang:
                sums[g[:-1]] = sums.get(g[:-1], 0) + p
        assert all(0 < s <= 1 + 1e-9 for s in sums.values())


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_log_perplexity_equals_loops(spark, block, monkeypatch):
    """The whole path of counts, model, blocks and sums, also with repeated rows and null ids, in one block and in many."""
    monkeypatch.setattr(perplexity, "BLOCK_GRAMS", block)
    monkeypatch.setattr(perplexity, "GATHER", 500)
    monkeypatch.setattr(perplexity, "KEEP", 400)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "and", "tión"]) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (3, "other text"), (60, None), (61, "")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "s") for i, t in rows], SCHEMA).repartition(3)
    model = kneser_ney_by_loops([t.encode() for _, t in rows if t], perplexity.ORDER)

    def log_perplexity(t):
        s = b"\n" * (perplexity.ORDER - 1) + t.encode()
        return round(-sum(math.log(max(model[s[i : i + perplexity.ORDER]][1], perplexity.LEAST_P)) for i in range(len(t.encode()))) / len(t.encode()), 4)

    got = sorted((str(r.doc_id), None if r.log_perplexity is None else round(r.log_perplexity, 4)) for r in perplexity.scores(docs).collect() if r.n_bytes)
    assert got == sorted((str(i), log_perplexity(t)) for i, t in rows if t)
    assert perplexity.scores(docs).filter("n_bytes = 0 AND log_perplexity IS NULL").count() == 2


def base_by_loops(text):
    words, lines, seen, dup = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()), (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_measures_equal_loops():
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c a b c", "é😀\x85x\u2003y #<>|", "x\n x\nx\n\n \nx"]
    texts += ["".join(rng.choice(["a", "b", "é ", " ", "\n", "#", "cd "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = perplexity.base_measures([t.encode() if t else t for t in texts])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [base_by_loops(t) for t in texts]


def test_quality_rules(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "in"]) + rng.choice(["re", "tion", "er", "st", "ing"]) for _ in range(n)) + ".\n"
    rows = [(i, prose(80), "en") for i in range(120)] + [
        (200, None, "en"), (201, "", None), (202, "same same same " * 40, "en"), (203, "".join(rng.choice("qxzjv kwpyg") for _ in range(900)), "en"),
        (204, prose(60), None), (None, prose(70), "en"), (205, "a #b\na #b\n \n \n", "en"),
    ]
    docs = spark.createDataFrame([(i, t, g, 1, 2, "s") for i, t, g in rows], SCHEMA)
    got = {r.doc_id: r for r in perplexity.quality_verdicts(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == (not got[i].base_failed) for i in range(120))
    assert not got[203].base_failed and not got[203].kept and got[202].base_failed and got[202].n_repeat_words == 120
    assert got[200].base_failed and got[200].log_perplexity is None and got[204].lang == "und"
    r = got[205]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (4, 6, 2, 1, 0)
    assert perplexity.quality_verdicts(docs.limit(0)).count() == 0
