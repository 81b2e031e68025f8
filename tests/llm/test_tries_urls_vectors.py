"""Conversation trie, url filter and hard negatives against brute force and SQL; every table holds the awkward rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from depthlens.llm import hard_negatives as hn
from depthlens.llm import prefix_trie as pt
from depthlens.llm import url_filter as uf
from depthlens.llm.queries import URL_RULES
from depthlens.llm.secret_scan import ADDED, BASE, Scanner

TURNS = "conv_id long, turn long, role string, text string, depth int, id1 string, size string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return con.sql(sql)


# ---- conversation trie -------------------------------------------------------------------------------------------


def trie_by_loops(rows):
    own = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:2])] for c, vs in own.items()}
    nodes, whole = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    children = dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda m, d: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == d).encode()).hexdigest()
    return [(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(m, len(k))) for k, m in nodes.items()]


def conversation_rows():
    rng = random.Random(1)
    rows = []
    for c in range(-7, 90):
        if c % 11 != 3:
            for t in range(rng.choice([1, 2, 3, 8, 12, 25])):
                rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "b", "é", None, ""]) if t < 4 else rng.choice(["x", "y"]), 1, "n", "s"))
    for c in range(1000, 1300, 5):  # one conversation that many repeat
        rows += [(c, 0, "u", "hot", 1, None, None), (c, 1, "a", "same " * 400, 1, None, None)]
    rows += [(None, 1, "u", "z", 1, "", ""), (5000, None, "u", "null turn", 2, "", ""), (5000, 3, "u", "m", 2, "", ""), (5001, 1, "u", "twice", 1, "", ""), (5001, 1, "u", "twice", 1, "", "")]
    return rows


@pytest.mark.parametrize(("width", "cells"), [(64, 1 << 19), (64, 50), (4, 70), (1, 10**6)])
def test_trie_equals_loops(spark, width, cells):
    """Blocks and segments of any size give the same nodes: null ids, turns, roles and texts, empty texts, ties, repeated rows, clashing columns."""
    rows = conversation_rows()
    docs = spark.createDataFrame(rows, TURNS).repartition(5)
    assert ordered(pt.prefix_trie(pt.rebuilt_turns(docs), width, cells).collect()) == ordered(trie_by_loops(rows))


def test_trie_of_hot_conversation_in_blocks(spark):
    """One conversation id that holds most rows is numbered in blocks, with the same result."""
    rows = [(c, t, "u", f"t{t % 7}", 0, "", "") for c in (10, 11, 20) for t in range(400 if c == 10 else 5)]
    spark.conf.set("spark.depthlens.blockRows", "40")
    try:
        got = pt.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    finally:
        spark.conf.unset("spark.depthlens.blockRows")
    assert ordered(got) == ordered(trie_by_loops(rows))


def test_trie_of_nothing_and_of_turnless(spark):
    assert pt.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    only_null = spark.createDataFrame([(None, 1, "u", "x", 0, "", "")], TURNS)
    assert pt.conversation_trie(only_null).collect() == []
    # 3 takes more turns of its absent first member than it has itself: it has none and is a member of the root alone
    assert zlib.crc32(b"3") % 9 >= 1
    got = pt.conversation_trie(spark.createDataFrame([(3, 0, "u", "x", 0, "", "")], TURNS)).collect()
    assert ordered(got) == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


# ---- url filter ------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/x?y#z", "http://anet/", "https://example.net/en/1", "https://www.EXAMPLE.net/EN/1",
    "https://www.example.net/en/1/login", "https://example.com/de/", "https://example.com/de", "https://x.example.org/fr/9#t", "https://org/fr/", "https://example.org/es/login?x=1",
    "https://example.org/help/login", "https://example.org/es/loginpage", "https://example.org/es/1?page=2&ref=x", "https://example.org/a.EXE", "https://example.org/a.exe?x",
    "://net/", "x://y://net/", "http://net:80/", "http://u@net/", "http://é.net/é", "http://example.org/docs/cart/", "http://" + "a." * 20_000 + "net/" + "p/" * 20_000, "http://net\n/", "http://a.net?x", "http://a.net/\n?",
]


def url_by_loops(url, rules, default="allow"):
    host, path, rest = uf.split_url(url)
    if url is None:
        return host, path, None, default, None
    fits = [r for r in rules if (re.match(r.expression, rest, 0 if r.host else re.I | re.A) if rest is not None else None) if r.pattern.startswith("||")]
    fits += [r for r in rules if not r.pattern.startswith("||") and re.search(r.expression, url, re.I | re.A)]
    hosts = sorted((-len(r.name), r.verdict, r.name) for r in fits if r.host)
    if hosts:
        return host, path, hosts[0][2], hosts[0][1], None
    block = sorted(r.name for r in fits if r.verdict == "block")
    blocked = bool(block) and not any(r.verdict == "allow" for r in fits)
    return host, path, None, "block" if blocked else default, block[0] if blocked else None


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_urls_equal_every_rule_on_every_url(spark, most):
    """Null and long urls, repeated rows, null ids, clashing columns; rules in one block and in many."""
    rows = [(i, u, "html", "v", "p") for i, u in enumerate(URLS)] + [(1, URLS[8], None, None, None), (None, URLS[6], None, None, None), (1, URLS[8], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string, host string").repartition(3)
    want = ordered((i, *url_by_loops(u, URL_RULES)) for i, u, *_ in rows)
    assert ordered(uf.url_verdicts(pages, URL_RULES, most=most).collect()) == want
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows])})
    assert ordered(by_sql(uf.verdict_sql(URL_RULES), pages=table).fetchall()) == want


def test_rules_are_filed_under_their_rarest_whole_token(spark):
    rules = uf.pattern_rules(["||shop.example.com/basket", "/ads/banner*top", "advert", "! comment", "", "@@|https://good.org^"])
    assert [r.tokens() for r in rules] == [["shop", "example", "com"], ["ads"], [], ["https", "good", "org"]]
    index = uf.Index(rules, {"shop": 9, "example": 2, "com": 30, "ads": 1, "https": 99, "good": 3, "org": 50})
    assert index.by_token == {"example": [0], "ads": [1], "good": [3]} and index.always == [2]
    urls = spark.createDataFrame([("http://shop.example.com/SHOP",), ("http://org/",), (None,)], "url string")
    assert uf.token_counts(urls, {"shop", "org", "no"}) == {"shop": 1, "org": 1}


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.url_verdicts(empty, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://net/x")], "page_id long, url string")
    assert [tuple(r) for r in uf.url_verdicts(one, []).collect()] == [(1, "net", "/x", None, "allow", None)]


# ---- hard negatives --------------------------------------------------------------------------------------------------


def negatives_by_loops(rows, every=10, scale=256):
    used = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x * scale) for x in v):
            used.append((i, label, tuple(math.floor(x * scale) for x in v)))
    dot = lambda a, b: max(-hn.MOST_SCORE, min(hn.MOST_SCORE, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, label, v in sorted(set(u for u in used if u[0] % every == 0)):
        scored = sorted((-dot(v, w), j, other) for j, other, w in used if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            hits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(hits)]
    return out


@pytest.mark.parametrize("kind", ["plain", "ties", "ragged", "huge"])
def test_negatives_equal_loops(spark, kind, monkeypatch):
    rng = random.Random(7)
    def value():
        x = rng.gauss(0.05, 0.2)
        return round(x, 1) if kind == "ties" else x * 10 ** rng.choice([0, 6, 18]) if kind == "huge" else x
    width = lambda: rng.choice([0, 3, 8]) if kind == "ragged" else 2 if kind == "ties" else 8
    rows = [(i, rng.randrange(3), [value() for _ in range(width())]) for i in range(240)]
    rows += [(None, 1, [0.1] * 8), (300, None, [0.1] * 8), (310, 1, None), (320, 1, [None] + [0.1] * 7), (330, 1, [math.nan] * 8), (331, 2, [math.inf] + [0.1] * 7)]
    rows += [rows[20], rows[20], (501, 1, [0.3] * 8), (-10, 2, [0.3] * 8)]
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 11)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, label int, embedding array<double>, score int, anchor string").repartition(4)
    got = hn.hard_negatives(df, df["vec_id"] % 10 == 0).collect()
    assert ordered(got) == ordered(negatives_by_loops(rows))


def test_negatives_of_nothing(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hn.hard_negatives(spark.createDataFrame([], schema), pt.F.lit(True)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(1, 1, [0.5]), (2, 2, [0.5])], schema), pt.F.lit(False)).collect() == []


def test_packed_scores_are_exact():
    rng = np.random.default_rng(3)
    for size in (3, 200, 10**5, 10**12):
        a, c = (np.floor(rng.uniform(-size, size, (n, 17))) for n in (5, 23))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a]
        want = np.clip(np.array(want, object), -hn.MOST_SCORE, hn.MOST_SCORE).astype(np.int64)
        assert (hn.packed_scores(a, c) == want).all()
    assert (hn.packed_scores(np.zeros((2, 3)), np.zeros((4, 3))) == 0).all()


# ---- very long lines in the secret scan --------------------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["0123456789abcdef", "eyJ", "eyJa.", "token=", "token ", "-----BEGIN ", "ghp_a"])
def test_secret_scan_reads_a_line_in_linear_time(unit):
    import time

    scanner, line = Scanner(BASE + ADDED), (unit * (1_000_000 // len(unit))).encode()
    began = time.process_time()
    got = scanner.scan([line])[0]
    assert time.process_time() - began < 5
    want = [m.span() for r in BASE[2:] for m in re.finditer(r.pattern.encode(), line) if m.end() - m.start() >= r.least]
    assert [(s, e) for s, e, k in got if k == 2] == want


def test_secret_spans_equal_the_expressions_on_mixed_lines():
    scanner, rng = Scanner(BASE + ADDED), random.Random(3)
    parts = ["token", "=", "password", " ", "'", '"', ":", "eyJ", ".", "abc123XYZ", "0123456789abcdef" * 2, "ghp_", "AKIA", "ABCD1234EFGH5678", "xoxb-", "api_key", "key", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "_", "-", "Z9" * 20, "é", "f"]
    for _ in range(3000):
        line = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))).encode()
        want = []
        for k, r in enumerate(scanner.rules):
            p = r.pattern.encode()
            for m in re.finditer(p[: p.rindex(b"[")] + b"(?P<tail>" + p[p.rindex(b"[") :] + b")", line):
                if len(m["tail"]) >= r.least if r.tail else m.end() - m.start() >= r.least:
                    want.append((*m.span(), k))
        assert sorted(scanner.spans(line)) == sorted(want)
