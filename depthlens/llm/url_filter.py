"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern as filter lists write them: ``||`` at its start ties it to a host and its subdomains, ``|`` to either
end of the url, ``*`` stands for any characters and ``^`` for a separator or the end.  Every rule needs its literal tokens
(runs of letters, digits and %) to be tokens of a url that it fits, so a rule is filed under one of them only - the
one that the fewest urls of the table hold, counted in Spark.  A url fetches the rules filed under its own tokens, and only
those run their regular expressions.  Rules without a whole literal token are tried on every url.

Rules come in two lists: host rules (host, path), of which the longest fitting one decides, and after those block patterns
with ``@@`` exceptions.  The list of rules is dealt into blocks of bounded size; each block is broadcast and applied in one pass
without a shuffle, and a url's best rule so far travels in its row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from depthlens.llm.text import map_batches

#: Characters of patterns in one broadcast block of rules.
BLOCK_CHARS = 4 << 20

_TOKEN = re.compile("[a-z0-9%]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"


class Rule(NamedTuple):
    """``pattern`` without ``@@``; ``host`` rules are decided by length, others as block or exception (``allow``)."""

    name: str
    verdict: str
    pattern: str
    host: bool

    @property
    def expression(self) -> str:
        """A regular expression, for ``match`` on what follows the first ``://`` if the pattern starts with ``||``, and for ``search`` otherwise."""
        p, out = self.pattern, ""
        if p.startswith("||"):
            p, out = p[2:], r"(?:[^/?#]*\.)?"
        elif p.startswith("|"):
            p, out = p[1:], r"\A"
        end = p.endswith("|")
        p = p[:-1] if end else p
        for c in p:
            out += r"[\s\S]*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c)
        return out + (r"\Z" if end else "")

    def tokens(self) -> list[str]:
        """Literal tokens that a url must hold as whole tokens for the rule to fit."""
        p = self.pattern.translate(_LOWER)
        left = len(p) - len(p.lstrip("|"))
        right = len(p) - len(p.rstrip("|"))
        body = p[left : len(p) - right] if left + right < len(p) else ""
        found = []
        for m in _TOKEN.finditer(body):
            before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
            opened = before != "*" if before else left > 0
            closed = after != "*" if after else right > 0
            if opened and closed:
                found.append(m[0])
        return found


def host_rules(rules: Iterable[tuple[str, str, str]]) -> list[Rule]:
    """Rules from (verdict, host, path): they fit the host and its subdomains where the path starts with ``path``."""
    return [Rule(host + path, verdict, f"||{host.translate(_LOWER)}{path}", True) for verdict, host, path in rules]


def pattern_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules from lines of a filter list; ``@@`` marks exceptions, ``!`` comments; blank lines say nothing."""
    lines = [s for s in map(str.strip, lines) if s and not s.startswith("!")]
    return [Rule(s, "allow" if s.startswith("@@") else "block", s.removeprefix("@@"), False) for s in lines]


def split_url(url: str | None) -> tuple[str, str, str | None]:
    """Host (A-Z lower-cased), path, and the url after its first ``://`` with that host; null or no ``://``: empty, empty, None."""
    if not url or (at := url.find("://")) < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path = re.compile("[^?#]*").match(rest, len(host))[0]
    return host.translate(_LOWER), path, host.translate(_LOWER) + rest[len(host) :]


class Index:
    """Rules under their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules, self.always, self.by_token = rules, [], {}
        for k, r in enumerate(rules):
            if tokens := r.tokens():
                self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
            else:
                self.always.append(k)
        self.expressions: dict[int, re.Pattern] = {}

    def fitting(self, url: str, rest: str | None) -> Iterator[Rule]:
        """The rules of the index that fit; ``rest`` as ``split_url`` gives it."""
        for token in [None, *dict.fromkeys(_TOKEN.findall(url.translate(_LOWER)))]:
            for k in self.always if token is None else self.by_token.get(token, ()):
                rule = self.rules[k]
                x = self.expressions.get(k)
                if x is None:
                    x = self.expressions[k] = re.compile(rule.expression, 0 if rule.host else re.IGNORECASE | re.ASCII)
                if not rule.pattern.startswith("||"):
                    if x.search(url):
                        yield rule
                elif rest is not None and x.match(rest):
                    yield rule


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many urls each of ``tokens`` occurs; the result is no larger than ``tokens``."""
    shared = urls.sparkSession.sparkContext.broadcast(tokens)

    def run(c):
        wanted, n = shared.value, Counter()
        for u in c["url"]:
            if u:
                n.update(wanted.intersection(_TOKEN.findall(u.translate(_LOWER))))
        return {"token": list(n), "n": list(n.values())}

    sums = map_batches(urls.select("url"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in sums.toLocalIterator()}


def blocks(rules: Sequence[Rule], most: int = BLOCK_CHARS) -> Iterator[list[Rule]]:
    """``rules`` in pieces of at most ``most`` characters of patterns (one rule at least)."""
    block, size = [], 0
    for r in rules:
        if block and size + len(r.pattern) > most:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.pattern)
    if block:
        yield block


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", most: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, pattern.

    The host rule with the longest host and path decides (on a tie ``allow``, then the smaller name); ``rule`` names it.  Where none fits,
    a block pattern without a fitting exception blocks (``pattern`` names the smallest), and ``default`` holds otherwise.  A null url, or one without
    ``://``, has an empty host and path and fits no host rule; a null url fits no pattern either.  Rows that repeat are
    judged each; other columns are not read.
    """
    sc = pages.sparkSession.sparkContext
    state = "page_id long, url string, size int, rule string, verdict string, block string, spare boolean"
    urls = pages.select("page_id", "url")
    judged = urls.selectExpr("*", "0 size", "cast(null as string) rule", "cast(null as string) verdict", "cast(null as string) block", "false spare")
    parts = list(blocks(rules, most))
    for part in parts:
        counts = token_counts(urls, {t for r in part for t in r.tokens()})
        shared = sc.broadcast((part, counts))

        def run(c, made=[], shared=shared):  # noqa: B006 - one index per task and block of rules
            if not made:
                made.append(Index(*shared.value))
            out = {n: list(v) for n, v in c.items()}
            for i, url in enumerate(c["url"]):
                if url is None:
                    continue
                for r in made[0].fitting(url, split_url(url)[2]):
                    if r.host:
                        new = (-len(r.name), r.verdict, r.name)
                        if out["rule"][i] is None or new < (-out["size"][i], out["verdict"][i], out["rule"][i]):
                            out["size"][i], out["rule"][i], out["verdict"][i] = len(r.name), r.name, r.verdict
                    elif r.verdict == "allow":
                        out["spare"][i] = True
                    elif out["block"][i] is None or r.name < out["block"][i]:
                        out["block"][i] = r.name
            return out

        judged = map_batches(judged, run, state)

    def finish(c):
        sides = [split_url(u) for u in c["url"]]
        blocked = [b if b is not None and not s else None for b, s in zip(c["block"], c["spare"])]
        return {
            "page_id": c["page_id"], "host": [s[0] for s in sides], "path": [s[1] for s in sides], "rule": c["rule"],
            "verdict": [v if v is not None else "block" if b is not None else default for v, b in zip(c["verdict"], blocked)],
            "pattern": [b if v is None else None for v, b in zip(c["verdict"], blocked)],
        }

    return map_batches(judged, finish, "page_id long, host string, path string, rule string, verdict string, pattern string")


def verdict_sql(rules: Sequence[Rule], default: str = "allow") -> str:
    """The same verdicts as one statement over ``pages``, every rule tried on every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def fits(r: Rule) -> str:
        x = r.expression.replace(r"\A", "^").replace(r"\Z", "$").replace(r"[\s\S]", r"(?:.|\n)")
        if r.pattern.startswith("||"):
            return f"coalesce(regexp_matches(rest, {quote('^' + x)}, '{'c' if r.host else 'i'}'), false)"
        return f"coalesce(regexp_matches(url, {quote(x)}, 'i'), false)"

    hosts = sorted((r for r in rules if r.host), key=lambda r: (-len(r.name), r.verdict, r.name))
    block = sorted((r for r in rules if not r.host and r.verdict == "block"), key=lambda r: r.name)
    spare = [r for r in rules if not r.host and r.verdict == "allow"]
    case = lambda rs, f, e: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(f(r))}" for r in rs) + f" ELSE {e} END" if rs else e
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spared = " OR ".join(map(fits, spare)) or "false"
    return f"""WITH cut AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN strpos(url, '://') > 0 THEN host || substr(url, strpos(url, '://') + 3 + length(host)) END AS rest
  FROM pages),
judged AS (
  SELECT *, {case(hosts, lambda r: r.name, 'NULL')} AS rule, {case(hosts, lambda r: r.verdict, 'NULL')} AS decided,
    CASE WHEN NOT ({spared}) THEN {case(block, lambda r: r.name, 'NULL')} END AS blocked
  FROM cut)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN blocked IS NOT NULL THEN 'block' ELSE '{default}' END) AS verdict,
  CASE WHEN decided IS NULL THEN blocked END AS pattern
FROM judged"""
