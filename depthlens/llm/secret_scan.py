"""Secret scan with one deterministic automaton for all rules.

Rule expressions become one nondeterministic automaton, subset construction makes it deterministic over byte classes,
and partition refinement minimises it into a transition array.  The finder scans every byte once: the lines of a piece
of text are lanes of a vector, all lanes take one step per byte position.  No rule crosses a line end.

Lines in which the finder ends in its accepting state are cut into spans, each byte of them in a fixed number of steps: the automaton of
the reversed rules reads the line once from its end and marks the positions where a match begins; from the leftmost free one the
anchored automaton walks to the longest end, and the next walk of that rule begins behind it.  So no walk fails, and none
reads bytes that another of the same rule has taken.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from depthlens.llm.text import made_once, map_batches, texts

#: Below this number of lanes the finder takes single steps.
FEW_LANES = 12


class Rule(NamedTuple):
    """A kind of secret.  ``pattern`` is matched leftmost-longest without overlaps; matches below ``least`` are dropped.

    ``least`` counts the bytes after the first accepting one, that one included, where ``tail`` is set, else all bytes.
    """

    kind: str
    pattern: str
    least: int
    tail: bool = False


#: The base rules, then the kinds this scan adds.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)


# -- expressions -> nondeterministic automaton ------------------------------------------------------------------------


class Nfa:
    """Edges by state: (set of bytes, target); ``None`` as the set is an empty step."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def add(self, pattern: str, start: int) -> int:
        """Build ``pattern`` from ``start``; returns its end state.

        Understood: literals, ``\\.`` and ``\\xNN`` escapes, classes, groups, ``|`` and the repeats ``? * + {n,}``.
        """
        at, end = self._choice(pattern, 0, start)
        if at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {at}")
        return end

    def _choice(self, p: str, at: int, start: int) -> tuple[int, int]:
        end = self.state()
        while True:
            at, last = self._sequence(p, at, start)
            self.edges[last].append((None, end))
            if at >= len(p) or p[at] != "|":
                return at, end
            at += 1

    def _sequence(self, p: str, at: int, start: int) -> tuple[int, int]:
        while at < len(p) and p[at] not in "|)":
            begin = at
            at, end = self._atom(p, at, start)
            if at < len(p) and p[at] in "?*+":
                if p[at] in "*+":
                    self.edges[end].append((None, start))
                if p[at] in "?*":
                    self.edges[start].append((None, end))
                    # loops must not be entered from inside what follows
                nxt = self.state()
                self.edges[end].append((None, nxt))
                end, at = nxt, at + 1
            elif at < len(p) and p[at] == "{":
                close = p.index(",}", at)
                for _ in range(int(p[at + 1 : close]) - 1):
                    last = end
                    _, end = self._atom(p, begin, end)
                self.edges[end].append((None, last))
                at = close + 2
            start = end
        return at, start

    def _atom(self, p: str, at: int, start: int) -> tuple[int, int]:
        fresh = self.state()
        self.edges[start].append((None, fresh))
        if p[at] == "(":
            at, end = self._choice(p, at + 1, fresh)
            return at + 1, end
        end = self.state()
        if p[at] == "[":
            members, at = set(), at + 1
            while p[at] != "]":
                lo, at = self._byte(p, at)
                hi = lo
                if p[at] == "-" and p[at + 1] != "]":
                    hi, at = self._byte(p, at + 1)
                members.update(range(lo, hi + 1))
            at += 1
        else:
            b, at = self._byte(p, at)
            members = {b}
        self.edges[fresh].append((frozenset(members), end))
        return at, end

    @staticmethod
    def _byte(p: str, at: int) -> tuple[int, int]:
        if p[at] == "\\":
            return (int(p[at + 2 : at + 4], 16), at + 4) if p[at + 1] == "x" else (ord(p[at + 1]), at + 2)
        return ord(p[at]), at + 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for members, to in self.edges[todo.pop()]:
                if members is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


# -- subset construction and minimisation -----------------------------------------------------------------------------


class Automaton:
    """``table[state * classes + byte_class[byte]]``; state 0 starts; ``accepts[state]`` has a bit per rule."""

    def __init__(self, byte_class: np.ndarray, table: np.ndarray, accepts: np.ndarray):
        self.byte_class, self.table, self.accepts = byte_class, table, accepts
        self.classes = len(table) // len(accepts)


def _byte_classes(nfa: Nfa) -> tuple[np.ndarray, dict[int, int]]:
    """The class of each byte (no edge tells bytes of one class apart), and one byte of each class."""
    sets = {m for edges in nfa.edges for m, _ in edges if m is not None}
    byte_class, signatures = np.zeros(256, np.uint8), {}
    for b in range(256):
        byte_class[b] = signatures.setdefault(tuple(b in m for m in sets), len(signatures))
    return byte_class, {int(c): b for b, c in reversed(list(enumerate(byte_class)))}


def compile_rules(patterns: list[str], search: bool) -> Automaton:
    """One automaton for all ``patterns``.

    ``search``: matches may begin anywhere and an accepting state is never left; else they begin at the first byte and
    a state without any way on is dead.
    """
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for i, p in enumerate(patterns):
        start = nfa.state()
        nfa.edges[root].append((None, start))
        ends[nfa.add(p, start)] = i
    byte_class, sample = _byte_classes(nfa)
    first = nfa.closure([root])
    number, order, rows, accepts = {first: 0}, [first], [], []
    for states in order:  # grows while it is walked
        accept = sum(1 << ends[s] for s in states if s in ends)
        accepts.append(accept)
        row = []
        for c in range(len(sample)):
            if search and accept:
                to = states
            else:
                step = [t for s in states for m, t in nfa.edges[s] if m is not None and sample[c] in m]
                to = nfa.closure([*step, root] if search else step)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    return minimised(byte_class, np.array(rows), np.array(accepts), search)


def compile_reversed(pattern: str) -> Automaton:
    """The automaton that reads backwards: it accepts at every byte where a match of ``pattern`` begins."""
    nfa = Nfa()
    root = nfa.state()
    end = nfa.add(pattern, root)
    back = Nfa()
    back.edges = [[] for _ in nfa.edges]
    for s, edges in enumerate(nfa.edges):
        for members, to in edges:
            back.edges[to].append((members, s))
    byte_class, sample = _byte_classes(nfa)
    first = back.closure([end])
    number, order, rows, accepts = {first: 0}, [first], [], []
    for states in order:  # grows while it is walked
        accepts.append(int(root in states))
        row = []
        for c in range(len(sample)):
            to = back.closure([end, *(t for s in states for m, t in back.edges[s] if m is not None and sample[c] in m)])
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    return minimised(byte_class, np.array(rows), np.array(accepts), False)


def minimised(byte_class: np.ndarray, rows: np.ndarray, accepts: np.ndarray, search: bool) -> Automaton:
    """Refine the partition by acceptance until all states of a block go to the same blocks."""
    _, block = np.unique(accepts > 0 if search else accepts, return_inverse=True)
    while True:
        _, refined = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    _, at = np.unique(block, return_index=True)
    rank = np.argsort(np.argsort(at))  # blocks by first member: the start stays state 0
    keep = np.sort(at)
    return Automaton(byte_class, rank[block[rows[keep]]].astype(np.int32).reshape(-1), accepts[keep])


# -- scanning ---------------------------------------------------------------------------------------------------------


class Scanner:
    """Finder and cutter for one list of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        # a run of one class alone would flag nearly every line, so its least length is part of the finder
        self.finder = compile_rules(
            [f"{r.pattern[:-1]}{{{r.least},}}" if r.pattern[0] == "[" else r.pattern for r in rules], search=True
        )
        f = self.finder
        self.find, self.found = f.table.reshape(-1, f.classes)[:, f.byte_class].tolist(), (f.accepts > 0).tolist()
        self.cutter = compile_rules([r.pattern for r in rules], search=False)
        a = self.cutter
        self.next = a.table.reshape(-1, a.classes)[:, a.byte_class].tolist()  # by state and byte
        self.accepts = a.accepts.tolist()
        # rules that can still be accepted from a state
        self.alive = list(self.accepts)
        changed = True
        while changed:
            changed = False
            for state, row in enumerate(a.table.reshape(-1, a.classes).tolist()):
                mask = self.alive[state]
                for to in row:
                    mask |= self.alive[to]
                changed, self.alive[state] = changed or mask != self.alive[state], mask
        self.reversed = [compile_reversed(r.pattern) for r in rules]
        self.before = [r.table.reshape(-1, r.classes)[:, r.byte_class].tolist() for r in self.reversed]

    def flagged(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Indices of the lanes (stretches of ``buffer``) in which some rule matches."""
        f = self.finder
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        classes = f.byte_class[buffer]
        state = np.zeros(len(order), np.int32)
        # number of lanes that are longer than i bytes, for each i
        longer = len(left) - np.searchsorted(left[::-1], np.arange(left[0] if len(left) else 0), side="right")
        few = int(np.argmax(longer < FEW_LANES)) if len(longer) and longer[-1] < FEW_LANES else len(longer)
        for i, n in enumerate(longer[:few].tolist()):
            state[:n] = f.table[state[:n] * f.classes + classes[at[:n] + i]]
        if few < len(longer):  # a few long lanes are left: a vector of them costs more than single steps
            for lane in range(int(longer[few])):
                now, end = int(state[lane]), int(at[lane] + left[lane])
                for byte in buffer[int(at[lane]) + few : end].tobytes():
                    now = self.find[now][byte]
                    if self.found[now]:
                        break
                state[lane] = now
        return order[f.accepts[state] > 0]

    def begins(self, line: bytes, rule: int) -> list[int]:
        """Where in ``line`` a match of a rule begins, ascending: one pass from the end."""
        before, accepts, state, out = self.before[rule], self.reversed[rule].accepts.tolist(), 0, []
        at = len(line)
        for byte in reversed(line):
            at -= 1
            state = before[state][byte]
            if accepts[state]:
                out.append(at)
        return out[::-1]

    def spans(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the kept matches of a line, in bytes."""
        n, found = len(line), []
        nxt, accepts, alive = self.next, self.accepts, self.alive
        for k, rule in enumerate(self.rules):
            bit, free = 1 << k, 0
            for s in self.begins(line, k):
                if s < free:
                    continue
                state, first, at = 0, None, s
                while at < n:
                    state = nxt[state][line[at]]
                    if not alive[state] & bit:
                        break
                    at += 1
                    if accepts[state] & bit:
                        first, free = at - 1 if first is None else first, at
                if free - (first if rule.tail else s) >= rule.least:
                    found.append((s, free, k))
        return found

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, end, rule) in code points, ordered by start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        buffer = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        ends = np.flatnonzero(buffer == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64) + 1
        begins = np.cumsum(sizes) - sizes
        hits = np.sort(self.flagged(buffer, starts, ends - starts))
        owner = np.searchsorted(begins, starts[hits], side="right") - 1
        for lane, row in zip(hits.tolist(), owner.tolist()):
            base = int(starts[lane] - begins[row])
            line = texts[row][base : base + int(ends[lane] - starts[lane])]
            out[row] += [(base + s, base + e, k) for s, e, k in self.spans(line)]
        for row, found in enumerate(out):
            if found:
                chars = np.cumsum((np.frombuffer(texts[row], np.uint8) & 0xC0) != 0x80)
                point = lambda b: int(chars[b - 1]) if b else 0
                out[row] = sorted((point(s), point(e), k) for s, e, k in found)
        return out


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end), code points, end exclusive; ordered by start, then rule.

    One pass, no shuffle.  Null and empty texts have none; repeated rows are each scanned.
    """

    def run(c):
        scanner = made_once(("secrets", rules), lambda: Scanner(rules))
        found = scanner.scan(c["text"])
        return {"doc_id": c["doc_id"], "spans": [[(rules[k].kind, s, e) for s, e, k in f] for f in found]}

    return map_batches(texts(docs), _as_structs(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _as_structs(run):
    def structs(c):
        out = run(c)
        out["spans"] = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in out["spans"]]
        return out

    return structs


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans by kind, digest of the base spans, and all spans as text."""
    rules = BASE + ADDED

    def run(c):
        scanner = made_once(("secrets", rules), lambda: Scanner(rules))
        found = scanner.scan(c["text"])
        show = lambda f: ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in f)
        base = [[x for x in f if x[2] < len(BASE)] for f in found]
        out = {f"n_{r.kind}": [sum(x[2] == k for x in f) for f in base] for k, r in enumerate(BASE)}
        return out | {
            "doc_id": c["doc_id"], "base_sha256": [hashlib.sha256(show(f).encode()).hexdigest() for f in base],
            "spans": [show(f) for f in found],
        }

    return map_batches(
        texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
