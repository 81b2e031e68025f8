"""BPE encoding and decoding: prefixes shared by distinct words are encoded once, in a trie.

A merge list gives every symbol string one encoding.  Each prefix of that encoding is the encoding of its own text, so
it is enough to know, per trie node, the *last* token of the encoding of the path to it: the token before it is the
last token of the node where it starts.  A suffix of the path is the last token if (and only if) it may stand behind
the last token of its start node, i.e. no merge across their border would have come first.  A depth-first walk
fills the nodes from the root; a word's tokens are read by jumping back from its end node.
"""

from __future__ import annotations

import hashlib
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame

from depthlens.llm import byte_level
from depthlens.llm.text import made_once, map_batches, texts

#: How the public word vocabulary cuts normalized text, and its mark for the end of a word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class Trie:
    """Words as strings with one character per symbol: bytes are U+0000-00FF, word-final bytes U+0100-01FF.

    Nodes are numbers.  ``last[node]`` is the last token of the path to the node and ``start[node]`` the node where that
    token begins.  Words come sorted, so nodes are made depth-first and a node is filled when it is made: all nodes
    above it are filled by then.
    """

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        self.ids = ids
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts: dict[str, tuple[str, str]] = {}  # token -> the two that make it
        self.made: dict[str, int] = {}  # token -> rank of the merge that makes it
        for i, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b))
            self.made.setdefault(a + b, i)
        self.suffixes = dict.fromkeys((t[i:] for t in ids for i in range(1, len(t))), False) | dict.fromkeys(ids, True)  # whether it is a token
        self.fits: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self):
        self.child: dict[int, int] = {}
        self.last: list[str] = [""]
        self.start = array("i", [0])
        self.path, self.word = [0], ""  # nodes on the way of the last word
        self.fits.clear()

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when they stand side by side.

        The merge made last on either side of the border is undone first; a merge across the border that ranks before
        the one just undone (on equal rank the one further left comes first) would have come before it.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        bound, fits, a, b = float("inf"), True, left, right
        while True:
            cross = self.rank.get((a, b))
            if cross is not None and cross < bound:
                fits = False
                break
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                bound, a = ra, self.parts[a][1]
            else:
                bound, b = rb + 0.5, self.parts[b][0]
        self.fits[key] = fits
        return fits

    def insert(self, word: str) -> int:
        """The node of ``word``; new nodes get their last token.  The prefix shared with the word before is not walked again."""
        child, last, start, suffixes, path = self.child, self.last, self.start, self.suffixes, self.path
        shared, before = 0, self.word
        for c, d in zip(word, before):
            if c != d:
                break
            shared += 1
        del path[shared + 1 :]
        self.word, at = word, path[shared]
        for i in range(shared + 1, len(word) + 1):
            key = at << 9 | ord(word[i - 1])
            at = child.get(key)
            if at is None:
                fitting = []
                for lo in range(i - 1, -1, -1):
                    token = word[lo:i]
                    whole = suffixes.get(token)
                    if whole:
                        fitting.append((token, path[lo]))
                    elif whole is None:
                        break
                for token, node in reversed(fitting):
                    if not node or self.compatible(last[node], token):
                        break
                at = child[key] = len(last)
                last.append(token)
                start.append(node)
            path.append(at)
        return at

    def tokens(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.last[node])
            node = self.start[node]
        return out[::-1]


class Encoder:
    """Encodes and decodes texts for one vocabulary file."""

    #: Nodes of the trie; bytes of the pieces of text whose result is kept; pieces that are looked at together.
    MAX_NODES, KNOWN_BYTES, STEP = 600_000, 128 << 20, 50_000

    def __init__(self, vocabulary: str):
        vocab, merges, special = byte_level.parse(vocabulary)
        byte = {s: chr(b) for b, s in enumerate(byte_level.byte_symbols())}

        def inner(token: str) -> str:
            end = token.endswith(WORD_END)
            t = "".join(byte[c] for c in token.removesuffix(WORD_END))
            return t[:-1] + chr(ord(t[-1]) + 256) if end and t else t

        names = {t: inner(t) for t in vocab if t not in special}
        self.trie = Trie([(inner(a), inner(b)) for a, b in merges], {names[t]: vocab[t] for t in names})
        self.id_text = {names[t]: str(vocab[t]) for t in names}
        self.shown = {str(i).encode(): t.encode() for t, i in vocab.items()} | {str(i).encode(): t.encode() for t, i in special.items()}
        self.special_ids = special
        self.pattern = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {"": b""}  # piece of text -> ids in decimal, joined by blanks
        self.older, self.bytes = {}, 0  # pieces that were not asked for since the last time that ``known`` was full

    def _words(self, piece: str) -> list[str]:
        """Normalized words of a piece of text without blanks."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            piece = piece.replace("Σ", "σ")  # no final sigma
        piece = piece.lower()
        return [piece] if piece.isalpha() else self.pattern.findall(piece)

    def learn(self, pieces: set[str]):
        """Make all ``pieces`` known; the distinct words of those that are not go through the trie in sorted order.

        The trie is begun anew whenever it is full, also between two words; a word's tokens are read at once.
        """
        known, older, trie = self.known, self.older, self.trie
        if self.bytes > self.KNOWN_BYTES // 2:
            self.older = older = known
            self.known = known = {"": b""}
            self.bytes = 0

        def keep(p: str, ids: bytes):
            known[p] = ids
            self.bytes += 190 + len(p) + len(ids)

        def unknown(keys):
            """Those of ``keys`` that are in neither generation; older ones move on."""
            for k in keys:
                if (made := older.pop(k, None)) is None:
                    yield k
                else:
                    keep(k, made)

        split = {p: self._words(p) for p in unknown(pieces.difference(known))}
        # a word of ASCII is a piece of its own and shares its place; no piece begins with a blank
        words = {w if w.isascii() else " " + w for ws in split.values() for w in ws}
        for k in sorted(unknown(words.difference(known))):
            if len(trie.last) > self.MAX_NODES:
                trie.clear()
            s = k.lstrip(" ").encode().decode("latin-1")
            keep(k, " ".join([self.id_text[t] for t in trie.tokens(trie.insert(s[:-1] + chr(ord(s[-1]) + 256)))]).encode())
        for p, ws in split.items():
            if p not in known:
                keep(p, b" ".join([known[w if w.isascii() else " " + w] for w in ws]))

    def _units(self, texts: list[str | None]):
        """(number of the text, pieces without blanks, or one special string) in order, at most ``STEP`` pieces each."""
        for row, t in enumerate(texts):
            segments = self.special.split(t) if t and self.special and self.special.search(t) else [t or ""]
            for i, s in enumerate(segments):
                if i % 2:
                    yield row, s
                else:
                    s = s.replace("\n", " ").split(" ")
                    for lo in range(0, len(s), self.STEP):
                        yield row, s[lo : lo + self.STEP]

    def batch(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """Per text: number of ids, ids in decimal joined by blanks, decoded text (tokens joined by blanks)."""
        ids: list[list[bytes]] = [[] for _ in texts]

        def settle(units):
            self.learn({p for _, x in units if type(x) is list for p in x})
            known = self.known
            for row, x in units:
                found = map(known.__getitem__, x) if type(x) is list else [str(self.special_ids[x]).encode()]
                if found := b" ".join(filter(None, found)):
                    ids[row].append(found)

        units, size = [], 0
        for row, x in self._units(texts):
            units.append((row, x))
            size += len(x)
            if size >= self.STEP:
                settle(units)
                units, size = [], 0
        settle(units)
        out, shown = [], self.shown.__getitem__
        for row in ids:
            joined = b" ".join(row)
            each = joined.split()
            out.append((len(each), joined, b" ".join(map(shown, each))))
        return out


def _encoder(docs: DataFrame, vocabulary_path: str):
    text, digest = byte_level.read_vocabulary(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(text)
    return lambda: made_once(("trie", digest), lambda: Encoder(shared.value))


def encode_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.  Null and empty texts have no ids."""
    encoder = _encoder(docs, vocabulary_path)

    def run(c):
        found = encoder().batch([t.decode() if t else None for t in c["text"]])
        return {
            "doc_id": c["doc_id"], "n_tokens": [n for n, _, _ in found],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for _, i, _ in found],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, _, d in found],
        }

    return map_batches(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text.  Null and empty texts give an empty array and an empty text."""
    encoder = _encoder(docs, vocabulary_path)

    def run(c):
        found = encoder().batch([t.decode() if t else None for t in c["text"]])
        return {
            "doc_id": c["doc_id"], "ids": [[int(x) for x in i.split()] for _, i, _ in found],
            "decoded": [d.decode() for _, _, d in found],
        }

    return map_batches(texts(docs), run, "doc_id long, ids array<int>, decoded string")
