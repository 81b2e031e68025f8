"""Language identification of words with a linear-chain conditional random field.

Words are labelled in sequence: a word's emission scores come from affixes, character n-grams and the word itself (its
lexicon feature), all hashed; learned transitions say how likely a text stays in a language or switches.  The forward
and backward recursions give every word's probabilities, so code-switched texts get labels per word; a text's language
is the one with the largest expected number of words.

Training rows are a bounded sample of labelled documents; their lines are spliced so that some sequences switch.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from depthlens.llm.text import made_once, map_batches, mix, texts

BITS = 17
#: Training: documents, words taken from each, words of a sequence, passes.
TRAIN_DOCUMENTS, TRAIN_WORDS, TRAIN_LENGTH, TRAIN_PASSES = 2_400, 120, 40, 4
#: Words whose features are kept per worker.
KNOWN_WORDS = 300_000
_ASCII_LETTERS = bytes(range(97, 123))
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Stretches of letters without case (ASCII) and of characters beyond ASCII."""
    return text.translate(_SPLIT).split() if text else []


def has_letter(word: bytes) -> bool:
    return len(word.translate(None, _ASCII_LETTERS)) < len(word) or any(c.isalpha() for c in word.decode(errors="replace"))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of the words, one word after the other, and their numbers; words without letters have none.

    Features are hashes of the word and of its n-grams of 2 to 4 bytes, word borders counted as bytes: those at a border
    are the affixes.
    """
    kept = [w if has_letter(w) else b"" for w in words]
    sizes = np.array([len(w) + 2 if w else 0 for w in kept], np.int64)
    x = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in kept if w), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    index = [np.array([zlib.crc32(w) for w in kept if w], np.uint64)]
    of = [np.flatnonzero(sizes)]
    for n in (2, 3, 4):
        count = max(0, len(x) - n + 1)
        code = np.full(count, np.uint64(n << 40))
        for i in range(n):
            code |= x[i : i + count] << np.uint64(8 * i)
        inside = owner[:count] == owner[n - 1 : n - 1 + count]
        index.append(mix(code[inside]))
        of.append(owner[:count][inside])
    index, of = np.concatenate(index) & np.uint64((1 << BITS) - 1), np.concatenate(of)
    return index[np.argsort(of, kind="stable")].astype(np.int64), np.bincount(of, minlength=len(words))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, transition: np.ndarray, neighbours: bool = True):
    """Probabilities of each label at each place, (lanes, steps, labels), and of each pair of neighbours, summed.

    ``emission`` holds scores (lanes, steps, labels); places beyond a lane's length get probability 0.
    """
    lanes, steps, labels = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    a = np.exp(transition)
    alpha, beta, scale = np.zeros_like(e), np.zeros_like(e), np.ones((lanes, steps))
    for t in range(steps):
        live = t < lengths
        x = (np.exp(start) if t == 0 else alpha[:, t - 1] @ a) * e[:, t]
        scale[:, t] = np.where(live, x.sum(axis=1), 1.0)
        alpha[:, t] = np.where(live[:, None], x / scale[:, t, None], 0.0)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        last = (t == lengths - 1)[:, None]
        if t + 1 < steps:
            ahead = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
            inside = (t + 1 < lengths)[:, None]
            if neighbours:
                pairs += (alpha[:, t] * inside).T @ (ahead * inside) * a
            beta[:, t] = np.where(last, 1.0, np.where(inside, ahead @ a.T, 0.0))
        else:
            beta[:, t] = np.where(last, 1.0, 0.0)
    p = alpha * beta
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300), pairs


def word_sums(weights: np.ndarray, index: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights (rows ``index``) of each of ``n`` words."""
    return np.column_stack([np.bincount(word, weights[index, j], minlength=n) for j in range(weights.shape[1])])


class WordScores:
    """Emission scores of the words met so far: ``matrix`` has a row for each; begun anew at ``KNOWN_WORDS``."""

    def __init__(self, emission: np.ndarray):
        self.emission, self.number = emission, {}
        self.matrix = np.zeros((0, emission.shape[1]), np.float32)

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Matrix rows of the words with letters of each text."""
        if len(self.number) > KNOWN_WORDS:
            self.number, self.matrix = {}, self.matrix[:0]
        new = list({w for t in texts for w in t if w not in self.number})
        if new:
            index, sizes = features(new)
            found = word_sums(self.emission, index, np.repeat(np.arange(len(new)), sizes), len(new))
            at = np.where(sizes > 0, len(self.matrix) + np.arange(len(new)), -1)
            self.number.update(zip(new, at.tolist()))
            self.matrix = np.concatenate([self.matrix, found.astype(np.float32)])
        out = [np.fromiter(map(self.number.__getitem__, t), np.int64, len(t)) for t in texts]
        return [r[r >= 0] for r in out]


class Crf:
    """Weights: emission (features x labels), start, transition."""

    def __init__(self, labels: list[str], emission=None, start=None, transition=None):
        k = len(labels)
        self.labels = labels
        self.emission = np.zeros((1 << BITS, k), np.float32) if emission is None else emission
        self.start = np.zeros(k) if start is None else start
        self.transition = np.zeros((k, k)) if transition is None else transition

    def train(self, sequences: list[list[bytes]], targets: list[list[int]], passes: int, rate: float = 0.4, seed: int = 7):
        """Adaptive gradient ascent of the log likelihood on batches of sequences."""
        k = len(self.labels)
        number: dict[bytes, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in q], np.int64) for q in sequences]
        all_index, all_sizes = features(list(number))
        begin = np.cumsum(all_sizes) - all_sizes
        squares = [np.full(x.shape, 1e-4) for x in (self.emission, self.start, self.transition)]
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            order = rng.permutation(len(sequences))
            for lo in range(0, len(order), 64):
                batch = [coded[i] for i in order[lo : lo + 64]]
                gold = [targets[i] for i in order[lo : lo + 64]]
                lengths = np.array([len(s) for s in batch])
                ids = np.concatenate(batch)
                sizes = all_sizes[ids]
                word = np.repeat(np.arange(len(ids)), sizes)
                index = all_index[np.repeat(begin[ids], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                score = word_sums(self.emission, index, word, len(ids))
                lane, step = np.repeat(np.arange(len(batch)), lengths), np.concatenate([np.arange(n) for n in lengths])
                grid = np.zeros((len(batch), lengths.max(), k))
                grid[lane, step] = score
                p, pairs = forward_backward(grid, lengths, self.start, self.transition)
                y = np.concatenate(gold)
                g = -p[lane, step]
                g[np.arange(len(y)), y] += 1
                touched, at = np.unique(index, return_inverse=True)
                ge = np.column_stack([np.bincount(at, g[word, j], minlength=len(touched)) for j in range(k)])
                inner = step[1:] > 0
                gt = -pairs
                np.add.at(gt, (y[:-1][inner], y[1:][inner]), 1.0)
                first = step == 0
                gs = g[first].sum(axis=0)
                squares[0][touched] += ge**2
                self.emission[touched] += rate * ge / np.sqrt(squares[0][touched])
                for x, s, gx in ((self.start, squares[1], gs), (self.transition, squares[2], gt)):
                    s += gx**2
                    x += rate * 0.1 * gx / np.sqrt(s)

    def expected(self, texts: list[bytes | None], scores: WordScores, most: int = 400_000) -> np.ndarray:
        """Expected number of words of each label in each text; texts are lanes, longest first, in groups."""
        out = np.zeros((len(texts), len(self.labels)))
        rows = scores.rows([words_of(t) for t in texts])
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: -len(rows[i]))
        lo = 0
        while lo < len(order):
            hi = lo + max(1, min(len(order) - lo, most // len(rows[order[lo]])))
            group = order[lo:hi]
            lengths = np.array([len(rows[i]) for i in group])
            ids = np.zeros((len(group), lengths[0]), np.int64)
            ids[np.arange(lengths[0]) < lengths[:, None]] = np.concatenate([rows[i] for i in group])
            out[group] = self._marginal_sums(scores.matrix[ids].astype(np.float64), lengths)
            lo = hi
        return out

    def _marginal_sums(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        p, _ = forward_backward(grid, lengths, self.start, self.transition, neighbours=False)
        return p.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_language_crf(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> Crf:
    """A model of the languages in ``lang``, from ``most`` labelled documents outside the held-out fifth.

    Documents come in the order of a hash of their id; of each, up to ``TRAIN_WORDS`` words from a hashed place on.
    """
    labelled = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").filter(~held_out(F.col("doc_id")))
    picked = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    labels = sorted(r.lang for r in labelled.select("lang").distinct().toLocalIterator())
    each = max(1, most // max(1, len(labels)))
    rows = None
    for lang in labels:  # as many of each language
        some = picked.filter(F.col("lang") == lang).orderBy("h", "doc_id").limit(each)
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return Crf([])
    # at most TRAIN_DOCUMENTS narrow rows: a proven bound
    sample = texts(docs).join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"])

    def cut(c):
        found = []
        for t, h in zip(c["text"], c["h"]):
            w = words_of(t)
            at = h % max(1, len(w) - TRAIN_WORDS)
            found.append(b" ".join(w[at : at + TRAIN_WORDS]))
        return {"doc_id": c["doc_id"], "lang": c["lang"], "words": found}

    rows = map_batches(sample.select("doc_id", "lang", "h", "text"), cut, "doc_id long, lang string, words binary").toArrow().sort_by("doc_id")
    number = {g: i for i, g in enumerate(labels)}
    sequences, targets = [], []
    tail: tuple[list, int] = ([], 0)
    for words, lang, doc in zip(*(rows.column(n).to_pylist() for n in ("words", "lang", "doc_id"))):
        w = [x for x in words.split() if has_letter(x)]
        for lo in range(0, len(w), TRAIN_LENGTH):
            piece = w[lo : lo + TRAIN_LENGTH]
            if (doc + lo) % 4 == 0:  # a switch in the middle of a sequence
                half = len(tail[0]) // 2
                sequences.append(tail[0][:half] + piece)
                targets.append([tail[1]] * half + [number[lang]] * len(piece))
            else:
                sequences.append(piece)
                targets.append([number[lang]] * len(piece))
            tail = (piece, number[lang])
    crf = Crf(labels)
    crf.train(sequences, targets, TRAIN_PASSES)
    return crf


def languages(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score (share of expected words), and ``switched``: the second
    language's share where it is 0.15 or more, else 0.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    """
    crf = crf or train_language_crf(docs)
    shared = docs.sparkSession.sparkContext.broadcast((crf.labels, crf.emission, crf.start, crf.transition))
    tag = f"crf {zlib.crc32(crf.emission.tobytes())} {len(crf.labels)}"

    def run(c):
        model, scorer = made_once(tag, lambda: (Crf(*shared.value), WordScores(shared.value[1])))
        n = model.expected(c["text"], scorer) if model.labels else np.zeros((len(c["text"]), 1))
        total = n.sum(axis=1)
        best = n.argmax(axis=1)
        share = np.sort(n, axis=1)[:, ::-1] / np.maximum(total, 1e-9)[:, None]
        second = share[:, 1] if n.shape[1] > 1 else np.zeros(len(total))
        return {
            "doc_id": c["doc_id"], "held_out": c["held_out"],
            "lang_pred": [model.labels[b] if t > 0 else "und" for b, t in zip(best.tolist(), total.tolist())],
            "score": np.where(total > 0, np.clip(share[:, 0], 0, 1), 0.0).tolist(),
            "switched": np.where(second >= 0.15, second, 0.0).tolist(),
        }

    return map_batches(
        texts(docs, held_out(F.col("doc_id")).alias("held_out")), run,
        "doc_id long, held_out boolean, lang_pred string, score double, switched double",
    )
