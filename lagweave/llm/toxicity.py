"""Toxicity by a support vector machine on a gapped subsequence kernel with Nystroem landmarks.

The kernel of two words is the normalised gap-weighted count of the letter subsequences (of length 3) that they share, so
letters put between those of an insult lower it but do not end it. The kernel of two sentences is the sum over their words.
Landmarks are words; a word's features are its kernels with the landmarks, to a low and to a high power, whitened by the landmarks'
own kernel matrices. A linear SVM learns sentence weights: in toxic documents, which sentences are toxic is not labelled, so training starts from all of
them and then keeps those that the machine itself scores highest. A logistic layer turns a document's sentence and word margins
into a score. The score of a word depends on the word only, so each task scores each distinct word once.

A word takes part if it holds, in order and with at most two letters put between, three fifths of a landmark's neighbouring
letter pairs. Case and characters other than letters and digits are ignored; runs of three or more one-letter words count as a word,
too, so spaced-out insults are met.

Training adds copies of toxic rows in which letters are put into the telling words, as far as no word of clean documents is more like
the landmark than the new form, so that the threshold allows for them; a row and its copies count as one row.

Bounds of training: at most ``SAMPLE`` labelled documents, chosen by a hash of doc_id, and ``SAMPLE_CHARS`` characters of them (of several texts
under one doc_id the largest in byte order). Scoring covers all texts, whole. Defined
cases: null and empty texts get the score of a text without any margin; repeated rows get equal scores; a document with several labels
is toxic if any says so; without labels of both kinds every score is the share of toxic ones (0 without labels); an empty
table gives an empty result; columns besides ``doc_id`` and ``text`` are carried by ``keep``, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm import words as wd
from lagweave.llm.shared import bucket_of
from lagweave.session import map_arrow

SAMPLE = 4000
#: Characters of the texts trained on: whole texts in the sample's order, as far as they fit.
SAMPLE_CHARS = 64 << 20
LANDMARKS = 96
ORDER, DECAY = 3, 0.85
#: Powers of the kernel (a product of kernels is a kernel): the low one meets words with letters put in, the high one parts stems that differ a little.
POWERS = (2, 6)
#: Copies of toxic training rows with letters put into their telling words.
COPIES = 4
#: Forms tried for each telling word.
FORMS = 40
#: Letters of a piece of a word; longer words are scored by overlapping pieces.
PIECE = 32
#: Pairs of words in one run of the recursion, and words whose features are found at once: bounds of working memory.
PAIRS, WORDS = 2048, 50_000
#: Rows of the machine's matrix that are worked on at once.
ROWS = 4096
#: Share of a landmark's neighbouring pairs that a word must hold.
SHARED = 0.6
#: Marks around a word: where a stem stands tells as much as its letters.
BEGIN, END = "<", ">"
#: Ends of sentences.
_ENDS = np.isin(np.arange(256), list(b".!?\n"))

_ALNUM = np.zeros(0x110000, bool)


def _alnum() -> np.ndarray:
    if not _ALNUM.any():
        _ALNUM[[c for c in range(0x110000) if chr(c).isalnum()]] = True
    return _ALNUM


def ssk(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernels of paired rows of code arrays; 0 pads."""
    n, ls = s.shape
    lt = t.shape[1]
    prime = np.ones((lt + 1, n), np.float32)  # K'_0(j, .)
    history = [prime] * (ls + 1)
    square = np.float32(decay * decay)
    for _ in range(order - 1):
        now = [np.zeros((lt + 1, n), np.float32)]
        for j in range(ls):
            second, row = np.zeros(n, np.float32), np.empty((lt + 1, n), np.float32)
            row[0] = 0
            letter = s[:, j]
            for k in range(lt):
                second = decay * second + np.where((letter == t[:, k]) & (letter > 0), square * history[j][k], 0)
                row[k + 1] = decay * now[j][k + 1] + second
            now.append(row)
        history = now
    total = np.zeros(n, np.float32)
    for j in range(ls):
        for k in range(lt):
            total += np.where((s[:, j] == t[:, k]) & (s[:, j] > 0), square * history[j][k], 0)
    return total


def kernel(s: np.ndarray, t: np.ndarray, own_s: np.ndarray | None = None, own_t: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernels of paired rows."""
    if len(s) > PAIRS:  # the recursion keeps a table for each pair
        parts = [slice(k, k + PAIRS) for k in range(0, len(s), PAIRS)]
        return np.concatenate([kernel(s[p], t[p], None if own_s is None else own_s[p], None if own_t is None else own_t[p]) for p in parts])
    own = (ssk(s, s) if own_s is None else own_s) * (ssk(t, t) if own_t is None else own_t)
    return np.where(own > 0, ssk(s, t) / np.sqrt(np.maximum(own, 1e-30)), 0)


def pad(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w[:width]]
    return out


def pair_masks(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, reach: int) -> np.ndarray:
    """256 bits of the ordered letter pairs at most ``reach`` apart in each word."""
    out = np.zeros((len(starts), 4), np.uint64)
    if not len(letters):
        return out
    word = np.repeat(np.arange(len(starts)), lengths)
    for d in range(1, reach + 1):
        at = np.flatnonzero(word[:-d] == word[d:]) if len(word) > d else np.zeros(0, np.int64)
        code = wd.mix(letters[at].astype(np.uint64) * np.uint64(1 << 32) + letters[at + d]) >> np.uint64(56)
        bit = np.uint64(1) << (code & np.uint64(63))
        lane = (code >> np.uint64(6)).astype(np.int64)
        for k in range(4):
            mine = lane == k
            if mine.any():
                w = word[at[mine]]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out[w[first], k] |= np.bitwise_or.reduceat(bit[mine], first)
    return out


@dataclass
class Landmarks:
    words: list[str]
    codes: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    masks: np.ndarray = field(init=False)
    needed: np.ndarray = field(init=False)
    whitening: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.words)
        self.codes = pad(self.words, max(map(len, self.words), default=1))
        self.own = ssk(self.codes, self.codes)
        letters = np.array([ord(c) for w in self.words for c in w], np.uint32)
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.masks = pair_masks(letters, np.cumsum(lengths) - lengths, lengths, 1)
        self.needed = np.maximum(1, np.ceil(SHARED * np.bitwise_count(self.masks).sum(axis=1))).astype(np.int64)
        i, j = np.divmod(np.arange(n * n), n)
        alike = kernel(self.codes[i], self.codes[j]).reshape(n, n).astype(float)
        self.whitening = np.zeros((n * len(POWERS), n * len(POWERS)))
        for k, power in enumerate(POWERS):
            values, vectors = np.linalg.eigh(alike**power + 1e-2 * np.eye(n))
            block = slice(k * n, (k + 1) * n)
            self.whitening[block, block] = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T

    def powers(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, feature, value): each kernel to each power."""
        n = len(self.words)
        return np.tile(left, len(POWERS)), np.concatenate([right + k * n for k in range(len(POWERS))]), np.concatenate([value**p for p in POWERS])

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel) of all pairs that take part; words of at most ``PIECE`` letters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        masks = pair_masks(letters, starts, lengths, 3)
        left, right = [], []
        for z in range(len(self.words)):
            common = np.bitwise_count(masks & self.masks[z]).sum(axis=1)
            found = np.flatnonzero(common >= self.needed[z])
            left.append(found)
            right.append(np.full(len(found), z))
        left, right = np.concatenate(left or [starts[:0]]), np.concatenate(right or [starts[:0]])
        out = np.zeros(len(left))
        order = np.argsort(lengths[left], kind="stable")  # short words do not pay for long ones
        for k in range(0, len(order), PAIRS):
            chosen = order[k : k + PAIRS]
            w = left[chosen]
            width = int(lengths[w].max())
            w, which = np.unique(w, return_inverse=True)
            at = np.minimum(starts[w][:, None] + np.arange(width), len(letters) - 1)
            s = np.where(np.arange(width) < lengths[w][:, None], letters[at], 0)
            out[chosen] = kernel(s[which], self.codes[right[chosen]], ssk(s, s)[which], self.own[right[chosen]])
        return left, right, out


def texts_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The spans' letters and digits, lower-cased, between marks of a word's begin and end; blanks go, too."""
    if not len(start):
        return []
    raw = wd.bytes_of(data, start, end)
    raw = np.where(wd.NOT_BLANK[raw], raw, np.uint8(46))
    joined = np.insert(raw, np.cumsum(end - start)[:-1], 10)  # a line feed between spans
    out = joined.tobytes().decode("utf-8", "replace").lower().split("\n")
    table = _alnum()
    bare = [w if w.isalnum() else "".join(c for c in w if table[ord(c)]) for w in out]
    return [f"{BEGIN}{w}{END}" if w else "" for w in bare]


def _single_runs(words: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of three or more one-byte words in a row."""
    single = (words.end - words.start) == 1
    if len(single) < 3 or not single.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.concatenate(([False], single[1:] & single[:-1] & (words.row[1:] == words.row[:-1]), [False]))
    begin, finish = np.flatnonzero(single & ~joined[:-1]), np.flatnonzero(single & ~joined[1:])
    long = finish - begin >= 2
    return begin[long], finish[long]


@dataclass
class Block:
    """Words, and runs of single letters, of a block of rows; ``code`` is each one's number among the distinct ones."""

    row: np.ndarray
    sentence: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray


def read_block(data: np.ndarray, offsets: np.ndarray) -> Block:
    words = wd.segment(data, offsets, wd.NOT_BLANK, wd.SAME)
    begin, finish = _single_runs(words)
    run_start, run_end = words.start[begin], words.end[finish]
    start, end = np.concatenate((words.start, run_start)), np.concatenate((words.end, run_end))
    hashes = np.concatenate((words.hash, wd.hash_spans(data, run_start, run_end)))
    row = np.concatenate((words.row, words.row[begin]))
    marks = np.concatenate(([0], np.cumsum(_ENDS[data])))
    code, unique = pd.factorize(hashes)
    first = np.zeros(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return Block(row, marks[start] + row, code, unique, start[first], end[first])


def word_features(words: list[str], marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, landmark, kernel), for a long word the largest kernel of its overlapping pieces."""
    if len(words) > WORDS:
        parts = [(k, word_features(words[k : k + WORDS], marks)) for k in range(0, len(words), WORDS)]
        return np.concatenate([p[0] + k for k, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])
    pieces, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= PIECE:
            pieces.append(w)
            owner.append(i)
        else:
            for k in range(0, len(w) - PIECE // 2, PIECE // 2):
                pieces.append(w[k : k + PIECE])
                owner.append(i)
    left, right, value = marks.features(pieces)
    left = np.asarray(owner, np.int64)[left] if len(left) else left
    if len(pieces) == len(words):
        return left, right, value
    key, at = np.unique(left * len(marks.words) + right, return_inverse=True)
    largest = np.zeros(len(key))
    np.maximum.at(largest, at, value)
    return key // len(marks.words), key % len(marks.words), largest


def svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and balanced classes, by Newton steps over blocks of rows.

    ``toxic`` and ``clean`` are what each row counts as one of either class (a row can stand for sentences of both).
    """
    sides = [(1.0, 0.5 * toxic / max(toxic.sum(), 1e-9)), (-1.0, 0.5 * clean / max(clean.sum(), 1e-9))]
    n = x.shape[1]
    ridge = np.full(n + 1, penalty * 1e-3)
    ridge[-1] = 1e-9
    w = np.zeros(n + 1)

    def values(w: np.ndarray) -> np.ndarray:
        return x @ w[:-1].astype(np.float32) + w[-1]

    def loss(w: np.ndarray) -> float:
        f = values(w)
        return float(ridge @ (w * w) + sum(cost @ np.maximum(0, 1 - y * f) ** 2 for y, cost in sides))

    for _ in range(50):
        f = values(w)
        gradient, hessian = ridge * w, np.diag(ridge) + 1e-12 * np.eye(n + 1)
        for y, cost in sides:
            active = np.flatnonzero((y * f < 1) & (cost > 0))
            for k in range(0, len(active), ROWS):
                at = active[k : k + ROWS]
                a = np.hstack((x[at], np.ones((len(at), 1))))
                gradient = gradient - a.T @ (cost[at] * (y - a @ w))
                hessian = hessian + a.T @ (a * cost[at][:, None])
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights, none below 0, and a constant as the last one, by accelerated projected gradients; y is 0 or 1, ``share`` what a row counts.

    Every feature counts what speaks for toxicity, so more of it must not lower a score.
    """
    design = np.hstack((x, np.ones((len(x), 1))))
    ridge = np.full(design.shape[1], penalty)
    ridge[-1] = 0
    share = share / share.sum()
    step = 1 / (0.25 * np.linalg.norm(design * np.sqrt(share)[:, None], 2) ** 2 + penalty)
    w = previous = np.zeros(design.shape[1])
    for k in range(5000):
        ahead = w + k / (k + 3) * (w - previous)
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        previous, w = w, ahead - step * (design.T @ (share * (p - y)) + ridge * ahead)
        w[:-1] = np.maximum(w[:-1], 0)
        if k > 50 and np.abs(w - previous).max() < 1e-7:
            break
    return w


@dataclass
class Model:
    marks: Landmarks
    #: A word's score is its kernels times these.
    weights: np.ndarray
    bias: float
    #: Means, scales and weights of the document layer.
    center: np.ndarray
    scale: np.ndarray
    layer: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.center) / self.scale) @ self.layer[:-1] + self.layer[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(row: np.ndarray, sentence: np.ndarray, value: np.ndarray, n_rows: int, bias: float) -> np.ndarray:
    """Of the words that take part: summed and largest margins of words and of sentences."""
    out = np.zeros((n_rows, 6))
    if not len(row):
        return out
    gain = np.maximum(value, 0)
    out[:, 0] = np.log1p(np.bincount(row, gain, minlength=n_rows))
    order = np.lexsort((-gain, row))
    r = row[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    for k in range(3):
        mine = rank == k
        out[r[mine], 1 + k] = gain[order[mine]]
    code, _ = pd.factorize(sentence)
    margin = np.bincount(code, value) + bias
    owner = np.zeros(len(margin), np.int64)
    owner[code] = row
    out[:, 4] = np.log1p(np.bincount(owner, np.maximum(margin, 0), minlength=n_rows))
    np.maximum.at(out[:, 5], owner, margin - bias)
    return out


def choose_landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, size: int = LANDMARKS) -> tuple[list[str], dict[str, float]]:
    """Words that tell toxic documents, spread by their kernels, and their likes from clean documents, a quarter of all; and of
    each telling word the kernel with the clean word that is most like it."""
    p, q = toxic / max(n_toxic, 1), clean / max(n_clean, 1)
    both = (toxic + clean) / (n_toxic + n_clean)
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both) * (1 / max(n_toxic, 1) + 1 / max(n_clean, 1)), 1e-12))
    length = np.fromiter(map(len, words), np.int64, len(words))
    fit = np.flatnonzero((length >= ORDER + 2) & (length <= PIECE) & (toxic >= 3) & (z > 5))
    fit = fit[np.argsort(-z[fit], kind="stable")][:200]
    if not len(fit):
        return [], {}
    codes = pad([words[i] for i in fit], PIECE)
    i, j = np.divmod(np.arange(len(fit) ** 2), len(fit))
    alike = kernel(codes[i], codes[j]).reshape(len(fit), len(fit)) ** POWERS[-1]
    nearest, chosen = np.zeros(len(fit)), []
    while len(chosen) < min(size * 3 // 4, len(fit)):
        best = int(np.argmax(z[fit] * np.maximum(1 - nearest, 0)))
        if nearest[best] >= 0.999:
            break
        chosen.append(best)
        nearest = np.maximum(nearest, alike[best])
    positive = [words[fit[k]] for k in chosen]
    rest = np.flatnonzero((length >= ORDER + 2) & (length <= PIECE) & (z <= 0) & (clean >= 2))
    rest = rest[np.argsort(-clean[rest], kind="stable")][:20_000]
    names = [words[k] for k in rest]
    left, right, value = Landmarks(positive).features(names)
    near, nearest = np.zeros(len(names)), np.zeros(len(positive))
    np.maximum.at(near, left, value ** POWERS[-1])
    np.maximum.at(nearest, right, value)
    like = np.argsort(-near * np.log1p(clean[rest]), kind="stable")[: size - len(positive)]
    return positive + [names[k] for k in like if near[k] > 0.1], dict(zip(positive, nearest.tolist(), strict=True))


def distorted(word: str, rng: np.random.Generator, letters: str) -> str:
    """``word`` with a letter put in between, at times two, or one of its own doubled."""
    out = word
    for _ in range(int(rng.choice([1, 1, 2]))):
        at = int(rng.integers(2, len(out) - 1))
        out = out[:at] + (out[at - 1] if rng.random() < 0.25 else letters[int(rng.integers(len(letters)))]) + out[at:]
    return out


def with_distorted(row: np.ndarray, sentence: np.ndarray, word: np.ndarray, words: list[str], labels: np.ndarray, nearest: dict[str, float], copies: int = COPIES) -> tuple[np.ndarray, ...]:
    """Training rows and, of each toxic one that holds a telling landmark, copies in which letters are put into these words.

    A form that is less like its word than some word of clean documents is (``nearest``) tells nothing, and the word stays as it is.
    Who is to be met in such a form must be learned from it: without them the machine's threshold falls between the words as
    they are and everything else. ``words`` grows by the new forms.
    """
    rng = np.random.default_rng(11)
    letters = "".join(sorted({c for w in nearest for c in w} - {BEGIN, END}))
    telling = np.zeros(len(words), bool)
    numbers = {w: i for i, w in enumerate(words)}
    telling[[numbers[w] for w in nearest if len(w) <= PIECE - 4]] = True
    own = Landmarks(list(nearest))
    forms: dict[int, list[int]] = {}
    for z, w in enumerate(nearest):
        if telling[numbers[w]]:
            made = sorted({distorted(w, rng, letters) for _ in range(FORMS)})
            alike = kernel(pad(made, PIECE), np.repeat(own.codes[z : z + 1], len(made), 0))
            made = [f for f, k in zip(made, alike, strict=True) if k > nearest[w]]
            if 2 * len(made) < FORMS:
                telling[numbers[w]] = False
            for f in made:
                if f not in numbers:
                    numbers[f] = len(words)
                    words.append(f)
            forms[numbers[w]] = [numbers[f] for f in made]
    wanted = np.zeros(len(labels), bool)
    wanted[row[telling[word] & (labels[row] == 1)]] = True
    of_wanted = np.flatnonzero(wanted[row])
    rows, sentences, all_words, marks = [row], [sentence], [word], [labels]
    number = np.cumsum(wanted) - 1
    n_rows, n_sentences = len(labels), int(sentence.max(initial=-1)) + 1
    for _ in range(copies):
        w = word[of_wanted].copy()
        for k in np.flatnonzero(telling[w]).tolist():
            w[k] = rng.choice(forms[w[k]])
        rows.append((n_rows + number[row[of_wanted]]).astype(row.dtype))
        sentences.append((n_sentences + sentence[of_wanted]).astype(sentence.dtype))
        all_words.append(w)
        marks.append(np.ones(int(wanted.sum()), labels.dtype))
        n_rows, n_sentences = n_rows + int(wanted.sum()), 2 * n_sentences
    # a row and its copies count as one row
    part = 1 / (1 + copies * wanted)
    share = np.concatenate([part, *[part[wanted]] * copies])
    return np.concatenate(rows), np.concatenate(sentences), np.concatenate(all_words), np.concatenate(marks), share


def fit(texts: list[str | None], labels: np.ndarray) -> Model | float:
    """Train on whole texts with labels 0 and 1; the share of ones if there is nothing to learn."""
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    numbers: dict[str, int] = {}
    row, sentence, word, done, last = [], [], [], 0, 0
    for data, offsets in wd.blocks(pa.array([t or "" for t in texts], pa.large_string()), 1 << 20):
        b = read_block(data, offsets)
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in texts_of(data, b.start, b.end)], np.int64)
        row.append((b.row + done).astype(np.int32))
        sentence.append((b.sentence + last).astype(np.int32))
        word.append(ids[b.code].astype(np.int32))
        done, last = done + len(offsets) - 1, last + int(b.sentence.max(initial=0)) + 2
    row, sentence, word = (np.concatenate(x) for x in (row, sentence, word))
    words = list(numbers)
    pairs = np.unique(row.astype(np.int64) * len(words) + word)
    owner, kind = pairs // len(words), pairs % len(words)
    toxic = np.bincount(kind[labels[owner] == 1], minlength=len(words))
    clean = np.bincount(kind[labels[owner] == 0], minlength=len(words))
    del pairs, owner, kind
    chosen, nearest = choose_landmarks(words, toxic, clean, int(labels.sum()), int((1 - labels).sum()))
    if not chosen:
        return float(labels.mean())
    row, sentence, word, labels, share = with_distorted(row, sentence, word, words, labels, nearest)
    marks = Landmarks(chosen)
    left, right, value = marks.powers(*word_features(words, marks))
    table = np.full(len(words), -1)
    there = np.unique(left)
    table[there] = np.arange(len(there))
    size = len(chosen) * len(POWERS)
    features = np.zeros((len(there), size), np.float32)
    features[table[left], right] = value
    taking = np.flatnonzero(table[word] >= 0)
    code, _ = pd.factorize(sentence[taking])
    n = int(code.max(initial=-1)) + 1
    if not n:
        return float(labels.mean())
    # sentences of the same taking words are one row of the machine, which saves most of them
    order = np.argsort(code, kind="stable")
    kinds = table[word[taking[order]]]
    begin = np.searchsorted(code[order], np.arange(n + 1))
    names = np.add.reduceat(wd.mix(kinds.astype(np.uint64) + np.uint64(1)), begin[:-1])
    pattern, unique = pd.factorize(names)
    first = np.empty(len(unique), np.int64)
    first[pattern[::-1]] = np.arange(n)[::-1]
    x = np.zeros((len(unique) + 1, size), np.float32)
    whitening = marks.whitening.astype(np.float32)
    for k in range(0, len(unique), ROWS):
        mine = first[k : k + ROWS]
        long = begin[mine + 1] - begin[mine]
        before = np.cumsum(long) - long
        tokens = np.repeat(begin[mine] - before, long) + np.arange(int(long.sum()))
        x[k : k + len(mine)] = np.add.reduceat(features[kinds[tokens]], before, axis=0) @ whitening
    # a clean document also stands for its sentences in which no word takes part: the last row
    rest = np.flatnonzero(labels == 0)
    document = np.zeros(n, np.int64)
    document[code] = row[taking]
    document, pattern = np.concatenate((document, rest)), np.concatenate((pattern, np.full(len(rest), len(unique))))
    is_toxic = labels[document] == 1
    use = np.ones(len(document), bool)
    weights, bias = np.zeros(size), 0.0
    for _ in range(4):
        counts = [np.bincount(pattern[use & side], share[document[use & side]], minlength=len(x)) for side in (is_toxic, ~is_toxic)]
        if not (counts[0].any() and counts[1].any()):
            break
        weights, bias = svm(x, *counts)
        margin = (x @ weights.astype(np.float32) + bias)[pattern]
        best = np.full(len(labels), -np.inf)
        np.maximum.at(best, document, margin)
        use = ~is_toxic | (margin > 0) | (margin >= best[document])
    del x
    weights = marks.whitening @ weights
    got = document_features(row[taking], sentence[taking], (features @ weights)[table[word[taking]]], len(labels), bias)
    center, scale = got.mean(axis=0), np.maximum(got.std(axis=0), 1e-6)
    return Model(marks, weights, bias, center, scale, logistic((got - center) / scale, labels.astype(float), share))


class Memory:
    """Scores of the words that a task has met; NaN for words that take no part."""

    def __init__(self, model: Model, most: int = 2_000_000) -> None:
        self.model, self.most = model, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, b: Block, data: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, b.hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == b.hashes[known]
        out = np.empty(len(b.hashes))
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            marks = self.model.marks
            left, right, value = marks.powers(*word_features(texts_of(data, b.start[new], b.end[new]), marks))
            got = np.full(len(new), np.nan)
            got[np.unique(left)] = 0
            np.add.at(got, left, value * self.model.weights[right])
            out[new] = got
            if len(self.keys) + len(new) > self.most:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
            keys, order = b.hashes[new], np.argsort(b.hashes[new])
            at = np.searchsorted(self.keys, keys[order])
            self.keys, self.values = np.insert(self.keys, at, keys[order]), np.insert(self.values, at, got[order])
        return out


def scores(column: pa.Array, model: Model | float, memory: Memory | None) -> np.ndarray:
    if memory is None:
        return np.full(len(column), float(model))
    out = []
    for data, offsets in wd.blocks(column, 1 << 20):
        b = read_block(data, offsets)
        value = memory.of(b, data)[b.code]
        taking = np.flatnonzero(~np.isnan(value))
        out.append(model.score(document_features(b.row[taking], b.sentence[taking], value[taking], len(offsets) - 1, model.bias)))
    return np.concatenate(out) if out else np.zeros(0)


def is_held_out(modulus: int = 5):
    return bucket_of(F.col("doc_id"), modulus) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 5) -> Model | float:
    """Fit on labelled rows that are not held out, ``sample`` at most."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(modulus))
    n = marked.count()
    if n > sample:
        # by a hash: a share that holds some more than ``sample`` rows, of which the first ones stay
        share = min(1.0, 1.5 * sample / n + 100 / n)
        marked = marked.withColumn("h", F.xxhash64("doc_id", F.lit(17))).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * share))
        marked = marked.orderBy(F.pmod("h", F.lit(1 << 30)), "doc_id").limit(sample).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["h"], r["doc_id"], r["text"], int(r["toxic"])) for b in batches for r in b.to_pylist())
        room = np.cumsum([len(r[2]) for r in rows]) <= SAMPLE_CHARS
        rows = [r for r, fits in zip(rows, room.tolist(), strict=True) if fits]
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the sample is bounded, so one task trains on it; the driver sees the model only
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)))
    models = map_arrow(rows.repartition(1), run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else 0.0


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, score`` for every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: some 100 kB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(sent.value) if isinstance(sent.value, Model) else None
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text"), sent.value, memory), pa.float64())], schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def keep(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with scores below the threshold, with all their columns."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(sent.value) if isinstance(sent.value, Model) else None
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), sent.value, memory) < threshold, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
