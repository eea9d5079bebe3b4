"""Toxicity by a support vector machine with a gapped subsequence kernel and Nyström landmarks.

The kernel of two words counts common subsequences of three and four characters; a subsequence
that spans n characters weighs DECAY**n, so an insult with characters put in between still meets
the plain one. Landmarks are words of labelled sentences. The machine learns in the space they
span, from every word of the labelled documents; a document is scored by its words' margins.

As spans are bounded, the kernel has an explicit (sparse) form: the machine's sum over landmarks is
folded into one weight for each subsequence that some landmark has. That is the same number.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import _powers, in_turns, mix, small_batches

_U = np.uint64
#: Labelled documents that are learned from at most, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_SEED = 6_000, 20_000, 11
#: Every so many of them set the scale of the scores and teach the machine nothing.
CALIBRATION = 3
SPAN, DECAY = 5, 0.6
PATTERNS = [(0, *p) for size in (2, 3) for p in combinations(range(1, SPAN), size)]
#: Landmarks, and the words that the machine learns from at most: half are those in most documents,
#: half are of all others those of least hash.
LANDMARKS, UNITS = 500, 50_000
#: Landmarks are words and their beginnings of so many characters.
BEGINNINGS = (3, 4, 5, 6)
#: Two landmarks are less alike than this.
ALIKE = 0.9
RIDGE, STEPS = 1e-5, 50
#: Weight of all harmless words against all others: a text has hundreds of them.
HARMLESS = 100.0
#: Deviations from its expected number of toxic sentences from which on a word counts as toxic.
STANDS_OUT = 4.0
#: And the share of such sentences among those that hold it.
STANDS_OUT_SHARE = 0.7
#: Shorter beginnings of words do not make their words count as toxic.
TELLING = 5
#: Longer words are judged in pieces of so many characters, each half of the next.
LONG = 24
#: Labelled texts whose words the driver counts at once.
TURN_ROWS = 250
#: Words whose subsequences are formed at once.
TURN = 1 << 13
#: What is put into known words to learn disguised ones, and their weight against the plain ones.
FILLERS, MARKS, DISGUISED = "xzhoaiet", ".-*_", 0.5
#: Text of which the distinct words are judged at once.
TURN_BYTES = 4 << 20
#: Documents from this score on are predicted to be toxic.
LEAST_SCORE = 0.3
#: Texts that are held out have this remainder.
FOLDS, HELD_OUT = 4, 2
_BEGIN, _END = 1, 2
#: Margins beyond these say no more.
LOW, HIGH = -0.5, 1.5


@dataclass
class Units:
    """Characters of words: ``code[start:end]`` is a word of text ``row``."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def hash(self) -> np.ndarray:
        sums = np.zeros(len(self.code) + 1, _U)
        base = _U(0x9E3779B97F4A7C15 | 1)
        np.cumsum((self.code.astype(_U) + _U(3)) * _powers(len(self.code), base)[0], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _powers(len(self.code) + 1, base)[1][self.start])


def units(texts: list[str]) -> Units:
    """Words in lower case between white space, without marks at their ends; a run of three or more
    lone letters is one word, and a word with marks inside comes without them too. Longer words than
    LONG come in pieces."""
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row_at = np.append(0, np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64))
    space = (code <= 32) | (code == 0xA0) | (code == 0x3000)
    mark = (code < 128) & ~((code >= 48) & (code <= 57)) & ~((code >= 97) & (code <= 122))
    edge = np.diff(np.concatenate([[0], (~space).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    good = np.flatnonzero(~mark & ~space)
    a, b = np.searchsorted(good, start), np.searchsorted(good, end)
    some = b > a
    start, end = good[a[some]], good[b[some] - 1] + 1
    row = np.searchsorted(row_at, start, "right") - 1
    # Set behind the texts: letters that stand alone side by side, and words without the marks in them.
    lone = (end - start == 1) & ~((code[start] >= 48) & (code[start] <= 57)) if len(start) else np.zeros(0, bool)
    new = np.flatnonzero(lone & ~np.append(False, lone[:-1] & (row[1:] == row[:-1])))
    upto = np.flatnonzero(lone & ~np.append(lone[1:] & (row[1:] == row[:-1]), False)) + 1
    long_run = upto - new >= 3
    new, upto = new[long_run], upto[long_run]
    spelled = code[start[np.repeat(new, upto - new) + _ramp(upto - new)]]
    marked = np.flatnonzero(np.diff(np.searchsorted(good, np.stack([start, end], 1)))[:, 0] < end - start)
    sizes = (end - start)[marked]
    inside = np.repeat(start[marked], sizes) + _ramp(sizes)
    plain = ~mark[inside]
    left = np.bincount(np.repeat(np.arange(len(marked)), sizes), plain, len(marked)).astype(np.int64)
    at = len(code) + np.cumsum(np.concatenate([[0], upto - new, left]))
    code = np.concatenate([code, spelled, code[inside[plain]]])
    start, end, row = np.append(start, at[:-1]), np.append(end, at[1:]), np.concatenate([row, row[new], row[marked]])
    pieces = np.maximum(-((LONG - (end - start)) // (LONG // 2)), 0) + 1
    step = _ramp(pieces) * (LONG // 2)
    whole = np.repeat(end, pieces)
    start, row = np.repeat(start, pieces) + step, np.repeat(row, pieces)
    return Units(code, start, np.where(np.repeat(pieces, pieces) > 1, np.minimum(start + LONG, whole), whole), row)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def subsequences(
    code: np.ndarray, start: np.ndarray, end: np.ndarray, open_: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, id, value) of every distinct subsequence of each word with its ends marked, by word.
    Values are scaled so that each word's kernel with itself is one. ``open_``: those that are only
    the beginnings of words and have no end."""
    size = end - start
    first = np.cumsum(size + 2 + SPAN) - (size + 2 + SPAN)
    flat = np.zeros(int((size + 2 + SPAN).sum()), _U)
    flat[np.repeat(first + 1, size) + _ramp(size)] = code[np.repeat(start, size) + _ramp(size)].astype(_U) + _U(8)
    flat[first], flat[first + 1 + size] = _BEGIN, _END if open_ is None else np.where(open_, 0, _END)
    word = np.repeat(np.arange(len(size)), size + 2 + SPAN)
    n, ids, of, value = len(flat) - SPAN, [], [], []
    for p in PATTERNS:
        at = np.flatnonzero((flat[:n] > 0) & (flat[p[-1]:n + p[-1]] > 0))
        h = np.full(len(at), len(p), _U)
        for k in p:
            h = h * _U(0x9E3779B97F4A7C15) + flat[at + k]
        ids.append(mix(h))
        of.append(word[at])
        value.append(np.full(len(at), DECAY ** (p[-1] + 1)))
    ids, of, value = np.concatenate(ids), np.concatenate(of), np.concatenate(value)
    order = np.argsort(of.astype(_U) << _U(44) | ids >> _U(20), kind="stable")
    ids, of, value = ids[order], of[order], value[order]
    cut = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ids, of, value = ids[cut], of[cut], np.add.reduceat(value, cut) if len(cut) else value
    norm = np.sqrt(np.bincount(of, value * value, len(size)))
    return of, ids, value / np.maximum(norm, 1e-12)[of]


@dataclass
class Model:
    """Folded weights of subsequences, the machine's bias, and the scale of documents' scores."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def margins(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), self.bias)
        for lo in range(0, len(start), TURN):
            word, ids, value = subsequences(code, start[lo:lo + TURN], end[lo:lo + TURN])
            if len(self.ids) and len(ids):
                place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                value = value * self.weights[place] * (self.ids[place] == ids)
                out[lo:lo + TURN] += np.bincount(word, value, len(out[lo:lo + TURN]))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(features(self, texts) @ self.scale)))


def features(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text: the largest margin of its words, the second largest, how many distinct words are
    above zero, and one. Margins are cut off at LOW and HIGH."""
    found = units(texts)
    _, at, back = np.unique(found.hash(), return_index=True, return_inverse=True)
    margin = model.margins(found.code, found.start[at], found.end[at])[back]
    pairs = np.unique(found.row * max(len(at), 1) + back, return_index=True)[1] if len(back) else back
    row, margin = found.row[pairs], margin[pairs]
    order = np.lexsort((-margin, row))
    row, margin = row[order], margin[order]
    out = np.zeros((len(texts), 4))
    out[:, :2] = LOW
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    for k in (0, 1):
        out[row[nth == k], k] = np.clip(margin[nth == k], LOW, HIGH)
    out[:, 2] = np.log1p(np.bincount(row, margin > 0, len(texts)))
    out[:, 3] = 1
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss."""
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        curve, slope = ridge * np.eye(len(w)), -ridge * w
        for lo in range(0, len(y), TURN):
            part, sign, heavy = x[lo:lo + TURN].astype(float), y[lo:lo + TURN], weight[lo:lo + TURN]
            slack = 1 - sign * (part @ w)
            heavy = np.where(slack > 0, heavy, 0)
            curve += (part * heavy[:, None]).T @ part
            slope += part.T @ (heavy * sign * slack)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def disguised(words: list[str]) -> list[str]:
    """Each word with a letter put in, with one doubled, and with a mark in every gap."""
    out = []
    for n, word in enumerate(words):
        if len(word) > 2:
            k = 1 + n % (len(word) - 1)
            out += [word[:k] + FILLERS[n % len(FILLERS)] + word[k:], word[:k] + word[k - 1:], MARKS[n % len(MARKS)].join(word)]
    return out


def _deviation(held: np.ndarray, free: np.ndarray, share: float) -> np.ndarray:
    """How far the number of toxic sentences is above the expected one, in standard deviations."""
    return (held - (held + free) * share) / np.sqrt((held + free) * share * (1 - share) + 1)


def _vocabulary(texts: list[str], toxic: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray]:
    """The distinct words of labelled texts, and how many toxic and other texts hold each."""
    hashes, held, free, words = [], [], [], []
    for lo in range(0, len(texts), TURN_ROWS):
        part = units(texts[lo:lo + TURN_ROWS])
        h, at, back = np.unique(part.hash(), return_index=True, return_inverse=True)
        pair = np.unique(back * TURN_ROWS + part.row)
        label = toxic[lo + pair % TURN_ROWS]
        hashes.append(h)
        held.append(np.bincount(pair // TURN_ROWS, label, len(h)))
        free.append(np.bincount(pair // TURN_ROWS, 1 - label, len(h)))
        words += [part.code[a:b].tobytes() for a, b in zip(part.start[at], part.end[at])]
    _, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    held, free = (np.bincount(back, np.concatenate(x), len(first)) for x in (held, free))
    words = [words[i] for i in first]
    end = np.cumsum([len(w) // 4 for w in words])
    start = np.append(0, end[:-1])
    return Units(np.frombuffer(b"".join(words), np.uint32), start, end, np.arange(len(words))), held, free


def _landmarks(found: Units, held: np.ndarray, free: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(start, end, open) of words and beginnings of words: half stand out most in toxic sentences,
    half are the commonest of the others; none is much like an earlier one. And for each word
    whether it or one of its beginnings stands out."""
    start, end = found.start, found.end
    size = end - start
    starts, ends, opens = [start], [end], [np.zeros(len(size), bool)]
    of = [np.arange(len(size))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(size > k)
        starts.append(start[longer])
        ends.append(start[longer] + k)
        opens.append(np.ones(len(longer), bool))
        of.append(longer)
    start, end, open_, of = (np.concatenate(x) for x in (starts, ends, opens, of))
    keys = mix(Units(found.code, start, end, of).hash() ^ open_.astype(_U))
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    held, free = (np.bincount(back, x[of], len(first)) for x in (held, free))
    deviation = _deviation(held, free, held.sum() / max((held + free).sum(), 1))
    toxic = np.zeros(len(size), bool)
    clear = ((deviation >= STANDS_OUT) & (held > STANDS_OUT_SHARE * (held + free)))[back]
    toxic[of[clear & (~open_ | (end - start >= TELLING))]] = True
    out: list[int] = []
    dense: dict[int, dict] = {}
    for order in (np.lexsort((first, -deviation)), np.lexsort((first, -free))):
        taken = 0
        for i in order[:8 * LANDMARKS].tolist():
            if taken == LANDMARKS // 2:
                break
            j = first[i:i + 1]
            _, ids, value = subsequences(found.code, start[j], end[j], open_[j])
            own = dict(zip(ids.tolist(), value.tolist()))
            if all(sum(v * other.get(u, 0.0) for u, v in own.items()) < ALIKE for other in dense.values()):
                dense[i] = own
                out.append(int(j[0]))
                taken += 1
    chosen = np.array(out, np.int64)
    return (start[chosen], end[chosen], open_[chosen]), toxic


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Machine and scale from labelled texts; without any, or with one label only, all scores are
    the smoothed share of toxic ones."""
    rate = (toxic.sum() + 1) / (len(toxic) + 2)
    even = Model(np.zeros(0, _U), np.zeros(0), 0.0, np.array([0, 0, 0, np.log(rate / (1 - rate))]))
    teach = np.arange(len(texts)) % CALIBRATION != 0
    if len(set(toxic[teach].tolist())) < 2 or len(set(toxic[~teach].tolist())) < 2:
        return even
    found, held, free = _vocabulary([t for t, use in zip(texts, teach) if use], toxic[teach])
    landmarks, stands_out = _landmarks(found, held, free)
    lm_word, lm_id, lm_value = subsequences(found.code, *landmarks)
    ids, column = np.unique(lm_id, return_inverse=True)
    table = np.zeros((len(ids), len(landmarks[0])))
    table[column, lm_word] = lm_value
    order = np.lexsort((found.start, -(held + free)))
    rest = order[UNITS // 2:]
    kept = np.append(order[:UNITS // 2], rest[np.argsort(found.hash()[rest], kind="stable")[:UNITS // 2]])
    kernel = table.T @ table
    value, vector = np.linalg.eigh(kernel)
    some = value > 1e-6 * value[-1]
    root = vector[:, some] / np.sqrt(value[some])
    low = table @ root  # subsequences -> Nyström space
    # A toxic sentence has many harmless words: those count as toxic that stand out in such sentences.
    y = np.where(stands_out, 1.0, -1.0)[kept]
    weight = np.where(y > 0, held[kept], np.log1p((held + free)[kept]))
    toxic_words = kept[y > 0]
    changed = disguised([
        "".join(map(chr, found.code[a:b])) for a, b in zip(found.start[toxic_words], found.end[toxic_words])
    ])
    more = units([" ".join(changed)])
    parts = [(found.code, found.start[kept], found.end[kept]), (more.code, more.start, more.end)]
    extra = len(more.start)
    y = np.append(y, np.ones(extra))
    weight = np.append(weight, np.full(extra, DISGUISED * weight[y[:len(weight)] > 0].sum() / max(extra, 1)))
    for side, share in ((1, 1.0), (-1, HARMLESS)):
        weight[y == side] *= share / max(weight[y == side].sum(), 1e-12)
    x = np.ones((len(y), low.shape[1] + 1), np.float32)
    row = 0
    for code, start, end in parts:
        for lo in range(0, len(start), 256):
            word, i, v = subsequences(code, start[lo:lo + 256], end[lo:lo + 256])
            place = np.minimum(np.searchsorted(ids, i), len(ids) - 1)
            known = np.flatnonzero(ids[place] == i)
            n = len(start[lo:lo + 256])
            dense = np.zeros((n, len(ids)), np.float32)
            dense[word[known], place[known]] = v[known]
            x[row:row + n, :-1] = dense @ low
            row += n
    w = _newton(x, y, weight, RIDGE)
    model = Model(ids, low @ w[:-1], float(w[-1]), even.scale)
    own = [t for t, use in zip(texts, teach) if not use]
    model.scale = _logistic(features(model, own), toxic[~teach].astype(float))
    return model


def held_out(doc_id: str) -> Column:
    """Whether no label of the row may be learned from; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, those of least hash. Texts
    over SAMPLE_CHARS characters and null labels teach nothing; of several labels the largest holds."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__toxic"))
        .orderBy(F.xxhash64("__id", F.lit(SAMPLE_SEED)), "__id").limit(rows)
    )
    found = (
        docs.select(F.col(doc_id).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        .where(F.length("__text") <= SAMPLE_CHARS).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
        .select("__id", "__text", "__toxic").dropDuplicates(["__id"])
        .orderBy(F.xxhash64("__id", F.lit(SAMPLE_SEED)), "__id").toArrow()
    )
    return fit(found["__text"].to_pylist(), found["__toxic"].to_numpy().astype(np.int64))


def scored(model: Model, text: Column) -> Column:
    """Score of each whole text; null counts as empty."""

    def part(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    def whole(texts: pa.Array) -> pa.Array:
        return in_turns(texts, part, TURN_BYTES)

    return arrow_udf(whole, "double")(text)


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS,
    model: Model | None = None,
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from LEAST_SCORE on).

    Only the text decides. Null, empty and blank texts have the score of a text without words;
    repeated rows get equal scores; an empty table stays empty. Input columns of the added names
    are replaced.
    """
    model = model or train(docs, labels, doc_id, text, label, rows)
    added = ("held_out", "score", "predicted")
    bare = small_batches(docs).select(*[F.col(c) for c in docs.columns if c not in added], scored(model, F.col(text)).alias("score"))
    return bare.select("*", held_out(doc_id).alias("held_out"), (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
