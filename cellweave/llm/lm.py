"""Masked pseudo-likelihood: a window network predicts every token from both of its sides.

Word counts of all documents choose the classes; the network is trained in numpy on all documents,
each partition from the same start and averaged by tokens after each round; a document's score is
the sum of the log probability of each token given its neighbours. A word of a shared class is
charged its own share of the class's count, joined from the counts of all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Words, in_turns, small_batches, stored
from .quality import LETTERS

#: Frequent words with a class of their own, and classes that share all other words by hash.
OWN, SHARED = 768, 256
#: Words whose shares of their class every worker holds, 16 bytes each; those of all others are joined.
FREQUENT = 200_000
#: Output classes are predicted in two steps, a group and a member of it.
GROUP = 32
GROUPS = (OWN + SHARED) // GROUP
SIDE = 2
HIDDEN = 16
BATCH, RATE = 8192, 0.01
ROUNDS = 2
SEED = 11
#: Distinct words that a task counts before it passes them on.
COUNT_AT_ONCE = 1_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): hashes of words with their number, combined within the task."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["word", "n"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, n = np.unique(Words(batch.column(0).slice(lo, 256), LETTERS).hash, return_counts=True)
            both, back = np.unique(np.concatenate([keys, part]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, n]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > COUNT_AT_ONCE:
                yield out()
                keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys):
        yield out()


@dataclass
class Classes:
    """Sorted hashes of the words with their own class, their classes, and what is known of each class."""

    words: np.ndarray
    number: np.ndarray
    counts: np.ndarray
    members: np.ndarray
    #: Sorted hashes of the most frequent words of shared classes, and the logs of their shares in them.
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: (word, n) of all words, where it is at hand; never sent to Python workers.
    table: DataFrame | None = None

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = OWN + (hashes % np.uint64(SHARED)).astype(np.int64)
        if not len(self.words):
            return shared
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.number[at], shared)

    def log_shares(self, hashes: np.ndarray) -> np.ndarray:
        """Log share of each word in its class, not a number where it is not among the frequent ones."""
        if not len(self.common):
            return np.full(len(hashes), np.nan)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.shares[at], np.nan)


def classes(docs: DataFrame, text: str = "text") -> Classes:
    """Counted over every document. What reaches the driver is bounded: OWN and FREQUENT words and
    SHARED sums."""
    counts = stored(
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_count, "word long, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "counts",
    )
    often = counts.orderBy(F.desc("n"), "word").limit(OWN + FREQUENT).toArrow()
    top, often = often.slice(0, OWN).to_pylist(), often.slice(OWN)
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    # The remainder of the unsigned hash: SHARED is a power of two.
    rest = counts.groupBy(F.col("word").bitwiseAND(F.lit(SHARED - 1).cast("long")).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    total, members = np.zeros(OWN + SHARED), np.ones(OWN + SHARED)
    for r in rest:
        total[OWN + r["b"]], members[OWN + r["b"]] = r["n"], r["words"]
    for i, r in enumerate(top):
        total[i] = r["n"]
        bucket = OWN + (r["word"] & (SHARED - 1))
        total[bucket] -= r["n"]
        members[bucket] -= 1
    order = np.argsort(words)
    common, n = often["word"].to_numpy().view(np.uint64), often["n"].to_numpy()
    share = np.log(n / (total[OWN + (common % np.uint64(SHARED)).astype(np.int64)] + 1))
    at = np.argsort(common)
    return Classes(words[order], order.astype(np.int64), total, np.maximum(members, 1), common[at], share[at], counts)


SHAPES = [
    (2 * SIDE, OWN + SHARED + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, GROUP), (GROUPS, GROUP),
]
SIZES = [int(np.prod(s)) for s in SHAPES]


class Network:
    """Embeddings of each place of the window, added, squashed, and read out group by group."""

    def __init__(self, flat: np.ndarray):
        cuts = np.cumsum([0, *SIZES])
        self.flat = flat.astype(np.float32)
        self.parts = [self.flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], SHAPES)]

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases alone give the classes' own frequencies."""
        net = cls(np.random.default_rng(SEED).normal(0, 0.1, sum(SIZES)))
        grouped = counts.reshape(GROUPS, GROUP) + 0.5
        net.parts[1][:] = 0
        net.parts[3][:] = np.log(grouped.sum(1) / grouped.sum())
        net.parts[5][:] = np.log(grouped / grouped.sum(1, keepdims=True))
        return net

    def forward(self, context: np.ndarray, target: np.ndarray, learn: bool):
        """Log probability of each target, and the gradient of minus their mean if ``learn``."""
        emb, b, a, ab, w, wb = self.parts
        n = len(target)
        h = emb[0][context[0]]
        for place in range(1, 2 * SIDE):
            h += emb[place][context[place]]
        h = np.tanh(h + b)
        group, member = target // GROUP, target % GROUP
        logp, p = _log_softmax(h @ a + ab, group)
        if learn:
            grads = [np.zeros_like(x) for x in self.parts]
            p[np.arange(n), group] -= 1
            dh = p @ a.T
            grads[2], grads[3] = h.T @ p, p.sum(0)
        # Members are read out for all targets of a group together.
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            at = order[ends[g]:ends[g + 1]]
            if not len(at):
                continue
            inner, q = _log_softmax(h[at] @ w[g] + wb[g], member[at])
            logp[at] += inner
            if learn:
                q[np.arange(len(at)), member[at]] -= 1
                dh[at] += q @ w[g].T
                grads[4][g], grads[5][g] = h[at].T @ q, q.sum(0)
        if not learn:
            return logp
        dz = dh * (1 - h * h)
        grads[1] = dz.sum(0)
        for place in range(2 * SIDE):
            order = np.argsort(context[place].astype(np.int16), kind="stable")
            ids = context[place][order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            grads[0][place][ids[first]] = np.add.reduceat(dz[order], first, axis=0)
        return logp, np.concatenate([g.ravel() for g in grads]) / n


def _log_softmax(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the chosen column of each row, and all probabilities."""
    z = z - z.max(1, keepdims=True)
    e = np.exp(z)
    total = e.sum(1)
    return z[np.arange(len(z)), at] - np.log(total), e / total[:, None]


def windows(text: pa.Array, known: Classes) -> tuple[Words, np.ndarray, np.ndarray]:
    """Classes of all words of a text column and, for each, of the words at the window's places."""
    words = Words(text, LETTERS)
    ids = known.of(words.hash)
    n = len(ids)
    context = np.full((2 * SIDE, n), OWN + SHARED, np.int64)
    for place, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        lo, hi = max(0, -shift), min(n, n - shift)
        if lo < hi:
            same = words.row[lo:hi] == words.row[lo + shift:hi + shift]
            context[place, lo:hi][same] = ids[lo + shift:hi + shift][same]
    return words, ids, context


def trainer(flat: np.ndarray, known: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the partition by Adam steps; its weights and how many tokens they saw."""
        net, seen, step = Network(flat.copy()), 0, 0
        mean, square = np.zeros_like(net.flat), np.zeros_like(net.flat)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                _, ids, context = windows(batch.column(0).slice(lo, 128), known)
                seen += len(ids)
                for a in range(0, len(ids), BATCH):
                    _, g = net.forward(context[:, a:a + BATCH], ids[a:a + BATCH], True)
                    step += 1
                    mean += np.float32(0.1) * (g - mean)
                    square += np.float32(0.01) * (g * g - square)
                    rate = np.float32(RATE / (1 + step / 100) ** 0.5)
                    net.flat -= rate * (mean / np.float32(1 - 0.9**step)) / (np.sqrt(square / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        if seen:
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.flat], kind)], ["n", "w"])

    return run


@dataclass
class Model:
    classes: Classes
    flat: np.ndarray
    #: (word, n) of all words; without it the words of a shared class count as equally likely.
    table: DataFrame | None = None

    def of_classes(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, those of shared classes whose shares are to be joined, and the sum of the
        log probabilities of all classes and of the shares at hand."""
        words, ids, context = windows(text, self.classes)
        out = self._classes(ids, context)
        share = np.where(ids >= OWN, self.classes.log_shares(words.hash), 0.0)
        out += np.nan_to_num(share)
        n = len(words.at) - 1
        return np.diff(words.first), np.bincount(words.row, np.isnan(share), n), np.bincount(words.row, out, n) if len(ids) else np.zeros(n)

    def score(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and the sum of their log probabilities given both sides, all words of
        a shared class being equally likely: what can be said without the table of counts."""
        words, ids, context = windows(text, self.classes)
        out = self._classes(ids, context) - np.log(self.classes.members[ids])
        n = len(words.at) - 1
        return np.diff(words.first), np.bincount(words.row, out, n) if len(ids) else np.zeros(n)

    def _classes(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        net = Network(self.flat)
        out = np.zeros(len(ids))
        for a in range(0, len(ids), BATCH):
            out[a:a + BATCH] = net.forward(context[:, a:a + BATCH], ids[a:a + BATCH], False)
        return out


def _shared_words(text: pa.Array, known: Classes) -> pa.Array:
    """(word, n) of the distinct words of shared classes in each text, the frequent ones left out."""
    words = Words(text, LETTERS)
    rare = (known.of(words.hash) >= OWN) & np.isnan(known.log_shares(words.hash))
    row, word = words.row[rare], words.hash[rare]
    order = np.lexsort((word, row))
    row, word = row[order], word[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(row))).astype(np.int32)
    ends = np.searchsorted(row[first], np.arange(len(words.at))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(n, pa.int32())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def shares(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(text_key, share): of each distinct text with words of shared classes that are not frequent, the
    mean log share of such a word in the count of its class. Words never counted share one count.

    A text's distinct words of that kind meet the counts of all words in one join and are summed by text.
    """
    known = replace(model.classes, table=None)

    def whole(texts: pa.Array) -> pa.Array:
        return in_turns(texts, lambda part: _shared_words(part, known))

    total = F.array(*[F.lit(float(x)) for x in known.counts[OWN:]])
    met = docs.select(text_key(text).alias("text_key"), F.inline(arrow_udf(whole, "array<struct<word:long,n:int>>")(F.col(text))))
    # A word's class is the remainder of its unsigned hash, as in Classes.of.
    size = F.element_at(total, F.col("word").bitwiseAND(F.lit(SHARED - 1).cast("long")).cast("int") + 1) + 1
    own = met.join(model.table.withColumnRenamed("n", "__all"), "word", "left")
    log = F.log(F.coalesce(F.col("__all"), F.lit(1)) / size)
    # Equal texts add to both sums alike.
    return own.groupBy("text_key").agg((F.sum(F.col("n") * log) / F.sum("n")).alias("share"))


def text_key(text: str) -> Column:
    """Two hashes of a text, 128 bits together."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(filled).alias("a"), F.xxhash64(F.lit(SEED), filled).alias("b"))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Train on every document once, a share of them (by hash of the text) in each round.

    After a round the partitions' weights are averaged by tokens, summed in Spark weight by weight.
    """
    counted = classes(small_batches(docs), text)
    known = replace(counted, table=None)
    flat = Network.start(known.counts).flat
    filled = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    for turn in range(rounds):
        part = filled.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        learned = part.mapInArrow(trainer(flat, known), "n long, w array<float>")
        summed = (
            learned.select("n", F.posexplode("w").alias("i", "v")).groupBy("i")
            .agg((F.sum(F.col("n") * F.col("v").cast("double")) / F.sum("n")).alias("v")).orderBy("i").select("v").toArrow()
        )
        if summed.num_rows:
            flat = summed["v"].to_numpy().astype(np.float32)
    return Model(known, flat, counted.table)


def scored(text: Column, model: Model) -> Column:
    """Struct of a text's words, its words whose shares are to be joined, and the log probability of all
    classes and of the shares at hand; if the model has no table of counts, of the words."""
    kind = pa.struct([("n_tokens", pa.int64()), ("n_shared", pa.int64()), ("log_likelihood", pa.float64())])
    bare, whole_words = Model(replace(model.classes, table=None), model.flat), model.table is None

    def part(texts: pa.Array) -> pa.Array:
        n, shared, total = bare.of_classes(texts)
        if whole_words:
            total = bare.score(texts)[1]
        return pa.StructArray.from_arrays([pa.array(x) for x in (n.astype(np.int64), shared.astype(np.int64), total)], fields=list(kind))

    def whole(texts: pa.Array) -> pa.Array:
        return in_turns(texts, part)

    return arrow_udf(whole, "struct<n_tokens:long,n_shared:long,log_likelihood:double>")(text)


def score(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with n_tokens, log_likelihood and mean_log_likelihood of whole texts.

    Tokens are words of letters, digits and non-ASCII. Null and empty texts have no tokens, a
    likelihood of zero and a null mean; repeated rows get equal values; an empty table stays empty.
    Input columns of the added names are replaced.

    A model trained here depends on how the table is dealt over partitions, as each one trains from
    the same start before they are averaged; the counts and the shares of words do not.
    """
    model = model or train(docs, text)
    added = ("n_tokens", "log_likelihood", "mean_log_likelihood")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*names, scored(F.col(text), model).alias("__s"))
    total = F.col("__s.log_likelihood")
    if model.table is not None:
        found = stored(shares(small_batches(docs), model, text).select(F.col("text_key").alias("__k"), F.col("share").alias("__share")), "shares")
        rows = rows.withColumn("__t", text_key(text)).join(found, F.col("__t") == F.col("__k"), "left")
        total = total + F.when(F.col("__s.n_shared") > 0, F.col("__s.n_shared") * F.col("__share")).otherwise(F.lit(0.0))
    out = rows.select(*[F.col(c) for c in names], F.col("__s.n_tokens").alias("n_tokens"), total.alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn(added[2], mean)
