"""Quality and toxicity: a document classifier combined with host and path rates by empirical Bayes.

The classifier is a logistic regression fitted in numpy on a bounded sample of labelled rows. Its
evidence on all documents is summed per host and per path within the host; a site's rate is shrunk
towards the level above by as much as the spread between sites tells, and every document's
evidence is weighed against its site's rate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Words, in_turns, mix, small_batches, stored
from .decontam import if_small

#: Labelled rows of which the classifier is fitted, the longest text among them, and their choice.
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 50_000
SAMPLE_SEED = 7
#: A word or word beginning must be in so many sampled documents to have a weight.
LEAST_DOCUMENTS = 5
#: Texts whose features the driver forms at once.
TURN_ROWS = 100
PREFIXES = (4, 6, 8)
#: Words kept for each target, by the square of their deviation from independence.
CHOSEN, LEAST_DEVIATION = 300, 25.0
#: Steps between shares of a layout value; sizes are cut at their own quantiles.
SHARES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BINS = len(SHARES) + 1
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
TARGETS = ("quality", "toxic")
#: A document is kept from this quality on and below this toxicity.
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.25

LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_features(text: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """Words of letters and digits, and for each of them the ids of itself and its beginnings."""
    words = Words(text, LETTERS)
    return words, [mix(h ^ np.uint64(i)) for i, h in enumerate([words.hash, *(words.prefix(n) for n in PREFIXES)])]


def dense_features(text: pa.Array) -> np.ndarray:
    """Layout of each text: shares of marks, capitals, digits, words that end in marks, repeats, size."""
    words = Words(text)
    n, chars = len(words.at) - 1, np.maximum(np.diff(words.at), 1)
    count = np.diff(words.first)
    some = np.maximum(count, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[words.at]) / chars

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, flags, n) / some

    kind = np.zeros(256, np.int8)
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    kind[48:58], kind[65:91], kind[10] = 2, 3, 4
    kinds = kind[words.raw]
    h = words.hash
    order = np.lexsort((h, words.row))
    again = np.zeros(len(h))
    again[1:] = (h[order][1:] == h[order][:-1]) & (words.row[order][1:] == words.row[order][:-1])
    next_to = np.zeros(len(h))
    next_to[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    # The last two bytes of a word both marks: not the full stop of a sentence.
    last, size = words.end - 1, words.end - words.start
    both = (size > 1) & (kinds[last] == 1) & (kinds[np.maximum(last - 1, 0)] == 1) if len(h) else np.zeros(0)
    alone = (size == 1) & (kinds[last] == 1) if len(h) else np.zeros(0)
    return np.stack([
        share(kinds == 1), share(kinds == 2), share(kinds == 3), share(kinds == 4), of_words(both), of_words(alone),
        np.bincount(words.row[order], again, n) / some, of_words(next_to), of_words(size.astype(float)), np.log1p(count),
    ], axis=1)


@dataclass
class Model:
    """Weights of words and of binned layout values for each target, and the base rates fitted on."""

    ids: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    rates: np.ndarray
    targets: tuple[str, ...] = field(default=TARGETS)

    def log_odds(self, text: pa.Array) -> np.ndarray:
        """Evidence of each text for each target, one row per text."""
        words, families = word_features(text)
        n = len(words.at) - 1
        out = np.tile(self.bias, (n, 1))
        if len(self.ids):
            row, at, count = [], [], []
            for family in families:
                place = np.searchsorted(self.ids, family)
                place[place == len(self.ids)] = 0
                known = np.flatnonzero(self.ids[place] == family)
                pair, times = np.unique(words.row[known] * len(self.ids) + place[known], return_counts=True)
                row, at, count = row + [pair // len(self.ids)], at + [pair % len(self.ids)], count + [times]
            row, at, x = np.concatenate(row), np.concatenate(at), np.log1p(np.concatenate(count))
            for t in range(len(self.targets)):
                out[:, t] += np.bincount(row, self.weights[at, t] * x, n)
        for j, bins in enumerate(binned(dense_features(text), self.cuts).T):
            out += self.dense[j, bins]
        return out


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, values.T)], axis=1)


def fit(text: pa.Array, labels: np.ndarray) -> Model:
    """Logistic regressions of the columns of ``labels`` (0/1) by full-batch Adam steps.

    Without rows the evidence is always zero; a target of one value keeps its smoothed base rate.
    """
    n, k = labels.shape
    rates = (labels.sum(0) + 1) / (n + 2)
    base = np.log(rates / (1 - rates))
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((10, 0)), np.zeros((10, 1, k)), base, rates)
    ids, row, count, values = [], [], [], []
    for lo in range(0, n, TURN_ROWS):
        part = text.slice(lo, TURN_ROWS)
        words, families = word_features(part)
        for family in families:
            order = np.lexsort((words.row, family))
            i, r = family[order], words.row[order]
            first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))) if len(i) else np.zeros(0, int)
            ids.append(i[first])
            row.append((r[first] + lo).astype(np.int32))
            count.append(np.diff(np.append(first, len(i))).astype(np.int32))
        values.append(dense_features(part))
    ids, row, count, values = (np.concatenate(x) for x in (ids, row, count, values))
    known, column, documents = np.unique(ids, return_inverse=True, return_counts=True)
    kept = np.zeros(len(known), bool)
    for t in range(k):
        held = np.bincount(column, labels[row, t], len(known))
        deviation = (held - documents * rates[t]) ** 2 / (documents * rates[t] * (1 - rates[t]))
        deviation[(documents < LEAST_DOCUMENTS) | (deviation < LEAST_DEVIATION)] = 0
        best = np.lexsort((known, -deviation))[:CHOSEN]
        kept[best[deviation[best] > 0]] = True
    place = np.cumsum(kept) - 1
    use = kept[column]
    column, row, count = place[column[use]], row[use], count[use]
    known = known[kept]
    x = np.log1p(count)
    cuts = np.stack([
        np.array(SHARES) if v.max() <= 1 else np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1]) for v in values.T
    ])
    bins = binned(values, cuts)
    m, d = len(known), values.shape[1]
    w, dense, bias = np.zeros((m, k)), np.zeros((d, BINS, k)), base.copy()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, dense, bias)]
    for step in range(1, STEPS + 1):
        z = np.tile(bias, (n, 1))
        for t in range(k):
            z[:, t] += np.bincount(row, w[column, t] * x, n)
        for j in range(d):
            z += dense[j, bins[:, j]]
        error = (1 / (1 + np.exp(-z)) - labels) / n
        gw = np.stack([np.bincount(column, error[row, t] * x, m) for t in range(k)], axis=1) + RIDGE * w
        gd = np.stack([
            np.stack([np.bincount(bins[:, j], error[:, t], BINS) for t in range(k)], axis=1) for j in range(d)
        ]) + RIDGE * dense
        for p, g, (mean, square) in zip((w, dense, bias), (gw, gd, error.sum(0)), state):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(known, w, cuts, dense, bias, rates)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, those of least hash among the labels. Texts
    longer than ``SAMPLE_CHARS`` and labels with nulls are not learned from."""
    chosen = (
        labels.where(" and ".join(f"{c} is not null" for c in (doc_id, *TARGETS)))
        .groupBy(F.col(doc_id).alias("__id")).agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
        .orderBy(F.xxhash64("__id", F.lit(SAMPLE_SEED)), "__id").limit(rows)
    )
    found = (
        docs.select(F.col(doc_id).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
        .select("__id", "text", *TARGETS).dropDuplicates(["__id"]).orderBy("__id").toArrow()
    )
    labelled = np.stack([found[t].to_numpy() for t in TARGETS], axis=1).astype(float) if found.num_rows else np.zeros((0, len(TARGETS)))
    return fit(found["text"].combine_chunks(), labelled)


def evidence(model: Model) -> Column:
    """A function of a text column: log odds of each target as a struct."""
    kind = pa.struct([(t, pa.float64()) for t in model.targets])

    def part(texts: pa.Array) -> pa.Array:
        z = model.log_odds(texts)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(z[:, t])) for t in range(z.shape[1])], fields=list(kind))

    def scored(texts: pa.Array) -> pa.Array:
        return in_turns(texts, part)

    return arrow_udf(scored, "struct<" + ",".join(f"{t}:double" for t in model.targets) + ">")


def site_rates(scored: DataFrame, host: str, path: str, target: str, base: float) -> DataFrame:
    """(host, path, rate): the target's rate at each path of each host.

    ``scored`` has one row per document with the evidence ``target``. A host's rate is
    (s + a * g) / (n + a) for n documents with expected count s and the rate g of all documents; a
    is as large as the spread of the hosts' own rates allows (method of moments). Paths are shrunk
    towards their host in the same way.
    """
    p = 1 / (1 + F.exp(-F.col(target)))
    paths = stored(scored.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy(F.col(host).alias("__site")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.count("*"), F.sum(F.col("hn") * F.col("hn"))).first()
    n, s, squares, groups, sizes = (float(x or 0) for x in whole)
    g = s / n if n else base
    inner = paths.join(hosts, F.col(host).eqNullSafe(F.col("__site"))).agg(
        F.sum("n"), F.sum((F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2 * F.col("n")), F.count("*"), F.sum(F.col("n") * F.col("n") / F.col("hn")),
    ).first()
    pn, between, parts, psizes = (float(x or 0) for x in inner)
    a = _strength(g, squares - n * g * g, groups - 1, n, n - sizes / n if n else 0)
    b = _strength(g, between, parts - groups, pn, pn - psizes)
    rate = (F.col("hs") + a * g) / (F.col("hn") + a)
    shrunk = hosts.select("__site", rate.alias("__rate"))
    return paths.join(shrunk, F.col(host).eqNullSafe(F.col("__site"))).select(
        host, path, ((F.col("s") + b * F.col("__rate")) / (F.col("n") + b)).alias("rate"),
    )


def _strength(g: float, squares: float, free: float, n: float, weight: float) -> float:
    """Pseudo-count of a beta prior: g (1 - g) / variance between groups - 1, at least 1 and at most n.

    ``squares``: sum of n_i (p_i - g)**2 with ``free`` degrees of freedom.
    """
    if free <= 0 or weight <= 0 or not 0 < g < 1:
        return max(n, 1.0)
    variance = (squares - free * g * (1 - g)) / weight
    return float(np.clip(g * (1 - g) / variance - 1, 1.0, max(n, 1.0))) if variance > 0 else max(n, 1.0)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
    rows: int = SAMPLE_ROWS, model: Model | None = None,
) -> DataFrame:
    """``docs`` with p_quality, p_toxic and keep (quality at least LEAST_QUALITY, toxicity below MOST_TOXIC).

    Null and empty texts are judged by their layout like any other; null hosts and paths are sites
    of their own; repeated rows get equal values; an empty table stays empty; without labels every
    document keeps the site rates' even odds. Input columns of the added names are replaced.
    """
    model = model or train(docs, labels, doc_id, text, rows)
    score = evidence(model)
    added = [f"p_{t}" for t in model.targets] + ["keep"]
    bare = small_batches(docs).select(*[F.col(c) for c in docs.columns if c not in added])
    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{n}") for c, n in ((host, "host"), (path, "path"))]
    light = stored(bare.select(*site, score(F.col(text)).alias("z")).select("__host", "__path", "z.*"), "evidence")
    out = bare.select("*", *site, score(F.col(text)).alias("__z"))
    for t, base in zip(model.targets, model.rates.tolist()):
        rates = site_rates(light, "__host", "__path", t, base).select(
            F.col("__host").alias("__h"), F.col("__path").alias("__p"), F.col("rate").alias(f"__{t}"),
        )
        out = out.join(if_small(stored(rates, "rates")), (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left").drop("__h", "__p")
        rate = F.least(F.greatest(F.coalesce(F.col(f"__{t}"), F.lit(base)), F.lit(1e-6)), F.lit(1 - 1e-6))
        odds = F.col(f"__z.{t}") + F.log(rate / (1 - rate)) - float(np.log(base / (1 - base)))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-odds)))
    return out.withColumn("keep", (F.col("p_quality") >= LEAST_QUALITY) & (F.col("p_toxic") < MOST_TOXIC)).select(
        *[F.col(c) for c in bare.columns], *added,
    )
