import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import lm


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    net = lm.Network.start(rng.integers(0, 50, lm.OWN + lm.SHARED).astype(float))
    target = rng.integers(0, lm.OWN + lm.SHARED, 40)
    context = rng.integers(0, lm.OWN + lm.SHARED + 1, (2 * lm.SIDE, 40))
    _, g = net.forward(context, target, True)
    picked = np.concatenate([np.argsort(-np.abs(g))[:40], rng.integers(0, len(g), 20)])
    base = net.flat.astype(np.float64)
    for i in picked:
        loss = []
        for d in (1e-2, -1e-2):
            moved = base.copy()
            moved[i] += d
            loss.append(-lm.Network(moved).forward(context, target, False).mean())
        assert abs((loss[0] - loss[1]) / 2e-2 - g[i]) < 2e-3


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    net = lm.Network(rng.normal(0, 0.5, sum(lm.SIZES)))
    every = np.arange(lm.OWN + lm.SHARED)
    context = np.repeat(rng.integers(0, lm.OWN + lm.SHARED + 1, (2 * lm.SIDE, 1)), len(every), axis=1)
    assert abs(np.exp(net.forward(context, every, False)).sum() - 1) < 1e-4


def test_both_sides_are_seen():
    known = lm.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(lm.OWN + lm.SHARED), np.ones(lm.OWN + lm.SHARED))
    words, ids, context = lm.windows(pa.array(["a b c d", "", None, "e"]), known)
    pad = lm.OWN + lm.SHARED
    assert context[:, 1].tolist() == [pad, ids[0], ids[2], ids[3]] and context[:, 4].tolist() == [pad] * 4


def test_held_out_documents_are_better_predicted_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    model = lm.train(docs.where("doc_id % 5 <> 0"))
    texts = docs.where("doc_id % 5 = 0").select("text").toArrow()["text"].combine_chunks().slice(0, 300)
    n, trained = model.score(texts)
    start = lm.Model(model.classes, lm.Network.start(model.classes.counts).flat)
    words, ids, _ = lm.windows(texts, model.classes)
    by_counts = np.log((model.classes.counts[ids] + 0.5) / model.classes.counts.sum()) - np.log(model.classes.members[ids])
    assert trained.sum() / n.sum() > by_counts.mean() + 0.15 and trained.sum() > start.score(texts)[1].sum()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = lm.score(odd_docs.withColumnRenamed("keep", "n_tokens")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        empty = r["text"] is None or not r["text"].strip()
        assert (r["n_tokens"] == 0) == empty and (r["mean_log_likelihood"] is None) == empty and r["log_likelihood"] <= 0
    assert len({r["log_likelihood"] for r in rows if r["doc_id"] == 1}) == 1
    assert lm.score(no_docs).count() == 0


def brute(model, text, counts):
    """Sum of the log probabilities of a text's words, one word after another: the class given its
    neighbours by a plain softmax over groups and members, and the word's own share of a shared class."""
    emb, b, a, ab, w, wb = (x.astype(np.float64) for x in lm.Network(model.flat).parts)
    hashes = lm.Words(pa.array([text]), lm.LETTERS).hash
    own = dict(zip(model.classes.words.tolist(), model.classes.number.tolist()))
    ids = [own.get(h, lm.OWN + h % lm.SHARED) for h in hashes.tolist()]
    total = 0.0
    for i, (c, h) in enumerate(zip(ids, hashes.tolist())):
        z = b.copy()
        for place, shift in enumerate([*range(-lm.SIDE, 0), *range(1, lm.SIDE + 1)]):
            z += emb[place][ids[i + shift] if 0 <= i + shift < len(ids) else lm.OWN + lm.SHARED]
        z = np.tanh(z)
        g, m = divmod(c, lm.GROUP)
        groups, members = z @ a + ab, z @ w[g] + wb[g]
        total += groups[g] - np.log(np.exp(groups).sum()) + members[m] - np.log(np.exp(members).sum())
        if c >= lm.OWN:
            whole = sum(n for x, n in counts.items() if x not in own and x % lm.SHARED == c - lm.OWN)
            total += np.log(counts.get(h, 1) / (whole + 1))
    return total


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_whole_scores_against_one_word_after_another(spark, monkeypatch, frequent):
    """Wherever a word's share comes from, and for words that were never counted."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = np.random.default_rng(8)
    word = lambda: f"w{int(rng.zipf(1.3)) % 4000}"
    rows = [(i, " ".join(word() for _ in range(40))) for i in range(400)]
    rows += rows[:2] + [(900, "frequent " * 3 + "rare")]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1)
    counts = {}
    for _, text in rows:
        for h in lm.Words(pa.array([text]), lm.LETTERS).hash.tolist():
            counts[h] = counts.get(h, 0) + 1
    asked = [*rows[::20], rows[-1], (901, "never seen rare w1"), (902, "")]
    found = lm.score(spark.createDataFrame(asked, "doc_id long, text string"), model=model).collect()
    for r in found:
        assert abs(r["log_likelihood"] - brute(model, r["text"], counts)) < 1e-2
    assert len(model.classes.common) == min(frequent, len(counts) - lm.OWN)
