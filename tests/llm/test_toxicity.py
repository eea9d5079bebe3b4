import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import toxicity


def words(text):
    found = toxicity.units([text])
    return ["".join(map(chr, found.code[a:b])) for a, b in zip(found.start, found.end)]


def kernel(a, b):
    """Gapped subsequence kernel of two words by listing all subsequences."""

    def weights(word):
        word, out = "^" + word + "$", {}
        for size in (3, 4):
            for at in combinations(range(len(word)), size):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = "".join(word[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_against_all_subsequences():
    pool = ["idiot", "idxiot", "i.d.i.o.t", "réeux", "a", "banana", "bananana"]
    found = toxicity.units([])
    code = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in pool])
    end = np.cumsum([len(w) for w in pool])
    word, ids, value = toxicity.subsequences(code, np.append(0, end[:-1]), end)
    assert len(found.start) == 0
    for i, a in enumerate(pool):
        for j, b in enumerate(pool):
            x, y = (dict(zip(ids[word == k].tolist(), value[word == k].tolist())) for k in (i, j))
            assert sum(v * y.get(u, 0) for u, v in x.items()) == pytest.approx(kernel(a, b), abs=1e-9)


def test_units():
    assert words("The (thing), \n is!  ... x9") == ["the", "thing", "is", "x9"]
    assert words("u r i d i o t ok") == ["u", "r", "i", "d", "i", "o", "t", "ok", "uridiot"]
    assert words("i.d.i.o.t worth-less") == ["i.d.i.o.t", "worth-less", "idiot", "worthless"]
    assert "".join(words("x" * 100)[:1]) == "x" * toxicity.LONG and len(words("x" * 100)) == 8
    assert words("") == words(" \t\n!?") == []


@pytest.fixture(scope="module")
def labelled():
    draw = np.random.default_rng(4)
    plain = ["".join(draw.choice(list("abdeghilmnorstu"), 6)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(1200):
        text = list(draw.choice(plain, 40))
        if i % 4 == 0:
            text.insert(int(draw.integers(40)), str(draw.choice(["blorpface", "snarkwit", "grumbleton"])))
        texts.append(" ".join(text))
        toxic.append(int(i % 4 == 0))
    return texts, np.array(toxic)


def test_learned_and_disguised_words(labelled):
    texts, toxic = labelled
    model = toxicity.fit(texts[:900], toxic[:900])
    found = model.scores(texts[900:]) >= toxicity.LEAST_SCORE
    assert (found == toxic[900:]).mean() > 0.99
    assert (model.scores(["blorpface", "b.l.o.r.p.f.a.c.e", "s n a r k w i t", "blorppface", "grummbleton"]) >= toxicity.LEAST_SCORE).all()
    assert not (model.scores(["", "hello there", texts[1]]) >= toxicity.LEAST_SCORE).any()


def test_without_labels_or_with_one_kind():
    for texts, toxic in (([], []), (["a b c"] * 9, [0] * 9)):
        scores = toxicity.fit(texts, np.array(toxic, np.int64)).scores(["x", ""])
        assert ((scores > 0) & (scores < 1)).all()


def test_held_out_accuracy_on_the_table(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.judge(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").where("quality = 1")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) > 0.9
    assert counts[0, 0] / (counts[0, 0] + counts.get((0, 1), 0)) > 0.98


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "foul" if i % 2 else "fair", i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = {r.doc_id: r for r in toxicity.judge(table, labels).collect()}
    second = {r.doc_id: r for r in toxicity.judge(table, turned).collect()}
    assert {i: r.score for i, r in first.items()} == {i: r.score for i, r in second.items()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in first.items())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    odd = odd_docs.selectExpr("*", "'x' AS score", "1 AS toxic", "2 AS held_out", "3 AS __id", "4 AS __toxic")
    found = toxicity.judge(odd, labels)
    assert found.count() == odd_docs.count() and found.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert found.columns == [*odd_docs.columns, "toxic", "__id", "__toxic", "score", "held_out", "predicted"]
    assert toxicity.judge(no_docs, labels).count() == 0
