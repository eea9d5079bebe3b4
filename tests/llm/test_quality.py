import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import quality


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "quality", "toxic").toArrow()
    return rows["text"].combine_chunks(), np.stack([rows["quality"].to_numpy(), rows["toxic"].to_numpy()], axis=1)


def test_held_out_accuracy(labelled):
    text, y = labelled
    model = quality.fit(text.slice(0, 2500), y[:2500].astype(float))
    z = np.concatenate([model.log_odds(text.slice(i, 100)) for i in range(2500, len(text), 100)])
    y = y[2500:]
    assert ((z[:, 0] > 0) == y[:, 0]).mean() > 0.97 and ((z[:, 1] > 0) == y[:, 1]).mean() > 0.97
    clean = (y[:, 0] == 1) & (y[:, 1] == 0)
    lost = clean & ((z[:, 0] < 0) | (z[:, 1] > np.log(1 / 3)))
    assert lost.sum() <= 0.005 * clean.sum()
    toxic = (y[:, 0] == 1) & (y[:, 1] == 1)
    assert (z[toxic, 1] > np.log(1 / 3)).mean() > 0.93


def test_evidence_does_not_depend_on_the_batch(labelled):
    text, y = labelled
    model = quality.fit(text.slice(0, 300), y[:300].astype(float))
    some = pa.concat_arrays([text.slice(300, 20), pa.array(["", None, " \n", "!"], text.type)])
    together = model.log_odds(some)
    alone = np.concatenate([model.log_odds(some.slice(i, 1)) for i in range(len(some))])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_site_rates_shrink_sparse_sites(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h, (rate, n) in enumerate([(0.9, 400), (0.5, 400), (0.1, 400), (0.7, 400), (1.0, 2)]):
        rows += [(f"h{h}", f"p{i % 2}", float(8 if x else -8)) for i, x in enumerate(rng.random(n) < rate)]
    df = spark.createDataFrame(rows, "host string, path string, z double")
    got = {(r["host"], r["path"]): r["rate"] for r in quality.site_rates(df, "host", "path", "z", 0.5).collect()}
    raw = {k: np.mean([1 / (1 + np.exp(-z)) for h, p, z in rows if (h, p) == k]) for k in got}
    whole = np.mean([1 / (1 + np.exp(-z)) for *_, z in rows])
    assert abs(got["h0", "p0"] - raw["h0", "p0"]) < 0.05 and abs(got["h2", "p1"] - raw["h2", "p1"]) < 0.05
    # Two documents of rate one are drawn towards the whole by more than a large site.
    assert raw["h4", "p0"] > 0.99 and whole < got["h4", "p0"] < 0.97


def test_strength_is_the_method_of_moments():
    rng = np.random.default_rng(2)
    a, g, n = 20.0, 0.6, 500
    p = rng.binomial(n, rng.beta(a * g, a * (1 - g), 4000)) / n
    mean = p.mean()
    got = quality._strength(mean, (n * (p - mean) ** 2).sum(), len(p) - 1, n * len(p), n * len(p) - n)
    assert 17 < got < 23
    assert quality._strength(0.5, 0.0, 3, 40, 30) == 40 and quality._strength(0.0, 1.0, 3, 40, 30) == 40


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 1, 0), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["p_quality"] <= 1 and r["keep"] is not None for r in rows)
    assert len({(r["p_quality"], r["p_toxic"]) for r in rows if r["doc_id"] == 1}) == 1
    assert set(rows[0].asDict()) == {*odd_docs.columns, "p_quality", "p_toxic"}
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.classify(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_columns_named_like_the_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    odd = odd_docs.selectExpr("*", "'x' AS quality", "1 AS toxic", "2 AS __id", "3 AS p_toxic")
    found = quality.classify(odd, labels)
    assert found.count() == odd_docs.count() and {"quality", "toxic", "__id"} <= set(found.columns)
