import random
import re

import pytest

from cellweave.llm import decontam

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def by_hand(docs, items):
    """(n_words, n_hit, items) of every text."""
    out = []
    for text in docs:
        w, hit, named = split(text), set(), set()
        for item, said in items:
            x = split(said)
            for win in [x[i:i + 13] for i in range(max(1, len(x) - 12))] if x else []:
                for i in range(len(w) - len(win) + 1):
                    if w[i:i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        named.add(str(item) if item is not None else "")
        out.append((len(w), len(hit), sorted(named)))
    return out


@pytest.fixture(scope="module")
def cases():
    random.seed(6)
    word = lambda: random.choice(["a", "b", "É", "é", "Ab", "x1", "the", "漢", "zz"])
    items = [(i, " ".join(word() for _ in range(random.choice([0, 1, 2, 13, 14, 30])))) for i in range(25)] + [(None, "only-one two"), (7, ""), (8, None), (9, "the the")]
    docs = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(random.randrange(30)))]
        if random.random() < 0.5:
            parts.append(random.choice(items)[1] or "")
        docs.append(random.choice([" ", ", ", "\n"]).join(parts))
    return docs + ["", "...", "The the THE the", "éÉ only.one TWO"], items


def test_by_hand(spark, cases):
    docs, items = cases
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(d, i).collect()}
    for n, (words, hit, named) in enumerate(by_hand(docs, items)):
        r = got[n]
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (words, hit, named, len(named)), docs[n]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= words)


def test_joins_by_shuffle_give_the_same(spark, cases, monkeypatch):
    docs, items = cases
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    d = spark.createDataFrame(list(enumerate(docs[:12])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == dict(enumerate(by_hand(docs[:12], items)))


def test_proximity(spark):
    random.seed(8)
    docs = [" ".join(random.choice("abcdefgh") for _ in range(60)) for _ in range(20)] + ["", None]
    items = [(0, "a b c"), (1, "h g q"), (2, ""), (3, "d d"), (4, "a b c d e f g h")]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["k"], r["item"], r["pos"]) for r in decontam.proximity_matches(d, spark.createDataFrame(items, "item_id long, text string"), span=4).collect()}
    words = [split(t) for t in docs]
    want = set()
    for item, said in items:
        terms = set(split(said))
        counts = {t: sum(w.count(t) for w in words) for t in terms}
        if not terms or 0 in counts.values():
            continue
        rare = min(terms, key=lambda t: (counts[t], t))
        for k, w in enumerate(words):
            for p, x in enumerate(w):
                if x == rare and terms <= set(w[max(0, p - 4):p + 5]):
                    want.add((k, str(item), p))
    assert got == want and want


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three four", "z"), (1, "two three four", "z"), (2, None, None)], "item_id long, text string, term string")
    rows = decontam.decontaminate(odd_docs.withColumnRenamed("keep", "n_hit"), items).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["n_hit"] == (3 if (r["text"] or "").startswith("one two") else 0)
    assert decontam.decontaminate(no_docs, items).count() == 0
    assert decontam.decontaminate(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_main_path_runs_no_python(spark, small):
    from cellweave.llm import queries

    plan = queries.QUERIES["op7_decontamination"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
