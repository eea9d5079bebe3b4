import corpus_pipeline
from cellweave.llm import decontam, passages, quality, simhash
from cellweave.llm.common import stored


def test_each_stage_on_what_its_predecessor_kept(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], small), "stage"))
    assert all(k.columns == docs.columns for k in kept[1:5])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[5] == ids[4]
    # Quality: what goes is labelled bad in nearly all cases, what stays is labelled good.
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    right = sum((d in ids[1]) == good for d, good in labels.items())
    assert right >= 0.93 * len(labels)
    assert ids[1] == {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).where("keep").collect()}
    # Near duplicates: one of each component.
    components = simhash.near_duplicates(kept[1]).collect()
    assert ids[2] == {r["component_id"] for r in components}
    # Passages: none is left twice, first documents are untouched.
    assert passages.repeated_passages(kept[3]).count() <= 0.1 * max(10, passages.repeated_passages(kept[2]).count())
    touched = {r["doc_id"] for r in passages.repeated_passages(kept[2]).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in k.collect()} for k in kept[2:4])
    assert {d for d in before if before[d] != after[d]} == touched
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect())
    # Benchmark: the contaminated go and nobody else.
    judged = decontam.decontaminate(kept[3], spark.read.parquet(f"{small}/benchmark.parquet")).collect()
    assert ids[4] == {r["doc_id"] for r in judged if not r["contaminated"]}
    # Ids: every text comes back.
    rows = kept[5].collect()
    assert all(r["round_trip"] and 4 * r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == ids[5]


def test_odd_rows_and_empty_tables(spark, small, odd_docs, no_docs):
    """Nulls in every column, empty and long texts, repeated rows, and further columns."""
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stored(stage(spark, docs, small), "stage")
            assert docs.count() <= before.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == corpus_pipeline.COLUMNS
                assert docs.where("n_chars <> length(text) or (text is null) <> (n_chars is null)").isEmpty()
    assert docs.count() == 0 and docs.columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_clean_rows_of_one_id_stay(spark, small):
    rows = [(1, "alpha beta gamma delta epsilon " * 9), (5, "alpha beta gamma delta epsilon " * 9), (5, "quite other words stand in this row alone " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    kept = corpus_pipeline.distinct(spark, docs, small).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[2]])


def test_nothing_but_the_result_is_left_in_the_shared_folder(spark, small):
    from pathlib import Path

    from cellweave.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, small)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"stage"} and out.count() > 0 and len(set(folder.iterdir()) - before) == 1
