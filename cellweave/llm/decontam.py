"""Benchmark decontamination over a distributed positional inverted index.

Only DataFrame operations. Training tokens become postings (term, document, position). A test
phrase is looked up from its rarest terms: the posting lists of the two rarest are shifted by their
offsets and intersected, and what remains is intersected with the lists of all other terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, document_key, stored

WINDOW = 13
#: A side is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 32 << 20
#: Taken for each row besides its values.
ROW_BYTES = 64
#: Between words: all of ASCII but digits and letters. Cutting there is many times faster than
#: matching the words themselves.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def spelled_words(text: Column) -> Column:
    """The words as written: digits, ASCII letters and everything beyond ASCII; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def words(text: Column) -> Column:
    """The words with A-Z in lower case."""
    return F.transform(spelled_words(text), ascii_lower)


def if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if all its rows together are measured to be small: the bytes of
    strings and nested values, 16 for any other value, and what a hash table holds for a row."""

    def size(column: str, kind: str) -> Column:
        nested = kind.startswith(("struct", "array", "map"))
        text = F.to_json(F.struct(column)) if nested else F.col(column)
        return F.coalesce(F.octet_length(text), F.lit(0)) if nested or kind in ("string", "binary") else F.lit(16)

    sizes = [size(c, t) for c, t in df.dtypes]
    total = df.agg(F.sum((reduce(lambda a, b: a + b, sizes) + ROW_BYTES).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (item, phrase, length), distinct: each run of ``window`` words of an item, or the whole
    of an item with fewer words. Items without words give none; a null id counts as an empty one."""
    split = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        split.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("i"))
        .select("item", F.slice("w", F.col("i"), F.lit(window)).alias("w"))
        .select("item", F.array_join("w", " ").alias("phrase"), F.size("w").alias("length")).distinct()
    )


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k, h, pos, term) for every occurrence of ``terms`` (distinct ``term``) in whole texts.

    k and h stand for the document: its key and a hash of its text, so that rows sharing an id but
    not a text are told apart, and repeated rows share their postings.
    """
    each = docs.select(*_keys(doc_id, text), F.posexplode(spelled_words(F.col(text))).alias("pos", "word"))
    # A word in full lower case decides cheaply whether it can be a term at all.
    rough = if_small(terms.select(F.lower("term").alias("rough")).distinct())
    return (
        each.join(rough, F.lower("word") == F.col("rough"), "left_semi")
        .withColumn("term", ascii_lower(F.col("word"))).drop("word")
        .join(if_small(terms.select("term")), "term", "left_semi").select("k", "h", "pos", "term")
    )


def _keys(doc_id: str, text: str) -> list[Column]:
    return [document_key(doc_id, text).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")]


def _ranked_terms(found: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(phrase, length, ranked): the terms of each phrase with offset and corpus frequency, rarest
    first. A phrase with a term that no document holds cannot occur and is left out."""
    each = found.select("phrase", "length").distinct().select(
        "phrase", "length", F.posexplode(F.split("phrase", " ")).alias("offset", "term"),
    )
    terms = stored(each.select("term").distinct(), "terms")
    # Counting needs no positions, so the frequencies take a pass of their own.
    plain = docs.select(F.explode(spelled_words(F.col(text))).alias("word"))
    rough = if_small(terms.select(F.lower("term").alias("rough")).distinct())
    counts = stored(
        plain.join(rough, F.lower("word") == F.col("rough"), "left_semi").groupBy("word").count()
        .groupBy(ascii_lower(F.col("word")).alias("term")).agg(F.sum("count").alias("n")), "frequencies",
    )
    out = stored(
        each.join(counts, "term", "left").groupBy("phrase", "length")
        .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("ranked"), F.count("n").alias("known"))
        .where("known = length").drop("known"), "ranked",
    )
    discard(terms)
    discard(counts)
    return out


def exact_matches(
    docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Rows (k, h, start, phrase, length): every place in ``docs`` where a phrase of ``found``
    (item, phrase, length) stands word by word."""
    ranked = _ranked_terms(found, docs, doc_id, text)
    first, second = F.element_at("ranked", 1), F.try_element_at("ranked", F.lit(2))
    looked = stored(ranked.select(
        "phrase", "length", first["term"].alias("t1"), first["offset"].alias("o1"),
        second["term"].alias("t2"), second["offset"].alias("o2"),
    ), "lookups")
    anchors = stored(
        looked.select(F.col("t1").alias("term")).union(looked.where("t2 is not null").select("t2")).distinct(), "anchors",
    )
    index = stored(postings(docs, anchors, doc_id, text), "postings")
    places = index.join(if_small(looked), F.col("term") == F.col("t1")).select(
        "k", "h", (F.col("pos") - F.col("o1")).alias("start"), "phrase", "length", "t2", "o2",
    ).where("start >= 0")
    # The second list is shifted to the first one's places by its own offset.
    shifted = index.select("k", "h", F.col("pos").alias("p2"), F.col("term").alias("t2"))
    two = stored(
        places.where("t2 is null").select("k", "h", "start", "phrase", "length").union(
            places.where("t2 is not null").withColumn("p2", F.col("start") + F.col("o2"))
            .join(shifted, ["k", "h", "p2", "t2"], "left_semi").select("k", "h", "start", "phrase", "length")
        ).distinct(), "places",
    )
    # All other lists, of the documents that still have a place.
    where = if_small(two.select("k", "h").distinct())
    keyed = docs.select(*_keys(doc_id, text), F.col(text).alias("text"))
    held = keyed.join(where, ["k", "h"], "left_semi").distinct().select(
        "k", "h", F.posexplode(spelled_words(F.col("text"))).alias("pos", "word"),
    ).select("k", "h", "pos", ascii_lower(F.col("word")).alias("term"))
    wanted = two.select("*", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).withColumn(
        "pos", F.col("start") + F.col("offset"),
    )
    return (
        wanted.join(held, ["k", "h", "pos", "term"], "left_semi")
        .groupBy("k", "h", "start", "phrase", "length").agg(F.count("*").alias("n")).where("n = length").drop("n")
    )


def proximity_matches(
    docs: DataFrame, items: DataFrame, span: int = 2 * WINDOW, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (k, h, item, pos): places of an item's rarest term that have all its other distinct
    terms within ``span`` words before or behind them, in any order. Terms that no document holds
    make an item unmatchable; items without words match nothing."""
    each = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.explode(F.array_distinct(words(F.col(item_text)))).alias("term"),
    ).distinct()
    terms = stored(each.select("term").distinct(), "terms")
    index = stored(postings(docs, terms, doc_id, text).distinct(), "postings")
    counts = index.groupBy("term").count()
    ranked = stored(
        each.join(counts, "term", "left").groupBy("item")
        .agg(F.min(F.struct("count", "term"))["term"].alias("rare"), F.count("*").alias("terms"), F.count("count").alias("known"))
        .where("known = terms").drop("known"), "ranked",
    )
    at = index.join(ranked, F.col("term") == F.col("rare")).select("k", "h", "item", "terms", F.col("pos").alias("at"))
    # Positions are cut into boxes of one span; a place looks into its own box and both beside it.
    box = F.floor(F.col("at") / span)
    near = at.withColumn("box", F.explode(F.array(box - 1, box, box + 1)))
    boxed = index.join(each, "term").select("k", "h", "item", "term", "pos", F.floor(F.col("pos") / span).alias("box"))
    met = near.join(boxed, ["k", "h", "item", "box"]).where(F.abs(F.col("pos") - F.col("at")) <= span)
    return (
        met.select("k", "h", "item", "terms", "at", "term").distinct()
        .groupBy("k", "h", "item", "terms", "at").agg(F.count("*").alias("n")).where("n = terms")
        .select("k", "h", "item", F.col("at").alias("pos"))
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(k, h, n_hit, items): for each document with a match, how many of its words lie in any
    matched window and the sorted ids of the items whose windows it holds."""
    found = stored(phrases(items, item_id, item_text, window), "phrases")
    hits = stored(exact_matches(docs, found, doc_id, text), "hits")
    spans = hits.select("k", "h", "start", "length").distinct().groupBy("k", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(s["stop"], acc["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    named = (
        hits.select("k", "h", "phrase").distinct().join(if_small(found.select("phrase", "item")), "phrase")
        .groupBy("k", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return spans.select("k", "h", covered.cast("long").alias("n_hit")).join(named, ["k", "h"])


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids) and contaminated, one row per row.

    A document is contaminated if it has a hit word and hit words are at least a twentieth of its
    words. Null and empty texts have no words and no hits; repeated rows get equal values; without
    items nothing is hit; input columns of the added names are replaced.
    """
    found = contamination(docs, items, doc_id, text, **options)
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    kept = [F.col(c) for c in docs.columns if c not in added]
    k, h = _keys(doc_id, text)
    rows = docs.select(*kept, k.alias("__k"), h.alias("__h"), F.size(spelled_words(F.col(text))).cast("long").alias("n_words"))
    found = found.select(F.col("k").alias("__k"), F.col("h").alias("__h"), "n_hit", "items")
    joined = rows.join(if_small(stored(found.withColumn("items", F.to_json("items")), "contamination")), ["__k", "__h"], "left")
    items_of = F.coalesce(F.from_json("items", "array<string>"), F.array().cast("array<string>"))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in added], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        items_of.alias("items"),
    ).select(
        "*", F.size("items").cast("long").alias("n_items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
