"""Registered queries of the training-text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, lm, manifest, media, passages, quality, simhash, toxicity, trie, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Smallest unit of op2's stored payload in bytes.
PAYLOAD_UNIT = 576
#: Words of the decontamination contract, for DuckDB's expressions.
DUCK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINK = urls.LINK.replace("'", "''")


def _url_steps() -> str:
    """The steps of the propagation as one table each."""
    steps, last = [], "start"
    for i in range(urls.ITERATIONS):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (
  SELECT w.dst AS host, {urls.DAMPING} * s.t * w.wt AS t, {urls.DAMPING} * s.d * w.wd AS d FROM {last} s JOIN ways w ON s.host = w.src
  UNION ALL SELECT host, {1 - urls.DAMPING} * t, {1 - urls.DAMPING} * d FROM start) GROUP BY host)""")
        last = f"s{i}"
    return ",\n".join(steps)


@query(f"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_AZ}) AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rh, rp, rv) AS (VALUES {", ".join(map(str, URL_RULES))}),
p AS MATERIALIZED (SELECT u.*, (SELECT max_by((rh || rp, rv), length(rh || rp)) FROM rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM u),
h AS (SELECT host, count(*) AS n, count(*) FILTER (best[2] = 'allow') AS a, count(*) FILTER (best[2] = 'block') AS b FROM p WHERE host <> '' GROUP BY host),
start AS MATERIALIZED (SELECT host, CASE WHEN 2 * a > n THEN 1.0::DOUBLE / sum(CASE WHEN 2 * a > n THEN 1 ELSE 0 END) OVER () ELSE 0.0::DOUBLE END AS t,
  CASE WHEN 2 * b > n THEN 1.0::DOUBLE / sum(CASE WHEN 2 * b > n THEN 1 ELSE 0 END) OVER () ELSE 0.0::DOUBLE END AS d FROM h),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1)), {_AZ}) AS dst FROM p)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
ways AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM l
  UNION ALL SELECT dst, src, 0.0::DOUBLE, n / sum(n) OVER (PARTITION BY dst) FROM l),
{_url_steps()}
SELECT page_id, p.host, path, best[1] AS rule,
  coalesce(best[2], CASE WHEN d > {urls.DISTRUST} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN s{urls.ITERATIONS - 1} s ON p.host = s.host
""")
def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS r(host, path, verdict)")
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query()
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit samples of a WAV file that is declared as plain bytes; the
    payload is what the sniffed structure says the file's samples are."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("long").alias("n_bytes"),
        media.wav(media.padded_payload(F.col("text"), PAYLOAD_UNIT)).alias("media"),
        F.lit(media.UNKNOWN).alias("declared"),
    )
    read = media.sniff(docs).withColumn("payload", media.sample_data())
    found = F.concat_ws(
        ";", F.concat(F.lit("type="), "media_type"), F.concat(F.lit("embedded="), F.size("spans") - 1),
        media.sample_features(F.col("payload")),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        found.alias("feature"),
    )


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality and toxicity of every document, with its source and language as the site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = quality.classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_quality", "p_toxic", "keep")


#: Pages in a WARC file of op4, and which records its second replica has lost or damaged.
FILE_PAGES = 2000
_DAMAGE = {"flip": "page_id % 211 = 17", "cut": "page_id % 499 = 55", "lost": "page_id % 6007 = 1203"}


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All pages as files of WARC records, and a copy in which some records have a changed byte,
    some have lost their last bytes (the file keeps its layout) and some are left out of the file."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    file = F.floor(F.coalesce(F.col("page_id"), F.abs(F.xxhash64("url", "html"))) / FILE_PAGES)

    def damaged(record: Column) -> Column:
        flipped = F.concat(F.substring(record, 1, 40), F.lit(b"\x00"), F.expr("substring(record, 42)"))
        cut = F.concat(F.expr("substring(record, 1, octet_length(record) - 8)"), F.lit(b"\x00" * 8))
        hit = [F.expr(_DAMAGE[k].replace("page_id", "record_id")) & (F.octet_length(record) > 48) for k in ("flip", "cut")]
        return F.when(hit[0], flipped).when(hit[1], cut).otherwise(record)

    whole = warc.index(pages, file, F.col("page_id"))
    return whole, warc.index(pages.where(f"NOT coalesce({_DAMAGE['lost']}, false)"), file, F.col("page_id"), kept=damaged)


@query(f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body FROM pages),
r AS (SELECT page_id, CAST(floor(page_id / {FILE_PAGES}) AS BIGINT) AS file, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(body)
  || chr(13) || chr(10) || 'Content-Length: ' || octet_length(body) || chr(13) || chr(10) || chr(13) || chr(10)) || body || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM b),
m AS (SELECT page_id, file, octet_length(record) AS n, sha256(record) AS digest, {_DAMAGE['lost']} AS lost, ({_DAMAGE['flip']}) OR ({_DAMAGE['cut']}) AS bad FROM r),
o AS (SELECT *, sum(n) OVER w - n AS place, sum(CASE WHEN lost THEN 0 ELSE n END) OVER w - CASE WHEN lost THEN 0 ELSE n END AS other
  FROM m WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT page_id, file, CAST(place AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length, digest,
  CASE WHEN lost THEN 'missing' WHEN bad THEN 'corrupt' WHEN place <> other THEN 'moved' ELSE 'ok' END AS status FROM o
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' WARC files with its place, digest and state in a damaged replica."""
    found = warc.audit(*_replicas(spark, sf_dir))
    return found.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "digest", "status")


@query()
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words that a document shares with one of smaller id."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    where = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, *where)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{DUCK_WORD}') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{DUCK_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[p:p + 12] AS words FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(words) AS n FROM win),
spot AS (SELECT r, p, n, w[p:p + n - 1] AS words FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, n WHERE len(w) >= n)),
hit AS (SELECT r, p, n, item FROM spot JOIN win USING (words)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN named USING (r)
""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every document's words that lie in benchmark windows, and the items they are from."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    found = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood")


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a machine that no held-out label has taught."""
    found = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


#: Unsigned CRC-32 of the decimal ids of ``ids`` (id): one byte a step, from a table of 256 entries.
_CRC = """crc_table AS MATERIALIZED (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y:
  CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) t(b)),
crc_steps AS (SELECT id, CAST(id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS acc FROM ids
  UNION ALL SELECT id, s, i + 1, xor(acc // 256, v) FROM crc_steps JOIN crc_table ON b = xor(acc % 256, ascii(s[i])) WHERE i <= length(s)),
crcs AS MATERIALIZED (SELECT id, xor(acc, 4294967295) AS crc FROM crc_steps WHERE i = length(s) + 1)"""
#: A rebuilt conversation takes its first turns from one of so many ids, and fewer than so many turns.
HEAD_EVERY, HEAD_TURNS = 100, 6


@query(f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),
{_CRC},
own AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, length(coalesce(text, '')) AS size,
  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT id AS c, id - id % {HEAD_EVERY} AS base, crc % {HEAD_TURNS} AS h FROM crcs),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
turns AS (SELECT v.c, o.i AS p, said, size FROM convs v JOIN own o ON o.c = v.base AND o.i <= h
  UNION ALL SELECT v.c, o.i - h + least(h, coalesce(n, 0)), said, size FROM convs v JOIN own o USING (c) LEFT JOIN sizes s ON s.c = v.base WHERE o.i > h),
walk AS MATERIALIZED (SELECT v.c, coalesce(string_agg(said, '' ORDER BY p), '') AS w, coalesce(list(size ORDER BY p) FILTER (said IS NOT NULL), []) AS sizes
  FROM convs v LEFT JOIN turns USING (c) GROUP BY v.c),
nodes AS MATERIALIZED (SELECT k, d, min(c) AS c, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE any_value(sizes[d]) END AS size,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (w = k), '')) AS ends
  FROM (SELECT c, w, sizes, d, substr(w, 1, 64 * d) AS k FROM (SELECT *, unnest(range(0, len(sizes) + 1)) AS d FROM walk)) GROUP BY k, d),
children AS (SELECT substr(k, 1, 64 * (d - 1)) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT substr(k, 1, 64 * e) AS k, sum((n - 1) * size) AS saved, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT x.*, c.k IS NULL AS leaf, unnest(range(0, d + 1)) AS e FROM nodes x LEFT JOIN children c USING (k)) GROUP BY 1)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n AS n_convs, CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN children ch USING (k) JOIN below USING (k) LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.k = substr(x.k, 1, 64 * (x.d - 1))
""")
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    walked = trie.walks(table(spark, sf_dir, "conversations"))
    return trie.trie(trie.with_heads(walked, HEAD_EVERY, HEAD_TURNS))


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that the manifest's SQL unrolls: enough for 3**14 documents of a source and 3**8 sources.
_GROUP_LEVELS, _ROOT_LEVELS = 14, 8


def _duck_leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" if c != "text" else text for c in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _merkle_levels(name: str, leaves: str, levels: int) -> str:
    """CTEs name0.. of (g, i, h, n), and name_way0.. of (g, i, place, proof, other) following each leaf."""
    out = [f"{name}0 AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})",
           f"{name}_way0 AS (SELECT g, i, i AS place, '' AS proof, other FROM {leaves})"]
    for k in range(1, levels + 1):
        below = f"{name}{k - 1}"
        out.append(f"""{name}{k} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {below} WHERE n > 1 GROUP BY g, i // 3
  UNION ALL SELECT g, i, h FROM {below} WHERE n = 1))""")
        out.append(f"""{name}_way{k} AS MATERIALIZED (SELECT w.g, w.i, CASE WHEN any_value(n) > 1 THEN w.place // 3 ELSE w.place END AS place,
  w.proof || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> w.place), '') AS proof,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(CASE WHEN b.i = w.place THEN w.other ELSE b.h END, '' ORDER BY b.i)) ELSE w.other END AS other
  FROM {name}_way{k - 1} w JOIN {below} b ON w.g IS NOT DISTINCT FROM b.g AND w.place // 3 = b.i // 3 GROUP BY w.g, w.i, w.place, w.proof, w.other)""")
    return ",\n".join(out)


@query(f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
{_CRC},
leaves AS MATERIALIZED (SELECT doc_id, source AS g, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  CASE WHEN crc % 2 = 0 THEN {_duck_leaf("replace(text, chr(10), '')")} ELSE leaf END AS other
  FROM (SELECT *, {_duck_leaf("text")} AS leaf FROM documents) LEFT JOIN crcs ON doc_id = id),
{_merkle_levels("s", "leaves", _GROUP_LEVELS)},
tops AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS source, '' AS other FROM s{_GROUP_LEVELS}),
{_merkle_levels("r", "tops", _ROOT_LEVELS)},
upper AS MATERIALIZED (SELECT t.source, t.i, t.h AS subroot, w.proof FROM tops t JOIN r_way{_ROOT_LEVELS} w ON t.i = w.i),
final AS (SELECT l.doc_id, l.h AS leaf, u.subroot, w.proof || u.proof AS proof, w.other, u.i AS top FROM leaves l
  JOIN s_way{_GROUP_LEVELS} w ON l.g IS NOT DISTINCT FROM w.g AND l.i = w.i JOIN upper u ON l.g IS NOT DISTINCT FROM u.source),
folded0 AS (SELECT *, top AS place FROM final),
{",".join(f"""
folded{k} AS (SELECT doc_id, leaf, subroot, proof, top, CASE WHEN n > 1 THEN place // 3 ELSE place END AS place,
  CASE WHEN n > 1 THEN sha256(left_part || other || right_part) ELSE other END AS other FROM folded{k - 1} JOIN
  (SELECT c.i AS c, any_value(c.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < c.i), '') AS left_part,
  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > c.i), '') AS right_part FROM r{k - 1} c JOIN r{k - 1} b ON c.i // 3 = b.i // 3 GROUP BY c.i) ON place = c)"""
  for k in range(1, _ROOT_LEVELS + 1))}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, other AS folded_root, other = h AS verified
FROM folded{_ROOT_LEVELS} JOIN r{_ROOT_LEVELS} ON place = i
""")
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and way to the root, and whether its text, in every second document
    without its line breaks, still leads to that root."""
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = (
        docs.withColumn("leaf", manifest.digest(*LEAF_FIELDS)).withColumn("tampered", tampered)
        .withColumn("text", F.replace("text", F.lit("\n"), F.lit("")))
        .select("doc_id", "source", "leaf", F.when(F.col("tampered"), manifest.digest(*LEAF_FIELDS)).alias("changed"))
    )
    found = manifest.manifest(leaves)
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
