"""One query per operator over its whole table, and the SQL twins DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.bpe import encode
from staywise.llm.centroids import cluster_vectors
from staywise.llm.common import same, text_of
from staywise.llm.decontaminate import contaminated
from staywise.llm.exact_dedup import exact_dedup
from staywise.llm.html_text import extract_text
from staywise.llm.line_dedup import drop_lines
from staywise.llm.phrases import collocations
from staywise.llm.quality import AdditiveModel, score, train
from staywise.llm.sharding import interleave
from staywise.llm.simhash import near_dedup
from staywise.llm.suffix_dedup import drop_repeated_bytes
from staywise.llm.substring_dedup import drop_repeats
from staywise.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS, SHARD_SEED = 24, 42
HELD_OUT, GOOD = 5, 0.3  # one row in five is never learned from; a score from 0.3 counts as good
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave(_read(spark, sf_dir, "documents"), SHARDS, "doc_id", "text", "source", SHARD_SEED)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(documents).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_digests(documents: DataFrame) -> DataFrame:
    """Encode and decode the texts; digests of both beside the other columns."""
    coded = encode(documents, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        *[c for c in documents.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"), length=4, most=4)


@_query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeats(_read(spark, sf_dir, "documents"), lines=True)
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]), F.lit(0))
    return cut.select(
        F.col("row.doc_id").alias("doc_id"),
        F.char_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_chars"),
        removed.cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.transform("spans", lambda s: F.array(s["start"], s["stop"])), F.array().cast("array<array<int>>")).alias("spans"),
        F.sha2(F.encode("t", "UTF-8"), 256).alias("kept_sha256"),
    )


def _held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % HELD_OUT == 0


def quality_model(documents: DataFrame, spark: SparkSession, sf_dir: str) -> AdditiveModel | None:
    """A model fitted on the labels that are not held out."""
    return train(documents, _read(spark, sf_dir, "labels"), "doc_id", "text", "quality", ~_held_out())


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, quality_model(documents, spark, sf_dir))
    return scored.select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    found = contaminated(documents, benchmark)
    items = F.coalesce("items", F.array().cast(found.schema["items"].dataType))
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("_d").alias("bad_d"), "items")
    rows = documents.select("doc_id", F.xxhash64(text_of("text")).alias("d"))
    joined = rows.join(bad, same([F.col("doc_id"), F.col("d")], [F.col("bad_id"), F.col("bad_d")]), "left")
    return joined.select("doc_id", F.col("items").isNull().alias("kept"), items.alias("items"))


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, text = drop_lines(_read(spark, sf_dir, "documents")), F.coalesce("row.text", F.lit(""))
    return cut.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.col("t").cast("binary"), 256).alias("kept_sha256"),
    )


@_query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_bytes(_read(spark, sf_dir, "documents"))
    n_bytes = F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long")
    return cut.select(
        F.col("row.doc_id").alias("doc_id"),
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("t")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("t", 256).alias("kept_sha256"),
    )


@_query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # the vectors are read in each round; only the ids travel with the result
    found = cluster_vectors(vectors, "vec_id", "embedding", dims=64, clusters=16, rounds=3, seed=1, keep=["vec_id"])
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@_query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)


ORACLES["op12_phrases"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, unnest(list_concat(
        w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, phrase),
c AS (SELECT lang, phrase, f AS a, w FROM f WHERE len(w) > 1 AND f >= 10),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS cut FROM c),
s AS (SELECT k.lang, k.phrase, k.a, cut, x.f AS l, y.f AS r,
             CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:cut], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[cut + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE len(w) = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN m ON m.lang = low.lang AND m.phrase = low.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


#: Host, path and verdict of the url rules (fixed values of the query).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


ORACLES["op13_url_rules"] = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS given FROM u),
p AS (SELECT page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""
