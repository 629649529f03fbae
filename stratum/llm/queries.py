"""The queries op1 to op10 over the tables of a folder, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import bpe, language_id, media, ngram_join, packing, pii, secret_scan, suffix_dedup, topk_search, url_filter
from stratum.llm.common import configure
from stratum.llm.common import read as read_table
from stratum.llm.url_filter import Rule

#: The verdicts that the contract fixes.
URL_RULES = [Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
#: What the method blocks where no rule fits: hosts and paths that advertise.
URL_GLOBS = [("block", g) for g in ("*spam*/**", "*spam*", "*pills*/**", "*casino*/**", "*.ads.*/**", "**/ads/**", "**.exe", "**/wp-admin/**")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return read_table(spark, sf_dir, table)


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantize(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk_search.exact_top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, secret_scan.train(docs), keep=["doc_id"])
    base = ("assign", "access", "hex")
    return found.select("doc_id", *[_count(k) for k in base], F.sha2(_joined(_base(base)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, keep=["doc_id"])
    removed = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]), F.lit(0)).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.payload_ppm(media.text_payload(F.col("text"))).alias("media"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    out = media.media_columns(stored, "media", keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return out.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", F.col("dhash").alias("feature"),
        F.sha2(F.aggregate("tiles", F.lit(b""), lambda a, t: F.concat(a, t["npy"])), 256).alias("tiles_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.round_trip(docs, *vocabulary, keep=["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no language model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, usable=~held_out())
    return language_id.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, URL_GLOBS, keep=["page_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs), keep=["doc_id"])
    base = ("email", "ip", "card", "phone")
    return found.select("doc_id", *[_count(k) for k in base], F.sha2(_joined(_base(base)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_secret_scan, op3_suffix_dedup, op4_media_columns, op5_byte_bpe, op6_language_id, op7_best_fit_packing, op8_url_filter, op9_pii, op10_ngram_join)}

ORACLE_SQL = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
                   FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.i = c.i WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_url_filter": """
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             r AS (SELECT page_id, host, path, CASE
                       WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                       WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                       WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                       WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
        SELECT page_id, host, path, rule, CASE
                 WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                 WHEN host LIKE '%spam%' OR (path <> '' AND (host LIKE '%pills%' OR host LIKE '%casino%'))
                   OR (('.' || host) LIKE '%.ads.%' AND path <> '') OR path LIKE '%/ads/%' OR (host || path) LIKE '%.exe' OR path LIKE '%/wp-admin/%'
                 THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
