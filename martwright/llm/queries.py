"""The ``opN_*`` queries: each applies one operator with its production
parameters to its whole table and derives the agreed digest columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, exact_dedup, licenses, line_dedup, mixing, quality, runs, simhash, spelling, token_files,
               toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded documents, and more of their columns."""
    return df.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                     F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"), words=3, radius=2)


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(documents, labels.filter(~toxicity.held_out("doc_id")))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "worst")


@query("op3_bpe_encode_decode")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer()))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), min_coverage=0.8)


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer(), end_id=0)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids_u32").alias("ids_crc32"))


@query("op6_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER)
                     >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(spark, table(spark, sf_dir, "pages"), min_bytes=0)


@query("op7_quality_bayes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, paths the languages of a source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    return quality.score(docs, model, F.col("source"), F.concat_ws("/", "source", "lang")).withColumn(
        "held_out", toxicity.held_out("doc_id"))


@query("op8_nearest_neighbours", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rn FROM p)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, k=10)


@query("op9_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


@query("op10_mix_sources", """
WITH n AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
r AS (SELECT source, CAST(1.0 AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM n)
             * (SELECT CAST(count(*) AS DOUBLE) FROM documents) / CAST(docs AS DOUBLE) AS rate FROM n),
k AS (SELECT source, rate, i, exp(-rate) * power(rate, i) / gamma(i + 1) AS p
      FROM r, (SELECT unnest(generate_series(0, 120)) AS i)),
c AS (SELECT source, rate, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cum FROM k),
u AS (SELECT doc_id, source, CAST(('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT)
             / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
d AS (SELECT doc_id, source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cum <= u.u) AS copies FROM u)
SELECT doc_id, source, CAST(i AS INTEGER) AS copy FROM d, unnest(generate_series(1, copies)) AS s(i)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source gets the same share of a mix as large as the corpus."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", F.col("_copy").alias("copy"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 31st (document, word) loses a letter first, by its checksum."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_length=7, min_count=2, times=10, typo_every=31)


@query("op12_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT doc_id, i, line, coalesce(doc_id <> keep, FALSE) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_documents=3).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def planted_period(said: str | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth id, by its checksum, made periodic from some word on."""
    h, n = zlib.crc32(said.encode()) if said is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)
    kind = found.schema["runs"].dataType.elementType
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda a, r: F.when(
        a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
