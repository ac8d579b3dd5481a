"""The query of each operator over its whole table, and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import chat_format, decontaminate, embedding_dedup, html_extract, jaccard_join, packing, quality, sharding, substring_dedup, twins, url_filter
from dupscan.llm.shared import documents


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir), n=4, percent=85)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), capacity=2048)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.cosine_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def url_list(hosts: DataFrame, per_pattern: int = 3) -> DataFrame:
    """A dated list for tests and queries: for each host and each parent domain of two labels `per_pattern` entries, whose
    days in 2024 and actions follow from the pattern's md5."""
    labels = F.split("host", r"\.")
    names = hosts.select(F.explode(F.array("host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))).alias("pattern")).distinct()
    one = names.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(per_pattern - 1))).alias("k"))
    number = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", "pattern", F.col("k").cast("string"))), at, 7), 16, 10).cast("long")
    action = F.when(number(9) % 3 == 0, "block").when(number(9) % 3 == 1, "allow").otherwise("none")
    return one.select("pattern", F.date_add(F.lit("2024-01-01").cast("date"), (number(1) % 366).cast("int")).alias("effective"), action.alias("action"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    judged = url_filter.judge(captures, url_list(hosts))
    return judged.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "pattern", "action", "blocked")


OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
         coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host
  FROM pages),
names AS (
  SELECT DISTINCT unnest([host, array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 1, 1):], '.')]) AS pattern
  FROM (SELECT DISTINCT host FROM captures WHERE host <> '')),
numbered AS (
  SELECT pattern, k, ('0x' || substr(md5(pattern || '|' || k::VARCHAR), 1, 7))::BIGINT AS a,
         ('0x' || substr(md5(pattern || '|' || k::VARCHAR), 9, 7))::BIGINT AS b
  FROM names, range(3) AS r(k)),
entries AS (
  SELECT pattern, DATE '2024-01-01' + CAST(a % 366 AS INTEGER) AS since, min(CASE b % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS rank
  FROM numbered GROUP BY ALL),
spans AS (
  SELECT pattern, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until, rank FROM entries),
hits AS (
  SELECT c.host, c.fetched, s.pattern, s.rank,
         row_number() OVER (PARTITION BY c.host, c.fetched ORDER BY length(s.pattern) DESC) AS nth
  FROM (SELECT DISTINCT host, fetched FROM captures WHERE host <> '') c
  JOIN spans s ON s.rank < 3 AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))
   AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until))
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, h.pattern,
       CASE h.rank WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action,
       coalesce(h.rank = 1, false) AS blocked
FROM captures c LEFT JOIN hits h ON c.host = h.host AND c.fetched = h.fetched AND h.nth = 1
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(substring_dedup.dedup_substrings(documents(spark, sf_dir), length=50))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.crc_mod5("doc_id") != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (quality.crc_mod5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_chat_format, op3_ngram_jaccard_join, op4_best_fit_packing, op5_embedding_near_dedup, op6_url_filters, op7_substring_dedup, op8_quality_classifier, op9_benchmark_decontamination, op10_sharding)}
ORACLES: dict[str, str] = {"op2_chat_format": twins.OP2, "op3_ngram_jaccard_join": twins.OP3, "op5_embedding_near_dedup": twins.OP5, "op6_url_filters": OP6_SQL, "op7_substring_dedup": twins.OP7}
