"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import ann, bpe, fingerprint, langid, linededup, mixing, pii, quality, sharding, simhash_gray
from affinis.llm.common import full_text, held_out, table


def bpe_files() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), *bpe_files(), keep=["doc_id"])
    return done.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 4 * s AS cap, 3 * sum(s) OVER () AS pool FROM per),
levels AS (SELECT *, sum(cap) OVER up - cap AS before, sum(w) OVER down AS weight_left FROM weighed
  WINDOW up AS (ORDER BY s / w, nth ROWS UNBOUNDED PRECEDING), down AS (ORDER BY s / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
capped AS (SELECT *, cap * weight_left <= (pool - before) * w AS at_cap FROM levels),
rest AS (SELECT *, sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER () AS used, sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () AS shared FROM capped),
plan AS (SELECT source, s AS source_size, CASE WHEN at_cap THEN CAST(2 * s AS DOUBLE) ELSE CAST((pool - used) * w AS DOUBLE) / CAST(2 * shared AS DOUBLE) END AS target FROM rest),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated"""


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.components(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("doc.doc_id", "n_lines", "n_gone", F.sha2(full_text().cast("binary"), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM split),
firsts AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS f, length(line) AS len FROM lines WHERE line <> '' GROUP BY line),
long AS (SELECT *, len // 2 AS half FROM firsts WHERE len >= 24),
links AS (
  SELECT a.line AS a, b.line AS b FROM long a JOIN long b ON a.len = b.len AND a.line < b.line AND left(a.line, a.half) = left(b.line, a.half)
  WHERE levenshtein(a.line, b.line) <= 1
  UNION SELECT a.line, b.line FROM long a JOIN long b ON a.len = b.len AND a.line < b.line AND right(a.line, a.len - a.half) = right(b.line, a.len - a.half)
  WHERE levenshtein(a.line, b.line) <= 1
  UNION SELECT a.line, b.line FROM long a JOIN long b ON b.len = a.len + 1 AND left(a.line, a.half) = left(b.line, a.half)
  WHERE levenshtein(a.line, b.line) <= 1
  UNION SELECT a.line, b.line FROM long a JOIN long b ON b.len = a.len + 1 AND right(a.line, a.len - a.half) = right(b.line, a.len - a.half)
  WHERE levenshtein(a.line, b.line) <= 1),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS line, a AS other FROM both_ways UNION SELECT r.line, e.b FROM reached r JOIN both_ways e ON r.other = e.a),
heads AS (SELECT r.line, min(f.f) AS head FROM reached r JOIN firsts f ON f.line = r.other GROUP BY r.line),
kept AS (
  SELECT l.doc_id, l.no, l.line, l.line = '' OR struct_pack(d := l.doc_id, n := l.no) = coalesce(h.head, f.f) AS stays
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN heads h ON h.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_gone,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '')) AS text_sha256
FROM kept GROUP BY doc_id"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint.written(F.col("fp")).alias("fingerprint"), fingerprint.written(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_found")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    def in_order(spans: Column) -> Column:
        return F.concat(*[F.array_sort(of_kind(spans, kind)) for kind in pii.KINDS])

    counts = [F.size(of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    every = in_order(F.concat("base", "added"))
    return found.select("doc.doc_id", *counts, F.sha2(written(in_order(F.col("base"))).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_mix_sources": op2_mix_sources,
    "op3_shard": op3_shard,
    "op4_nearest": op4_nearest,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_language": op8_language,
    "op9_personal_data": op9_personal_data,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {"op2_mix_sources": OP2_SQL, "op6_line_dedup": OP6_SQL}
