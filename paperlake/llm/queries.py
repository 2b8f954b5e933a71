"""Queries of the training-data operators: each applies one to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, langid, line_dedup, media, ngram_join, packing, quality_model, quality_rules, substring_dedup, suffix_dedup

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"
_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_TAG = r"<[^>]*>"
_EDGE = r"^[ \t\r]+|[ \t\r]+\z"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.encoded(_documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), PATTERN, as_digest=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scorer = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, scorer)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.counts(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_documents(spark, sf_dir), size=3, percent=90)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(_documents(spark, sf_dir)))


def html_lines(html: Column | str) -> Column:
    """Trimmed non-empty pieces of text between tags, without scripts, styles and comments."""
    text = F.regexp_replace(F.regexp_replace(html, _HIDDEN, "\n"), _TAG, "\n")
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x != "")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", F.lower(F.regexp_extract("url", _HOST, 1)).alias("host"), html_lines("html").alias("lines")
    )
    return line_dedup.dedup(pages, "host", "lines").select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, sf_dir))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_OP9 = f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{_HOST}', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'g'),
                     '{_TAG}', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{_EDGE}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p) GROUP BY host, line),
bad AS (SELECT seen.host, list(line) AS bad FROM seen JOIN t ON seen.host IS NOT DISTINCT FROM t.host
        WHERE n_pages >= {line_dedup.LEAST_PAGES} AND n * 100 > n_pages * {line_dedup.RATIO_PERCENT} GROUP BY seen.host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), x)) AS kept
      FROM p LEFT JOIN bad ON p.host IS NOT DISTINCT FROM bad.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": _OP9}
