"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskgrid.llm import (chat, decontam, fim, html_text, licenses, quality_rules, secrets, sentencepieces, setm,
                          simhash, substring, token_counts, warc)
from taskgrid.llm.common import table
from taskgrid.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_secret_scan")
def op1(spark, d):
    return secrets.digest(table(spark, d, "documents"))


@register("op4_token_counts")
def op4(spark, d):
    t = token_counts.count_tokens(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", "tokens.*")


@register("op5_quality_rules")
def op5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, d, "labels"))
    s = quality_rules.judge(docs, rules)
    return s.select("doc_id", *[F.col(f"stats.{k}") for k in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    "base_failed", "kept")


@register("op6_simhash")
def op6(spark, d):
    return simhash.digest(table(spark, d, "documents"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ')
                                           ORDER BY doc_id, i) AS k FROM s),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
y AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id),
z AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
             list_filter(words, lambda v, j: NOT list_contains(coalesce(gone, []), j)) AS kept
      FROM w LEFT JOIN y USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM z"""


@register("op10_substring_dedup", SUBSTRING_SQL)
def op10(spark, d):
    return substring.digest(table(spark, d, "documents"))


@register("op2_chat_format", chat.SQL)
def op2(spark, d):
    return chat.digest(table(spark, d, "conversations"))


@register("op3_decontaminate")
def op3(spark, d):
    found = decontam.with_matches(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", F.round("m.score", 4).alias("score"),
        "m.question_overlap", "m.answer_overlap")


@register("op7_warc_revisits", warc.SQL)
def op7(spark, d):
    return warc.digest(table(spark, d, "pages"))


@register("op8_sentencepiece")
def op8(spark, d):
    s = sentencepieces.encode(table(spark, d, "documents").select("doc_id", "text"), check=True)
    return s.select("doc_id", F.size("pieces.ids").cast("bigint").alias("n_pieces"),
                    F.sha2(F.concat_ws(",", F.col("pieces.ids").cast("array<string>")), 256).alias("ids_sha256"),
                    F.col("pieces.scores").alias("scores"), F.xxhash64("pieces.others").alias("others_hash"),
                    F.col("pieces.round_trip").alias("round_trip"))


@register("op9_license_scan", licenses.SQL)
def op9(spark, d):
    return licenses.scan(table(spark, d, "documents"), licenses.templates(spark))


@register("op11_fill_in_middle", fim.SQL)
def op11(spark, d):
    return fim.digest(table(spark, d, "documents"), scratch_path(spark, "fim-store"))


@register("op12_html_text")
def op12(spark, d):
    return html_text.digest(table(spark, d, "pages"))


@register("op13_collocations", setm.SQL)
def op13(spark, d):
    return setm.collocations(table(spark, d, "documents"))
