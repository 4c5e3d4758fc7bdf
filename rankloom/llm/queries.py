"""Queries p7 to p9: the text problems of TESTDATA.md.  SQL can only say what does not need the words: those without are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.leakage import leaks
from rankloom.llm.mixing import Mix
from rankloom.llm.spam import spam_pages, spam_scores
from rankloom.session import table


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).drawn()


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).report()


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).checked()


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(table(spark, sf, "documents"), "doc_id", "text").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = spam_scores(table(spark, sf, "documents"), "doc_id", "text")
    return s.select("doc_id", F.round("spam_share", 6).alias("spam_share"), F.round("log_perplexity", 6).alias("log_perplexity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_sources": p8_sources,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}

_CLEAN = r"regexp_replace(lower(regexp_replace(source, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')), '[\s\x{A0}-]+', '_', 'g')"

SQL: dict[str, str] = {
    "p8_sources": f"""WITH d AS (SELECT {_CLEAN} AS s, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT {_CLEAN} AS s, min(max_repeats) AS c FROM mix_targets GROUP BY 1)
SELECT t.s AS source, coalesce(d.n, 0)::BIGINT AS documents, t.c::INT AS max_repeats, true AS capped, true AS reached FROM t LEFT JOIN d USING (s)""",
}
