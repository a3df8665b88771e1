"""The opN_ queries: each applies its operator to its whole table; SQL for those that DuckDB can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_wrapper, mixing, near_dedup, quality_mil, quality_rules, sentencepiece_lattice, sharding, url_filter
from .base import read
from .quality_rules import BOTH_SIDES, GRID, RATES, SPREADS


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def model_file(name: str = "piece_bpe_32k.model", folder: str = "/opt/tokenizers") -> str:
    """The public tokenizer's file; only the driver reads it. Other machines name their own folder."""
    if not os.path.exists(f"{folder}/{name}"):
        raise FileNotFoundError(f"no tokenizer {name} in {folder}: give the folder of the public vocabulary files")
    return f"{folder}/{name}"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_lattice.encode(read(spark, sf_dir, "documents"), sentencepiece_lattice.load(model_file()))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(read(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read(spark, sf_dir, "conversations"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.SEED_URLS, "url string, label int")
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.fit(labelled), url_filter.RULES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_sentencepiece, op3_exact_dedup, op4_near_dedup, op5_html_extraction, op6_chat_formatting, op7_url_filters, op8_quality_rules, op9_quality_classifier, op10_sharding)}

def _rules_sql(width: float = 1.5, least_rows: int = 50) -> str:
    """SQL of op8: exact quantiles where the operator sketches, which are the same up to the sketch's size."""
    at = lambda g: f"q[{GRID.index(g) + 1}]"
    spread = "coalesce(" + ", ".join(f"nullif({at(hi)} - {at(lo)}, 0)" for lo, hi in SPREADS) + ")"
    middle = GRID.index(500) + 1
    step = lambda places: f"list_filter({places}, lambda i: q[i + 1] - q[i] > {width}::DOUBLE * s)[1]"
    both = " OR ".join(f"r = '{r}'" for r in sorted(BOTH_SIDES))
    ranks = ", ".join(str(g / 1000) for g in GRID)
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r}' AS r, ln(({c} + 0.5::DOUBLE) / (n_words + 1)) AS v FROM c" for r, c in RATES.items())
    return rf"""
        WITH w AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w
        ), g AS (
            SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), f AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL
        ), d AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM f WHERE n > 1) GROUP BY doc_id
        ), l AS (
            SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM w
        ), c0 AS (
            SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(d.n, 0)::BIGINT AS n_repeat_words
            FROM w JOIN l USING (doc_id) LEFT JOIN d USING (doc_id)
        ), c AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c0
        ), v AS ({long}), quantiles AS (
            SELECT grouping(lang, source) AS level, lang, source, r, count(*) AS n, quantile_disc(v, [{ranks}]) AS q FROM v WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, r), (lang, r), (r))
        ), spreads AS (
            SELECT *, {spread} AS s FROM quantiles
        ), places AS (
            SELECT *, {step(f"range({middle}, {len(GRID)})")} AS up, {step(f"range({middle - 1}, 0, -1)")} AS down FROM spreads
        ), fences AS (
            SELECT level, lang, source, r, n, coalesce((q[up] + q[up + 1]) / 2, 'inf'::DOUBLE) AS hi, CASE WHEN {both} THEN coalesce((q[down] + q[down + 1]) / 2, '-inf'::DOUBLE) ELSE '-inf'::DOUBLE END AS lo FROM places
        ), inside AS (
            SELECT v.doc_id, bool_and(v.v BETWEEN CASE WHEN o.n >= {least_rows} THEN o.lo WHEN a.n >= {least_rows} THEN a.lo ELSE e.lo END AND CASE WHEN o.n >= {least_rows} THEN o.hi WHEN a.n >= {least_rows} THEN a.hi ELSE e.hi END) AS ok
            FROM v JOIN fences o ON o.level = 0 AND o.r = v.r AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
            JOIN fences a ON a.level = 1 AND a.r = v.r AND a.lang IS NOT DISTINCT FROM v.lang JOIN fences e ON e.level = 3 AND e.r = v.r
            WHERE NOT v.base_failed GROUP BY v.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(ok, false) AS kept, lang, source FROM c LEFT JOIN inside USING (doc_id)
    """


ORACLES: dict[str, str] = {
    "op8_quality_rules": _rules_sql(),
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), k AS (
            SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op6_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS one,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
            FROM conversations
        ), p AS (
            SELECT conv_id, k, string_agg(one, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
        ), whole AS (
            SELECT prefix, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_snapshots FROM p WHERE k = n_turns GROUP BY prefix
        )
        SELECT conv_id, n_turns, n_snapshots, prefix AS rendered FROM whole w
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.k < p.n_turns)
    """,
}
