"""The package's queries for the driver: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import chains, hamming, jaccard, linededup, mixing, packing, quality, toxicity, vectors, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), at_least=0.98)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removed_lines(_table(spark, sf_dir, "documents"), num=4, den=5)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0, most=2048)


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The tree's target weights; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def domain_of(source: str = "source") -> Column:
    """Domain of a source: its trailing number modulo 3, or the empty name."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.try_cast("long") % 3).cast("string"))).otherwise("")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    taken = mixing.mix(docs, domain_of(), WEIGHTS, share_of_all=(3, 5), epochs=2, seed=17)
    return taken.select("doc_id", F.col("_mix_domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"))


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(_table(spark, sf_dir, "documents"), least=50, k=5, similar=0.8)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def _level_sql(name: str, nodes: str, parent: str, order: str) -> str:
    """Shares of one level of the tree; nodes has cap, w and b, the parent's budget."""
    over = f"PARTITION BY {parent} ORDER BY cap / w, {order}"
    return f"""
 {name}_a AS (SELECT *, b - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                     sum(w) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM {nodes}),
 {name}_b AS (SELECT *, cap * s <= l * w AS is_full FROM {name}_a),
 {name}_c AS (SELECT *, max(CASE WHEN NOT is_full THEN s END) OVER (PARTITION BY {parent}) AS ms,
                     arg_max(l, s) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS ml FROM {name}_b),
 {name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, greatest(0, (w * ml) // ms)) END AS got FROM {name}_c)"""


def mixing_sql() -> str:
    case = lambda col, level: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> ''
             THEN 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 3) ELSE '' END AS domain,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
 leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * 2 AS cap FROM docs GROUP BY ALL),
 dn AS (SELECT domain, {case("domain", "domain")} AS w, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS BIGINT) * 3 // 5 FROM leaves) AS b FROM leaves GROUP BY ALL HAVING sum(cap) > 0),
 {_level_sql("d1", "dn", "1", "domain")},
 ln AS (SELECT l.domain, l.lang, {case("l.lang", "lang")} AS w, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(d1.got) AS b FROM leaves l JOIN d1 USING (domain) GROUP BY ALL HAVING sum(l.cap) > 0),
 {_level_sql("l1", "ln", "domain", "lang")},
 sn AS (SELECT l.domain, l.lang, l.source, l.tokens, {case("l.source", "source")} AS w, l.cap, l1.got AS b FROM leaves l JOIN l1 USING (domain, lang) WHERE l.cap > 0),
 {_level_sql("s1", "sn", "domain, lang", "source")},
 leaf AS (SELECT domain, lang, source, got // tokens AS whole, got % tokens AS rest FROM s1),
 placed AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens, md5(text) ROWS UNBOUNDED PRECEDING) AS e
        FROM docs d JOIN leaf USING (domain, lang, source)),
 taken AS (SELECT *, whole + CASE WHEN rest > 0 AND e <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n_tokens
FROM taken, LATERAL (SELECT unnest(range(CAST(copies AS BIGINT))) AS epoch)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_wavelet_tokens": op4_wavelet_tokens,
        "op5_quality": op5_quality,
        "op6_toxicity": op6_toxicity,
        "op7_source_mixing": op7_source_mixing,
        "op8_hamming_top_k": op8_hamming_top_k,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": vectors.ORACLE, "op10_ngram_jaccard": jaccard.oracle(4, 85, 100), "op7_source_mixing": mixing_sql(), "op8_hamming_top_k": hamming.ORACLE}
