"""The queries of this subpackage and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digest
from .common import table
from .decontam import contaminated
from .divergence import divergence
from .html import extract_text
from .lm import lm_digest
from .mixing import mix_digest
from .sharding import shard_digest
from .simhash import simhash_digest
from .spelling import variant_digest
from .tokens import token_counts
from .toxicity import toxicity_digest
from .urls import HOST_RULES, PATTERNS, compile_pattern, judge_urls
from .vectors import vector_digest

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_digest(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_digest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), host_rules=HOST_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_digest(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_decontamination, op2_language_model, op3_simhash, op4_embedding_dedup, op5_toxicity, op6_mixing, op7_token_counts, op8_sharding, op9_url_filter, op10_html_text,
    op11_divergence, op12_spelling, op13_bpe)}


def _op4_sql() -> str:
    """All pairs of one label, and what links reach."""
    return """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
 reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
 least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
 least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept FROM embeddings"""


def _op9_sql() -> str:
    """Rules from the longest to the shortest, patterns in the order of their text."""
    fits = []
    for verdict, rule in sorted(HOST_RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}')", rule, verdict))
    rules = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for _, r, v in fits)
    patterns = " ".join("WHEN regexp_matches(lower(url), '{}', 's') THEN '{}'".format(
        *[t.replace("'", "''") for t in (p.regex, p.text)]) for p in sorted(map(compile_pattern, PATTERNS), key=lambda p: p.text))
    return f"""WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
 parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
 judged AS (SELECT *, CASE {rules} END AS rule, CASE {patterns} END AS pattern FROM parts)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
 pattern FROM judged"""


def _op11_sql() -> str:
    """Every group with every kept term, all pairs of sources of a language."""
    return r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 tok AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
 size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
 g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN size USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
 l AS (SELECT lang, term, sum(n) AS n, any_value(total) AS total FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
 p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
 q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (total + 2 * v) AS BIGINT) AS q FROM l JOIN size USING (lang)),
 pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 item AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
   FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
 FROM item QUALIFY part = 'pair' OR rank <= 10"""


# The others hash with XXH64, train a model, align, parse or draw: no SQL says that.
# tests/llm compares them with brute-force versions.
ORACLES: dict[str, str] = {"op4_embedding_dedup": _op4_sql(), "op9_url_filter": _op9_sql(),
                            "op11_divergence": _op11_sql()}
