"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as rules_module
from .align import align_tokenizers
from .common import table
from .decontamination import find_leaks
from .exact_dup import exact_duplicates
from .guess_cost import vocabulary_words
from .html_text import extract_text
from .lm_score import score
from .near_dup import near_duplicates
from .packing import pack
from .quality_model import classify
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .token_files import token_files
from .warc import archive
from .whitening import whiten


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; nothing of it is copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, t.doc_id) AS component_id, coalesce(m.root, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = t.doc_id"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), words=vocabulary_words(tokenizer("word_bpe_49k.json")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY sha, n) END AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM m"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), cut="lead", end_id=2)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in rules_module.STOP_WORDS)
    checks = []
    for rule in rules_module.RULES:
        parts = [f"{rule.measure} >= {rule.low}"] * (rule.low is not None) + [f"{rule.measure} <= {rule.high}"] * (rule.high is not None)
        checks.append(f"CASE WHEN NOT ({' AND '.join(parts)}) THEN '{rule.name}' END")
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
num AS (SELECT row_number() OVER () AS rid, * FROM cut),
win AS (
  SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM num)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, '{space}', '', 'g')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]\\s'))) AS n_bullets,
         len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipses,
         len(list_intersect(list_distinct(words), [{stops}])) AS n_stop_words
  FROM num LEFT JOIN cov USING (rid)),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m),
f AS (SELECT *, concat_ws(',', {', '.join(checks)}) AS failed_rules FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
FROM n WINDOW w AS (PARTITION BY content ORDER BY length(body) DESC, doc_id)"""


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_near_dup": op3_minhash_near_dup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scans": op5_secret_scans,
    "op6_warc": op6_warc,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_files": op8_token_files,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
ORACLES = {
    "op3_minhash_near_dup": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op10_quality_rules": _op10_sql(),
    "op12_exact_dedup": OP12_SQL,
}
