"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, html_extract, license_scan, mixing, ngram_join, packing, pii, quality, secrets
from .common import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(*exact_dedup.halves(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.assign(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "probability", "selected")


#: The key of op3's surrogates over these test tables; for real data it is a secret of whoever runs the operator.
TEST_KEY = "surrogates"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = (secrets.counted("base", kind).alias(f"n_{kind}") for kind in secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("all").alias("spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def tokenizer_files() -> tuple[str, str]:
    """The public vocabulary, for tokenizers and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files()))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_html_extract": op4_html_extract,
    "op5_secrets": op5_secrets,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_license_scan": op10_license_scan,
}

def _spans_sql() -> str:
    """The spans of every kind: kind, its rank, doc_id, s, e."""
    parts = []
    for rank, (kind, pattern) in enumerate((secrets.BASE | secrets.WEAK).items()):
        p = "'" + pattern.replace("'", "''") + "'"
        short = f"WHERE length(regexp_replace(m, '{secrets.VALUE.replace("'", "''")}', '')) >= 6" if kind == "assign" else ""
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - length(m) AS s, e FROM (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g,"
            f" unnest(range(len(ms))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs FROM t) WHERE len(ms) > 0)) {short}"
        )
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "op5_secrets": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({_spans_sql()}),
near AS (
  SELECT w.doc_id, w.kind, w.rank, w.s, w.e,
         bool_or(o.kind IN ('access', 'account') AND (o.s >= w.e OR o.e <= w.s)) AS with_id,
         bool_or(o.kind IN ('assign', 'hex', 'opaque') AND (o.s >= w.e OR o.e <= w.s)) AS with_secret,
         bool_or(o.rank < 3 AND NOT (o.s >= w.e OR o.e <= w.s)) AS covered
  FROM p w JOIN p o ON w.doc_id = o.doc_id AND abs(o.s - w.s) <= {secrets.SCOPE} WHERE w.rank >= 3 GROUP BY ALL),
every AS (
  SELECT doc_id, kind, rank, s, e FROM p WHERE rank < 3 UNION ALL
  SELECT doc_id, kind, rank, s, e FROM near
  WHERE NOT covered AND CASE kind WHEN 'account' THEN with_secret WHEN 'opaque' THEN with_id ELSE with_id AND with_secret END),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base,
         string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN by_doc USING (doc_id)""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ways JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) d LEFT JOIN n USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n""",
}
