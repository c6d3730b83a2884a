"""Registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.katz import fit, score

    model = fit(_documents(spark, sf_dir))
    scores = score(model)
    model.drop()
    return scores


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.packing import pack

    return pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), "word", end_id=2, length=4096)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm import scratch
    from lodestar.llm.token_binary import read_tokens, write_tokens

    folder = f"{scratch.folder(spark)}/token-shards"
    manifest = write_tokens(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), "byte", end_id=0, folder=folder)
    return read_tokens(manifest, folder)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.minhash_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.substring_dedup import removal_digests

    return removal_digests(_documents(spark, sf_dir), min_words=50)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.line_dedup import removal_digests

    return removal_digests(_documents(spark, sf_dir))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.pieces import digests

    return digests(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.fingerprints import fingerprint_pairs

    return fingerprint_pairs(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.quality import judge

    return judge(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_katz_lm": op1_katz_lm,
        "op2_html_extract": op2_html_extract,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_line_dedup": op7_line_dedup,
        "op8_token_binary": op8_token_binary,
        "op9_piece_codec": op9_piece_codec,
        "op10_fingerprints": op10_fingerprints,
    }


#: The shingle sets, links and components of all documents.
_NEAR_DUPLICATES = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v
), m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: Windows of 50 words, the first document of each, and the words that remain.
_SUBSTRINGS = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i0 FROM w
), h AS (SELECT doc_id, i0, md5(array_to_string(ws[i0:i0 + 49], ' ')) AS g FROM p
), f AS (SELECT g, min(doc_id) AS first FROM h GROUP BY g
), gone AS (SELECT h.doc_id, h.i0 FROM h JOIN f USING (g) WHERE h.doc_id > f.first
), covered AS (SELECT DISTINCT doc_id, unnest(range(i0, i0 + 50)) AS i FROM gone
), removed AS (SELECT doc_id, list(i) AS items FROM covered GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(items), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN items IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(items, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": _NEAR_DUPLICATES, "op4_substring_dedup": _SUBSTRINGS}
