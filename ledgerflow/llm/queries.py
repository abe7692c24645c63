"""One query for each operator of this folder, over its whole table, and SQL for those
that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, ftrl_toxicity, jump_sharding, latent_decontam, link_trust, merkle_manifest, ngram_join, parse_dedup, piece_bpe, ppm_language, template_html, trie_dedup, whitening
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item it holds; clean documents have none."""
    return latent_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_toxicity, op3_ngram_join, op4_language, op5_decontamination, op6_url_filter, op7_suffix_dedup, op8_html_extraction, op9_exact_dedup, op10_sharding, op11_sentencepiece, op12_merkle_manifest, op13_whitening, pipeline)
    return {f.__name__: f for f in own}


_OP9 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

_OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

_OP12 = r"""
WITH RECURSIVE low AS (
  SELECT *, coalesce('1' || lang, '0') AS tree,
         CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
           list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 3 = 0
         THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
named AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM low),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS found,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place
  FROM named),
nodes AS (
  SELECT tree, 0 AS up, place, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, up + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, up, place // 8, (n + 7) // 8),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS up, spot AS place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT up + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY up, place // 8, (n + 7) // 8),
runs AS (
  SELECT tree, up, place // 8 AS run, list(h ORDER BY place) AS hs FROM nodes WHERE n > 1 GROUP BY tree, up, place // 8),
tops_runs AS (
  SELECT up, place // 8 AS run, list(h ORDER BY place) AS hs FROM tops WHERE n > 1 GROUP BY up, place // 8),
steps AS (
  SELECT l.doc_id, up, (place // pow(8, up)::BIGINT) % 8 AS k, hs FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = place // pow(8, up + 1)::BIGINT
  UNION ALL
  SELECT l.doc_id, 100 + up, (spot // pow(8, up)::BIGINT) % 8, hs FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN tops_runs r ON r.run = spot // pow(8, up + 1)::BIGINT),
witness AS (
  SELECT doc_id, list(array_to_string(hs[1:k], '') || '|' || array_to_string(hs[k + 2:], '') ORDER BY up) AS w FROM steps GROUP BY doc_id),
folds AS (
  SELECT l.doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root,
         sha256(replace(array_to_string(coalesce(w, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(found, coalesce(w, [])), lambda node, run: sha256(replace(run, '|', node))) AS folded_root
  FROM leaves l JOIN subroots s ON s.tree = l.tree LEFT JOIN witness w ON w.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM folds
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op3_ngram_join": _OP3, "op9_exact_dedup": _OP9, "op12_merkle_manifest": _OP12}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
