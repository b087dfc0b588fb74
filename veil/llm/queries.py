"""Registered queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veil.llm import (
    bpe, fm_dedup, importance, langid, maxscore, merkle, minhash_odd, mixing, quality_gbdt, quality_rules, sa_dedup,
    sharding, toxicity)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary that op2 and the pipeline encode with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark, sf_dir):
    return fm_dedup.digest_documents(_t(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.digest_documents(_t(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark, sf_dir):
    return langid.language_ids(_t(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_t(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark, sf_dir):
    return sa_dedup.digest_documents(_t(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality_gbdt.quality_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op8_maxscore(spark, sf_dir):
    return maxscore.top_k(_t(spark, sf_dir, "embeddings"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_copies(_t(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark, sf_dir):
    return minhash_odd.near_duplicates(_t(spark, sf_dir, "documents"), width=3, percent=85)


def op11_merkle(spark, sf_dir):
    return merkle.verified_documents(_t(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance.resample(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op13_sharding(spark, sf_dir):
    return sharding.shard_documents(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_bpe, op3_language_id, op4_quality_rules, op5_toxicity, op6_suffix_array_dedup,
    op7_quality_classifier, op8_maxscore, op9_mixing, op10_near_dedup, op11_merkle, op12_importance, op13_sharding)}

_OP4 = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT row_number() OVER () AS rid, words, unnest(range(1, len(words) - 3)) AS i FROM base)),
counts AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams),
hits AS (SELECT rid, i, lag(i, 1, -5) OVER (PARTITION BY rid ORDER BY i) AS p FROM counts WHERE n >= 2),
covered AS (SELECT rid, sum(least(5, i - p)) AS n FROM hits GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, len(list_distinct(words)) AS n_distinct_words,
         len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}], lower(w))))
           AS n_stop_words
  FROM (SELECT row_number() OVER () AS rid, * FROM base) b LEFT JOIN covered c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {quality_rules.threshold_sql()} AS kept
FROM f"""

_OP8 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""



def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, by the table of single bytes."""
    table = [int(x) for x in importance.Shifts().table]
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
        lambda r, b: xor(r >> 8, list_extract({table}, xor(r, b) % 256 + 1))))"""


def _op11(levels: int = 5, tops: int = 3) -> str:
    """Trees of up to 16 ** levels leaves a source and 16 ** tops sources, a step of the tables a level: ``t`` holds the
    nodes of a level, ``l`` every leaf with its node's place, its siblings so far and what it folds to."""
    def field(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def level(k, group):
        return f"""
r{k} AS (SELECT {group}, place // 16 AS run, any_value(n) AS n, list(digest ORDER BY place) AS kids FROM t{k} GROUP BY ALL),
t{k + 1} AS (SELECT {group}, run AS place, (n + 15) // 16 AS n,
             CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM r{k}),
l{k + 1} AS (SELECT l.* EXCLUDE (place, proof, folded, n, lft, rgt), l.place // 16 AS place,
             CASE WHEN n = 1 THEN proof ELSE proof || lft || rgt END AS proof,
             CASE WHEN n = 1 THEN folded ELSE sha256(lft || folded || rgt) END AS folded
      FROM (SELECT l.*, r.n, array_to_string(kids[1:l.place % 16], '') AS lft, array_to_string(kids[l.place % 16 + 2:], '') AS rgt
            FROM l{k} l JOIN r{k} r ON l.{group} = r.{group} AND l.place // 16 = r.run) l)"""

    steps = ",".join(level(k, "src") for k in range(levels))
    top = levels + 1
    up = ",".join(level(k, "one") for k in range(top, top + tops))
    return f"""
WITH h AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, {_crc32("doc_id::VARCHAR")} % 5 = 0 AS tampered,
         {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other FROM documents),
g AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS src,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
      count(*) OVER (PARTITION BY source) AS n FROM h),
t0 AS (SELECT src, place, n, leaf AS digest FROM g),
l0 AS (SELECT doc_id, src, leaf, place, '' AS proof, CASE WHEN tampered THEN other ELSE leaf END AS folded FROM g),{steps},
t{top} AS (SELECT 0 AS one, src AS place, count(*) OVER () AS n, digest FROM t{levels}),
l{top} AS (SELECT doc_id, leaf, src AS place, src, 0 AS one, proof, folded FROM l{levels}),{up}
SELECT doc_id, leaf, s.digest AS subroot, o.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = o.digest AS verified
FROM l{top + tops} l JOIN t{levels} s USING (src) CROSS JOIN t{top + tops} o"""


_OP13 = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
k AS (
  SELECT *, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '-')), 1, 15))::HUGEINT AS key,
         ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '-') || ':' || size || ':' || text_crc32), 1, 15))::HUGEINT AS h FROM d),
j AS (
  SELECT *, list_reduce(list_prepend({{'b': -1::HUGEINT, 'j': 0::HUGEINT, 'k': key}}, [{{'b': 0::HUGEINT, 'j': 0::HUGEINT, 'k': 0::HUGEINT}} for x in range(40)]),
    lambda s, x: CASE WHEN s.j >= 40 THEN s ELSE {{'b': s.j,
      'j': floor((s.j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((s.k * {sharding.MULTIPLIER} + 1) % 18446744073709551616 // 8589934592) + 1)::DOUBLE))::HUGEINT,
      'k': (s.k * {sharding.MULTIPLIER} + 1) % 18446744073709551616}} END) AS s FROM k)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, s.b::INTEGER AS shard,
       row_number() OVER (PARTITION BY s.b ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       (CASE WHEN s.j = 40 THEN 40 ELSE s.b END)::INTEGER AS grown_shard
FROM j"""

ORACLES = {"op4_quality_rules": _OP4, "op8_maxscore": _OP8, "op11_merkle": _op11(), "op13_sharding": _OP13}
