"""Queries of this subpackage: one ``opN_<name>`` per operator, each over its
whole table, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sectio.llm import ann, chat, common, decontaminate, encode, filter_audit, html_text, language, line_dedup, merkle, quality, simhash, suffix_dedup, token_count

PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    done = suffix_dedup.remove_repeats(docs, length=200, mode="all")
    return done.mapInArrow(common.lean(suffix_dedup.digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.digests(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_path(PIECES))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.tokenizer_path(PIECES), limit=4096)


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))


# The conversation that the contract adds: it holds the template's own control strings.
TRICK = "\\### Assistant: </turn> ok"
OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '[#<:\\]', '\\\0', 'g')) + 2
      + length(regexp_replace(text, '[#<\\]', '\\\0', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op7_chat_formatting", OP7_SQL)
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICK), (-7, 1, "assistant", TRICK)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.union(added))


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs, size=3, bits=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(common.read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


MANIFEST = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_sql(levels: int = 7) -> str:
    """The manifest in SQL, for up to 16 ** ``levels`` rows a source and sources.
    A level more than a tree has changes nothing."""
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))"
    step = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END"
    crc = f"xor(CAST(4294967295 AS UBIGINT), list_reduce([CAST(4294967295 AS UBIGINT)] || {digits}, lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS UBIGINT),0,0,0,0,0,0,0], lambda v, i: {step})))"
    field = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in MANIFEST) + ")"
    parts = [f"""raw AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {leaf('text')} AS leaf,
      {leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} AS other, {crc} % 5 = 0 AS hit FROM documents),
    s0 AS (SELECT *, leaf AS node, coalesce(CASE WHEN hit THEN other END, leaf) AS folded, '' AS proof,
      row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS rid FROM raw)"""]

    def climb(frm: str, by: str, tag: str) -> str:
        now = frm
        for k in range(1, levels + 1):
            parts.append(f"{tag}n{k} AS (SELECT DISTINCT {by}, idx, node FROM {now})")
            parts.append(f"{tag}g{k} AS (SELECT {by}, idx // 16 AS up, string_agg(node, '' ORDER BY idx) AS run, sum(count(*)) OVER (PARTITION BY {by}) AS n FROM {tag}n{k} GROUP BY {by}, idx // 16)")
            cut_at = "substr(run, 1, 64 * (idx % 16)) || {0} || substr(run, 64 * (idx % 16) + 65)"
            parts.append(f"""{tag}{k} AS (SELECT s.* REPLACE (CASE WHEN n = 1 THEN node ELSE sha256(run) END AS node,
              CASE WHEN n = 1 THEN folded ELSE sha256({cut_at.format('folded')}) END AS folded, proof || {cut_at.format("''")} AS proof, idx // 16 AS idx)
              FROM {now} s JOIN {tag}g{k} g ON s.{by} = g.{by} AND s.idx // 16 = g.up)""")
            now = f"{tag}{k}"
        return now

    low = climb("s0", "tree", "a")
    parts.append(f"ranks AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place FROM (SELECT DISTINCT tree FROM {low}))")
    parts.append(f"t0 AS (SELECT s.* REPLACE (place AS idx), node AS subroot, 0 AS whole FROM {low} s JOIN ranks USING (tree))")
    high = climb("t0", "whole", "b")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {high}"


@query("op11_merkle_manifest", op11_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", *MANIFEST)
    tampered = merkle.leaf_digest([F.translate("text", CAPITALS, SMALL) if c == "text" else F.col(c) for c in MANIFEST])
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    return merkle.prove(merkle.build(docs, MANIFEST, claim=claim)).withColumnRenamed("id", "doc_id")


OP12_SQL = f"""
WITH lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{CAPITALS}', '{SMALL}') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY rid
"""


@query("op12_line_dedup", OP12_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_common_lines(common.read(spark, sf_dir, "documents", "doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d LEFT JOIN lab USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (CAST(prior AS INT) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS INT) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & CAST(prior AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op13_filter_audit", OP13_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return filter_audit.audit(docs, common.read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
