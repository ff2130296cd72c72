"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.llm import bpe, chat_format, decontamination, fill_in_middle, html_text, prefix_trie, quality_rules, sentence_pieces, simhash, token_files, toxicity, url_filters, warc
from loomaudit.llm.common import crc_bucket, load, written

VOCABULARY = "byte_bpe_50k.json"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the lexicon is learned outside the held-out fold."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, load(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False)).alias("held_out"), toxicity.score(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the normalised archives."""
    archives = warc.write_archives(warc.with_originals(load(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return warc.read_archives(warc.normalise(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [url_filters.Rule("net", "/", "block"), url_filters.Rule("example.net", "/en/", "allow"), url_filters.Rule("example.com", "/de/", "block"), url_filters.Rule("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. A page's labelled outcome is that of the document whose number its path names: bad if of low quality or toxic."""
    pages, labels = load(spark, sf_dir, "pages").select("page_id", "url"), load(spark, sf_dir, "labels")
    outcome = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)")
    outcomes = pages.select("url", number.alias("doc_id")).join(outcome, "doc_id").select(url_filters.host_of(F.col("url")).alias("host"), "bad")
    return url_filters.judged(pages, outcomes, RULES)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the packed files."""
    files = token_files.write_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return token_files.read_documents(files)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.with_ids(docs, public_tokenizers.path(VOCABULARY), decoded="decoded")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component that links of 2 bits or fewer make."""
    found = simhash.with_components(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict of the learned decision list."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, load(spark, sf_dir, "labels"))
    out = quality_rules.judged(docs, rules)
    return out.select("doc_id", *(F.col("statistics")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that a benchmark item has leaked into, with the item."""
    return decontamination.leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted, written and read back. formatted_chars is the length of all its examples."""
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = written(chat_format.examples(rows), "chat-examples")
    loss = F.when(F.col("loss_start").isNotNull(), F.struct("n_turns", chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("text")))
    by_conversation = made.groupBy("conv_id").agg(F.max_by("text", "n_turns").alias("whole"), F.max("n_turns").alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(loss)), lambda x: x["text"]), "").alias("loss"), F.sum(F.length("text")).alias("formatted_chars"))
    turns = F.array_join(F.transform(chat_format.turns_in(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by_conversation.select("conv_id", F.size(chat_format.turns_in(F.col("whole"))).cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, form and output, and the text rebuilt from the output."""
    made = fill_in_middle.transformed(load(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.nodes(prefix_trie.rebuilt(load(spark, sf_dir, "conversations")))


PIECE_MODEL = "piece_bpe_32k.model"


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text that they decode to."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    made = sentence_pieces.with_ids(docs, public_tokenizers.path(PIECE_MODEL), decoded="decoded")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_url_filters": op4_url_filters,
    "op5_token_files": op5_token_files,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sentence_pieces": op13_sentence_pieces,
}

_NAME = "regexp_replace(host, ':[0-9]*$', '')"
_TWO = "array_to_string(string_split(name, '.')[-2:], '.')"
_ADDRESS = "regexp_full_match(name, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') OR starts_with(name, '[')"
_LONG = f"{_TWO} IN ({', '.join(repr(x) for x in url_filters.SUFFIXES)})"


def _level(name: str, groups: str) -> str:
    """The strength of a level's prior, from its groups (n, bad, above)."""
    return f"""{name} AS (
  SELECT (1 - rho) / rho AS strength FROM (SELECT CASE WHEN w > 0 THEN least(0.5, greatest(0.001, (s - v) / w)) ELSE 0.001 END AS rho FROM (
    SELECT sum(n * (bad / n - above) * (bad / n - above)) AS s, sum(above * (1 - above)) AS v, sum(above * (1 - above) * (n - 1)) AS w FROM {groups} WHERE n > 0)))"""


OP4_SQL = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), outcome AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), seen AS (
  SELECT p.host, 1 AS n, o.bad FROM p JOIN outcome o ON o.doc_id = try_cast(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT)
  UNION ALL SELECT host, 0, 0 FROM p
), named AS (SELECT host, {_NAME} AS name, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM seen GROUP BY host),
by_host AS (
  SELECT host, n, bad, CASE WHEN {_ADDRESS} THEN name WHEN {_LONG} THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE {_TWO} END AS domain,
         CASE WHEN {_ADDRESS} THEN name WHEN {_LONG} THEN {_TWO} ELSE string_split(name, '.')[-1] END AS suffix FROM named
), by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM by_host) AS above FROM by_domain GROUP BY suffix),
{_level("s_prior", "s")},
d AS (SELECT domain, x.n, x.bad, (s.bad + strength * s.above) / (s.n + strength) AS above FROM by_domain x JOIN s USING (suffix), s_prior),
{_level("d_prior", "d")},
h AS (SELECT host, x.n, x.bad, (d.bad + strength * d.above) / (d.n + strength) AS above FROM by_host x JOIN d USING (domain), d_prior),
{_level("h_prior", "h")},
rates AS (SELECT host, n, strength, (bad + strength * above) / (n + strength) AS rate FROM h, h_prior),
reputation AS (SELECT host, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM rates),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, verdict)),
best AS (
  SELECT p.page_id, max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule, max_by(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, v.verdict) AS verdict FROM p JOIN reputation v USING (host) LEFT JOIN best b ON b.page_id = p.page_id
"""

OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
         length('<|im_start|>' || role || chr(10) || replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || '<|im_end|>' || chr(10)) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR k = turns))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
         ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: crc32 of a number's digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: xor(e >> 1, (e & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"""

OP12_SQL = f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, sha256(length(role) || ':' || role || text) AS id, strlen(text) AS bytes FROM rows_),
ids AS (SELECT DISTINCT conv_id FROM t),
plan AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM ids),
r AS (
  SELECT p.conv_id, 0 AS part, k, id, bytes FROM plan p JOIN t ON t.conv_id = p.base AND t.k <= p.h
  UNION ALL SELECT p.conv_id, 1, k, id, bytes FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.k > p.h
), c AS (
  SELECT p.conv_id, coalesce(list(r.id ORDER BY part, k) FILTER (r.id IS NOT NULL), []) AS path, coalesce(list(r.bytes ORDER BY part, k) FILTER (r.id IS NOT NULL), []) AS bytes
  FROM plan p LEFT JOIN r USING (conv_id) GROUP BY p.conv_id
), m AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth, bytes FROM c),
n AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(bytes[depth]), 0) AS saved,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL
), k AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
up AS (SELECT *, unnest(range(depth + 1)) AS above FROM f),
s AS (SELECT node[1:above] AS node, above AS depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT f.conv_id, f.depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (node, depth) LEFT JOIN n o ON o.depth = f.depth - 1 AND o.node = f.node[1:f.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {"op4_url_filters": OP4_SQL, "op10_chat_format": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_prefix_trie": OP12_SQL}
