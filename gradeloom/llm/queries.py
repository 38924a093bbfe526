"""The operators bound to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import (
    decontaminate, fill_middle, fm_dedup, licenses, merkle, mixing, order_minhash, piece_tokens, quality, simhash,
    token_files, tool_chat, url_filter,
)
from gradeloom.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Overrides of the list: (host, path prefix, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))
# A host is listed if one of its parts is one of these.
LISTED_PARTS = ("adult-x", "cheap-pills", "casino", "casino-win", "malware", "phish")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"))
    bad = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_PARTS)))
    return url_filter.judged(pages, hosts.where(bad).distinct(), URL_RULES)


TOOLS = {
    "search": {"required": ["limit", "query"], "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 10}, "query": {"type": "string", "minLength": 1}}},
    "lookup": {"required": ["key"], "properties": {"key": {"type": "string", "minLength": 3}}},
}


def tool_tables(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain conversations: each assistant turn calls a tool and waits for
    the assistant turn before; the turn after it is the result."""
    named = lambda turn: F.concat("conv_id", F.lit(":"), turn)
    search = F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") % 12).alias("limit")))
    lookup = F.to_json(F.struct(F.col("text").alias("key")))
    is_search = F.col("turn") % 4 != 1
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", named(F.col("turn")).alias("call_id"), F.when(is_search, "search").otherwise("lookup").alias("name"),
        F.when(is_search, search).otherwise(lookup).alias("arguments"), named(F.col("turn") - 2).alias("after"))
    results = turns.where("role <> 'assistant'").select(
        "conv_id", "turn", named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_chat.linked_calls(*tool_tables(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarised(licenses.scanned(table(spark, sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_files.write_tokens(table(spark, sf_dir, "documents"), token_files.new_path(spark), TOKENIZER)
    return token_files.read_digests(spark, file)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_fingerprints(table(spark, sf_dir, "documents"))


def known_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labels cover."""
    covered = labels.select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")


def op7_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, known_languages(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.without_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transformed(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(
        table(spark, sf_dir, "documents"), F.replace("text", F.lit("\n"), F.lit("")),
        F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    return {f.__name__: f for f in (
        op1_quality_classifier, op2_url_filter, op3_tool_calls, op4_license_scan, op5_token_files,
        op6_order_minhash, op7_mixing_rates, op8_decontamination, op9_substring_dedup, op10_simhash,
        op11_sentence_pieces, op12_fill_in_middle, op13_merkle_manifest,
    )} | {"pipeline": run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_LISTED = ", ".join(f"'{p}'" for p in LISTED_PARTS)


def _license_rules() -> str:
    """Every rule once for each word it starts with."""
    rows = [f"({i}, '{w}', '^({r.pattern})(?: |$)', '{r.label}', {r.priority}, {r.weight})"
            for i, r in enumerate(licenses.RULES) for w in r.first]
    base = [f"({-1 - i}, '{p.split(' ')[0]}', '^({p})(?: |$)', '{label}', 0, 0.0)"
            for i, (p, label) in enumerate(licenses.BASE)]
    return ", ".join(rows + base)


_SQL = {
    "op2_url_filter": rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, prefix, said) AS (VALUES {_RULES}),
chosen AS (
  SELECT page_id, arg_max(h || prefix, len(h || prefix)) AS rule, arg_max(said, len(h || prefix)) AS said
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN list_has_any(string_split(host, '.'), [{_LISTED}])
       THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN chosen USING (page_id)""",
    "op3_tool_calls": r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS after, text,
         CASE WHEN turn % 4 <> 1 THEN 'search' ELSE 'lookup' END AS name
  FROM conversations WHERE role = 'assistant'),
results AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role <> 'assistant'),
depth AS (
  SELECT call_id, 0 AS depth FROM calls WHERE after NOT IN (SELECT call_id FROM calls)
  UNION ALL SELECT c.call_id, d.depth + 1 FROM calls c JOIN depth d ON c.after = d.call_id),
judged AS (
  SELECT c.*, d.depth, CASE WHEN name = 'search' THEN concat_ws('; ',
      CASE WHEN turn % 12 < 1 THEN 'limit: too small' WHEN turn % 12 > 10 THEN 'limit: too large' END,
      CASE WHEN len(text) < 1 THEN 'query: too short' END)
    WHEN len(text) < 3 THEN 'key: too short' ELSE '' END AS errors,
    CASE WHEN name = 'search' THEN '{"limit":' || (turn % 12) || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}'
      ELSE '{"key":' || CAST(to_json(text) AS VARCHAR) || '}' END AS arguments
  FROM calls c JOIN depth d USING (call_id))
SELECT coalesce(j.conv_id, r.conv_id) AS conv_id, coalesce(j.turn, r.turn) AS turn, coalesce(j.call_id, r.call_id) AS call_id,
  depth, CASE WHEN j.call_id IS NULL THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN r.call_id IS NULL THEN 'pending'
    ELSE 'linked' END AS status, coalesce(errors, '') AS errors,
  '{' || CASE WHEN j.call_id IS NULL THEN '' ELSE '"after":"' || after || '","arguments":' || arguments || ',' END
    || '"call":"' || coalesce(j.call_id, r.call_id) || '","conversation":' || coalesce(j.conv_id, r.conv_id)
    || CASE WHEN j.call_id IS NULL THEN '' ELSE ',"depth":' || depth END
    || ',"errors":[' || CASE WHEN coalesce(errors, '') = '' THEN '' ELSE '"' || replace(errors, '; ', '","') || '"' END || ']'
    || CASE WHEN j.call_id IS NULL THEN '' ELSE ',"name":"' || name || '"' END
    || CASE WHEN r.call_id IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END || '}' AS json
FROM judged j FULL JOIN results r ON j.call_id = r.call_id""",
    "op4_license_scan": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
rules(rule, first, pattern, label, priority, weight) AS (VALUES {_license_rules()}),
places AS (
  SELECT doc_id, i - 1 AS s, w[i] AS first, array_to_string(list_slice(w, i, i + {licenses.MOST_WORDS - 1}), ' ') AS t
  FROM d, unnest(range(1, len(w) + 1)) r(i) WHERE w[i] IN (SELECT first FROM rules)),
found AS (
  SELECT doc_id, s, s + len(string_split(m, ' ')) AS e, rule, label, priority, weight
  FROM (SELECT *, regexp_extract(t, pattern, 1) AS m FROM places JOIN rules USING (first)) WHERE m <> ''),
base AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE rule < 0 GROUP BY doc_id),
kept AS (
  SELECT * FROM found x WHERE rule >= 0 AND NOT EXISTS (
    SELECT 1 FROM found y WHERE y.rule >= 0 AND y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e AND y.priority <= x.priority
      AND (y.s < x.s OR y.e > x.e OR y.priority < x.priority OR y.rule < x.rule))),
best AS (SELECT doc_id, count(*) AS n_detections, max(weight) AS score FROM kept GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM kept UNION SELECT doc_id, label FROM found WHERE rule < 0) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(s)),
firsts AS (SELECT g, min(doc_id) AS first FROM places GROUP BY g),
lost AS (
  SELECT DISTINCT p.doc_id, p.s + k AS i FROM places p JOIN firsts f ON p.g = f.g AND f.first < p.doc_id, unnest(range(0, 13)) t(k)),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, s, s + 12), ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(s) WHERE len(w) > 0),
places AS (
  SELECT doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g
  FROM d, (SELECT DISTINCT m FROM windows) l, unnest(range(1, len(w) - m + 2)) t(s)),
hits AS (SELECT doc_id, s, m, item_id FROM places JOIN windows USING (m, g)),
words AS (
  SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, m)) t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         list_transform(range(0, 4), lambda k: CAST('0x' || substr(sha256('7:' || doc_id), 8 * k + 1, 8) AS BIGINT)) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
         greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100
              THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS key, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    -- The register of CRC-32 after the digits of doc_id; each digit is followed by eight shifts.
    list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(0, 8), lambda x: CAST(-1 AS BIGINT)))))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS register
  FROM documents),
f AS (
  SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN register % 2 = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
    END AS changed FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM f),
nodes AS (
  SELECT key, 0 AS l, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT key, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY key, l, i // 3),
subroots AS (
  SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS l, i, h, n FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY l, i // 3),
all_nodes AS (SELECT * FROM nodes UNION ALL SELECT NULL, l, i, h, n FROM tops),
beside AS (
  SELECT a.key, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM all_nodes a JOIN all_nodes b ON a.key IS NOT DISTINCT FROM b.key AND a.l = b.l AND a.i // 3 = b.i // 3
  WHERE a.n > 1 GROUP BY a.key, a.l, a.i),
low AS (
  SELECT key, i AS leaf_i, 0 AS l, i, n, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.key, leaf_i, w.l + 1, w.i // 3, (n + 2) // 3, sha256(lft || h || rgt), proof || lft || rgt
  FROM low w JOIN beside s ON w.key = s.key AND w.l = s.l AND w.i = s.i WHERE n > 1),
high AS (
  SELECT w.key, leaf_i, 0 AS l, s.i, s.n, w.h, proof FROM low w JOIN subroots s ON w.key = s.key WHERE w.n = 1
  UNION ALL
  SELECT w.key, leaf_i, w.l + 1, w.i // 3, (n + 2) // 3, sha256(lft || h || rgt), proof || lft || rgt
  FROM high w JOIN beside s ON s.key IS NULL AND w.l = s.l AND w.i = s.i WHERE n > 1)
SELECT x.doc_id, x.leaf, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(y.proof) AS proof_sha256,
  y.h AS folded_root, y.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves x JOIN subroots r USING (key) JOIN high y ON y.key = x.key AND y.leaf_i = x.i AND y.n = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
