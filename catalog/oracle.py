"""``oracle_sql()``: every query again, in DuckDB SQL over the same tables."""

from __future__ import annotations

import json

from catalog.queries import CHUNK_CAP, HEADER
from gradeloom import constants as C

# White space and its trimming, stated here again so that a wrong class shows.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TRIM = rf"\A{SPACE}+|{SPACE}+\z"

MODELS = (C.BASE, C.FINETUNED)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(expression: str, name: str) -> str:
    return f"round(cast({expression} AS double), 6) AS {name}"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM}', '', 'g')"


def normal(x: str) -> str:
    bare = (r"regexp_replace(regexp_replace(coalesce(" + x + r", ''), '(?i)@startuml[^\n]*\n?', '',"
            r" 'g'), '(?i)@enduml[^\n]*', '', 'g')")
    return f"trim(regexp_replace(lower({bare}), '{SPACE}+', ' ', 'g'))"


def strip_think(x: str) -> str:
    return trim_space(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def shares(*names: str, whole: str = "n") -> str:
    return ", ".join(r6(f"100.0 * {c} / nullif({whole}, 0)", f"{c}_pct") for c in names)


# Views

FLAGGED = """flagged AS (
  SELECT d.doc_id AS row_idx, d.text, d.source AS split,
    coalesce(l.quality = 1, false) AS uml_valid,
    CASE WHEN coalesce(l.quality = 1, false) THEN ''
      ELSE 'quality ' || coalesce(l.quality, -1) END AS uml_error,
    coalesce(l.toxic = 1, false) AS llm_failed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PAIRS = FLAGGED + """,
base AS (
  SELECT f.row_idx, coalesce(n.text, '') AS uml_pred, f.text AS uml_code_gt,
    f.uml_valid, f.uml_error, f.llm_failed
  FROM flagged f LEFT JOIN documents n ON n.doc_id = f.row_idx + 1),
finetuned AS (
  SELECT row_idx, CASE row_idx % 3
      WHEN 0 THEN '@startuml' || chr(10) || replace(text, ' ', '  ') || chr(10) || '@enduml'
      WHEN 1 THEN left(text, cast(floor(length(text) / 2) AS int)) ELSE '' END AS uml_pred,
    text AS uml_code_gt, uml_valid OR row_idx % 3 = 0 AS uml_valid,
    CASE WHEN uml_valid OR row_idx % 3 = 0 THEN '' ELSE uml_error END AS uml_error, llm_failed
  FROM flagged),
pairs AS (
  SELECT 'base' AS model, * FROM base UNION ALL SELECT 'finetuned' AS model, * FROM finetuned)"""

NORMED = f"""normed AS (
  SELECT model, row_idx, {normal('uml_pred')} AS p, {normal('uml_code_gt')} AS r FROM pairs)"""

TOKENS = f"""token_sets AS (
  SELECT model, row_idx, list_distinct({words('p')}) AS p, list_distinct({words('r')}) AS r
  FROM normed),
token_counts AS (
  SELECT model, row_idx, len(p) AS np, len(r) AS nr,
    len(list_intersect(p, r)) AS tp FROM token_sets),
token_prf AS (
  SELECT model, row_idx,
    CASE WHEN np > 0 AND nr > 0 THEN tp / np ELSE 0.0 END AS token_prec,
    CASE WHEN np > 0 AND nr > 0 THEN tp / nr ELSE 0.0 END AS token_recall
  FROM token_counts),
token_f AS (
  SELECT *, CASE WHEN token_prec + token_recall > 0
    THEN 2 * token_prec * token_recall / (token_prec + token_recall) ELSE 0.0 END AS token_f1
  FROM token_prf)"""


def metric_tokens(x: str) -> str:
    for old, new in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"(' ' || {x} || ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return words(x)


BLEU = f"""bleu_tokens AS (
  SELECT model, row_idx, 'p' AS side, {metric_tokens('p')} AS t FROM normed
  UNION ALL SELECT model, row_idx, 'r' AS side, {metric_tokens('r')} AS t FROM normed),
spots AS (
  SELECT model, row_idx, side, unnest(t) AS t1, unnest(range(len(t))) AS pos FROM bleu_tokens),
followed AS (
  SELECT model, row_idx, side, t1, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3,
    lead(t1, 3) OVER w AS t4
  FROM spots WINDOW w AS (PARTITION BY model, row_idx, side ORDER BY pos)),
grams AS (
  SELECT model, row_idx, side, n, CASE n WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2
    WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3 ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS g
  FROM followed, (SELECT unnest([1, 2, 3, 4]) AS n) o),
gram_counts AS (
  SELECT model, row_idx, n, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r
  FROM grams WHERE g IS NOT NULL GROUP BY ALL),
orders AS (
  SELECT model, row_idx, n, sum(least(p, r)) AS m, sum(p) AS total
  FROM gram_counts GROUP BY ALL HAVING sum(p) > 0),
smoothed AS (
  SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY model, row_idx ORDER BY n) AS misses FROM orders),
bleu_parts AS (
  SELECT model, row_idx, sum(m) AS matches,
    avg(ln(CASE WHEN m > 0 THEN m / total ELSE 1.0 / (pow(2, misses) * total) END)) AS log_mean
  FROM smoothed GROUP BY ALL),
lengths AS (
  SELECT model, row_idx, max(len(t)) FILTER (side = 'p') AS lp, max(len(t)) FILTER (side = 'r') AS lr
  FROM bleu_tokens GROUP BY ALL),
bleu AS (
  SELECT model, row_idx, CASE WHEN coalesce(matches, 0) = 0 THEN 0.0
    ELSE exp(log_mean) * CASE WHEN lp < lr THEN exp(1.0 - lr / lp) ELSE 1.0 END END AS bleu
  FROM lengths LEFT JOIN bleu_parts USING (model, row_idx))"""

TFIDF = r"""terms AS (
  SELECT model, row_idx, 'p' AS side, unnest(regexp_extract_all(
    CASE WHEN p = '' THEN '<empty>' ELSE p END, '[\p{L}\p{N}_]{2,}')) AS term FROM normed
  UNION ALL SELECT model, row_idx, 'r' AS side, unnest(regexp_extract_all(
    CASE WHEN r = '' THEN '<empty>' ELSE r END, '[\p{L}\p{N}_]{2,}')) AS term FROM normed),
tf AS (
  SELECT model, row_idx, term, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r
  FROM terms GROUP BY ALL),
vocabulary AS (
  SELECT model, term, sum((p > 0)::int + (r > 0)::int) AS df FROM tf GROUP BY ALL),
texts AS (SELECT model, 2 * count(*) AS n FROM pairs GROUP BY ALL),
weights AS (
  SELECT model, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM vocabulary JOIN texts USING (model)),
sums AS (
  SELECT model, row_idx, sum(p * r * idf * idf) AS lr, sum(p * p * idf * idf) AS ll,
    sum(r * r * idf * idf) AS rr
  FROM tf JOIN weights USING (model, term) GROUP BY ALL),
tfidf AS (
  SELECT model, row_idx, CASE WHEN coalesce(sqrt(ll * rr), 0) = 0 THEN 0.0
    ELSE lr / sqrt(ll * rr) END AS emb_sim
  FROM pairs LEFT JOIN sums USING (model, row_idx))"""

SCORES = ",\n".join([PAIRS, NORMED, TOKENS, BLEU, TFIDF]) + """,
scores AS (
  SELECT model, row_idx, uml_valid, uml_error, llm_failed,
    CASE WHEN normed.p = normed.r THEN 1.0 ELSE 0.0 END AS exact_match,
    bleu, bleu AS codebleu, emb_sim, token_prec, token_recall, token_f1
  FROM pairs JOIN normed USING (model, row_idx) JOIN token_f USING (model, row_idx)
    JOIN bleu USING (model, row_idx) JOIN tfidf USING (model, row_idx))"""

DIAGRAMS = """diagrams AS (
  SELECT doc_id AS row_idx, CASE doc_id % 6
    WHEN 0 THEN text WHEN 1 THEN '@startuml ' || text
    WHEN 2 THEN '@startuml' || chr(10) || text || chr(10) || '@enduml'
    WHEN 3 THEN '@startuml @enduml' WHEN 4 THEN ''
    ELSE '@StartUML' || chr(10) || text || chr(10) || '@EndUML' END AS code
  FROM documents)"""

CHECKED = f"""trimmed AS (SELECT row_idx, code, {trim_space('code')} AS t FROM diagrams),
checked AS (
  SELECT row_idx, code, CASE WHEN code = '' THEN 'Empty response'
    WHEN NOT starts_with(t, '@startuml') THEN 'Missing @startuml'
    WHEN NOT ends_with(t, '@enduml') THEN 'Missing @enduml'
    WHEN {trim_space("substring(t, 10, length(t) - 16)")} = '' THEN 'Empty diagram body'
    ELSE '' END AS error,
  CASE WHEN NOT regexp_matches(code, '(?i)@startuml') THEN 'Missing @startuml directive (pre-flight check)'
    WHEN NOT regexp_matches(code, '(?i)@enduml') THEN 'Missing @enduml directive (pre-flight check)'
    END AS preflight
  FROM trimmed)"""

RESPONSES = f"""responses AS (
  SELECT doc_id AS row_idx, copy AS file_ord, doc_id AS line_no,
    CASE WHEN (doc_id + copy) % 7 <> 0 THEN
      {trim_space("text || CASE WHEN copy = 1 THEN ' again' ELSE '' END")} END AS uml_code
  FROM documents, (SELECT unnest([0, 1]) AS copy) c
  WHERE doc_id % 11 <> 0 AND (copy = 0 OR doc_id % 13 = 0)),
latest AS (
  SELECT row_idx, uml_code FROM responses
  QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY file_ord DESC, line_no DESC) = 1)"""

MANIFEST = """manifest AS (
  SELECT event_id AS id, event_id // 5 AS job,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN NULL
      ELSE 'file_' || event_id END AS output_file_id, event_type, props, ts
  FROM events)"""

GATE = "coalesce(bool_and(status = 'completed' AND output_file_id IS NOT NULL), true) AS ready"

CHATS = """chats AS (
  SELECT conv_id * 1000 + turn AS row_idx, conv_id, turn, role, text,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer FROM conversations)"""

SHARDS = """shards AS (
  SELECT doc_id, 'documents' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents
  UNION ALL SELECT doc_id, 'labels' AS split, row_number() OVER (ORDER BY doc_id) - 1
    + (SELECT count(*) FROM documents) AS row_idx FROM labels)"""


def request_line(user: str, system: str) -> str:
    messages = (f"[json_object('role', 'system', 'content', {lit(system)}),"
                f" json_object('role', 'user', 'content', {user})]")
    return (f"json_object('custom_id', 'req_' || doc_id, 'method', 'POST', 'url', '{C.REQUEST_URL}',"
            f" 'body', json_object('model', 'model-a', 'messages', {messages}, 'temperature', 0.0))")


TEXT_LINE = request_line(f"{lit(C.TEXT_USER_PREFIX)} || {trim_space('text')}", C.TEXT_SYSTEM_PROMPT)
IMAGE_LINE = request_line(
    f"[json_object('type', 'text', 'text', {lit(C.IMAGE_USER_PROMPT)}), json_object('type',"
    f" 'image_url', 'image_url', json_object('url', {lit(C.IMAGE_URI_PREFIX)} || base64(encode(text))))]",
    C.IMAGE_SYSTEM_PROMPT)

PLAN = f"""RECURSIVE lines AS (
  SELECT doc_id AS row_idx, octet_length(encode(cast({TEXT_LINE} AS varchar))) + 1 AS bytes
  FROM documents),
plan AS (
  SELECT row_idx, bytes, bytes AS held, cast(0 AS bigint) AS part FROM lines WHERE row_idx = 0
  UNION ALL
  SELECT l.row_idx, l.bytes,
    CASE WHEN p.held + l.bytes > {CHUNK_CAP} THEN l.bytes ELSE p.held + l.bytes END AS held,
    CASE WHEN p.held + l.bytes > {CHUNK_CAP} THEN p.part + 1 ELSE p.part END AS part
  FROM plan p JOIN lines l ON l.row_idx = p.row_idx + 1)"""

TOKEN_IDS = f"""ids AS (
  SELECT doc_id AS row_idx, doc_id // 4 AS batch, list_transform(
    list_filter(string_split(text, ' '), lambda w: w <> ''),
    lambda w: cast(unicode(w) % 50 + length(w) * 50 AS int))[1:{C.MAX_SEQUENCE_LENGTH}] AS ids
  FROM documents),
widths AS (SELECT batch, max(len(ids)) AS width FROM ids GROUP BY ALL),
spots AS (
  SELECT row_idx, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM ids),
followed AS (
  SELECT row_idx, id, pos, lead(id) OVER (PARTITION BY row_idx ORDER BY pos) AS next_id FROM spots),
headers AS (
  SELECT row_idx, min(pos) AS header_at FROM followed
  WHERE id = {HEADER[0]} AND next_id = {HEADER[1]} GROUP BY row_idx),
padded AS (
  SELECT row_idx, width, header_at, list_concat(ids,
    list_transform(range(width - len(ids)), lambda i: 0)) AS ids
  FROM ids JOIN widths USING (batch) LEFT JOIN headers USING (row_idx))"""


def over_scores(select: str) -> str:
    return f"WITH {SCORES}\n{select}"


def over_pairs(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([PAIRS, *more]) + "\n" + select


def per_measure(column: str, alias: str) -> str:
    return f"SELECT '{alias}' AS measure, model, {column} AS value FROM scores GROUP BY model"


MEANS = ", ".join(r6(f"avg({m})", m) for m in C.METRICS)
MEASURES = " UNION ALL ".join(
    [per_measure("cast(count(*) AS double)", "n"),
     per_measure("avg(uml_valid::int * 100.0)", "valid_pct"),
     *[per_measure(f"avg({m})", m) for m in C.METRICS]])
PAIRED = f"""paired AS (
  SELECT measure, max(value) FILTER (model = 'base') AS base,
    max(value) FILTER (model = 'finetuned') AS finetuned
  FROM ({MEASURES}) GROUP BY measure)"""
THRESHOLD = "(SELECT coalesce(median(codebleu), 0.5) FROM scores WHERE model = 'finetuned' AND uml_valid)"

COUNTS = """counts AS (
  SELECT model, count(*) AS n, count(*) FILTER (uml_valid) AS valid,
    count(*) FILTER (llm_failed) AS failed FROM pairs GROUP BY model)"""


def _comparison(outcome: str, rows: str) -> str:
    b, f = (f"(SELECT {rows} FROM counts WHERE model = '{m}')" for m in MODELS)
    bp, fp = (f"(SELECT 100.0 * ({rows}) / n FROM counts WHERE model = '{m}')" for m in MODELS)
    return (f"SELECT '{outcome}' AS outcome, {b} AS base_rows, {r6(bp, 'base_pct')}, {f} AS"
            f" finetuned_rows, {r6(fp, 'finetuned_pct')}, {r6(f'{fp} - {bp}', 'delta_pp')}")


def _share(outcome: str, condition: str) -> str:
    whole = "(SELECT count(*) FROM pairs WHERE model = 'base')"
    return (f"SELECT model, '{outcome}' AS outcome, "
            f"{r6(f'100.0 * count(*) FILTER ({condition}) / {whole}', 'share_pct')} "
            "FROM pairs GROUP BY model")


HISTOGRAM = """spread AS (
  SELECT model, count(*) AS n, avg(token_f1) AS mean, min(token_f1) AS low, max(token_f1) AS high,
    (max(token_f1) - min(token_f1)) / 20 AS width FROM scores GROUP BY model),
binned AS (
  SELECT model, least(cast(floor((token_f1 - low) / width) AS int), 19) AS bin, count(*) AS n_rows
  FROM scores JOIN spread USING (model) GROUP BY ALL),
grid AS (SELECT spread.*, cast(unnest(range(20)) AS int) AS bin FROM spread)"""

DENSITY = """spread AS (
  SELECT model, count(*) AS n, stddev_samp(emb_sim) * pow(count(*), -0.2) AS h,
    min(emb_sim) - 0.5 * (max(emb_sim) - min(emb_sim)) AS x0,
    2.0 * (max(emb_sim) - min(emb_sim)) / 999 AS dx FROM scores GROUP BY model),
grid AS (SELECT spread.*, cast(i AS int) AS i, x0 + i * dx AS x
  FROM spread, (SELECT unnest(range(1000)) AS i) g)"""


def chat_text() -> str:
    user = f"user=image|text:{C.IMAGE_USER_PROMPT}"
    return (f"{lit('system=text:' + C.TRAINING_SYSTEM_PROMPT + '||' + user + '||assistant=text:')}"
            " || text")


def _turn(role: str, *parts: str) -> str:
    return f"json_object('role', '{role}', 'content', json_array({', '.join(parts)}))"


def _part(text: str) -> str:
    return f"json_object('type', 'text', 'text', {text})"


TRAINING_TURNS = ", ".join((
    _turn("system", _part(lit(C.TRAINING_SYSTEM_PROMPT))),
    _turn("user", "json_object('type', 'image')", _part(lit(C.IMAGE_USER_PROMPT))),
    _turn("assistant", _part("text"))))

RENDERS = r"""renders AS (
  SELECT event_id AS row_idx, event_id % 7 AS kind,
    trim(' ' || event_type || ' in ' || props || ' ') AS said,
    upper(left(event_type, 1)) || substr(event_type, 2) AS word, props FROM events)"""


def _json(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def oracle_sql() -> dict[str, str]:
    return {
        "read_shards": "SELECT doc_id, lang, n_chars FROM documents",
        "exclude_files": f"WITH {SHARDS} SELECT doc_id FROM shards",
        "tag_split": f"WITH {SHARDS} SELECT doc_id, split FROM shards",
        "dense_row_index": f"WITH {SHARDS} SELECT doc_id, split, row_idx FROM shards",
        "filtered_row_index":
            "SELECT doc_id, row_idx FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx"
            " FROM documents) WHERE lang = 'en'",
        "union_shards": "SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark",
        "read_eval_split":
            "SELECT 'chat' AS layout, octet_length(encode(text)) AS n_bytes, text AS uml_code_gt FROM"
            " documents UNION ALL SELECT unnest(['source', 'flat']), octet_length(encode(text)),"
            " CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END FROM documents",
        "read_ground_truth":
            f"WITH {CHATS} SELECT row_idx, text AS uml_code_gt, 'direct' AS layout FROM chats"
            " UNION ALL SELECT row_idx, answer, 'messages' FROM chats",
        "read_batch_responses":
            "SELECT doc_id AS row_idx, CASE WHEN (doc_id + copy) % 7 <> 0 THEN "
            + trim_space("text || CASE WHEN copy = 1 THEN ' again' ELSE '' END")
            + " END AS uml_code, copy AS file_ord FROM documents, (SELECT cast(unnest([0, 1]) AS int) AS copy) c"
            " WHERE copy = 0 OR doc_id % 13 = 0",
        "unreadable_responses":
            "SELECT source, count(*) AS n_lines, count(*) FILTER (source = 'src0') AS n_unreadable FROM documents"
            " GROUP BY source",
        "resume_increment":
            "SELECT doc_id AS row_idx, source AS split FROM documents"
            " WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "resume_from_store":
            f"WITH {RESPONSES} SELECT d.doc_id AS row_idx, l.uml_code, l.row_idx IS NULL AS pending"
            " FROM documents d LEFT JOIN latest l ON l.row_idx = d.doc_id",
        "keep_valid": f"WITH {FLAGGED} SELECT row_idx, split FROM flagged WHERE uml_valid AND NOT llm_failed",
        "kept_count":
            f"WITH {FLAGGED} SELECT count(*) FILTER (uml_valid AND NOT llm_failed) AS kept,"
            " count(*) AS initial FROM flagged",
        "classify_outcome": over_pairs(
            "SELECT model, row_idx, CASE WHEN uml_valid THEN 'valid' WHEN llm_failed THEN"
            " 'llm_failure' ELSE 'invalid' END AS outcome FROM pairs"),
        "result_row":
            f"WITH {DIAGRAMS}, {CHECKED}, judged AS (SELECT *, row_idx % 5 = 0 AS failed,"
            " concat_ws('; ', preflight, nullif(error, '')) AS found FROM checked)"
            " SELECT row_idx, CASE WHEN failed THEN '' ELSE code END AS uml_code,"
            " NOT failed AND found = '' AS uml_valid,"
            f" CASE WHEN failed THEN {lit(C.FAILED_CALL_IMAGE)} ELSE found END AS uml_error,"
            " failed AS llm_failed FROM judged",
        "fill_missing_text": over_pairs("SELECT model, row_idx, uml_pred FROM pairs"),
        "empty_reference_count": f"WITH {CHATS} SELECT count(*) AS n_empty FROM chats WHERE answer = ''",
        "drop_source_columns":
            f"WITH {FLAGGED} SELECT md5(cast(json_array({TRAINING_TURNS}) AS varchar)) AS messages,"
            " octet_length(encode(text)) AS image_bytes, split FROM flagged"
            " WHERE uml_valid AND NOT llm_failed",
        "sample_rows":
            f"WITH {FLAGGED} SELECT row_idx, left(text, 120) AS text, split, uml_valid, uml_error,"
            " llm_failed FROM flagged ORDER BY row_idx LIMIT 5",
        "attach_results":
            f"WITH {RESPONSES} SELECT d.doc_id AS row_idx, d.source AS split, l.uml_code"
            " FROM documents d LEFT JOIN latest l ON l.row_idx = d.doc_id",
        "attach_ground_truth": over_pairs(
            "SELECT b.row_idx, b.uml_pred, upper(f.split) AS uml_code_gt FROM base b"
            " JOIN flagged f USING (row_idx)"),
        "attach_ground_truth_by_position": over_pairs(
            "SELECT b.row_idx AS key, b.uml_pred, upper(f.split) AS uml_code_gt FROM base b"
            " JOIN flagged f USING (row_idx)"),
        "benchmark_table":
            f"WITH {RESPONSES}, answered AS (SELECT d.doc_id AS row_idx, d.source AS uml_code_gt, l.uml_code AS code,"
            f" {trim_space('l.uml_code')} AS t FROM documents d LEFT JOIN latest l ON l.row_idx = d.doc_id),"
            " judged AS (SELECT *, CASE WHEN code IS NULL THEN 'LLM failure' WHEN code = '' THEN 'Empty response'"
            " WHEN NOT starts_with(t, '@startuml') THEN 'Missing @startuml' WHEN NOT ends_with(t, '@enduml')"
            f" THEN 'Missing @enduml' WHEN {trim_space('substring(t, 10, length(t) - 16)')} = ''"
            " THEN 'Empty diagram body' ELSE '' END AS uml_error FROM answered)"
            " SELECT row_idx, uml_code_gt, coalesce(code, '') AS uml_pred, uml_error = '' AS uml_valid, uml_error,"
            " code IS NULL AS llm_failed FROM judged",
        "latest_response": f"WITH {RESPONSES} SELECT row_idx, uml_code FROM latest",
        "merge_responses":
            f"WITH {RESPONSES}, answers AS (SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN '@startuml' || chr(10)"
            " || uml_code || chr(10) || '@enduml' ELSE uml_code END AS uml_code FROM latest), judged AS ("
            "SELECT d.doc_id AS row_idx, l.uml_code, CASE WHEN l.uml_code IS NULL THEN"
            f" {lit(C.FAILED_IN_BATCH)} WHEN NOT regexp_matches(l.uml_code, '(?i)@startuml') THEN"
            " 'Missing @startuml directive (pre-flight check)' WHEN NOT regexp_matches(l.uml_code, '(?i)@enduml')"
            " THEN 'Missing @enduml directive (pre-flight check)' ELSE '' END AS uml_error"
            " FROM documents d LEFT JOIN answers l ON l.row_idx = d.doc_id)"
            " SELECT row_idx, coalesce(uml_code, '') AS uml_code, uml_error = '' AS uml_valid, uml_error,"
            " uml_code IS NULL AS llm_failed FROM judged",
        "write_results": f"WITH {FLAGGED} SELECT row_idx, split, uml_valid, uml_error, llm_failed FROM flagged",
        "export_split":
            f"WITH {FLAGGED} SELECT row_idx, text, uml_valid, llm_failed FROM flagged WHERE split = 'src0'",
        "write_detail_csv": f"WITH {FLAGGED} SELECT row_idx, uml_valid, uml_error, llm_failed FROM flagged",
        "write_request_chunks": f"WITH {PLAN} SELECT part, count(*) AS n_requests FROM plan GROUP BY part",
        "check_predictions":
            f"WITH {DIAGRAMS}, {CHECKED} SELECT row_idx, error = '' AS uml_valid, error AS uml_error,"
            " false AS llm_failed FROM checked",
        "assign_split":
            "SELECT doc_id AS row_idx, CASE WHEN slot < 8 THEN 'train' WHEN slot = 8 THEN 'validation' ELSE 'test' END"
            " AS split FROM (SELECT doc_id, cast('0x' || left(md5(doc_id || ':42'), 8) AS bigint) % 10 AS slot FROM documents)",
        "assign_exact_split":
            "SELECT doc_id AS row_idx, CASE WHEN place <= n - held THEN 'train'"
            " WHEN place <= n - cast(ceil(held / 2) AS bigint) THEN 'validation' ELSE 'test' END AS split"
            " FROM (SELECT doc_id, count(*) OVER () AS n, cast(ceil(count(*) OVER () / 5) AS bigint) AS held,"
            " row_number() OVER (ORDER BY left(md5(doc_id || ':42'), 15), doc_id) AS place FROM documents)",
        "pair_models": over_pairs(
            "SELECT measure, max(value) FILTER (model = 'base') AS base,"
            " max(value) FILTER (model = 'finetuned') AS finetuned FROM long GROUP BY measure",
            "long AS (SELECT model, 'n' AS measure, count(*) AS value FROM pairs GROUP BY model"
            " UNION ALL SELECT model, 'pred_chars', cast(sum(length(uml_pred)) AS bigint) FROM pairs GROUP BY model"
            " UNION ALL SELECT model, 'gt_chars', cast(sum(length(uml_code_gt)) AS bigint) FROM pairs GROUP BY model)"),
        "union_models": over_pairs("SELECT * FROM pairs"),
        "shard_census":
            f"WITH {SHARDS} SELECT split || '.parquet' AS file_name, split, count(*) AS n_rows"
            " FROM shards GROUP BY split",
        "split_census":
            "SELECT count(*) AS total, count(DISTINCT source) AS n_splits,"
            " string_agg(DISTINCT source, ',' ORDER BY source) AS splits FROM documents",
        "conversion_summary":
            f"WITH {FLAGGED}, rows AS (SELECT * REPLACE (nullif(split, 'src0') AS split) FROM flagged),"
            " both_scopes AS (SELECT 'all' AS scope, NULL AS split, * EXCLUDE (split) FROM rows"
            " UNION ALL SELECT 'split', split, * EXCLUDE (split) FROM rows WHERE split IS NOT NULL)"
            " SELECT scope, split, count(*) AS total, count(*) FILTER (uml_valid) AS uml_valid,"
            " count(*) FILTER (llm_failed) AS llm_failures, count(*) - count(*) FILTER (uml_valid)"
            " - count(*) FILTER (llm_failed) AS uml_invalid, "
            + r6("100.0 * count(*) FILTER (uml_valid) / count(*)", "valid_pct")
            + " FROM both_scopes GROUP BY scope, split",
        "benchmark_summary": over_pairs(
            "SELECT n, llm_failures, n - valid - llm_failures AS invalid, valid, "
            + r6("100.0 * llm_failures / n", "llm_failures_pct") + ", "
            + r6("100.0 * (n - valid - llm_failures) / n", "invalid_pct") + ", "
            + r6("100.0 * valid / n", "valid_pct")
            + " FROM (SELECT count(*) AS n, count(*) FILTER (llm_failed) AS llm_failures,"
              " count(*) FILTER (uml_valid) AS valid FROM base)"),
        "top_errors": over_pairs(
            "SELECT uml_error, count(*) AS n_rows, min(row_idx) AS first_idx FROM base"
            " WHERE uml_error <> '' AND NOT llm_failed GROUP BY uml_error"
            " ORDER BY n_rows DESC, first_idx LIMIT 5"),
        "outcome_comparison": over_pairs(" UNION ALL ".join([
            _comparison("valid", "valid"), _comparison("invalid", "n - valid - failed"),
            _comparison("failed", "failed")]), COUNTS),
        "outcome_shares": over_pairs(" UNION ALL ".join([
            _share("llm_failures", "llm_failed"), _share("valid", "uml_valid"),
            _share("invalid", "NOT uml_valid AND NOT llm_failed")])),
        "split_sizes": "SELECT source AS split, count(*) AS n_rows FROM documents GROUP BY source",
        "batch_gate": f"WITH {MANIFEST} SELECT job, {GATE} FROM manifest GROUP BY job",
        "batch_gate_overall": f"WITH {MANIFEST} SELECT {GATE} FROM manifest",
        "batch_status_report":
            f"WITH {MANIFEST} SELECT cast(id AS varchar) AS id, upper(status) AS status,"
            " cast(10 AS bigint) AS total, 10 - id % 3 AS completed, id % 3 AS failed,"
            " strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,"
            " CASE WHEN status = 'failed' THEN event_type END AS error_code,"
            " CASE WHEN status = 'failed' THEN props END AS error_message FROM manifest",
        "normalise_code": f"WITH {DIAGRAMS} SELECT row_idx, {normal('code')} AS body FROM diagrams",
        "strip_think": "SELECT doc_id AS row_idx, " + strip_think(
            r"chr(9) || '<think>a' || chr(10) || 'b</think>' || chr(10) || text ||"
            r" '<think>c</think> <think>open '") + " AS text FROM documents",
        "check_diagram":
            f"WITH {DIAGRAMS}, {CHECKED} SELECT row_idx, error = '' AS valid, error FROM checked",
        "preflight_diagram":
            f"WITH {DIAGRAMS}, {CHECKED} SELECT row_idx, preflight AS error FROM checked",
        "classify_render_response":
            f"WITH {RENDERS}, judged AS (SELECT row_idx, CASE WHEN kind = 0 THEN {lit(C.RENDER_REJECTED)}"
            f" WHEN kind = 1 THEN '{C.RENDER_HTTP_ERROR}503: Service Unavailable'"
            f" WHEN kind = 2 THEN '{C.RENDER_CONTENT_TYPE}text/html'"
            " WHEN kind <= 4 AND regexp_matches(lower(said), 'error|syntax|unexpected|cannot|unknown')"
            f" THEN '{C.RENDER_REPORTED}' || said"
            f" WHEN kind > 4 AND word = 'Error' THEN '{C.RENDER_REPORTED}' || 'PNG' || chr(10) || chr(10) || 'IDATrows Error' || props || 'IEND'"
            " END AS error FROM renders)"
            " SELECT row_idx, error IS NULL AS uml_valid, coalesce(error, '') AS errors FROM judged",
        "assistant_text": f"WITH {CHATS} SELECT row_idx, answer AS text FROM chats",
        "assistant_turn_plain":
            "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 2 = 0 THEN text"
            " ELSE 'closing' END AS text FROM conversations",
        "build_request": f"SELECT doc_id AS row_idx, cast({TEXT_LINE} AS varchar) AS line FROM documents",
        "build_request_image": f"SELECT doc_id AS row_idx, cast({IMAGE_LINE} AS varchar) AS line FROM documents",
        "request_id":
            "SELECT doc_id AS row_idx, 'req_' || doc_id AS custom_id, doc_id AS parsed FROM documents",
        "format_training_chat":
            f"WITH {FLAGGED} SELECT split, octet_length(encode(text)) AS n_bytes, {chat_text()} AS chat"
            " FROM flagged WHERE uml_valid AND NOT llm_failed",
        "pick_splits":
            f"WITH {FLAGGED} SELECT row_idx, CASE WHEN uml_valid THEN 'train' ELSE 'test' END AS split,"
            " CASE WHEN uml_valid THEN 'train' ELSE 'eval' END AS role FROM flagged"
            " WHERE uml_valid OR llm_failed",
        "mask_prompt_labels":
            f"WITH {TOKEN_IDS} SELECT row_idx, cast(width AS int) AS width, array_to_string(list_transform("
            "ids, lambda x, i: CASE WHEN i < coalesce(header_at + 2, 1) OR x = 0 THEN -100 ELSE x END), ' ')"
            " AS labels FROM padded",
        "plan_request_chunks": f"WITH {PLAN} SELECT row_idx, bytes, part FROM plan",
        "chunk_report":
            f"WITH {PLAN} SELECT part, count(*) AS n_requests, "
            + r6("sum(bytes) / (1024 * 1024)", "size_mb") + " FROM plan GROUP BY part",
        "exact_match": over_pairs(
            "SELECT model, row_idx, CASE WHEN p = r THEN 1.0::double ELSE 0.0 END AS exact_match"
            " FROM normed", NORMED),
        "token_prf": over_pairs(
            f"SELECT model, row_idx, {', '.join(r6(c, c) for c in C.METRICS[4:])} FROM token_f",
            NORMED, TOKENS),
        "sentence_bleu": over_pairs(f"SELECT model, row_idx, {r6('bleu', 'bleu')} FROM bleu", NORMED, BLEU),
        "code_bleu": over_pairs(
            f"SELECT row_idx, {r6('bleu', 'codebleu')} FROM bleu WHERE model = 'finetuned'", NORMED, BLEU),
        "tfidf_cosine": over_pairs(
            f"SELECT row_idx, {r6('emb_sim', 'emb_sim')} FROM tfidf WHERE model = 'base'", NORMED, TFIDF),
        "tfidf_cosine_split": over_pairs(
            f"SELECT row_idx, {r6('emb_sim', 'emb_sim')} FROM tfidf WHERE model = 'base'", NORMED, TFIDF),
        "vector_cosine":
            "SELECT a.vec_id, " + r6("list_cosine_similarity(a.embedding::double[], b.embedding::double[])",
                                     "cosine")
            + " FROM embeddings a JOIN embeddings b ON b.vec_id = CASE WHEN a.vec_id = (SELECT max(vec_id) FROM embeddings)"
            " THEN (SELECT min(vec_id) FROM embeddings) ELSE a.vec_id + 1 END",
        "score_pairs": over_scores(
            "SELECT model, row_idx, uml_valid, uml_error, llm_failed, "
            + ", ".join(r6(m, m) for m in C.METRICS) + " FROM scores"),
        "available_metrics": over_scores(
            " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n_values FROM scores"
                               for m in C.METRICS)),
        "metric_means": over_scores(f"SELECT model, {MEANS} FROM scores GROUP BY model"),
        "metric_summary": over_scores(
            f", {PAIRED} SELECT measure, {r6('base', 'base')}, {r6('finetuned', 'finetuned')} FROM paired"),
        "metric_delta": over_scores(
            f", {PAIRED} SELECT measure AS metric, {r6('finetuned - base', 'delta')},"
            " CASE WHEN finetuned - base > 0 THEN '↑' ELSE '↓' END AS arrow FROM paired"
            " WHERE measure NOT IN ('n', 'valid_pct')"),
        "metric_scatter": over_scores(
            f"SELECT model, {r6('bleu', 'bleu')}, {r6('emb_sim', 'emb_sim')} FROM scores"),
        "correctness_threshold": over_scores(
            f"SELECT 'codebleu' AS metric, {r6(THRESHOLD, 'threshold')}"),
        "validity_correctness": over_scores(
            "SELECT model, " + r6("100.0 * count(*) FILTER (NOT uml_valid) / count(*)", "invalid_pct")
            + ", " + r6(f"100.0 * count(*) FILTER (uml_valid AND codebleu < {THRESHOLD}) / count(*)",
                        "imprecise_pct")
            + ", " + r6(f"100.0 * count(*) FILTER (uml_valid AND codebleu >= {THRESHOLD}) / count(*)",
                        "correct_pct") + " FROM scores GROUP BY model"),
        "score_histogram": over_scores(
            f", {HISTOGRAM} SELECT model, bin, {r6('low + bin * width', 'bin_low')},"
            f" coalesce(n_rows, 0) AS n_rows, {r6('coalesce(n_rows, 0) / (n * width)', 'density')},"
            f" {r6('mean', 'mean')} FROM grid LEFT JOIN binned USING (model, bin)"),
        "score_density": over_scores(
            f", {DENSITY} SELECT model, i, {r6('any_value(x)', 'x')}, "
            + r6("sum(exp(-0.5 * pow((x - emb_sim) / h, 2))) / any_value(n * h * sqrt(2 * pi()))", "density")
            + " FROM grid JOIN scores USING (model) GROUP BY model, i"),
    }
