"""Text sources (corpus, files, chat bodies, conversations) and sinks (CSV, JSON, audit lines)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import audit
from maskwright.operators import mutate as M
from maskwright.operators import reports as R
from maskwright.plans.detect_sql import q
from maskwright.plans.registry import query
from maskwright.session import checkpoint_root
from maskwright.sources import files
from maskwright.sources.views import AS_OF

START, END = "2024-01-01 00:00:00", AS_OF


@query("src_corpus", "SELECT doc_id AS id, coalesce(text, '') AS text, lang, source FROM documents")
def src_corpus(t):
    return files.corpus(t.documents, "doc_id").select("id", "text", "lang", "source")


@query("src_dir_scan", "SELECT '.txt' AS extension, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes FROM documents")
def src_dir_scan(t):
    """Documents written out as text files (one line feed each), then listed back: size per extension."""
    root = f"{checkpoint_root(t.spark)}/dir-scan-{uuid.uuid4().hex}"
    t.documents.select(F.coalesce("text", F.lit("")).alias("value")).write.text(f"{root}/nested/texts")
    t.documents.select("doc_id").write.json(f"{root}/other")  # not a supported extension
    found = files.supported_files(t.spark, root)
    return found.groupBy("extension").agg(F.sum("length").alias("n_bytes"))


_NAME = "CASE {k} WHEN 0 THEN 'a.b/Report.PDF' WHEN 1 THEN 'x.docx' WHEN 2 THEN 'dir/y.XLSX' WHEN 3 THEN 'n.md' WHEN 4 THEN 'noext' WHEN 5 THEN 'dir.v2/readme' WHEN 6 THEN 'z.csv' ELSE 'w.log' END"
_MIMES = " ".join(f"WHEN {q(e)} THEN {q(m)}" for e, m in X.MIME_TYPES.items())


@query(
    "mime_of",
    f"""SELECT page_id, path, CASE lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) {_MIMES} ELSE 'text/plain' END AS mime FROM (SELECT page_id, url || '/' || {_NAME.format(k='page_id % 8')} AS path FROM pages)""",
)
def mime_of(t):
    df = t.pages.select("page_id", F.concat("url", F.lit("/"), F.expr(_NAME.format(k="page_id % 8"))).alias("path"))
    return df.select("page_id", "path", X.mime_of(F.col("path")).alias("mime"))


_MIME_ROT = "CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END"


@query(
    "extract_text",
    f"""SELECT page_id, CASE WHEN page_id % 5 < 2 THEN html WHEN page_id % 5 = 3 THEN '' ELSE regexp_replace(html, '[^\\x20-\\x7E\\n\\r\\t]', ' ', 'g') END AS text FROM pages""",
)
def extract_text(t):
    blobs = t.pages.select("page_id", F.encode("html", "UTF-8").alias("content"), F.expr(_MIME_ROT).alias("mime"))
    return blobs.select("page_id", X.extract_text(F.col("content"), F.col("mime")).alias("text"))


@query(
    "size_guard",
    """SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) > 500000 THEN 'TEXT_TOO_LARGE' END AS error_code, CASE WHEN length(text) > 5000 THEN 'TEXT_TOO_LARGE' END AS error_at_5000 FROM documents""",
)
def size_guard(t):
    """Under the request limit, and under a smaller one that this corpus does exceed."""
    n = F.length("text").cast("long")
    small = X.size_error(F.col("text"), max_chars=5000)
    return t.documents.select("doc_id", n.alias("n_chars"), X.size_error(F.col("text")).alias("error_code"), small.alias("error_at_5000"))


_STR = "json_type({v}) = 'VARCHAR'"
_ARR = "json_type({v}) = 'ARRAY'"


def _strings(v):
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN [json_extract_string({v}, '$')] WHEN json_type({v}) = 'ARRAY' THEN list_transform(list_filter(from_json({v}, '[\"JSON\"]'), lambda p: json_type(p) = 'VARCHAR'), lambda p: json_extract_string(p, '$')) ELSE [] END"


def _blocks(v):
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN [json_extract_string({v}, '$')] WHEN json_type({v}) = 'ARRAY' THEN list_transform(list_filter(from_json({v}, '[\"JSON\"]'), lambda p: json_extract_string(p, '$.type') = 'text'), lambda p: json_extract_string(p, '$.text')) ELSE [] END"


def _string(v):
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN [json_extract_string({v}, '$')] ELSE [] END"


def _msgs(each):
    return f"flatten(list_transform(json_extract(body, '$.messages[*].content'), lambda c: {each('c')}))"


def _f(name):
    return f"json_extract(body, '$.{name}')"


def _chat(*parts):
    return "SELECT id, array_to_string(" + " || ".join(f"({p})" for p in parts) + ", chr(10)) AS text FROM chat_bodies"


@query("chat_text_openai", _chat(_msgs(_blocks), _strings(_f("prompt")), _strings(_f("input"))))
def chat_text_openai(t):
    return t.chat_bodies.select("id", X.chat_text_openai("body").alias("text"))


@query("chat_text_anthropic", _chat(_blocks(_f("system")), _msgs(_blocks)))
def chat_text_anthropic(t):
    return t.chat_bodies.select("id", X.chat_text_anthropic("body").alias("text"))


@query("chat_text_sdk", _chat(_msgs(_string), _string(_f("prompt")), _string(_f("input"))))
def chat_text_sdk(t):
    return t.chat_bodies.select("id", X.chat_text_sdk("body").alias("text"))


@query(
    "conv_text",
    """SELECT conv_id, part, count(*) AS n_turns, CAST(length(coalesce(string_agg(text, chr(10) ORDER BY turn), '')) AS BIGINT) AS n_chars, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS text FROM
       (SELECT *, CAST(floor(coalesce(sum(coalesce(length(text) + 1, 0)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500000) AS BIGINT) AS part FROM conversations)
       GROUP BY conv_id, part""",
)
def conv_text(t):
    return X.conversation_text(t.conversations)


_TYPES = """array_to_string(CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]') ELSE [data_types] END, '{sep}')"""
_TS = "strftime(e.timestamp, '%Y-%m-%d %H:%M:%S')"


@query(
    "sink_events_csv",
    f"""SELECT e.id, e.id || ',' || {_TS} || ',' || e.user_id || ',' || coalesce(u.email, '') || ',' || ai_domain || ',' || rule_id || ',"' || {_TYPES.format(sep=',')} || '",' || action || ',' || extension_version AS line,
        {_TS} || ',' || coalesce(u.email, '') || ',' || ai_domain || ',' || action || ',' || {_TYPES.format(sep=';')} || ',' || CASE WHEN acknowledged THEN 'yes' ELSE 'no' END || ',' || coalesce(strftime(acknowledged_at, '%Y-%m-%d %H:%M:%S'), '') AS client_line
        FROM policy_events e LEFT JOIN users u ON u.id = e.user_id""",
)
def sink_events_csv(t):
    """Server and client line formats of the export."""
    e = R.with_user_email(t.policy_events, t.users)
    return e.select("id", audit.event_csv_line().alias("line"), audit.client_csv_line().alias("client_line"))


@query(
    "sink_json",
    f"""SELECT id, '{{"id":' || id || ',"aiDomain":"' || ai_domain || '","dataTypes":[' || CASE WHEN len(l) = 0 THEN '' ELSE '"' || array_to_string(l, '","') || '"' END || '],"action":"' || action || '","acknowledged":' || CASE WHEN acknowledged THEN 'true' ELSE 'false' END || '}}' AS json
        FROM (SELECT *, CASE WHEN json_valid(data_types) THEN from_json(data_types, '["VARCHAR"]') ELSE [data_types] END AS l FROM policy_events)""",
)
def sink_json(t):
    v = M.event_view(t.policy_events)
    return v.select("id", F.to_json(F.struct("id", "aiDomain", "dataTypes", "action", "acknowledged")).alias("json"))


_Q = "'\"' || replace(coalesce({v}, ''), '\"', '\"\"') || '\"'"


def _quote(v):
    return _Q.format(v=v)


def _fmt(v):
    return f"strftime({v}, '%Y-%m-%d %H:%M:%S')"


_AUDIT = {
    "ct": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(a)}, {q(b)}, {q(c)}, {q(d)}, {q(audit.EVIDENCE[(b, e)] if (b, e) in audit.EVIDENCE else audit.SECTION_EVIDENCE[e])})" for i, (a, b, c, d, e) in enumerate(R.CONTROLS)) + ") c(i, framework, control, name, implementation, evidence)",
    "ins": f"SELECT * FROM policy_events WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'",
    "fixed": "SELECT * FROM (VALUES " + ", ".join(f"({s}, {p}, {q(x)})" for s, p, x in audit.FIXED_LINES) + ") f(section, part, line)",
}
_REPORT = f"""SELECT o.id AS org_id, f.section, f.part, f.line FROM orgs o, fixed f
  UNION ALL SELECT id, 0, 1, 'Organisation,' || {_quote('coalesce(name, domain)')} FROM orgs
  UNION ALL SELECT id, 0, 2, 'Generated,' || {_quote(q(END))} FROM orgs
  UNION ALL SELECT id, 0, 3, 'Period,' || {_quote(q(START))} || ' to ' || {_quote(q(END))} FROM orgs
  UNION ALL SELECT u.org_id, 1, 3, {_quote("coalesce(email, 'anonymous')")} || ',' || {_quote('role')} || ',' || CASE WHEN extension_installed THEN 'Yes' ELSE 'No' END || ',' || CASE WHEN policy_acknowledged_at IS NOT NULL THEN 'Yes' ELSE 'No' END || ',' || {_quote(_fmt('policy_acknowledged_at'))}
     || ',' || coalesce(c.b, 0) || ',' || coalesce(c.w, 0) || ',' || {_quote(_fmt('last_seen_at'))} FROM users u LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE action = 'BLOCK') AS b, count(*) FILTER (WHERE action = 'WARN') AS w FROM policy_events GROUP BY user_id) c ON c.user_id = u.id
  UNION ALL SELECT o.id, 1, 4, 'Total,' || count(u.id) || ' members,' || count(u.policy_acknowledged_at) || ' trained (' || CAST(floor(CAST(count(u.policy_acknowledged_at) AS DOUBLE) / greatest(count(u.id), 1) * 100 + 0.5) AS BIGINT) || '%)' FROM orgs o LEFT JOIN users u ON u.org_id = o.id GROUP BY o.id
  UNION ALL SELECT e.org_id, 2, 3, {_quote(_fmt('e.timestamp'))} || ',' || {_quote("coalesce(u.email, 'anonymous')")} || ',' || {_quote('ai_domain')} || ',' || {_quote("CASE WHEN json_valid(data_types) THEN array_to_string(from_json(data_types, '[\"VARCHAR\"]'), '; ') ELSE data_types END")} || ',' || {_quote('action')} || ',' || CASE WHEN acknowledged THEN 'Yes' ELSE 'No' END || ',' || {_quote(_fmt('acknowledged_at'))} || ',' || {_quote('acknowledged_note')}
     FROM ins e LEFT JOIN users u ON u.id = e.user_id
  UNION ALL SELECT o.id, 2, 4, 'Total events in period,' || count(e.id) FROM orgs o LEFT JOIN ins e ON e.org_id = o.id GROUP BY o.id
  UNION ALL SELECT o.id, 2, 5, 'Blocks,' || count(e.id) FROM orgs o LEFT JOIN ins e ON e.org_id = o.id AND action = 'BLOCK' GROUP BY o.id
  UNION ALL SELECT o.id, 2, 6, 'Blocks reviewed,' || count(e.id) FROM orgs o LEFT JOIN ins e ON e.org_id = o.id AND action = 'BLOCK' AND acknowledged GROUP BY o.id
  UNION ALL SELECT d.org_id, 3, 3, {_quote('d.ai_domain')} || ',' || users || ',' || visits || ',' || {_quote("coalesce(t.status, 'discovered')")} || ',' || {_quote("coalesce(t.risk_level, 'limited')")} || ',' || {_quote(_fmt('last_seen'))} || ',' || {_quote('t.notes')} FROM
     (SELECT org_id, ai_domain, count(DISTINCT user_id) AS users, count(*) AS visits, max(visited_at) AS last_seen FROM platform_visits WHERE visited_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY org_id, ai_domain) d LEFT JOIN ai_tools t ON t.org_id = d.org_id AND t.domain = d.ai_domain
  UNION ALL SELECT o.id, 4, 2, {_quote('framework')} || ',' || {_quote('control')} || ',' || {_quote('c.name')} || ',' || {_quote('implementation')} || ',' || {_quote('evidence')} FROM orgs o, ct c"""


@query("sink_audit_report", _REPORT, _AUDIT)
def sink_audit_report(t):
    return audit.report(t.spark, t.orgs, t.users, t.policy_events, t.platform_visits, t.ai_tools, START, END).select("org_id", "section", "part", "line")


@query("u_report_sections", f"SELECT org_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({_REPORT}) GROUP BY org_id, section", _AUDIT)
def u_report_sections(t):
    """Sizes of the united sections per tenant."""
    r = audit.report(t.spark, t.orgs, t.users, t.policy_events, t.platform_visits, t.ai_tools, START, END)
    return r.groupBy("org_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).alias("n_chars"))
