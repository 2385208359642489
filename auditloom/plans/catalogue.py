"""The registered queries of the scanning engine and their SQL.

Text operators run on whole tables of text. Operators on code run on the template corpus,
where the SQL holds labels made by hand. Operators on findings run on findings derived
from whole tables by arithmetic, so that SQL can say the same independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import excluded, finding_hash, java_regex, lines, suppressed
from ..operators import assess as asm
from ..operators import facts as ft
from ..operators import findings as fd
from ..operators import match
from . import corpus
from . import rules as rl
from . import scan as sc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id", "source")


def _regex_only() -> rl.Catalog:
    return rl.Catalog({**r, "patterns": [p for p in r["patterns"] if p["type"] == "regex"]} for r in rl.builtin().rules if any(p["type"] == "regex" for p in r["patterns"]))


# -- lines and text rules ---------------------------------------------------

#: Lines of a text in SQL: no further line after a final line end.
_LINES = r"""l AS (SELECT {key}, generate_subscripts(a, 1)::INTEGER AS line, unnest(a) AS text FROM (SELECT {key}, string_split(CASE WHEN {text} LIKE '%' || chr(10) THEN left({text}, length({text}) - 1) ELSE {text} END, chr(10)) a FROM {table} WHERE {text} <> ''))"""
_RULES = rl.builtin()


def _regex_sql(table: str, key: str, text: str) -> str:
    """One branch for each pattern. Lookahead patterns are tested on lines without the benign form."""
    parts = []
    for i, j, r, p in _RULES.patterns("regex"):
        pat = p["target"].replace("'", "''")
        if "(?!" in pat:
            head, rest = pat[: pat.index("(?!")], pat[pat.index("(?!") + 3 : -1]
            test = f"regexp_matches(regexp_replace(text, '{head}({rest})', '', 'g'), '{head}')"
        else:
            test = f"regexp_matches(text, '{pat}')"
        parts.append(f"SELECT {key}, line, '{r['id']}' rule_id, {i} rule_ord, {j} pattern_ord FROM l WHERE {test}")
    return f"WITH {_LINES.format(key=key, text=text, table=table)}, h AS ({' UNION ALL '.join(parts)})"


def _first_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.filter(match.may_match(F.col(text), _RULES)).select(key, F.posexplode(lines(F.col(text))).alias("i", "text"))
    hits = match.regex_hits(rows, _RULES).select(key, (F.col("i") + 1).alias("line"), "hit.rule_id", "hit.pattern_ord")
    return hits.groupBy(key, "line", "rule_id").agg(F.min("pattern_ord").alias("pattern_ord"))


@query("WITH " + _LINES.format(key="doc_id", text="text", table="documents") + " SELECT doc_id, count(*) n_lines, sum(length(text))::BIGINT chars, max(length(text))::BIGINT longest FROM l GROUP BY doc_id")
def lines_split(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.max(F.length("line")).cast("long").alias("longest"))


@query(_regex_sql("documents", "doc_id", "text") + " SELECT doc_id, line, rule_id, min(pattern_ord)::INTEGER pattern_ord FROM h GROUP BY ALL")
def regex_findings_documents(spark, sf_dir):
    return _first_hits(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_regex_sql("pages", "page_id", "html") + " SELECT page_id, line, rule_id, min(pattern_ord)::INTEGER pattern_ord FROM h GROUP BY ALL")
def regex_findings_pages(spark, sf_dir):
    return _first_hits(_table(spark, sf_dir, "pages"), "page_id", "html")


_CHAT = "(SELECT conv_id * 100000 + turn AS chat_id, text FROM conversations)"


@query(_regex_sql(_CHAT, "chat_id", "text") + " SELECT chat_id, line, rule_id, min(pattern_ord)::INTEGER pattern_ord FROM h GROUP BY ALL")
def regex_findings_conversations(spark, sf_dir):
    return _first_hits(_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("chat_id"), "text"), "chat_id", "text")


@query(r"WITH " + _LINES.format(key="doc_id", text="text", table="documents") + r""", m AS (SELECT doc_id, line, text, regexp_extract(text, '^(.*?)\b4[0-9]{12}(?:[0-9]{3})?\b', 1) head, regexp_extract(text, '\b4[0-9]{12}(?:[0-9]{3})?\b') hit FROM l WHERE regexp_matches(text, '\b4[0-9]{12}(?:[0-9]{3})?\b'))
SELECT doc_id, line, length(head)::INTEGER start_col, (length(head) + length(hit))::INTEGER end_col, hit FROM m""")
def regex_first_match_columns(spark, sf_dir):
    card = rl.Catalog([{**r, "patterns": r["patterns"][:1]} for r in _RULES.rules if r["id"] == "GDPR-ART05-003"])
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("i", "text"))
    h = match.regex_hits(rows, card)
    return h.select("doc_id", (F.col("i") + 1).alias("line"), F.col("hit.start").alias("start_col"), (F.col("hit.start") + F.col("hit.length")).alias("end_col"), F.regexp_extract("text", java_regex(card.rules[0]["patterns"][0]["target"]), 0).alias("hit"))


_COMMENT = "CASE doc_id % 5 WHEN 0 THEN 'x = 1  # auditloom:ignore EUAIA-ART12-001' WHEN 1 THEN 'y  # auditloom:ignore gdpr-art05-001, ALL' WHEN 2 THEN 'z # auditloom:ignore A-1,B-2' WHEN 3 THEN 'auditloom:ignore' ELSE 'none' END"


@query("SELECT doc_id, rule FROM documents JOIN (VALUES (0, 'EUAIA-ART12-001'), (1, 'GDPR-ART05-001'), (1, 'ALL'), (2, 'A-1,B-2')) t(k, rule) ON doc_id % 5 = k")
def suppression_tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_COMMENT).alias("line"))
    return d.select("doc_id", F.explode(suppressed(F.col("line"))).alias("rule"))


# -- rules ------------------------------------------------------------------

@query(r"""WITH r(rule_id, article) AS (VALUES """ + ", ".join("('{}', '{}')".format(r["id"], r["article"]) for r in _RULES.rules) + r"""), a AS (SELECT rule_id, unnest(regexp_extract_all(rule_id || ' ' || article, '(?i)art(?:icle)?\.?\s*(\d+)', 1)) n FROM r)
SELECT DISTINCT rule_id, ltrim(n, '0') AS article_number FROM a""")
def active_rules_by_article(spark, sf_dir):
    """Every article that some rule names, by the selection that a scan makes."""
    rows = [(r, str(n)) for n in range(1, 100) for r in _RULES.for_articles([f"Art. {n:02}"]).ids()]
    return spark.createDataFrame(rows, "rule_id string, article_number string")


@query("WITH r(rule_id) AS (VALUES " + ", ".join(f"('{x}')" for x in _RULES.ids()) + ") SELECT rule_id FROM r WHERE rule_id NOT IN ('GDPR-ART05-001', 'EUAIA-ART12-001')")
def rules_without_ignored(spark, sf_dir):
    return rl.rules_table(spark, _RULES.without([" gdpr-art05-001", "EUAIA-ART12-001"])).select("rule_id")


# -- code: facts and joins against labels -----------------------------------

def _findings(spark, sf_dir) -> DataFrame:
    return sc.scan(corpus.sources(spark, sf_dir), _RULES)


_PLACE = ["path", "rule_id", "start_line"]


@query(corpus.expected_sql())
def scan_findings(spark, sf_dir):
    """All engines, suppressions and the choice of one finding per place."""
    return _findings(spark, sf_dir).select(*_PLACE)


def _ast(spark, sf_dir, *types: str) -> DataFrame:
    keep = rl.Catalog({**r, "patterns": [p for p in r["patterns"] if p["type"] in types]} for r in _RULES.rules if any(p["type"] in types for p in r["patterns"]))
    src = corpus.sources(spark, sf_dir)
    m = match.ast_findings(ft.python_facts(src), keep)
    return fd.first_of_each(fd.identified(match.without_suppressed(m, ft.suppressions(src)), keep)).select(*_PLACE)


@query("SELECT path, rule_id, start_line FROM (" + corpus.expected_sql("EUAIA-ART05-001", files=("moods.py",)) + ") WHERE start_line = 1")
def ast_import_findings(spark, sf_dir):
    return _ast(spark, sf_dir, "ast_import")


@query("SELECT path, rule_id, start_line FROM (" + corpus.expected_sql("EUAIA-ART05-002", "GDPR-ART22-001") + " UNION ALL SELECT * FROM (" + corpus.expected_sql("EUAIA-ART05-001", "GDPR-ART32-002", files=("moods.py", "client.py")) + ") WHERE start_line IN (3, 5))")
def ast_call_findings(spark, sf_dir):
    """Calls by dotted ends, with arguments where the rule asks for them."""
    return _ast(spark, sf_dir, "ast_call")


@query(corpus.expected_sql("EUAIA-ART12-001"))
def ast_absence_findings(spark, sf_dir):
    return _ast(spark, sf_dir, "ast_absence")


def _custom(*patterns: dict) -> rl.Catalog:
    base = {**_RULES.rules[0], "id": "TEST-GEN-001"}
    return rl.Catalog([{**base, "patterns": list(patterns)}])


@query("SELECT 'p' || doc_id || '/settings.py' AS path, 4 AS start_line, 'token' AS name FROM documents WHERE doc_id % 19 = 6")
def ast_assignment_findings(spark, sf_dir):
    """A custom rule: `token` set to the constant `short`."""
    m = match.ast_findings(ft.python_facts(corpus.sources(spark, sf_dir)), _custom({"type": "ast_assignment", "target": "TOKEN", "match_args": {"value": "short"}}))
    return m.select("path", "start_line", F.lower("target").alias("name"))


@query("SELECT 'p' || doc_id || '/' || name AS path, line AS start_line FROM documents JOIN (VALUES (0, 'shell_agent.py', 5), (1, 'logged_agent.py', 7)) t(k, name, line) ON doc_id % 19 = k")
def ast_function_def_findings(spark, sf_dir):
    """A custom rule: functions whose name contains `act`."""
    m = match.ast_findings(ft.python_facts(corpus.sources(spark, sf_dir)), _custom({"type": "ast_function_def", "target": "Act"}))
    return m.select("path", "start_line")


@query(corpus.expected_sql("EUAIA-ART14-002", "EUAIA-ART50-003"))
def taint_findings(spark, sf_dir):
    src = corpus.sources(spark, sf_dir)
    m = match.flow_findings(ft.python_facts(src, match.flow_specs(_RULES), ("flow",)), _RULES)
    return m.select(*_PLACE).distinct()


@query("SELECT 'p' || doc_id || '/' || name AS path, n::INTEGER step, kind AS step_type, line::INTEGER start_line FROM documents JOIN (VALUES (0, 'shell_agent.py', 0, 'source', 6), (0, 'shell_agent.py', 1, 'propagation', 7), (0, 'shell_agent.py', 2, 'sink', 8), (2, 'page.py', 0, 'source', 9), (2, 'page.py', 1, 'sink', 10), (9, 'branches.py', 0, 'source', 5), (9, 'branches.py', 1, 'sink', 8)) t(k, name, n, kind, line) ON doc_id % 19 = k")
def taint_steps(spark, sf_dir):
    src = corpus.sources(spark, sf_dir)
    m = match.flow_findings(ft.python_facts(src, match.flow_specs(_RULES), ("flow",)), _RULES)
    return m.select("path", F.posexplode("steps").alias("step", "s")).select("path", "step", "s.step_type", "s.start_line")


@query("SELECT 'p' || doc_id || '/' || name AS path, imports FROM documents JOIN (VALUES (0, 'shell_agent.py', 'openai,os'), (1, 'logged_agent.py', 'guardrails,logging,openai,os'), (2, 'page.py', 'anthropic,flask,logging'), (3, 'moods.py', 'deepface,feat,ferret'), (4, 'score.py', ''), (5, 'client.py', 'requests'), (6, 'settings.py', ''), (7, 'quiet.py', 'feat,fer'), (9, 'branches.py', 'logging,subprocess'), (18, 'plain.py', '')) t(k, name, imports) ON doc_id % 19 = k")
def import_inventory(spark, sf_dir):
    return ft.import_inventory(corpus.sources(spark, sf_dir)).select("path", F.array_join("imports", ",").alias("imports"))


@query("SELECT 'p' || doc_id || '/branches.py' AS path, a::INTEGER AS line, b::INTEGER AS next_line FROM documents JOIN (VALUES (0, 5), (5, 6), (6, 7), (6, 8), (7, 8), (8, 9), (9, 10), (10, 0)) t(a, b) ON doc_id % 19 = 9")
def cfg_edges(spark, sf_dir):
    """Edges of a function with a branch, by lines; 0 stands for entry and exit."""
    n = ft.control_flow(corpus.sources(spark, sf_dir)).filter("path LIKE '%/branches.py' AND function = 'f'")
    e = n.select("path", "line", F.explode("successors").alias("to"))
    return e.join(n.select("path", F.col("node").alias("to"), F.col("line").alias("next_line")), ["path", "to"]).select("path", "line", "next_line")


def _engine(build, *rules: str):
    def run(spark, sf_dir):
        src = corpus.sources(spark, sf_dir)
        m = match.without_suppressed(build(src, _RULES), ft.suppressions(src))
        return m.select(*_PLACE).distinct()

    return run


for _name, _build, _rules, _files in (
    ("requirements_findings", match.dependency_findings, ("EUAIA-ART05-003",), ("requirements-dev.txt",)),
    ("pyproject_findings", match.dependency_findings, ("EUAIA-ART05-003",), ("pyproject.toml",)),
    ("uvlock_findings", match.dependency_findings, ("EUAIA-ART05-003",), ("uv.lock",)),
    ("pipfile_findings", match.dependency_findings, ("EUAIA-ART05-003",), ("Pipfile",)),
    ("dockerfile_findings", match.docker_findings, ("EUAIA-ART15-004", "EUAIA-ART15-005"), ("Dockerfile", "api.dockerfile")),
    ("compose_findings", match.compose_findings, ("EUAIA-ART15-005", "EUAIA-ART15-006"), ("compose.yml",)),
):
    def _run(spark, sf_dir, build=_build, files=_files):
        return _engine(build)(spark, sf_dir).filter(F.element_at(F.split("path", "/"), -1).isin(*files))

    QUERIES[_name], ORACLES[_name] = _run, corpus.expected_sql(*_rules, files=_files)


@query("SELECT 'p' || doc_id || '/Dockerfile' AS path, (doc_id % 4 <> 3 AND doc_id % 4 <> 1) AS root, CASE doc_id % 4 WHEN 3 THEN 3 ELSE 2 END::INTEGER AS user_line FROM documents WHERE doc_id % 4 <> 1 UNION ALL SELECT 'p' || doc_id || '/Dockerfile', false, 3 FROM documents WHERE doc_id % 4 = 1")
def dockerfile_users(spark, sf_dir):
    """The final user by a fold over lines: root, a default, none at all, a literal."""
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN 'FROM a\nUSER root' WHEN 1 THEN 'FROM a\nARG U=svc\nUSER $U' WHEN 2 THEN 'USER app\nFROM a' ELSE 'FROM a\n# USER root\nUSER 1000:0' END")
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/Dockerfile")).alias("path"), text.alias("text"))
    return ft.docker_users(d).select("path", (~F.col("safe")).alias("root"), "user_line")


@query("SELECT 'p' || doc_id || '/Dockerfile' AS path, 'ENV OPENAI_API_KEY' AS target, 2 AS start_line FROM documents WHERE doc_id % 3 = 0")
def dockerfile_env_secrets(spark, sf_dir):
    """A custom rule on literal secrets in ENV and ARG."""
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN 'FROM a\nENV OPENAI_API_KEY=abcdefgh' WHEN 1 THEN 'FROM a\nENV OPENAI_API_KEY=$K' ELSE 'FROM a\nENV HF_TOKEN=abc' END")
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/Dockerfile")).alias("path"), text.alias("text"))
    return match.docker_findings(d, _custom({"type": "infra_docker", "target": "env", "match_args": {"secrets_in_env": True}})).select("path", "target", "start_line")


_WORSE = "CASE WHEN 'tainted' IN (a, b) THEN 'tainted' WHEN 'sanitized' IN (a, b) THEN 'sanitized' WHEN 'human_gated' IN (a, b) THEN 'human_gated' ELSE 'clean' END"
_STATES = "CASE {} WHEN 0 THEN 'clean' WHEN 1 THEN 'human_gated' WHEN 2 THEN 'sanitized' ELSE 'tainted' END"


@query(f"SELECT doc_id, {_WORSE} AS state FROM (SELECT doc_id, {_STATES.format('doc_id % 4')} a, {_STATES.format('(doc_id // 4) % 4')} b FROM documents)")
def lattice_join_table(spark, sf_dir):
    from ..functions.taint import LATTICE, worse_column

    order = F.array(*[F.lit(s) for s in LATTICE])
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", worse_column(F.get(order, F.pmod("doc_id", F.lit(4)).cast("int")), F.get(order, F.pmod(F.floor(F.col("doc_id") / 4), F.lit(4)).cast("int"))).alias("state"))


# -- findings: identity, dedup, roll-ups ------------------------------------
# Findings of all rules over events: a rule, a file and a line by arithmetic.

_N = len(_RULES.rules)
_RULE_VALUES = "r(rule_ord, rule_id, risk_tier, severity) AS (VALUES " + ", ".join("({}, '{}', '{}', '{}')".format(i, r["id"], r["risk_tier"], r["severity"]) for i, r in enumerate(_RULES.rules)) + ")"
_EVENTS = f"{_RULE_VALUES}, e AS (SELECT event_id, (event_id * 7 % {_N})::INTEGER rule_ord, 'src' || event_id % 40 || '/f' || event_id % 9 || '.py' AS path, (event_id % 13 + 1)::INTEGER AS start_line, 'scan' || event_id % 17 AS scan FROM events), f AS (SELECT e.*, r.rule_id, r.risk_tier, r.severity FROM e JOIN r USING (rule_ord))"
_HASH = """sha256('{"end_line": ' || start_line || ', "file_path": "' || path || '", "rule_id": "' || rule_id || '", "snippet_normalized": "line \\"' || start_line || '\\"", "start_line": ' || start_line || ', "target": "t"}')"""


def _synthetic(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id")
    text = lambda k: F.pmod("event_id", F.lit(k)).cast("string")
    df = e.select("event_id", (F.col("event_id") * 7 % _N).cast("int").alias("rule_ord"), F.concat(F.lit("src"), text(40), F.lit("/f"), text(9), F.lit(".py")).alias("path"), (F.col("event_id") % 13 + 1).cast("int").alias("start_line"), F.concat(F.lit("scan"), text(17)).alias("scan"))
    df = df.join(F.broadcast(rl.rules_table(spark, _RULES).select("rule_ord", "rule_id", "risk_tier", "severity")), "rule_ord")
    snippet = F.concat(F.lit('  line "'), F.col("start_line").cast("string"), F.lit('"\r\n'))
    return df.withColumn("id", finding_hash(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("start_line"), F.lit(" t "), snippet))


@query(f"WITH {_EVENTS} SELECT event_id, {_HASH} id FROM f")
def finding_hashes(spark, sf_dir):
    return _synthetic(spark, sf_dir).select("event_id", "id")


@query(f"WITH {_EVENTS} SELECT rule_id, path, start_line, min(event_id) AS event_id FROM f GROUP BY ALL")
def findings_dedup(spark, sf_dir):
    f = _synthetic(spark, sf_dir).withColumns({"engine": F.lit(0), "pattern_ord": F.lit(0), "ord": F.col("event_id")})
    return fd.first_of_each(f).select("rule_id", "path", "start_line", "event_id")


def _zero_filled(column: str, values: tuple[str, ...]) -> str:
    rows = ", ".join(f"('{v}')" for v in values)
    return f"WITH {_EVENTS}, v(x) AS (VALUES {rows}), k AS (SELECT DISTINCT scan FROM f) SELECT k.scan, v.x AS {column}, count(f.event_id) findings FROM k CROSS JOIN v LEFT JOIN f ON f.scan = k.scan AND f.{column} = v.x GROUP BY ALL"


@query(_zero_filled("risk_tier", rl.TIERS))
def summary_by_tier(spark, sf_dir):
    return fd.counts_by(_synthetic(spark, sf_dir), "risk_tier", "scan")


@query(_zero_filled("severity", rl.SEVERITIES))
def summary_by_severity(spark, sf_dir):
    return fd.counts_by(_synthetic(spark, sf_dir), "severity", "scan")


_RANK = "CASE risk_tier WHEN 'prohibited' THEN 0 WHEN 'high_risk' THEN 1 WHEN 'limited_risk' THEN 2 ELSE 3 END"


@query(f"WITH {_EVENTS} SELECT path, CASE min({_RANK}) WHEN 0 THEN 'prohibited' WHEN 1 THEN 'high_risk' WHEN 2 THEN 'limited_risk' ELSE 'minimal_risk' END AS risk_tier FROM f GROUP BY path")
def overall_risk_by_file(spark, sf_dir):
    return fd.overall_risk(_synthetic(spark, sf_dir), "path")


@query(f"WITH {_EVENTS} SELECT path, count(*) FILTER ({_RANK} < 1) = 0 AS passes FROM f GROUP BY path")
def policy_gate_by_file(spark, sf_dir):
    return fd.gate(_synthetic(spark, sf_dir), "high_risk", "path")


@query(f"WITH {_EVENTS} SELECT scan, sha256(string_agg(id, '|' ORDER BY id)) AS scan_id FROM (SELECT scan, {_HASH} id FROM f) GROUP BY scan")
def scan_id_by_scan(spark, sf_dir):
    return fd.scan_id(_synthetic(spark, sf_dir), "scan")


@query(f"WITH {_EVENTS}, m AS (SELECT scan, rule_id, min(event_id) p FROM f GROUP BY ALL) SELECT scan, rule_id, (row_number() OVER (PARTITION BY scan ORDER BY p) - 1)::INTEGER rule_index FROM m")
def sarif_rule_index(spark, sf_dir):
    return fd.rule_index(_synthetic(spark, sf_dir).withColumn("place", F.col("event_id")), "scan")


@query(f"WITH {_EVENTS}, a AS (SELECT rule_id, path, start_line FROM f WHERE event_id % 10 <> 0), b AS (SELECT rule_id, path, start_line FROM f WHERE event_id % 10 <> 1) SELECT *, 'new' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def baseline_diff(spark, sf_dir):
    f = _synthetic(spark, sf_dir)
    return fd.baseline_diff(f.filter("event_id % 10 <> 0"), f.filter("event_id % 10 <> 1"), ("rule_id", "path", "start_line"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents")
def source_manifest(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    m = fd.manifest(raw)
    return m.select(F.col("path").cast("long").alias("doc_id"), "sha256", "size_bytes")


@query("""SELECT source, sha256('[' || string_agg('{"path":"' || doc_id || '","sha256":"' || sha256(text) || '","size_bytes":' || octet_length(encode(text)) || '}', ',' ORDER BY doc_id::VARCHAR) || ']') AS manifest_hash FROM documents GROUP BY source""")
def manifest_fingerprint_by_source(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    return fd.manifest_fingerprint(d, "source")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'new' ELSE 'gone' END AS change FROM documents WHERE doc_id % 4 <> 3")
def changed_files(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    old = d.filter("doc_id % 4 <> 1").withColumn("sha256", F.when(F.col("doc_id") % 4 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return fd.changed_files(d.filter("doc_id % 4 <> 2"), old).select(F.col("path").cast("long").alias("doc_id"), "change")


#: Paths of two to four parts by arithmetic, for both dialects.
_PATH = ("CASE doc_id % 6 WHEN 0 THEN 'tests' WHEN 1 THEN 'src' WHEN 2 THEN 'a' WHEN 3 THEN 'a-b' WHEN 4 THEN 'docs' ELSE 'mytests' END || '/' || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'tests/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'build.d/' ELSE 'x/' END || "
         "CASE doc_id % 7 WHEN 0 THEN 'B' WHEN 1 THEN '_m' WHEN 2 THEN 'tests' ELSE 'f' END || CAST(doc_id % 11 AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.env' WHEN 2 THEN '.log' ELSE '.min.js' END")
_GLOBS = ["tests/**", "docs/**", "*.log", "src/?7.py", "a/[!f]*", "x/f[0-3].env"]


@query(f"SELECT doc_id, list_bool_or([p GLOB g OR p GLOB ('*/' || g) OR (p || '/') GLOB g OR (p || '/') GLOB ('*/' || g) FOR g IN {[g.replace('**', '*') for g in _GLOBS]}]) AS excluded FROM (SELECT doc_id, {_PATH} p FROM documents)")
def glob_exclusions(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", excluded(F.expr(_PATH), _GLOBS).alias("excluded"))


@query(f"SELECT doc_id, p AS path, (row_number() OVER (PARTITION BY doc_id % 7 ORDER BY string_split(p, '/'), doc_id))::INTEGER AS place FROM (SELECT doc_id, {_PATH} p FROM documents)")
def path_order(spark, sf_dir):
    """Paths in the order of their parts, as reports have them."""
    p = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), (F.col("doc_id") % 7).alias("scan"))
    return fd.placed(p, "scan", order=[fd.path_key(F.col("path")), F.col("doc_id")]).select("doc_id", "path", F.col("place").cast("int").alias("place"))


@query("SELECT tp, fp, tn, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) FILTER (e AND h) tp, count(*) FILTER (NOT e AND h) fp, count(*) FILTER (NOT e AND NOT h) tn, count(*) FILTER (e AND NOT h) fn FROM (SELECT doc_id % 2 = 0 AS e, doc_id % 3 <> 0 AS h FROM documents))".replace("2.0 * tp / (2 * tp + fp + fn)", "2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE))"))
def detection_quality(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 2 == 0).alias("expected"))
    return fd.detection_quality(d, d.filter("case_id % 3 <> 0"))


# -- context ----------------------------------------------------------------

_TRI = "CASE c_custkey // {} % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END"
_ANSWER_SQL = ", ".join(f"{_TRI.format(3**i % 997 + i)} AS {a}" for i, a in enumerate(asm.ANSWERS))
_CONTEXT_SQL = f"c AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' ELSE 'triage' END purpose, CASE c_custkey % 5 WHEN 0 THEN 'provider' WHEN 1 THEN 'deployer' WHEN 2 THEN 'importer' WHEN 3 THEN 'distributor' ELSE 'unknown' END AS role, {_ANSWER_SQL} FROM customer)"
_HIGH = "((annex_i_product IS TRUE AND third_party_conformity IS TRUE) OR (annex_iii_use IS TRUE AND NOT (profiling IS FALSE AND narrow_exception IS TRUE)))"
_OUT = "(is_ai IS FALSE OR eu_scope IS FALSE)"


def _contexts(spark, sf_dir) -> DataFrame:
    tri = lambda i: F.expr(_TRI.format(3**i % 997 + i).replace("//", "DIV"))
    c = _table(spark, sf_dir, "customer")
    role = F.get(F.array(*[F.lit(r) for r in ("provider", "deployer", "importer", "distributor", "unknown")]), (F.col("c_custkey") % 5).cast("int"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise("triage").alias("intended_purpose"), role.alias("role"), *[tri(i).alias(a) for i, a in enumerate(asm.ANSWERS)])


@query(f"""WITH {_CONTEXT_SQL} SELECT c_custkey, CASE WHEN NOT {_OUT} AND prohibited_practice IS TRUE THEN 'prohibited' WHEN NOT {_OUT} AND {_HIGH} THEN 'high_risk' WHEN NOT {_OUT} AND transparency IS TRUE THEN 'limited_risk'
WHEN is_ai IS TRUE AND eu_scope IS TRUE AND purpose <> '' AND role <> 'unknown' AND personal_data IS NOT NULL AND prohibited_practice IS NOT NULL AND annex_i_product IS NOT NULL AND annex_iii_use IS NOT NULL AND transparency IS NOT NULL AND gpai_provider IS NOT NULL
  AND NOT (annex_i_product IS TRUE AND third_party_conformity IS NULL) AND NOT (annex_iii_use IS TRUE AND (profiling IS NULL OR narrow_exception IS NULL)) THEN 'minimal_risk' END AS risk_tier FROM c""")
def assess_tier(spark, sf_dir):
    return asm.assess(_contexts(spark, sf_dir)).select("c_custkey", "risk_tier")


@query(f"""WITH {_CONTEXT_SQL} SELECT c_custkey, concat_ws(',', CASE WHEN purpose = '' THEN 'intended_purpose' END, CASE WHEN role = 'unknown' THEN 'role' END, CASE WHEN is_ai IS NULL THEN 'is_ai' END, CASE WHEN eu_scope IS NULL THEN 'eu_scope' END, CASE WHEN personal_data IS NULL THEN 'personal_data' END,
CASE WHEN NOT {_OUT} AND prohibited_practice IS NULL THEN 'prohibited_practice' END, CASE WHEN NOT {_OUT} AND annex_i_product IS NULL THEN 'annex_i_product' END, CASE WHEN NOT {_OUT} AND annex_iii_use IS NULL THEN 'annex_iii_use' END, CASE WHEN NOT {_OUT} AND transparency IS NULL THEN 'transparency' END, CASE WHEN NOT {_OUT} AND gpai_provider IS NULL THEN 'gpai_provider' END,
CASE WHEN NOT {_OUT} AND annex_i_product IS TRUE AND third_party_conformity IS NULL THEN 'third_party_conformity' END, CASE WHEN NOT {_OUT} AND annex_iii_use IS TRUE AND profiling IS NULL THEN 'profiling' END, CASE WHEN NOT {_OUT} AND annex_iii_use IS TRUE AND narrow_exception IS NULL THEN 'narrow_exception' END,
CASE WHEN personal_data IS TRUE AND solely_automated_significant_decision IS NULL THEN 'solely_automated_significant_decision' END) AS missing FROM c""".replace("(is_ai IS FALSE OR eu_scope IS FALSE)", "coalesce(is_ai IS FALSE OR eu_scope IS FALSE, false)"))
def assess_missing_context(spark, sf_dir):
    return asm.assess(_contexts(spark, sf_dir)).select("c_custkey", F.array_join("missing_context", ",").alias("missing"))


@query(f"""WITH {_CONTEXT_SQL} SELECT c_custkey, concat_ws(';', CASE WHEN {_OUT} THEN 'Arts. 2-3' END, CASE WHEN NOT {_OUT} AND prohibited_practice IS TRUE THEN 'Art. 5' END, CASE WHEN NOT {_OUT} AND annex_i_product IS TRUE AND third_party_conformity IS TRUE THEN 'Art. 6(1), Annex I' END,
CASE WHEN NOT {_OUT} AND annex_iii_use IS TRUE AND NOT (profiling IS FALSE AND narrow_exception IS TRUE) THEN 'Art. 6(2), Annex III' END, CASE WHEN NOT {_OUT} AND annex_iii_use IS TRUE AND profiling IS FALSE AND narrow_exception IS TRUE THEN 'Art. 6(3)-(4)' END,
CASE WHEN NOT {_OUT} AND {_HIGH} AND role = 'deployer' THEN 'Art. 26;Art. 27' END, CASE WHEN NOT {_OUT} AND {_HIGH} AND role = 'provider' THEN 'Arts. 9-15;Arts. 16-21;Arts. 43-49' END, CASE WHEN NOT {_OUT} AND transparency IS TRUE THEN 'Art. 50' END, CASE WHEN gpai_provider IS TRUE THEN 'Arts. 51-55' END,
CASE WHEN personal_data IS TRUE THEN 'GDPR Arts. 5, 6, 9, 13-14, 25, 32, 35' END, CASE WHEN personal_data IS TRUE AND solely_automated_significant_decision IS TRUE THEN 'GDPR Art. 22' END) AS articles FROM c""")
def assess_articles(spark, sf_dir):
    return asm.assess(_contexts(spark, sf_dir)).select("c_custkey", F.array_join("applicable_articles", ";").alias("articles"))
