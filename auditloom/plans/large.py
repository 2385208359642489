"""Registered queries of what keeps scans of very many files cheap, and their SQL: scans of
changed files only, digest trees, and files against what an index publishes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import match, merkle, names
from ..sources.tables import dealt, fresh_path
from . import incremental, samples
from . import rules as rl
from . import scan as sc
from .catalogue import _LINES, _documents, _regex_only, _regex_sql, _table, query

# -- scans of changed files -------------------------------------------------
# The documents as they are, after a scan of a former state: of a hundred documents one had
# another text, one was not there, and one was there under a path that is gone.


def _former(spark, sf_dir) -> DataFrame:
    now = _documents(spark, sf_dir).filter("doc_id % 100 <> 8")
    text = F.when(F.col("doc_id") % 100 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("\nverify = False"))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 100 == 9, F.concat(F.lit("old/"), "path"))
    return now.select(F.explode(F.array_compact(F.array("path", path))).alias("path"), text.alias("text"))


def _rescanned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    store, rules = incremental.Store(spark, fresh_path(spark, "finding-store")), _regex_only()
    incremental.scan(store, _former(spark, sf_dir), rules)
    return incremental.scan(store, _documents(spark, sf_dir).select("path", "text"), rules)


_CHANGE = "CASE doc_id % 100 WHEN 7 THEN 'changed' WHEN 8 THEN 'new' ELSE 'same' END"


@query(_regex_sql("documents", "doc_id", "text") + f" SELECT DISTINCT 'd' || doc_id || '.txt' AS path, rule_id, line AS start_line, {_CHANGE} AS change FROM h")
def incremental_findings(spark, sf_dir):
    """Findings of the second scan, which parses two documents of a hundred."""
    found, changes = _rescanned(spark, sf_dir)
    return found.join(changes, "path").select("path", "rule_id", "start_line", "change")


@query(f"SELECT 'd' || doc_id || '.txt' AS path, {_CHANGE} AS change FROM documents UNION ALL SELECT 'old/d' || doc_id || '.txt', 'gone' FROM documents WHERE doc_id % 100 = 9")
def incremental_changes(spark, sf_dir):
    """What a scan finds changed since the one before, by digests alone."""
    rules = incremental.fingerprint(_regex_only())
    before = incremental._current(_former(spark, sf_dir)).withColumns({"rules": F.lit(rules), "since": F.lit(0)})
    return incremental.changes(incremental._current(_documents(spark, sf_dir)), before, rules).select("path", "change")


# -- digest trees -----------------------------------------------------------

_ENTRY = """'{"path":"' || p || '","sha256":"' || sha256(t) || '","size_bytes":' || octet_length(encode(t)) || '}'"""


def _level(below: str, digits: int, child: str) -> str:
    line = f"{child} || ':' || d"
    return f"SELECT source, left({child}, {digits}) AS p, sum(n)::BIGINT AS n, sha256(string_agg({line}, ',' ORDER BY {line})) AS d FROM {below} GROUP BY ALL"


def _entries(d: DataFrame) -> DataFrame:
    """source, path, sha256, size_bytes of source, path, text."""
    text = F.coalesce("text", F.lit(""))
    return d.select("source", "path", F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("size_bytes"))


@query(f"""WITH e AS (SELECT source, {_ENTRY} AS entry FROM (SELECT source, doc_id::VARCHAR p, coalesce(text, '') t FROM documents)),
l AS (SELECT source, sha256(entry) AS place, count(*) AS n, sha256(entry || '*' || count(*)) AS d FROM e GROUP BY source, entry),
six AS ({_level('l', 6, 'place')}), four AS ({_level('six', 4, 'p')}), two AS ({_level('four', 2, 'p')}), top AS ({_level('two', 0, 'p')})
SELECT source, 6 AS depth, p AS prefix, n AS entries, d AS digest FROM six UNION ALL SELECT source, 4, p, n, d FROM four UNION ALL SELECT source, 2, p, n, d FROM two UNION ALL SELECT source, 0, p, n, d FROM top""")
def manifest_trees(spark, sf_dir):
    """All nodes of each source's manifest tree; those of depth 0 are the digests of the manifests."""
    d = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "text")
    return merkle.tree(_entries(d), "source", entry=fd.manifest_entry()).nodes.select("source", "depth", "prefix", "entries", "digest")


@query(f"""WITH n AS (SELECT source, {_ENTRY} AS entry, {_CHANGE} <> 'new' AS old, doc_id % 100 <> 7 AS same FROM (SELECT *, 'd' || doc_id || '.txt' p, coalesce(text, '') t FROM documents)),
o AS (SELECT source, entry FROM n WHERE old AND same UNION ALL SELECT source, {_ENTRY} FROM (SELECT source, 'd' || doc_id || '.txt' p, coalesce(text, '') || chr(10) || 'verify = False' t FROM documents WHERE doc_id % 100 = 7)),
a AS (SELECT source, entry, count(*) n FROM n GROUP BY ALL), b AS (SELECT source, entry, count(*) n FROM o GROUP BY ALL)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.entry, b.entry) AS entry, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'gone' ELSE 'count' END AS change, coalesce(a.n, 0)::BIGINT AS new_copies, coalesce(b.n, 0)::BIGINT AS old_copies
FROM a FULL JOIN b ON a.entry = b.entry AND a.source IS NOT DISTINCT FROM b.source WHERE a.n IS DISTINCT FROM b.n""")
def manifest_differences(spark, sf_dir):
    """Each source's manifest against the one of its former state, from the roots down."""
    d = _documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 100 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("\nverify = False"))).otherwise(F.col("text"))
    old = d.filter("doc_id % 100 <> 8").withColumn("text", text)
    trees = [merkle.tree(_entries(x), "source", entry=fd.manifest_entry()).stored() for x in (d, old)]
    return merkle.differences(*trees).select("source", "entry", "change", "new_copies", "old_copies")


# -- published files --------------------------------------------------------

@query("""SELECT 'f' || doc_id || '.whl' AS filename, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'yanked' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def published_differences(spark, sf_dir):
    """Files against the answers of a package index, one in two by its simple form."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".whl")).alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    digest = F.struct(F.when(F.col("doc_id") % 11 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    simple = F.to_json(F.struct(F.array(F.struct("filename", F.when(F.col("doc_id") % 7 == 0, "broken").alias("yanked"), digest.alias("hashes"))).alias("files")))
    version = F.to_json(F.struct(F.array(F.struct("filename", (F.col("doc_id") % 7 == 0).alias("yanked"), digest.alias("digests"))).alias("urls")))
    answers = d.filter("doc_id % 5 <> 0").select(F.when(F.col("doc_id") % 2 == 0, simple).otherwise(version).alias("payload"))
    return fd.published_differences(d.select("filename", "sha256"), fd.published_files(answers))


# -- large catalogs ---------------------------------------------------------

_FOLLOWED = "[ ,.]+[a-z]"


@query("WITH " + _LINES.format(key="doc_id", text="text", table="documents") + f""", w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{8,}}')) w FROM benchmark), c AS (SELECT w FROM w ORDER BY sha256(w) LIMIT {rl.MAX_PATTERNS // 2})
SELECT 'd' || doc_id || '.txt' AS path, line AS start_line, w || '{_FOLLOWED}' AS target FROM l JOIN c ON contains(l.text, c.w) WHERE regexp_matches(l.text, w || '{_FOLLOWED}')""")
def large_catalog_findings(spark, sf_dir):
    """Half of the patterns that a catalog may have, of the benchmark's words, on all documents."""
    found = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("w")).distinct()
    chosen = [r["w"] for r in found.orderBy(F.sha2("w", 256)).limit(rl.MAX_PATTERNS // 2).collect()]
    base = rl.builtin().rules[0]
    rules = rl.Catalog({**base, "id": f"TEST-GEN-{k:03}", "patterns": [{"type": "regex", "target": w + _FOLLOWED}]} for k, w in enumerate(chosen))
    hits = match.regex_findings(_documents(spark, sf_dir).select("path", "text"), rules)
    return hits.select("path", "start_line", "target")


# -- the catalog against labels of its own ------------------------------------

@query(samples.expected_sql())
def catalog_samples(spark, sf_dir):
    """Every built-in rule by files that it must find, and near ones that it must not."""
    return sc.scan(samples.sources(spark, sf_dir), rl.builtin()).select("path", "rule_id", "severity", "risk_tier", "start_line")


# -- baselines over moved lines -----------------------------------------------

#: Three findings of one rule in each document, 100 lines apart, and how far an edit has moved them. Moved by 80, they
#: stand nearer to the next one's former place than to their own.
_MOVES = "f AS (SELECT 'd' || doc_id || '.txt' AS path, 'line ' || doc_id % 3 AS snippet, doc_id % 40 AS r, CASE WHEN doc_id % 10 = 3 THEN 80 ELSE doc_id % 7 END AS shift, unnest([1, 2, 3]) AS k FROM documents)"


@query(f"""WITH {_MOVES} SELECT 'moved' AS change, path, snippet, (100 * k + r + shift)::INTEGER AS start_line, (100 * k + r)::INTEGER AS old_line FROM f WHERE shift BETWEEN 1 AND 50
UNION ALL SELECT 'moved', path, snippet, (100 * k + r + shift)::INTEGER, (100 * k + 100 + r)::INTEGER FROM f WHERE shift = 80 AND k < 3
UNION ALL SELECT 'new', path, snippet, (300 + r + shift)::INTEGER, NULL FROM f WHERE shift = 80 AND k = 3 UNION ALL SELECT 'gone', path, snippet, NULL, (100 + r)::INTEGER FROM f WHERE shift = 80 AND k = 1""")
def aligned_baseline(spark, sf_dir):
    """Findings against a reviewed state, where those that only moved are neither new nor gone."""
    d = _documents(spark, sf_dir)
    shift = F.when(F.col("doc_id") % 10 == 3, 80).otherwise(F.col("doc_id") % 7)
    d = d.select("path", F.concat(F.lit("line "), (F.col("doc_id") % 3).cast("string")).alias("snippet"), (F.col("doc_id") % 40).alias("r"), shift.alias("shift"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    at = lambda more: d.select("path", "snippet", (100 * F.col("k") + F.col("r") + more).cast("int").alias("start_line"))
    return fd.aligned_diff(at(F.col("shift")), at(F.lit(0)), what=("path", "snippet"))


# -- names by joins -----------------------------------------------------------

_MODULE, _OWN = "'m' || CAST(doc_id % 5 AS STRING) || '.core'", "'x' || CAST(doc_id % 7 AS STRING)"


@query(f"""WITH c AS (SELECT doc_id AS id, {_MODULE} AS m, {_OWN} AS x, doc_id % 2 = 0 AS hidden FROM documents)
SELECT id, 2 AS start_line, m || '.Client' AS name, 'a.Client' AS spelling FROM c
UNION ALL SELECT id, 5, CASE WHEN hidden THEN 'b.run' ELSE m || '.Client.run' END, 'b.run' FROM c UNION ALL SELECT id, 6, m || '.Client.run', 'c.run' FROM c
UNION ALL SELECT id, 8, m || '.Client.part', 'd' FROM c UNION ALL SELECT id, 9, 'c', 'c' FROM c UNION ALL SELECT id, 10, m || '.' || x, 'a.' || x FROM c""")
def resolved_calls(spark, sf_dir):
    """Names of calls by interval joins of uses and bindings: imports, instances, copies, and parameters that hide them."""
    c = dealt(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", F.expr(_MODULE).alias("m"), F.expr(_OWN).alias("x"), F.when(F.col("doc_id") % 2 == 0, "b").otherwise("p").alias("p"))
    text = F.concat(F.lit("import "), "m", F.lit(" as a\nb = a.Client()\nc = b\ndef f("), "p", F.lit("):\n    b.run()\n    c.run()\n    d = c.part\n    d()\nc()\na."), "x", F.lit("()\n"))
    calls = names.resolved_calls(c.select(F.concat(F.col("doc_id").cast("string"), F.lit("/m.py")).alias("path"), text.alias("text")))
    return calls.select(F.split("path", "/")[0].cast("long").alias("id"), "start_line", "name", "spelling")
