"""Queries over generated sources, with SQL that computes what they must give.

A row's columns choose names, arguments, aliases and forms; Spark writes a source from
them and runs the engine on it, while the SQL works out the result from the columns and
the operators' definitions, without any source. The choices themselves are expressions
that both dialects read alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import manifests, requirements, strict, taint
from ..operators import assess as asm
from ..operators import facts as ft
from ..operators import findings as fd
from ..operators import match
from ..sources.srctree import scannable
from ..sources.tables import dealt
from . import report as rp
from . import scan as sc
from .catalogue import _EVENTS, _custom, _synthetic, _table, query

_C = "c_custkey"


def _choices(spark, sf_dir, table: str, key: str, **columns: str) -> DataFrame:
    """Dealt over all cores: each row becomes a source, which is parsed, or a report."""
    return dealt(_table(spark, sf_dir, table).select(F.col(key).alias("id"), *[F.expr(v).alias(k) for k, v in columns.items()]), "id")


def _chosen(table: str, key: str, **columns: str) -> str:
    return f"c AS (SELECT {key} AS id, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {table})"


def _source(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _each(df: DataFrame, f: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """f over the rows of df, which gives rows of schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for row in frame.itertuples(index=False, name=None) for r in f(row)], columns=names)

    return df.mapInPandas(run, schema)


def _as_files(df: DataFrame, name: str, text: Column) -> DataFrame:
    return df.select(F.concat(F.col("id").cast("string"), F.lit(f"/{name}")).alias("path"), text.alias("text"))


def _id() -> Column:
    return F.split("path", "/")[0].cast("long").alias("id")


# -- facts of Python --------------------------------------------------------

_NAMES = dict(
    module=f"CASE {_C} % 5 WHEN 0 THEN 'deepface' WHEN 1 THEN 'requests' WHEN 2 THEN 'openai' WHEN 3 THEN 'tools.' || lower(c_mktsegment) ELSE 'x' || CAST({_C} % 13 AS STRING) END",
    alias=f"'a' || CAST({_C} % 11 AS STRING)", param=f"CASE {_C} % 2 WHEN 0 THEN 'a' || CAST({_C} % 11 AS STRING) ELSE 'p' END",
    fn=f"CASE {_C} % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'Post' ELSE 'analyze' || CAST({_C} % 4 AS STRING) END",
    arg=f"CASE {_C} % 4 WHEN 0 THEN 'verify' ELSE 'n' END", val=f"CASE {_C} % 6 WHEN 0 THEN 'False' WHEN 1 THEN '7' WHEN 2 THEN '''Ab''' WHEN 3 THEN 'True' WHEN 4 THEN 'None' ELSE '1.5' END")


def _calls_source(c: DataFrame) -> DataFrame:
    return _as_files(c, "m.py", _source("import ", F.col("module"), " as ", F.col("alias"), "\ndef f(", F.col("param"), "):\n    ", F.col("param"), ".", F.col("fn"), "(", F.col("arg"), "=", F.col("val"), ")\n", F.col("alias"), ".", F.col("fn"), "(\n  1, ", F.col("arg"), "=", F.col("val"), ")\n"))


@query("WITH " + _chosen("customer", _C, **_NAMES) + """, v AS (SELECT *, lower(trim(val, '''')) v FROM c)
SELECT id, 3 AS start_line, 3 AS end_line, param || '.' || fn AS name, param || '.' || fn AS spelling, arg || '=' || v AS args, '    ' || param || '.' || fn || '(' || arg || '=' || val || ')' AS snippet FROM v
UNION ALL SELECT id, 4, 5, module || '.' || fn, alias || '.' || fn, arg || '=' || v, alias || '.' || fn || '(' || chr(10) || '  1, ' || arg || '=' || val || ')' FROM v""")
def generated_calls(spark, sf_dir):
    """Aliases, shadowing parameters, spelled names, constant arguments and snippets."""
    f = ft.python_facts(_calls_source(_choices(spark, sf_dir, "customer", _C, **_NAMES)), kinds=("call",))
    args = F.array_join(F.transform(F.map_entries("kwargs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["text"])), ",")
    return f.select(_id(), "start_line", "end_line", "name", "spelling", args.alias("args"), "snippet")


@query("WITH " + _chosen("customer", _C, **_NAMES) + """SELECT id, start_line FROM (SELECT id, 3 AS start_line, lower(param || '.' || fn) AS n, lower(param || '.' || fn) AS s, arg, val FROM c UNION ALL SELECT id, 4, lower(module || '.' || fn), lower(alias || '.' || fn), arg, val FROM c)
WHERE arg = 'verify' AND val = 'False' AND (n = 'requests.get' OR n LIKE '%.requests.get' OR n = 'get' OR n LIKE '%.get' OR s = 'get' OR s LIKE '%.get')""")
def generated_call_findings(spark, sf_dir):
    """A custom rule on a name's dotted end with an argument."""
    f = ft.python_facts(_calls_source(_choices(spark, sf_dir, "customer", _C, **_NAMES)))
    return match.ast_findings(f, _custom({"type": "ast_call", "target": "GET", "match_args": {"verify": False}})).select(_id(), "start_line").distinct()


_IMPORTS = dict(a=f"'m' || CAST({_C} % 7 AS STRING)", b=f"'k' || CAST({_C} % 5 AS STRING)", dots=f"CASE {_C} % 4 WHEN 0 THEN '.' WHEN 1 THEN '..' ELSE '' END", form=f"{_C} % 3")


@query("WITH " + _chosen("customer", _C, **_IMPORTS) + """SELECT id, 1 AS start_line, a || '.' || b AS name FROM c UNION ALL SELECT id, 2, a || '.' || b FROM c UNION ALL SELECT id, 2, a || '.z' FROM c UNION ALL SELECT id, 3, CASE WHEN dots = '' THEN 'q.' || b ELSE b END FROM c
UNION ALL SELECT id, 5, a FROM c WHERE form = 0""")
def generated_imports(spark, sf_dir):
    c = _choices(spark, sf_dir, "customer", _C, **_IMPORTS)
    a, b, dots = F.col("a"), F.col("b"), F.col("dots")
    text = _source("import ", a, ".", b, " as w\nfrom ", a, " import ", b, ", z as y\nfrom ", F.when(dots == "", "q").otherwise(dots), " import ", b, "\ndef f():\n    ", F.when(F.col("form") == 0, _source("import ", a)).otherwise("pass"), "\n")
    return ft.python_facts(_as_files(c, "m.py", text), kinds=("import",)).select(_id(), "start_line", "name")


@query("WITH " + _chosen("customer", _C, **_IMPORTS) + """SELECT id, concat_ws(',', CASE WHEN dots = '' THEN a || ',q' ELSE a END) AS imports FROM c""")
def generated_inventory(spark, sf_dir):
    """Top-level packages of absolute imports, once each and sorted."""
    c = _choices(spark, sf_dir, "customer", _C, **_IMPORTS)
    text = _source("from ", F.when(F.col("dots") == "", "q").otherwise(F.concat("dots", F.lit("p"))), ".r import s\nimport ", F.col("a"), ".", F.col("b"), ", ", F.col("a"), "\n")
    return ft.import_inventory(_as_files(c, "m.py", text)).select(_id(), F.array_join("imports", ",").alias("imports"))


@query("WITH " + _chosen("customer", _C, **_NAMES) + """SELECT id, 1 AS start_line, 'call' AS kind, module || '.Client' AS name, '' AS value FROM c UNION ALL SELECT id, 3, 'call', module || '.Client.' || fn, '' FROM c UNION ALL SELECT id, 4, 'call', 'x', '' FROM c
UNION ALL SELECT id, 5, 'assign', 'x', lower(trim(val, '''')) FROM c UNION ALL SELECT id, 6, 'call', 'x.' || fn, '' FROM c UNION ALL SELECT id, 7, 'assign', 'z', '3' FROM c UNION ALL SELECT id, 8, 'call', module || '.' || fn, '' FROM c""")
def generated_assignments(spark, sf_dir):
    """Instances, copies, constants and what each makes of later calls."""
    c = _choices(spark, sf_dir, "customer", _C, **_NAMES)
    m, fn = F.col("module"), F.col("fn")
    text = _source("x = ", m, ".Client()\ny = x\ny.", fn, "()\nx()\nx = ", F.col("val"), "\nx.", fn, "()\nz: int = 3\n", m, ".", fn, "()\n")
    f = ft.python_facts(_as_files(c, "m.py", text), kinds=("call", "assign"))
    return f.select(_id(), "start_line", "kind", "name", F.coalesce(F.element_at("kwargs", "value")["text"], F.lit("")).alias("value"))


_WORDS = dict(w=f"CASE {_C} % 8 WHEN 0 THEN 'catalog' WHEN 1 THEN 'Login' WHEN 2 THEN 'audit_x' WHEN 3 THEN 'trace' WHEN 4 THEN 'telemetry' WHEN 5 THEN 'structlog' WHEN 6 THEN 'plain' ELSE 'loguru' END", place=f"{_C} % 5")
_LOGS = {0: "w SIMILAR TO '.*(logging|loguru|structlog|telemetry|audit).*'", 1: "w SIMILAR TO '.*(logging|loguru|structlog|telemetry|audit).*'", 2: "lower(w) SIMILAR TO '.*(log|audit|trace|telemetry).*'", 3: "lower(w) SIMILAR TO '.*(log|audit).*'", 4: "false"}


@query("WITH " + _chosen("customer", _C, **_WORDS) + "SELECT id, CASE place " + " ".join(f"WHEN {k} THEN {v}" for k, v in _LOGS.items()) + " END AS logs FROM c")
def generated_logging_marks(spark, sf_dir):
    """A word counts as logging by substring, by its own list in imports, decorators and calls, and nowhere else."""
    w = F.col("w")
    text = F.get(F.array(_source("import ", w, "\n"), _source("from ", w, " import q\n"), _source("@", w, "\ndef f(): pass\n"), _source(w, "()\n"), _source(w, " = 1\n")), F.col("place").cast("int"))
    f = ft.python_facts(_as_files(_choices(spark, sf_dir, "customer", _C, **_WORDS), "m.py", _source(text, "g = 1\n")))
    return f.filter("kind = 'assign' AND name = 'g'").select(_id(), "logs")


_GATES = dict(w=f"CASE {_C} % 6 WHEN 0 THEN 'is_human' WHEN 1 THEN 'Approved' WHEN 2 THEN 'ready' WHEN 3 THEN 'reviewers' WHEN 4 THEN 'ok' ELSE 'CONSENTS' END", form=f"{_C} % 4", n=f"1 + {_C} % 5")


@query("WITH " + _chosen("customer", _C, **_GATES) + "SELECT id, form < 3 AND lower(w) SIMILAR TO '.*(human|approve|approval|confirm|review|authorize|consent).*' AS gate FROM c")
def generated_gates(spark, sf_dir):
    """Conditions that look like a person's approval; a word in a string does not count."""
    w = F.col("w")
    test = F.get(F.array(w, _source("x.", w, " and 1"), _source("f(", w, ")"), _source("'", w, "'")), F.col("form").cast("int"))
    g = ft.control_flow(_as_files(_choices(spark, sf_dir, "customer", _C, **_GATES), "m.py", _source("def f(x):\n    if ", test, ":\n        a()\n")))
    return g.filter("function = 'f' AND line = 2").select(_id(), F.col("human_gate").alias("gate"))


@query("WITH " + _chosen("customer", _C, **_GATES) + ", l AS (SELECT id, n, unnest(generate_series(1, n)) i FROM c) SELECT id, (i + 1)::INTEGER AS line, i::INTEGER AS place FROM l UNION ALL SELECT id, (n + 2)::INTEGER, (n + 1)::INTEGER FROM c")
def generated_flow_order(spark, sf_dir):
    """Places in reverse postorder of straight code before a return; what follows it has none."""
    c = _choices(spark, sf_dir, "customer", _C, **_GATES)
    text = _source("def f():\n", F.repeat(F.lit("    a()\n"), F.col("n").cast("int")), "    return 1\n    b()\n")
    g = ft.control_flow(_as_files(c, "m.py", text)).filter("function = 'f' AND line > 0 AND place IS NOT NULL")
    return g.select(_id(), "line", "place")


# -- taint ------------------------------------------------------------------

_TRACES = dict(a=f"{_C} % 4", b=f"{_C} % 5", c0=f"{_C} % 3", same=f"{_C} % 7")


@query("WITH " + _chosen("customer", _C, **_TRACES) + """SELECT id, CASE WHEN a = 0 AND b = 0 THEN 'clean' WHEN a = 0 THEN 'right' || b WHEN b = 0 THEN 'left' || a WHEN a < b THEN 'left' || a WHEN b < a THEN 'right' || b ELSE 'left' || a END AS both,
concat_ws(',', CASE WHEN a + b > 0 THEN 'x' END, CASE WHEN a > 0 THEN 'y' END, CASE WHEN b > 0 THEN 'z' END) AS tainted FROM c""")
def generated_state_joins(spark, sf_dir):
    """Joins of two values (the shorter trace, the earlier of equal ones) and of two states by name."""

    def one(row: tuple) -> list[tuple]:
        key, a, b = (int(x) for x in row)
        trace = lambda n, line: tuple(taint.Step("propagation", "m", line + i, 1, 0, 1) for i in range(n)) or None
        x, y = trace(a, 1), trace(b, 9)
        got = taint.either(x, y)
        state = taint.merged({k: t for k, t in (("x", x), ("y", x)) if t}, {k: t for k, t in (("x", y), ("z", y)) if t})
        assert state == taint.merged(state, None) and state.get("x") == got
        return [(key, "clean" if got is None else f"{'left' if got[0].line == 1 else 'right'}{len(got)}", ",".join(sorted(state)))]

    return _each(_choices(spark, sf_dir, "customer", _C, **_TRACES).select("id", "a", "b"), one, "id long, both string, tainted string")


_FLOWS = dict(v=f"'v' || CAST({_C} % 9 AS STRING)", clean=f"{_C} % 4 = 0", copies=f"{_C} % 3", other=f"{_C} % 5 = 0", late=f"{_C} % 7 = 0")


@query("WITH " + _chosen("customer", _C, **_FLOWS) + """, f AS (SELECT *, 3 + copies AS sink FROM c WHERE NOT clean AND NOT other AND NOT late)
SELECT id, sink::INTEGER AS start_line, 'source' || CASE WHEN copies > 0 THEN repeat(',propagation', copies) ELSE '' END || ',sink' AS kinds FROM f""")
def generated_flows(spark, sf_dir):
    """A chain of copies from a source to a sink; a sanitizer, another value, or a sink before the source breaks it."""
    c = _choices(spark, sf_dir, "customer", _C, **_FLOWS)
    v = F.col("v")
    step = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("copies"), F.concat(F.lit("    "), v, F.lit("_"), (i + 1).cast("string"), F.lit(" = "), v, F.when(i > 0, F.concat(F.lit("_"), i.cast("string"))).otherwise(""), F.lit(" + ''\n"))).otherwise(""))
    last = F.concat(v, F.when(F.col("copies") > 0, F.concat(F.lit("_"), F.col("copies").cast("string"))).otherwise(""))
    given = F.when(F.col("other"), F.lit("'ls'")).when(F.col("clean"), F.concat(F.lit("guard.clean("), last, F.lit(")"))).otherwise(last)
    text = F.when(F.col("late"), _source("def f(", v, "):\n    os.system(", v, ")\n    ", v, " = model.generate()\n")).otherwise(_source("def f():\n    ", v, " = model.generate()\n", F.array_join(step, ""), "    os.system(", given, ")\n"))
    rule = _custom({"type": "data_flow", "target": "", "data_flow": {k: [{"target": t}] for k, t in (("sources", "model.generate"), ("sanitizers", "guard.clean"), ("sinks", "os.system"))}})
    m = match.flow_findings(ft.python_facts(_as_files(c, "m.py", text), match.flow_specs(rule), ("flow",)), rule)
    return m.select(_id(), "start_line", F.array_join(F.transform("steps", lambda s: s["step_type"]), ",").alias("kinds"))


# -- manifests and reading --------------------------------------------------

_REQ = dict(name=f"CASE {_C} % 6 WHEN 0 THEN 'Py_Feat' WHEN 1 THEN 'deep-Face' WHEN 2 THEN '-bad' WHEN 3 THEN 'a.b__c' WHEN 4 THEN 'x' || CAST({_C} % 100 AS STRING) ELSE 'a b' END",
            version=f"CASE {_C} % 5 WHEN 0 THEN '' WHEN 1 THEN '>=1.0' WHEN 2 THEN '=>1' WHEN 3 THEN '==1.*,<2' ELSE '>=1 <2' END",
            marker=f"CASE {_C} % 7 WHEN 0 THEN '; os_name == ''posix''' WHEN 1 THEN '; wrong == ''x''' WHEN 2 THEN '; os_name' WHEN 3 THEN '; python_version < ''3.9'' and extra in ''a''' ELSE '' END")


@query("WITH " + _chosen("customer", _C, **_REQ) + "SELECT id, (name <> '-bad' AND name <> 'a b' AND version NOT IN ('=>1', '>=1 <2') AND marker NOT IN ('; os_name', '; wrong == ''x''')) AS accepted FROM c")
def generated_requirements(spark, sf_dir):
    def one(row: tuple) -> list[tuple]:
        try:
            requirements.line(row[1])
        except requirements.Malformed:
            return [(row[0], False)]
        return [(row[0], True)]

    return _each(_choices(spark, sf_dir, "customer", _C, **_REQ).select("id", F.concat("name", "version", "marker")), one, "id long, accepted boolean")


@query("WITH " + _chosen("customer", _C, **_REQ) + "SELECT id, lower(regexp_replace(CASE WHEN name = 'a b' THEN 'a' ELSE name END, '[-_.]+', '-', 'g')) AS package, 2 AS line FROM c")
def generated_packages(spark, sf_dir):
    """Names of requirement lines in normal form, at the second line."""
    c = _choices(spark, sf_dir, "customer", _C, **_REQ)
    p = ft.requirement_packages(_as_files(c, "requirements.txt", _source("# x\n", F.col("name"), F.col("version"), "\n")))
    return p.select(_id(), "package", "line")


_PROJECT = dict(n=f"{_C} % 4", m=f"{_C} % 3", hit=f"{_C} % 5")


@query("WITH " + _chosen("customer", _C, **_PROJECT) + """, d AS (SELECT id, n, m, unnest(generate_series(1, n + m)) k, hit FROM c)
SELECT id, (CASE WHEN k <= n THEN 2 + k ELSE 4 + k END)::INTEGER AS start_line FROM d WHERE k = hit""")
def generated_pyproject_findings(spark, sf_dir):
    """The line of a dependency in one of two lists; `hit` names which of them the rule is about."""
    c = _choices(spark, sf_dir, "customer", _C, **_PROJECT)
    rows = lambda a, b: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: (i > a) & (i <= b)), lambda i: F.concat(F.lit("  'lib_"), F.when(i == F.col("hit"), "Hit.x").otherwise(F.concat(F.lit("n"), i.cast("string"))), F.lit(">=1',\n"))), "")
    text = _source("[project]\ndependencies = [\n", rows(F.lit(0), F.col("n")), "]\noptional-dependencies.z = [\n", rows(F.col("n"), F.col("n") + F.col("m")), "]\n")
    found = match.dependency_findings(_as_files(c, "pyproject.toml", F.replace(text, F.lit("Hit.x"), F.lit("Hit_x"))), _custom({"type": "infra_dependency", "target": "lib-hit.X"}))
    return found.select(_id(), "start_line")


_DOCKER = dict(arg=f"CASE {_C} % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'app' WHEN 2 THEN '0' ELSE '' END", use=f"CASE {_C} % 5 WHEN 0 THEN 'U' WHEN 1 THEN 'U:-svc' WHEN 2 THEN 'V' WHEN 3 THEN 'V:-svc' ELSE 'V:-0' END", stage=f"{_C} % 3 = 0")


@query("WITH " + _chosen("customer", _C, **_DOCKER) + """, u AS (SELECT *, CASE WHEN use LIKE 'U%' THEN arg WHEN use LIKE '%:-%' THEN substr(use, 4) ELSE '${V}' END AS who FROM c)
SELECT id, (stage OR who IN ('', 'root', '0') OR who LIKE '$%') AS root, CASE WHEN stage THEN 4 ELSE 3 END::INTEGER AS user_line FROM u""")
def generated_users(spark, sf_dir):
    """The last stage's user: by variables, their defaults, or none."""
    c = _choices(spark, sf_dir, "customer", _C, **_DOCKER)
    text = _source("FROM a\nARG U=", F.col("arg"), "\nUSER ${", F.col("use"), "}\n", F.when(F.col("stage"), "FROM b\n").otherwise(""))
    return ft.docker_users(_as_files(c, "Dockerfile", text)).select(_id(), (~F.col("safe")).alias("root"), "user_line")


_INPUTS = dict(form=f"{_C} % 9", k=f"{_C} % 2")


@query("WITH " + _chosen("customer", _C, **_INPUTS) + "SELECT id FROM c WHERE form IN (1, 3, 4, 6) OR form = 8 AND k = 1")
def generated_validation(spark, sf_dir):
    """Inputs that can't be read in full: syntax, shape, repeated keys, a reference to nothing."""
    name = F.array(*[F.lit(n) for n in ("a.py", "a.py", "pyproject.toml", "pyproject.toml", "Pipfile.lock", "Pipfile.lock", "compose.yml", "compose.yml", "requirements.txt")])
    text = F.array(*[F.lit(t) for t in ("x = 1\n", "def f(:\n", "[project]\ndependencies = ['a']\n", "[project]\ndependencies = 'a'\n", '{"default": {"a": 1, "a": 2}}', '{"default": {"a": {}}}', "services: [1]\n", "services:\n  a:\n    image: b\n")],
                   F.when(F.col("k") == 1, "-r missing.txt\n").otherwise("a>=1\n"))
    c = _choices(spark, sf_dir, "customer", _C, **_INPUTS)
    src = c.select(F.concat(F.col("id").cast("string"), F.lit("/"), F.get(name, F.col("form").cast("int"))).alias("path"), F.get(text, F.col("form").cast("int")).alias("text"))
    return ft.validation_errors(src).select(_id())


_JSON = dict(a=f"{_C} % 3", b=f"{_C} % 4", odd=f"{_C} % 6")


@query("WITH " + _chosen("customer", _C, **_JSON) + "SELECT id, (a <> b AND odd <> 5) AS accepted FROM c")
def generated_json(spark, sf_dir):
    """Keys that repeat and numbers that JSON does not have are refused."""

    def one(row: tuple) -> list[tuple]:
        key, a, b, odd = (int(x) for x in row)
        try:
            return [(key, strict.load_json(f'{{"o": {{"k{a}": 1, "k{b}": {"NaN" if odd == 5 else "2"}}}}}') is not None)]
        except ValueError:
            return [(key, False)]

    return _each(_choices(spark, sf_dir, "customer", _C, **_JSON), one, "id long, accepted boolean")


_BYTES = dict(form=f"{_C} % 6", word=f"'w' || CAST({_C} % 50 AS STRING)")


@query("WITH " + _chosen("customer", _C, **_BYTES) + "SELECT id, CASE form WHEN 0 THEN 'ñ' || word WHEN 1 THEN 'ñ' || word WHEN 2 THEN 'error' WHEN 3 THEN 'ñ' || word WHEN 4 THEN 'Ã±' || word ELSE 'ñ' || word END AS text FROM c")
def generated_encodings(spark, sf_dir):
    """UTF-8 with and without a mark, a declared encoding in either of two lines, none for other bytes."""
    heads = ["", "# coding: latin-1\n", "", "\ufeff", "#!x\n# -*- coding: iso-8859-1 -*-\n", "x = 1\n# coding: latin-1\n"]

    def one(row: tuple) -> list[tuple]:
        key, form, word = row
        data = (heads[form].encode() + (("ñ" + word).encode("latin-1" if form in (1, 2) else "utf-8")))
        try:
            return [(key, manifests.decode("a.py", data).split("\n")[-1])]
        except ValueError:
            return [(key, "error")]

    return _each(_choices(spark, sf_dir, "customer", _C, **_BYTES), one, "id long, text string")


_FILES = dict(name=f"CASE {_C} % 7 WHEN 0 THEN 'Dockerfile.' WHEN 1 THEN 'my-compose.' WHEN 2 THEN '.env.' WHEN 3 THEN 'a.b.' WHEN 4 THEN 'uv.' WHEN 5 THEN '.' ELSE 'r.evidence.' END || CASE {_C} % 8 WHEN 0 THEN 'py' WHEN 1 THEN 'JSON' WHEN 2 THEN 'md' WHEN 3 THEN 'lock' WHEN 4 THEN 'sarif' WHEN 5 THEN 'env' WHEN 6 THEN 'java' ELSE 'ts' END")


@query("WITH " + _chosen("customer", _C, **_FILES) + """, n AS (SELECT id, lower(name) n FROM c)
SELECT id, NOT (n LIKE '%.evidence.json' OR n LIKE '%.sarif') AND (n SIMILAR TO '.+[.](py|json|env|lock|ts)' OR n SIMILAR TO '[.]env([.].*)?' OR n LIKE '%dockerfile%' OR n LIKE '%compose%') AS scanned FROM n""")
def generated_file_names(spark, sf_dir):
    return _each(_choices(spark, sf_dir, "customer", _C, **_FILES), lambda r: [(r[0], scannable(r[1]))], "id long, scanned boolean")


# -- reports ----------------------------------------------------------------

_CHARS = dict(code=f"1 + {_C} % 700")
_HEX = "lower(lpad(hex(code), 4, '0'))"


@query("WITH " + _chosen("customer", _C, **_CHARS) + f""", h AS (SELECT id, code, lpad(printf('%x', code), 4, '0') hex FROM c)
SELECT id, CASE WHEN code IN (9, 10) THEN 'a' || chr(code::INTEGER) || 'b' WHEN code < 32 OR code BETWEEN 127 AND 159 OR code = 173 THEN 'a\\u' || hex || 'b' ELSE 'a' || chr(code::INTEGER) || 'b' END AS shown,
CASE WHEN code = 10 THEN 'a / b' WHEN code = 9 THEN 'a' || chr(9) || 'b' WHEN code < 32 OR code BETWEEN 127 AND 159 OR code = 173 THEN 'a\\\\u' || hex || 'b' WHEN code = 38 THEN 'a&amp;b' WHEN code = 60 THEN 'a&lt;b' WHEN code = 62 THEN 'a&gt;b' WHEN code = 34 THEN 'a&quot;b' WHEN code = 39 THEN 'a&\\#x27;b'
WHEN code = 124 THEN 'a&#124;b' WHEN contains('\\`*_[]{{}}()#+~', chr(code::INTEGER)) THEN 'a\\' || chr(code::INTEGER) || 'b' ELSE 'a' || chr(code::INTEGER) || 'b' END AS inline FROM h""")
def generated_escapes(spark, sf_dir):
    """One character between two letters, as shown in a terminal and in one line of Markdown."""
    return _each(_choices(spark, sf_dir, "customer", _C, **_CHARS), lambda r: [(r[0], rp.display(f"a{chr(r[1])}b"), rp.safe(f"a{chr(r[1])}b"))], "id long, shown string, inline string")


_SARIF = dict(severity=f"CASE {_C} % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END", rule=f"CASE {_C} % 2 WHEN 0 THEN 'GDPR-ART0' ELSE 'EUAIA-ART1' END || CAST({_C} % 7 AS STRING)",
              path=f"'a b/' || CASE {_C} % 3 WHEN 0 THEN 'c#' WHEN 1 THEN 'ñ' ELSE 'x%y' END || CAST({_C} % 10 AS STRING) || '.py'", line=f"1 + {_C} % 40")


@query("WITH " + _chosen("customer", _C, **_SARIF) + """SELECT id, CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' WHEN 'INFO' THEN 'none' ELSE 'error' END AS level, replace(replace(replace(replace(path, '%', '%25'), ' ', '%20'), '#', '%23'), 'ñ', '%C3%B1') AS uri,
CASE WHEN rule LIKE 'GDPR%' THEN 'https://eur-lex.europa.eu/eli/reg/2016/679/oj' ELSE 'https://eur-lex.europa.eu/eli/reg/2024/1689/oj' END AS help, replace(rule, '-', '_') AS name, (line + 1)::BIGINT AS first_column FROM c""")
def generated_sarif_fields(spark, sf_dir):
    """A report of one finding for each row: level, place, help and name as the log has them."""

    def one(row: tuple) -> list[tuple]:
        key, severity, rule, path, line = row
        place = {"file_path": path, "start_line": line, "end_line": line, "start_col": line, "end_col": line}
        finding = {"id": "i", "rule_id": rule, "article": "a", "severity": severity, "risk_tier": "t", "title": "t", "message": "m", "remediation": "r", "max_fine": "f", "confidence": 1.0, "location": place, "code_snippet": None, "flow_steps": None}
        log = json.loads(rp.to_sarif(sc.Report("s", "2026-01-01", "p", {}, [finding], {}, [], "m", [], "r", "c", {}, {})))["runs"][0]
        result, known = log["results"][0], log["tool"]["driver"]["rules"][0]
        where = result["locations"][0]["physicalLocation"]
        return [(key, result["level"], where["artifactLocation"]["uri"], known["helpUri"], known["name"], where["region"]["startColumn"])]

    return _each(_choices(spark, sf_dir, "customer", _C, **_SARIF), one, "id long, level string, uri string, help string, name string, first_column long")


@query(f"WITH {_EVENTS}, n AS (SELECT scan, count(*) n FROM f GROUP BY scan) SELECT scan, (2 * n)::INTEGER AS findings_count, length(scan) = 5 AS completed FROM n")
def sarif_result_counts(spark, sf_dir):
    """Logs of two runs each, counted as a build step does; some say that a run failed."""
    f = _synthetic(spark, sf_dir).groupBy("scan").agg(F.collect_list(F.struct(F.col("rule_id").alias("ruleId"))).alias("results"))
    run = F.struct("results", F.array(F.struct((F.length("scan") == 5).alias("executionSuccessful"))).alias("invocations"))
    return fd.sarif_counts(f.select("scan", F.to_json(F.struct(F.array(run, run).alias("runs"))).alias("sarif")), "scan")


@query("""SELECT c_custkey AS id, sha256('{"a":' || (c_custkey % 9) || ',"k":["' || c_mktsegment || '",' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'null' END || '],"z":"\\u00f1' || c_name || '"}') AS digest FROM customer""")
def generated_fingerprints(spark, sf_dir):
    """Digests of compact canonical JSON with sorted keys in ASCII."""
    c = _choices(spark, sf_dir, "customer", _C, a=f"{_C} % 9", segment="c_mktsegment", yes=f"{_C} % 2 = 0", name="c_name")
    return _each(c, lambda r: [(r[0], sc.fingerprint({"z": "ñ" + r[4], "k": [r[2], True if r[3] else None], "a": int(r[1])}))], "id long, digest string")


_PLACES = "engine, CASE WHEN engine IN (1, 4) THEN start_line ELSE 0 END, CASE WHEN engine = 1 THEN id END NULLS FIRST, rule_ord, pattern_ord, ord"


@query(f"WITH {_EVENTS} SELECT event_id, (row_number() OVER (PARTITION BY scan ORDER BY string_split(path, '/'), {_PLACES}, event_id))::INTEGER AS place FROM (SELECT *, (event_id % 5)::INTEGER engine, (event_id % 3)::INTEGER pattern_ord, event_id % 7 AS ord, lpad((event_id * 37 % 101)::VARCHAR, 3, '0') id FROM f)")
def finding_order(spark, sf_dir):
    """Findings in a report's order: files by parts, engines, then each engine's own order."""
    e = F.col("event_id")
    f = _synthetic(spark, sf_dir).withColumns({"engine": (e % 5).cast("int"), "pattern_ord": (e % 3).cast("int"), "ord": e % 7, "id": F.lpad((e * 37 % 101).cast("string"), 3, "0")})
    order = [*fd.report_order(), F.col("event_id")]
    return fd.placed(f, "scan", order=order).select("event_id", F.col("place").cast("int").alias("place"))


# -- context ----------------------------------------------------------------

_FORM = dict(q1=f"CASE {_C} % 4 WHEN 0 THEN 'scoring' ELSE 'none' END", q2=f"CASE {_C} % 3 WHEN 0 THEN 'hiring' ELSE 'none' END", q3=f"CASE {_C} % 5 WHEN 0 THEN 'chat' ELSE 'none' END")


@query("WITH " + _chosen("customer", _C, **_FORM) + "SELECT id, CASE WHEN q1 <> 'none' THEN 'prohibited' WHEN q2 <> 'none' THEN 'high_risk' WHEN q3 <> 'none' THEN 'limited_risk' END AS risk_tier FROM c")
def assess_short_form(spark, sf_dir):
    """Three questions; `none` leaves a question open, so no answer gives the lowest tier."""
    return asm.provisional(_choices(spark, sf_dir, "customer", _C, **_FORM)).select("id", "risk_tier")
