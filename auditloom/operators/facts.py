"""Facts of sources as tables. sources: path, text."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cfg, manifests, pyfacts, taint
from ..functions.text import MARKER, lines, package_name, strip, suppressed
from ..sources.tables import sliced

_STEP = "struct<step_type:string,message:string,start_line:int,end_line:int,start_col:int,end_col:int,snippet:string>"
FACTS = f"path string, ord int, kind string, name string, spelling string, start_line int, end_line int, start_col int, end_col int, snippet string, kwargs map<string,struct<text:string,items:array<string>>>, logs boolean, spec int, steps array<{_STEP}>"
_TEXT, _INT = pa.string(), pa.int32()
#: The same for Arrow.
_FACT_ROWS = pa.schema({"path": _TEXT, "ord": _INT, "kind": _TEXT, "name": _TEXT, "spelling": _TEXT, "start_line": _INT, "end_line": _INT, "start_col": _INT, "end_col": _INT, "snippet": _TEXT,
                        "kwargs": pa.map_(_TEXT, pa.struct({"text": _TEXT, "items": pa.list_(_TEXT)})), "logs": pa.bool_(), "spec": _INT,
                        "steps": pa.list_(pa.struct({"step_type": _TEXT, "message": _TEXT, "start_line": _INT, "end_line": _INT, "start_col": _INT, "end_col": _INT, "snippet": _TEXT}))})


def kind(path: Column) -> Column:
    """What a file is, by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    # A suffix needs something before it: `.py` alone is a name.
    return (F.when(name.rlike(r"[^.].*\.pyw?$|..\.pyw?$"), "python").when(name.startswith("requirements") & name.endswith(".txt"), "requirements")
            .when(name == "pyproject.toml", "pyproject").when(name == "uv.lock", "uvlock").when(name.isin("pipfile", "pipfile.lock"), "pipfile")
            .when(name.contains("dockerfile"), "dockerfile").when(name.contains("compose") & name.rlike(r"\.ya?ml$"), "compose").otherwise("text"))


def _value(v: object) -> dict:
    return {"text": str(v).lower(), "items": [str(x).lower() for x in v] if isinstance(v, list) else None}


def file_facts(path: str, text: str, specs: list[dict], kinds: tuple[str, ...] | None = None) -> list[tuple]:
    tree = ast.parse(text)
    reader = pyfacts.read(tree)
    rows = text.splitlines()
    part = lambda a, b: "\n".join(rows[a - 1 : b]) if 1 <= a <= len(rows) else ""
    where = lambda n: (n.lineno, n.end_lineno or n.lineno, n.col_offset, n.end_col_offset or 0)
    out = []
    for i, f in enumerate(reader.facts):
        if kinds is None or f.kind in kinds:
            at = where(f.node)
            out.append((path, i, f.kind, f.name, f.spelling, *at, part(at[0], at[1]), [(k, _value(v)) for k, v in f.values.items()], reader.logs, None, None))
    if specs and (kinds is None or "flow" in kinds):
        spelled = {f.node: f.spelling for f in reader.facts if f.kind == "call"}
        for i, h in enumerate(taint.flows(tree, specs, reader.calls, spelled)):
            at = where(h.call)
            steps = [{"step_type": s.kind, "message": s.message, "start_line": s.line, "end_line": s.end_line, "start_col": s.col, "end_col": s.end_col, "snippet": part(s.line, s.end_line)} for s in h.steps]
            out.append((path, i, "flow", h.name, "", *at, part(at[0], at[1]), [], reader.logs, h.spec, steps))
    return out


def python_facts(sources: DataFrame, specs: list[dict] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All facts of Python files, each parsed once; flows of the given specs among them. With kinds, only facts
    of these leave Python."""
    specs = specs or []
    only = sources.select("path", "text").filter(kind(F.col("path")) == "python")
    return only.mapInArrow(lambda batches: sliced(batches, lambda p, t: file_facts(p, t, specs, kinds), _FACT_ROWS), FACTS)


def import_inventory(sources: DataFrame) -> DataFrame:
    """path, imports: sorted top-level packages; files without any keep an empty list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "imports": [pyfacts.import_roots(ast.parse(t)) for t in frame["text"]]})

    return sources.select("path", "text").filter(kind(F.col("path")) == "python").mapInPandas(run, "path string, imports array<string>")


def control_flow(sources: DataFrame) -> DataFrame:
    """path, function, node, kind, line, human_gate, place (in reverse postorder, null if
    control never gets there), successors of every statement."""

    def statements(path: str, text: str) -> list[tuple]:
        rows = []
        for name, g in cfg.graphs(ast.parse(text)):
            place = {n: i for i, n in enumerate(g.order())}
            rows += [(path, name, n, k, line, gate, place.get(n), sorted(b for a, b in g.edges if a == n)) for n, k, line, gate in g.nodes]
        return rows

    schema = pa.schema({"path": _TEXT, "function": _TEXT, "node": _INT, "kind": _TEXT, "line": _INT, "human_gate": pa.bool_(), "place": _INT, "successors": pa.list_(_INT)})
    only = sources.select("path", "text").filter(kind(F.col("path")) == "python")
    return only.mapInArrow(lambda batches: sliced(batches, statements, schema), "path string, function string, node int, kind string, line int, human_gate boolean, place int, successors array<int>")


def line_table(sources: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line."""
    return sources.select("path", F.posexplode(lines(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def suppressions(sources: DataFrame, marker: str = MARKER, strip_chars: str = ",;") -> DataFrame:
    """path, line, rule of every inline suppression. Only files with the marker are split."""
    marked = line_table(sources.filter(F.contains("text", F.lit(marker)))).filter(F.contains("text", F.lit(marker)))
    return marked.select("path", "line", F.explode(suppressed(F.col("text"), marker, strip_chars)).alias("rule"))


def requirement_packages(sources: DataFrame) -> DataFrame:
    """path, line, text, package of requirement lines; an egg's name goes before the line's head."""
    rows = line_table(sources.filter(kind(F.col("path")) == "requirements"))
    clean = strip(F.regexp_replace("text", r"(?U)(?:^|\s)#.*$", ""))
    egg = F.regexp_extract(clean, r"#egg=([a-zA-Z0-9_\-.]+)", 1)
    head = F.when(~clean.rlike(r"^\S*://"), F.regexp_extract(clean, r"^([a-zA-Z0-9_\-.]+)", 1)).otherwise("")
    name = F.when(egg != "", egg).otherwise(head)
    return rows.withColumn("package", package_name(name)).filter(F.col("package") != "")


def declared_packages(sources: DataFrame) -> DataFrame:
    """path, kind, package, written, text of pyproject, uv.lock and Pipfile files; the text goes along, so
    that nobody has to join it back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, manifests.kind_of(p), manifests.declared(p, t), t) for p, t in zip(frame["path"], frame["text"])]
            yield pd.DataFrame([(p, k, [{"package": a, "written": b} for a, b in d], t) for p, k, d, t in rows], columns=["path", "kind", "declared", "text"])

    only = sources.select("path", "text").filter(kind(F.col("path")).isin("pyproject", "uvlock", "pipfile"))
    files = only.mapInPandas(run, "path string, kind string, declared array<struct<package:string,written:string>>, text string")
    return files.select("path", "kind", F.inline("declared"), "text")


def compose_services(sources: DataFrame) -> DataFrame:
    """path, ord, service, privileged, user, ports, text of compose files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, [{"service": s["name"], "privileged": s["privileged"], "user": s["user"], "ports": s["ports"]} for s in manifests.services(t)], t) for p, t in zip(frame["path"], frame["text"])]
            yield pd.DataFrame(rows, columns=["path", "services", "text"])

    only = sources.select("path", "text").filter(kind(F.col("path")) == "compose")
    files = only.mapInPandas(run, "path string, services array<struct<service:string,privileged:boolean,user:string,ports:array<string>>>, text string")
    return files.select("path", F.posexplode("services").alias("ord", "s"), "text").select("path", "ord", "s.*", "text")


_ASSIGN = r"([A-Za-z_][A-Za-z0-9_]*)=(\"[^\"]*\"|'[^']*'|\S*)"
_VARIABLE = r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}|\$([A-Za-z_][A-Za-z0-9_]*)"


def _expanded(value: Column, known: Column) -> Column:
    """value with the build variables that are known, or their defaults."""
    uses = F.regexp_extract_all(value, F.lit(_VARIABLE), F.lit(0))

    def one(use: Column) -> Column:
        name = F.regexp_extract(use, r"^\$\{?([A-Za-z_][A-Za-z0-9_]*)", 1)
        found = F.get(F.filter(known, lambda k: k["name"] == name), F.lit(0))
        return F.when(found.isNotNull(), found["value"]).when(use.contains(":-"), F.regexp_extract(use, r"(?s):-(.*)\}$", 1)).otherwise(use)

    return F.array_join(F.transform(F.split(value, _VARIABLE, -1), lambda piece, i: F.concat(piece, F.coalesce(one(F.get(uses, i)), F.lit("")))), "")


def docker_users(sources: DataFrame) -> DataFrame:
    """path, lines, safe, user_line: whether the last stage ends under a user without
    privileges, and the line that decides. A fold over each file's lines in order."""
    d = sources.filter(kind(F.col("path")) == "dockerfile").select("path", lines(F.col("text")).alias("lines"))
    start = F.struct(F.lit(False).alias("safe"), F.lit(1).alias("at"), F.array().cast("array<struct<name:string,value:string>>").alias("known"))

    def step(acc: Column, row: Column) -> Column:
        line = strip(row["text"])
        parts = F.split(line, r"(?U)\s+")
        word = F.upper(F.get(parts, F.lit(0)))
        rest = F.regexp_extract(line, "(?s)^[^ ]* (.*)$", 1)
        pairs = F.arrays_zip(F.regexp_extract_all(rest, F.lit(_ASSIGN), F.lit(1)).alias("name"), F.regexp_extract_all(rest, F.lit(_ASSIGN), F.lit(2)).alias("value"))
        literal = F.transform(F.filter(pairs, lambda p: ~p["value"].contains("$")), lambda p: F.struct(p["name"].alias("name"), F.regexp_replace(p["value"], "^[\"']+|[\"']+$", "").alias("value")))
        user = F.lower(strip(F.get(F.split(_expanded(F.get(parts, F.lit(1)), acc["known"]), ":"), F.lit(0))))
        safe = (user != "") & ~user.isin("root", "0") & ~user.rlike(r"^[${]")
        state = lambda s, a, k: F.struct(s.alias("safe"), a.alias("at"), k.alias("known"))
        sets_user = (word == "USER") & (F.size(parts) > 1)
        return (F.when((line == "") | line.startswith("#"), acc).when(word == "FROM", state(F.lit(False), row["line"], acc["known"]))
                .when(word.isin("ARG", "ENV"), state(acc["safe"], acc["at"], F.concat(F.reverse(literal), acc["known"])))
                .when(sets_user, state(safe, row["line"], acc["known"])).otherwise(acc))

    numbered = F.transform("lines", lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    return d.withColumn("end", F.aggregate(numbered, start, step)).select("path", "lines", F.col("end.safe").alias("safe"), F.col("end.at").alias("user_line"))


def validation_errors(sources: DataFrame) -> DataFrame:
    """path, error for every source that can't be read in full, and for references of
    requirement files to paths that are not among the sources."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, t in zip(frame["path"], frame["text"]):
                try:
                    base = p.rsplit("/", 1)[0] + "/" if "/" in p else ""
                    for r in manifests.check_source(p, t):
                        rest = [x for x in r.path.split("/") if x not in ("", ".")]
                        rows.append((p, None, base + "/".join(rest), r.folder))
                except Exception as e:  # whatever a parser raises is a reason to fail the scan
                    rows.append((p, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300], None, None))
            yield pd.DataFrame(rows, columns=["path", "error", "reference", "folder"])

    checked = sources.select("path", "text").mapInPandas(run, "path string, error string, reference string, folder boolean")
    known = sources.select(F.col("path").alias("reference")).withColumn("_is", F.lit("file"))
    above = sources.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i - 1), "/"))).alias("reference")).distinct().withColumn("_is", F.lit("folder"))
    met = checked.join(known.unionByName(above), "reference", "left")
    lost = F.col("reference").isNotNull() & (F.col("_is").isNull() | ((F.col("_is") == "folder") & ~F.col("folder")))
    return met.withColumn("error", F.coalesce("error", F.when(lost, F.concat(F.lit("reference not found: "), "reference")))).filter("error IS NOT NULL").select("path", "error").distinct()
