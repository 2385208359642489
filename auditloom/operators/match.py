"""Rules against facts: equi-joins on dotted parts, theta joins only where a rule asks for
a substring, and anti-joins for suppressions.

Every engine returns the same columns (FINDING): the finding's place, target, snippet and
message, with engine, rule, pattern and fact order, so that later steps never depend on
the order of rows. Pattern tables are bounded by the catalog's limits, and therefore sent
to the executors.
"""

from __future__ import annotations

import re
import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import longest_line
from ..functions.text import java_regex, lines, match_length, match_start, package_name, strip
from ..plans.rules import KNOWN_PATTERNS, Catalog
from ..sources.tables import stored
from . import facts as ft
from . import pattern_index

FINDING = ["path", "engine", "rule_ord", "pattern_ord", "ord", "rule_id", "target", "start_line", "end_line", "start_col", "end_col", "snippet", "message", "steps"]
ENGINES = {"ast": 0, "flow": 1, "dependency": 2, "docker": 3, "regex": 4}
#: HTTP ports that count as plain, and names of build secrets.
PORTS = ("80", "8000", "5000", "8080")
SECRET_NAMES = ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "HF_TOKEN", "AWS_SECRET_ACCESS_KEY")
_STEPS = f"array<{ft._STEP}>"
#: Matches and seconds that text patterns may take for one file.
MATCH_BUDGET, SECONDS = 20_000, 2.0


def pattern_table(spark: SparkSession, catalog: Catalog, *types: str) -> DataFrame:
    """rule_ord, pattern_ord, rule_id, type, pattern (target), key (in small letters), package, need."""
    rows = [(i, j, r["id"], p["type"], p["target"], p["target"].lower(), re.sub(r"[-_.]+", "-", p["target"]).lower(),
             [(k, str(v).lower(), isinstance(v, str)) for k, v in (p.get("match_args") or {}).items()]) for i, j, r, p in catalog.patterns(*types)]
    return spark.createDataFrame(rows, "rule_ord int, pattern_ord int, rule_id string, type string, pattern string, key string, package string, need array<struct<key:string,text:string,listed:boolean>>")


def _finding(df: DataFrame, engine: str, message: Column, number: Column | None = None) -> DataFrame:
    df = df.withColumns({"engine": F.lit(ENGINES[engine]) if number is None else number, "message": message})
    if "steps" not in df.columns:
        df = df.withColumn("steps", F.lit(None).cast(_STEPS))
    return df.select(*FINDING)


def _about(text: str) -> Column:
    return F.format_string(text, F.col("target"))


def suffixes(name: Column) -> Column:
    """All dotted ends of a name: a.b.c, b.c, c."""
    parts = F.split(F.lower(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def prefixes(name: Column) -> Column:
    parts = F.split(F.lower(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def _arguments_fit() -> Column:
    def one(n: Column) -> Column:
        v = F.element_at("kwargs", n["key"])
        return F.coalesce(F.when(v["items"].isNotNull() & n["listed"], F.array_contains(v["items"], n["text"])).otherwise(v["text"] == n["text"]), F.lit(False))

    return F.forall("need", one)


AST = ("ast_import", "ast_call", "ast_assignment", "ast_absence", "ast_function_def")
_KINDS = {"ast_import": "import", "ast_assignment": "assign", "ast_function_def": "def", "data_flow": "flow"}


def python_findings(facts: DataFrame, catalog: Catalog, types: tuple[str, ...] = (*AST, "data_flow")) -> DataFrame:
    """Imports, calls, assignments, definitions, calls without logging, and flows. One pass over the
    facts and one join: a fact offers the keys by which patterns of its kind may be found."""
    flows = {(i, j): n for n, (i, j, *_) in enumerate(catalog.patterns("data_flow"))}
    table = pattern_table(facts.sparkSession, catalog, *types).withColumnRenamed("key", "wanted")
    spec = F.create_map(*[F.lit(x) for (i, j), n in flows.items() for x in (f"{i}.{j}", str(n))]) if flows else F.lit(None).cast("map<string,string>")
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    table = table.select("*", F.coalesce(F.element_at(kind, F.col("type")), F.lit("call")).alias("kind"))
    # Definitions are found by substring: all of their patterns have one key.
    table = table.withColumn("key", F.when(F.col("kind") == "def", "").when(F.col("kind") == "flow", F.element_at(spec, F.concat_ws(".", "rule_ord", "pattern_ord"))).otherwise(F.col("wanted")))
    name = F.lower("name")
    keys = (F.when(F.col("kind") == "import", prefixes(F.col("name"))).when(F.col("kind") == "call", F.array_union(suffixes(F.col("name")), suffixes(F.col("spelling"))))
            .when(F.col("kind") == "def", F.array(F.lit(""))).when(F.col("kind") == "flow", F.array(F.col("spec").cast("string"))).otherwise(F.array(name)))
    met = facts.withColumn("key", F.explode(F.array_distinct(keys))).join(F.broadcast(table), ["kind", "key"])
    met = met.filter(F.when(F.col("type") == "ast_function_def", F.contains(name, F.col("wanted"))).when(F.col("type") == "ast_absence", ~F.col("logs")).when(F.col("type").isin("ast_call", "ast_assignment"), _arguments_fit()).otherwise(True))
    flow = F.col("type") == "data_flow"
    met = met.withColumn("target", F.when(flow, F.col("name")).otherwise(F.col("pattern")))
    out = _finding(met, "ast", F.when(flow, _about("unvalidated model output reaches '%s'")).otherwise(_about("technical pattern '%s'")), F.when(flow, ENGINES["flow"]).otherwise(ENGINES["ast"]))
    return out


def ast_findings(facts: DataFrame, catalog: Catalog) -> DataFrame:
    """Imports, calls, assignments, definitions and calls without logging."""
    return python_findings(facts, catalog, AST)


def flow_specs(catalog: Catalog) -> list[dict]:
    """The flow patterns as plain lists, in order."""
    return [{k: [x["target"] for x in p["data_flow"].get(k, [])] for k in ("sources", "sanitizers", "sinks")} for _, _, _, p in catalog.patterns("data_flow")]


def flow_findings(facts: DataFrame, catalog: Catalog) -> DataFrame:
    return python_findings(facts, catalog, ("data_flow",))


def _first_line(fits) -> Column:
    """Number of the first line that fits, else 1."""
    return F.coalesce(F.array_min(F.transform("lines", lambda t, i: F.when(fits(t), i + 1))), F.lit(1))


def _at_line(df: DataFrame, line: Column, fallback: Column) -> DataFrame:
    """A whole stripped line as the place of a finding."""
    df = df.withColumn("start_line", line)
    df = df.withColumn("snippet", F.coalesce(strip(F.get("lines", F.col("start_line") - 1)), fallback))
    return df.withColumns({"end_line": F.col("start_line"), "start_col": F.lit(0), "end_col": F.length("snippet")})


def dependency_findings(sources: DataFrame, catalog: Catalog) -> DataFrame:
    table = F.broadcast(pattern_table(sources.sparkSession, catalog, "infra_dependency"))
    req = ft.requirement_packages(sources).join(table, "package")
    req = req.withColumns({"ord": F.col("line"), "target": F.col("pattern"), "start_line": F.col("line"), "end_line": F.col("line"), "snippet": strip(F.col("text")), "start_col": F.lit(0)}).withColumn("end_col", F.length("snippet"))
    said = ft.declared_packages(sources).join(table, "package").withColumn("lines", lines(F.col("text")))
    quoted = lambda t, q: F.contains(t, F.concat(F.lit(f"name = {q}"), "written", F.lit(q)))
    line = (F.when(F.col("kind") == "pyproject", _first_line(lambda t: F.contains(F.replace(F.lower(t), F.lit("_"), F.lit("-")), F.col("package"))))
            .when(F.col("kind") == "uvlock", _first_line(lambda t: quoted(t, '"') | quoted(t, "'")))
            .otherwise(_first_line(lambda t: ~F.ltrim(t).startswith("#") & F.contains(package_name(t), F.col("package")))))
    said = _at_line(said.withColumns({"ord": F.lit(0), "target": F.col("pattern")}), line, F.col("pattern"))
    message = _about("declared dependency '%s'")
    return _finding(req, "dependency", message).unionByName(_finding(said, "dependency", message))


def _for_rules(df: DataFrame, catalog: Catalog, arg: str) -> DataFrame:
    """One row for each container rule that asks for arg; the rules are literals."""
    rows = [F.struct(F.lit(i).alias("rule_ord"), F.lit(j).alias("pattern_ord"), F.lit(r["id"]).alias("rule_id")) for i, j, r, p in catalog.patterns("infra_docker") if (v := (p.get("match_args") or {}).get(arg)) and (arg != "missing_directive" or v == "USER")]
    none = F.array().cast("array<struct<rule_ord:int,pattern_ord:int,rule_id:string>>")
    return df.select("*", F.inline(F.array(*rows) if rows else none))


def docker_findings(sources: DataFrame, catalog: Catalog) -> DataFrame:
    """Root users, plain ports and secrets of Dockerfiles."""
    message = _about("infrastructure risk at '%s'")
    users = ft.docker_users(sources).filter("NOT safe").transform(_for_rules, catalog, "missing_directive")
    users = _at_line(users.withColumns({"ord": F.lit(1 << 30), "target": F.lit("missing_USER_directive")}), F.col("user_line"), F.lit("Dockerfile"))
    rows = ft.line_table(sources.filter(ft.kind(F.col("path")) == "dockerfile")).withColumn("snippet", strip(F.col("text")))
    exposed = rows.filter(F.upper("snippet").startswith("EXPOSE")).withColumn("port", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PORTS)]), lambda x: F.regexp_like(F.col("snippet"), F.concat(F.lit(r"(?U)\b"), x["p"], F.lit(r"\b"))))))
    exposed = exposed.transform(_for_rules, catalog, "insecure_http_endpoint").withColumns({"target": F.concat(F.lit("EXPOSE "), F.col("port.p")), "ord": F.col("line") * 8 + F.col("port.i")})
    value = strip(F.regexp_extract("snippet", "(?s)^[^=]*=(.*)$", 1))
    named = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(SECRET_NAMES)]), lambda x: F.contains("snippet", x["n"]))
    secret = rows.filter(F.upper("snippet").rlike("^(ENV|ARG) ") & F.col("snippet").contains("=") & (F.length(value) > 6) & ~value.rlike(r"^[${]")).withColumn("name", F.explode(named))
    secret = secret.transform(_for_rules, catalog, "secrets_in_env").withColumns({"target": F.concat(F.lit("ENV "), F.col("name.n")), "ord": F.col("line") * 8 + F.col("name.i")})
    out = _finding(users, "docker", message)
    for df in (exposed, secret):
        df = df.withColumns({"start_line": F.col("line"), "end_line": F.col("line"), "start_col": F.lit(0), "end_col": F.length("snippet")})
        out = out.unionByName(_finding(df, "docker", message))
    return out


def compose_findings(sources: DataFrame, catalog: Catalog) -> DataFrame:
    """Privileged or root services and plain ports of compose files."""
    message = _about("infrastructure risk at '%s'")
    s = ft.compose_services(sources).withColumn("lines", lines(F.col("text"))).withColumnRenamed("ord", "service_ord")
    root = s.filter(F.col("privileged") | F.get(F.split("user", ":"), F.lit(0)).isin("root", "0")).transform(_for_rules, catalog, "privileged_mode")
    root = root.withColumns({"target": F.concat(F.lit("service '"), "service", F.lit("' (privileged/root)")), "ord": F.col("service_ord") * 4096})
    root = _at_line(root, _first_line(lambda t: F.contains(t, F.concat("service", F.lit(":")))), F.col("service"))
    plain = s.select("*", F.posexplode("ports").alias("n", "port"))
    plain = plain.filter(F.exists(F.array(*[F.lit(f"{p}:{p}") for p in PORTS]), lambda x: F.contains("port", x))).transform(_for_rules, catalog, "insecure_http_endpoint")
    plain = plain.withColumns({"target": F.concat(F.lit("ports: "), "port"), "ord": F.col("service_ord") * 4096 + F.col("n") + 1})
    plain = _at_line(plain, _first_line(lambda t: F.contains(t, F.col("port"))), F.col("port"))
    return _finding(root, "docker", message).unionByName(_finding(plain, "docker", message))


HIT = "struct<rule_ord:int,pattern_ord:int,rule_id:string,target:string,start:int,length:int>"


def _text_patterns(catalog: Catalog, known: bool | None) -> list[tuple[int, int, dict, dict]]:
    """All text patterns, or the built-in ones alone, or all but these."""
    return [x for x in catalog.patterns("regex") if known is None or (x[3]["target"] in KNOWN_PATTERNS) == known]


def relaxed(pattern: str) -> str | None:
    """A pattern, as a group, that a text matches if one of its lines matches the given one: without
    the conditions on what must not stand beside a match. None where line ends enter in another way."""
    body = re.sub(r"\A\(\?[a-zA-Z]+\)", "", pattern)
    flags = pattern[2 : pattern.index(")")] if body != pattern else ""
    out, i, inside = [], 0, False
    while i < len(body):
        two = body[i : i + 2]
        if two[0] == "\\":
            if two[1:] in ("A", "Z", "z", "G"):
                return None
            out.append(two)
            i += 2
            continue
        if not inside and body.startswith(("(?!", "(?<!"), i):
            depth, j, in_class = 0, i, False
            while j < len(body):
                c = body[j]
                if c == "\\":
                    j += 1
                elif in_class:
                    in_class = c != "]"
                elif c == "[":
                    in_class = True
                else:
                    depth += (c == "(") - (c == ")")
                    if not depth:
                        break
                j += 1
            i = j + 1
            continue
        if not inside and (two[0] in "^$" or body.startswith(("(?=", "(?<="), i)):
            return None
        inside = (inside or two[0] == "[") and not (inside and two[0] == "]")
        out.append(two[0])
        i += 1
    return f"(?{flags}:{''.join(out)})"


#: Letters that ignoring case takes for ASCII ones.
_FOLDED = "\u017f\u212a\u0131\u0130"


def factors(pattern: str) -> list[str] | None:
    """Texts, in small letters, one of which is in every match; a run of digits stands as `0000`.
    None if there is nothing of three characters or more."""
    best: list[str] | None = None

    def keep(found: list[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= 3 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    run = ""
    for op, arg in _parsed(pattern):
        if op == "literal":
            run += arg
        elif op == "digits":
            keep([run])
            keep(["0" * arg])
            run = ""
        elif op == "branch":
            keep([run])
            keep([y for x in arg for y in x])
            run = ""
        elif op == "break":
            keep([run])
            run = ""
    keep([run])
    return best


_ESCAPE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|[0-9]{1,3}|.)"
_CLASS = r"\[\^?\]?(?:[^\]\\]|\\.)*\]"
#: What stands at a pattern's top level, in order of precedence. Groups that hold more than plain choices are skipped whole.
_PIECES = re.compile(rf"""(?P<nothing>\\b|\(\?<?!(?:[^()\\]|\\.)*\))|\[0-9\]\{{(?P<digits>\d+)(?:,\d*)?\}}|\((?:\?:)?(?P<branch>[\w-]+(?:\|[\w-]+)*)\)(?![?*{{])|(?P<group>\()|(?P<choice>\|)|(?P<quantity>\{{\d*,?\d*\}})
|(?P<literal>\\[^\w\s]|[^\\\[\](){{}}.*+?|^$\x80-\U0010ffff])(?![?*{{])|(?P<other>{_CLASS}|{_ESCAPE}|.)""".replace("\n", ""), re.S)


def _parsed(pattern: str) -> Iterator[tuple[str, object]]:
    """A pattern's top level: literals, runs of digits, choices of plain words, and all else as breaks."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    body, i = pattern[flags.end() if flags else 0 :], 0
    if flags and "x" in flags[1] or "|" in _outside_groups(body):
        return  # blanks that mean nothing, or a choice of the whole: nothing is sure
    while m := _PIECES.match(body, i):
        i = m.end()
        if m["group"]:
            i = _closed(body, m.start())
        if m["digits"]:
            yield "digits", int(m["digits"])
        elif m["branch"]:
            yield "branch", [[x.lower()] for x in m["branch"].split("|")]
        elif m["literal"]:
            yield "literal", m["literal"][-1].lower()
        elif not m["nothing"]:
            yield "break", None


def _closed(pattern: str, at: int) -> int:
    """The place after the group that begins at `at`."""
    depth = 0
    for m in re.compile(rf"{_CLASS}|{_ESCAPE}|.", re.S).finditer(pattern, at):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth:
            return m.end()
    return len(pattern)


def may_match(text: Column, catalog: Catalog, known: bool | None = None) -> Column:
    """Whether a whole text can have a line that some text pattern matches. A cheap test comes first,
    whether it has any of the patterns' factors; then one pass of one expression. Texts that
    can't match, which is most, are never cut into lines."""
    targets = [p["target"] for *_, p in _text_patterns(catalog, known)]
    parts = [relaxed(java_regex(t)) for t in targets]
    if not parts:
        return F.lit(False)
    if None in parts:
        return F.lit(True)
    whole = text.rlike("|".join(parts))
    return F.when(has_factor(text, targets), whole).otherwise(False)


def has_factor(text: Column, targets: list[str]) -> Column:
    """Whether a whole text has what every match of one of the patterns holds."""
    sure = [factors(t) for t in targets]
    if None in sure:
        return F.lit(True)
    digits = [len(x) for f in sure for x in f if set(x) == {"0"}]
    low, gate = F.lower(text), F.lit(False)
    for x in sorted({x for f in sure for x in f if set(x) != {"0"}}):
        gate = gate | F.contains(low, F.lit(x))
    for c in _FOLDED:
        gate = gate | F.contains(text, F.lit(c))
    if digits:
        gate = gate | text.rlike(f"[0-9]{{{min(digits)}}}")
    return gate


def _outside_groups(pattern: str) -> str:
    """A pattern's characters outside of groups, classes and escapes."""
    out, i = [], 0
    while i < len(pattern):
        m = re.compile(rf"(?P<group>\()|{_CLASS}|{_ESCAPE}|(?P<plain>.)", re.S).match(pattern, i)
        out.append(m["plain"] or "")
        i = _closed(pattern, i) if m["group"] else m.end()
    return "".join(out)


def regex_hits(lines_: DataFrame, catalog: Catalog, text: str = "text", known: bool | None = None, only: set[tuple[int, int]] | None = None) -> DataFrame:
    """lines_ with hit (rule_ord, pattern_ord, rule_id, target, start, length), one row for
    each pattern that a line matches. Patterns are literals: compiled once, no Python."""
    line, tests = F.col(text), []
    for i, j, r, p in _text_patterns(catalog, known):
        if only is not None and (i, j) not in only:
            continue
        java, fits = java_regex(p["target"]), line.rlike(java_regex(p["target"]))
        if only is not None and p["target"] not in KNOWN_PATTERNS:
            fits = (F.length(line) <= longest_line(p["target"])) & fits
        # Places are only worked out where the pattern matches.
        tests.append(F.when(fits, F.struct(F.lit(i).alias("rule_ord"), F.lit(j).alias("pattern_ord"), F.lit(r["id"]).alias("rule_id"), F.lit(p["target"]).alias("target"), match_start(line, java).alias("start"), match_length(line, java).alias("length"))))
    if not tests:
        return lines_.limit(0).withColumn("hit", F.lit(None).cast(HIT))
    return lines_.withColumn("hit", F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())))


class OverBudget(ValueError):
    """A file's patterns took more time or matches than a scan grants."""


@contextmanager
def _within(seconds: float) -> Iterator[None]:
    """TimeoutError in the block when the time is over. Python's expressions look for signals as they go, so a
    search is stopped where it is; only the main thread of a process has signals."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def over(*_: object) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, max(0.001, seconds))
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def timed_hits(lines_: DataFrame, patterns: list[tuple[int, int, str, str, int]], text: str = "text", seconds: float = SECONDS, per: str = "path") -> DataFrame:
    """lines_ with hit and error, by Python's expressions: (rule order, pattern order, rule id, target, length)
    of patterns, each for lines that are longer than its length. The lines of one `per` stand together
    and may take so many seconds and MATCH_BUDGET matches. Beyond it the file gets one row with an error,
    and no more of its lines are tried."""
    columns = lines_.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(p, re.compile(p[3])) for p in patterns]
        now, used, matched, failed = None, 0.0, 0, False
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False, name=None):
                line, of = row[columns.index(text)], row[columns.index(per)] if per in columns else None
                if of != now:
                    now, used, matched, failed = of, 0.0, 0, False
                for p, c in compiled:
                    if failed or len(line) <= p[4]:
                        continue
                    began, m = time.monotonic(), None
                    try:
                        with _within(seconds - used):
                            m = c.search(line)
                    except TimeoutError:
                        failed = True
                    used += time.monotonic() - began
                    matched += m is not None
                    if failed or used > seconds or matched > MATCH_BUDGET:
                        failed = True
                        rows.append((*row, None, f"text patterns exceed their budget for {of} (rule {p[2]})"))
                    elif m:
                        rows.append((*row, {"rule_ord": p[0], "pattern_ord": p[1], "rule_id": p[2], "target": p[3], "start": m.start(), "length": m.end() - m.start()}, None))
            yield pd.DataFrame(rows, columns=[*columns, "hit", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines_.schema.fields), f"hit {HIT}", "error string"])
    return lines_.mapInPandas(run, schema)


def _or_fail(timed: DataFrame) -> DataFrame:
    """timed without its error, which ends the job."""
    hit = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(HIT)).otherwise(F.col("hit"))
    return timed.withColumn("hit", hit).drop("error")


def regex_hits_python(lines_: DataFrame, catalog: Catalog, text: str = "text", known: bool | None = None, seconds: float = SECONDS, per: str = "path") -> DataFrame:
    """Hits by Python's expressions within a budget, for patterns that Java reads otherwise or whose time
    nobody knows. A file beyond it fails the job, which names the file and the rule."""
    patterns = [(i, j, r["id"], p["target"], -1) for i, j, r, p in _text_patterns(catalog, known)]
    if not patterns:
        return lines_.limit(0).withColumn("hit", F.lit(None).cast(HIT))
    return _or_fail(timed_hits(lines_, patterns, text, seconds, per))


#: From how many text patterns with factors on a line is looked up in an index of grams first.
INDEXED = 24


def _in_bounds(sources: DataFrame, catalog: Catalog) -> DataFrame:
    """path, line, text, hit of all text patterns on lines for which their time is known to be short."""
    patterns = [(i, j, r["id"], p["target"], factors(p["target"]), (1 << 30) if p["target"] in KNOWN_PATTERNS else longest_line(p["target"])) for i, j, r, p in _text_patterns(catalog, None)]
    patterns = [p for p in patterns if p[5] >= 0]
    index = [p for p in patterns if p[4]]
    if len(index) < INDEXED:
        index = []
    rest = {p[:2] for p in patterns if p not in index}
    trusted = {(i, j) for i, j, _, _ in _text_patterns(catalog, True)}
    table = lambda s: ft.line_table(s)
    # A text as a whole is tried only with patterns whose time is short on any text.
    custom = [p for p in patterns if p[:2] in rest - trusted]
    gate = has_factor(F.col("text"), [p[3] for p in custom]) if custom else F.lit(False)
    if rest & trusted:
        gate = gate | may_match(F.col("text"), catalog, True)
    out = regex_hits(table(sources.filter(gate)), catalog, only=rest).select("path", "line", "text", "hit")
    if index:
        out = out.unionByName(pattern_index.indexed_hits(sources, index, table))
    return out


def _beyond_bounds(sources: DataFrame, catalog: Catalog) -> DataFrame | None:
    """path, line, text, hit, error of the other lines, each pattern timed; None if there are no custom patterns."""
    patterns = [(i, j, r["id"], p["target"], longest_line(p["target"])) for i, j, r, p in _text_patterns(catalog, False)]
    if not patterns:
        return None
    least = min(p[4] for p in patterns)
    return timed_hits(ft.line_table(sources).filter(F.length("text") > least), patterns)


def timed(sources: DataFrame, catalog: Catalog) -> DataFrame | None:
    """The hits and errors of searches whose time the patterns' form does not bound, stored once; give it to
    regex_findings, and take the errors from it. None if all patterns are built in."""
    found = _beyond_bounds(sources, catalog)
    return None if found is None else stored(found, "timed-hits")


def over_time_budget(timed_: DataFrame | None, sources: DataFrame) -> DataFrame:
    """path, error of files whose patterns took too long or matched too often."""
    if timed_ is None:
        return sources.sparkSession.createDataFrame([], "path string, error string")
    return timed_.filter("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))


def regex_findings(sources: DataFrame, catalog: Catalog, python: bool | str = "bounded", timed_: DataFrame | None = None) -> DataFrame:
    """python: "bounded" runs a text pattern in the JVM on lines for which its form bounds the time, and in Python
    within a budget on the others; False runs all in the JVM, True all in Python, and "custom" those
    in Python that are not built in. timed_: what `timed` gave for these sources; failed files count for nothing."""
    jvm = lambda known: regex_hits(ft.line_table(sources.filter(may_match(F.col("text"), catalog, known))), catalog, known=known)
    if python == "bounded":
        hits = _in_bounds(sources, catalog)
        if timed_ is not None:
            hits = hits.unionByName(timed_.filter("error IS NULL").drop("error"))
        elif (more := _beyond_bounds(sources, catalog)) is not None:
            hits = hits.unionByName(_or_fail(more))
    elif python == "custom":
        hits = jvm(True)
        if _text_patterns(catalog, False):
            hits = hits.unionByName(regex_hits_python(ft.line_table(sources), catalog, known=False))
    else:
        hits = regex_hits_python(ft.line_table(sources), catalog) if python else jvm(None)
    df = hits.select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), (F.col("line") * 256 + F.col("hit.pattern_ord")).alias("ord"), "hit.rule_ord", "hit.pattern_ord", "hit.rule_id", "hit.target",
                     F.col("hit.start").alias("start_col"), (F.col("hit.start") + F.col("hit.length")).alias("end_col"), strip(F.col("text")).alias("snippet"))
    return _finding(df, "regex", _about("expression '%s' matches"))


def over_match_budget(sources: DataFrame, catalog: Catalog) -> DataFrame:
    """path, error for files with more matches of text patterns than a scan grants. A line gives one
    match for each pattern at most, so only files of many lines are looked at."""
    n = len(catalog.patterns("regex"))
    long_ = sources.filter(F.size(lines(F.col("text"))) * n > MATCH_BUDGET)
    bounded = {(i, j) for i, j, _, p in catalog.patterns("regex") if p["target"] in KNOWN_PATTERNS or longest_line(p["target"]) >= 0}
    counts = regex_hits(ft.line_table(long_), catalog, only=bounded).groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > MATCH_BUDGET)
    return counts.select("path", F.concat(F.col("n").cast("string"), F.lit(" matches of text patterns")).alias("error"))


def without_suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Left anti join: a finding goes if its first line names its rule or ALL."""
    m = marks.alias("m")
    return findings.alias("f").join(m, (F.col("f.path") == F.col("m.path")) & (F.col("f.start_line") == F.col("m.line")) & ((F.col("m.rule") == F.col("f.rule_id")) | (F.col("m.rule") == "ALL")), "left_anti")
