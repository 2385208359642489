"""What names stand for, by joins.

A file gives rows: bindings (what a name is bound to, when, and until when its scope lasts) and
uses (a dotted name at a time). Times are places in the file's order of events. A use sees, of the
bindings of its first name that were made before it and whose scope has not ended, the one of the
innermost scope, and there the last: an interval join on file and name, followed by one
maximum. A binding to another name (`x = Client()`, `y = x.z`) is a use itself, so bindings
point at bindings; pointers are doubled round by round, so a chain of n copies takes about log n
joins. The result is what `functions.pyfacts` finds by folding over the events of one file.

The pairs of a join are those of one name in one file, which the size of files bounds.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pyfacts
from ..sources.tables import sliced, stored
from .facts import kind

#: kind `binding` or `call`. at: when the first name is looked up; t: from when a binding holds, within (start, end) of its
#: scope. head null: text is all there is. copy: an instance if what it is bound to is one; bare: the call is of a plain name.
EVENTS = "path string, kind string, at int, t int, name string, start int, end int, head string, tail string, text string, instance boolean, copy boolean, bare boolean, spelling string, start_line int, end_line int, start_col int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _parts(node: ast.AST) -> tuple[str | None, str]:
    """The first name of a dotted expression, if it has one, and the rest."""
    first = pyfacts._first_name(node)
    whole = pyfacts.dotted(node, {})
    return (first[0], whole[len(first[0]) :].lstrip(".")) if first else (None, whole)


def file_events(path: str, text: str) -> list[dict]:
    rows: list[dict] = []
    scopes: list[tuple[int, list[dict]]] = [(0, [])]
    now = 0

    def bind(at: int, name: str, **more) -> None:
        nonlocal now
        now += 1
        row = {"path": path, "kind": "binding", "at": at, "t": now, "name": name, "start": scopes[-1][0], "instance": False, "copy": False, **more}
        rows.append(row)
        scopes[-1][1].append(row)

    def leave() -> None:
        for row in scopes.pop()[1]:
            row["end"] = now

    for event, node, names in pyfacts.events(ast.parse(text)):
        now += 1
        at = now
        if event == "import":
            for name, full in pyfacts.imported(node):
                bind(at, name, text=full)
        elif event == "call":
            head, tail = _parts(node.func)
            rows.append({"path": path, "kind": "call", "at": at, "head": head, "tail": tail, "text": None if head else tail, "bare": isinstance(node.func, ast.Name), "spelling": pyfacts.dotted(node.func, {}),
                         "start_line": node.lineno, "end_line": node.end_lineno, "start_col": node.col_offset})
        elif event == "bind":
            value, named = node.value, isinstance(node.value, ast.Name)
            for name in names:
                if isinstance(value, (ast.Call, ast.Name, ast.Attribute)):
                    head, tail = _parts(value)
                    bind(at, name, head=head, tail=tail, text=None if head else tail, instance=isinstance(value, ast.Call), copy=named and not isinstance(node, ast.AnnAssign))
                else:
                    bind(at, name, text=name)
        elif event == "enter":
            scopes.append((now, []))
            for name in names:
                bind(at, name, text=name)
        elif event == "leave":
            leave()
    now += 1
    while scopes:
        leave()
    return rows


def events(sources: DataFrame) -> DataFrame:
    schema = pa.schema([(name, _ARROW[kind_]) for name, kind_ in (c.split() for c in EVENTS.split(","))])

    def rows_of(path: str, text: str) -> list[tuple]:
        return [tuple(map(row.get, schema.names)) for row in file_events(path, text)]

    only = sources.select("path", "text").filter(kind(F.col("path")) == "python")
    return only.mapInArrow(lambda batches: sliced(batches, rows_of, schema), EVENTS)


def _joined(first: Column, rest: Column) -> Column:
    """Dotted, without empty parts."""
    return F.when(first == "", rest).when(rest == "", first).otherwise(F.concat(first, F.lit("."), rest))


def _seen(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses with `to`, the time of the binding that their head has; null if it has none."""
    b = bindings.select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("t").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = uses.filter("head IS NOT NULL").select("path", "kind", "at", "t", "head").join(b, (F.col("path") == F.col("_p")) & (F.col("head") == F.col("_n")) & (F.col("_t") < F.col("at")) & (F.col("at") < F.col("_e")))
    # A use has one time; a binding with several targets is one use for each of them.
    best = met.groupBy("path", "kind", "at", "t").agg(F.max(F.struct("_s", "_t")).getField("_t").alias("to"))
    u, v = uses.alias("u"), best.alias("v")
    on = (F.col("u.path") == F.col("v.path")) & (F.col("u.kind") == F.col("v.kind")) & (F.col("u.at") == F.col("v.at")) & F.col("u.t").eqNullSafe(F.col("v.t"))
    return u.join(v, on, "left").select("u.*", "v.to")


def resolved_bindings(bindings: DataFrame) -> DataFrame:
    """path, t, text, instance of every binding: what its name stands for from then on."""
    now = _seen(bindings, bindings)
    # Where the head is bound to nothing it stands for itself, and the chain ends.
    ends = F.col("head").isNotNull() & F.col("to").isNull()
    now = now.select("path", "t", F.when(ends, _joined(F.col("head"), F.col("tail"))).otherwise(F.col("text")).alias("text"), "to", F.coalesce("tail", F.lit("")).alias("tail"), "instance", (F.col("copy") & F.col("to").isNotNull()).alias("copy"))
    while True:
        now = stored(now, "names")
        if now.filter("text IS NULL").isEmpty():
            return now.select("path", "t", "text", "instance")
        up = now.select(F.col("path").alias("_p"), F.col("t").alias("_t"), F.col("text").alias("_text"), F.col("to").alias("_to"), F.col("tail").alias("_tail"), F.col("instance").alias("_i"), F.col("copy").alias("_c"))
        met = now.filter("text IS NULL").join(up, (F.col("path") == F.col("_p")) & (F.col("to") == F.col("_t")))
        # A pointer to what is known ends; the others go on to where theirs points.
        met = met.select("path", "t", _joined(F.col("_text"), F.col("tail")).alias("text"), F.col("_to").alias("to"), _joined(F.col("_tail"), F.col("tail")).alias("tail"), F.when(F.col("copy"), F.col("_i")).otherwise(F.col("instance")).alias("instance"), (F.col("copy") & F.col("_c")).alias("copy"))
        now = now.filter("text IS NOT NULL").unionByName(met)


def resolved_calls(sources: DataFrame) -> DataFrame:
    """path, start_line, end_line, start_col, name, spelling of every call: an instance's own name if it is called itself."""
    rows = stored(events(sources), "name-events")
    bindings, calls = rows.filter("kind = 'binding'"), rows.filter("kind = 'call'")
    known = resolved_bindings(bindings).select(F.col("path").alias("_p"), F.col("t").alias("_t"), F.col("text").alias("_text"), F.col("instance").alias("_i"))
    met = _seen(calls, bindings).join(known, (F.col("path") == F.col("_p")) & (F.col("to") == F.col("_t")), "left")
    itself = F.col("bare") & F.coalesce("_i", F.lit(False))
    name = F.when(F.col("head").isNull(), F.col("tail")).when(itself, F.col("head")).otherwise(_joined(F.coalesce("_text", "head"), F.col("tail")))
    return met.select("path", "start_line", "end_line", "start_col", name.alias("name"), "spelling")
