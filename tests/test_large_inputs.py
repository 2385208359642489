"""Steps whose work or memory must not grow with a task's input."""

import ast
import tracemalloc

import pandas
import pyarrow as pa
import pytest

from auditloom.functions import pyfacts, taint
from auditloom.operators import facts, names
from auditloom.plans import generated, report, scan
from auditloom.sources import tables

SF = "/root/testdata/sf0.001"


# -- rows over all cores ----------------------------------------------------

@pytest.mark.parametrize("name", ["generated_sarif_fields", "generated_flows", "generated_assignments", "generated_gates", "generated_json"])
def test_a_narrow_table_is_dealt_over_all_cores(spark, name):
    got = getattr(generated, name)(spark, SF)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_a_report_builds_no_frame(monkeypatch):
    place = {"file_path": "a.py", "start_line": 1, "end_line": 1, "start_col": 0, "end_col": 1}
    rows = [{"id": f"i{k}", "rule_id": rule, "article": "a", "severity": "LOW", "risk_tier": "t", "title": f"t{k}", "message": "m", "remediation": "r", "max_fine": "f", "confidence": 1.0, "location": place, "code_snippet": None, "flow_steps": None} for k, rule in enumerate(["GDPR-2", "EUAIA-1", "GDPR-2", "EUAIA-3"])]
    monkeypatch.setattr(pandas, "DataFrame", None)
    rules, results = report.sarif_rows(rows)
    assert [(r["rule_id"], r["title"], r["name"]) for r in rules] == [("GDPR-2", "t0", "GDPR_2"), ("EUAIA-1", "t1", "EUAIA_1"), ("EUAIA-3", "t3", "EUAIA_3")]
    assert [r["rule_index"] for r in results] == [0, 1, 0, 2] and '"ruleIndex": 2' in report.to_sarif(scan.Report("s", "2026-01-01", "p", {}, rows, {}, [], "m", [], "r", "c", {}, {}))


# -- results of Python in slices --------------------------------------------

def step(spark, monkeypatch, build):
    """What build runs in Python over batches of files."""
    found, df = [], spark.createDataFrame([], "path string, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: found.append(run) or self)
    build(df)
    return found[0]


def batch(files):
    body = "import m as a\n" + "".join(f"x{k} = a.f(k={k})\nx{k}.g()\n" for k in range(10))
    return pa.RecordBatch.from_pydict({"path": [f"{n}/m.py" for n in range(files)], "text": [body] * files})


def peak(run, files):
    """Rows, the most of one slice, and the most memory of Python and Arrow that its slices held."""
    given, rows, most, before = batch(files), 0, 0, pa.total_allocated_bytes()
    arrow = before
    tracemalloc.start()
    for out in run(iter([given])):
        arrow = max(arrow, pa.total_allocated_bytes())
        rows, most = rows + len(out), max(most, len(out))
        del out
    held = tracemalloc.get_traced_memory()[1] + arrow - before
    tracemalloc.stop()
    return rows, most, held


@pytest.mark.parametrize("build, each", [(facts.python_facts, 21), (facts.control_flow, None), (names.events, 31)])
def test_results_of_a_large_batch_are_never_held_whole(spark, monkeypatch, build, each):
    run = step(spark, monkeypatch, build)
    (rows, most, small), (more, most_of_more, large) = peak(run, 300), peak(run, 1500)
    assert more == 5 * rows and (each is None or rows == 300 * each)
    assert max(most, most_of_more) < tables.SLICE_ROWS + 100 and large < 1.5 * small


def test_slices_end_by_size_too_and_keep_every_row():
    schema = pa.schema({"path": pa.string(), "n": pa.int32()})
    files = pa.RecordBatch.from_pydict({"path": list("abcd"), "text": ["x" * tables.SLICE_CHARS, "", "y" * (tables.SLICE_CHARS // 2), "z"]})
    got = list(tables.sliced(iter([files, files]), lambda p, t: [(p, len(t))] if t else [], schema))
    assert [b.column("path").to_pylist() for b in got] == [["a"], ["c", "d", "a"], ["c", "d"]]
    assert list(tables.sliced(iter([files]), lambda p, t: [], schema))[0].num_rows == 0 and not list(tables.sliced(iter([]), lambda p, t: [], schema))


# -- steps for each node of a source ----------------------------------------

SPEC = {"sources": ["model.generate"], "sanitizers": [], "sinks": ["os.system"]}


def test_flows_search_statements_alone_and_make_steps_of_tainted_values_alone(monkeypatch):
    made, step_of = [], taint._step
    monkeypatch.setattr(taint, "_step", lambda kind, *more: made.append(kind) or step_of(kind, *more))
    monkeypatch.setattr(ast, "walk", None)
    body = "    v = model.generate()\n" + "".join(f"    c{k} = {k} + n\n" for k in range(50)) + "    w = v + ''\n    os.system(w)\n"
    nested = "try:\n    pass\nexcept E:\n    match x:\n        case 1:\n            async def g(n):\n" + "".join(f"            {line}\n" for line in body.splitlines())
    tree = ast.parse(f"def f(n):\n{body}" + nested + "if x:\n    class C:\n        def h(self): pass\n")
    read = pyfacts.read(tree)
    spelled = {f.node: f.spelling for f in read.facts if f.kind == "call"}
    hits = taint.flows(tree, [SPEC], read.calls, spelled)
    assert [(h.name, h.call.lineno, [s.line for s in h.steps]) for h in hits] == [("os.system", 54, [2, 53, 54]), ("os.system", 113, [61, 112, 113])]
    assert sorted(made) == ["propagation"] * 2 + ["sink"] * 2 + ["source"] * 2
    assert [f.name for f in taint.functions(tree)] == ["f", "h", "g"]  # as ast.walk finds them, level by level


def test_only_facts_of_the_kinds_that_are_asked_for_leave_python(spark):
    text = "import m\ndef f():\n    v = model.generate()\n    os.system(v)\nx = 1\n"
    rows = facts.file_facts("a.py", text, [SPEC])
    assert [r[2] for r in rows] == ["import", "def", "call", "call", "assign", "flow"]
    for kinds in (("flow",), ("call", "assign"), ("import", "def")):
        assert facts.file_facts("a.py", text, [SPEC], kinds) == [r for r in rows if r[2] in kinds]
    sources = spark.createDataFrame([("a.py", text)], "path string, text string")
    assert [r["kind"] for r in facts.python_facts(sources, [SPEC], ("flow",)).collect()] == ["flow"]


def test_reading_visits_no_contexts_and_looks_up_a_name_once_in_any_depth(monkeypatch):
    deep = "".join(" " * k + f"def f{k}(p{k}):\n" for k in range(60)) + " " * 60 + "a.get(p3)\n" + "a.b()\n"
    tree = ast.parse("import m as a\n" + deep)
    monkeypatch.setattr(ast, "iter_child_nodes", None)
    seen = [f.name for f in pyfacts.read(tree).facts if f.kind == "call"]
    assert seen == ["m.get", "m.b"] and type(pyfacts.Scopes().table) is dict


def test_what_a_scope_says_ends_with_it():
    scopes = pyfacts.Scopes()
    name = ast.parse("x.y", mode="eval").body
    said = []
    scopes.bind("x", "one")
    for text in ("two", "three"):
        scopes.enter()
        scopes.bind("x", text)
        scopes.bind("x", text + "!")
        scopes.bind("only", text, True)
        said.append(scopes.spelled(name))
    for _ in range(2):
        scopes.leave()
        said.append((scopes.spelled(name), scopes.is_instance(ast.Name("only"))))
    assert said == ["two!.y", "three!.y", ("two!.y", True), ("one.y", False)]
