import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import fill_middle as fm


def plain_way(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé \n<>PSM1😀"), max_size=40), st.one_of(st.none(), st.integers(-5, 500)))
def test_one_text_equals_the_plain_way_and_comes_back(text, doc_id):
    got = fm.transform(text, "" if doc_id is None else str(doc_id), fm.Form())
    assert got == plain_way(doc_id, text)
    assert fm.restore(got[4], got[1]) == text


def test_tables_with_every_edge(spark):
    long_ = "Some words, ünï 12\n" * 100_000
    rows = [(k, f"def f{k}(x):\n    return x + {k}", "p", 7) for k in range(200)] + [(1, "dup one", "p", 7)] * 3 + [(None, "no id here", "p", 7), (5, None, "p", 7), (6, "", "p", 7), (7, "has <M> mark", None, None), (8, long_, "p", 7), (9, "a<", "p", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, extra int")
    out = fm.fill_middle(df, digests=True)
    assert out.columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain_way(i, t)) for i, t, *_ in rows), key=str)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in out.collect()) == sorted((str(i), sha(t)) for i, t, *_ in rows)
    assert all(r["output_sha256"] == sha(r["output"]) for r in out.collect())
    assert fm.fill_middle(df.limit(0)).count() == 0


def test_other_marks_and_shares(spark):
    df = spark.createDataFrame([(k, f"one two {k} <P>") for k in range(300)], "doc_id long, text string")
    form = fm.Form("[pre]", "[suf]", "[mid]", transformed=50, suffix_first=100, seed=9)
    got = {r["doc_id"]: r for r in fm.fill_middle(df, form).collect()}
    assert {r["form"] for r in got.values()} == {"plain", "spm"} and 100 < sum(r["form"] == "spm" for r in got.values()) < 200
    assert all(fm.restore(r["output"], r["form"], form) == f"one two {k} <P>" for k, r in got.items())
