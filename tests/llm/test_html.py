import random
import time

import pytest

from auditloom.llm import html_extraction
from auditloom.llm.dom import parse

SCHEMA = "page_id long, url string, html string, host string, refs int, slots string, text int"


def extract(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "h", 1, "s", 2) for r in rows], SCHEMA)
    out = html_extraction.extract(df, **kw)
    assert out.columns == ["page_id", "url", "text"]
    return {r["page_id"]: r["text"] for r in out.collect()}


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))


def test_slots_alone_find_the_content(spark):
    """No marks and no telling names: menu, box and last line vary from page to page."""
    rng, rows, want = random.Random(1), [], {}
    for i in range(12):
        head, body = words(rng, 5), [words(rng, 30) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"http://h.org/{i}", f"<body><div class=a1><a href=/>{words(rng, 3)}</a> <a>{words(rng, 4)}</a></div><div class=b2>{words(rng, 8)}</div><div class=c3><h1>{head}</h1>"
                     + "".join(f"<p>{b}</p>" for b in body) + f"<p>Same last line</p></div><div class=d4>{words(rng, 6)}</div></body>"))
        want[i] = " ".join([head, *body])
    assert extract(spark, rows) == extract(spark, rows, marks=False) == want
    assert extract(spark, rows[:2])[0].endswith("Same last line " + rows[0][2].split("d4>")[1].split("<")[0])  # too few pages for a wrapper


def test_title_before_the_region(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h.org/{i}", f"<div><h1>Title {i}</h1><div>by {i}</div><div class=x>{words(rng, 60)}</div></div>") for i in range(5)]
    assert all(t == f"Title {i} " + rows[i][2].split("class=x>")[1].split("<")[0] for i, t in extract(spark, rows).items())


def test_copies_count_once(spark):
    copy = "<div><p>One of it.</p><p>Two of it.</p><p>Three of it.</p></div>"
    rows = [(i, f"http://h.org/{i}", copy) for i in range(40)] + [(40 + i, f"http://h.org/s{i}", f"<div><p>Short {i}</p></div>") for i in range(3)]
    got = extract(spark, rows)
    assert all(got[i] == "One of it. Two of it. Three of it." for i in range(40)) and got[41] == "Short 1"


def test_near_copies_keep_their_text(spark):
    body = "".join(f"<p>Sentence {k} of a long story that many pages repeat.</p>" for k in range(6))
    rows = [(i, f"http://h.org/{i}", f"<div>{body}<p>Seen {i} times</p></div>") for i in range(9)]
    assert all(t.count("Sentence") == 6 and t.endswith(f"Seen {i} times") for i, t in extract(spark, rows).items())


@pytest.mark.parametrize("deep", [1500, 20000])
def test_deep_markup(spark, deep):
    rows = [(i, f"http://h.org/{i}", "<div>" * deep + f"<p>Deep text {i}</p>" + "</div>" * (deep - i) + "</section></span>") for i in range(4)]
    assert extract(spark, rows) == {i: f"Deep text {i}" for i in range(4)}


def test_markup_of_bad_form_takes_linear_time():
    began = time.perf_counter()
    for source in ("<a " + '"' * 50_000, "<a " * 50_000, '<p class="x>' * 20_000, "<![CDATA[" * 20_000, "<!--" * 20_000, "</i>" * 50_000 + "<div>" * 50_000 + "</i>" * 50_000, "<li>" * 20_000, "<p>" * 20_000):
        html_extraction.main_text(parse(source), set())
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("source, want", [
    ('<p title="a>b">one</p><br/><p/>two', "one two"),
    ("<p class=\"a>one</p><p>it's \"two\"</p>", ""),  # by the standard's rules the quote runs on to the next one, and the tag to the last >
    ('<p class="a>one</p>', "one"), ("<p title=it's>one</p>", "one"),
])
def test_quotes(source, want):
    assert html_extraction.main_text(parse(source), set()) == want


def test_empty_table_and_pages(spark):
    assert extract(spark, []) == {}
    got = extract(spark, [(1, None, None), (2, None, ""), (3, "x", "plain"), (None, "http://h.org", "<p>t"), (4, "http://h.org", "<p>t"), (4, "http://h.org", "<p>t")])
    assert got == {1: "", 2: "", 3: "plain", None: "t", 4: "t"}


def test_names_within_the_article_do_not_drop_text(spark):
    parts = ['<div class="side-effects"><p>two</p></div>', '<div class="notice">three</div>', '<p id="comment-on-law">four</p>', '<section class="related-work">five <a href=/>six</a> seven</section>', '<p class="header-text">eight</p>']
    noise = ['<div class="ad">Buy</div>', '<div id="comments"><p>First!</p></div>', '<div class="related-posts"><a href=x>More</a> <a href=y>Yet more</a></div>', '<div class="subscription">Mail <input name=m></div>', '<div class="big cookie">Ok?</div>', "<nav>Up</nav>"]
    page = "<body><div class=menu>Menu</div><article><h1>one</h1>" + "".join(p + n for p, n in zip(parts + [""], noise)) + "</article><div class=notice>Out</div></body>"
    assert extract(spark, [(1, "http://h.org/1", page)])[1] == "one two three four five six seven eight"
    assert extract(spark, [(1, "http://h.org/1", "<body><p>one</p><div class=notice>Out</div></body>")])[1] == "one"


def test_many_named_elements_take_linear_time():
    began = time.perf_counter()
    source = "<article>" + "<div class=related-x>a " * 20_000 + "</article>"
    assert html_extraction.main_text(parse(source), set()).count("a") == 20_000
    assert time.perf_counter() - began < 10
