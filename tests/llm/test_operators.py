import random
import re
import zlib

import duckdb
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import compression_quality, decontamination, html_extraction, mixing, quality_rules, queries, surrogates, token_counts, url_filter
from auditloom.llm.common import word_count, words
from auditloom.llm.dom import match, parse

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_words(spark):
    texts = [None, "", " ", "a", " a\tb\n", "a\u00a0b c", "\x0b\x0c x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")), word_count(F.col("t"))).collect()
    for t, w, n in rows:
        assert w == re.findall(r"[^\x20\x09-\x0D]+", t or "") and n == len(w)


# -- 2 surrogates -----------------------------------------------------------

PII = [
    (1, "Mr. John Smith met Mrs Ann Smith and Mr. John Smith; +1 (017) 555-7713, +1 017 555 7713 and 10.0.0.7."),
    (2, "card 4111-1111-1111-1111 is 4111111111111111, not 4012888888881881; JOE@Ex.com is joe@ex.com; id 078-05-1120"),
    (3, None), (4, ""), (5, "clean text, version 2.0 of 12.5"), (5, "clean text, version 2.0 of 12.5"),
    (6, "Frau Éva Müller 10.0.0.7 GB82 WEST 1234 5698 7654 32 token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\""),
]


def test_surrogates_keep_form_identity_and_distinctness(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in PII], "doc_id int, text string, n_entities0 int")
    got = {r["doc_id"]: r for r in surrogates.replace(df).collect()}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == PII[4][1] and got[5]["n_entities"] == 0
    one, two, six = got[1]["text"], got[2]["text"], got[6]["text"]
    for new, (_, old) in ((one, PII[0]), (two, PII[1]), (six, PII[6])):
        assert len(new) == len(old) and re.sub(r"[^\W_]", "x", new) == re.sub(r"[^\W_]", "x", old)
        assert [c.isupper() for c in new] == [c.isupper() for c in old]
    names = re.findall(r"(Mrs?\.?) (\w+ \w+)", one)
    assert names[0] == names[2] and names[0][1] != names[1][1] and names[0][1] != "John Smith"
    a, b = re.findall(r"\+[\d ()-]+\d", one)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713" and a.startswith("+1")
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"\d{4}-\d{4}-\d{4}-\d{4}|\d{16}", two)]
    assert cards[0] == cards[1] != cards[2]
    for c in cards:
        d = [int(x) for x in reversed(c)]
        assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0
    mails = re.findall(r"\S+@\S+\.com", two)
    assert mails[0].lower() == mails[1] != "joe@ex.com" and mails[0].isupper() is False
    assert re.search(r"\d+\.\d\.\d\.\d", one)[0] == re.search(r"\d+\.\d\.\d\.\d", six)[0] != "10.0.0.7"
    assert re.search(r'"[0-9A-F]{40}"', six)
    assert [r["text"] for r in surrogates.replace(df).orderBy("doc_id").collect()] == [r["text"] for r in surrogates.replace(df).orderBy("doc_id").collect()]
    assert surrogates.replace(df, key="other").filter("doc_id = 1").first()["text"] != one


def test_colliding_entities_become_distinct(spark):
    ips = [f"{a}.{b}.1.1" for a in range(2, 10) for b in range(10)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "doc_id int, text string")
    new = [r["text"] for r in surrogates.replace(df).collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)


#: For each type, mentions with as few digits as it allows.
BARE = {"email": ["a.b@ex.com"], "ip": ["10.0.0.7"], "phone": ["+1 (017) 555-7713"], "ssn": ["078-05-1120"], "iban": ["GB82 WEST 1234 5698 7654 32"], "card": ["4111-1111-1111-1111"],
        "secret": ["sk-" + "abcdefghij" * 2, *(f"gh{c}_" + "abcdefghijkl" * 3 for c in "pousr"), "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefab" * 4], "name": ["Mrs Smith"]}


def test_every_pattern_passes_the_hint(spark):
    assert BARE.keys() == surrogates.PATTERNS.keys()
    df = spark.createDataFrame([(x, f"so {x} it is") for xs in BARE.values() for x in xs], "mention string, text string")
    for r in surrogates.replace(df).collect():
        assert r["n_entities"] == 1 and r["mention"] not in r["text"]


def test_bare_repeats_of_a_titled_name(spark):
    rows = [(1, "Mr. John Smith came. John Smith said so; Smith's hat. JOHN SMITH! Smithson stayed, smith too. Smith left"),
            (2, "Said Mary O'Brien, then Prof. Dr. Mary Ann O'Brien: O'Brien."), (3, "Frau Dr. Anna von der Berg-Klein; Berg-Klein. Dr J. R. McDonald and McDonald"),
            (4, "Mr. John Ronald Smith and John Smith"), (5, "John Smith untitled, Mr. Key x@y.com $1 Key \\1 Key")]
    got = {r["doc_id"]: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {i: r["n_entities"] for i, r in got.items()} == {1: 5, 2: 3, 3: 4, 4: 2, 5: 4}
    first, last = re.match(r"Mr\. (\w+) (\w+) came", got[1]["text"]).groups()
    assert got[1]["text"] == f"Mr. {first} {last} came. {first} {last} said so; {last}'s hat. {f'{first} {last}'.upper()}! Smithson stayed, smith too. {last} left" and last != "Smith"
    first, middle, last = re.search(r"Prof\. Dr\. (\w+) (\w+) (\w'\w+)", got[2]["text"]).groups()
    assert got[2]["text"] == f"Said {first} {last}, then Prof. Dr. {first} {middle} {last}: {last}."
    assert not re.search("Anna|Berg|Klein|Donald", got[3]["text"]) and re.match(r"Frau Dr\. \w+ \w{3} \w{3} (\w+-\w+); \1\. Dr \w\. \w\. (\w+) and \2$", got[3]["text"])
    assert re.match(r"Mr\. (\w+) \w+ (\w+) and \1 \2$", got[4]["text"]) and not re.search("John|Ronald|Smith", got[4]["text"])
    assert re.match(r"John Smith untitled, Mr\. (\w{3}) \w@\w\.com \$1 \1 \\1 \1$", got[5]["text"])


def test_surrogates_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    union = regex.compile(surrogates.UNION)
    for r in surrogates.op2_surrogates(spark, SF).collect():
        found = [m[0] for m in union.finditer(old[r["doc_id"]])]
        assert r["n_entities"] == len(found) and (r["text"] != old[r["doc_id"]]) == bool(found)
        assert not any(x in r["text"] for x in found if len(x) > 6)


# -- 3 decontamination ------------------------------------------------------

def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = [(1, "X " + item.replace(" ", ", ") + " y"), (1, "other"), (2, None), (3, ""), (4, " ".join(item.split()[:9])), (None, item.upper()), (5, "tiny Item, here tiny item"), (6, item + " " + item)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, h string")
    b = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, "!!"), (10, item), (9, " ".join(item.split()[2:12]))], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"]) for r in decontamination.report(d, b).collect()}
    assert got == {(1, 16): (14, 2), (1, 1): (0, 0), (2, 0): (0, 0), (3, 0): (0, 0), (4, 9): (0, 0), (None, 14): (14, 2), (5, 5): (4, 1), (6, 28): (28, 2)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(d, none).filter("contaminated").count() == 0


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "x alpha beta gamma delta noise epsilon zeta eta theta iota kappa y"
    d = spark.createDataFrame([(1, moved), (2, item), (3, "alpha kappa")], "doc_id long, text string")
    wins = decontamination.windows(spark.createDataFrame([(1, item)], "item_id long, text string"))
    keys = decontamination.keyed(d, wins)
    postings = decontamination.index(d, keys, reach=12)
    assert {r["doc_id"] for r in decontamination.matches(postings, keys).collect()} == {2}
    assert {r["doc_id"] for r in decontamination.matches(postings, keys, slop=2).collect()} == {1, 2}


# -- 4 quality rules --------------------------------------------------------

def test_quality_rules_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "a b c a b c " * 20, "en", "s"), (None, "\n".join(["one two three four five six"] * 12), "en", "s"), (4, " ".join(f"word{i}" for i in range(80)), "en", "s"), (4, " ".join(f"word{i}" for i in range(80)), "en", "s")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_words long")
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(df).collect()}
    assert got[1, 0]["base_failed"] and got[2, 0]["base_failed"] and got[3, 120]["n_repeat_words"] == 120
    assert got[None, 72]["n_dup_lines"] == 11 and got[4, 80]["kept"]
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_histogram_cells(spark):
    xs = [0, 1, 127, 128, 129, 255, 256, 1000, 123456]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(quality_rules.bucket(F.col("x"))).collect()]
    assert all(b <= x <= b * (1 + 1 / 64) for x, b in zip(xs, got)) and got[:4] == [0, 1, 127, 128]


# -- 5 html -----------------------------------------------------------------

@pytest.mark.parametrize("source, want", [
    ("", ""), ("<p>a<br>b &amp; c<p> d\n e", "a b & c d e"), ("<article><h1>T<i>i</i>t</h1><script>var a='</p>'</script><p>x</article><p>no", "Tit x"),
    ("<nav>n</nav><header>h</header><div class='main'><p>t</p></div><aside>a</aside><div id='cookie-notice'>c</div><form>f</form><footer>f</footer>", "t"),
    ("<main><p>a</p><section class='comments'><p>c</p></section></main>", "a"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>1 < 2</p><!-- x --><p>y", "1 < 2 y"), ("text &#233; &eacute;", "text é é"), ("<div hidden>h</div><b>v", "v"),
])
def test_main_text(source, want):
    assert html_extraction.main_text(parse(source), set()) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pdivarticle =\"'&;!-ab\n", max_size=80))
def test_any_markup_is_read(source):
    html_extraction.main_text(parse(source), set())


def test_wrapper_drops_constant_slots(spark):
    page = lambda i: f"<html><body><div><p>Welcome to our site</p></div><div><h1>Story {i}</h1><p>Body number {i} of many.</p></div><div><p>All rights</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(6)] + [(7, "http://copies.org/a", page(1)), (8, "http://copies.org/b", page(1)), (9, "http://copies.org/c", page(1)), (10, None, None), (11, "x", "")]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 Body number 3 of many." and got[10] == got[11] == ""
    assert "Story 1" in got[7] and len(got) == len(rows)


def test_long_lists_are_aligned_exactly(spark):
    # An extra paragraph before the end shifts what an alignment by index would pair.
    for n in (150, 250, 3000):
        rows = [(i, f"http://h.org/{i}", "<div>" + "".join(f"<p>Text {i} {k}</p>" for k in range(n + i)) + "<h2>t</h2><p>Fixed notice</p><div>All rights</div></div>") for i in range(4)]
        got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert not any("Fixed" in r["text"] or "rights" in r["text"] for r in got) and all(f"Text {r['page_id']} {n - 1}" in r["text"] for r in got)


def test_alignment_equals_brute_force():
    def heaviest(a, b):
        if a.label != b.label:
            return 0
        x, y = ([k for k in t.kids if not isinstance(k, str)] for t in (a, b))
        if [k.label for k in x] == [k.label for k in y]:
            return 1 + sum(map(heaviest, x, y))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + heaviest(p, q))
        return 1 + best[-1][-1]

    rng = random.Random(3)
    page = lambda n: parse("<div>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c<li>d</ul>", "<ul><li><b>c</b></ul>", "<section><p>a</p><h2>b</h2></section>", "<section><p>x</p></section>"]) for _ in range(n)) + "</div>")
    for n in [*range(12)] * 8 + [220, 260]:
        a, b, found = page(n), page(max(0, n + rng.randint(-3, 3))), {}
        assert match(a, b, found) == heaviest(a, b) == len(found)


# -- 7 tokens ---------------------------------------------------------------

def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), token_counts.counts_for(path)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\tab'sé1.😀", max_size=60))
def test_counts_equal_the_library(text):
    library, counts = _library()
    text = text.encode("utf-8", "ignore").decode()
    assert counts.text(text) == len(library.encode(text, add_special_tokens=False))


def test_counts_of_the_small_table(spark):
    library, counts = _library()
    assert counts.text(None) == 0 and counts.text("a<|endoftext|>b") == 3 and counts.text("ab" * 20000) == len(library.encode("ab" * 20000).ids)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in token_counts.op7_token_counts(spark, SF).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False)) and r["over_limit"] == (r["n_tokens"] > 1024)


# -- 8 classifier -----------------------------------------------------------

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = compression_quality.op8_compression_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, right, good, kept = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality")), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & (F.col("predicted") == 1))).first()
    assert right / n > 0.95 and kept / good > 0.98


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "x" * 100000, 0.2)], "doc_id long, text string, other double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = compression_quality.train(docs.select("doc_id", "text"), labels)
    assert all(0 <= r["score"] <= 1 for r in compression_quality.score(docs, model).collect())
    assert compression_quality.outline("Ab ab ab CD  12 x*#") == b"Aa a = A  9 a*#"


# -- 9 urls -----------------------------------------------------------------

def brute_judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "com", "net", "x1"])
    rules = [(rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randint(1, 3))), "/" + "/".join(part() for _ in range(rng.randint(0, 2)))) for _ in range(25)]
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    urls = [None, "", "no url", "://", "http://", "HTTP://A.Com", "x://y://z/a"] + [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{'/'.join(part() for _ in range(rng.randint(0, 4)))}{rng.choice(['', '/', '?q=/a', '#f'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


# -- 10 mixing --------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > most * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.01 else None, rng.choice(["a", "b", "c", "dé", None] + ["hot"] * 5 + ["rare"] * (i % 50 == 0)), rng.choice([0, 1, 5, 40, 300, 900])) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, size long, copies int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["source"], r["size"]) for r in got if r["doc_id"] is not None and r["source"]) == sorted(r for r in rows if r[0] is not None and r[1])
    sizes, taken, largest = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s], taken[s], largest[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["size"] * r["copies"], max(largest.get(s, 0), r["size"])
        assert 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_expected_copies_stay(spark):
    df = spark.createDataFrame([(i, "a" if i < 60 else "b", 10) for i in range(90)], "doc_id long, source string, size long")
    runs = [{r["doc_id"]: r["copies"] for r in mixing.mix(df, seed=s, fan=8).collect()} for s in range(12)]
    share = 900 * 5 / 7 / 600
    mean = sum(sum(r[i] for i in range(60)) for r in runs) / 12 / 60
    assert mean == pytest.approx(share, abs=0.02) and len({tuple(sorted(r.items())) for r in runs}) > 1


def test_very_many_equal_rows(spark):
    """100,000 equal rows, a third of them without an id: no group grows with them, and targets are met."""
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, 7).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit(10).alias("size"))
    df = hot.unionByName(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(10).alias("size")))
    out = mixing.mix(df, mark=None)
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert {r["source"]: r["n"] for r in got} == {"hot": 100_000, "b": 20_000} and all(abs(r["taken"] - r["target"]) <= 5 for r in got)
    rows = df.groupBy("doc_id", "source", "size").count().withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    buckets = rows.groupBy("source", F.pmod(F.xxhash64(F.lit(17), "doc_id", "size", F.lit(0).cast("long"), F.col("k").cast("long")), F.lit(782))).count()
    assert buckets.agg(F.max("count")).first()[0] < 300
    key = lambda r: (str(r["doc_id"]), r["source"], r["copies"])
    assert sorted(map(key, out.collect())) == sorted(map(key, mixing.mix(df.repartition(5)).collect()))


def test_empty_mix(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_held_out_folds(spark):
    got = {r["doc_id"] for r in compression_quality.op8_compression_quality(spark, SF).filter("held_out").collect()}
    assert got == {i for i in (r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()) if zlib.crc32(str(i).encode()) % 5 == 0}
