import itertools
import random
import re
import time

import pytest

from auditloom.llm import surrogates

SCHEMA = "doc_id long, text string"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def replaced(spark, texts, **kw):
    got = {r["doc_id"]: r["text"] for r in surrogates.replace(table(spark, texts), **kw).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("title", ["Mr", "Ms", "Dr"])
def test_names_of_two_letters(spark, title):
    names = ["Al", "Ed", "Ek", "Ob", "Ib", "Un", "Jo", "Bo", "Li", "Lu", "Ng"] + ["".join(p).capitalize() for p in itertools.product("aeiou", "bcd")]
    names = sorted(set(names))
    new = [re.fullmatch(rf"so {title} (\w+) it is", t)[1] for t in replaced(spark, [f"so {title} {x} it is" for x in names])]
    assert len(set(new)) == len(names) and not set(new) & set(names) and all(x[0].isupper() and x[1:].islower() for x in new)
    if title != "Dr":
        assert all(x[-1] == {"Mr": "o", "Ms": "a"}[title] for x in new)


def test_full_space_of_addresses(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a, b, c, d in itertools.product(range(10), repeat=4)]
    new = replaced(spark, [" ".join(ips)])[0].split(" ")
    assert len(new) == len(set(new)) == len(ips) and not set(new) & set(ips)
    assert all(re.fullmatch(surrogates._OCTET + rf"(?:\.{surrogates._OCTET}){{3}}", x) for x in new)


@pytest.mark.parametrize("text", ["a@" + "b." * 20000 + "com", "a@" + "b-" * 20000 + ".com!", "a@" + "1." * 20000, "Mr " + "Ab" * 20000, "Mr " * 20000 + "Smith", "Mr " + "A. " * 20000, "Mr Ab" + "-Cd" * 20000, "sk-" + "a1" * 20000, "+1 " * 20000, "1 " * 20000, "f" * 40000])
def test_long_mentions(spark, text):
    new = replaced(spark, [text, "x", None, ""])
    assert new[1:] == ["x", None, ""] and len(new[0]) == len(text) and (new[0] != text) == bool(re.search("com|Ab|Smith|sk-|fff", text))


def test_coreference_and_distinctness_by_brute_force(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ssns, phones = [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(30)], [("+1", digits(3), digits(3), digits(4)) for _ in range(30)]
    mails, cards = [f"{a}@{b}.org" for a in "abc" for b in "xyz"], [digits(16) for _ in range(20)]
    forms = [lambda: rng.choice(ssns), lambda: rng.choice([" ", "-", "."]).join(rng.choice(phones)), lambda: rng.choice([str, str.upper, str.title])(rng.choice(mails)),
             lambda: rng.choice([" ", "-"]).join(re.findall("....", rng.choice(cards))), lambda: rng.choice(["Mr", "Mr.", "Mrs"]) + " " + rng.choice(["Ann", "Bo", "Cy Ek"])]
    texts = ["; ".join(rng.choice(forms)() for _ in range(rng.randint(1, 8))) for _ in range(150)]
    new = replaced(spark, texts)
    to, back = {}, {}
    plain = lambda kind, m: re.sub(r"\D", "", m) if kind == "number" else m.lower() if kind == "mail" else (re.sub("[. ].*", "", m), re.sub(r"^\S+ ", "", m).lower())
    for old, now in zip(texts, new):
        for a, b in zip(old.split("; "), now.split("; "), strict=True):
            kind = "mail" if "@" in a else "name" if a[0] == "M" else "number"
            x, y = (kind, plain(kind, a)), (kind, plain(kind, b))
            assert to.setdefault(x, y) == y and back.setdefault(y, x) == x
            assert (kind == "number" and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b)) or kind != "number"
    assert not set(to) & set(back)


def test_key_is_a_setting(spark):
    texts = ["card 4111-1111-1111-1111"]
    default = replaced(spark, texts)
    spark.conf.set(surrogates.KEY_SETTING, "secret one")
    try:
        assert default != replaced(spark, texts) == replaced(spark, texts, key="secret one")
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)


def test_endings_follow_script_and_gender(spark):
    new = replaced(spark, ["Mrs Иванова met Mr Иванов, Mr Παπαδοπουλος and Ms Παππα"])[0]
    assert re.fullmatch(r"Mrs [А-Я][а-я]{5}а met Mr [А-Я][а-я]{4}в, Mr [Α-Ω][α-ως]{10}ς and Ms [Α-Ω][α-ω]{3}α", new) and "Иванов" not in new


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, h int, len int, kind string, n_entities int, fake string")
    out = surrogates.replace(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "h", "len", "kind", "n_entities", "fake"]
    rows = spark.createDataFrame([(1, "id 078-05-1120", 5, 6, "k", 7, "f"), (1, "id 078-05-1120", 5, 6, "k", 7, "f"), (None, None, None, None, None, None, None)], empty.schema)
    got = surrogates.replace(rows).collect()
    assert sorted(r["n_entities"] for r in got) == [0, 1, 1] and all(r["h"] == 5 and r["fake"] == "f" for r in got if r["n_entities"]) and len({r["text"] for r in got}) == 2


@pytest.mark.parametrize("name", ["Արամ", "Łukasz Żółć", "Đặng Nguyễn", "Čapek", "İşık", "ნინო", "דוד", "محمد", "山田", "Ὀδυσσεύς", "Ғабит", "अमित"])
def test_names_of_many_scripts(spark, name):
    """No part of the name stays readable, each letter stays in its script and case, and repeats stay one."""
    import unicodedata

    new = replaced(spark, [f"Mr {name} came. {name} left."])[0]
    one, two = re.fullmatch(r"Mr (.+) came\. (.+) left\.", new).groups()
    assert one == two and len(one) == len(name)
    letters = [(a, b) for a, b in zip(name, one) if unicodedata.category(a)[0] == "L"]
    assert sum(a == b for a, b in letters) <= len(letters) // 3
    script = lambda c: unicodedata.name(c).split(" ")[0]
    assert all(script(a) == script(b) and a.isupper() == b.isupper() for a, b in letters)


def test_addresses_of_other_scripts(spark):
    new = replaced(spark, ["to 山田@example.com and josé@b.org"])[0]
    assert re.fullmatch(r"to \w\w@\w{7}\.com and \w{4}@\w\.org", new) and not set("山田é") & set(new)


def test_time_grows_with_length(spark):
    """A megabyte of one secret, which is as many letters to draw."""
    replaced(spark, ["x " + "ab" * 40])
    began = time.monotonic()
    new = replaced(spark, ["ab" * 500_000])[0]
    assert time.monotonic() - began < 60 and len(new) == 1_000_000 and set(new) <= set("abcdef") and new[:40] != "ab" * 20
