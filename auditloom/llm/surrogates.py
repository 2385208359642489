"""Personal data replaced by keyed surrogates, in DataFrame code.

A mention is found by one expression, typed, and reduced to a canonical form (digits of
a number, lower case of an address), so that differently written mentions of one entity
stay one. Each entity gets a surrogate of the same form: digits for digits, letters of the
same script for letters (of some forty scripts; others become Latin), octets of the same width for an address, a check digit that is
valid where the original's is; a name gets letters of its script, with the title and so
the gender left, and where the title tells a gender its last letter is one that such names
end with in its script (Latin a or o, Cyrillic а or в, Greek α or ς). The letters come from
SHA-256 over the key, the type, the entity and an attempt number. Entities whose
surrogate meets another's or a real entity's try again; from the attempt WIDER on their
form grows (names by two letters an attempt, addresses by two letters or to octets of
any width, numbers by a digit), so that all become distinct however short they are.
Each mention is then written in its own punctuation and case. A name is found by its title;
within that text its bare repeats (the full name, first and last part, the last part alone,
as written or in capitals) get the same surrogate, the earliest name's where two share one.

The key is the argument, else the setting `spark.auditloom.pii.key`; the default is public
and for tests only: who knows the key can test a guess at an entity.

Edge cases: null and empty texts stay as they are and have no mentions; texts of any
length are scanned whole; repeated rows get the same text; an empty table stays empty;
other columns are kept as they are, except one with the name of the count, which is replaced.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, store, table

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MALE = r"Mr|Mister|Sir|Herr|Señor|Signor|Monsieur|Don|Sr"
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Señorita|Signora|Madame|Mademoiselle|Doña|Sra|Dra|Mme|Mlle"
_EITHER = r"Dr|Prof|Professor|Doctor|Doktor|Mx"
# Loops over groups have a bound or give nothing back: Java takes the others by recursion.
_TITLES = rf"(?:(?:{_FEMALE}|{_MALE}|{_EITHER})\.? ){{1,6}}"
_SMALL = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|zu|bin|ibn|al) ){0,4}"
_INITIALS = r"(?:\p{Lu}\. ?){0,6}"
#: One part of a name: Smith, McDonald, O'Brien, Smith-Jones.
_PART = r"(?:(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}++)++(?:-(?:\p{Lu}\p{Ll}++)++)*+|[\p{Lo}\p{M}ა-ჺ]{1,20}+)"
#: Types in order of precedence where two start at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}|[0-9a-fA-F]{32,})(?![A-Za-z0-9_])",
    "name": rf"(?<![\p{{L}}0-9]){_TITLES}{_INITIALS}{_SMALL}{_PART}(?: {_INITIALS}{_SMALL}{_PART}){{0,4}}",
}
UNION = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = rf"^{_TITLES}"
#: A mention has one of these (every alternative of UNION implies one); texts without any skip the long expression.
_HINT = rf"[0-9@]|{_TITLES}{_SMALL}[\p{{Lu}}\p{{Lo}}ა-ჺ]|sk-|gh[pousr]_|AKIA|[a-fA-F]{{32}}"
#: Alphabets of one script each: lower case, by the range that a letter falls in. The first four are the common letters.
_SCRIPTS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "ß-ÿ": "àáâäèéêëìíîïòóôöùúûüñç", "α-ω": "αβγδεζηθικλμνξοπρστυφχψω", "а-я": "абвгдежзиклмнопрстуфхцчшщыэюя"}
#: Ranges of code points of other letters: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Syriac, Indic scripts one by one, Thai, Lao,
#: Tibetan, Burmese, Georgian, Hangul letters, Ethiopic, Cherokee, Khmer, Latin, Greek, kana, bopomofo, Han, Yi, Hangul.
_RANGES = [(0x100, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x561, 0x587), (0x5D0, 0x5EA), (0x620, 0x6D3), (0x710, 0x72F), *((0x900 + 128 * k, 0x97F + 128 * k) for k in range(10)), (0xE01, 0xE2E), (0xE81, 0xEAE),
           (0xF40, 0xF6C), (0x1000, 0x102A), (0x10D0, 0x10FA), (0x1100, 0x11FF), (0x1200, 0x135A), (0x13A0, 0x13F4), (0x1780, 0x17B3), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3105, 0x312F), (0x3400, 0x9FFF), (0xA000, 0xA48C), (0xAC00, 0xD7A3)]


def _alphabet(low: int, high: int) -> str:
    """Up to 64 letters of a range, evenly: small ones whose capital is one letter, or those without case."""
    letters = [c for c in map(chr, range(low, high + 1)) if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper().lower() == c != c.upper()]
    letters = letters or [c for c in map(chr, range(low, high + 1)) if unicodedata.category(c) in ("Lo", "Ll")]
    return "".join(letters[:: max(1, len(letters) // 64)][:64])


#: (first, last code point, alphabet), in order of precedence.
_ALPHABETS = [(ord(k[0]), ord(k[-1]), v) for k, v in _SCRIPTS.items()] + [(a, b, x) for a, b in _RANGES if (x := _alphabet(a, b))]
_ENDINGS = {"f": {"a-z": "a", "α-ω": "α", "а-я": "а"}, "m": {"a-z": "o", "α-ω": "ς", "а-я": "в"}}
#: The attempt from which on forms grow.
WIDER = 3
KEY_SETTING, PUBLIC_KEY = "spark.auditloom.pii.key", "auditloom"


def kind_of(m: Column) -> Column:
    out = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike(rf"\A(?:{PATTERNS[name]})\z"), name).otherwise(out)
    return F.when(m.rlike(_TITLE), "name").otherwise(out)


def canonical(m: Column, kind: Column) -> Column:
    # Gender enters a name's canonical form, so that namesakes of two genders stay two.
    gender = F.when(m.rlike(rf"^(?:(?:{_EITHER})\.? )*(?:{_FEMALE})\.? "), "f").when(m.rlike(rf"^(?:(?:{_EITHER})\.? )*(?:{_MALE})\.? "), "m").otherwise("n")
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, "[^0-9]", ""))
            .when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind.isin("email", "secret"), F.lower(m))
            .when(kind == "name", F.concat(gender, F.lit(":"), F.lower(F.translate(F.regexp_replace(m, _TITLE, ""), "\u0130", "i")))).otherwise(m))


def _form(kind: Column, entity: Column, attempt: Column) -> Column:
    """The entity itself, or from the attempt WIDER on a longer one of its kind."""
    more = F.greatest(attempt - (WIDER - 1), F.lit(0)).cast("int")
    longer = (F.when(kind == "email", F.concat(F.repeat(F.lit("ba"), more), entity)).when(kind == "ip", entity)
              .when(kind == "name", F.concat(entity, F.repeat(F.regexp_extract(entity, r"\p{L}{1,2}$", 0), more))).otherwise(F.concat(entity, F.repeat(F.lit("0"), more))))
    return F.when(more == 0, entity).otherwise(longer)


def _stream(seed: Column, form: Column) -> Column:
    """Array of digests: sixteen-bit numbers as hex, one for each character of the form."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(form) / 16).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 256))


def _luhn_rest(digits: Column) -> Column:
    """Luhn sum modulo ten."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _with_surrogate(df: DataFrame, key: str) -> DataFrame:
    """df: kind, entity, attempt; adds fake, a stand-in of the form."""
    kind, form, attempt, stream, plain = (F.col(c) for c in ("kind", "_form", "attempt", "_stream", "_plain"))
    # What depends on the whole entity is worked out once, not for each of its characters; `let` keeps it so.
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, F.col("entity"), attempt.cast("string")), 256)
    df = df.withColumn("_form", _form(kind, F.col("entity"), attempt)).withColumn("_stream", let(seed, lambda s: _stream(s, form)))
    small = F.when((kind == "secret") & form.rlike("^[0-9a-f]+$"), "abcdef").otherwise(_SCRIPTS["a-z"])

    def number(i):
        return F.conv(F.substring(F.get(stream, F.floor(i / 16).cast("int")), i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")

    def letter(c, i, small):
        lower = F.lower(c)
        point = F.ascii(lower)
        pick = lambda letters: F.substring(F.lit(letters), number(i) % len(letters) + 1, F.lit(1))
        # Names stay pronounceable: vowels for vowels, consonants for consonants.
        sound = F.when(lower.isin(*"aeiou"), pick("aeiou")).otherwise(pick("bcdfghjklmnprstvw"))
        new = F.when(point.between(97, 122), F.when(kind == "name", sound).otherwise(F.substring(small, number(i) % F.length(small) + 1, F.lit(1))))
        for low, high, letters in _ALPHABETS[1:]:
            new = new.when(point.between(low, high) & lower.rlike(r"^\p{L}"), pick(letters))
        # Letters of none of these scripts become Latin ones rather than stay; marks and signs stay.
        new = new.when(lower.rlike(r"^\p{L}"), pick(_SCRIPTS["a-z"])).otherwise(c)
        return F.when(F.ascii(c).between(48, 57), (number(i) % 10).cast("string")).when(c == lower, new).otherwise(F.upper(new))

    df = df.withColumn("_plain", let(small, lambda az: F.array_join(F.transform(F.split(form, ""), lambda c, i: letter(c, i, az)), "")))
    wide = attempt >= WIDER
    octet = lambda o, i: F.when(wide, number(i) % 256).when(F.length(o) == 1, number(i) % 10).when(F.length(o) == 2, 10 + number(i) % 90).otherwise(100 + number(i) % 156).cast("string")
    ip = F.array_join(F.transform(F.split(form, r"\."), octet), ".")
    # The last domain label stays, so that an address remains one; so do the prefixes by which a secret is known.
    tld = F.length(F.regexp_extract(form, r"(\.[a-z]+)$", 1))
    mail = F.concat(F.substring(plain, F.lit(1), F.length(plain) - tld), F.substring(form, F.length(form) - tld + 1, tld))
    lead = F.length(F.regexp_extract(form, r"^(sk-|gh[pousr]_|akia)", 1))
    secret = F.concat(F.substring(form, F.lit(1), lead), F.substring(plain, lead + 1, F.length(plain)))
    first = F.concat(F.substring(form, 1, 1), F.substring(plain, F.lit(2), F.length(plain)))
    most = F.substring(first, F.lit(1), F.length(form) - 1)
    card = F.when(_luhn_rest(F.col("entity")) == 0, F.concat(most, ((10 - _luhn_rest(F.concat(most, F.lit("0")))) % 10).cast("string"))).otherwise(first)
    iban = F.concat(F.substring(form, 1, 2), F.substring(plain, F.lit(3), F.length(plain)))
    end = F.substring(plain, F.length(plain), F.lit(1))
    for gender, ends in _ENDINGS.items():
        for span, letter_ in ends.items():
            end = F.when(form.startswith(f"{gender}:") & form.rlike(f"[{span}]$"), letter_).otherwise(end)
    name = F.concat(F.substring(form, 1, 2), F.substring(plain, F.lit(3), F.length(plain) - 3), end)
    fake = F.when(kind == "ip", ip).when(kind == "email", mail).when(kind == "card", card).when(kind == "phone", first).when(kind == "iban", iban).when(kind == "name", name).when(kind == "secret", secret).otherwise(plain)
    return df.withColumn("fake", fake).drop("_form", "_stream", "_plain")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, fake for distinct entities: fakes are distinct and never real. A round
    reads what former rounds have given away, but writes only its own."""
    real = store(entities.select("kind", "entity").distinct(), "pii-entities")
    settled, left, attempt = real.select("kind", "entity", F.lit("").alias("fake")).limit(0), real, 0
    while True:
        tried = _with_surrogate(left.withColumn("attempt", F.lit(attempt)), key)
        given = real.select("kind", F.col("entity").alias("fake")).unionByName(settled.select("kind", "fake")) if attempt else real.select("kind", F.col("entity").alias("fake"))
        now = tried.join(given, ["kind", "fake"], "left_anti").groupBy("kind", "fake").agg(F.min("entity").alias("entity"))
        now = store(now.select("kind", "entity", "fake"), f"pii-settled{attempt}")
        settled = settled.unionByName(now) if attempt else now
        left = store(left.join(now, ["kind", "entity"], "left_anti"), f"pii-left{attempt}")
        attempt += 1
        if left.isEmpty():
            return settled


def render(mention: Column, kind: Column, fake: Column) -> Column:
    """fake in the mention's punctuation and case. The k-th letter or digit of the mention
    takes the k-th of fake."""
    title = F.when(kind == "name", F.regexp_extract(mention, _TITLE, 0)).otherwise("")
    body = F.expr("substring(mention, length(_title) + 1)")
    new = F.when(kind == "name", F.expr("substring(fake, 3)")).otherwise(fake)

    up = lambda c, n: F.when((c != F.lower(c)) & (kind != "iban"), F.upper(n)).otherwise(n)

    def place(acc, c):
        passes = c.rlike(r"^[^0-9]$") & kind.isin("phone", "card", "ssn") | ((kind == "iban") & (c == " "))
        out = F.when(passes, c).otherwise(up(c, F.substring(F.col("_new"), acc["k"] + 1, F.lit(1))))
        return F.struct(F.concat(acc["s"], out).alias("s"), (acc["k"] + F.when(passes, 0).otherwise(1)).alias("k"))

    # Numbers, of bounded length, pass over their punctuation; the others agree place by place. What a
    # longer form has more stands at the end, in capitals after capitals; of addresses it is the fake itself.
    folded = F.aggregate(F.split("_body", ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), place, lambda a: F.concat(a["s"], F.substring(F.col("_new"), a["k"] + 1, F.length("_new"))))
    rest = F.substring(F.col("_new"), F.length("_body") + 1, F.length("_new"))
    placed = let(F.split("_new", ""), lambda new: F.array_join(F.transform(F.split("_body", ""), lambda c, i: up(c, F.get(new, i))), ""))
    placed = F.concat(placed, F.when(F.col("_body") == F.upper("_body"), F.upper(rest)).otherwise(rest))
    written = F.when(kind.isin("phone", "card", "ssn", "iban"), folded).when(kind.isin("ip", "email") & (F.length("_body") != F.length("_new")), F.col("_new")).otherwise(placed)
    return {"title": title, "body": body, "new": new, "written": written}


def _aliases(i: Column, kind: Column, body: Column, new: Column) -> Column:
    """Array of (i, alias, fake): the bare forms by which a text may repeat a name."""
    last, ends = "[^ ]+$", "^([^ ]+) .* ([^ ]+)$"
    pair = lambda a, b: F.struct(i.alias("i"), a.alias("alias"), b.alias("fake"))
    forms = [(body, new), (F.regexp_extract(body, last, 0), F.regexp_extract(new, last, 0)), (F.regexp_replace(body, ends, "$1 $2"), F.regexp_replace(new, ends, "$1 $2"))]
    return F.when(kind == "name", F.array(*[pair(f(a), f(b)) for a, b in forms for f in (lambda x: x, F.upper)])).otherwise(F.array().cast("array<struct<i:int,alias:string,fake:string>>"))


def _bare(x: Column, known: Column, any_of: Column) -> Column:
    """x cut at the aliases that any_of matches: (s, n), the text with their fakes and how many there were."""
    rest, hits = F.split(x, any_of), F.regexp_extract_all(x, any_of, F.lit(0))
    s = F.array_join(F.transform(F.arrays_zip(rest.alias("r"), hits.alias("a")), lambda z: F.concat(z["r"], F.coalesce(F.element_at(known, z["a"]), F.lit("")))), "")
    return F.when(F.size(known) > 0, F.struct(s.alias("s"), F.size(hits).alias("n"))).otherwise(F.struct(x.alias("s"), F.lit(0).alias("n")))


def replace(docs: DataFrame, key: str | None = None, text: str = "text", counted: str = "n_entities") -> DataFrame:
    """docs with `text` rewritten, and the number of its mentions as column `counted`."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, PUBLIC_KEY)
    t = F.col(text)
    # A case keeps the order: the long expression only sees texts with a hint.
    has = F.when(F.coalesce(t.rlike(_HINT), F.lit(False)), t.rlike(UNION)).otherwise(False)
    found = docs.filter(has).select(t.alias("t")).groupBy(F.xxhash64("t").alias("h"), F.length("t").alias("len")).agg(F.first("t").alias("t"))
    mentions = found.select("h", "len", F.posexplode(F.regexp_extract_all("t", F.lit(UNION), F.lit(0))).alias("i", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("entity", canonical(F.col("mention"), F.col("kind")))
    mentions = store(mentions, "pii-mentions")
    m = mentions.join(assign(mentions, key), ["kind", "entity"])
    r = render(F.col("mention"), F.col("kind"), F.col("fake"))
    m = m.withColumn("_title", r["title"]).withColumn("_body", r["body"]).withColumn("_new", r["new"]).withColumn("new", F.concat("_title", r["written"]))
    m = m.withColumn("_known", _aliases(F.col("i"), F.col("kind"), F.col("_body"), F.expr("substring(new, length(_title) + 1)")))
    per = m.groupBy("h", "len").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "new"))), lambda s: s["new"]).alias("fakes"), F.sort_array(F.flatten(F.collect_list("_known"))).alias("_known"))
    # One fake for each alias, the earliest name's; in the expression longer aliases come first.
    per = per.withColumn("known", F.map_from_entries(F.transform(F.array_distinct(F.transform("_known", lambda k: k["alias"])), lambda a: F.struct(a, F.get(F.filter("_known", lambda k: k["alias"] == a), F.lit(0))["fake"]))))
    longest = F.transform(F.sort_array(F.transform(F.map_keys("known"), lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))), asc=False), lambda z: F.concat(F.lit(r"\Q"), z["a"], F.lit(r"\E")))
    per = per.select("h", "len", "fakes", "known", F.concat(F.lit(r"(?<![\p{L}0-9])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}0-9])")).alias("any_of")).alias("p")
    clean = docs.filter(~has).withColumn(counted, F.lit(0).cast("long"))
    # Names of the two sides stay apart by their aliases, whatever columns docs has.
    d = docs.filter(has).alias("d")
    met = d.join(per, (F.xxhash64(F.col(f"d.`{text}`")) == F.col("p.h")) & (F.length(F.col(f"d.`{text}`")) == F.col("p.len")))
    pieces = F.split(F.col(f"d.`{text}`"), UNION)
    done = F.transform(pieces, lambda x: _bare(x, F.col("p.known"), F.col("p.any_of")))
    kept = [c for c in docs.columns if c not in (text, counted)]
    met = met.select(*[F.col(f"d.`{c}`") for c in kept], F.col("p.fakes").alias("_al_fakes"), done.alias("_al_done"))
    whole = F.array_join(F.transform("_al_done", lambda x, i: F.concat(x["s"], F.coalesce(F.get("_al_fakes", i), F.lit("")))), "")
    bare = F.aggregate("_al_done", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    changed = met.select(*[whole.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != counted], (F.size("_al_fakes") + bare).alias(counted))
    return clean.unionByName(changed)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
