import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.functions.text import java_regex
from auditloom.operators import match
from auditloom.plans import rules as rl


@pytest.mark.parametrize("pattern, want", [("(?iU)a(?!b[)(]\\))c", "(?iU:ac)"), ("(?U)x[^$]\\$", "(?U:x[^$]\\$)"), ("(?U)^a", None), ("(?U)a$", None), ("(?U)a\\Z", None), ("(?U)a(?=b)", None), ("(?U)(?<!a)b(c)", "(?U:b(c))")])
def test_relaxed(pattern, want):
    assert match.relaxed(pattern) == want


def test_a_text_with_a_matching_line_is_never_left_out(spark):
    """Lines put together from pieces that the built-in patterns look for."""
    rng = random.Random(1)
    pieces = ["api_key", " = ", "'abcdefghijklmnop1234'", "verify", "=", "False", "base_url='http://", "localhost", "models", "sk-", "a" * 40, "4111111111111111", "12345678Z", "X1234567L", "skip_data_validation", "prompt = f'", "{user_input}'", "ai_disclaimer = False", "return r.choices[0].message.content", "\n", "\r\n", " ", " ", "x", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    patterns = [re.compile(p["target"]) for *_, p in rl.builtin().patterns("regex")]
    assert None not in [match.relaxed(java_regex(p.pattern)) for p in patterns]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(match.may_match(F.col("t"), rl.builtin())).collect()]
    want = [any(p.search(line) for p in patterns for line in t.splitlines()) for t in texts]
    assert sum(want) > 300 and all(g or not w for g, w in zip(got, want))


@pytest.mark.parametrize("pattern, want", [
    ("(?i)Verify\\s*=", ["verify"]), ("abc|def", None), ("((abc)?def)?x", None), ("a{0,3}bc", None), ("ab{3}cdef", ["cdef"]), ("\\u00e9999x", ["999x"]), ("(?x)a b c d", None), ("(one|two){2}", None), ("(one|three)\\b-x", ["one", "three"]),
    ("[0-9]{7}[a-z]", ["0000000"]), ("x[abc]+yzw?", None), ("abc+d", ["abc"]), ("(?<!foo)barbaz", ["barbaz"]), ("caf\u00e9s", ["caf"]), ("abc[)]def", ["abc"]), ("(?:a(b|c)d|e)long(?!x)er", ["longer"]), ("", None), ("\\.py\\.js", [".py.js"]),
])
def test_factors(pattern, want):
    assert match.factors(pattern) == want


def test_matches_have_a_factor():
    """Random patterns and texts: what matches has one of the pattern's factors."""
    rng, seen = random.Random(5), 0
    piece = ["abc", "de", "(ab|cde)", "(x|yz)?", "[ab]+", "\\d{3}", "[0-9]{4}", "f*", "gh{2}", "\\.", "\\b", "(?:ab)+", "((q)r)?", "k+", "(?!z)"]
    for _ in range(10000):
        p = "".join(rng.choice(piece) for _ in range(rng.randint(1, 5)))
        t = "".join(rng.choice(["abc", "de", "ab", "cde", "1234", "123", "f", "ghh", ".", "qr", "kk", "x", "yz"]) for _ in range(8))
        found = match.factors(p)
        if found and re.search(p, t):
            seen += 1
            assert any(x in t if set(x) != {"0"} else re.search(f"[0-9]{{{len(x)}}}", t) for x in found), (p, t, found)
    assert seen > 200
