import random

from auditloom.operators import findings as fd

SCHEMA = "rule_id string, path string, target string, snippet string, start_line int"


def plain_way(actual, reviewed, band):
    """The same by looking at all pairs of one key, round after round."""
    a, b, out = list(actual), list(reviewed), []
    for x in list(a):
        if x in b:
            a.remove(x)
            b.remove(x)
    while True:
        choose = {}
        for mine, theirs, tag in ((a, b, "a"), (b, a, "b")):
            for i, x in enumerate(mine):
                near = [(abs(x[4] - y[4]), not (y[4] < x[4] or y[4] == x[4]), y[4], j) for j, y in enumerate(theirs) if y[:4] == x[:4]]
                if near and min(near)[0] <= band:
                    choose[tag, i] = min(near)
        found = []
        taken_a, taken_b = set(), set()
        for (tag, i), (_, _, line, _) in sorted(choose.items()):
            if tag == "a" and i not in taken_a:
                for j, y in enumerate(b):
                    if j not in taken_b and y[:4] == a[i][:4] and y[4] == line and ("b", j) in choose and choose["b", j][2] == a[i][4]:
                        found.append((i, j))
                        taken_a.add(i)
                        taken_b.add(j)
                        break
        if not found:
            break
        out += [("moved", *a[i], b[j][4]) for i, j in found]
        a = [x for i, x in enumerate(a) if i not in taken_a]
        b = [y for j, y in enumerate(b) if j not in taken_b]
    return sorted(map(str, [*out, *(("new", *x, None) for x in a), *(("gone", *y[:4], None, y[4]) for y in b)]))


def got(spark, actual, reviewed, band=50):
    df = fd.aligned_diff(spark.createDataFrame(actual, SCHEMA), spark.createDataFrame(reviewed, SCHEMA), band)
    return sorted(str(tuple(r)) for r in df.select("change", "rule_id", "path", "target", "snippet", "start_line", "old_line").collect())


def f(line, path="a.py", snippet="s", rule="R"):
    return (rule, path, "t", snippet, line)


def test_moves_copies_and_limits(spark):
    assert got(spark, [f(12)], [f(10)]) == ["('moved', 'R', 'a.py', 't', 's', 12, 10)"]
    assert got(spark, [f(12)], [f(12)]) == [] and got(spark, [], []) == []
    assert got(spark, [f(61)], [f(10)]) == ["('gone', 'R', 'a.py', 't', 's', None, 10)", "('new', 'R', 'a.py', 't', 's', 61, None)"]
    assert got(spark, [f(60)], [f(10)]) == ["('moved', 'R', 'a.py', 't', 's', 60, 10)"]
    assert got(spark, [f(5, "b.py"), f(5, snippet=None)], [f(5), f(6, snippet=None)]) == ["('gone', 'R', 'a.py', 't', 's', None, 5)", "('moved', 'R', 'a.py', 't', None, 5, 6)", "('new', 'R', 'b.py', 't', 's', 5, None)"]
    # Three lines go down by two, and a fourth comes before them: nearest ones first, then the rest.
    assert len([x for x in got(spark, [f(1), f(12), f(22), f(32)], [f(10), f(20), f(30)]) if "moved" in x]) == 3
    assert got(spark, [f(7)] * 3, [f(8)] * 2) == ["('moved', 'R', 'a.py', 't', 's', 7, 8)"] * 2 + ["('new', 'R', 'a.py', 't', 's', 7, None)"]


def test_random_edits_equal_the_plain_way(spark):
    rng = random.Random(4)
    reviewed = [f(line, path=f"p{p}", snippet=rng.choice("xy")) for p in range(12) for line in rng.sample(range(1, 400), 25)]
    actual = []
    for p in range(12):
        shift = rng.randint(-20, 20)
        mine = [x for x in reviewed if x[1] == f"p{p}" and rng.random() > 0.15]
        actual += [(*x[:4], max(1, x[4] + (shift if x[4] > 200 else 0))) for x in mine] + [f(rng.randint(1, 400), path=f"p{p}", snippet="x") for _ in range(3)]
    want = plain_way(actual, reviewed, 30)
    have = got(spark, actual, reviewed, 30)
    assert have == want and sum("moved" in x for x in have) > 60
