import numpy as np
import pyarrow.parquet as pq
import pytest

from auditloom.llm import embedding_dedup as ed
from auditloom.llm.hnsw import Graph, layer_sizes


def brute(ids, vectors, limit=0.95):
    """(id, links, least reachable id) of every row, from all cosines."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    near = np.zeros((n, n), bool)
    for d in {len(v) for v, o in zip(vectors, ok) if o}:
        at = np.array([k for k in range(n) if ok[k] and len(vectors[k]) == d])
        x = np.array([vectors[k] for k in at], np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near[np.ix_(at, at)] = x @ x.T >= limit
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.array([min(label[k], *label[near[k]]) if near[k].any() else label[k] for k in range(n)])
        if (new == label).all():
            break
        label = new
    best = {}
    for k in range(n):
        if ids[k] is not None:
            best[label[k]] = min(best.get(label[k], ids[k]), ids[k])
    return [(ids[k], int(near[k].sum()), best.get(label[k])) for k in range(n)]


def got(df):
    return sorted(((r["id"], r["n_links"], r["component"]) for r in df.collect()), key=str)


def vectors(rng, dim=32):
    out = [rng.normal(size=dim) for _ in range(300)]
    for c in range(6):  # groups of near copies, one of them large
        centre = rng.normal(size=dim)
        out += [centre + rng.normal(size=dim) * 0.16 for _ in range(250 if c == 0 else 6)]
    chain = rng.normal(size=dim)  # neighbours are linked, ends are not
    for _ in range(12):
        chain = chain + rng.normal(size=dim) * 0.27
        out.append(chain)
    return [v.astype(np.float32).tolist() for v in out]


def test_result_equals_brute_force_with_every_edge(spark):
    rng = np.random.default_rng(1)
    vs = vectors(rng)
    vs += [vs[0]] * 40 + [[x * 4 for x in vs[1]], [-x for x in vs[1]]]  # copies, another length, the opposite
    ids = [int(x) for x in rng.permutation(len(vs))]
    odd = [None, [], [0.0] * 32, [None, *[1.0] * 31], [float("nan"), *[1.0] * 31], [float("inf"), *[1.0] * 31], [1.0, 2.0], [2.0, 4.0], [2.0, 4.1], [3e38] * 32, [1e-40] * 32, [1.0] * 32]
    vs += odd + [vs[5], vs[6]]
    ids += [2000 + k for k in range(len(odd))] + [None, ids[6]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vs)], "vec_id long, embedding array<float>, class string, rows int")
    found, audits = ed.near_vectors(df, recall=1.0, shards=3)
    assert found.columns == ["id", "n_links", "component", "kept"]
    assert got(found) == sorted(brute(ids, vs), key=str)
    assert all(r["kept"] == (r["id"] == r["component"]) for r in found.collect())
    a = audits.collect()
    assert len(a) >= 6 and all(r["found"] == r["links"] for r in a)


def test_doubles_ties_and_limits(spark):
    c = 0.95
    vs = [[1.0, 0.0], [c, float(np.sqrt(1 - c * c))], [1e200, 0.0], [1e-200, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    found = {r["id"]: (r["n_links"], r["component"]) for r in ed.near_vectors(df, limit=0.9499999999)[0].collect()}
    assert found == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}


@pytest.mark.parametrize("shards", [1, 5])
def test_result_does_not_depend_on_the_shards(spark, shards):
    vs = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    assert got(ed.near_vectors(df, recall=1.0, shards=shards)[0]) == sorted(brute(list(range(len(vs))), vs), key=str)


def test_given_table_equals_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    want = sorted(brute(t["vec_id"].to_pylist(), t["embedding"].to_pylist()), key=str)
    found = ed.op13_embedding_dedup(spark, "/root/testdata/sf0.1")
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()), key=str) == want


def test_empty_table(spark):
    found, audits = ed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.count() == 0 and audits.count() == 0


def test_graph_reaches_all_and_beams_widen():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(3000, 24)), rng.normal(size=24) + rng.normal(size=(700, 24)) * 0.1])
    rng.shuffle(x)
    u = ed.unit(x)
    g = Graph.build(u.astype(np.float32))
    assert [len(k) for k in g.links] == layer_sizes(len(u))
    ids, _ = g.search(u[:1000].astype(np.float32), 32)
    assert (ids[:, 0] == np.arange(1000)).mean() > 0.99
    shard = ed._Shard.__new__(ed._Shard)
    shard.keys, shard.exact, shard.graph = np.arange(len(u)), u, g
    s = ed.Searcher(shard, 0.95)
    pairs = [np.stack(p) for p in s.links(u)]
    found = set(zip(*np.concatenate(pairs, axis=1).tolist()))
    want = set(zip(*(a.tolist() for a in np.nonzero(u @ u.T >= 0.95))))
    assert found <= want and len(found) > 0.99 * len(want) and len(want) > 400 * 700
    assert sum(p.shape[1] for p in pairs) == len(found)
    true, hits = s.audit([u[:200]], 0.995)
    assert hits >= 0.995 * true
