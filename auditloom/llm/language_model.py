"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Three passes over whole texts. (1) Words are hashed and counted; ranges of the hash
space become sorted hash arrays with counts, and a word's number is its place in them.
(2) Bigrams, as pairs of such numbers with a begin mark as first context, are hashed one
to one and counted; ranges of the hash space become sorted hash arrays with counts, so that
a context with many followers is dealt over all of them. Each range's sums by context and
by word meet in ranges of these numbers. (3) Workers map these files into memory, look the words and bigrams of whole batches up
by binary search, and score. Every task sums its own keys before the shuffle and sends
each range as one compressed row, so a frequent word costs a range no more than a rare
one; a range is one task, which reads about what PART_MB of text amount to at any size. Files lie in the shared folder, are written under a temporary name and moved into
place, so a lost executor's task can simply run again.

P(w|u) = max(c(uw) - D, 0) / c(u) + g(u) * Pc(w), where Pc is the same form over the
number of distinct words before w, interpolated with the uniform 1 / (V + 1). Three
discounts D for counts 1, 2 and 3 or more at each level come from the counts of counts.
The order is two: arrays of order three would need more disk than the input has.

Edge cases: a null or blank text is the end token alone; training texts may repeat and
count as often as they occur; without training rows every token has probability 1 /
(V + 1) = 1; words that training never met are scored by the uniform part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import shared_dir, store, table

END = np.uint64(0x8000000000000001)  # the end token's hash
CHUNK = 2_000_000  # words that are sorted at once
PART_MB = 24  # megabytes of text for each range of a model's arrays


def local_path(uri: str) -> str:
    """The path by which driver and workers both open files of the shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped models need a shared folder that is mounted as a file system, not {uri}")
    return uri


def _save(path: str, arrays: dict[str, np.ndarray]) -> None:
    for name, a in arrays.items():
        final = f"{path}.{name}.npy"
        own = f"{final}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, a)
        os.replace(own, final)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _unmix(x: np.ndarray) -> np.ndarray:
    """The key of which x is wordhash.mix."""
    inverse = lambda m: np.uint64(pow(int(m), -1, 1 << 64))
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * inverse(wordhash._M2)
        x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * inverse(wordhash._M1)
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the upper halves as differences, so that they compress."""
    upper = (keys >> np.uint64(32)).astype(np.uint32)
    return _pack(np.concatenate((np.diff(upper, prepend=np.uint32(0)).astype(np.uint32), keys.astype(np.uint32))))


def _unpack_sorted(b: bytes) -> np.ndarray:
    both = _unpack(b, np.uint32)
    n = len(both) // 2
    upper = np.cumsum(both[:n], dtype=np.uint64)
    return upper << np.uint64(32) | both[n:].astype(np.uint64)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of each column of counts."""
    if not len(keys):
        return (keys.astype(np.uint64), *(c.astype(np.int64) for c in counts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in counts))


class _Tally:
    """Counts of 64-bit keys; sorted runs are merged when they double."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            k, c = np.unique(keys, return_counts=True)
            self.runs.append((k, c.astype(np.int64)))
            while len(self.runs) > 1 and len(self.runs[-1][0]) * 2 > len(self.runs[-2][0]):
                (k1, c1), (k2, c2) = self.runs.pop(), self.runs.pop()
                self.runs.append(_summed(np.concatenate((k2, k1)), np.concatenate((c2, c1))))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _summed(np.concatenate([k for k, _ in self.runs]), np.concatenate([c for _, c in self.runs]))


def _texts(batches: Iterator[pa.RecordBatch], step: int = 2_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their tokens: word hashes, each text's followed by END, and token counts."""
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            h, n = wordhash.batch_hashes(batch.column(batch.num_columns - 1).to_pylist())
            yield batch, np.insert(h, np.cumsum(n), END), n + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    hs, ns, size = [], [], 0
    for _, h, n in _texts(batches):
        hs.append(h)
        ns.append(n)
        size += len(h)
        if size >= CHUNK:
            yield np.concatenate(hs), np.concatenate(ns)
            hs, ns, size = [], [], 0
    if hs:
        yield np.concatenate(hs), np.concatenate(ns)


#: Sorted keys and columns of counts of one range; seat: the number that the range is shuffled by.
_COUNTED = "seat int, keys binary, counts array<binary>"


def seats(spark: SparkSession, n: int) -> list[int]:
    """For each k under n a number that Spark's hash partitioning into n puts into partition k, so
    that n ranges are n tasks, one each, and none reads several."""
    found: dict[int, int] = {}
    upto = 0
    while len(found) < n:
        some = spark.range(upto, upto + 16 * n, 1, 1).select(F.col("id").cast("int").alias("x")).select("x", F.pmod(F.hash("x"), F.lit(n)).alias("k"))
        for r in some.groupBy("k").agg(F.min("x").alias("x")).collect():  # at most n
            found.setdefault(r["k"], r["x"])
        upto += 16 * n
    return [found[k] for k in range(n)]


def _by_range(seat: list[int], parts: np.ndarray, keys: np.ndarray, *counts: np.ndarray) -> list[tuple]:
    """One row for each range; parts: the range of each key, ascending; seat: the ranges' numbers."""
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    return [(seat[int(parts[a])], _pack_sorted(keys[a:b]), [_pack(c[a:b].astype(np.int64)) for c in counts]) for a, b in zip(cuts, [*cuts[1:], len(keys)])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["seat", "keys", "counts"])


def _least(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    columns = zip(*([_unpack(c, np.int64) for c in row] for row in pdf["counts"]))
    return _summed(np.concatenate([_unpack_sorted(k) for k in pdf["keys"]]), *(np.concatenate(c) for c in columns))


def _hash_range(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Lookup:
    """Sorted arrays in files, one for each range of keys, mapped into memory."""

    def __init__(self, folder: str, name: str, sizes: list[int]) -> None:
        self.keys = [np.load(f"{folder}/{name}-{p:05d}.keys.npy", mmap_mode="r") if n else np.zeros(0, np.uint64) for p, n in enumerate(sizes)]
        self.folder, self.name, self.sizes = folder, name, sizes
        self.offset = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        live = [p for p, n in enumerate(sizes) if n]
        self.live, self.lowest = live, np.array([self.keys[p][0] for p in live], np.uint64)

    def column(self, name: str) -> list[np.ndarray]:
        return [np.load(f"{self.folder}/{self.name}-{p:05d}.{name}.npy", mmap_mode="r") if n else np.zeros(0) for p, n in enumerate(self.sizes)]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of ascending keys in all ranges together, -1 where there is none."""
        out = np.full(len(wanted), -1, np.int64)
        cuts = np.append(np.searchsorted(wanted, self.lowest), len(wanted))
        for k, p in enumerate(self.live):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if a < b:
                keys = self.keys[p]
                at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == wanted[a:b], at + self.offset[p], -1)
        return out

    def take(self, column: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Values at places, which ascend but for -1; -1 gives 0."""
        if len(places) and places.min() < 0:
            out = np.zeros(len(places), np.float64)
            there = places >= 0
            out[there] = self.take(column, places[there])
            return out
        out = np.zeros(len(places), np.float64)
        cuts = np.searchsorted(places, self.offset)
        for p in self.live:
            a, b = int(cuts[p]), int(cuts[p + 1])
            if a < b:
                out[a:b] = column[p][places[a:b] - self.offset[p]]
        return out


def _ids(vocab: Lookup, h: np.ndarray) -> np.ndarray:
    """Numbers of words; those that training never met get vocab's size plus one."""
    u, back = np.unique(h, return_inverse=True)
    at = vocab.find(u)
    return np.where(at < 0, vocab.offset[-1] + 1, at)[back]


def _pairs(ids: np.ndarray, n: np.ndarray, begin: int) -> np.ndarray:
    """Bigram keys of texts that lie one after the other."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.concatenate(([0], np.cumsum(n)[:-1]))] = begin
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the number of keys that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _four(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, text: str = "text") -> dict:
    """Counts docs and returns the model: sizes, sums and the folder of its files."""
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark)) + f"/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    docs = docs.select(F.col(text).alias("text"))
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-letters // (PART_MB << 20)))
    seat = seats(spark, parts)
    place = {x: k for k, x in enumerate(seat)}
    seat2 = seats(spark, 2 * parts)  # contexts, then words
    place2 = {x: k for k, x in enumerate(seat2)}

    def words_of(batches):
        tally = _Tally()
        for h, _ in _chunks(batches):
            tally.add(h)
        k, c = tally.total()
        if len(k):
            yield _batch(_by_range(seat, _hash_range(k, parts), k, c))

    def vocab_range(pdf: pd.DataFrame) -> pd.DataFrame:
        p = place[int(pdf["seat"].iloc[0])]
        k, c = _merged(pdf)
        _save(f"{folder}/vocab-{p:05d}", {"keys": k, "counts": _least(c)})
        return pd.DataFrame({"part": [p], "n": [len(k)], "total": [int(c.sum())]})

    done = store(docs.mapInArrow(words_of, _COUNTED).repartition(parts, "seat").groupBy("seat").applyInPandas(vocab_range, "part int, n long, total long"), "lm-vocab")
    rows = done.collect()  # one for each range of hashes
    sizes = [0] * parts
    for r in rows:
        sizes[r["part"]] = r["n"]
    size, tokens = sum(sizes), sum(r["total"] for r in rows)
    if size + 2 >= 1 << 32:
        raise ValueError("more distinct words than bigram keys have room for")

    def bigrams_of(batches):
        vocab, tally = Lookup(folder, "vocab", sizes), _Tally()
        for h, n in _chunks(batches):
            tally.add(wordhash.mix(_pairs(_ids(vocab, h), n, size)))
        k, c = tally.total()
        if len(k):
            yield _batch(_by_range(seat, _hash_range(k, parts), k, c))

    def bigram_range(pdf: pd.DataFrame) -> pd.DataFrame:
        p = place[int(pdf["seat"].iloc[0])]
        k, c = _merged(pdf)
        _save(f"{folder}/bigram-{p:05d}", {"keys": k, "counts": _least(c)})
        pairs, one = _unmix(k), np.ones(len(k), np.int64)
        number = lambda x: (x * np.uint64(parts) // np.uint64(size + 1)).astype(np.int64)
        u, *sums = _summed(pairs >> np.uint64(32), c, c == 1, c == 2, c >= 3)
        w, before = _summed(pairs & np.uint64(0xFFFFFFFF), one)
        out = pd.DataFrame([*_by_range(seat2, number(u), u, *sums), *_by_range(seat2[parts:], number(w), w, before)], columns=["seat", "keys", "counts"])
        return out.assign(range=p, n=len(k), four=[_four(c)] * len(out))

    met = store(docs.mapInArrow(bigrams_of, _COUNTED).repartition(parts, "seat").groupBy("seat").applyInPandas(bigram_range, f"{_COUNTED}, range int, n long, four array<long>"), "lm-bigrams")
    pairs, four = [0] * parts, np.zeros(4, np.int64)
    for r in met.select("range", "n", "four").distinct().collect():  # one for each range of bigrams
        pairs[r["range"]] = r["n"]
        four += np.array(r["four"])

    def number_range(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, p = divmod(place2[int(pdf["seat"].iloc[0])], parts)
        kind = ("context", "before")[kind]
        k, n, *rest = _merged(pdf)
        _save(f"{folder}/{kind}-{p:05d}", {"keys": k, "counts": _least(n), **{name: _least(x) for name, x in zip(("one", "two", "more"), rest)}})
        return pd.DataFrame({"sums": [kind], "part": [p], "n": [len(k)], "more": [int((n >= 3).sum())], "four": [_four(n)]})

    rows = store(met.select("seat", "keys", "counts").repartition(2 * parts, "seat").groupBy("seat").applyInPandas(number_range, "sums string, part int, n long, more long, four array<long>"), "lm-sums").collect()
    found = {"context": [0] * parts, "before": [0] * parts}
    low, more = np.zeros(4, np.int64), 0
    for r in rows:
        found[r["sums"]][r["part"]] = r["n"]
        if r["sums"] == "before":
            low, more = low + np.array(r["four"]), more + r["more"]
    d = discounts(list(low))
    held = d[0] * float(low[0]) + d[1] * float(low[1]) + d[2] * more
    return {"folder": folder, "vocab": sizes, "bigram": pairs, **found, "size": size, "tokens": tokens, "pairs": sum(pairs), "d": discounts(list(four)), "d_low": d, "held": held}


class Model:
    """The files of train(), as a worker sees them."""

    def __init__(self, m: dict) -> None:
        self.m = m
        self.vocab, self.bigram, self.context, self.before = (Lookup(m["folder"], k, m[k]) for k in ("vocab", "bigram", "context", "before"))
        self.seen, self.met, self.sources = self.vocab.column("counts"), self.bigram.column("counts"), self.before.column("counts")
        self.sums = [self.context.column(k) for k in ("counts", "one", "two", "more")]

    def _sorted(self, number: np.ndarray) -> np.ndarray:
        """Places in `before`: numbers of known words ascend as the words do, the others are not there."""
        out = np.full(len(number), -1, np.int64)
        known = number < self.m["size"]
        out[known] = self.before.find(number[known].astype(np.uint64))
        return out

    @staticmethod
    def _less(c: np.ndarray, d: list[float]) -> np.ndarray:
        return c - np.choose(np.minimum(c, 3).astype(np.int64), [0.0, *d])

    def score(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score, log10 probability."""
        m, size = self.m, self.m["size"]
        u, back = np.unique(h, return_inverse=True)
        at = self.vocab.find(u)
        count = self.vocab.take(self.seen, at)
        base = np.log10((count + 0.1) / (m["tokens"] + 0.1 * (size + 1)))
        number = np.where(at < 0, size + 1, at)
        ids = number[back]
        sources = self.before.take(self.sources, self._sorted(number))
        uniform = 1.0 / (size + 1)
        low = (self._less(sources, m["d_low"]) + m["held"] * uniform) / m["pairs"] if m["pairs"] else np.full(len(u), uniform)
        pairs, pair_of = np.unique(_pairs(ids, n, size), return_inverse=True)
        mixed = wordhash.mix(pairs)
        order = np.argsort(mixed)
        c = np.zeros(len(pairs), np.float64)
        c[order] = self.bigram.take(self.met, self.bigram.find(mixed[order]))
        before = pairs >> np.uint64(32)
        contexts, context_of = np.unique(before, return_inverse=True)
        place = self.context.find(contexts)
        total, one, two, more = (self.context.take(x, place)[context_of] for x in self.sums)
        back_off = np.where(total > 0, (m["d"][0] * one + m["d"][1] * two + m["d"][2] * more) / np.maximum(total, 1), 1.0)
        log = np.log10((self._less(c, m["d"]) / np.maximum(total, 1))[pair_of] + back_off[pair_of] * low[back])
        cuts = np.concatenate(([0], np.cumsum(n)[:-1]))
        return np.add.reduceat((count[back] > 0).astype(np.int64), cuts), np.add.reduceat(base[back], cuts), np.add.reduceat(log, cuts)


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score and score."""
    keep = [c for c in docs.columns if c != text]
    added = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        m = Model(model)
        for batch, h, n in _texts(batches):
            known, base, log = m.score(h, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(log, pa.float64())], names=[*keep, *added])

    zero = F.lit(0).cast("long")
    schema = docs.select(*keep).withColumns({"n_tokens": zero, "n_known": zero, "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10))
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold == 0).alias("held_out"), "text")
    model = train(docs.filter("NOT held_out"))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
