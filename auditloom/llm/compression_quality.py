"""Quality classifier by compression.

Two views of a text are compressed, its bytes and its outline, each with a zstandard
dictionary of good and one of bad labelled texts, in short blocks so that a block can lean
on the dictionary only. The normalised difference of the two sizes, one for each view, says
which kind the text resembles. A logistic curve, fitted on labelled texts that did not
enter the dictionaries, turns both into a calibrated probability. The outline keeps
punctuation and blanks, writes a run of small letters as `a`, of capitals as `A`, of
digits as `9`, and a word equal to the one before it as `=`: it holds for words that
no dictionary has seen. The bytes' dictionaries are trained by the library; outlines are
alike in everything but detail, so theirs are raw content, blocks one after the other.

What is fitted comes from a bounded sample: of the labelled rows outside the held-out
fold, those of each label with the `sample` smallest hashes of their id. These texts are
read whole, by the executors: every second one is cut into blocks, of which the dictionaries
take `blocks` for each label, one of each text in the order of hashes of their places, then a
second of each and so on, wherever in the text they stand. The driver sees these blocks and two
numbers for each text. Every text is scored whole, however long. Labels, language, source and
id are no inputs of a score.

Edge cases: null, empty and blank texts get one fixed score, the sample's share of good
labels among such texts, smoothed; if a label is missing from the sample all scores are
the share of good labels (0.5 without any). Repeated rows get equal scores, also under one
id; of rows that share a labelled id one is learnt from. An id that is labelled both ways
counts as bad. An empty table stays empty; a column with the score's name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches, store, table

LEVEL, DICT_BYTES = 3, 64 * 1024

_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = ord("9"), ord("A"), ord("a"), ord("a")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("9"), ord("A"), ord("a")]] = True


def outline(text: str) -> bytes:
    out, last = [], None
    for buf in wordhash.pieces(text.encode("utf-8", "surrogatepass")):
        starts, ends = wordhash.spans(buf)
        kind = _KIND[buf]
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
        if len(starts):
            h = wordhash.hashes(buf, starts, ends)
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[0] = last is not None and h[0] == last
            last = h[-1]
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[starts[same]] += 1
            edge[ends[same]] -= 1
            keep &= ~np.cumsum(edge[:-1]).astype(bool)
            kind[starts[same]], keep[starts[same]] = ord("="), True
        out.append(kind[keep].tobytes())
    return b"".join(out)


def raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


#: view -> (function, bytes of a block, whether its dictionaries are trained).
VIEWS = {"text": (raw, 256, True), "outline": (outline, 64, False)}


def _blocks(view: str, text: str) -> list[bytes]:
    make, size, _ = VIEWS[view]
    whole = make(text)
    return [whole[i : i + size] for i in range(0, len(whole), size)]


def _dictionary(view: str, blocks: list[bytes]) -> tuple[bytes, bool]:
    """Content, and whether it is a trained dictionary; too few blocks to train on are taken as they are."""
    if VIEWS[view][2]:
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks, k=200, d=8).as_bytes(), True
        except zstandard.ZstdError:
            pass
    return b"\n".join(blocks)[:DICT_BYTES], False


def _compressors(model: dict) -> dict[str, list[zstandard.ZstdCompressor]]:
    """For each view the good and the bad one."""
    out = {}
    for view, two in model["dictionaries"].items():
        out[view] = []
        for content, trained in two:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            out[view].append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(text: str, both: dict[str, list[zstandard.ZstdCompressor]]) -> list[float]:
    """For each view the normalised difference of the compressed sizes; positive is like good texts."""
    out = []
    for view, (good, bad) in both.items():
        g = b = 0
        for block in _blocks(view, text):
            g, b = g + len(good.compress(block)) - 5, b + len(bad.compress(block)) - 5
        out.append((b - g) / (b + g + VIEWS[view][1]))  # one more block, so that a few words alone decide little
    return out


def calibrated(xs: np.ndarray, ys: np.ndarray, start: float) -> list[float]:
    """Coefficients of a logistic curve, the constant last: Newton steps, lightly regularised."""
    scale = np.maximum(1e-6, np.sqrt((xs**2).mean(axis=0)))
    x = np.column_stack((xs / scale, np.ones(len(xs))))
    w, ridge = np.append(np.zeros(xs.shape[1]), start), np.append(np.full(xs.shape[1], 1e-3), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - ys) + np.append(ridge[:-1] * w[:-1], 0))
        w = w - step
        if np.abs(step).sum() < 1e-9:
            break
    return [*(w[:-1] / scale), w[-1]]


def is_blank(text: str | None) -> bool:
    return not (text and text.strip())


def score_text(text: str | None, model: dict, both: dict[str, list[zstandard.ZstdCompressor]]) -> float:
    if is_blank(text):
        return model["blank"]
    z = model["w"][-1] + sum(a * x for a, x in zip(model["w"], differences(text, both)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """y, half, text: of each label the rows with the smallest id hashes, at most `sample`, one for each id."""
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y")).filter(fold() != 0)
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return store(one.select("y", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half"), "r.text"), "quality-sample")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not is_blank(text):
                for view in VIEWS:
                    own = blake2b(raw(text), digest_size=16).digest()
                    each = sorted((blake2b(own + i.to_bytes(8, "big"), digest_size=16).digest(), b) for i, b in enumerate(_blocks(view, text)))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    columns = ([view] * len(each), [y] * len(each), range(len(each)), [h for h, _ in each], [b for _, b in each])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["view", "y", "turn", "h", "block"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, blocks: int = 16_384) -> dict:
    """docs: doc_id, text. labels: doc_id, quality. sample: labelled rows of each label; blocks: blocks
    of a view and label that its dictionary is made from."""
    rows = sampled(docs, labels, sample)
    half = F.col("half")
    cut = store(small_batches(rows.filter(half == 0).select("y", "text")).mapInArrow(_cut, "view string, y int, turn long, h binary, block binary"), "quality-blocks")
    some = None
    for view in VIEWS:
        for y in (0, 1):
            part = cut.filter((F.col("view") == view) & (F.col("y") == y)).orderBy("turn", "h", "block").limit(blocks)
            some = part if some is None else some.unionByName(part)
    taken: dict[tuple, list] = {}
    for r in some.collect():  # at most `blocks` for each view and label
        taken.setdefault((r["view"], r["y"]), []).append((r["turn"], bytes(r["h"]), bytes(r["block"])))
    model = {"dictionaries": {}}
    if len(taken) == 2 * len(VIEWS):
        model["dictionaries"] = {view: [_dictionary(view, [b for *_, b in sorted(taken[view, y])]) for y in (1, 0)] for view in VIEWS}
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded: four dictionaries

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _compressors(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            xs = [[] if is_blank(t) else differences(t, both) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(is_blank, texts), pa.bool_()), pa.array(xs, pa.list_(pa.float64()))], names=["y", "half", "blank", "xs"])

    found = small_batches(rows.select("y", "half", "text")).mapInArrow(measure, "y int, half int, blank boolean, xs array<double>").collect()  # at most `sample` for each label
    blank = [r["y"] for r in found if r["blank"]]
    full = sorted((r["xs"], r["y"], r["half"]) for r in found if not r["blank"])
    prior = (sum(y for _, y, _ in full) + 1) / (len(full) + 2)
    start = math.log(prior / (1 - prior))
    model |= {"w": [start], "blank": (sum(blank) + 0.5) / (len(blank) + 5)}
    xs, ys = [x for x, _, h in full if h == 1], [y for _, y, h in full if h == 1]
    if model["dictionaries"] and min(sum(ys), len(ys) - sum(ys)) >= 2:
        model["w"] = [float(v) for v in calibrated(np.array(xs), np.array(ys), start)]
    else:
        model["dictionaries"] = {}
    return model


def fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column for the score."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: four dictionaries
    names, at = [*docs.columns, out], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _compressors(shared.value)
        for batch in batches:
            values = [score_text(t.as_py(), shared.value, both) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=names)

    return small_batches(docs).mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
