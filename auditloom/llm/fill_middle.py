"""Fill-in-the-middle training texts.

A text is a row of units, runs of A-Z and a-z or one other code point each. Two hashed
cuts between units divide it into prefix, middle and suffix; the output puts the suffix
(or, in the spm form, the suffix first) before the middle, behind marks. One finditer of the
regex library collects the units' end offsets in an array of four-byte numbers, two
look-ups there give the slices, and hashlib gives the cuts and digests. It is one narrow
map: nothing is shuffled, and memory is that of a batch of texts.

Edge cases: null and empty texts have no units and stay plain (their output is empty);
texts that hold a mark stay plain, so that a transformed text can always be taken apart
again; texts of any length are cut whole; repeated rows give the same, as the cuts depend
on the seed and the id alone; a null id hashes as no digits; an empty table gives an empty
result. Columns of docs that are named like a result are replaced by it, all others stay.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")


@dataclass(frozen=True)
class Form:
    """Marks, and of 100 texts how many are transformed and how many of these have the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    seed: int = 1

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", [m.end() for m in UNIT.finditer(text)])


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: str, key: str, form: Form) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, length of prefix and middle, output."""
    at = ends(text)
    n = len(at)
    h1, h2, h3, h4 = draws(form.seed, key)
    if not n or h3 % 100 >= form.transformed or any(m in text for m in form.marks()):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (at[k - 1] if k else 0 for k in (low, high))
    before, middle, after = form.prefix + text[:a], form.middle + text[a:b], form.suffix + text[b:]
    if h4 % 100 < form.suffix_first:
        return n, "spm", a, b - a, after + before + middle
    return n, "psm", a, b - a, before + after + middle


def restore(output: str, kind: str, form: Form = Form()) -> str:
    """The text that the output was made of. The parts hold no mark, so the first of each divides them."""
    if kind == "plain":
        return output
    head, middle = output.split(form.middle, 1)
    first, second = (form.prefix, form.suffix) if kind == "psm" else (form.suffix, form.prefix)
    x, y = head.removeprefix(first).split(second, 1)
    return x + middle + y if kind == "psm" else y + middle + x


def fill_middle(docs: DataFrame, form: Form = Form(), text: str = "text", key: str = "doc_id", texts: bool = True, digests: bool = False) -> DataFrame:
    """docs without the text, with n (units), form, prefix_chars, middle_chars (null if plain), and
    output if texts, output_sha256 and restored_sha256 (of the text rebuilt from the output) if digests."""
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"} | ({"output": "string"} if texts else {}) | ({"output_sha256": "string", "restored_sha256": "string"} if digests else {})

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in kinds.items()))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for ids, values in batches:
            rows = []
            for i, t in zip(ids, values):
                *numbers, out = transform(t, i, form)
                rows.append([*numbers, *([out] if texts else []), *([sha(out), sha(restore(out, numbers[1], form))] if digests else [])])
            frame = pd.DataFrame(rows, columns=list(kinds), dtype=object)
            yield frame.astype({k: "Int64" for k, v in kinds.items() if v == "long"})

    src = small_batches(docs).withColumn("_al_cut", cut(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return src.select(*[F.col(f"`{c}`") for c in docs.columns if c not in kinds and c != text], *[F.col(f"_al_cut.{k}") for k in kinds])


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle(docs, texts=False, digests=True).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u, ('0x' || s[1:8])::BIGINT h1, ('0x' || s[9:16])::BIGINT h2, ('0x' || s[17:24])::BIGINT h3, ('0x' || s[25:32])::BIGINT h4 FROM d),
c AS (SELECT *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') s FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END o FROM p),
r AS (SELECT *, o[4:strpos(o, '<M>') - 1] head, o[strpos(o, '<M>') + 3:] tail FROM o)
SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END middle_chars, sha256(o) output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN head[1:strpos(head, '<S>') - 1] || tail || head[strpos(head, '<S>') + 3:]
    ELSE head[strpos(head, '<P>') + 3:] || tail || head[1:strpos(head, '<P>') - 1] END) restored_sha256 FROM r
"""
