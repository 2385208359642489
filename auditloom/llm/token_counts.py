"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pretokens by the tokenizer's own pattern. Within one, symbols form
a doubly linked list, and a heap holds the adjacent pairs that have a merge; the pair of
lowest rank (leftmost first) is popped and merged until none is left. The count is
the initial symbols less the merges; no identifiers are made. Counts of short pieces
are remembered in each worker, within a fixed number of entries.

Edge cases: null and empty texts have no tokens; a special token's own string inside a
text is one token, as the library's default has it; texts of any length are counted
whole (the heap keeps a long piece at n log n); repeated rows are counted alike.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the pretoken pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker remembers; beyond it starts afresh.
REMEMBERED, LONGEST = 1_500_000, 48


def _byte_letters() -> dict[str, int]:
    """The letter that such vocabularies write for each byte, and back: printable bytes
    stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Merges:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_letters()
        raw = lambda s: bytes(back[c] for c in s)
        ids = {bytes([b]): b for b in range(256)}
        #: pair (left * 2^32 + right) -> rank; made[rank] is the symbol that the merge makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = raw(a), raw(b)
            self.made.append(ids.setdefault(left + right, len(ids)))
            self.rank.setdefault(ids[left] << 32 | ids[right], k)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.strings = special
        self.pattern = regex.compile(PATTERN)

    def pretoken(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        rank, made, symbols, left = self.rank.get, self.made, list(data), n
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            # A pair that has changed since it was pushed no longer has this rank.
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 32 | symbols[j]) != top >> 32:
                continue
            new = made[top >> 32]
            symbols[i], symbols[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 32 | symbols[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] << 32 | new)) is not None:
                push(heap, r << 32 | h)
        return left


class Counts(dict):
    """piece -> tokens, filled on demand."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        m = self.merges
        parts = m.pattern.findall(piece)
        n = m.pretoken(piece.encode()) if len(parts) == 1 else sum(self[x] for x in parts)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. Where no blank precedes a space, every
        space starts a pretoken, so that cutting there changes nothing."""
        if not text:
            return 0
        if _SPACED.search(text):
            return sum(map(self.__getitem__, self.merges.pattern.findall(text)))
        first, *rest = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + x for x in rest]))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        m = self.merges
        if m.special and any(s in text for s in m.strings):
            parts = m.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


_SPACED = re.compile(r"\s ")
_counts: dict[str, Counts] = {}


def counts_for(path: str) -> Counts:
    if path not in _counts:
        _counts[path] = Counts(Merges(path))
    return _counts[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens. path: a byte-level BPE vocabulary, in reach of every worker."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(path)
        for batch in batches:
            n = [counts.text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = docs.select(*keep).withColumn("n_tokens", F.lit(0).cast("long")).schema
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
