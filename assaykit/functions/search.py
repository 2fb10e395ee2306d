"""Approximate search: where a wanted text stands in a corpus with at most a given rate of character errors.

Exact by the pigeonhole rule. For k allowed edits a wanted text is cut into k + 1 pieces of nearly one length, the leaves of a
binary tree; a node over L leaves stands for their text with L - 1 edits. If a node is found, one of its two children is, as
both can't have more edits than they are allowed; so some leaf stands in the text unchanged and so does, with its edits, each
node on the way from it to the root. Leaves are looked up by a rolling hash of their first characters, and from each
hit the way is climbed: a node's text is compared, by bit vectors, with the few characters around the hit in
which it could lie, and most hits end at the first step.

The corpus is scanned where it lies: what is sent to the tasks are the wanted texts, in blocks of at most BLOCK
characters (one scan and one written result each), so nothing grows with the corpus and no piece, however common, gathers rows in
one place. A wanted text that a text hits so often that climbing would cost more is compared with the whole of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import substring_distance
from assaykit.session import cut

#: Characters of wanted texts that a scan looks for at a time; one longer text makes a block of its own.
BLOCK = 2_000_000
#: Characters of a leaf that are hashed at most, bits of the table that a hash must pass first.
GRAM, BITS = 16, 20
#: A hit costs about as much as this many characters of a whole comparison.
HIT = 40
_BASE = 0x9E3779B97F4A7C15
FOUND = "doc_id bigint, key string, distance int, stop int"


def _hashes(chars: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hash of the n characters from each place on, for each n: polynomials made by doubling."""
    powers, known = {}, {}
    h, width = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while width <= max(sizes, default=0):
        powers[width], known[width] = np.uint64(pow(_BASE, width, 1 << 64)), h
        if len(h) <= width:
            break
        h, width = h[:-width] * powers[width] + h[width:], width * 2
    out = {}
    for n in sizes:
        if n > len(chars):
            continue
        total, at = None, 0
        for w in sorted((w for w in known if n & w), reverse=True):
            part = known[w][at : at + len(chars) - n + 1]
            total = part if total is None else total * powers[w] + part
            at += w
        out[n] = total ^ (total >> np.uint64(29))
    return out


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _way(size: int, leaves: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(start, stop, nodes above as (start, stop, edits), the root last) of each leaf."""
    ends = [size * i // leaves for i in range(leaves + 1)]
    out = []

    def down(a: int, b: int, above: list) -> None:
        if b - a == 1:
            out.append((ends[a], ends[b], above[::-1]))
            return
        here = [*above, (ends[a], ends[b], b - a - 1)]
        half = (a + b + 1) // 2
        down(a, half, here)
        down(half, b, here)

    down(0, leaves, [])
    return out


class Index:
    """Wanted texts by the hashes of their leaves' first characters."""

    def __init__(self, wanted: list[str], rate: float):
        self.wanted = wanted
        self.edits = [int(rate * len(w) + 1e-9) for w in wanted]
        self.leaves, by_size = [], {}
        for i, w in enumerate(wanted):
            if self.edits[i] >= len(w):
                raise ValueError("a rate of 1 or more finds everything everywhere")
            ways = _way(len(w), self.edits[i] + 1)
            sizes = {min(b - a, GRAM) for a, b, _ in ways}
            hashed = _hashes(_chars(w), sorted(sizes))
            for a, b, above in ways:
                n = min(b - a, GRAM)
                by_size.setdefault(n, []).append((int(hashed[n][a]), len(self.leaves)))
                self.leaves.append((i, a, b, above))
        self.tables = {}
        for n, pairs in sorted(by_size.items()):
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], np.uint64)
            table = np.zeros(1 << BITS, bool)
            table[hashes >> np.uint64(64 - BITS)] = True
            self.tables[n] = table, hashes, np.array([x for _, x in pairs])

    def hits(self, chars: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, leaf) wherever a leaf's first characters may stand."""
        for n, h in _hashes(chars, list(self.tables)).items():
            table, hashes, leaves = self.tables[n]
            at = np.flatnonzero(table[h >> np.uint64(64 - BITS)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for place, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for leaf in leaves[a:b].tolist():
                    yield place, leaf

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """(distance, earliest end of the nearest part) of each wanted text that the text holds within its edits."""
        by_text: dict[int, list[tuple[int, int]]] = {}
        for place, leaf in self.hits(_chars(text)):
            by_text.setdefault(self.leaves[leaf][0], []).append((place, leaf))
        found = {}
        for i, hits in by_text.items():
            best = self._whole(text, i) if len(hits) * HIT > len(text) + 1000 else self._climb(text, i, hits)
            if best is not None and best[0] <= self.edits[i]:
                found[i] = best
        return found

    def _whole(self, text: str, i: int) -> tuple[int, int]:
        return substring_distance(text, self.wanted[i])

    def _climb(self, text: str, i: int, hits: list[tuple[int, int]]) -> tuple[int, int] | None:
        wanted, best = self.wanted[i], None
        known: dict[tuple[int, int, int], tuple[int, int]] = {}
        for place, leaf in hits:
            _, a, b, above = self.leaves[leaf]
            if text[place : place + b - a] != wanted[a:b]:
                continue
            shift, last = place - a, (0, place + b - a)
            for start, stop, edits in above:
                if (start, stop, shift) not in known:
                    low = max(0, shift + start - edits)
                    distance, end = substring_distance(text[low : shift + stop + edits], wanted[start:stop])
                    known[start, stop, shift] = distance, low + end
                last = known[start, stop, shift]
                if last[0] > edits:
                    break
            else:
                best = last if best is None else min(best, last)
        return best


_INDEXES: dict[str, Index] = {}


def _index(name: str, wanted: list[str], rate: float) -> Index:
    """The index of a block, built once in a worker; that of another block goes."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(wanted, rate)
    return _INDEXES[name]


def clean(col: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def _scan(texts: DataFrame, wanted: list[tuple[str, str]], rate: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(wanted)  # at most BLOCK characters, or one text
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, [w for _, w in sent.value], rate)
        for batch in batches:
            rows = [(d, sent.value[i][0], *best) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, best in index.find(t).items()]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "key", "distance", "stop"])

    return texts.mapInArrow(run, FOUND)


def approx_find(texts: DataFrame, wanted: DataFrame, rate: float = 0.1, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, distance, stop, cer) of each wanted text (item_id, required) in each text (doc_id, text) that holds
    it with at most rate * length edits: the least edit distance to any part of the text, the earliest end of such a
    part, and distance / length; in lower case with single spaces. Every such pair is found, whatever the lengths.

    Null and empty texts are in no pair; repeated rows of either side each give theirs. Other columns don't matter.
    """
    items = wanted.select("item_id", clean(F.col("required")).alias("required")).where("required <> ''").withColumn("key", F.sha2("required", 256))
    forms = items.select("key", "required").distinct()
    total = forms.agg(F.sum(F.length("required"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    # a comparison costs far more than its bytes: what few files hold is spread over as many tasks as a shuffle has
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), clean(F.col("text")).alias("text")).where("text <> ''")
    rows = rows.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text")
    parts = []
    for b in range(blocks):
        here = [(r["key"], r["required"]) for r in forms.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()]
        found = _scan(rows, here, rate)
        parts.append(cut(found) if blocks > 1 else found)
    found = reduce(DataFrame.unionByName, parts)
    size = F.length("required")
    return found.join(items, "key").select("item_id", "doc_id", "distance", "stop", F.round(F.col("distance") / size, 6).alias("cer"))
