"""Fill-in-middle: a text is cut into prefix, middle and suffix at line ends and written in another order.

Where the line ends are is found by content-defined chunks. A rolling hash over the last WINDOW bytes ends a chunk
wherever its low bits are zero (LEAST to MOST bytes long), so that texts which share a passage share its chunks. A chunk's
summary is kept in a cache: how many lines it ends, whether it holds a mark, and its first and last bytes, which is
all that its neighbours need to see a mark across their border. The cache knows a chunk by its hash and verifies it by
its bytes, so a chance collision can't change a result. Line counts of a text's chunks are added up; the chunk in which a
cut falls is the only one whose line ends are looked at one by one.

Units are `[^\\n]*\\n|[^\\n]+`, left to right: n = line ends, and one more for a rest without one. Of the sha256 of
`<seed>:<doc_id>` the first four groups of 8 digits are h1 to h4: the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger; h3 decides whether the text is changed at all, h4 the form.

All work is within the row, with no shuffle. Memory is bounded by one Arrow batch, PIECE bytes of hashes and CACHE bytes
of chunks. Nulls: a null text is empty, an empty one stays plain; a null doc_id is hashed as the empty string. A text
with one of the marks in it stays plain, as it couldn't be told apart afterwards. Very long texts are cut whole. Repeated
rows each give their row, the same where their id is the same. An empty table gives an empty one. Columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts so many are changed, and of those so many put the suffix first.
RATE, SPM_RATE = 100, 50
#: Bytes that the rolling hash sees; a chunk's least and greatest length; a chunk ends about every 2**BITS bytes.
WINDOW, LEAST, MOST, BITS = 32, 64, 8192, 9
#: Bytes whose hashes are held at a time, and bytes of chunks in each of the cache's two generations.
PIECE, CACHE = 1 << 20, 32 << 20
OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_MARKS = re.compile(b"<[PSM]>")
_GEAR = np.random.default_rng(1).integers(1 << 63, size=256, dtype=np.uint64)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash ends a chunk: the hash of a byte's window is the sum of gear[b] << age, made
    by doubling the window, a piece of PIECE bytes at a time."""
    found = []
    for at in range(0, len(data), PIECE):
        start = max(0, at - WINDOW + 1)
        h, width = _GEAR[data[start : at + PIECE]], 1
        while width < WINDOW:
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint64(width)
            h, width = wider, width * 2
        # bits from WINDOW on have seen every byte of the window
        ends = np.flatnonzero(h >> np.uint64(WINDOW) & np.uint64((1 << BITS) - 1) == 0) + start + 1
        found.append(ends[ends > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Chunks:
    """Summaries of chunks: (line ends, a mark inside, first bytes, last bytes). Two generations bound the memory."""

    def __init__(self, most: int = CACHE):
        self.most, self.size, self.new, self.old = most, 0, {}, {}
        self.hits = 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        found = self.new.get(chunk)  # by hash, then by its bytes
        if found is None:
            found = self.old.get(chunk)
            self.hits += found is not None
            found = found or (chunk.count(b"\n"), _MARKS.search(chunk) is not None, chunk[:2], chunk[-2:])
            if self.size > self.most:
                self.old, self.new, self.size = self.new, {}, 0
            self.new[chunk] = found
            self.size += len(chunk) + 200
        else:
            self.hits += 1
        return found


def _borders(start: int, stop: int, ends: np.ndarray) -> list[int]:
    """Where the chunks of one text begin and end: hash ends that lie LEAST to MOST bytes apart. As LEAST is more than
    WINDOW, what stands before the text in the buffer has no say in it."""
    cuts = [start]
    for e in ends.tolist():
        if e - cuts[-1] < LEAST:
            continue
        while e - cuts[-1] > MOST:
            cuts.append(cuts[-1] + MOST)
        if e < stop and e - cuts[-1] >= LEAST:
            cuts.append(e)
    while stop - cuts[-1] > MOST:
        cuts.append(cuts[-1] + MOST)
    return [*cuts, stop]


def _after(data: bytes, cuts: list[int], sums: list[int], k: int) -> int:
    """Where the k-th line of the text ends: its chunk by the sums of line ends, its place within the chunk."""
    if k == 0:
        return cuts[0]
    if k > sums[-1]:
        return cuts[-1]
    c = bisect_left(sums, k)
    at = cuts[c] - 1
    for _ in range(k - (sums[c - 1] if c else 0)):
        at = data.index(b"\n", at + 1)
    return at + 1


def _chars(piece: bytes) -> int:
    return len(piece.decode("utf-8", "surrogatepass"))


def split(data: bytes, start: int, stop: int, ends: np.ndarray, chunks: Chunks, h: tuple[int, int]) -> tuple[int, bool, int, int]:
    """(units, whether a mark is in it, end of the prefix, end of the middle) of the text data[start:stop]."""
    cuts, sums, marked, tail = _borders(start, stop, ends), [], False, b""
    for a, b in zip(cuts[:-1], cuts[1:]):
        lines, inside, first, last = chunks.summary(data[a:b])
        marked = marked or inside or _MARKS.search(tail + first) is not None
        tail = last  # only a text's last chunk can be shorter than that
        sums.append((sums[-1] if sums else 0) + lines)
    n = sums[-1] + (stop > start and data[stop - 1] != 10)
    one, two = sorted(x % (n + 1) for x in h)
    return n, marked, _after(data, cuts, sums, one), _after(data, cuts, sums, two)


def transform(docs: DataFrame, text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; see the module for odd rows."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunks = state.setdefault("chunks", Chunks())
        ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
        offsets = offsets - offsets[0]
        ends = chunk_ends(np.frombuffer(data, np.uint8))
        of = np.searchsorted(ends, offsets, "right")
        rows = []
        for i, doc_id in enumerate(ids):
            a, b = int(offsets[i]), int(offsets[i + 1])
            digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(digest[j : j + 8], 16) for j in range(0, 32, 8))
            n, marked, one, two = split(data, a, b, ends[of[i] : of[i + 1]], chunks, (h1, h2))
            if a == b or marked or h3 % 100 >= rate:
                rows.append((n, "plain", None, None, data[a:b]))
                continue
            before, middle, after = data[a:one], data[one:two], data[two:b]
            spm = h4 % 100 < spm_rate
            out = b"".join([s, after, p, before, m, middle] if spm else [p, before, s, after, m, middle])
            rows.append((n, "spm" if spm else "psm", _chars(before), _chars(middle), out))
        n, form, prefix, middle, out = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")), run, OUT)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made from, by its form."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda *order: F.concat(*(F.get(parts, i) for i in order))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
