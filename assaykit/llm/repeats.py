"""Repeated passages across documents by difference-cover suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id. Equal texts are one
class, known by their SHA-256; the class's smallest id stands for it, and its other documents repeat it whole.

Sorting every suffix of the corpus isn't needed. Each window of LENGTH bytes has an anchor: of the GRAM-byte strings
inside it the one with the least hash (the first of equals). Equal windows have equal anchors, so:

1. Anchors are listed, about one in 18 bytes. Those that occur in a single class can't be part of a repeat.
2. For each other anchor, the bytes of its windows (a context, 84 bytes at most) go to the anchor's partition, where
   all windows that could be equal to them go as well.
3. There the suffixes of the distinct contexts are sorted by difference cover: triples of six-byte letters at two of
   three places are sorted and named, triples of names are sorted in turn (three of them reach beyond LENGTH), and
   the suffixes of the remaining places are merged by their first letter and the name that follows.
4. Neighbours whose prefixes agree in LENGTH bytes are one group; its windows repeat its smallest document.

Hot passages: an anchor that several classes of one batch have is known to be shared there and then, and is listed once
for the batch; of equal contexts of a batch the bytes are sent once. What a task sorts at a time is a chunk of CHUNK bytes
of contexts, cut between anchors. The contexts of one anchor that is larger than that are halved: a window has 17 bytes
or more before its anchor, or 18 or more after it, so windows of either kind are dealt by those bytes as well. Equal
contexts are sorted once. What stays in one task are the places (17 bytes each) of an anchor's occurrences.

Texts are shuffled once, compressed: the same exchange serves to list contexts and, at the end, to cut. Anchors are
shuffled once with 6 bytes each, contexts once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import map_batches
from assaykit.session import cut

LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
LETTER = 6
#: Bytes of text that are hashed at a time, of contexts that are sorted at a time, and of text behind a partition.
STEP, CHUNK, PART = 1 << 21, 1 << 21, 16 << 20
#: The class of an anchor that several classes of a batch have (classes are hashes; one that is this number is no harm,
#: as its anchors count as shared), and the id that stands for none.
SEVERAL, NO_ID = -(2**63), 2**63 - 1
#: Bytes before the anchor that tell the halves of a large anchor's contexts apart.
BEFORE = 17


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: of each anchor its hash, its text, the first and last window that it is the anchor of,
    and its place in the first."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    power, block, size = np.array([0x9E3779B97F4A7C15], np.uint64), data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:  # hashes of GRAM bytes by doubling
        block = block[:-size] * power + block[size:]
        power, size = power * power, size * 2
    block ^= block >> np.uint64(31)
    block *= np.uint64(0xD6E8FEB86659FD93)
    block ^= block >> np.uint64(32)
    least = (block & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(block), dtype=np.uint64)
    size = 1
    while size * 2 <= GRAMS:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = GRAMS - size
    least = np.minimum(least[: len(least) - rest], least[rest:])  # least of GRAMS places from each window's start
    window = np.arange(len(least))
    text = np.searchsorted(ends, window, side="right")
    inside = window + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    window, at, text = window[inside], (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside], text[inside]
    if not len(window):
        return none.astype(np.uint64), none, none, none, none
    first = np.nonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))[0]
    last = np.append(first[1:], len(window)) - 1
    return block[at[first]] >> np.uint64(16), text[first], window[first], window[last], at[first] - window[first]


def _steps(texts: list[bytes]):
    """Texts in steps of about STEP bytes: (index of the first, bytes, ends)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP or i == len(texts) - 1:
            part = texts[begin : i + 1]
            yield begin, np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(x) for x in part])
            begin, size = i + 1, 0


def _six(h: np.ndarray) -> bytes:
    """Anchors, of 48 bits, in 6 bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    h = np.zeros((len(data) // 6, 8), np.uint8)
    h[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return h.view("<u8").ravel()


def _packed(rows: DataFrame) -> DataFrame:
    """rows with text compressed, for a shuffle."""
    columns = rows.columns
    at = columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        arrays = list(batch.columns)
        arrays[at] = pa.array([pack(t) for t in batch.column(at).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays(arrays, columns)

    return map_batches(rows, run, rows.schema)


def _unpacked(values: pa.Array) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(v) for v in values.to_pylist()]


LISTS = ["part", "classes", "counts", "anchors"]


def _dealt(part: np.ndarray, classes: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """Rows of LISTS: pairs of anchor and class by part, each class once with the number of its anchors."""
    order = np.lexsort((classes, part))
    part, classes, h = part[order], classes[order], h[order]
    for p, a, b in zip(*_runs(part)):
        owners, starts, stops = _runs(classes[a:b])
        yield int(p), owners.astype("<i8").tobytes(), (stops - starts).astype("<u4").tobytes(), _six(h[a:b])


def _distinct(h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, by anchor, and how many classes the anchor of each has."""
    order = np.lexsort((classes, h))
    h, classes = h[order], classes[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (classes[1:] != classes[:-1]))[: len(h)]
    h, classes = h[fresh], classes[fresh]
    _, starts, stops = _runs(h)
    return h, classes, np.repeat(stops - starts, stops - starts)


def _listed(rows: DataFrame, parts: int) -> DataFrame:
    """(part, classes, counts, anchors): the anchors of each class, packed. Parts below `parts` are by the anchor's hash;
    SEVERAL stands for the class of an anchor that several classes of a batch have. Those classes are in the parts from
    `parts` on, by class, as what they share is known."""

    def run(batches):
        for batch in batches:
            owners = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(h, t + begin) for begin, data, ends in _steps(batch.column(1).to_pylist()) for h, t, *_ in [_anchors(data, ends)]]
            if not found:
                continue
            h, classes, several = _distinct(np.concatenate([f[0] for f in found]), owners[np.concatenate([f[1] for f in found])])
            known, alone = several > 1, several == 1
            once = np.unique(h[known])
            sent = np.concatenate([h[alone], once]), np.concatenate([classes[alone], np.full(len(once), SEVERAL)])
            deals = [((sent[0] % np.uint64(parts)).astype(np.int64), sent[1], sent[0]), (classes[known] % parts + parts, classes[known], h[known])]
            listed = [r for d in deals for r in _dealt(*d)]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in listed], kind) for k, kind in enumerate(kinds)], LISTS)

    return rows.mapInArrow(run, "part int, classes binary, counts binary, anchors binary")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and stop of each run of equal neighbours."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.nonzero(np.append(True, values[1:] != values[:-1]))[0]
    return values[starts], starts, np.append(starts[1:], len(values))


def _shared(listed: DataFrame, parts: int) -> DataFrame:
    """(class, anchors): of each class the anchors that another class has as well, packed."""

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        classes = np.concatenate([np.repeat(np.frombuffer(c, "<i8"), np.frombuffer(n, "<u4")) for c, n in zip(table["classes"].to_pylist(), table["counts"].to_pylist())])
        return _from_six(b"".join(table["anchors"].to_pylist())), classes

    def counted(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part >= parts:  # known already
            return table.set_column(0, "part", pa.array(np.full(table.num_rows, part - parts, np.int32)))
        h, classes, several = _distinct(*pairs(table))
        # SEVERAL counts as more than one; it is not a class to be told
        shared = (several > 1) | (classes == SEVERAL)
        shared = np.isin(h, h[shared]) & (classes != SEVERAL)
        h, classes = h[shared], classes[shared]
        rows = list(_dealt(classes % parts, classes, h))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], LISTS)

    def merged(table: pa.Table) -> pa.Table:
        h, classes = pairs(table)
        order = np.argsort(classes, kind="stable")
        h, classes = h[order], classes[order]
        owners, starts, stops = _runs(classes)
        return pa.table({"class": pa.array(owners, pa.int64()), "anchors": pa.array([_six(h[a:b]) for a, b in zip(starts, stops)], pa.binary())})

    schema = "part int, classes binary, counts binary, anchors binary"
    dealt = listed.repartition(parts, "part").groupBy("part").applyInArrow(counted, schema)
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(merged, "class bigint, anchors binary")


#: n occurrences of m contexts: their anchors, places of the anchors, lengths and bytes; of the occurrences the number of
#: the context, id, copy and place.
CONTEXTS = "part int, n int, m int, anchors binary, offsets binary, lengths binary, data binary, numbers binary, ids binary, copies binary, ats binary"
CONTEXT_NAMES = [c.split()[0] for c in CONTEXTS.split(", ")]
KINDS = {"offsets": "u1", "lengths": "u1", "numbers": "<u4", "ids": "<i8", "copies": "<u4", "ats": "<u4"}


def _contexts(rows: DataFrame, parts: int) -> DataFrame:
    """rows: copy, id, text (compressed), anchors. The context of each listed anchor with its id, copy and place, dealt
    by the anchor, packed; equal ones of a batch have their bytes in one place."""

    def run(batches):
        for batch in batches:
            copies, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts, lists = _unpacked(batch.column(2)), [x if x is None else _from_six(x) for x in batch.column(3).to_pylist()]
            number: dict[tuple[int, bytes], int] = {}
            found = []
            for begin, data, ends in _steps(texts):
                hh, t, first, last, offset = _anchors(data, ends)
                starts, whole = np.append(0, ends[:-1]), data.tobytes()
                for d, a, b in zip(*_runs(t)):
                    wanted = lists[begin + d]
                    k = np.arange(a, b) if wanted is None else np.nonzero(np.isin(hh[a:b], wanted))[0] + a
                    pieces = (whole[x:y] for x, y in zip(first[k].tolist(), (last[k] + LENGTH).tolist()))
                    own = [number.setdefault(key, len(number)) for key in zip(hh[k].tolist(), pieces, offset[k].tolist())]
                    found.append((np.array(own, np.int64), np.full(len(k), begin + d), first[k] - starts[d]))
            if not number:
                continue
            own, doc, at = map(np.concatenate, zip(*found))
            h = np.fromiter((key[0] for key in number), np.uint64, len(number))
            offset = np.fromiter((key[2] for key in number), np.int64, len(number))
            pieces = [key[1] for key in number]
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            number.clear()
            h, offset, part, pieces = h[order], offset[order], part[order], [pieces[k] for k in order.tolist()]
            own = place[own]
            order = np.argsort(own, kind="stable")
            own, doc, at = own[order], doc[order], at[order]
            for p, a, b in zip(*_runs(part)):
                x, y = np.searchsorted(own, [a, b])
                values = {
                    "offsets": offset[a:b], "lengths": np.array([len(c) for c in pieces[a:b]]), "numbers": own[x:y] - a,
                    "ids": ids[doc[x:y]], "copies": copies[doc[x:y]], "ats": at[x:y],
                }
                packed = {n: pa.compress(v.astype(KINDS[n]).tobytes(), "zstd", asbytes=True) for n, v in values.items()}
                packed |= {"part": int(p), "n": int(y - x), "m": int(b - a), "anchors": _six(h[a:b]), "data": pa.compress(b"".join(pieces[a:b]), "zstd", asbytes=True)}
                yield pa.RecordBatch.from_arrays([pa.array([packed[n]], pa.int32() if n in ("part", "n", "m") else pa.binary()) for n in CONTEXT_NAMES], CONTEXT_NAMES)

    return rows.mapInArrow(run, CONTEXTS)


def _key(*letters: np.ndarray) -> np.ndarray:
    """One number for each tuple of letters, in the order of the tuples: packed where that fits 64 bits, else ranked."""
    bits = [int(x.max(initial=0)).bit_length() for x in letters]
    if sum(bits) <= 64:
        out = np.zeros(len(letters[0]), np.uint64)
        for x, n in zip(letters, bits):
            out = (out << np.uint64(n)) | x.astype(np.uint64)
        return out
    order = np.lexsort(letters[::-1])
    fresh = np.zeros(len(order), bool)
    for x in letters:
        y = x[order]
        fresh[1:] |= y[1:] != y[:-1]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(fresh)
    return out


def _names(*letters: np.ndarray) -> np.ndarray:
    """Dense names, from 1, of the tuples of letters by their sorted order."""
    key = _key(*letters)
    order = np.argsort(key)
    y = key[order]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.append(True, y[1:] != y[:-1])[: len(y)])
    return names


def suffix_order(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the suffixes that start at `starts` (sorted), the order by their first LENGTH bytes or more.

    letters[i] holds the LETTER bytes from i on. A suffix is a string of letters at i, i + 6, ...; its place i is of
    class (i div 6) mod 3. Classes 1 and 2 are the difference cover: one of i + 6, i + 12 is in it for any i.
    """
    n, stride = len(letters), LETTER
    first = np.zeros(n + 12 * stride, np.int64)
    first[:n] = _names(letters)
    place = np.arange(n)
    sampled = place[(place // stride) % 3 != 0]
    name = np.zeros(n + 12 * stride, np.int64)
    name[sampled] = _names(first[sampled], first[sampled + stride], first[sampled + 2 * stride])
    # names of 18 bytes each; three of them, 18 apart (the same class), reach 54 bytes
    name[sampled] = _names(name[sampled], name[sampled + 3 * stride], name[sampled + 6 * stride])
    kind = (starts // stride) % 3
    rest, one, two = starts[kind == 0], starts[kind == 1], starts[kind == 2]
    cover = np.concatenate([one, two])
    cover = cover[np.argsort(name[cover], kind="stable")]
    rest = rest[np.argsort(_key(first[rest], name[rest + stride], name[rest + 2 * stride]), kind="stable")]
    # how many of each class of the cover come before each of the rest: compared by letters up to the next named place
    before = _before(rest, one, (first, 0), (name, stride)) + _before(rest, two, (first, 0), (first, stride), (name, 2 * stride))
    order = np.empty(len(starts), np.int64)
    slots = before + np.arange(len(rest))
    free = np.ones(len(starts), bool)
    free[slots] = False
    order[slots], order[free] = rest, cover
    return order


def _before(rest: np.ndarray, others: np.ndarray, *keys: tuple[np.ndarray, int]) -> np.ndarray:
    """For each of rest (in its order) how many of others are smaller by the keys (array, shift)."""
    both = np.concatenate([others, rest])
    key = _key(*(a[both + shift] for a, shift in keys))
    return np.searchsorted(np.sort(key[: len(others)]), key[len(others) :])


def _repeated(contexts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of distinct contexts, end to end: the smallest id that has each, and where each context begins."""
    lengths = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts) + bytes(LENGTH + 2 * LETTER), np.uint8).astype(np.uint64)
    n = int(lengths.sum())
    letters = np.zeros(n + LENGTH, np.uint64)
    for k in range(LETTER):
        letters = (letters << np.uint64(8)) | data[k : k + n + LENGTH]
    windows = lengths - LENGTH + 1
    firsts = np.cumsum(lengths) - lengths
    edge = np.cumsum(windows) - windows
    starts = np.repeat(firsts - edge, windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(contexts)), windows)
    order = suffix_order(letters, starts)
    slot = np.empty(n, np.int64)
    slot[starts] = np.arange(len(starts))
    slot = slot[order]
    same = np.ones(len(order) - 1, bool)
    for shift in [*range(0, LENGTH - LETTER, LETTER), LENGTH - LETTER]:
        x = letters[order + shift]
        same &= x[1:] == x[:-1]
    groups = np.nonzero(np.append(True, ~same))[0]
    least = np.minimum.reduceat(ids[owner[slot]], groups)
    smallest = np.empty(len(order), np.int64)
    smallest[slot] = np.repeat(least, np.diff(np.append(groups, len(order))))
    return smallest, np.append(edge, len(order))


def _solved(copies: np.ndarray, ids: np.ndarray, ats: np.ndarray, contexts: list[bytes]) -> pa.Table:
    """The runs of one chunk of contexts."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(c, len(number)) for c in contexts), np.int64, len(contexts))
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, own, ids)
    smallest, edges = _repeated(list(number), least)
    low, high = np.minimum.reduceat(smallest, edges[:-1]), np.maximum.reduceat(smallest, edges[:-1])
    whole = high[own] < ids
    start, stop = ats.astype(np.int64), ats + np.array([len(c) for c in contexts])
    out = [(copies[whole], ids[whole], start[whole], stop[whole])]
    for k in np.nonzero(~whole & (low[own] < ids))[0].tolist():
        gone, x, y = _runs(smallest[edges[own[k]] : edges[own[k] + 1]] < ids[k])
        x, y = x[gone] + start[k], y[gone] + start[k] - 1 + LENGTH
        out.append((np.full(len(x), copies[k]), np.full(len(x), ids[k]), x, y))
    found = [np.concatenate(c) for c in zip(*out)]
    return pa.table([pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))], ["copy", "id", "start", "stop"])


def _halves(contexts: list[bytes], offsets: list[int]) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, number, shift, part) of each context: its windows with BEFORE bytes or more before the anchor, and the
    others. Equal windows are in parts of one key."""
    for k, (c, a) in enumerate(zip(contexts, offsets)):
        if a >= BEFORE:
            yield b"<" + c[a - BEFORE : a], k, 0, c[: a - BEFORE + LENGTH]
        start = max(0, a - BEFORE + 1)
        if len(c) - start >= LENGTH:
            yield b">" + c[a + GRAM : a + LENGTH - BEFORE + 1], k, start, c[start:]


def _large(copies: np.ndarray, ids: np.ndarray, ats: np.ndarray, contexts: list[bytes], offsets: list[int]) -> Iterator[pa.Table]:
    """The runs of the contexts of one anchor, by halves and in chunks."""
    parts = sorted(_halves(contexts, offsets), key=lambda x: x[0])
    begin = size = 0
    for k, (key, _, _, piece) in enumerate(parts, 1):
        size += len(piece)
        if k == len(parts) or size >= CHUNK and parts[k][0] != key:
            some = parts[begin:k]
            own = np.array([x[1] for x in some])
            yield _solved(copies[own], ids[own], ats[own] + np.array([x[2] for x in some]), [x[3] for x in some])
            begin, size = k, 0


def _removed(contexts: DataFrame, parts: int) -> DataFrame:
    """(copy, id, start, stop) of runs of windows that a smaller document has as well."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(CONTEXT_NAMES).to_pylist()
        read = lambda r, n: np.frombuffer(pa.decompress(r[n], r["n" if n in ("numbers", "ids", "copies", "ats") else "m"] * np.dtype(KINDS[n]).itemsize, "zstd", asbytes=True), KINDS[n]).astype(np.int64)
        # all bytes end to end, and of each occurrence where its context is in them
        data, where, size, anchors, offsets, ids, copies, ats = [], [], [], [], [], [], [], []
        done = 0
        for r in rows:
            lengths, number = read(r, "lengths"), read(r, "numbers")
            ends = np.cumsum(lengths)
            where.append((ends - lengths + done)[number])
            size.append(lengths[number])
            anchors.append(_from_six(r["anchors"])[number])
            offsets.append(read(r, "offsets")[number])
            for name, column in (("ids", ids), ("copies", copies), ("ats", ats)):
                column.append(read(r, name))
            data.append(pa.decompress(r["data"], int(ends[-1]), "zstd", asbytes=True))
            done += int(ends[-1])
            r.clear()
        whole = b"".join(data)
        data.clear()
        where, size, anchors, offsets, ids, copies, ats = map(np.concatenate, (where, size, anchors, offsets, ids, copies, ats))
        order = np.lexsort((where, anchors))
        groups, starts, stops = _runs(anchors[order])
        total = np.cumsum(size[order])
        pieces = lambda k: [whole[a:b] for a, b in zip(where[k].tolist(), (where[k] + size[k]).tolist())]
        out, begin, before = [], 0, 0
        for start, stop in zip(starts.tolist(), stops.tolist()):
            own = int(total[stop - 1]) - (int(total[start - 1]) if start else 0)
            if own >= CHUNK:  # one anchor is a chunk of its own or more
                if begin < start:
                    k = order[begin:start]
                    out.append(_solved(copies[k], ids[k], ats[k], pieces(k)))
                k = order[start:stop]
                out += _large(copies[k], ids[k], ats[k], pieces(k), offsets[k].tolist())
            elif int(total[stop - 1]) - before >= CHUNK or stop == len(order):
                k = order[begin:stop]
                out.append(_solved(copies[k], ids[k], ats[k], pieces(k)))
            else:
                continue
            begin, before = stop, int(total[stop - 1])
        return pa.concat_tables(out)

    return contexts.repartition(parts, "part").groupBy("part").applyInArrow(run, "copy int, id bigint, start int, stop int")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(id, none, sha, class, text): a null id is NO_ID with none set; a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("doc_id").isNull().alias("none"), whole.alias("text"))
    return rows.select("id", "none", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("class"), "text")


def _found(rows: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """(id, none, sha, n_bytes, spans) of each distinct (id, none, sha) of _texts(), whose texts come packed."""
    keys = cut(rows.groupBy("id", "none", "sha", "class").agg(F.max(F.octet_length("text")).cast("long").alias("n_bytes")))
    owners = keys.groupBy("sha", "class").agg(F.min(F.struct("id", "none")).alias("o")).select("sha", "class", F.col("o.id").alias("owner"), F.col("o.none").alias("owner_none"))
    # an id may own several texts: they are told apart by a small number. Two texts may have one class: they list all anchors
    owners = owners.withColumn("copy", F.row_number().over(Window.partitionBy("owner").orderBy("owner_none", "sha")) - 1)
    owners = owners.withColumn("clash", F.count("*").over(Window.partitionBy("class")) > 1)
    shared = _shared(_listed(rows.select("class", "text"), parts), parts)
    wanted = owners.join(shared, "class", "left").where("clash OR anchors IS NOT NULL")
    wanted = wanted.select(F.col("sha").alias("k_sha"), F.col("owner").alias("k_id"), F.col("owner_none").alias("k_none"), "copy", F.when(~F.col("clash"), F.col("anchors")).alias("anchors"))
    # a text of one class may be in the table more than once under its smallest id: one of them is enough
    sources = packed.hint("merge").join(wanted, _same("k_")).select("copy", "id", "text", "anchors")
    runs = _removed(_contexts(sources, parts), parts).groupBy("copy", "id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    known = keys.drop("class").join(owners.drop("class", "clash"), "sha")
    runs = runs.select(F.col("copy").alias("r_copy"), F.col("id").alias("r_id"), "runs")
    found = known.join(runs, (F.col("copy") == F.col("r_copy")) & (F.col("owner") == F.col("r_id")), "left")
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    later = (F.col("id") > F.col("owner")) | (F.col("id") == F.col("owner")) & F.col("none") & ~F.col("owner_none")
    spans = F.when(later & (F.col("n_bytes") >= LENGTH), all_of_it).when(later, nothing).otherwise(F.coalesce("runs", nothing))
    return found.select("id", "none", "sha", "n_bytes", spans.alias("spans"))


def _same(prefix: str) -> Column:
    return (F.col("id") == F.col(f"{prefix}id")) & (F.col("none") == F.col(f"{prefix}none")) & (F.col("sha") == F.col(f"{prefix}sha"))


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of docs: the maximal removed runs (start, stop) in bytes, and the
    bytes that are left.

    A null text is empty. A null id counts as greater than all others. Equal rows have equal results, and rows with
    one id and different texts are no sources for each other. Long texts are read whole. An empty table gives no rows.
    """
    rows = _texts(docs, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART))
    # both joins with the texts take this exchange
    packed = _packed(rows.select("id", "none", "sha", "text")).repartition(parts, "id", "none", "sha")
    found = _found(rows, packed, parts).select(*[F.col(c).alias(f"f_{c}") for c in ("id", "none", "sha")], "spans")
    # each row has a partner; an outer join would not share the exchange, as it keeps null keys
    both = packed.hint("merge").join(found, _same("f_")).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, spans, sizes = [], [], []
        for value, listed in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
            joined = _joined(listed or [])
            at, out = 0, []
            for a, b in joined:
                out.append(value[at:a])
                at = b
            kept.append(b"".join([*out, value[at:]]))
            spans.append([{"start": a, "stop": b} for a, b in joined])
            sizes.append(len(value))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return map_batches(both, run, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary")
