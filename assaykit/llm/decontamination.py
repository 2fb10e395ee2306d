"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed of SEED tokens are compared: the longest common run of tokens that
aren't marked yet is marked as a tile, again and again, until none of TILE tokens is left. The order of the tiles doesn't
matter, so a passage whose sentences were moved about is found as well. A document holds an item if its tiles cover
COVERAGE of the item's tokens.

Tokens are runs of letters and digits, lower-cased; in scripts that are written without spaces, each letter is one. Items
of fewer than SEED tokens are found as a whole; of fewer than TILE (one or two tokens) they are left out, as any text
might hold them.

Seeds are joined in Spark. A Bloom filter of fixed size (BLOOM_BITS) holds the seeds of the benchmark, whatever its size;
what passes it of a document's seeds meets those of the items, documents that nothing passes go no further. A seed may be
common to a third of the documents, so that both joins are salted by document. Pairs get the tokens of the item and those
of the document that are within an item's length of a seed, and are tiled one by one.

Tiling is running Karp-Rabin with the search length found by halving: by hashes of free windows, the greatest length of
which the two have one in common is found; at that length the windows of the item are taken from left to right, each with
the first free window of the text that is the same. No longer common run exists and afterwards none of this length does,
so this is what marking the longest match one by one gives. A round takes time in proportion to the two lengths, and
there are as many rounds as tiles have lengths: about the root of the item's length at most. Periodic texts are no
exception, as pairs of places are never listed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import map_batches
from assaykit.session import cut

SEED, TILE, COVERAGE = 5, 3, 0.8
#: Bits of the filter of seeds (8 MB), and the places that a seed sets.
BLOOM_BITS, PROBES = 1 << 26, 3
#: Parts that the documents of one seed or one item are dealt to.
SALT = 16
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 20
#: Letters of scripts that are written without spaces (Thai to Tibetan, Myanmar, Khmer, kana, Han).
UNSPACED = "฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
PLAIN_TOKEN = re.compile(r"[^\W_]+")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
TOKEN = re.compile(rf"(?![\W_])[{UNSPACED}]|[^\W_{UNSPACED}]+")
PRIME = np.array([0x9E3779B97F4A7C15], np.uint64)


def tokens(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (TOKEN if ANY_UNSPACED.search(low) else PLAIN_TOKEN).findall(low)


class Words(dict):
    """Hash of a word, the same in each process; never 0."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5) | 1
        return found

    def ids(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window: a polynomial in PRIME, modulo 2**64. Windows are cut by squaring, not one by one."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    n = len(ids) - length + 1
    out, done = np.zeros(n, np.uint64), 0
    power, block, size = PRIME, ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1
    while True:
        if length & size:
            out = out * power + block[done : done + n]
            done += size
        if size * 2 > length:
            return out
        block = block[:-size] * power + block[size:]
        power, size = power * power, size * 2


def _free(ids: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that hold nothing marked."""
    hashes = rolling(ids, length)
    before = np.append(0, np.cumsum(marked))
    place = np.nonzero(before[length:] == before[:-length])[0][: len(hashes)]
    return place, hashes[place]


def tile(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length) of each tile. Zeros of text never match."""
    p_marked, t_marked = np.zeros(len(item), bool), text == 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while most >= least:
        low, high = least - 1, most  # a common free window of `low` tokens exists (or low is too short), of high + 1 none
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(_free(item, p_marked, middle)[1], _free(text, t_marked, middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        i_at, i_hash = _free(item, p_marked, low)
        j_at, j_hash = _free(text, t_marked, low)
        common = np.isin(i_hash, j_hash)
        order = np.argsort(j_hash, kind="stable")
        j_hash, j_at = j_hash[order], j_at[order]
        first, last = np.searchsorted(j_hash, i_hash[common]), np.searchsorted(j_hash, i_hash[common], side="right")
        at: dict[int, int] = {}  # by the first place of a hash, where to go on
        end = -1
        for i, a, b in zip(i_at[common].tolist(), first.tolist(), last.tolist()):
            if i < end:
                continue
            k = at.get(a, a)
            while k < b and (t_marked[j_at[k]] or t_marked[j_at[k] + low - 1]):
                k += 1
            at[a] = k
            if k < b:
                j = int(j_at[k])
                if np.array_equal(item[i : i + low], text[j : j + low]):
                    p_marked[i : i + low] = t_marked[j : j + low] = True
                    tiles.append((i, j, low))
                    end = i + low
        most = low - 1
    return tiles


def seeds(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of an item or text that are seeds for items of `length` tokens, at most SEED."""
    n = min(length, SEED)
    x = rolling(ids, n) + np.uint64(n)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bit(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th place of the filter that each seed sets."""
    return ((hashes >> np.uint64(20 * k)) ^ (hashes >> np.uint64(37))) & np.uint64(BLOOM_BITS - 1)


def _passes(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter."""
    left = np.arange(len(hashes))
    for k in range(PROBES):
        bit = _bit(hashes[left], k)
        left = left[bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return left


def _near(ids: np.ndarray, hits: np.ndarray, reach: int) -> np.ndarray:
    """The tokens within reach of a hit; what is left out leaves one zero."""
    starts, stops = np.maximum(hits - reach, 0), np.minimum(hits + SEED + reach, len(ids))
    new = np.append(True, starts[1:] > np.maximum.accumulate(stops)[:-1])
    first = np.nonzero(new)[0]
    parts: list[np.ndarray] = []
    for a, b in zip(starts[first].tolist(), np.maximum.reduceat(stops, first).tolist()):
        parts += [ids[a:b], np.zeros(1, np.uint64)]
    return np.concatenate(parts[:-1])


def _items(benchmark: DataFrame, text: str) -> DataFrame:
    """(item, item_id, ids, seeds) of each distinct item of TILE tokens or more; item is a number for it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words()
        found = [words.ids(t) for t in batch.column(2).to_pylist()]
        keep = [k for k, ids in enumerate(found) if len(ids) >= TILE]
        listed = [np.unique(seeds(found[k], len(found[k]))).view(np.int64) for k in keep]
        rest = batch.take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [rest.column(0), rest.column(1), pa.array([found[k].astype("<u8").tobytes() for k in keep], pa.binary()), pa.array([x.tolist() for x in listed], pa.list_(pa.int64()))], ["item", "item_id", "ids", "seeds"]
        )

    rows = benchmark.select("item_id", text).where(F.col(text).isNotNull()).distinct()
    return map_batches(rows.select(F.xxhash64("item_id", text).alias("item"), "item_id", text), run, "item bigint, item_id bigint, ids binary, seeds array<bigint>")


def _bloom(items: DataFrame) -> np.ndarray:
    """The filter, gathered as words of 64 bits: BLOOM_BITS / 64 of them at most."""
    spread = items.select(F.explode("seeds").alias("h"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column(0).to_numpy().view(np.uint64)
        bits = np.concatenate([_bit(h, k) for k in range(PROBES)])
        return pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], ["w", "b"])

    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in map_batches(spread, run, "w int, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bloom[r["w"]] = r["b"]
    return bloom.view(np.uint8)


def _met(docs: DataFrame, text: str, bloom: np.ndarray, lengths: list[int], reach: int) -> DataFrame:
    """(row, doc_id, text_hash, near, seeds) of each row of docs of which seeds pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        from pyspark import TaskContext

        words, row = Words(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, kept, near, listed = [], [], [], []
            for k, value in enumerate(batch.column(2).to_pylist()):
                row += 1
                if not value:
                    continue
                ids = words.ids(value)
                found = [(seeds(ids, n), n) for n in lengths]
                hits = [(_passes(shared.value, h), h) for h, _ in found]
                places = np.unique(np.concatenate([at for at, _ in hits]))
                if len(places):
                    rows.append(row)
                    kept.append(k)
                    near.append(_near(ids, places, reach).astype("<u8").tobytes())
                    listed.append(np.unique(np.concatenate([h[at] for at, h in hits])).view(np.int64).tolist())
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), some.column(0), some.column(1), pa.array(near, pa.binary()), pa.array(listed, pa.list_(pa.int64()))], ["row", "doc_id", "text_hash", "near", "seeds"])

    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text)
    return rows.mapInArrow(run, "row bigint, doc_id bigint, text_hash bigint, near binary, seeds array<bigint>")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _found(docs: DataFrame, benchmark: DataFrame, text: str, coverage: float) -> DataFrame | None:
    """(row, doc_id, text_hash, item_id, coverage, n_tiles) of each pair that is found; None for an empty benchmark."""
    items = cut(_items(benchmark, "text"))
    size = F.octet_length("ids") / 8
    about = items.agg(F.max(size).alias("reach"), F.collect_set(F.least(size, F.lit(SEED)).cast("int")).alias("lengths")).first()
    if not about["lengths"]:
        return None
    met = cut(_met(docs, text, _bloom(items), sorted(about["lengths"]), int(about["reach"])))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")
    of_docs = met.select("row", salt.alias("salt"), F.explode("seeds").alias("seed"))
    of_items = _salted(items.select("item", F.explode("seeds").alias("seed")))
    pairs = of_docs.join(of_items, ["seed", "salt"]).select("row", "salt", "item").distinct()
    tiled = pairs.join(_salted(items.select("item", "item_id", "ids")), ["item", "salt"]).select("row", "item_id", "ids").join(met.drop("seeds"), "row")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, covered, n_tiles = [], [], []
        for k, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            item, near = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            inside = np.nonzero(np.isin(rolling(item, TILE), rolling(near, TILE)))[0]
            most = np.zeros(len(item), bool)
            for d in range(TILE):
                most[inside + d] = True
            if most.sum() < coverage * len(item):  # tiles can't cover more than the shared windows do
                continue
            tiles = tile(item, near)
            share = sum(n for _, _, n in tiles) / len(item)
            if share >= coverage:
                kept.append(k)
                covered.append(share)
                n_tiles.append(len(tiles))
        rest = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array(covered, pa.float64()), pa.array(n_tiles, pa.int32())], ["row", "doc_id", "text_hash", "item_id", "coverage", "n_tiles"])

    columns = tiled.select("row", "doc_id", "text_hash", "item_id", "ids", "near")
    return map_batches(columns, run, "row bigint, doc_id bigint, text_hash bigint, item_id bigint, coverage double, n_tiles int")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) for each row of docs and each item that it holds.

    Null and empty texts on either side hold and are held by nothing; repeated rows of docs are reported for each, those
    of the benchmark once. Long and periodic texts are read whole. Other columns don't matter. An empty benchmark or
    table gives no rows.
    """
    found = _found(docs, benchmark, text, coverage)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, coverage double, n_tiles int")
    return found.select("doc_id", "item_id", "coverage", "n_tiles")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, whole, that hold no item; null and empty texts stay, repeated rows stay or go together."""
    found = _found(docs, benchmark, text, coverage)
    if found is None:
        return docs
    gone = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text]) == gone["__hash"]), "left_anti")
