"""SimHash near-duplicates, searched by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less meet half way: flipping one bit of each leaves one bit at most between
them. That odd bit is taken by a block of 16 bits that is left out of the key: some block holds one of the
differing bits (or none differ), and outside it the two differ by 2 bits at most, so that a variant of one with
at most one flipped bit equals such a variant of the other. Each distinct fingerprint emits 4 x 49 of these
variants, they are shuffled, and what collides is verified:

* two fingerprints alone under a key: their distance is counted;
* more than two: all pairs would grow with the square, so their members go to an exact round on full 64-bit
  variants. Fingerprints with a common variant at distance 1 (or 0) are at distance 2 or less. At distance 3 one
  of the two has an even number of ones: the even one emits what is 1 bit away and the odd one what is 2 bits
  away; under a common variant, every odd one is at distance 3 or less from every even one. So under each
  variant a star around the smallest member states only true links and loses no connection.

Components of the links are found by large-star and small-star rounds.

A radius of 3 of 64 bits is a similarity far above 0.9: at a Jaccard similarity of 0.8 about 15 % of the bits differ.
near_copies() looks for those with WORDS x 64 bits: TABLES keys of 28 bits are drawn from them, texts meet where the
first 6 bits are equal, and there the ball hashing goes on over the other 22 with one flip on either side. What meets is
held against FAR of all bits, and then against the shingles themselves. Where more than CROWD texts meet under a variant,
they are told leaders: of those that no leader is near, the most central becomes the next, until each is near one or is one. Of
those that it is told under its variants a text is linked to the nearest, so that a crowd of near copies costs a link for
each text and key. Leaders are only the cheap way: a crowd also states ties, a forest over all of its pairs at distance FAR or
less, so that whatever meets in a crowd has one cluster of ties. Where the links that were verified leave a cluster in several
components, all of its pairs between different components are held against each other by their shingles, in tasks of two
blocks of texts each, and only what joins two components becomes a row. The number of texts that are dealt to one task is
held at about GROUP by further bits of the key; a text goes to the tasks of all of its variants, so that all pairs meet that
would meet without, and in a crowd a text may be linked to one leader in each task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import map_batches
from assaykit.llm.components import connected_components
from assaykit.session import cut

RADIUS = 3
SHINGLE = 3
BLOCK = 16
#: Fingerprints whose variants one task makes.
SPREAD = 1 << 14
#: Shingles hashed at a time, so that memory doesn't follow the length of a text.
STEP = 1 << 17
#: near_copies(): 64-bit words of a fingerprint, keys drawn from its bits, their bits (equal, and flipped), the distance
#: of all bits that is looked at (four standard deviations beyond what a similarity of 0.8 has), the largest number of
#: texts under a variant of which all pairs are taken, and of texts that are meant to meet in one task.
WORDS, TABLES, EQUAL, FLIPPED, FAR, CROWD, GROUP = 4, 36, 6, 22, 64, 4, 1 << 17
#: Texts of a cluster in a block, and bytes of their shingles; prints that are held against each other at a time.
BLOCK_TEXTS, BLOCK_BYTES, CHUNK = 2048, 1 << 24, 256


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits: set where over half the shingles' XXH64 (seed 42) have a one. No words: 0."""
    import xxhash

    found = _words(text)
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    size = min(size, len(found))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(stops), STEP):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a long. Null or blank texts have fp 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", text), run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values) -> Column:
    return F.array(*[F.lit(_signed(x)).cast("long") for x in values])


def _variants(fps: DataFrame, masks: list[int]) -> DataFrame:
    flips = fps.select("fp", F.explode(_longs(masks)).alias("m"))
    return flips.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))


def _block_variants(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, key): for each block, the variants with at most one bit flipped outside it, with the block's number in it."""
    parts = []
    for j in range(64 // block):
        hole = ((1 << block) - 1) << (j * block)
        flips = [0] + [1 << b for b in range(64) if not hole >> b & 1]
        parts += [(_signed(m), _signed(~hole & (2**64 - 1)), _signed(j << (j * block))) for m in flips]
    plan = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(p, ("flip", "keep", "tag"))]) for p in parts])
    rows = fps.select("fp", F.explode(plan).alias("p"))
    key = F.col("fp").bitwiseXOR(F.col("p.flip")).bitwiseAND(F.col("p.keep")).bitwiseOR(F.col("p.tag"))
    return rows.select("fp", key.alias("key"))


def _star(rows: DataFrame, centre: Column) -> DataFrame:
    """Under each key, the link of every member to the smallest centre."""
    w = Window.partitionBy("key")
    return rows.select("fp", F.min(centre).over(w).alias("c")).where("fp != c").select(F.col("fp").alias("u"), F.col("c").alias("v"))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp at distance 3 or less: not all of them, but enough for every
    connection that all of them would make."""
    # variants are many: each task makes those of about SPREAD fingerprints, whatever the size of their table
    distinct = fps.select("fp").distinct()
    distinct = distinct.repartition(max(1, -(-fps.count() // SPREAD)), "fp")
    w = Window.partitionBy("key")
    met = _block_variants(distinct).select("fp", F.count("*").over(w).alias("n"), F.min("fp").over(w).alias("lo")).where("n > 1")
    met = cut(met.distinct())
    pairs = met.where((F.col("n") == 2) & (F.col("fp") != F.col("lo"))).select(F.col("fp").alias("u"), F.col("lo").alias("v"))
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    crowd = met.where("n > 2").select("fp").distinct()
    one = [1 << b for b in range(64)]
    two = [(1 << a) | (1 << b) for a, b in combinations(range(64), 2)]
    near = _star(_variants(crowd, [0, *one]), F.col("fp"))
    even = F.bit_count("fp") % 2 == 0
    meet = _variants(crowd.where(even), one).withColumn("even", F.lit(True))
    meet = meet.unionByName(_variants(crowd.where(~even), two).withColumn("even", F.lit(False)))
    far = _star(meet, F.when(F.col("even"), F.col("fp")))
    return pairs.unionByName(near).unionByName(far).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs.

    component_id is the smallest doc_id that a chain of links reaches, the row's own included. Rows with equal
    fingerprints are linked; repeated rows and repeated ids stay rows of their own. A null doc_id is never the
    smallest unless its component has no other. Other columns of docs don't matter. An empty table gives none.
    """
    fps = cut(fingerprints(docs, text))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(fps))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of runs of `size` words, sorted; a text of fewer words is one run."""
    import xxhash

    found = _words(text)
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    size = min(size, len(found))
    stops = ends[size - 1 :]
    starts = np.append(0, ends[: len(stops) - 1] + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(stops)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words whose bits are set where over half the hashes, mixed anew for each word, have a one."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STEP):
            x = hashes[at : at + STEP] + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _tables() -> np.ndarray:
    """The bits of each key, drawn once and for all."""
    rng = np.random.Generator(np.random.PCG64(4))
    return np.array([rng.permutation(64 * WORDS)[: EQUAL + FLIPPED] for _ in range(TABLES)])


def _keys(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    return bits[:, table].astype(np.int64) @ (1 << np.arange(len(table)))


def _led(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (places, place of the leader) of a crowd. The leader is the member that is nearest to what most members have
    in each bit: where texts are copies of one, with changes of their own, that one."""
    u, v, left, everyone = [], [], np.arange(len(prints)), np.arange(len(prints))
    while len(left):
        some = prints[left]
        ones = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(len(left), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        most = np.packbits(2 * ones > len(left), bitorder="little").view("<u8")
        leader = int(left[np.bitwise_count(some ^ most).sum(axis=1, dtype=np.int64).argmin()])
        near = np.bitwise_count(prints ^ prints[leader]).sum(axis=1, dtype=np.int64) <= FAR
        u.append(everyone[near & (everyone != leader)])
        v.append(np.full(len(u[-1]), leader))
        left = left[~near[left]]
    return u, v


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that links (u, v) connect with each."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[u], least[v])
        if (low == least[u]).all() and (low == least[v]).all():
            return least
        np.minimum.at(least, least[u], low)
        np.minimum.at(least, least[v], low)
        while (least[least] != least).any():
            least = least[least]


def _tied(prints: np.ndarray, some: list[np.ndarray], leaders: list[np.ndarray]) -> np.ndarray:
    """For each of a crowd, the smallest place that a chain of steps at distance FAR or less reaches. some, leaders: links that
    are known. What they connect is not looked at again, so that a crowd of near copies costs no more than its strays."""
    n = len(prints)
    least = _forest(n, np.concatenate(some), np.concatenate(leaders))
    parts, sizes = np.unique(least, return_counts=True)
    rest = np.nonzero(least != parts[sizes.argmax()])[0]
    u, v = [], []
    for at in range(0, len(rest), CHUNK):
        a = rest[at : at + CHUNK]
        for to in range(0, n, CHUNK * 16):
            b = np.arange(to, min(n, to + CHUNK * 16))
            apart = sum(np.bitwise_count(prints[a, k][:, None] ^ prints[b, k]).astype(np.int16) for k in range(WORDS))
            x, y = np.nonzero((apart <= FAR) & (least[a][:, None] != least[b]))
            pair = np.unique(least[a[x]] * n + least[b[y]])
            u.append(pair // n)
            v.append(pair % n)
    return least[_forest(n, np.concatenate(u), np.concatenate(v))[least]] if u else least


def _meeting(keys: np.ndarray, prints: np.ndarray, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in keys, which come by their node) at distance FAR or less whose keys differ in two bits at most: one
    flip on either side; of those in crowds, the pairs with leaders. Then ties (place, smallest place) that connect all such pairs
    in crowds. bits: which of the key's bits may be flipped, those of a row that was moved being none."""
    n = len(keys)
    flips = np.append(0, 1 << np.arange(FLIPPED)) if bits is None else bits
    owner = np.repeat(np.arange(n), len(flips)) if flips.ndim == 1 else np.nonzero(flips >= 0)[0]
    variants = (keys[:, None] ^ flips).ravel() if flips.ndim == 1 else (keys[:, None] ^ flips)[flips >= 0]
    order = np.argsort(variants, kind="stable")
    owner, variants = owner[order], variants[order]
    starts = np.nonzero(np.append(True, variants[1:] != variants[:-1]))[0]
    sizes = np.diff(np.append(starts, len(variants)))
    pairs, u, v, ties = [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int64)]
    for m in np.unique(sizes[(sizes > 1) & (sizes <= CROWD)]).tolist():
        met = owner[starts[sizes == m][:, None] + np.arange(m)]
        a, b = np.triu_indices(m, 1)
        pairs.append(np.unique(met[:, b].ravel() * n + met[:, a].ravel()))
    for a, m in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist()):
        members = owner[a : a + m]  # by place, as the sort is stable
        some, leaders = _led(prints[members])
        u += [members[x] for x in some]
        v += [members[y] for y in leaders]
        ties.append(members * n + members[_tied(prints[members], some, leaders)])
    if u:  # of the leaders that a text has under its variants, the nearest
        u, v = np.concatenate(u), np.concatenate(v)
        order = np.lexsort((v, np.bitwise_count(prints[u] ^ prints[v]).sum(axis=1, dtype=np.int64), u))
        u, v = u[order], v[order]
        first = np.append(True, u[1:] != u[:-1])[: len(u)]
        pairs.append(np.maximum(u, v)[first] * n + np.minimum(u, v)[first])
    out = np.unique(np.concatenate(pairs))
    u, v = out // n, out % n
    near = np.bitwise_count(prints[u] ^ prints[v]).sum(axis=1, dtype=np.int64) <= FAR
    ties = np.unique(np.concatenate(ties))
    least = _forest(n, ties // n, ties % n)
    tied = np.nonzero(least != np.arange(n))[0]
    return u[near], v[near], tied, least[tied]


def _prepared(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(doc_id, text_hash, node, prints, grams): node stands for the words of a text; grams holds its shingles, 4 bytes
    of each hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        nodes, prints, grams = [], [], []
        for value in batch.column(2).to_pylist():
            found = shingles(value, size)
            nodes.append(_signed(xxhash.xxh64_intdigest(b" ".join(_words(value)), 7)))
            prints.append(wide_fingerprint(found).astype("<u8").tobytes())
            grams.append(np.unique((found >> np.uint64(32)).astype("<u4")).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary()), pa.array(grams, pa.binary())], ["doc_id", "text_hash", "node", "prints", "grams"])

    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text)
    return map_batches(rows, run, "doc_id bigint, text_hash bigint, node bigint, prints binary, grams binary")


def _candidates(nodes: DataFrame, count: int, most: int = GROUP) -> DataFrame:
    """Links (u, v) between nodes (node, prints), `count` of them, that meet under a key; in crowds, those with leaders."""
    return _met(nodes, count, most).where("NOT tie").select("u", "v")


def _met(nodes: DataFrame, count: int, most: int = GROUP) -> DataFrame:
    """(u, v, tie) of nodes (node, prints), `count` of them: links, and the ties of crowds."""
    tables = _tables()
    split = min(FLIPPED, max(0, (count // (most << EQUAL)).bit_length()))  # bits of the key that deal as well
    mask = (1 << split) - 1

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
        whole = pa.table({"node": batch.column(0), "prints": batch.column(1)})
        group, moved = [], []
        for k, t in enumerate(tables):
            equal, low = k << EQUAL | _keys(prints, t[:EQUAL]), _keys(prints, t[EQUAL:]) & mask
            for flip in (0, *(1 << b for b in range(split))):
                group.append(equal << split | low ^ flip)
                moved.append(np.full(len(prints), flip != 0))
        many = pa.concat_tables([whole] * len(group)).combine_chunks()
        columns = [pa.array(np.concatenate(group), pa.int64()), pa.array(np.concatenate(moved)), *(c.combine_chunks() for c in many.columns)]
        return pa.RecordBatch.from_arrays(columns, ["g", "moved", "node", "prints"])

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, moved = group["node"].to_numpy(), group["moved"].to_numpy(zero_copy_only=False)
        prints = np.frombuffer(b"".join(group["prints"].to_pylist()), "<u8").reshape(-1, WORDS)
        keys = _keys(prints, tables[group["g"][0].as_py() >> EQUAL + split][EQUAL:]) & ~mask
        flips = np.append(0, 1 << np.arange(split, FLIPPED))
        u, v, a, b = _meeting(keys, prints, flips if not split else np.where(moved[:, None] & (flips > 0), -1, flips))
        tie = np.arange(len(u) + len(a)) >= len(u)
        u, v = np.append(u, a), np.append(v, b)
        return pa.table({"u": pa.array(np.maximum(node[u], node[v])), "v": pa.array(np.minimum(node[u], node[v])), "tie": pa.array(tie)})

    dealt = map_batches(nodes, deal, "g bigint, moved boolean, node bigint, prints binary")
    return dealt.groupBy("g").applyInArrow(meet, "u bigint, v bigint, tie boolean").distinct()


def _verified(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The links whose texts have at least this Jaccard similarity. grams: (node, grams)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
            if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = (grams.select(F.col("node").alias(n), F.col("grams").alias(f"{n}_grams")) for n in "uv")
    return map_batches(links.join(a, "u").join(b, "v").select("u", "v", "u_grams", "v_grams"), run, "u bigint, v bigint")


def _across(left: tuple, right: tuple, similarity: float) -> tuple[list[int], list[int]]:
    """Links (places in left and in right) of at least this Jaccard similarity, as many as it takes to join all components that
    have one. left, right: components, and the shingles of each text. Shingles that many texts have are counted as bits, the
    others by lists of the texts that have them."""
    n = len(right[0])
    _, labels = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    mine, theirs = labels[: len(left[0])], labels[len(left[0]) :]
    sizes = np.array([len(g) for g in right[1]])
    words, inverse, texts = np.unique(np.concatenate(right[1]), return_inverse=True, return_counts=True)
    dense = np.nonzero(texts > n / 64)[0]
    column = np.full(len(words), -1)
    column[dense] = np.arange(len(dense))
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    lists, ends = row[order], np.cumsum(texts)
    width = -(-len(dense) // 64) or 1
    bits = np.zeros((n, width), np.uint64)
    at = column[inverse]
    np.bitwise_or.at(bits, (row[at >= 0], at[at >= 0] // 64), np.uint64(1) << (at[at >= 0] % 64).astype(np.uint64))
    u, v = [], []
    for a, grams in enumerate(left[1]):
        size = len(grams)
        some = np.nonzero((theirs != mine[a]) & (np.minimum(sizes, size) >= similarity * np.maximum(sizes, size)))[0]
        if not len(some):
            continue
        place = np.minimum(np.searchsorted(words, grams), len(words) - 1)
        place = place[words[place] == grams]
        at = column[place]
        own = np.zeros(width, np.uint64)
        np.bitwise_or.at(own, at[at >= 0] // 64, np.uint64(1) << (at[at >= 0] % 64).astype(np.uint64))
        both = np.bitwise_count(bits[some] & own).sum(axis=1, dtype=np.int64)
        rare = [lists[ends[p] - texts[p] : ends[p]] for p in place[at < 0].tolist()]
        if rare:
            both += np.bincount(np.concatenate(rare), minlength=n)[some]
        some = some[both >= similarity * (size + sizes[some] - both)]
        for label, b in zip(*np.unique(theirs[some], return_index=True)):
            u.append(a)
            v.append(int(some[b]))
            mine[mine == label], theirs[theirs == label] = mine[a], mine[a]
    return u, v


def _between(clusters: DataFrame, grams: DataFrame, similarity: float, texts: int = BLOCK_TEXTS) -> DataFrame:
    """Links (u, v) of at least this Jaccard similarity that join all components between which a cluster has one. clusters:
    (cluster, node, root), root standing for the component; grams: (node, grams).

    Pairs are looked at for the texts outside a cluster's largest component, with all of its texts: blocks of the former (a)
    meet blocks of the latter (b), each two in one task."""
    parts = clusters.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("n > most.n")
    rows = clusters.join(whole.select("cluster", F.col("most.root").alias("most")), "cluster").join(grams, "node")
    rows = cut(rows.withColumn("other", F.col("root") != F.col("most")).drop("most"))

    def blocks(which: Column) -> Column:
        heavy = F.greatest(F.count_if(which) / texts, F.sum(F.when(which, F.octet_length("grams")).otherwise(0)) / BLOCK_BYTES)
        return F.greatest(F.ceil(heavy), F.lit(1)).cast("int")

    dealt = rows.join(rows.groupBy("cluster").agg(blocks(F.col("other")).alias("na"), blocks(F.lit(True)).alias("nb")), "cluster")
    place = F.xxhash64("node")
    a, b = F.pmod(place, F.col("na")).cast("int"), F.pmod(place, F.col("nb")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "a", "b", "side", "node", "root", "grams"]
    one = dealt.where("other").select("*", every("nb").alias("b")).withColumns({"a": a, "side": F.lit(True)}).select(columns)
    two = dealt.select("*", every("na").alias("a")).withColumns({"b": b, "side": F.lit(False)}).select(columns)

    def meet(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy(zero_copy_only=False)
        node, root = group["node"].to_numpy(), group["root"].to_numpy()
        found = [np.frombuffer(g, "<u4") for g in group["grams"].to_pylist()]
        left, right = np.nonzero(side)[0], np.nonzero(~side)[0]
        x, y = _across(*[(root[p], [found[k] for k in p]) for p in (left, right)], similarity) if len(left) and len(right) else ([], [])
        return pa.table({"u": pa.array([node[left[k]] for k in x], pa.int64()), "v": pa.array([node[right[k]] for k in y], pa.int64())})

    return one.unionByName(two).groupBy("cluster", "a", "b").applyInArrow(meet, "u bigint, v bigint")


def _components(met: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of links (u, v, tie) that hold, but for the roots; with the pairs of crowds that leaders
    don't link."""
    roots = connected_components(_verified(met.where("NOT tie").select("u", "v"), grams, similarity))
    tied = connected_components(met.where("tie").select("u", "v"))
    clusters = tied.select(F.col("root").alias("cluster"), "node").unionByName(tied.select(F.col("root").alias("cluster"), F.col("root").alias("node")).distinct())
    clusters = clusters.join(roots, "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("root"))
    more = cut(_between(clusters, grams, similarity))
    if not more.limit(1).count():
        return roots
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def near_copies(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component) of each row of docs; a component is what links of at least this Jaccard similarity
    on runs of `size` words connect. No link is stated that isn't so; of those at 0.8 some are missed (see README),
    and far more are where similarity is set lower, as TABLES and FAR are meant for 0.8 and above. Texts of the same
    words, whatever their ASCII case and white space, are one; null and blank texts as well."""
    rows = cut(_prepared(docs, text, size))
    nodes = rows.groupBy("node").agg(F.first("prints").alias("prints"))
    met = cut(_met(nodes, rows.count()))
    linked = met.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    grams = rows.select("node", "grams").join(linked, "node", "left_semi").dropDuplicates(["node"])
    roots = _components(met, grams, similarity)
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of near_copies(), the one with the smallest doc_id (a null one is greater than
    all others); all columns stay. Rows are known by id and text, so that one id may own several."""
    rows = near_copies(docs, text, size, similarity).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n")).alias("least")
    first = cut(rows.groupBy("component").agg(least).select(F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"), "least.n"))
    kept = docs.join(first.drop("n"), docs["doc_id"].eqNullSafe(first["__id"]) & (F.xxhash64(docs[text]) == first["__hash"]))
    if first.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["__id", "__hash"])
    return kept.select(*[docs[c] for c in docs.columns])
