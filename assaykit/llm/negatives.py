"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels within a band.

Anchors are clustered by direction (spherical k-means, fitted on at most SAMPLE anchors). The search is a grid of tasks:
rows in groups of at most GROUP, anchors, sorted by cluster, in groups of at most ANCHORS. In a task each cluster sorts
the group's rows once, by what their inner product with a member can be at most: |row| * cos(angle to the
centroid - greatest angle of a member), times the member's own norm. Every member walks that list, all members of a
cluster in one matrix product a step, and leaves it when the bound is below the least score that could still change its
result: then its result is certified. Results of a task are k rows for each anchor and band, which are merged by rank.

The first walk, over the lists of rows of a member's own label, finds the positives; the second, over all rows, the negatives
of every positive at once. Components are whole numbers (floor(scale * x)), so scores are exact: products of doubles below 2**53,
of 64-bit integers above. Bounds carry a margin for their rounding. Nothing is capped or left out: a list that no bound ends is
walked to its end.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part; neither do those whose
scaled norm is 2**31 or more, as their scores may not fit a long. A shorter vector counts as zero beyond its end, an empty one
everywhere. Ties go to the smaller id. Repeated rows each count, but rows with an anchor's id are none of its positives or
negatives, and of anchors with one id that with the least label, then vector, stands for them. An empty table or one without anchors gives an
empty table. Columns other than the three named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import bounded_sample, map_batches
from assaykit.llm.mixing import running_totals
from assaykit.session import cut

#: Rows and anchors that a task holds at most, and the fewest rows that are worth a task.
GROUP, ANCHORS, FEWEST = 65_536, 8_192, 1_024
#: Anchors that clusters are fitted on, clusters at most, rounds of the fit.
SAMPLE, CLUSTERS, ROUNDS = 4_096, 64, 8
#: Members that walk together, and rows in a step of a walk.
MEMBERS, STEP = 512, 1_024
BIG = 2.0**31
ROW = "vec_id bigint, label bigint, norm double, q binary, row bigint"
FOUND = "anchor_id bigint, slot int, score bigint, vec_id bigint"


def scaled(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, norm, q, row) of the rows that take part; q holds whole components, of 2 bytes each where they fit, else 8."""
    rows = vectors.select(F.col(vec_id).cast("long"), F.col(label).cast("long"), F.col(vector).cast("array<double>"), F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(2)
        offsets, flat = column.offsets.to_numpy().astype(np.int64), column.values
        part = ~np.asarray(pa.compute.is_null(batch.column(0))) & ~np.asarray(pa.compute.is_null(batch.column(1))) & ~np.asarray(pa.compute.is_null(column))
        values = np.floor(scale * np.asarray(flat.fill_null(np.nan), dtype=np.float64))
        norms, packed = np.zeros(len(part)), [b""] * len(part)
        for i in np.flatnonzero(part):
            v = values[offsets[i] : offsets[i + 1]]
            norm = float(np.sqrt(np.square(v).sum())) if np.isfinite(v).all() else np.inf
            if not norm < BIG:
                part[i] = False
                continue
            norms[i] = norm
            packed[i] = v.astype("<i2" if not len(v) or np.abs(v).max() < 1 << 15 else "<i8").tobytes() + bytes([2 if not len(v) or np.abs(v).max() < 1 << 15 else 8])
        keep = pa.array(part)
        arrays = [batch.column(0), batch.column(1), pa.array(norms), pa.array(packed, pa.binary()), batch.column(3)]
        return pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], ["vec_id", "label", "norm", "q", "row"])

    return map_batches(rows, run, ROW)


def matrix(packed: list[bytes], whole: bool = False) -> np.ndarray:
    """Rows of components, zero beyond a row's end."""
    rows = [np.frombuffer(p, f"<i{p[-1]}", (len(p) - 1) // p[-1]) for p in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64 if whole else np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt(np.square(m).sum(1, keepdims=True)), 1e-300)


def _narrow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both over the components that both have: the others meet zeros."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def centroids(sample: list[bytes], most: int = CLUSTERS) -> np.ndarray:
    """Unit centroids of the directions in the sample; about half the root of its size, `most` at most."""
    points = _unit(matrix(sample))
    k = max(1, min(most, round(len(points) ** 0.5 / 2)))
    found = points[np.linspace(0, len(points) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ found.T, 1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(np.square(sums).sum(1, keepdims=True) > 0, _unit(sums), found)
    return found


class Lists:
    """The rows of a task: their lists by cluster, sorted by the bound on first use."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, packed: list[bytes], centres: np.ndarray, whole: bool):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.norms = ids[order], labels[order], norms[order]
        self.rows = matrix([packed[i] for i in order], whole)
        self.angles = np.arccos(np.clip(np.matmul(*_swap(*_narrow(_unit(self.rows.astype(np.float64)), centres))), -1, 1))

    def sorted(self, cluster: int, widest: float, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, bounds of them for a member of norm 1) of the rows in among, greatest bound first."""
        bound = self.norms[among] * np.cos(np.maximum(0.0, self.angles[among, cluster] - widest))
        order = np.argsort(-bound, kind="stable")
        return among[order], bound[order]


def _swap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return a, b.T


def walk(lists: Lists, positions: np.ndarray, bounds: np.ndarray, members: np.ndarray, norms: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(member, band, key) of the best k rows of each member and band, and the number of scores taken.

    A key is score * 2**bits + (the row's place from the end of the ids in order), so that the greatest key has the
    greatest score and then the smallest id. Keys that could leave 64 bits are Python's whole numbers.
    """
    bits = max(1, len(lists.ids)).bit_length()
    peak = norms.max(initial=0.0) * lists.norms[positions].max(initial=0.0)
    big = peak >= 2.0 ** (60 - bits)
    kind, none = (object, -(1 << 120)) if big else (np.int64, -(1 << 62))
    m, j = low.shape
    best = np.full((m, j, k), none, kind)
    margin = 1e-6 * (norms * lists.norms[positions].max(initial=0.0) + 1)
    last = (1 << bits) - 1
    active, at, scored = np.arange(m), 0, 0
    while at < len(positions) and len(active):
        here = positions[at : at + STEP]
        a, b = _narrow(members[active], lists.rows[here])
        scores = (a @ b.T).astype(kind)
        scored += scores.size
        keys = scores * (1 << bits) + (last - here).astype(kind)[None, :]
        barred = (lists.labels[here][None, :] == labels[active][:, None]) != same
        own = np.flatnonzero(np.isin(lists.ids[here], ids[active]))
        barred[:, own] |= lists.ids[here[own]][None, :] == ids[active][:, None]
        for s in range(j):
            fit = ~barred & (scores >= low[active, s][:, None]) & (scores <= high[active, s][:, None])
            # only members with a row that beats their k-th
            some = np.flatnonzero((fit & (keys > best[active, s, k - 1][:, None])).any(1))
            if len(some):
                new = np.where(fit[some], keys[some], none)
                if not big and new.shape[1] > k:
                    new = np.partition(new, -k, axis=1)[:, -k:]
                best[active[some], s] = np.sort(np.concatenate([best[active[some], s], new], 1), axis=1)[:, ::-1][:, :k]
        at += STEP
        if at < len(positions):
            third = best[active, :, k - 1]
            need = np.where(third == none, low[active].astype(np.float64), (third >> bits).astype(np.float64))
            need = np.where(low[active] > high[active], np.inf, need).min(1)
            active = active[norms[active] * bounds[at] + margin[active] >= need]
    at = np.nonzero(best != none)
    return at[0], at[1], best[at], scored


def _search(rows: DataFrame, anchors: DataFrame, groups: int, fields: int, centres: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, score, vec_id): the best k rows of each anchor and band (low, high), k from each task at most."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "slot": [], "score": [], "vec_id": []}
        if left.num_rows and right.num_rows:
            got = {c: right[c].to_numpy() for c in ("anchor_id", "label", "cluster", "norm", "angle")}
            cand = {c: left[c].to_numpy() for c in ("vec_id", "label", "norm")}
            whole = cand["norm"].max() * got["norm"].max() >= 2.0**52
            lists = Lists(cand["vec_id"], cand["label"], cand["norm"], left["q"].to_pylist(), centres, whole)
            members = matrix(right["q"].to_pylist(), whole)
            bands = [np.array(right[c].to_pylist(), np.int64).reshape(right.num_rows, -1) for c in ("low", "high")]
            by_label = {x: np.flatnonzero(lists.labels == x) for x in np.unique(got["label"])} if same else {}
            everything = np.arange(len(lists.ids))
            parts = np.unique(np.stack([got["cluster"], got["label"] if same else got["cluster"]], 1), axis=0)
            bits = max(1, len(lists.ids)).bit_length()
            for cluster, label in parts.tolist():
                who = np.flatnonzero((got["cluster"] == cluster) & ((got["label"] == label) if same else True))
                among = by_label[label] if same else everything
                positions, bounds = lists.sorted(cluster, got["angle"][who].max(), among)
                for w in (who[i : i + MEMBERS] for i in range(0, len(who), MEMBERS)):
                    m, s, keys, _ = walk(lists, positions, bounds, members[w], *(got[c][w] for c in ("norm", "anchor_id", "label")), *(b[w] for b in bands), k, same)
                    out["anchor_id"].append(got["anchor_id"][w][m])
                    out["slot"].append(s)
                    out["score"].append((keys >> bits).astype(np.int64))
                    out["vec_id"].append(lists.ids[((1 << bits) - 1 - (keys & ((1 << bits) - 1))).astype(np.int64)])
        kinds = {"anchor_id": pa.int64(), "slot": pa.int32(), "score": pa.int64(), "vec_id": pa.int64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), kinds[c]) for c, v in out.items()})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "label", "norm", "q", F.pmod("row", F.lit(groups)).cast("int").alias("g"), each(fields).alias("h"))
    right = anchors.select("anchor_id", "label", "norm", "q", "cluster", "angle", "low", "high", each(groups).alias("g"), "h")
    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _clustered(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """anchors with `cluster`, the nearest centroid, and `angle`, that to it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cosines = np.matmul(*_swap(*_narrow(_unit(matrix(batch.column(3).to_pylist())), centres)))
        nearest = np.argmax(cosines, 1)
        angle = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1, 1))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64()), pa.array(angle)], ["anchor_id", "label", "norm", "q", "cluster", "angle"])

    return map_batches(anchors, run, "anchor_id bigint, label bigint, norm double, q binary, cluster bigint, angle double")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that the condition
    `anchor` (over vec_id) picks and its first `positives` other rows of its label, the first `negatives` rows of other labels whose
    score is from low to high percent of the positive's."""
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, scale, vec_id, vector, label))
    least = F.min(F.struct("label", "q", "norm")).alias("a")
    picked = cut(rows.where(anchor).groupBy("vec_id").agg(least).select(F.col("vec_id").alias("anchor_id"), "a.label", "a.norm", "a.q"))
    n, n_anchors = rows.count(), picked.count()
    sample = bounded_sample(picked, SAMPLE, n_anchors, "anchor_id").orderBy("anchor_id").limit(SAMPLE).select("q")
    centres = centroids([r["q"] for r in sample.collect()]) if n_anchors else np.zeros((1, 0))
    wanted = min(GROUP, max(FEWEST, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    groups, fields = max(1, -(-n // wanted)), max(1, -(-n_anchors // ANCHORS))
    order = [F.col("cluster"), F.col("anchor_id")]
    placed = running_totals(_clustered(picked, centres), order, place=F.lit(1).cast("long"))
    placed = cut(placed.withColumn("h", F.expr(f"int(place div {ANCHORS})")).drop("place"))

    any_score = [F.array(F.lit(b).cast("long")).alias(name) for name, b in (("low", -(1 << 62)), ("high", 1 << 62))]
    near = _search(rows, placed.select("*", *any_score), groups, fields, centres, positives, same=True)
    near = cut(near.select("anchor_id", "rank", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))

    ordered = F.array_sort(F.collect_list(F.struct("rank", "positive_score")))
    scores = near.groupBy("anchor_id").agg(F.transform(ordered, lambda p: p["positive_score"]).alias("p"))
    # 100 * n >= low * p and 100 * n <= high * p, in whole numbers; absent positives have an empty band
    up = lambda p: F.ceil(p.cast("decimal(20,0)") * low / F.lit(100)).cast("long")
    down = lambda p: F.floor(p.cast("decimal(20,0)") * high / F.lit(100)).cast("long")
    slots = F.sequence(F.lit(0), F.lit(positives - 1))
    band = lambda f, none: F.transform(slots, lambda i: F.coalesce(f(F.get("p", i)), F.lit(none).cast("long")))
    banded = placed.join(scores, "anchor_id").select(placed["*"], band(up, 1).alias("low"), band(down, 0).alias("high"))
    found = _search(rows, banded, groups, fields, centres, negatives, same=False)
    found = found.select("anchor_id", (F.col("slot") + 1).alias("__p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = near.withColumnRenamed("rank", "__p")
    return found.join(known, ["anchor_id", "__p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
