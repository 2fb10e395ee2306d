"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams (1 to 3 letters of the lower-cased text, runs of other characters as one blank),
hashed to BUCKETS. A text's weight for a bucket is its share of the text's n-grams times the bucket's IDF. The
shares sum to 1, so a class score is the mean over the text's n-grams of idf x weight: no text has to be cut or
grouped, whatever its length.

IDF counts every training row. The weights are fitted by FTRL-proximal (per-coordinate rates, elastic net: L1
makes them sparse, L2 keeps them small) on a bounded sample of training rows, in SHARDS shards of ROUNDS passes
each, whose weights are then averaged. A temperature, fitted on rows of the sample kept apart, calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bounded_sample, map_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Training rows for the weights and the temperature, at most about this many, and letters used of each in fitting.
SAMPLE = 8_000
SHARDS = 4
ROUNDS = 3
RATE, SMOOTH, L1, L2 = 0.5, 1.0, 1e-5, 1e-6
SCALE = 50.0
#: Letters of a text that are looked up at a time.
STEP = 1 << 20


def _fold(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with a blank for each character that is no letter, and blanks around it."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    return np.where(ascii_letter | (points >= 0xAA), points, np.uint32(32))


def grams(points: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each n-gram; those that are blank alone are left out."""
    parts = []
    state = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        state = (state[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        if n in ORDERS:
            mixed = state ^ (state >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            parts.append((mixed >> np.uint32(8)) & np.uint32(buckets - 1))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams in each."""
    index, counts = np.unique(grams(_fold(text)), return_counts=True)
    return index, counts / max(1, counts.sum())


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # BUCKETS x classes: SCALE x idf x weight
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        points = _fold(text)
        total, n = np.zeros(len(self.classes)), 0
        for at in range(0, len(points), STEP):
            g = grams(points[at : at + STEP + max(ORDERS) - 1] if at + STEP < len(points) else points[at:])
            total += self.table.take(g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest class and its calibrated probability; und and 0 for a text without letters or a model without classes."""
        if not self.classes or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many texts have each bucket, over all rows, and the number of rows. Counted in each task, then summed:
    the driver gets BUCKETS rows at most."""

    def run(batches):
        found, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                hit = np.zeros(BUCKETS, bool)
                points = _fold(value or "")
                for at in range(0, len(points), STEP):
                    hit[grams(points[at : at + STEP + max(ORDERS) - 1])] = True
                found += hit
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.nonzero(found)[0], -1).astype(np.int32)), pa.array(np.append(found[found > 0], rows))], ["bucket", "n"])

    counts = texts.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in counts:
        if r["bucket"] >= 0:
            out[r["bucket"]] = r["n"]
    return out, sum(r["n"] for r in counts if r["bucket"] < 0)


def ftrl(rows: list, n_classes: int, z: np.ndarray, n: np.ndarray, seed: int) -> None:
    """One pass of FTRL-proximal over rows (buckets, values, class); z and n are changed in place."""
    order = np.random.default_rng(seed).permutation(len(rows))
    for k in order:
        index, x, label = rows[k]
        zi, ni = z[index], n[index]
        w = ftrl_weights(zi, ni)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / RATE
        z[index] = zi + g - sigma * w
        n[index] = ni + g * g


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    free = np.abs(z) > L1
    return np.where(free, -(z - np.sign(z) * L1) / ((SMOOTH + np.sqrt(n)) / RATE + L2), 0.0)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages in rows; rows without text or lang are left out. Without rows it has no classes."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    frequency, total = document_frequencies(rows)
    if not total:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    classes = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    part = lambda seed, n: F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(n)).cast("int")
    chosen = bounded_sample(rows, sample, total, "doc_id", "text").select("text", "lang", part(7, SHARDS).alias("shard"), (part(11, 8) == 0).alias("apart"))
    k = len(classes)

    def prepared(table: pa.Table) -> list:
        out = []
        for value, label, apart in zip(table["text"].to_pylist(), table["lang"].to_pylist(), table["apart"].to_pylist()):
            index, x = features(value)
            if len(index):
                out.append((np.append(index, BUCKETS), np.append(SCALE * x * idf[index], 1.0), classes.index(label), apart))
        return out

    def shard(table: pa.Table) -> pa.Table:
        # in an order of its own, so that the weights don't depend on how rows were dealt
        rows = [r[:3] for r in prepared(table.sort_by([("text", "ascending"), ("lang", "ascending")])) if not r[3]]
        z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
        for epoch in range(ROUNDS):
            ftrl(rows, k, z, n, epoch)
        return pa.table({"w": pa.array([ftrl_weights(z, n).astype("<f4").tobytes()], pa.binary()), "rows": pa.array([len(rows)], pa.int64())})

    fitted = chosen.groupBy("shard").applyInArrow(shard, "w binary, rows bigint").collect()
    parts = sorted((r["rows"], bytes(r["w"])) for r in fitted if r["rows"])
    weights = sum((n * np.frombuffer(w, "<f4").reshape(BUCKETS + 1, k).astype(np.float64) for n, w in parts), np.zeros((BUCKETS + 1, k)))
    weights /= max(1, sum(n for n, _ in parts))
    model = Model(classes, (SCALE * idf[:, None] * weights[:BUCKETS]).astype(np.float32), weights[BUCKETS])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        logits = [model.logits(v).tolist() for v in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(logits, pa.list_(pa.float64())), batch.column(1)], ["z", "lang"])

    apart = map_batches(chosen.where("apart").select("text", "lang"), score, "z array<double>, lang string").collect()
    if apart:
        z, y = np.array([r["z"] for r in apart]), np.array([classes.index(r["lang"]) for r in apart])
        grid = np.geomspace(0.05, 20, 121)
        # smoothed targets, so that a sample without a mistake doesn't make every later one certain
        slack = 1 / (len(y) + 2)
        target = np.full(z.shape, slack / k)
        target[np.arange(len(y)), y] += 1 - slack
        loss = [-(target * np.log(softmax(z / t) + 1e-300)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row. Null texts and texts without a letter are `und` with score 0.
    Repeated rows stay; other columns don't matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(v) for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", text), run, "doc_id bigint, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose language is told with a probability of `least` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(v) for v in batch.column(at).to_pylist()]
        return batch.filter(pa.array([name != "und" and p >= least for name, p in found]))

    return map_batches(docs, run, docs.schema)
