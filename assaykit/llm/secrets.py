"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers.

Base spans are matches of three patterns (see BASE). The method adds spans: a run of letters, digits and `+/_=.-` of
LEAST_RUN characters or more is scored by the log-likelihood ratio of first-order Markov models over its characters.
There is one model of ordinary words and identifiers and one of random strings for each of ALPHABETS, of which the
likeliest counts. A run whose ratio reaches THRESHOLD is a secret, whatever letters it is made of; if base spans cover
only a part of it, the added span still is the whole run, and if they cover all of it, none is added.

The models are trained on labelled samples, counted in Spark from a bounded sample of rows (about SAMPLE, those with
the smallest hashes). Labelled random: values that the base patterns found, each for the narrowest alphabet that holds
it, and strings drawn evenly from each alphabet by a seeded generator. Labelled ordinary: runs outside of any span that
are too short for a secret, and neighbouring words of the rows joined as identifiers are (with signs, by capitals, with
numbers and dates), so that the models know how identifiers go on. What reaches the driver is one count for each label
and pair of characters, whatever the input.
"""

from __future__ import annotations

import math
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bounded_sample, map_batches

SAMPLE = 20_000
#: Least log-likelihood ratio of a whole run, and its least length.
THRESHOLD, LEAST_RUN = 12.0, 16
KINDS = ("assign", "access", "hex", "markov")

#: The base patterns, and the least length of what they find (24 for hex, which its pattern asks for).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
SHORT = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{3,15}(?![A-Za-z0-9+/_=.-])")
WORD = re.compile(r"[A-Za-z]{2,12}")
UPPER, LOWER, DIGITS, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=.-"
ALPHABET = UPPER + LOWER + DIGITS + SIGNS
#: What random strings are drawn from, narrow ones first.
ALPHABETS = [
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    UPPER + "234567",
    LOWER + "234567",
    LOWER,
    UPPER,
    LOWER + DIGITS,
    UPPER + DIGITS,
    UPPER + LOWER,
    UPPER + LOWER + DIGITS,
    UPPER + LOWER + DIGITS + "_-",
    UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + ".",
    ALPHABET,
]
#: Strings drawn from each alphabet, and their length.
DRAWN, DRAWN_LENGTH = 400, 40
_PLACE = np.full(128, -1, np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns; positions are code points, kind is an index of KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # runs of hexadecimal digits are maximal, so the long ones can be asked for at once
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(value: str) -> np.ndarray:
    """Places of a value's characters in ALPHABET."""
    return _PLACE[np.frombuffer(value.encode("ascii"), np.uint8)]


def _joined(spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """What spans (by start) cover, as runs that don't touch."""
    out: list[tuple[int, int]] = []
    for s, _, e, _ in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Markov:
    """Log-likelihoods of transitions. counts: by label, 0 for ordinary, k + 1 for ALPHABETS[k]. Each model is mixed with
    an even one over its own alphabet, and that with a little of all characters, so that nothing is impossible."""

    def __init__(self, counts: dict[int, np.ndarray], mix: float = 0.05):
        n = len(ALPHABET)
        self.logs = []
        for label, letters in enumerate([ALPHABET, *ALPHABETS]):
            c = counts.get(label, np.zeros((n, n)))
            even = np.isin(np.arange(n), _codes(letters)) * (1 - 1e-4) / len(letters) + 1e-4 / n
            rows = c.sum(axis=1, keepdims=True)
            overall = (c.sum(axis=0) + even * n) / (c.sum() + n)
            given = np.where(rows > 0, c / np.maximum(rows, 1), overall)
            weight = rows / (rows + n)  # a rarely seen letter says little about what follows it
            self.logs.append(np.log((1 - mix) * (weight * given + (1 - weight) * overall) + mix * even))
        self.trained = bool(counts)
        self.ordinary, self.random = self.logs[0], np.stack(self.logs[1:])

    def score(self, value: str) -> float:
        """Log-likelihood ratio of a whole run: the likeliest random model against the ordinary one."""
        c = _codes(value)
        if len(c) < 2 or not self.trained:
            return -math.inf
        a, b = c[:-1], c[1:]
        if len(c) > 4096:  # by counts, so that memory doesn't follow the length
            n = np.bincount(a * len(ALPHABET) + b, minlength=len(ALPHABET) ** 2).reshape(len(ALPHABET), -1)
            return float((self.random * n).sum(axis=(1, 2)).max() - (self.ordinary * n).sum())
        return float(self.random[:, a, b].sum(axis=1).max() - self.ordinary[a, b].sum())

    def spans(self, text: str, base: list) -> list[tuple[int, int, int, str]]:
        """The runs of a text that are taken for random, but for those that base spans cover."""
        found, covered, k = [], _joined(base), 0
        for m in RUN.finditer(text):
            run = m[0].strip("=.-/") + ("=" * (len(m[0]) - len(m[0].rstrip("="))))[:2]
            start = m.start() + len(m[0]) - len(m[0].lstrip("=.-/"))
            if len(run) < LEAST_RUN:
                continue
            while k < len(covered) and covered[k][1] <= start:
                k += 1
            if k < len(covered) and covered[k][0] <= start and start + len(run) <= covered[k][1]:
                continue
            if self.score(run) >= THRESHOLD:
                found.append((start, 3, start + len(run), run))
        return found


def narrowest(value: str) -> int:
    """The label of the first alphabet that holds a value."""
    letters = set(value)
    return next(k for k, a in enumerate(ALPHABETS, 1) if letters <= set(a))


def drawn() -> list[tuple[int, str]]:
    """Labelled random strings, the same ones at any time."""
    rng = random.Random(20)
    return [(k, "".join(rng.choices(a, k=DRAWN_LENGTH))) for k, a in enumerate(ALPHABETS, 1) for _ in range(DRAWN)]


def identifiers(words: list[str], seed: int) -> list[str]:
    """Neighbouring words joined as identifiers are; how depends on the text's seed alone."""
    rng, out = random.Random(seed), []
    for at in range(0, len(words) - 2, 3):
        some, c, bits = words[at : at + 3], words[at + 2], rng.getrandbits(80)

        def below(n: int) -> int:
            nonlocal bits
            bits, value = divmod(bits, n)
            return value

        some = some[: 1 + below(3)]
        sign, style = "__--/."[below(6)], below(6)
        some = [w.lower() for w in some] if style == 0 else [w.upper() for w in some] if style == 1 else [w.capitalize() for w in some] if style == 2 else some
        joined = ("" if style == 2 else sign).join(some)
        if below(2):
            tail, end = below(5), below(4)
            kind = below(5)
            number = str(below(100)) if kind == 0 else f"{below(10_000):04d}" if kind == 1 else f"{1990 + below(41)}{1 + below(12):02d}{1 + below(31):02d}" if kind == 2 else str(below(10**9)) if kind == 3 else "0" * (2 + below(8))
            joined += ("", "", "", sign, "_")[tail] + ("", number, number, f"{number}{sign}{below(1_000_000)}{sign}{c}")[end]
        out.append(joined)
    return out


def transitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(label, a, b, n): how often character b follows a in the labelled samples of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, labels = len(ALPHABET), len(ALPHABETS) + 1
        counts = np.zeros((labels, n * n), np.int64)
        for value in batch.column(0).to_pylist():
            value = value or ""
            base = base_spans(value)
            samples: dict[int, list[str]] = {}
            seed = crc32(value.encode("utf-8", "surrogatepass"))
            for _, _, _, v in base:
                samples.setdefault(narrowest(v), []).append(v)
            at = 0
            for start, end in [*_joined(base), (len(value), len(value))]:
                part = value[at:start]
                at = end
                samples.setdefault(0, []).extend(SHORT.findall(part))
                samples[0] += identifiers(WORD.findall(part), seed + start)
            for label, some in samples.items():
                # runs are parted by a sign that has no place
                c = np.concatenate([np.append(_codes(v), -1) for v in some]) if some else np.zeros(0, np.int64)
                inside = (c[:-1] >= 0) & (c[1:] >= 0)
                counts[label] += np.bincount(c[:-1][inside] * n + c[1:][inside], minlength=n * n)
        label, pair = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array((pair // n).astype(np.int32)), pa.array((pair % n).astype(np.int32)), pa.array(counts[label, pair])], ["label", "a", "b", "n"])

    found = map_batches(docs.select(text), run, "label int, a int, b int, n bigint")
    return found.groupBy("label", "a", "b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Markov:
    """The models of a bounded sample of docs and of what is drawn; without any ordinary sample nothing is found by them."""
    # the sample is bounded: its rows are spread, whatever number of files holds them
    chosen = bounded_sample(docs, sample, docs.count(), "doc_id", text).select(text).repartition(docs.sparkSession.sparkContext.defaultParallelism, text)
    n = len(ALPHABET)
    counts: dict[int, np.ndarray] = {}
    for r in transitions(chosen, text).collect():  # at most 15 x 68 x 68 rows
        counts.setdefault(r["label"], np.zeros((n, n)))[r["a"], r["b"]] = r["n"]
    if 0 not in counts:
        return Markov({})
    counts[0] = counts[0] + np.eye(n) * (1 + 0.05 * counts[0].sum(axis=1, keepdims=True))  # signs and letters repeat in rules and fillers
    for label, value in drawn():
        c = _codes(value)
        np.add.at(counts.setdefault(label, np.zeros((n, n))), (c[:-1], c[1:]), 1)
    return Markov(counts)


SPAN = "struct<start:int,end:int,kind:string>"


def scan(docs: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (start, end, kind) in code points, end exclusive, by start and then
    in the order of KINDS. spans holds the base spans and what the model adds. Null and empty texts have none;
    repeated rows stay; other columns don't matter; an empty table gives no rows. Long texts are read whole."""

    def listed(found):
        return [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e, _ in found]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, spans = [], []
        for value in batch.column(1).to_pylist():
            base = base_spans(value or "")
            bases.append(listed(base))
            spans.append(listed(sorted(base + model.spans(value or "", base))))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return map_batches(docs.select("doc_id", text), run, f"doc_id bigint, base array<{SPAN}>, spans array<{SPAN}>")


def redact(docs: DataFrame, model: Markov, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with each secret of text replaced by a mark and n_chars counted anew; every row and column stays.

    Overlapping spans are replaced as one. A null text stays null, repeated rows stay, and an empty table stays empty.
    """
    columns = docs.columns
    at = columns.index(text)
    counted = columns.index("n_chars") if "n_chars" in columns else None

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        base = base_spans(value)
        spans = sorted(base + model.spans(value, base))
        out, end = [], 0
        for s, _, e, _ in spans:
            if s >= end:
                out += [value[end:s], mark]
            end = max(end, e)
        return "".join([*out, value[end:]]) if spans else value

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = list(batch.columns)
        arrays[at] = pa.array([clean(v) for v in batch.column(at).to_pylist()], pa.string())
        if counted is not None:
            n = [None if v is None else len(v) for v in arrays[at].to_pylist()]
            arrays[counted] = pa.array(n, batch.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return map_batches(docs, run, docs.schema)
