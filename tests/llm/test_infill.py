import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import infill

SCHEMA = "doc_id bigint, text string, n string, form int, output string"


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    one, two = sorted(x % (len(units) + 1) for x in h[:2])
    a, m, z = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (len(units), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}")
    return (len(units), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}")


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    found = infill.transform(df, **options)
    got = found.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted([(i, *plain(i, t, **{k.replace("_rate", ""): v for k, v in options.items()}), t or "") for i, t in rows], key=key)
    assert sorted(map(tuple, got), key=key) == want


ODD = [None, "", "\n", "\n\n", "a", "a\n", "\na", "a\r\nb", "é\n\U0001f600\nß", "x <P> y\nz", "<S>", "<M>\n", "<", "a<\nP>\n<P\n>", "no end\nno end", "\x00\n\x85 z\n", " \n \n"]


def test_odd_texts(spark):
    rows = [(i * 31 + j, t) for i, t in enumerate(ODD) for j in range(5)]
    check(spark, rows + [(None, "a\nb\nc\n"), (None, None), (-3, "a\nb\nc"), (5, "same\nrow\n"), (5, "same\nrow\n")])
    check(spark, [])


@pytest.mark.parametrize("options", [{"rate": 0}, {"rate": 40, "spm_rate": 100}, {"spm_rate": 0}])
def test_rates(spark, options):
    check(spark, [(i, f"one {i}\ntwo\nthree\n") for i in range(60)], **options)


def test_long_texts_and_shared_passages(spark):
    dice = random.Random(2)
    word = lambda: "".join(dice.choice("abcdefghé\U0001f600 ") for _ in range(dice.randint(1, 9)))
    passage = "\n".join(word() for _ in range(400))
    rows = [(i, "".join(word() + dice.choice(["\n", " ", ""]) for _ in range(dice.randint(0, 300))) + passage) for i in range(40)]
    rows += [(90, "line\n" * 300_000), (91, "x" * 2_500_000), (92, "y" * 1_200_000 + "\nz<M>"), (93, "\n" * 200_000), (94, passage * 50)]
    check(spark, rows)


def test_marks_are_seen_across_chunks():
    for at in range(60, 300):
        data = b"a" * at + b"<P>" + b"b" * (400 - at)
        for ends in ([100, 200], [101, 202], [at + 1, at + 70], [at + 2]):
            *_, marked, _, _ = infill.split(data, 0, len(data), np.array(sorted(ends)), infill.Chunks(), (0, 0))[:4]
            assert marked


def test_chunks_are_shared_wherever_they_stand():
    dice = random.Random(3)
    passage = bytes(dice.randrange(32, 127) for _ in range(40_000))
    cuts = []
    for before in (0, 1, 333, 5000):
        data = bytes(dice.randrange(32, 127) for _ in range(before)) + passage
        found = infill._borders(0, len(data), infill.chunk_ends(np.frombuffer(data, np.uint8)))
        assert all(infill.LEAST <= b - a <= infill.MOST for a, b in zip(found[:-2], found[1:-1]))
        cuts.append({c - before for c in found if c - before > 3 * infill.MOST})
    assert len(cuts[0]) > 10 and cuts[0] == cuts[1] == cuts[2] == cuts[3]
    chunks = infill.Chunks()
    for data in (passage, passage):
        infill.split(data, 0, len(data), infill.chunk_ends(np.frombuffer(data, np.uint8)), chunks, (0, 0))
    assert chunks.hits >= 40


def test_hashes_don_t_depend_on_pieces(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(50_000), np.uint8)
    whole = infill.chunk_ends(data).tolist()
    monkeypatch.setattr(infill, "PIECE", 1000)
    assert infill.chunk_ends(data).tolist() == whole != []


def test_the_cache_is_bounded():
    chunks = infill.Chunks(most=10_000)
    for i in range(1000):
        assert chunks.summary(b"%d\n" % i * 20)[0] == 20
    assert sum(map(len, chunks.new)) <= 12_000 and sum(map(len, chunks.old)) <= 12_000
