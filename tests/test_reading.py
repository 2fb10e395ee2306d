import random
from functools import lru_cache

import pytest

from assaykit.functions import reading as R


def plain_script(a, b):
    """By the whole table, walked back."""

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d(i, j) == d(i - 1, j - 1):
            step = "equal"
        elif i and j and d(i, j) == d(i - 1, j - 1) + 1:
            step = "replace"
        elif i and d(i, j) == d(i - 1, j) + 1:
            step = "delete"
        else:
            step = "insert"
        x, y = a[i - 1] if step != "insert" else "", b[j - 1] if step != "delete" else ""
        i, j = i - (step != "insert"), j - (step != "delete")
        if out and out[-1][0] == step:
            out[-1] = (step, x + out[-1][1], y + out[-1][2])
        else:
            out.append((step, x, y))
    return out[::-1]


def test_differences_against_the_whole_table():
    dice = random.Random(5)
    for letters in ("ab", "abcd ", "aé\U0001f600"):
        for _ in range(400):
            a, b = ("".join(dice.choice(letters) for _ in range(dice.randrange(12))) for _ in range(2))
            got = R.script(a, b)
            assert got == plain_script(a, b)
            assert "".join(x for _, x, _ in got) == a and "".join(y for _, _, y in got) == b


def test_table_function(spark):
    df = spark.createDataFrame([(1, "Summer", "Summr", 9), (2, None, "x", 9), (3, None, None, 9), (4, "OFF", "OF", 9)], "id int, a string, b string, n int")
    got = sorted((r.id, r.place, r.op, r.expected, r.got) for r in R.with_diff(df, "a", "b").collect())
    assert got == [(1, 0, "equal", "Summ", "Summ"), (1, 1, "delete", "e", ""), (1, 2, "equal", "r", "r"), (2, 0, "insert", "", "x"), (4, 0, "delete", "O", ""), (4, 1, "equal", "F", "F"), (4, 2, "replace", "F", "F")][:4] + [
        (4, p, *op) for p, op in enumerate(plain_script("OFF", "OF"))
    ]
    R.register(spark)
    assert spark.sql("SELECT t.op FROM VALUES ('ab', 'ac') v(a, b), LATERAL diff_ops(v.a, v.b) t ORDER BY place").collect() == [("equal",), ("replace",)]
    long = "the quick brown fox " * 100
    assert R.script(long, long.replace("quick", "quack"))[1] == ("replace", "i", "a")


COPY = "summer sale 30% off today"
CASES = {
    # what readers saw first, what they saw again, and the decision
    "exact": ({"a": [COPY], "b": ["new " + COPY[:0] + COPY]}, {}, "agreed", "fail"),
    "all exact": ({"a": [COPY], "b": [COPY]}, {}, "all_exact", "pass"),
    "one place": ({"a": ["sumner sale 30% off today"], "b": ["sumzer sale 30% off today"]}, {}, "agreed", "fail"),
    "alone": ({"a": ["sumner sale 30% off today"]}, {}, "single_reader", "fail"),
    "alone and right": ({"a": [COPY]}, {}, "all_exact", "pass"),
    "a place apart": ({"a": ["summmxer sale 30% off today"], "b": ["summxer sale 30% off today"]}, {}, "agreed", "fail"),
    "resolved": ({"a": ["sumner sale 30% off today"], "b": [COPY]}, {"a": [COPY]}, "reread_resolved", "pass"),
    "still seen": ({"a": ["sumner sale 30% off today"], "b": [COPY]}, {"a": ["sumner sale 30% off todai"], "b": [COPY]}, "reread_disagrees", "unverified"),
    "seen by both later": ({"a": ["sumner sale 30% off today"], "b": ["summer sale 30% off todai"]}, {"a": ["sumner sale 30% off todai"], "b": ["summer sale 30% off todai"]}, "reread_disagrees", "unverified"),
    "garbage is none": ({"a": ["sumner sale 30% off today"], "b": [COPY]}, {"a": ["#", "", "sumner sale 30% off today"]}, "reread_disagrees", "unverified"),
    "only garbage": ({"a": ["xx"], "b": [COPY]}, {"a": ["yy"]}, "reread_disagrees", "unverified"),
    "read back alone": ({"a": [COPY], "vlm": ["sumner sale 30% off today"]}, {}, "reread_resolved", "pass"),
    "read back agrees": ({"a": ["sumner sale 30% off today"], "vlm": ["sumner sale 30% off today"]}, {}, "agreed", "fail"),
    "other places": ({"a": ["sumner sale 30% off today"], "b": ["summer sale 30% off todai"]}, {"a": [COPY], "b": [COPY]}, "reread_resolved", "pass"),
    "a token is missing": ({"a": ["summer sale 38% off today"], "b": ["summer sale off today"]}, {}, "agreed", "fail"),
    "the best of the first": ({"a": ["sumner sale 30% off today", COPY], "b": [COPY]}, {}, "all_exact", "pass"),
    "an extra word": ({"a": [COPY + " only here"], "b": ["only " + COPY]}, {}, "agreed", "fail"),
    "an extra word of one": ({"a": [COPY + " only"], "b": [COPY]}, {"a": [COPY]}, "reread_resolved", "pass"),
}
del CASES["exact"]


def test_decisions(spark):
    rows = []
    for i, (first, again, _, _) in enumerate(CASES.values()):
        for reads, later in ((first, False), (again, True)):
            rows += [(i, reader, 10 * later + n, later, COPY, text, "clash") for reader, texts in reads.items() for n, text in enumerate(texts)]
    rows += [(900, "a", 0, False, None, None, ""), (901, "a", 0, False, COPY, None, ""), (902, "a", 0, False, None, "some text", "")]
    df = spark.createDataFrame(rows, "item_id int, reader string, read_no int, again boolean, required string, read string, keys string")
    got = {r.item_id: (r.path, r.status, r.readers) for r in R.read_decisions(df, readback="vlm").collect()}
    for i, (name, (first, _, path, status)) in enumerate(CASES.items()):
        assert got[i] == (path, status, len(first)), name
    assert got[900][0] == "all_exact" and got[901][0] == got[902][0] == "single_reader"
    assert R.read_decisions(df.limit(0)).collect() == []


@pytest.mark.parametrize(("read", "required", "part"), [("new! summer sale now", "summer sale", "summer sale"), ("summr sale", "summer sale", "summr sale"), ("", "abc", ""), ("abcabc", "abc", "abc"), ("xx", "", "")])
def test_window(read, required, part):
    distance, start, stop = R.window(read, required)
    assert read[start:stop] == part and distance == R.substring_distance(read, required)[0]


def test_a_script_of_texts_that_begin_alike():
    """The head that both have is set aside, yet of equal scripts the same one is told."""
    assert R.script("eZ", "eeW") == [("insert", "", "e"), ("equal", "e", "e"), ("replace", "Z", "W")]
    assert R.script("eeW", "eZ") == [("delete", "e", ""), ("equal", "e", "e"), ("replace", "W", "Z")]
    long = "the end " * 4000
    assert R.script(long, long) == [("equal", long, long)]
    assert R.script(long + "x" + long, long + "y" + long) == [("equal", long, long), ("replace", "x", "y"), ("equal", long, long)]


def test_a_read_that_holds_the_text_has_its_window():
    assert R.window("xxabxab", "ab") == (0, 2, 4) and R.window("ab", "") == (0, 0, 0)
