"""What several readers make of one text: the errors of each read, merged differences, and the decision between readers.

A read is (item_id, reader, read_no, again, required, read): `again` is false for a reader's first reads and true for those made to
settle a dispute. Errors are keys, rows of (kind, pos, glyph): chg where a character of the required text is changed or
left out, ins where one is put in, missing a critical token, extra a word beside the text that was looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.text import critical_tokens, edits, missing_tokens, normalise, shared_start, substring_distance
from assaykit.session import cut

#: A read with more errors a character than this is none; letters and digits an extra word has at least.
GARBAGE, LEAST_EXTRA = 0.5, 2
KEYS = "array<struct<kind:string,pos:int,glyph:string>>"


def window(read: str, required: str) -> tuple[int, int, int]:
    """(distance, start, stop) of the part of read that is nearest to required: the first to end, the shortest of those."""
    if (at := read.find(required)) >= 0:
        return 0, at if required else 0, at + len(required)
    distance, stop = substring_distance(read, required)
    _, back = substring_distance(read[:stop][::-1], required[::-1])
    return distance, stop - back, stop


def extras(read: str, start: int, stop: int, required: str) -> list[str]:
    """Words outside the window that the required text doesn't have."""
    known = set(required.split())
    words = [w.strip(".,:;!?\"'()[]") for part in (read[:start], read[stop:]) for w in part.split()]
    return [w for w in dict.fromkeys(words) if sum(c.isalnum() for c in w) >= LEAST_EXTRA and w not in known]


def read_keys(reads: DataFrame) -> DataFrame:
    """reads with cer, garbage and keys: the errors of the part of each read that is nearest to what was required. An
    empty read and one of a cer above GARBAGE are garbage; a null text is an empty one."""
    rows = reads.withColumns({c: F.coalesce(c, F.lit("")) for c in ("required", "read")})
    rows = rows.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")

    @F.pandas_udf(f"cer double, part string, keys {KEYS}")
    def compared(required: pd.Series, read: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for want, got in zip(required, read):
            if (want, got) in known:  # the reads of an item are often the same
                out.append(known[want, got])
                continue
            distance, start, stop = window(got, want)
            keys = [{"kind": k, "pos": p, "glyph": g or ""} for k, p, g in edits(want, got[start:stop])]
            keys += [{"kind": "extra", "pos": -1, "glyph": w} for w in extras(got, start, stop, want)]
            out.append((distance / len(want) if want else 0.0, got[start:stop], keys))
            known[want, got] = out[-1]
        return pd.DataFrame(out, columns=["cer", "part", "keys"])

    rows = rows.withColumn("c", compared("required", "read"))
    lacking = F.transform(missing_tokens(F.lower("c.part"), critical_tokens(F.col("required"))), lambda t: F.struct(F.lit("missing").alias("kind"), F.lit(-1).alias("pos"), t.alias("glyph")))
    garbage = (F.trim("read") == "") | (F.col("c.cer") > GARBAGE)
    return rows.withColumns({"cer": F.col("c.cer"), "garbage": garbage, "keys": F.concat("c.keys", lacking.cast(KEYS))}).drop("c")


def _blocks(kind: Column, pos: Column, glyph: Column, near: bool) -> Column:
    """What two keys that are one error have in common; `near` on one side, as places may differ by one."""
    at = lambda d: F.concat_ws(":", F.lit("ins"), pos + d, glyph)
    places = F.array(*(at(F.lit(d)) for d in ((-1, 0, 1) if near else (0,))))
    alone = F.when(F.length(glyph) == 1, F.array(F.concat_ws(":", F.lit("sign"), glyph))).otherwise(F.array().cast("array<string>"))
    words = F.array(kind)
    return F.when(kind == "chg", F.array(F.concat_ws(":", kind, pos))).when(kind == "ins", F.concat(places, alone)).when(kind == "extra", F.concat(words, alone)).otherwise(words)


def _sightings(keys: DataFrame, others: DataFrame) -> DataFrame:
    """Each row of keys (item_id, reader, read_no, kind, pos, glyph) with the reader2 and read_no2 of each row of others of
    its item that is the same error: one place changed; one sign put in, at most a place apart; one token, or one within the
    other from 3 characters on; one sign put in and one beside the text."""
    fold = lambda c: F.regexp_replace(normalise(c), " ", "")
    mine = keys.withColumn("word", fold(F.col("glyph"))).withColumn("block", F.explode(_blocks(F.col("kind"), F.col("pos"), F.col("word"), True)))
    theirs = others.select("item_id", F.col("reader").alias("reader2"), F.col("read_no").alias("read_no2"), F.col("kind").alias("kind2"), "pos", fold(F.col("glyph")).alias("word2"))
    theirs = theirs.withColumn("block", F.explode(_blocks(F.col("kind2"), F.col("pos"), F.col("word2"), False))).drop("pos")
    sign = F.col("block").startswith("sign:")
    inside = (F.least(F.length("word"), F.length("word2")) >= 3) & (F.contains("word", F.col("word2")) | F.contains("word2", F.col("word")))
    token = F.col("kind").isin("missing", "extra") & (F.col("kind") == F.col("kind2")) & ((F.col("word") == F.col("word2")) | inside)
    same = F.when(sign, F.col("kind") != F.col("kind2")).otherwise(F.col("kind").isin("chg", "ins") | token)
    return mine.join(theirs, ["item_id", "block"]).where(same).drop("block", "word", "word2", "kind2").distinct()


def read_decisions(reads: DataFrame, readback: str | None = None) -> DataFrame:
    """(item_id, readers, status, path) of each item, from its reads.

    agreed (fail): two readers' first reads show one error. all_exact (pass): none shows any. single_reader (fail): there is
    one reader, with errors. Else the errors count that every read of a reader shows, first ones and those made again, garbage left
    out (all of the first read's, if only garbage is left): reread_agreed (fail) if two readers share one, reread_resolved (pass) if
    none is left, reread_disagrees (unverified) otherwise. What the readback reader sees can agree with others, but
    alone leaves nothing open. The first read of a reader is the nearest, then that of the smallest read_no.
    """
    rows = read_keys(reads)
    best = F.row_number().over(Window.partitionBy("item_id", "reader").orderBy(F.col("again").asc(), "cer", "read_no"))
    rows = cut(rows.withColumn("first", best == 1).select("item_id", "reader", "read_no", "first", "garbage", "keys"))
    listed = lambda df: df.select("item_id", "reader", "read_no", F.inline("keys"))
    first = rows.where("first")
    items = first.groupBy("item_id").agg(F.count("*").alias("readers"), F.max(F.size("keys") > 0).alias("errors"))
    keys = listed(first)
    agreed = _sightings(keys, keys).where("reader < reader2").select("item_id", F.lit(True).alias("agreed")).distinct()
    items = items.join(agreed, "item_id", "left").withColumn("agreed", F.coalesce("agreed", F.lit(False)))
    settled = F.when(F.col("agreed"), "agreed").when(~F.col("errors"), "all_exact").when(F.col("readers") < 2, "single_reader")
    items = items.withColumn("path", settled)

    disputed = rows.join(items.where("path IS NULL").select("item_id"), "item_id", "left_semi")
    w = Window.partitionBy("item_id", "reader")
    usable = disputed.withColumn("good", F.count_if(~F.col("garbage")).over(w)).where(~F.col("garbage") | ((F.col("good") == 0) & F.col("first")))
    usable = usable.withColumns({"base": F.row_number().over(w.orderBy(F.col("first").desc(), "read_no")) == 1, "reads": F.count("*").over(w)})
    held = listed(usable.where("base")).join(usable.where("base").select("item_id", "reader", "reads"), ["item_id", "reader"])
    again = _sightings(held, listed(usable.where("NOT base"))).where("reader = reader2")
    seen = again.groupBy("item_id", "reader", "kind", "pos", "glyph").agg(F.countDistinct("read_no2").alias("seen"))
    every = held.join(seen, ["item_id", "reader", "kind", "pos", "glyph"], "left").where(F.coalesce("seen", F.lit(0)) == F.col("reads") - 1)
    every = every.select("item_id", "reader", "read_no", "kind", "pos", "glyph")
    shared = _sightings(every, every).where("reader < reader2").select("item_id", F.lit(True).alias("shared")).distinct()
    left = every.groupBy("item_id").agg(F.max(F.col("reader") != F.lit(readback or "")).alias("open"))
    items = items.join(shared, "item_id", "left").join(left, "item_id", "left")
    path = F.coalesce("path", F.when(F.col("shared"), "reread_agreed").when(F.coalesce("open", F.lit(False)), "reread_disagrees").otherwise("reread_resolved"))
    status = F.when(path.isin("all_exact", "reread_resolved"), "pass").when(path == "reread_disagrees", "unverified").otherwise("fail")
    return items.select("item_id", F.col("readers").cast("long").alias("readers"), status.alias("status"), path.alias("path"))


def script(expected: str, read: str) -> list[tuple[str, str, str]]:
    """(op, expected, read) of the fewest edits, neighbours of one kind merged. Walked back from the ends: an equal pair, then a changed
    one, then one left out, then one put in. By Myers' bit vectors."""
    tail = shared_start(expected[::-1], read[::-1])
    left_a, left_b = expected[: len(expected) - tail], read[: len(read) - tail]
    head = shared_start(left_a, left_b)
    a, b = left_a[head:], left_b[head:]
    full, places = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    columns = [(full, 0, 0, 0)]  # of the distance table: rises and falls downwards, and from the column before
    for c in b:
        up, down = columns[-1][:2]
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(across | up)) & full, up & across
        more, less, both = (rise << 1 | 1) & full, fall << 1 & full, same | down
        columns.append(((less | ~(both | more)) & full, more & both, rise, fall))
    steps = [("equal", expected[len(expected) - tail :], read[len(read) - tail :])] if tail else []
    i, j = len(left_a), len(left_b)
    while i or j:
        x, y = i - head, j - head
        if i == j and x <= 0:
            steps.append(("equal", left_a[:i], left_b[:j]))
            break
        if i and j and left_a[i - 1] == left_b[j - 1]:  # the distance is that without the two
            steps.append(("equal", left_a[i - 1], left_b[j - 1]))
            i, j = i - 1, j - 1
            continue
        # within the head that both have, what one has more of is all that differs
        slope = left = corner = 0
        if x > 0 and y > 0:
            slope = (columns[y][0] >> x - 1 & 1) - (columns[y][1] >> x - 1 & 1)
            left = (columns[y][2] >> x - 1 & 1) - (columns[y][3] >> x - 1 & 1)
            corner = left + (columns[y - 1][0] >> x - 1 & 1) - (columns[y - 1][1] >> x - 1 & 1)
        elif i > j:
            slope = 1
        if corner == 1:
            steps.append(("replace", left_a[i - 1], left_b[j - 1]))
            i, j = i - 1, j - 1
        elif slope == 1:
            steps.append(("delete", left_a[i - 1], ""))
            i -= 1
        else:
            steps.append(("insert", "", left_b[j - 1]))
            j -= 1
    merged: list[tuple[str, list[str], list[str]]] = []
    for op, x, y in reversed(steps):
        if merged and merged[-1][0] == op:
            merged[-1][1].append(x)
            merged[-1][2].append(y)
        else:
            merged.append((op, [x], [y]))
    return [(op, "".join(x), "".join(y)) for op, x, y in merged]


class _DiffOps:
    def eval(self, expected: str | None, read: str | None) -> Iterator[tuple[int, str, str, str]]:
        for place, op in enumerate(script(expected or "", read or "")):
            yield (place, *op)


#: A table function: the merged differences of two texts, in order. Null texts are empty. Also for SQL, see register().
diff_ops = F.udtf(_DiffOps, returnType="place int, op string, expected string, got string", useArrow=True)


def register(spark) -> None:
    """diff_ops(expected, read) as a table function of Spark SQL."""
    spark.udtf.register("diff_ops", diff_ops)


def with_diff(df: DataFrame, expected: str, read: str) -> DataFrame:
    """df with a row for each merged difference: place, op (equal, replace, delete, insert), expected, got. Rows are spread
    over as many tasks as a shuffle has, as a script costs far more than its bytes."""

    @F.pandas_udf("array<struct<place:int,op:string,expected:string,got:string>>")
    def ops(wanted: pd.Series, got: pd.Series) -> pd.Series:
        return pd.Series([[(n, *op) for n, op in enumerate(script(a or "", b or ""))] for a, b in zip(wanted, got)])

    rows = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("*", F.inline(ops(F.col(expected), F.col(read))))
