"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (by a seeded hash) and served one after another, its whole list up to `repeats` times.
A copy's virtual finish time is the number of its source's words served up to its end, divided by the source's target, so that
at time 1 each source has given its target. All copies are sorted by finish time and the list is truncated at the total
budget; the copy that the budget ends in is cut to the words that are left.

Targets share the budget by weight. None is more than `repeats` times its source's size: what is above is shared
again among the others by weight, until none is above. That level is found in closed form: sources sorted by cap / weight are
capped from the front, until the rest by weight fits.

Every sum is a running total over a range-sorted table (running_totals): ranges are sorted and summed apart and
raised by the totals of the ranges before them, so that neither a hot source nor the whole corpus meets in one task. Only the
sizes of documents are moved, never their texts. The sorted tables are checkpoints: what was written is what is read
again when an executor is lost.

Nulls: a null text has size 0, as has an empty one; documents of size 0 are kept with taken = 0. A null source is a source
of its own, the last; a null doc_id is an id like others. Equal hashes are ordered by doc_id and size, so that reruns agree;
repeated rows are documents of their own. Very long texts count whole. An empty table, or one without any word, gives
targets of 0. Columns other than doc_id, text and source are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import words
from assaykit.session import cut

SEED = 11
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows that one range of a running total is meant to hold.
ROWS = 500_000


def running_totals(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df, with for each name in values the sum of that column over all rows that come before in the order.

    Rows are range-partitioned by the order and kept in the shared folder with the number of their range; a range's base is the
    sum over the ranges before it (a table of one row a range). Rows that are equal in the order come one after
    another, in no given order.
    """
    spark = df.sparkSession
    df = df.withColumns(values)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__range").agg(*(F.sum(v).alias(v) for v in values))
    bases = bases.select("__range", *(F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"__base_{v}") for v in values))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(F.broadcast(bases), "__range").withColumns({v: F.col(f"__base_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return summed.drop("__range", *(f"__base_{v}" for v in values))


def cycle(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """sources with `rank` (from 0, by code point, null last) and `weight`, the weights in turn."""
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1).cast("long"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    return ranked.withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))


def targets(sources: DataFrame, budget: float | None = None, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size, rank, weight) with `target`: min(repeats * size, level * weight), where the level makes
    them add up to the budget (all sizes, if None; never more than repeats times all sizes)."""
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total = min(whole["size"] if budget is None else budget, repeats * whole["size"])
    cap = F.col("source_size") * F.lit(repeats)
    sorted_ = running_totals(sources, [cap / F.col("weight"), F.col("rank")], capped=cap.cast("double"), used=F.col("weight"))
    left = F.lit(whole["weight"]) - F.col("used")
    enough = F.col("capped") + cap / F.col("weight") * left >= F.lit(total * (1 - 1e-12))
    level = sorted_.where(enough & (left > 0)).agg(F.min_by((F.lit(float(total)) - F.col("capped")) / left, F.struct(cap / F.col("weight"), "rank")))
    level = level.first()[0] or 0.0
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float | None = None, repeats: int = REPEATS, seed: int = SEED, text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(per document, the mix): doc_id, source, size, source_size, target, taken of each row; and row, doc_id, source,
    repeat (from 0), finish, words of each copy that the mix takes, sorted by finish time over all ranges."""
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    rows = docs.select("doc_id", F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    # every row's place in the shuffled lists of all sources, one list after another
    placed = cut(running_totals(cut(rows), order, before=F.col("size"), row=F.lit(1).cast("long")))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("base"))
    known = cut(targets(cycle(sizes, weights), budget, repeats))
    matched = placed.withColumnRenamed("source", "__s").join(known, F.col("__s").eqNullSafe(F.col("source"))).drop("__s", "weight")
    matched = matched.withColumn("ends", F.col("before") - F.col("base") + F.col("size"))

    total = known.agg(F.sum("target")).first()[0] or 0.0
    total = int(round(total)) if budget is None else int(budget)
    served = [(F.col("source_size") * F.lit(float(i)) + F.col("ends")) / F.col("target") for i in range(repeats)]
    copies = matched.where("size > 0 AND target > 0").select("row", "doc_id", "source", "rank", "size", F.posexplode(F.array(*served)).alias("repeat", "finish"))
    queue = running_totals(copies, [F.col("finish"), F.col("rank"), F.col("row")], served=F.col("size"))
    # truncated at the budget: the copy that it falls in is cut
    taken = queue.where(F.col("served") < total).withColumn("words", F.least("size", F.lit(total) - F.col("served")))
    taken = cut(taken.select("row", "doc_id", "source", "repeat", "finish", "words", "rank"))
    by_row = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    each = matched.join(by_row, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    each = each.select("row", "doc_id", "source", "size", "source_size", "target", "taken")
    return each, taken.orderBy("finish", "rank", "row").drop("rank")
