"""Quality rules: base rules of a text, and a hashed n-gram log-likelihood ratio between trusted texts and the corpus.

Words and word pairs are hashed to BUCKETS. Two multinomials over the buckets are estimated: one from trusted rows
(labelled of good quality), one from all rows. ALPHA occurrences are added to each bucket of the corpus, and to the
trusted counts the share of them that trusted rows have of the corpus, so that rare buckets tend to a ratio of 1
at every size. A text's score is the mean of
log(p_trusted / p_corpus) over its n-grams; it is kept from THRESHOLD on. Ratios are kept as whole millionths, so
that a sum doesn't depend on its order and every text has one verdict.

All of it is DataFrame expressions. A text's words never leave its row but as bucket numbers, which are counted
or looked up at once and summed before the shuffle, where a row is one text or one bucket. What is broadcast is
the ratio of each bucket (BUCKETS rows) and the ids of the trusted rows (TRUSTED at most, those with the smallest
hash: the bounded labelled sample of the trusted multinomial; the corpus one counts every row).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import BLANKS, words
from assaykit.session import cut

BUCKETS = 1 << 18
ALPHA = 64.0
TRUSTED = 20_000
THRESHOLD = -0.1
UNIT = 1_000_000
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _grams(df: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """df's columns `keep` and the bucket of each word of w and of each pair of neighbours; a last word has a null pair,
    and a row without words two nulls. Exploded first, so that hashing is compiled with what follows."""
    each = df.select(*keep, "w", F.posexplode_outer("w").alias("__i", "__x"))
    one, two = F.xxhash64("__x"), F.xxhash64("__x", F.get("w", F.col("__i") + 1))
    pair = F.when(F.col("__i") + 1 < F.size("w"), F.pmod(two, F.lit(buckets)))
    return each.select(*keep, F.explode(F.array(F.when(F.col("__x").isNotNull(), F.pmod(one, F.lit(buckets))), pair)).alias("bucket"))


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, w (the words) and the figures of the base rules for each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("doc_id", whole.alias("t")).select("doc_id", "t", words(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("l"))
    df = df.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, F.col("t")))).cast("long").alias("n_symbols"),
        F.filter("l", lambda x: F.octet_length(F.trim(x, F.lit(BLANKS))) > 0).alias("l"),
        # a window is known by its hash; two windows of one text sharing it by chance is out of reach (2**-64 a pair)
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"),
    )
    figures = ["doc_id", "w", "n_words", "word_chars", "n_symbols"]
    lines = (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines")
    again = F.size(F.array_distinct("h")) < F.size("h")
    df = df.select(*figures, lines, F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    figures.append("n_dup_lines")
    # a field of one element: taking the field of the whole array here would cost its length for every element
    same = lambda e, k: F.coalesce(e["h"] == F.get("s", k - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get("s", k + 1)["h"], F.lit(False))
    df = df.select(*figures, F.sort_array(F.transform(F.filter("s", same), lambda e: e["i"])).alias("p"))
    covered = F.aggregate(
        F.transform("p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.select(*figures, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """(id) of good quality rows that aren't toxic, at most the given number, by hash."""
    good = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").alias("id")).distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(most)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio): log(p_trusted / p_corpus) in millionths for each bucket that occurs."""
    marked = docs.select("doc_id", text).join(F.broadcast(trusted.withColumn("one", F.lit(1))), F.col("doc_id") == F.col("id"), "left")
    grams = _grams(marked.select(words(F.col(text)).alias("w"), F.coalesce("one", F.lit(0)).alias("one")), "one", buckets=buckets).where("bucket IS NOT NULL")
    counts = cut(grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("one").alias("k")))
    total = counts.agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"))
    share = F.col("k_all") / F.col("n_all")
    # both totals are smoothed alike, so the ratio of the two probabilities is that of the smoothed counts, over the share
    logs = F.when(F.col("k_all") > 0, F.log((F.col("k") + ALPHA * share) / (F.col("n") + ALPHA) / share)).otherwise(0.0)
    return counts.join(F.broadcast(total)).select("bucket", F.round(logs * UNIT).cast("long").alias("ratio"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, the base figures, score, base_failed and kept.

    A null or blank text has no words and fails the base rules; its score is null. Without trusted rows every ratio
    is 0, and only the base rules decide. Repeated rows and ids are judged each for itself; other columns of
    docs and labels don't matter. An empty table gives no rows.
    """
    ratios = bucket_ratios(docs, trusted_ids(labels), text)
    base = base_figures(docs, text).withColumn("row", F.monotonically_increasing_id())
    keys = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = _grams(base.select("row", F.struct(*keys).alias("base"), "w"), "row", "base")
    scored = grams.join(F.broadcast(ratios), "bucket", "left").groupBy("row", "base").agg(F.sum("ratio").alias("total"), F.count("bucket").alias("n")).select("base.*", "total", "n")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("total") >= F.lit(math.floor(threshold * UNIT)) * F.col("n")
    return scored.select(
        *keys,
        (F.col("total") / F.col("n") / UNIT).alias("score"),
        failed.alias("base_failed"),
        (~failed & F.coalesce(enough, F.lit(False))).alias("kept"),
    )
