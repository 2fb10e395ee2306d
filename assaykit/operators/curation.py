"""Data sets: item filters, joins of labels, sampling, packing, set operations, catalogues and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_items(outcomes: DataFrame, origin: str | None = None, dimension: str | None = None, outcome: str | None = None) -> DataFrame:
    """Item ids by origin (natural, planted), a dimension with any outcome, an outcome of it, or an outcome of any."""
    rows = outcomes.where(F.col("outcome").isNotNull())
    if origin:
        rows = rows.where((F.col("item_set") == "plant") == F.lit(origin == "planted"))
    if dimension:
        rows = rows.where(F.col("dimension") == dimension)
    if outcome:
        rows = rows.where(F.col("outcome") == outcome)
    return rows.select("item_id").distinct()


def gallery(items: DataFrame, item_set: str = "all", verdict: str = "all", failed: str = "all", product: str = "all", tag: str = "all") -> DataFrame:
    """Items by set, verdict, failed dimension, product and tag; "all" lets everything through."""
    tests = [(item_set, F.col("item_set") == item_set), (verdict, F.col("verdict") == verdict), (failed, F.array_contains("failed", failed)), (product, F.col("product_id") == product), (tag, F.array_contains("tags", tag))]
    for value, test in tests:
        items = items if value == "all" else items.where(test)
    return items


def eligible_bases(items: DataFrame, dims: tuple[str, ...], assume_pass: bool = False) -> DataFrame:
    """Natural items whose label is complete and passes everywhere; assume_pass lets unlabelled ones in, no others."""
    values = [F.try_element_at("labels", F.lit(d)) for d in dims]
    good = F.forall(F.array(*values), lambda v: F.coalesce(v, F.lit(False)))
    none = F.size("labels") == 0
    return items.where((F.col("item_set") == "nat") & ((good & ~none) | (F.lit(assume_pass) & none)))


def reason_targets(items: DataFrame) -> DataFrame:
    """(item_id, failed) of natural and final items whose product or context is labelled as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.try_element_at("labels", F.lit(d)), F.lit(d)) for d in ("product", "context")]))
    return items.where(F.col("item_set").isin("nat", "final")).select("item_id", failed.alias("failed")).where(F.size("failed") > 0)


def build_cases(outputs: DataFrame, planted: DataFrame, labels: DataFrame, assume_pass: bool = False) -> DataFrame:
    """Outputs and planted items with their labels: (item_id, origin, label_source, label, warning).

    labels: (sha, set, ok). An output gets its own set's label, else "assumed" (assume_pass) or "none". A planted item's
    label from people replaces its constructed one; a planted item whose source isn't among the outputs has a warning.
    """
    own = labels.select(F.col("sha").alias("l_sha"), F.col("set").alias("l_set"), "ok", F.lit(True).alias("found"))
    made = outputs.join(own, (F.col("sha") == F.col("l_sha")) & (F.col("set") == F.col("l_set")), "left")
    source = F.when(F.col("found"), "human").otherwise("assumed" if assume_pass else "none")
    natural = made.select("item_id", F.lit("natural").alias("origin"), source.alias("label_source"), F.when(F.col("found"), F.col("ok")).otherwise(F.lit(True if assume_pass else None).cast("boolean")).alias("label"), F.lit(False).alias("warning"))
    theirs = own.where("l_set = 'plant'").drop("l_set")
    known = outputs.select(F.col("sha").alias("o_sha"), F.lit(True).alias("has_source")).distinct()
    rows = planted.join(theirs, F.col("sha") == F.col("l_sha"), "left").join(known, F.col("source_sha") == F.col("o_sha"), "left")
    plant = rows.select("item_id", F.lit("planted").alias("origin"), F.when(F.col("found"), "human").otherwise("planted").alias("label_source"), F.when(F.col("found"), F.col("ok")).otherwise(F.col("constructed")).alias("label"), F.col("has_source").isNull().alias("warning"))
    return natural.unionByName(plant)


def enrich_items(items: DataFrame, images: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their image, their source's image and their product; planted items get no run."""
    img = images.select(F.col("sha").alias("i_sha"), F.col("width").alias("image_width"))
    src = images.select(F.col("sha").alias("s_sha"), F.col("width").alias("source_width"))
    rows = items.join(img, F.col("image_sha") == F.col("i_sha"), "left").join(src, F.col("source_sha") == F.col("s_sha"), "left").join(products, "product_id", "left")
    return rows.withColumn("run_id", F.when(F.col("item_set") != "plant", F.col("run_id"))).drop("i_sha", "s_sha")


def merge_labels(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with the incoming labels of people ("human:...") that have the three core dimensions and whose (sha,
    set) is new; of equal incoming keys the first labeller by name."""
    ready = incoming.where(F.col("labeller").startswith("human:") & F.col("technical").isNotNull() & F.col("text").isNotNull() & F.col("product").isNotNull())
    w = Window.partitionBy("sha", "set").orderBy("labeller")
    new = ready.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").join(existing.select("sha", "set"), ["sha", "set"], "left_anti")
    return existing.unionByName(new.select(existing.columns))


def pool(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_generated(old: DataFrame, new: DataFrame, pure: DataFrame, key: str = "item_id") -> DataFrame:
    """Generated items kept beside new ones, new before old; an id that is also a pure one is an error."""
    clash = old.select(key).unionByName(new.select(key)).intersect(pure.select(key))
    if clash.limit(1).count():
        raise ValueError(f"generated and pure items share ids, as {clash.first()[0]}")
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def diff_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): what is in a only, in b only, or in both."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("both")
    return x.join(y, key, "full").select(key, side.alias("side"))


def content_catalog(df: DataFrame, column: str, key: str) -> DataFrame:
    """(sha, prefix, bytes, first_id, copies): each content once, under its SHA-256 and the folder of its first two digits."""
    c = F.coalesce(F.col(column), F.lit("")).cast("binary")
    rows = df.select(F.sha2(c, 256).alias("sha"), F.octet_length(c).cast("long").alias("bytes"), F.col(key).alias("k"))
    out = rows.groupBy("sha").agg(F.max("bytes").alias("bytes"), F.min("k").alias("first_id"), F.count("*").alias("copies"))
    return out.withColumn("prefix", F.substring("sha", 1, 2))


def dataset_version(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, version) of each frame: 12 digits that don't depend on the order of rows. Row hashes are sorted and
    hashed by their first five digits, those by two, and those in turn, so that no list grows long."""
    out = []
    hashed = lambda: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), "")).alias("h")
    for name, df in sorted(frames.items()):
        row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)]))
        rows = df.select(row.alias("h")).select(F.col("h").alias("b"), "h")
        fine = rows.groupBy(F.substring("b", 1, 5).alias("k")).agg(hashed(), F.count("*").alias("n")).withColumnRenamed("k", "b")
        coarse = fine.groupBy(F.substring("b", 1, 2).alias("k")).agg(hashed(), F.sum("n").alias("n")).withColumnRenamed("k", "b")
        whole = coarse.agg(hashed(), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        out.append(whole.select(F.lit(name).alias("name"), "rows", F.substring("h", 1, 12).alias("version")))
    return pool(*out)


PARTS = 256


def quota_sample(bases: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Bases for each class of plan (mutation, k, capability): of the capable ones k by a seeded hash rank, every class
    starting at another place of the ranking so that bases are used evenly; shortfall where there aren't enough."""
    rank = F.md5(F.concat_ws("-", F.lit(seed), F.col("base_id"), F.col("mutation")))
    rows = bases.join(F.broadcast(plan), F.col("capabilities").bitwiseAND(F.col("capability")) == F.col("capability"))
    # the best k of each of many parts first, so that one task ranks few rows of a class
    part = Window.partitionBy("mutation", F.pmod(F.xxhash64("base_id"), F.lit(PARTS))).orderBy(rank, "base_id")
    best = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= F.col("k"))
    whole = Window.partitionBy("mutation").orderBy(rank, "base_id")
    taken = best.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= F.col("k"))
    listed = taken.groupBy("mutation").agg(F.count("*").alias("taken"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "base_id"))), lambda s: s["base_id"].cast("string")), ",").alias("bases"))
    return plan.join(listed, "mutation", "left").select("mutation", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), (F.col("k") - F.coalesce("taken", F.lit(0))).cast("long").alias("shortfall"), "bases")


def pack(rows: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of each group in order while their tokens (a quarter of the characters, one at least) fit the budget; the
    first that doesn't fit ends the group."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def stalled(candidates: DataFrame, similarity: DataFrame, least: float = 0.98) -> DataFrame:
    """Failing children that are `least` or more alike their parent; regenerated ones aside. similarity: (candidate_id, sim)."""
    rows = candidates.where(F.col("parent_id").isNotNull() & (F.col("kind") != "regenerate") & ~F.coalesce("passed", F.lit(False)))
    return rows.join(similarity.where(F.col("sim") >= least), "candidate_id").select("candidate_id", "parent_id", "sim")


def order_checks(checks: DataFrame, top: int = 3) -> DataFrame:
    """For each item its checks in the order to show them: deterministic first, then by dimension, then name; the first
    few that failed."""
    dims = F.array(*map(F.lit, ("technical", "text", "product", "context", "composition")))
    key = F.struct((F.col("method") != "deterministic").alias("m"), F.array_position(dims, F.col("dimension")).alias("d"), F.col("check_name").alias("c"))
    listed = F.array_sort(F.collect_list(F.when(~F.col("passed"), key)))
    return checks.groupBy("item_id").agg(F.array_join(F.transform(F.slice(listed, 1, top), lambda s: s["c"]), ",").alias("evidence"))


def numeric_order(col: Column) -> list[Column]:
    """Order of ids such as B2 before B10."""
    return [F.regexp_extract(col, r"^(\D*)", 1), F.coalesce(F.regexp_extract(col, r"(\d+)", 1).try_cast("long"), F.lit(0)), col]


def facets(items: DataFrame) -> DataFrame:
    """(product_id, name, items, tags): products with their first name by item id, and the tags that aren't outcomes."""
    rows = items.groupBy("product_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("item_id"))).alias("name"), F.count("*").alias("items"), F.array_sort(F.collect_set("tag")).alias("t"))
    return rows.select("product_id", "name", "items", F.array_join(F.array_except("t", F.array(F.lit("pass"), F.lit("fail"), F.lit("unverified"))), ",").alias("tags"))
