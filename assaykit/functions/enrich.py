"""Enrichment by small tables: places, seasons, policies, sizes, nearest references, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.text import dedup_ordered, fold_key


def resolve_geo(places: DataFrame, aliases: DataFrame, given: str = "given") -> DataFrame:
    """(place_id, code, mismatch) of free-text places (place_id, place, given): by aliases (key, priority, code) on the
    folded text, the lowest priority first, then the smaller code; mismatch tells that another code was given. The
    alias table is a short list."""
    keys = F.broadcast(aliases.select(fold_key(F.col("key")).alias("k"), "priority", "code"))
    rows = places.withColumn("k", fold_key(F.col("place"))).join(keys, "k", "left")
    best = rows.groupBy("place_id", given).agg(F.min_by("code", F.struct("priority", "code")).alias("code"))
    return best.select("place_id", "code", F.coalesce(F.col(given) != F.col("code"), F.lit(False)).alias("mismatch"))


#: Seasons of the months from January, by hemisphere.
NORTH = ["winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter"]
SOUTH = [*NORTH[6:], *NORTH[:6]]


def season(month: Column, climate: Column, hemisphere: Column, wet: Column) -> Column:
    """Season of a month: by hemisphere where temperate, wet or dry in the tropics, hot or mild where arid (hot is the
    hemisphere's summer half), else unspecified. wet: array of months."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), month.cast("int"))
    own = F.when(hemisphere == "S", pick(SOUTH)).otherwise(pick(NORTH))
    hot = F.when(hemisphere == "S", month.isin(10, 11, 12, 1, 2, 3)).otherwise(month.isin(4, 5, 6, 7, 8, 9))
    return (
        F.when(month.isNull(), "unspecified")
        .when(climate == "temperate", own)
        .when(climate == "tropical", F.when(F.array_contains(wet, month.cast("int")), "wet").otherwise("dry"))
        .when(climate == "arid", F.when(hot, "hot").otherwise("mild"))
        .otherwise("unspecified")
    )


def effective_season(briefs: DataFrame, countries: DataFrame, terms: DataFrame) -> DataFrame:
    """(brief_id, kind, months, season) of briefs (brief_id, country, phrase): the phrase without qualifiers is looked up
    among terms (key, priority, kind, months: a named season's months may be by hemisphere, N first); the season is that
    of its first month in the country. countries: (country, climate, hemisphere, wet). Both tables are short."""
    plain = F.trim(F.regexp_replace(F.lower("phrase"), r"\b(early|mid|late|this|next|the)\b", " "))
    rows = briefs.withColumn("key", F.regexp_replace(plain, r"\s+", " ")).join(F.broadcast(countries), "country", "left").join(F.broadcast(terms), "key", "left")
    months = F.when((F.col("kind") == "named_season") & (F.col("hemisphere") == "S"), F.transform("months", lambda m: (m + 5) % 12 + 1)).otherwise(F.col("months"))
    rows = rows.withColumn("m", months)
    best = rows.groupBy("brief_id", "climate", "hemisphere", "wet").agg(F.min_by(F.struct("kind", "m"), F.struct("priority", "kind")).alias("b"))
    at = F.get("b.m", F.lit(0))
    return best.select("brief_id", F.coalesce("b.kind", F.lit("unknown")).alias("kind"), F.array_join(F.col("b.m").cast("array<string>"), ",").alias("months"), season(at, F.col("climate"), F.col("hemisphere"), F.col("wet")).alias("season"))


def compile_policy(countries: DataFrame, default: list[str], conservative: list[str], holiday: dict[str, list[str]]) -> DataFrame:
    """(country, policy): the default rules, the country's (or the conservative ones), each holiday's, once each in order."""
    of = F.create_map(*[x for k, v in holiday.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts = F.array(F.array(*map(F.lit, default)), F.coalesce("rules", F.array(*map(F.lit, conservative))), F.flatten(F.transform("holidays", lambda h: F.coalesce(F.try_element_at(of, h), F.array().cast("array<string>")))))
    return countries.select("country", F.array_join(dedup_ordered(F.flatten(parts)), ",").alias("policy"))


#: Size classes by their upper bound in centimetres (not included), what each framing shows of a scene from
#: top to bottom in centimetres, and the share of the picture's height that the product may take.
BANDS = [(8, "tiny"), (20, "small"), (45, "medium"), (120, "large")]
FRAMES = {"close_up": (35.0, 55.0), "medium": (80.0, 120.0), "wide": (180.0, 300.0)}
HERO = (0.18, 0.6)


def scale_plan(size_cm: Column, kind: Column, requested: Column, slimness: Column, aspect: float, keywords: list[tuple[str, float]]) -> Column:
    """struct(cm, band, framing, low, high, note, area_low, area_high); null where no size is known.

    The size is size_cm if it is between 0.5 and 1000, else that of the first of keywords in kind. The framing is the
    requested one if the product can fill a share of HERO in it, or if it is the tightest that doesn't overfill it; else
    that one, with a note. low and high are the share of the height, held to HERO and 0.06 apart where both are held to
    one end. The areas are those of a box of this slimness (short by long side) in a picture of this aspect.
    """
    known = F.lit(None).cast("double")
    for word, cm in reversed(keywords):
        known = F.when(kind.contains(word), F.lit(float(cm))).otherwise(known)
    size = size_cm.cast("double")
    cm = F.when(size.between(0.5, 1000), size).otherwise(known)
    band = F.when(cm.isNotNull(), reduce(lambda acc, b: acc.when(cm < b[0], b[1]), BANDS[1:], F.when(cm < BANDS[0][0], BANDS[0][1])).otherwise("xlarge"))
    least, most = HERO
    tightest = F.when(cm / FRAMES["close_up"][1] <= most, "close_up").when(cm / FRAMES["medium"][1] <= most, "medium").when(cm.isNotNull(), "wide")
    fits = F.lit(False)
    for name, (low_cm, high_cm) in FRAMES.items():
        fits = F.when(requested == name, (cm / high_cm <= most) & (cm / low_cm >= least)).otherwise(fits)
    taken = (requested == tightest) | fits
    framing = F.when(taken, requested).otherwise(tightest)
    note = F.when(requested.isNotNull() & ~taken, F.concat(F.lit("framing "), requested, F.lit(" can't show a "), F.bround(cm).cast("bigint").cast("string"), F.lit(" cm product as the hero; used "), tightest))
    shown = lambda k: F.when(framing == "close_up", FRAMES["close_up"][k]).when(framing == "medium", FRAMES["medium"][k]).otherwise(FRAMES["wide"][k])
    held = lambda x: F.greatest(F.lit(least), F.least(x, F.lit(most)))
    low, high = held(cm / shown(1)), held(cm / shown(0))
    narrow = high - low < 0.04
    wider = F.when(narrow & (low <= least), low + 0.06).otherwise(high)
    lower = F.when(narrow & (low > least), high - 0.06).otherwise(low)
    low, high = F.round(lower, 3), F.round(wider, 3)
    slim = F.greatest(F.lit(0.05), F.least(F.lit(1.0), slimness))
    columns = [cm.alias("cm"), band.alias("band"), framing.alias("framing"), low.alias("low"), high.alias("high"), note.alias("note")]
    area = lambda x: F.round(x * x * slim / aspect, 6)
    return F.when(cm.isNotNull(), F.struct(*columns, area(low).alias("area_low"), area(high).alias("area_high")))


def json_fields(payload: Column) -> Column:
    """struct(k, version, box): fields of a JSON payload; box only if it has four whole numbers."""
    box = F.from_json(F.get_json_object(payload, "$.box"), "array<int>")
    return F.struct(F.get_json_object(payload, "$.k").cast("bigint").alias("k"), F.get_json_object(payload, "$.version").alias("version"), F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), box).alias("box"))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, refs: DataFrame, farthest: bool = False) -> DataFrame:
    """(vec_id, ref_id, distance) of the nearest (or farthest) of refs (ref_id, centre), a short list; the smaller
    ref_id on ties. Squared distance."""
    listed = refs.agg(F.array_sort(F.collect_list(F.struct("ref_id", "centre"))).alias("refs"))
    rows = vectors.join(F.broadcast(listed))
    scored = F.transform("refs", lambda r: F.struct(_squared(F.col("embedding"), r["centre"]).alias("d"), r["ref_id"].alias("ref_id")))
    best = F.array_max(F.transform(scored, lambda s: F.struct(s["d"], (-s["ref_id"]).alias("n")))) if farthest else F.array_min(scored)
    return rows.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.n")).alias("ref_id") if farthest else F.col("b.ref_id"), F.round("b.d", 4).alias("distance"))


def centroids(vectors: DataFrame, *by: str) -> DataFrame:
    """Mean vector of each group: (by, n, centre)."""
    long = vectors.select(*by, "vec_id", F.posexplode("embedding").alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return long.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))


def set_drift(reference: DataFrame, candidate: DataFrame, least: float = 0.10, mean_limit: float = 8.0, worst_limit: float = 12.0) -> DataFrame:
    """One row: how far the reference's centres (weight, centre) are from their nearest candidate centre: the weighted
    mean distance, the worst among weights of `least` or more, and whether both are within limits. Short lists."""
    listed = candidate.agg(F.collect_list("centre").alias("others"))
    d = F.array_min(F.transform("others", lambda c: F.sqrt(_squared(F.col("centre"), c))))
    rows = reference.join(F.broadcast(listed)).select("weight", d.alias("d"))
    out = rows.agg(F.round(F.sum(F.col("weight") * F.col("d")) / F.sum("weight"), 4).alias("drift"), F.round(F.max(F.when(F.col("weight") >= least, F.col("d"))), 4).alias("worst"))
    return out.withColumn("within", (F.col("drift") <= mean_limit) & (F.coalesce("worst", F.lit(0.0)) <= worst_limit))


def box_relations(boxes: DataFrame, zones: DataFrame, gap: float = 0.02, share: float = 0.05, cell: float = 0.25) -> DataFrame:
    """Pairs (box_id, zone_id) of an image whose boxes meet: centre_in, half_in (half of the box or more), near (gap on
    both axes), crowding (share of the box over `share`). Boxes are x0, y0, x1, y1 from 0 to 1; joined by grid cells."""

    def cells(df: DataFrame, pad: float) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor((F.col(a) - pad) / cell), F.floor((F.col(b) + pad) / cell))
        return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))

    a = cells(boxes, gap)
    z = cells(zones.select("image_id", "zone_id", *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")]), gap).select(
        F.col("image_id").alias("i2"), "zone_id", *[F.col(c).alias(f"z{c}") for c in ("x0", "y0", "x1", "y1", "cx", "cy")]
    )
    met = a.join(z, (F.col("image_id") == F.col("i2")) & (F.col("cx") == F.col("zcx")) & (F.col("cy") == F.col("zcy")))
    met = met.select("image_id", "box_id", "zone_id", "x0", "y0", "x1", "y1", "zx0", "zy0", "zx1", "zy1").distinct()
    w = F.greatest(F.lit(0.0), F.least("x1", "zx1") - F.greatest("x0", "zx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "zy1") - F.greatest("y0", "zy0"))
    part = F.try_divide(w * h, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    gx, gy = F.greatest("x0", "zx0") - F.least("x1", "zx1"), F.greatest("y0", "zy0") - F.least("y1", "zy1")
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("zx0"), F.col("zx1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("zy0"), F.col("zy1"))
    out = met.select("image_id", "box_id", "zone_id", inside.alias("centre_in"), (part >= 0.5).alias("half_in"), ((gx <= gap) & (gy <= gap)).alias("near"), (part > share).alias("crowding"))
    return out.where("near OR half_in OR crowding")


def box_from_thousandths(box: Column) -> Column:
    """[ymin, xmin, ymax, xmax] of 0 to 1000 as x0, y0, x1, y1 of 0 to 1."""
    at = lambda i: F.get(box, F.lit(i)) / 1000.0
    return F.struct(at(1).alias("x0"), at(0).alias("y0"), at(3).alias("x1"), at(2).alias("y1"))


def box_from_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct((x / width).alias("x0"), (y / height).alias("y0"), ((x + w) / width).alias("x1"), ((y + h) / height).alias("y1"))


def primary_box(boxes: DataFrame) -> DataFrame:
    """Of each image the box to work with: a matching one before others, then the largest, then the smaller id."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    w = Window.partitionBy("image_id").orderBy(F.desc("matches"), F.desc(area), F.asc("box_id"))
    return boxes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("image_id", "box_id")


def reading_order(words: DataFrame) -> DataFrame:
    """(image_id, text): words (image_id, word_id, text, x, y, h; centres and height) put into lines, a word joining the
    line of the word before it if their centres are half a height apart or less, lines from the top, words from the left."""
    w = Window.partitionBy("image_id").orderBy("y", "x", "word_id")
    new = (F.col("y") - F.lag("y").over(w) > F.lag("h").over(w) / 2).cast("int")
    rows = words.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "word_id", "text"))), lambda s: s["text"]), " ").alias("text"))


def accuracy(cases: DataFrame) -> DataFrame:
    """One row: cases and those whose found equals expected (two nulls are equal)."""
    return cases.agg(F.count("*").alias("cases"), F.count_if(F.col("found").eqNullSafe(F.col("expected"))).alias("exact"))
