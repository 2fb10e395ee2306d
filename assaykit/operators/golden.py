"""Import of a golden data set: its files, read as tables, put into the tables of the service so that a second import adds nothing.

Ids follow from contents (an image's hash, a run's id), so a broken import is begun again from the start and rows that are
there are known. All parts are joins on these ids; nothing is looked up row by row."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.metrics import DIMENSIONS
from assaykit.operators.writes import upsert
from assaykit.session import written

LABELLED = tuple(d for d in DIMENSIONS if d != "technical")
SHIPPED = ("passed", "approved")


@dataclass
class Files:
    """outputs: image_sha, item_set (nat, final), run_id, brief_id, attempt, slot, status, outcome, verdict, evaluator_version.
    labels: image_sha, rubric_version and a boolean for each of LABELLED. planted: image_sha, source_sha, mutation, the same
    booleans. report: image_sha, version, verdict and a boolean for each of DIMENSIONS. checks: image_sha, name, passed."""

    outputs: DataFrame
    labels: DataFrame
    planted: DataFrame
    report: DataFrame
    checks: DataFrame


@dataclass
class Tables:
    """images (image_sha, origin); runs (run_id, brief_id, status, outcome, approved_id, best_id); candidates (candidate_id, run_id,
    image_sha, parent_id, attempt, slot); labels (image_sha, labeller, rubric_version, LABELLED); planted (image_sha, source_sha,
    mutation); evaluations (image_sha, candidate_id, version, verdict, n_checks, DIMENSIONS); events (run_id, seq, type, candidate_id,
    status)."""

    images: DataFrame
    runs: DataFrame
    candidates: DataFrame
    labels: DataFrame
    planted: DataFrame
    evaluations: DataFrame
    events: DataFrame

    def counts(self) -> DataFrame:
        """(name, n) of each table."""
        each = [getattr(self, f.name).agg(F.count("*").alias("n")).select(F.lit(f.name).alias("name"), "n") for f in fields(self)]
        out = each[0]
        for df in each[1:]:
            out = out.unionByName(df)
        return out


def candidate_id(run: Column, sha: Column, attempt: Column, slot: Column) -> Column:
    return F.xxhash64(run, sha, attempt, slot)


def _new(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """rows, one of each key, that known lacks."""
    return rows.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti")


def linked_runs(outputs: DataFrame, tables: Tables) -> DataFrame:
    """(run_id, link) of each run of the files: id if the tables have it, image if a candidate there shows its final image, else
    create."""
    finals = outputs.where("item_set = 'final'").dropDuplicates(["run_id"]).select("run_id", "image_sha")
    by_id = finals.join(tables.runs.select("run_id", F.lit(True).alias("known")).distinct(), "run_id", "left")
    shown = tables.candidates.select("image_sha", F.lit(True).alias("shown")).distinct()
    link = F.when(F.col("known"), "id").when(F.col("shown"), "image").otherwise("create")
    return by_id.join(shown, "image_sha", "left").select("run_id", link.alias("link"))


def settled(files: Files) -> Files:
    """files with the report's and the checks' rows that an import counts, written once: one report row of each image, and the
    checks, far more than all else, of those images only. Each table of each import reads them again otherwise."""
    told = written(files.report.where("image_sha IS NOT NULL").dropDuplicates(["image_sha"]))
    # hashed on the side of the report, so that the checks are dealt out once and never sorted
    checks = files.checks.join(told.select("image_sha").hint("shuffle_hash"), "image_sha", "left_semi")
    return replace(files, report=told, checks=written(checks.dropDuplicates(["image_sha", "name"])))


def golden_import(files: Files, tables: Tables) -> Tables:
    """The tables after the import.

    A run needs a final output; its natural one is the first candidate and the final one, if it is another image or attempt, its
    child. A run that is linked is left as it is. A created run's events can be replayed: queued, each candidate with its evaluation,
    finished. A candidate's evaluation is told only where the report is of its evaluator's version; the report itself gives each known
    image an evaluation of that version without a run. Labels of unknown images are left out; labels, planted rows and
    evaluations that are there are brought up to date. Repeated rows of a file count once; null hashes are no image."""
    outputs = files.outputs.where("image_sha IS NOT NULL AND run_id IS NOT NULL")
    planted = files.planted.where("image_sha IS NOT NULL").dropDuplicates(["image_sha"])
    seen = outputs.select("image_sha", F.lit("golden").alias("origin")).dropDuplicates(["image_sha"]).unionByName(planted.select("image_sha", F.lit("planted").alias("origin")))
    images = tables.images.unionByName(_new(seen.groupBy("image_sha").agg(F.min("origin").alias("origin")), tables.images, "image_sha").select(tables.images.columns))
    known = images.select("image_sha").distinct()

    create = linked_runs(outputs, tables).where("link = 'create'").select("run_id")
    made = outputs.join(create, "run_id", "left_semi").withColumn("candidate_id", candidate_id(*[F.col(c) for c in ("run_id", "image_sha", "attempt", "slot")]))
    first = made.where("item_set = 'nat'").dropDuplicates(["run_id"]).select("run_id", F.col("candidate_id").alias("first_id"))
    final = made.where("item_set = 'final'").dropDuplicates(["run_id"])
    approved = F.col("status").isin(*SHIPPED) & F.coalesce(F.col("verdict") == "pass", F.lit(False))
    best = F.when(approved, F.lit(None).cast("long")).otherwise(F.col("candidate_id")).alias("best_id")
    runs = final.select("run_id", "brief_id", "status", "outcome", F.when(approved, F.col("candidate_id")).alias("approved_id"), best)
    shown = made.join(first, "run_id", "left").where((F.col("item_set") == "final") | (F.col("candidate_id") == F.col("first_id"))).dropDuplicates(["run_id", "candidate_id"])
    parent = F.when(F.col("candidate_id") != F.col("first_id"), F.col("first_id"))
    candidates = shown.select("candidate_id", "run_id", "image_sha", parent.alias("parent_id"), "attempt", "slot")

    told = files.report.where("image_sha IS NOT NULL").dropDuplicates(["image_sha"])
    counted = files.checks.dropDuplicates(["image_sha", "name"]).groupBy("image_sha").agg(F.count("*").alias("n_checks"))
    report = told.join(counted, "image_sha", "left").withColumn("n_checks", F.coalesce("n_checks", F.lit(0)).cast("long"))
    version = shown.select("image_sha", "candidate_id", F.col("evaluator_version").alias("version"))
    own = report.join(version, ["image_sha", "version"])
    loose = report.join(known, "image_sha", "left_semi").withColumn("candidate_id", F.lit(None).cast("long"))
    columns = tables.evaluations.columns
    evaluations = upsert(tables.evaluations, own.select(columns).unionByName(loose.select(columns)), ["image_sha", "candidate_id", "version"])

    human = files.labels.join(known, "image_sha", "left_semi").dropDuplicates(["image_sha"]).withColumn("labeller", F.lit("human"))
    by_plan = planted.withColumns({"labeller": F.lit("planted"), "rubric_version": F.lit("planted-1")})
    columns = tables.labels.columns
    labels = upsert(tables.labels, human.select(columns).unionByName(by_plan.select(columns)), ["image_sha", "labeller"])

    at = F.when(F.col("parent_id").isNull(), 1).otherwise(2)
    finish = F.when(approved | (F.col("status") == "passed"), "passed").otherwise("needs_review")
    none, text = F.lit(None).cast("long").alias("candidate_id"), F.lit(None).cast("string").alias("status")
    evaluated = candidates.join(own.select("candidate_id").distinct(), "candidate_id", "left_semi")
    log = (
        runs.select("run_id", F.lit(0).alias("at"), F.lit(0).alias("part"), F.lit("run.status").alias("type"), none, F.lit("queued").alias("status"))
        .unionByName(candidates.select("run_id", at.alias("at"), F.lit(0).alias("part"), F.lit("candidate.created").alias("type"), "candidate_id", text))
        .unionByName(evaluated.select("run_id", at.alias("at"), F.lit(1).alias("part"), F.lit("evaluation.done").alias("type"), "candidate_id", text))
        .unionByName(final.select("run_id", F.lit(3).alias("at"), F.lit(0).alias("part"), F.lit("run.finished").alias("type"), none, finish.alias("status")))
    )
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("at", "part", "candidate_id")).cast("long")
    events = log.withColumn("seq", seq)
    return Tables(
        images,
        tables.runs.unionByName(runs.select(tables.runs.columns)),
        tables.candidates.unionByName(candidates.select(tables.candidates.columns)),
        labels,
        upsert(tables.planted, planted.select(tables.planted.columns), ["image_sha"]),
        evaluations,
        tables.events.unionByName(events.select(tables.events.columns)),
    )
