"""Run folders: what a folder of earlier results holds, and counts read back from DOT text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file names that make a folder a run, and the kinds of files.
SUMMARY = "summary.json"
DOTS = {"callgraph": "callgraph.dot", "petrinet": "petrinet_raw.dot", "reduced": "petrinet.dot", "stategraph": "stategraph.dot"}
KINDS = DOTS | {"summary": SUMMARY, "deadlock_text": "deadlock_report.txt", "deadlock_json": "deadlock_report.txt.json", "race_text": "datarace_report.txt", "race_json": "datarace_report.txt.json", "atomic_text": "atomicity_report.txt", "atomic_json": "atomicity_report.txt.json", "pointsto": "pts_report.txt"}


def files(spark: SparkSession, root: str, glob: str, depth: int) -> DataFrame:
    """(path, folder, file) of the files below ``root``, ``depth`` folders down at most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    base = root.split(":", 1)[-1].rstrip("/")
    rest = F.regexp_replace(F.element_at(F.split("path", ":"), -1), F.lit("^/*" + base.lstrip("/") + "/"), F.lit(""))
    return found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.size(F.split(rest, "/")).alias("d")).where(F.col("d") <= depth + 1).drop("d")


def runs(spark: SparkSession, root: str, depth: int = 6) -> DataFrame:
    """(folder, kinds): folders with a summary or one of the DOT files, and the kinds of files in them."""
    kind = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (v, k)])
    f = files(spark, root, "*", depth).withColumn("kind", F.try_element_at(kind, F.col("file"))).where("kind is not null")
    found = f.groupBy("folder").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return found.where(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in ("summary", *DOTS)])))


def cases(spark: SparkSession, root: str, depth: int = 8) -> DataFrame:
    """(path) of the program sources below ``root``."""
    return files(spark, root, "*.rs", depth).select("path")


def artifact(found: DataFrame, kind: str) -> DataFrame:
    """(folder, path) of one kind of file in runs."""
    if kind not in KINDS:
        raise KeyError(kind)
    return found.where(F.array_contains("kinds", kind)).select("folder", F.concat("folder", F.lit(f"/{KINDS[kind]}")).alias("path"))


def dot_counts(spark: SparkSession, root: str) -> DataFrame:
    """(path, nodes, edges) of DOT files, by their lines."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.dot").text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.groupBy("path").agg(F.count_if(F.col("value").contains("[") & ~F.col("value").contains("->")).alias("nodes"), F.count_if(F.col("value").contains("->")).alias("edges"))


def bench_table(results: DataFrame) -> DataFrame:
    """One row for each (detector, case): bug_count, callable_functions and, raw and reduced, places, transitions, states; ``results`` has (detector, case, reduced, metric columns)."""
    pick = lambda c, reduced, name: F.max(F.when(F.col("reduced") == reduced, F.col(c))).alias(name)
    return results.groupBy("detector", "case").agg(F.max("bug_count").alias("bug_count"), F.max("callable_functions").alias("callable_functions"), pick("places", False, "raw_places"), pick("transitions", False, "raw_transitions"), pick("states", False, "raw_state_classes"), pick("places", True, "reduced_places"), pick("transitions", True, "reduced_transitions"), pick("states", True, "reduced_state_classes")).orderBy("detector", "case")
