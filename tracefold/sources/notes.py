"""Readers of Markdown notes and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.notes import link_targets, normalize_link


def read_wiki_docs(spark: SparkSession, path: str, first_seen: DataFrame | None = None) -> DataFrame:
    """Notes under a folder, one row per file, without ``_tmp`` files.

    A file system keeps no creation time; a snapshot (path, created_at) of earlier reads supplies it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    docs = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(wiki/.*)$", 1).alias("path"), F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ).where((F.col("path") != "") & ~F.element_at(F.split("path", "/"), -1).startswith("_tmp"))
    if first_seen is None:
        return docs.withColumn("created_at", F.col("modified_at"))
    seen = docs.join(first_seen.select("path", "created_at"), "path", "left")
    return seen.withColumn("created_at", F.coalesce("created_at", "modified_at"))


def extract_links(docs: DataFrame, targets: Column | None = None) -> DataFrame:
    """Resolved note-to-note edges between known notes, one per (source, target).

    ``targets`` is an array expression over the note; by default the note's Markdown links. A target
    resolves when it names a known note's path without extension, with or without the leading folder.
    """
    found = link_targets(F.col("content")) if targets is None else targets
    edges = docs.select(F.col("path").alias("source_path"), "modified_at", F.explode(F.array_distinct(found)).alias("target"))
    known = docs.select(F.col("path").alias("target_path"), normalize_link(F.col("path")).alias("full"))
    names = known.select("target_path", F.explode(F.array_distinct(F.array("full", F.regexp_replace("full", "(?i)^wiki/", "")))).alias("target"))
    resolved = edges.join(names, "target").select("source_path", "target_path", F.col("modified_at").alias("source_modified_at"))
    return resolved.dropDuplicates(["source_path", "target_path"])
