"""Reflection documents from files, with the reasons why some cannot be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reflections(spark: SparkSession, path: str, major: str = "2") -> DataFrame:
    """(document_id, project_slug, received_at, body, error_code) of every file under a path, one document each.

    The project is the document's own name, the time that of the file. error_code: parse_error for text that is no JSON object,
    unsupported_version for another major schema version; null for usable documents. A missing path raises an error.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_modification_time").alias("received_at"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    parsed = F.try_parse_json(F.regexp_replace("body", "^﻿+", ""))
    version = F.try_variant_get(parsed, "$.schema_version", "string")
    error = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "parse_error").when(~F.coalesce(version, F.lit("")).startswith(f"{major}."), "unsupported_version")
    return files.select(F.xxhash64("file").alias("document_id"), F.try_variant_get(parsed, "$.project.name", "string").alias("project_slug"), "received_at", "body", error.alias("error_code"))
