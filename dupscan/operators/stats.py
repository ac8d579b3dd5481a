"""Statistics of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.functions.text import text_lines


def by_language(files: DataFrame) -> DataFrame:
    """(language, files, bytes, lines)."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.sum(text_lines(F.col("content"))).alias("lines"))


def file_statistics(files: DataFrame) -> DataFrame:
    """One row: total_files, total_bytes, total_lines, by_language (map); zeros for no files."""
    each = by_language(files)
    entries = F.array_sort(F.collect_list(F.struct("language", "files")))
    return each.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.map_from_entries(entries).alias("by_language"))


def summary(stats) -> str:
    """Text of a file_statistics() row; languages by count, then by name."""
    counts = sorted(stats["by_language"].items(), key=lambda x: (-x[1], x[0]))
    named = ", ".join(f"{name}: {n}" for name, n in counts)
    return f"{stats['total_files']} files, {stats['total_lines']} lines, {stats['total_bytes']} bytes" + (f", Languages: {named}" if named else "")
