"""Source files: path predicates as columns, listing on the driver, contents read by the executors."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language by extension; fixed values.
LANGUAGES = {
    "py": "python",
    "pyi": "python",
    "pyw": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "rs": "rust",
    "java": "java",
    "go": "go",
    "c": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "h": "header",
    "hpp": "header",
}
#: Names that are not entered or read below a given root; fixed values.
SKIPPED = (
    "node_modules", "target", "build", "dist", ".git", ".svn", ".hg", "__pycache__", ".pytest_cache",
    ".mypy_cache", "venv", "env", ".venv", ".env", "vendor", ".idea", ".vscode",
)
FILES = "file_id long, path string, content string, language string"


class CollectionError(OSError):
    """A path is missing, or a file is not readable text."""


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, null without one; a leading dot begins no extension."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), found)


def included(path: Column, extensions: Iterable[str]) -> Column:
    wanted = list(extensions)
    return F.coalesce(extension(path).isin(wanted), F.lit(False)) if wanted else F.lit(True)


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def is_skipped(path: Column) -> Column:
    return file_name(path).isin(*SKIPPED)


def reachable(path: Column) -> Column:
    """No component of a path below its root is hidden or on the skip list."""
    return ~F.exists(F.split(path, "/"), lambda c: c.startswith(".") | c.isin(*SKIPPED))


def with_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("language") == language)


def list_paths(paths: Iterable[str], extensions: Iterable[str] = ("py",)) -> list[str]:
    """Files of the given files and folders, each once, in order; folders are walked in name order, links not in circles."""
    wanted, out, seen = set(extensions), dict(), set()

    def take(path: str) -> None:
        base = os.path.basename(path)
        if not wanted or (os.path.splitext(base)[1][1:] in wanted and os.path.splitext(base)[1]):
            out.setdefault(path)

    def walk(folder: str) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if name.startswith(".") or name in SKIPPED:
                continue
            walk(path) if os.path.isdir(path) else take(path)

    for path in map(os.fspath, paths):
        if os.path.isfile(path):
            take(path)
        elif os.path.isdir(path):
            walk(path)
        else:
            raise CollectionError(f"no such file or folder: {path}")
    return list(out)


def collect_files(spark: SparkSession, paths: Iterable[str], extensions: Iterable[str] = ("py",), on_error: str = "fail") -> DataFrame:
    """FILES and error: the files of paths that every machine can open.

    Spark's own file sources leave out names that begin with an underscore, so names are listed here and contents are
    read in the tasks.  For stores that only Spark reads use `collect_table` over spark.read."""
    listed = list_paths(paths, extensions)
    names = spark.createDataFrame(list(enumerate(listed)), "file_id long, path string")
    if len(listed) > 64:
        names = names.repartition(min(len(listed) // 16, 1024))
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("content", pa.string()), ("error", pa.string())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for key, path in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                text = error = None
                try:
                    with open(path, encoding="utf-8", newline="") as f:
                        text = f.read()
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{path}: {e}"
                    if on_error == "fail":
                        raise CollectionError(error) from e
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, path, text, error), schema, strict=True)], schema=schema)

    return names.mapInArrow(read, "file_id long, path string, content string, error string").withColumn("language", language_of(F.col("path"))).select("file_id", "path", "content", "language", "error")


def collect_table(table: DataFrame, id_col: str, text_col: str, language: str | None = None, path_col: str | None = None) -> DataFrame:
    """FILES from any table with a text column; null texts are empty."""
    path = F.col(path_col) if path_col else F.col(id_col).cast("string")
    return table.select(F.col(id_col).cast("long").alias("file_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("content"), (F.lit(language) if language else language_of(path)).alias("language"))
