"""The Python interface: detect_clones(paths) and the objects that it returns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from dupscan.config import CloneType, DetectionConfig, DetectionMode
from dupscan.plans.detector import detect
from dupscan.plans.report import collected
from dupscan.sources.files import collect_files

__all__ = ["Clone", "CloneGroup", "CloneType", "DetectionConfig", "DetectionMode", "detect_clones"]


@dataclass(frozen=True)
class Clone:
    """One instance of a group; lines from 1, columns from 0."""

    file: str
    start_line: int
    end_line: int
    start_col: int
    end_col: int
    content: str

    @property
    def line_count(self) -> int:
        return self.end_line - self.start_line + 1

    def __repr__(self) -> str:
        return f"Clone(file={self.file!r}, lines={self.start_line}-{self.end_line})"


@dataclass(frozen=True)
class CloneGroup:
    clone_type: CloneType
    instances: tuple[Clone, ...]
    similarity: float
    signature: str

    @property
    def size(self) -> int:
        return len(self.instances)

    @property
    def avg_lines(self) -> float:
        return sum(c.line_count for c in self.instances) / len(self.instances) if self.instances else 0.0

    def __len__(self) -> int:
        return len(self.instances)

    def __repr__(self) -> str:
        return f"CloneGroup({self.clone_type}, size={self.size}, similarity={self.similarity:.2f})"


def detect_clones(files: Iterable[str], config: DetectionConfig | None = None, spark: SparkSession | None = None) -> list[CloneGroup]:
    """Groups of equal windows in Python files and folders, largest first; then, unless the mode is fast, pairs of similar
    files (Type-3).

    A missing path or an unreadable file raises OSError; a file that does not lex raises ValueError, as an invalid config
    does.  Larger results stay in Spark: see dupscan.plans.detector.detect."""
    config = config or DetectionConfig()
    spark = spark or SparkSession.builder.getOrCreate()
    found = detect(collect_files(spark, list(files), on_error=config.on_error), config)
    try:
        groups = collected(found)
    except Exception as e:
        if "LexError" in str(e):
            raise ValueError(str(e).splitlines()[0]) from e
        if "CollectionError" in str(e):
            raise OSError(str(e).splitlines()[0]) from e
        raise
    return [CloneGroup(CloneType(g["clone_type"]), tuple(Clone(x["path"], x["start_line"], x["end_line"], x["start_col"], x["end_col"], x["content"]) for x in g["instances"]), g["similarity"], g["sig"]) for g in groups]
