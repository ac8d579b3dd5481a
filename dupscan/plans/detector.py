"""Detection as one lazy plan: files -> tokens -> windows -> repeated -> located -> groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupscan.config import DetectionConfig, DetectionMode
from dupscan.functions.python_lexer import lex_errors
from dupscan.functions.text import text_lines
from dupscan.operators import clones, similarity


@dataclass(frozen=True)
class Detection:
    """Lazy relations of one detection."""

    files: DataFrame
    config: DetectionConfig

    @cached_property
    def tokens(self) -> DataFrame:
        return clones.tokens_of(self.files, self.config.on_error)

    @cached_property
    def kept(self) -> DataFrame:
        c = self.config
        return clones.kept_tokens(self.tokens, c.mask, c.ignore_comments, c.ignore_whitespace)

    @cached_property
    def arrays(self) -> DataFrame:
        return clones.arrays(self.kept)

    @cached_property
    def windows(self) -> DataFrame:
        """Repeated windows with true positions, min_lines not yet applied."""
        return clones.located(clones.repeated(clones.windows(self.arrays, self.config.min_tokens, both=True)), self.kept, self.config.min_tokens)

    @cached_property
    def rows(self) -> DataFrame:
        return clones.with_min_lines(self.windows, self.config.min_lines)

    @cached_property
    def groups(self) -> DataFrame:
        """Type-1 and Type-2 groups of equal windows."""
        return clones.groups(self.rows)

    @cached_property
    def instances(self) -> DataFrame:
        return clones.instances(self.rows, self.files)

    @cached_property
    def regions(self) -> DataFrame:
        """Maximal regions between neighbours of a signature; min_lines applies to what `file_b` shows of the region."""
        rows = self.windows.select("file_id", "pos", "sig")
        if self.config.whole_units:
            rows = clones.within_units(rows, self.kept, self.config.min_tokens)
        runs = clones.regions(rows, self.config.min_tokens, 1 if self.config.whole_units else None)
        ends = self.kept.select(F.col("file_id").alias("file_b"), F.col("k").alias("_k"), "start_line", "end_line")
        first = ends.select("file_b", F.col("_k").alias("pos_b"), "start_line")
        last = ends.select("file_b", F.col("_k").alias("_last"), "end_line")
        found = runs.withColumn("_last", F.col("pos_b") + F.col("length") - 1).join(first, ["file_b", "pos_b"]).join(last, ["file_b", "_last"])
        return found.where(F.col("end_line") - F.col("start_line") + 1 >= self.config.min_lines).drop("_last")

    @cached_property
    def similar(self) -> DataFrame:
        """Type-3: files that share a window and whose token sets are similar enough, but not equal token sequences.  Only
        the first of files with equal ones is compared; the others have its links."""
        found = similarity.similar_files(self.windows, self.arrays, self.config.similarity_threshold)
        member = similarity.membership(self.arrays)
        a, b = (member.select(F.col("first").alias(f"file_{x}"), F.col("file_id").alias(x)) for x in "ab")
        both = found.join(a, "file_a").join(b, "file_b")
        return both.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"), "similarity", F.lit("Type-3").alias("clone_type"))

    @cached_property
    def similar_instances(self) -> DataFrame:
        """The two files of each similar pair, whole, as the rows of a report."""
        pairs = self.similar.withColumn("sig", F.md5(F.concat_ws("|", "file_a", "file_b")))
        ends = pairs.select("sig", "similarity", "clone_type", F.explode(F.array("file_a", "file_b")).alias("file_id"))
        lines = F.greatest(F.lit(1), text_lines(F.col("content"))).cast("int")
        rows = ends.join(self.files.select("file_id", "path", "content"), "file_id").withColumn("end_line", lines)
        mean = F.avg("end_line").over(Window.partitionBy("sig"))  # two rows
        last = F.char_length(F.substring_index(F.regexp_replace("content", "\n$", ""), "\n", -1)).cast("int")
        return rows.select("sig", "path", F.lit(1).alias("start_line"), F.lit(0).alias("start_col"), "end_line", last.alias("end_col"), "content", "clone_type", "similarity", F.lit(2).cast("long").alias("size"), mean.alias("avg_lines"))

    @cached_property
    def errors(self) -> DataFrame:
        """(file_id, path, error): files that could not be read, and those whose tokens could not be made."""
        known = self.files if "error" in self.files.columns else self.files.withColumn("error", F.lit(None).cast("string"))
        unread = known.where("error is not null").select("file_id", "path", "error")
        return unread.union(lex_errors(known.where("error is null")).select("file_id", "path", "error"))

    @property
    def mode(self) -> DetectionMode:
        return self.config.mode


def token_based(files: DataFrame, config: DetectionConfig) -> Detection:
    return Detection(files, config)


#: Detectors by name; each maps (files, config) to a Detection.
DETECTORS: dict[str, Callable[[DataFrame, DetectionConfig], Detection]] = {"Token-Based Detector": token_based}
DESCRIPTION = {"Token-Based Detector": "Finds equal and renamed passages by fingerprints of token windows"}


def register_detector(name: str, detector: Callable[[DataFrame, DetectionConfig], Detection], description: str = "") -> None:
    DETECTORS[name], DESCRIPTION[name] = detector, description


def detect(files: DataFrame, config: DetectionConfig | None = None, detector: str = "Token-Based Detector") -> Detection:
    return DETECTORS[detector](files, config or DetectionConfig())


def total_clones(groups: DataFrame) -> DataFrame:
    """One row: groups, instances."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("instances"))
