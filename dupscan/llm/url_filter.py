"""URL filters as a temporal list join, in DataFrame functions only.

A list has dated entries (pattern, effective, action): from that day on the action holds for hosts that are the pattern or
end in '.' and the pattern.  Entries become validity intervals, each up to the pattern's next entry; the action `none`
ends a listing.  A capture is evaluated as of its fetch day: of the intervals open then, the one of the longest pattern
decides.

Captures are reduced to distinct (host, day) pairs before anything is exploded or joined, so a host with a third of all
captures is at most one row a day there; the verdicts join back to all captures by an equi-join that AQE splits.  The
range condition stands inside an equi-join on the pattern.

Nulls and ties: a null or unparsable url has the host '' and matches nothing, as does a null day; entries with a null
pattern or day are ignored, an action outside of `ACTIONS` is an error of the list and counts as `none`; entries of one
pattern and day count as their strictest action; repeated captures stay repeated; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From the strictest on.
ACTIONS = ("block", "allow", "none")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and what is left as labels fall off its front."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): until is exclusive, null while the entry is the last of its pattern."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")), F.lit(0))
    strict = entries.where(F.col("pattern").isNotNull() & F.col("effective").isNotNull()).select(F.lower("pattern").alias("pattern"), F.col("effective").cast("date").alias("since"), F.when(rank == 0, len(ACTIONS)).otherwise(rank).alias("rank"))
    one = strict.groupBy("pattern", "since").agg(F.min("rank").alias("rank"))
    after = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", after.alias("until"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """captures with host, pattern (null: none matched), action ('block', 'allow' or 'none') and blocked."""
    made = ("host", "pattern", "action", "blocked")
    rows = captures.drop(*made).withColumn("host", host_of(F.col(url_col)))
    asked = rows.select("host", F.col(day_col).alias("_day")).where("host <> '' and _day is not null").distinct()
    probes = asked.select("host", "_day", F.explode(suffixes(F.col("host"))).alias("pattern"))
    valid = intervals(entries).where("action <> 'none'")
    hit = probes.join(valid, "pattern").where((F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    best = hit.groupBy("host", "_day").agg(F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("b")).select("host", "_day", "b.pattern", "b.action")
    out = rows.withColumn("_day", F.col(day_col)).join(best, ["host", "_day"], "left").drop("_day")
    return out.withColumn("action", F.coalesce("action", F.lit("none"))).withColumn("blocked", F.col("action") == "block")
