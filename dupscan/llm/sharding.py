"""Sharding by balanced label propagation.

Documents of one group (equal texts) are linked, as a clique that is never spelled out: the neighbours a document has in
a shard are its group's rows there, one aggregated count.

* Start: every document draws a shard by hash, and each group takes the shard that most of its rows drew; in a clique one
  round of propagation without quotas ends there.
* Quotas: groups are laid on a line in the order of their shards, large ones first, and the line is cut into equal shares,
  one for each shard.  So a cut falls into at most one group, and at most shards - 1 groups are split besides those that
  are larger than a share, however many rows are linked.
* Rounds: the counts are joined to the documents; a document of a split group wants to move to the shard that holds most
  of its group.  A shard takes no more than its room, dealt over buckets so that no task ranks all candidates.  Rounds go on
  until none moves a row: each move raises the sum of the squared counts of groups in shards, so they end.

Documents without links fill the shards up at the end; they cut no edge wherever they are.  Law `rows`: shard sizes differ
by at most one row.  Slots are gapless from 0 in each shard.

Nulls and ties: a null text has size 16, the checksum of no bytes, and no links; repeated rows are rows of their own; a
null id is placed like any; ties are broken by hashes; fewer rows than shards leave shards empty; no rows give no rows;
other columns are ignored; a text of any length is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscan.llm.shared import cut, parts


def _spread(df: DataFrame, by: list[str], order: list, buckets: int, what: str, weight: str | None = None) -> DataFrame:
    """df with a number in column `what`, gapless within by: the sum of the weights (1) of the rows before.  Rows are
    ranked within buckets, and the buckets' offsets are added."""
    w = F.col(weight) if weight else F.lit(1)
    small = df.groupBy(*by, "bucket").agg(F.sum(w).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if by in ([], ["shard"]):
        offsets = F.broadcast(offsets)  # shards x buckets rows at most
    rank = F.coalesce(F.sum(w).over(Window.partitionBy(*by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_rank", rank).join(offsets, [*by, "bucket"]).withColumn(what, (F.col("_before") + F.col("_rank")).cast("long")).drop("_rank", "_before")


def _shard_at(ends: list[int], at: Column) -> Column:
    return F.aggregate(F.array(*(F.lit(e).cast("long") for e in ends)), F.lit(0), lambda n, e: n + (e <= at).cast("int"))


def _sums(numbers: list[int]) -> list[int]:
    out, total = [], 0
    for n in numbers:
        total += n
        out.append(total)
    return out


def start(linked: DataFrame, shards: int, room: list[int], total: int, buckets: int) -> DataFrame:
    """linked with a column shard: whole groups by the label that most of their rows drew, under equal quotas."""
    drawn = linked.groupBy("g", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int").alias("drawn")).agg(F.count("*").alias("n"))
    groups = drawn.groupBy("g").agg(F.sum("n").alias("n"), F.max_by("drawn", F.struct("n", F.xxhash64("g", "drawn"))).alias("label"))
    # a bucket is a stretch of the line: label, size class, hash; so ranks within buckets are places in the order
    size = F.greatest(F.lit(0), F.lit(62) - F.floor(F.log2("n"))).cast("int")
    fine = max(1, buckets // shards)
    groups = groups.withColumn("bucket", (F.col("label") * 64 + size) * fine + F.pmod(F.xxhash64("g"), F.lit(fine)).cast("int"))
    groups = cut(_spread(groups.select("g", "n", "bucket"), [], [F.desc("n"), "g"], buckets, "place", "n").select("g", "place"))
    rows = _spread(linked.withColumn("bucket", F.pmod(F.xxhash64("id", "crc", F.lit(3)), F.lit(buckets)).cast("int")), ["g"], ["id", "crc"], buckets, "own")
    count = linked.count()
    share = _sums([r * count // max(total, 1) for r in room])
    ends = [e + min(k + 1, count - share[-1]) for k, e in enumerate(share)]  # what rounding left over goes to the first ones
    out = rows.join(groups, "g").withColumn("shard", F.least(F.lit(shards - 1), _shard_at(ends, F.col("place") + F.col("own"))))
    return cut(out.select("id", "size", "crc", "g", F.pmod(F.xxhash64("id", "g", F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"), "shard"), groups)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for each row of docs."""
    spark = docs.sparkSession
    buckets = min(2048, max(64, parts(spark)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("g"))
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64("id", "g", F.lit(1)), F.lit(buckets)).cast("int")))
    total = rows.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]

    groups = rows.where("g is not null").groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    alone = rows.join(groups, "g", "left_anti")
    linked = start(rows.join(groups, "g", "left_semi"), shards, room, total, buckets)
    load = dict(linked.groupBy("shard").count().collect())
    while True:
        open_ = [s for s in range(shards) if load.get(s, 0) < room[s]]
        held = linked.groupBy("g", "shard").agg(F.count("*").alias("n"))
        # of equal counts an open shard beats a full one, else rows that cannot come together there stay apart
        tie = F.when(F.col("shard").isin(open_), F.xxhash64("g", "shard")).otherwise(F.lit(-(1 << 63)))
        held = held.withColumn("rank", F.struct("n", tie.alias("tie")))
        held = held.join(held.groupBy("g").agg(F.count("*").alias("places")).where("places > 1").select("g"), "g", "left_semi")  # split groups only
        best = held.where(F.col("shard").isin(open_)).groupBy("g").agg(F.max_by(F.struct("shard", "rank"), "rank").alias("to"))
        wants = linked.join(best, "g").join(held.select("g", "shard", F.col("rank").alias("own")), ["g", "shard"])
        wants = wants.where((F.col("to.shard") != F.col("shard")) & (F.col("to.rank") > F.col("own")))
        wants = cut(wants.select("id", "size", "crc", "g", "bucket", "shard", F.col("to.shard").alias("to"), F.col("to.rank.n").alias("gain")))
        asked = wants.groupBy("to", "bucket").count().collect()
        if not asked:
            break
        asked.sort()
        quota, taken, seen, sums = [], {}, {}, {}
        for to, _, n in asked:
            sums[to] = sums.get(to, 0) + n
        for to, b, n in asked:  # each bucket's share of the room, rounded so that the shares add up to it
            seen[to] = seen.get(to, 0) + n
            share = min(sums[to], room[to] - load.get(to, 0)) * seen[to] // sums[to] - taken.get(to, 0)
            taken[to] = taken.get(to, 0) + share
            quota.append((to, b, share))
        quota = F.broadcast(spark.createDataFrame(quota, "to int, bucket int, quota long"))  # shards x buckets rows at most
        order = Window.partitionBy("to", "bucket").orderBy(F.desc("gain"), "g", "id", "crc")
        ranked = wants.withColumn("r", F.row_number().over(order)).join(quota, ["to", "bucket"])
        moved = ranked.select("id", "size", "crc", "g", "bucket", F.when(F.col("r") <= F.col("quota"), F.col("to")).otherwise(F.col("shard")).alias("shard"), (F.col("r") <= F.col("quota")).alias("went"))
        moved = cut(moved)
        if not moved.where("went").limit(1).count():
            break
        # the rows that want nothing stay; whole groups and shards decide that, not single rows
        stay = linked.join(best, "g", "left").join(held.select("g", "shard", F.col("rank").alias("own")), ["g", "shard"], "left")
        stay = stay.where(F.col("to").isNull() | (F.col("to.shard") == F.col("shard")) | (F.col("to.rank") <= F.col("own"))).select("id", "size", "crc", "g", "bucket", "shard")
        linked = cut(stay.union(moved.drop("went")), linked, wants, moved)
        load = dict(linked.groupBy("shard").count().collect())

    ends = _sums([room[s] - load.get(s, 0) for s in range(shards)])
    filled = _spread(alone, [], ["id", "crc"], buckets, "at").withColumn("shard", _shard_at(ends, F.col("at")))
    placed = cut(linked.select("id", "size", "crc", "bucket", "shard").union(filled.select("id", "size", "crc", "bucket", "shard")), rows, linked)
    out = _spread(placed, ["shard"], ["id", "crc"], buckets, "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def cut_edges(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: groups of two rows or more, split_groups, edges, cut_edges (pairs of linked rows in different shards);
    ids must not repeat."""
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.xxhash64(text_col).alias("g")).join(placed.select(id_col, "shard"), id_col)
    held = rows.groupBy("g", "shard").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    each = held.groupBy("g").agg(F.sum("n").alias("m"), F.count("*").alias("places"), F.sum(pairs(F.col("n"))).alias("within")).where("m > 1")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(F.count("*").alias("groups"), whole((F.col("places") > 1).cast("int")).alias("split_groups"), whole(pairs(F.col("m"))).alias("edges"), whole(pairs(F.col("m")) - F.col("within")).alias("cut_edges"))
