"""Similarity of files that share a window: Jaccard over token sets, Levenshtein over normalised text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from math import log
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupscan.functions import text as T

#: Metrics by name; each maps two token-array columns to a similarity in 0..1.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard": T.jaccard,
    "levenshtein": lambda a, b: T.levenshtein_similarity(T.normalized_string(a), T.normalized_string(b)),
}


def register_metric(name: str, metric: Callable[[Column, Column], Column]) -> None:
    METRICS[name] = metric


def membership(token_arrays: DataFrame) -> DataFrame:
    """(file_id, first): the first of the files with the same token sequence."""
    prints = token_arrays.select("file_id", T.fingerprint(F.col("norm")).alias("_p"))
    return prints.join(prints.groupBy("_p").agg(F.min("file_id").alias("first")), "_p").select("file_id", "first")


def representatives(token_arrays: DataFrame) -> DataFrame:
    """The rows of token_arrays of the first of the files with the same token sequence."""
    first = token_arrays.groupBy(T.fingerprint(F.col("norm")).alias("_p")).agg(F.min("file_id").alias("file_id")).select("file_id")
    return token_arrays.join(first, "file_id", "left_semi")


def sharing_pairs(rows: DataFrame, sizes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(file_a, file_b), file_a < file_b: the pairs of files of `sizes` (file_id, n: distinct tokens) that share a window
    and whose sizes let them be similar.  Of windows that the same files hold (known by their number and two sums of
    hashes) only one makes pairs."""
    files = rows.select("sig", "file_id").distinct().join(sizes, "file_id")
    total = lambda seed: F.sum(F.xxhash64("file_id", F.lit(seed)).cast("decimal(38,0)"))
    sets = files.groupBy("sig").agg(F.count("*").alias("m"), total(1).alias("h1"), total(2).alias("h2")).where("m > 1")
    own = files.join(sets.groupBy("m", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig"), "sig")
    a, b = (own.select("sig", F.col("file_id").alias(f"file_{x}"), F.col("n").alias(f"_n{x}")) for x in "ab")
    return a.join(b, "sig").where((F.col("file_a") < F.col("file_b")) & (F.least("_na", "_nb") >= F.lit(threshold) * F.greatest("_na", "_nb"))).select("file_a", "file_b").distinct()


def similar_files(rows: DataFrame, token_arrays: DataFrame, threshold: float) -> DataFrame:
    """(file_a, file_b, similarity): links between representatives that share a window and reach the threshold."""
    arrays = representatives(token_arrays)
    sizes = arrays.select("file_id", F.size(F.array_distinct("norm")).alias("n"))
    return similar_pairs(sharing_pairs(rows, sizes, threshold), arrays, "jaccard", threshold)


def similar_pairs(pairs: DataFrame, token_arrays: DataFrame, metric: str = "jaccard", threshold: float = 0.0) -> DataFrame:
    """(file_a, file_b, similarity) of the pairs that reach the threshold."""
    a = token_arrays.select(F.col("file_id").alias("file_a"), F.col("norm").alias("_a"))
    b = token_arrays.select(F.col("file_id").alias("file_b"), F.col("norm").alias("_b"))
    both = pairs.join(a, "file_a").join(b, "file_b")
    return both.select("file_a", "file_b", METRICS[metric](F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= threshold)


#: Files of one list that a task compares with so many others at once.
BLOCK = 512
#: Common items that a task counts at once.
COLUMNS = 4096


def near_files(files: DataFrame, width: int, threshold: float, edits: bool = False) -> DataFrame:
    """(file_a, file_b, similarity), file_a < file_b: similar_files() of text files (file_id, content), from anchors in
    place of all windows; with edits the edit similarity, in characters, of the same pairs.

    Files that share a window share its anchor, so lists of files by anchor hold all pairs.  Of anchors that the same
    files hold one makes a list, and a list whose files all have one longer list of theirs in common makes none.  A list
    of more than BLOCK files goes into blocks by bands of set size: a pair that may be similar is of one band or of two
    neighbouring ones.  A task has the whole texts of two blocks, and a pair counts at the least of its common lists
    only, if a window is shared: so each pair is made once, and none is lost."""
    texts, cores = files.select("file_id", "content").where("file_id is not null"), files.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # lexing is the costly part
        texts = texts.repartition(4 * cores)
    norm = texts.select("file_id", T.solid_tokens(F.lower("content")).alias("norm"))
    hashed = norm.select("file_id", F.array_join("norm", "\n").alias("text"), F.transform("norm", lambda t: F.xxhash64(t)).alias("hashes"))
    prints = hashed.mapInArrow(_anchored(width), "file_id long, p binary, n long, anchors array<long>")
    firsts = prints.groupBy("p").agg(F.min(F.struct("file_id", "n", "anchors")).alias("f")).select("f.*")
    posts = firsts.select("file_id", "n", F.explode("anchors").alias("key")).repartition("key")  # one exchange, read twice
    mixed = lambda seed: F.bit_xor(F.xxhash64("file_id", F.lit(seed)))
    lists = posts.groupBy("key").agg(F.count("*").alias("m"), mixed(1).alias("h1"), mixed(2).alias("h2"), F.min("n").alias("least")).where("m > 1 and least > 0")
    lists = lists.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "m")
    member = posts.join(lists, "key").select("key", "m", "file_id", "n")
    longest = member.groupBy("file_id").agg(F.max(F.struct("m", "key"))["key"].alias("top"))
    tops = member.join(longest, "file_id").groupBy("key").agg(F.min("top").alias("t1"), F.max("top").alias("t2"))
    member = member.join(tops.where("t1 <> t2 or t1 = key").select("key"), "key", "left_semi")

    step = max(1e-4, -log(threshold) * 1.0001) if threshold > 0 else float("inf")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long")
    held = member.groupBy("file_id").agg(F.collect_list(F.struct("key", "m", F.when(F.col("m") > BLOCK, band).otherwise(F.lit(0)).alias("band"))).alias("held"))
    held = held.select("file_id", F.explode("held").alias("h"), F.array_sort("held.key").alias("keys")).select("file_id", "h.*", "keys")
    # lexed again, as texts are large and only compressed ones are shuffled
    source = norm.select("file_id", F.array_join("norm", "\n").alias("text"), F.size("norm").alias("size")).mapInArrow(_packed(width), "file_id long, data binary")
    held = held.join(source, "file_id")
    small = held.where(F.col("m") <= BLOCK).select("key", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("spot"), "file_id", "keys", "data")
    sizes = member.where(F.col("m") > BLOCK).groupBy("key", band.alias("band")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    order = Window.partitionBy("key").orderBy("band")  # a row for each band of sizes
    beside = lambda shift, name: F.when(shift("band").over(order) == F.col("band") + (1 if shift is F.lead else -1), shift("blocks").over(order)).otherwise(0).alias(name)
    sizes = sizes.select("key", "band", "blocks", beside(F.lead, "above"), beside(F.lag, "below"))
    big = held.where(F.col("m") > BLOCK).join(sizes, ["key", "band"]).withColumn("x", F.pmod(F.xxhash64("file_id"), F.col("blocks")))

    def cells(count: str, cell: Callable[[Column], Column]) -> Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), cell)).otherwise(F.array().cast("array<long>"))

    def cell(low: Column, x: Column, up: int, y: Column) -> Column:
        return F.shiftleft(low, 34) + F.lit(up << 33) + F.shiftleft(x, 16) + y

    own = cells("blocks", lambda y: cell(F.col("band"), F.least("x", y), 0, F.greatest("x", y)))
    up = cells("above", lambda y: cell(F.col("band"), F.col("x"), 1, y))
    down = cells("below", lambda y: cell(F.col("band") - 1, y, 1, F.col("x")))
    big = big.select("key", F.explode(F.concat(own, up, down)).alias("cell"), (F.shiftleft("band", 16) + F.col("x")).alias("spot"), "file_id", "keys", "data")
    rows = small.union(big).withColumn("deal", F.pmod(F.xxhash64("key", "cell"), F.lit(8 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return rows.groupBy("deal").applyInArrow(_compared(width, threshold, edits), "file_a long, file_b long, similarity double")


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many items each array of a has in common with each of b; an item stands once in an array."""
    sides = [(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)) for x in (a, b)]
    common = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(a), len(b)), np.int64)
    placed = []
    for row, item in sides:
        at = np.searchsorted(common, item)
        at[at == len(common)] = 0
        own = common[at] == item if len(common) else np.zeros(len(item), bool)
        row, at = row[own], at[own]
        order = np.argsort(at, kind="stable")
        placed.append((row[order], at[order]))
    for begin in range(0, len(common), COLUMNS):
        width, made = min(COLUMNS, len(common) - begin), []
        for (row, at), n in zip(placed, out.shape, strict=True):
            i, j = np.searchsorted(at, [begin, begin + width])
            table = np.zeros((n, width), np.float32)
            table[row[i:j], at[i:j] - begin] = 1
            made.append(table)
        out += (made[0] @ made[1].T).astype(np.int64)
    return out


def _anchored(width: int):
    """For each file of at least width tokens, of which none holds a line break: digest of its tokens, number of distinct
    ones, and anchors of its windows."""
    schema = pa.schema([("file_id", pa.int64()), ("p", pa.binary()), ("n", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                part = part.filter(pc.greater_equal(part.column(2).value_lengths().fill_null(0), width))
                if len(part):
                    texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                    p, n = [md5(t, usedforsecurity=False).digest() for t in texts], [len({*t.split(b"\n")}) for t in texts]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.binary()), pa.array(n, pa.int64()), T.anchors(part.column(2), width)], schema=schema)

    return run


def _packed(width: int):
    """The tokens of each file of at least width tokens as compressed bytes."""
    schema = pa.schema([("file_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(pc.greater_equal(part.column(2), width))
            if len(part):
                data = [compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], schema=schema)

    return run


def _compared(width: int, threshold: float, edits: bool):
    schema = pa.schema([("file_a", pa.int64()), ("file_b", pa.int64()), ("similarity", pa.float64())])

    def block(key: int, cell: int, ids: np.ndarray, spots: np.ndarray, keys: list[np.ndarray], data: list[bytes]) -> Iterator[tuple[int, int, float]]:
        within = not cell >> 33 & 1 and cell >> 16 & 0xFFFF == cell & 0xFFFF
        if not within and spots[0] == spots[-1]:
            return
        code: dict[str, int] = {}
        texts = [decompress(d).decode("utf-8", "surrogatepass").split("\n") for d in data]
        seqs = [np.fromiter((code.setdefault(t, len(code)) for t in words), np.int64, len(words)) for words in texts]
        sets = [np.unique(s) for s in seqs]
        left = np.arange(len(ids)) if within else np.flatnonzero(spots == spots[0])
        right = left if within else np.flatnonzero(spots == spots[-1])
        both = shared([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(s) for s in sets])
        score = both / (sizes[left][:, None] + sizes[right][None, :] - both)
        good = score >= threshold
        if within:
            good &= ids[left][:, None] < ids[right][None, :]
        names: dict[bytes, int] = {}
        # not those that meet in an earlier list; those that share a window
        for items, wanted in ((lambda k: keys[k][keys[k] < key], False), (lambda k: np.unique(windows(seqs[k], names)), True)):
            i, j = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            if not len(i):
                return
            made = {k: items(k) for k in {*left[i].tolist(), *right[j].tolist()}}
            met = shared([made[k] for k in left[i].tolist()], [made[k] for k in right[j].tolist()]) > 0
            good[np.ix_(i, j)] &= met == wanted
        plain = {}
        for i, j in zip(*np.nonzero(good), strict=True):
            x, y = left[i], right[j]
            value = float(score[i, j])
            if edits:
                for k in (x, y):
                    if k not in plain:
                        plain[k] = " ".join(texts[k])
                value = 1 - T.edit_distance(plain[x], plain[y]) / max(len(plain[x]), len(plain[y]))
            yield min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y])), value

    def windows(seq: np.ndarray, names: dict[bytes, int]) -> np.ndarray:
        raw, size = seq.tobytes(), seq.itemsize
        return np.array([names.setdefault(raw[k * size : (k + width) * size], len(names)) for k in range(len(seq) - width + 1)], np.int64)

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("cell", "ascending"), ("spot", "ascending")]).combine_chunks()
        key, cell, spot, ids = (rows[c].to_numpy() for c in ("key", "cell", "spot", "file_id"))
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), True])
        out = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if j - i > 1:
                keys = [np.array(k, np.int64) for k in rows["keys"].slice(i, j - i).to_pylist()]
                out.extend(block(int(key[i]), int(cell[i]), ids[i:j], spot[i:j], keys, rows["data"].slice(i, j - i).to_pylist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 3, schema, strict=True)], schema=schema)

    return compare
