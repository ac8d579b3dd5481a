"""What several operators share: words, 64-bit shingle hashes, checkpoints, id bitmaps, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Odd multipliers of the finalising mix (public splitmix64 constants, fixed values).
MIX1, MIX2, MIX3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
EMPTY = np.empty(0, U)


BLOCK = 1 << 18
#: White space and lower case of A-Z by byte; masks of the first k bytes of eight.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Words of more bytes are hashed one by one.
LONGEST = 64


def hash_words(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words b[s:e].  All words take in eight bytes at a time, each step mixed, so a word of up to
    eight bytes shares its hash with no other of its length and longer ones only by chance."""
    size = e - s
    eight = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(U) * MIX1 ^ (eight[s] & FIRST[np.minimum(size, 8)]))
    on, at = np.flatnonzero(size > 8), 8
    while len(on) and at < LONGEST:
        h[on] = mix(h[on] * MIX3 + (eight[s[on] + at] & FIRST[np.minimum(size[on] - at, 8)]))
        at += 8
        on = on[size[on] > at]
    for i in on.tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[s[i] : e[i]].tobytes())
    return h


class Texts:
    """Some rows of a text column: hashes of all their words in order, and where each row's words and bytes begin."""

    def __init__(self, rows: range, data: np.ndarray, at: np.ndarray, lower: bool) -> None:
        self.rows, self.data, self.at = rows, data, at
        b = LOWER[data] if lower else data
        solid = ~SPACE[b]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        own = at[:-1][at[:-1] < at[1:]]
        begin[own] = solid[own]
        own = at[1:][at[:-1] < at[1:]] - 1
        end[own] = solid[own]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.hashes = hash_words(b, s, e) if len(s) else EMPTY
        self.begin, self.end = s, e
        self.first = np.searchsorted(s, at)

    def words(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def raw(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def version(self, i: int) -> int:
        return xxhash.xxh3_64_intdigest(self.raw(i)) - 2**63

    def ngrams(self, n: int):
        """For each row its n-gram hashes by position."""
        g = ngrams(self.hashes, n)
        for i in range(len(self.rows)):
            a, b = self.first[i], self.first[i + 1] - n + 1
            yield g[a : max(a, b)]


def text_blocks(col: pa.Array, lower: bool = False) -> Iterator[Texts]:
    """The rows of a string column in blocks of about BLOCK bytes, straight from Arrow's buffers; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    n, kind = len(col), np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not n:
        return
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        yield Texts(range(i, j), data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        i = j


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without ASCII white space; lower changes only A-Z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX2
    h = (h ^ (h >> U(27))) * MIX3
    return h ^ (h >> U(31))


def ngrams(ids: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n ids, by position; built by doubling, so the cost grows with log n."""
    if len(ids) < n:
        return EMPTY
    out, have, power, width = None, 0, ids, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = power, width
            else:
                m = min(len(out), len(power) - have)
                out = mix(out[:m] * MIX1 + power[have : have + m])
                have += width
        left >>= 1
        if left:
            m = len(power) - width
            power = mix(power[:m] * MIX1 + power[width : width + m])
            width *= 2
    return mix(out[: len(ids) - n + 1] + U(n))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def shingle_sets(texts: Texts, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-word shingles; a shorter text is one shingle, no words are none."""
    for i, g in enumerate(texts.ngrams(n)):
        w = texts.words(i) if not len(g) else EMPTY
        yield distinct(g) if len(g) else mix(ngrams(w, len(w)) ^ U(len(w))) if len(w) else EMPTY


def combine(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """One hash of several columns of 64-bit values."""
    for x in others:
        first = mix(first * MIX1 + x)
    return first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Texts are long: hand them to Python by at most so many, and about so many bytes, at a time, for the rest of the
    session.  One longer text is a batch of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        have = spark.conf.get(key).lower()
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def checkpoint_ready(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; only a local session without one gets a folder of its
    own, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: short plans, nothing is lost with an executor.

    What nothing needs from then on goes at once: the shuffle files that df took (a later use of df would make them
    anew), and the files of `done`, earlier results of cut()."""
    checkpoint_ready(df.sparkSession)
    out = df.checkpoint(eager=True)
    sc, plan = df.sparkSession.sparkContext._jsc.sc(), df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" and sc.cleaner().isDefined():
        for k in plan.context().shuffleIds().keySet().toArray():
            sc.cleaner().get().doCleanupShuffle(k, False)
    for old in done:
        discard(old)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a result of cut() that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a few numbers that may be broadcast, after counting them: some 20 MB.
FEW = 400_000
MAX_BITS = 1 << 27


def few(df: DataFrame):
    """F.broadcast where df, counted, has few rows, and else nothing."""
    return F.broadcast if df.count() <= FEW else (lambda x: x)


def bitmap(ids: DataFrame, n: int, bits_each: int = 32) -> np.ndarray:
    """Bitmap of the hashes of rows of LONG columns, at most 16 MB whatever n is: a filter that lets false ones pass, never loses one."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (bits_each * n).bit_length()))
    schema = pa.schema([("b", pa.binary())])

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits // 8, np.uint8)
        for rb in it:
            k = mix(combine(*(c.to_numpy(zero_copy_only=False).view(U) for c in rb.columns))) & U(bits - 1)
            np.bitwise_or.at(have, (k >> U(3)).astype(np.int64), (1 << (k & U(7)).astype(np.uint8)).astype(np.uint8))
        if have.any():
            yield batch(schema, [have.tobytes()])

    out = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(fold, "b binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def among(have: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = mix(h) & U(len(have) * 8 - 1)
    return (have[(k >> U(3)).astype(np.int64)] >> (k & U(7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge, by large-star and small-star steps.

    Each step is a shuffle of the edges still there; a hub's edges meet only in an aggregate with partial sums and in a
    join that AQE can split.  Null ends and loops are ignored."""
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # large star: larger neighbours of w go to the smallest of w's neighbourhood
        e1 = both.join(low, both.u == low.w).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, go to the smallest
        low2 = e1.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        e2 = e1.join(low2, e1.u == low2.w)
        e = cut(e2.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("w", "m")).distinct().toDF("u", "v"), e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out
