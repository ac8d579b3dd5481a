"""Quality classifier: Bradley-Terry pairwise ranking of documents, thresholded by a quantile of the scores.

A document's strength is w . x of features of its whole text.  From labelled rows, preference pairs (a document of label
1 over one of label 0) are drawn and w is fitted by logistic loss on the differences of features.  The quantile of the
training strengths that leaves the share of labels 0 below it becomes the score's threshold: a logistic map carries that
strength to `THRESHOLD`, so that score >= THRESHOLD keeps what ranks above the quantile.

Only fitting uses a sample: at most `SAMPLE` labelled rows, the ones with the least hash of their id; scores cover all.

Nulls and ties: a null or empty text has the features of an empty text and gets a score; labelled ids that are null or
have a null label are not used; an id counts once in fitting, with its greatest label and of several rows with the text of
the least hash, and each of its rows gets a score; where one label is missing every score is the share of label 1 (0.5
without labels); columns beside id, text and label are ignored; no documents give no rows; a text of any length has one
row of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.shared import LOWER, SPACE, U, Texts, distinct, small_batches, text_blocks

#: Bound on labelled rows that fitting uses, and on preference pairs for each row.
SAMPLE, PAIRS = 6000, 8
THRESHOLD = 0.3
#: Hashed words: one feature for each bucket, the share of words in it.
BUCKETS = 64
SYMBOLS = np.frombuffer(b"!#$%&*|.,;:?\"'()[]{}<>/\\@^_=+~-", np.uint8)


def features(t: Texts) -> np.ndarray:
    """A row of features for each text of a block: shares by kind of byte and of word, lengths, repetition."""
    n, data = len(t.rows), t.data
    starts = t.at[:-1]
    size = np.maximum(np.diff(t.at), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[t.at[1:]] - total[starts]) / size

    upper = LOWER[data] != data
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    cols = [share(upper), share(letters), share((data >= 48) & (data <= 57)), share(data >= 128), share(SPACE[data]), share(data == 10)]
    cols += [share(data == s) for s in SYMBOLS]
    # runs of symbols, and upper-case letters beside each other
    sym = ~letters & ~SPACE[data] & ~((data >= 48) & (data <= 57))
    pair = np.r_[False, True] if len(data) < 2 else None
    if pair is None:
        cols += [share(np.r_[False, sym[1:] & sym[:-1]]), share(np.r_[False, upper[1:] & upper[:-1]]), share(np.r_[False, SPACE[data][1:] & SPACE[data][:-1]])]
    else:
        cols += [np.zeros(n)] * 3
    count = np.diff(t.first).astype(float)
    cols += [np.log1p(count), np.minimum(size / np.maximum(count, 1), 40) / 10, (count == 0).astype(float)]
    fresh = np.array([len(distinct(t.words(i))) for i in range(n)], float)
    cols.append(fresh / np.maximum(count, 1))
    pairs = np.array([len(distinct(g)) / max(len(g), 1) for g in t.ngrams(3)])
    cols.append(pairs)
    owner = np.repeat(np.arange(n), np.diff(t.first))
    again = np.r_[False, (t.hashes[1:] == t.hashes[:-1]) & (owner[1:] == owner[:-1])][: len(owner)]
    cols.append(np.bincount(owner, again, n) / np.maximum(count, 1))
    hist = np.bincount(owner * BUCKETS + (t.hashes % U(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.column_stack([*cols, hist / (count + 30)[:, None]])  # 30: a few words say little


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, steps: int = 300, decay: float = 1e-4) -> dict:
    """Bradley-Terry weights from labels, by gradient steps (Adam) on pairs, and the map from strength to score."""
    width = x.shape[1] if x.ndim == 2 else 0
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        flat = min(max(float((y == 1).mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return {"w": np.zeros(width), "mean": np.zeros(width), "scale": np.ones(width), "gain": 0.0, "shift": float(np.log(flat / (1 - flat)))}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    good, bad = np.clip((good - mean) / scale, -8, 8), np.clip((bad - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    m = max(len(good), len(bad)) * PAIRS
    i, j = rng.integers(len(good), size=m), rng.integers(len(bad), size=m)
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for k in range(1, steps + 1):
        part = slice((k * 4096) % m, (k * 4096) % m + 4096)
        d = good[i[part]] - bad[j[part]]
        if not len(d):
            continue
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    s = np.r_[good @ w, bad @ w]
    cut = float(np.quantile(s, len(bad) / len(s)))
    spread = max(float(np.median(good @ w) - np.median(bad @ w)), 1e-3)
    return {"w": w, "mean": mean, "scale": scale, "gain": 8 / spread, "shift": float(np.log(THRESHOLD / (1 - THRESHOLD))) - 8 / spread * cut}


def strength_score(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] if len(model["w"]) else np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(model["gain"] * z + model["shift"], -500, 500)))


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for t in text_blocks(rb.column(0)):
            x = features(t)
            at = t.rows.start, len(t.rows)
            yield pa.RecordBatch.from_arrays([rb.column(1).slice(*at), pa.array(list(x), pa.list_(pa.float64())), rb.column(2).slice(*at)], names=["y", "x", "id"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on at most SAMPLE rows of labels (id_col, label_col) joined with docs."""
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))  # SAMPLE rows of 12 bytes at most
    one = rows.groupBy("_id").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"), F.max("_y").alias("_y"))  # partial sums first: a repeated id is one row for each task
    got = one.select("_t", "_y", F.col("_id").cast("string")).mapInArrow(_features, "y int, x array<double>, id string").toPandas()
    if not len(got):
        return fit(np.zeros((0, 0)), np.zeros(0))
    got = got.sort_values("id")  # the sums must not depend on the order in which tasks end
    return fit(np.vstack(got["x"]), got["y"].to_numpy())


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs and a column score, 0 to 1; a column of this name in docs is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(it):
        for rb in it:
            s = [strength_score(features(t), shared.value) for t in text_blocks(rb.column(at))]
            if s:
                yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(np.concatenate(s))], names=[*rb.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def crc_mod5(id_col: str):
    """The remainder by 5 of the crc32 of an id as text; remainder 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5
