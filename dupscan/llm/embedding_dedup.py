"""Embedding near-dedup: randomly rotated binary codes with correction factors decide which pairs need exact cosines.

A unit vector o is padded with zeros to D components, a multiple of `BITS`, and rotated at random, y = R o.  Its code is
the signs of y, packed into D / 8 bytes; x = signs / sqrt(D) is the nearest corner, and <x, y> is the correction.  Both are
made once and stored beside the vector.  For a query vector q with z = R q,
<x, z> / <x, y> estimates <o, q> without bias, with deviation at most sqrt((1 - <x, y>^2) / <x, y>^2 / (D - 1)).  A pair
whose estimate plus `SIGMAS` deviations stays below the threshold is passed over; what is left is estimated in the other
direction too, and what passes both gets an exact cosine in double precision.

Vectors meet only those of their own label.  The rows of a label are dealt into blocks of about `BLOCK` rows; a task
compares two blocks with each other by matrix products, so a hot label becomes many equal tasks and no pairs are emitted:
what leaves a task is a count of links for each vector and a forest of its links.  Equal vectors of a label are compared
once and counted as many times as they occur.

Nulls and ties: a null label, a null or zero vector, null or non-finite components link with nothing; vectors of unequal
lengths do not link; rows that repeat an id are vectors of their own, with one component; other columns are ignored; no
rows give no rows; a vector of any width is compared whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.shared import batch, components, cut

BLOCK, TILE, BITS, SIGMAS, SEED = 4096, 1024, 64, 4.5, 20240501


def rotation(width: int) -> np.ndarray:
    """The first `width` columns of a random rotation of D dimensions, the same everywhere."""
    n = -(-max(width, 2) // BITS) * BITS
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))
    return (q * np.sign(np.diag(r)))[:, :width]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of very long and very short ones."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(o: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of rotated unit vectors, and the correction of each."""
    y = o @ turn.T
    return np.packbits(y >= 0, axis=1), (np.abs(y).sum(1) / np.sqrt(y.shape[1])).astype(np.float32)


def corners(code: np.ndarray) -> np.ndarray:
    """The corners that packed signs name, as unit vectors."""
    bits = np.unpackbits(code, axis=1)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits.shape[1]))


def least_estimate(f: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """What <x, z> must reach for a pair of this code to be compared, by its correction."""
    return ((threshold - SIGMAS * np.sqrt(np.maximum(1 - f**2, 0) / f**2 / (bits - 1))) * f).astype(np.float32)


def candidates(xa: np.ndarray, za: np.ndarray, la: np.ndarray, xb: np.ndarray, zb: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) that the confidence bounds do not rule out; x: corners, z: rotated vectors, l: least
    estimates."""
    i, j = np.nonzero(xa @ zb.T >= la[:, None])
    keep = np.concatenate([np.einsum("ij,ij->i", xb[j[k : k + 65536]], za[i[k : k + 65536]]) >= lb[j[k : k + 65536]] for k in range(0, len(i), 65536)]) if len(i) else np.empty(0, bool)
    return i[keep], j[keep]


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def cosine_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    # -0.0 and 0.0 compare alike; a vector with a null, an infinite or a not-a-number component is out
    fine = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), fine.alias("fine"))
    same = cut(rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")).where("label is not null"))
    # ids may repeat, so a node has a number of its own
    kinds = {"label": pa.string(), "v": pa.list_(pa.float64()), "node": pa.int64(), "copies": pa.int64(), "number": pa.int64(), "code": pa.binary(), "correction": pa.float32()}

    def stored(it):
        """Rows and their codes, by width."""
        for rb in it:
            wide = pc.list_value_length(rb.column(1)).to_numpy(zero_copy_only=False)
            for w in np.unique(wide).tolist():
                part = rb.filter(pa.array(wide == w))
                code, correction = encode(unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)), rotation(w))
                yield batch(pa.schema(list(kinds.items())), *part.columns, [c.tobytes() for c in code], correction)

    same = cut(same.withColumn("number", F.monotonically_increasing_id()).mapInArrow(stored, "label string, v array<double>, node long, copies long, number long, code binary, correction float"))
    sizes = same.groupBy("label", F.size("v").alias("width")).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = same.withColumn("width", F.size("v")).join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    # block b meets every block: as the pair (min, max)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "width", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "number", "copies", "v", "code", "correction")

    def compare(group):
        numbers, copies, blocks = (group[c].to_numpy() for c in ("number", "copies", "block"))
        exact = unit(np.vstack(group["v"].to_numpy()))
        x = corners(np.vstack([np.frombuffer(c, np.uint8) for c in group["code"]]))
        z = (exact @ rotation(exact.shape[1]).T).astype(np.float32)
        least = least_estimate(group["correction"].to_numpy(), x.shape[1], threshold)
        one = group["lo"].iloc[0] == group["hi"].iloc[0]
        a = np.flatnonzero(blocks == group["lo"].iloc[0])
        b = a if one else np.flatnonzero(blocks == group["hi"].iloc[0])
        links, forest = np.zeros(len(x), np.int64), Forest()
        for i in range(0, len(a), TILE):
            for j in range(i if one else 0, len(b), TILE):
                p, q = a[i : i + TILE], b[j : j + TILE]
                s, t = candidates(x[p], z[p], least[p], x[q], z[q], least[q])
                s, t = p[s], q[t]
                if one:
                    s, t = s[s < t], t[s < t]
                for k in range(0, len(s), 65536):
                    u, w = s[k : k + 65536], t[k : k + 65536]
                    hit = np.einsum("ij,ij->i", exact[u], exact[w]) >= threshold
                    u, w = u[hit], w[hit]
                    np.add.at(links, u, copies[w])
                    np.add.at(links, w, copies[u])
                    for m, n in zip(u.tolist(), w.tolist(), strict=True):
                        forest.join(m, n)
        own = np.flatnonzero(links)
        return pd.DataFrame({"number": numbers[own], "links": links[own], "to": numbers[[forest.root(i) for i in own.tolist()]] if len(own) else numbers[:0]})

    found = cut(met.groupBy("label", "width", "lo", "hi").applyInPandas(compare, "number long, links long, to long"))
    count = found.groupBy("number").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("number").alias("a"), F.col("to").alias("b")))
    nodes = same.join(count, "number", "left").join(comp.withColumnRenamed("node", "number"), "number", "left").withColumn("c", F.coalesce("component", "number"))
    nodes = cut(nodes.select("label", "v", "node", "copies", "links", "c"))
    least = nodes.groupBy("c").agg(F.min("node").alias("least"))
    known = nodes.join(least, "c").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "least")
    out = rows.join(known, ["label", "v"], "left")
    component = F.coalesce(F.when(F.col("fine"), F.col("least")), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.when(F.col("fine"), F.col("n")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
