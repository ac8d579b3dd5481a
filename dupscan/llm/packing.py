"""Best-fit packing: a grouping genetic algorithm over islands, with elite migration.

Texts are tokenised and cut into pieces of at most `capacity` tokens.  A full piece is a sequence by itself.  The other
pieces are dealt into groups of about `GROUP`; on each group `ISLANDS` islands evolve packings of the same pieces:

* an individual is a list of bins; the first ones come from best-fit decreasing and from best-fit in disturbed orders;
* crossover injects whole well-filled bins of one parent into the other, drops the other's bins that hold a piece twice,
  and best-fits the displaced pieces; mutation dissolves the emptiest bins and some others;
* fewer bins are fitter, then the mean squared fill.

After an epoch each island sends its elite to the next one, which takes it into its population for another epoch; the best
island wins.  Bins that stay under `WELL` full are dissolved, and their pieces meet those of other groups in a next level,
until one group holds them all or a level saves no sequence.  Tasks hold a group at a time, so memory is bounded; lost
tasks run again from tables.  Where best-fit meets the lower bound (the larger of total size over capacity and the number
of pieces larger than half of it) nothing can be better, and a population is not bred.

Nulls and ties: a null text is empty; every document ends with id 0, so an empty one is a piece of one token; rows that
repeat an id are documents of their own; a null id is packed like any; other columns are ignored; no rows give no rows;
a text of any length is cut into pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupscan.llm.shared import Texts, U, batch, cut, small_batches, text_blocks

GROUP, ISLANDS, EPOCHS, POPULATION, GENERATIONS, WELL = 4000, 2, 2, 5, 10, 0.98
#: Words whose ids a worker keeps: 2^22 slots, 80 MB; and runs of letters, about 65 MB.
SLOTS, CORES = 1 << 22, 300_000
#: What may follow a word's letters without changing how the letters are split; the apostrophe is not among them.
TAIL = ".,!?;:*#$%&|)\"("


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    With a vocabulary that drops white space, a word's ids do not depend on its neighbours.  So words are hashed straight
    from Arrow's buffers, looked up in a table of 64-bit hashes (open addressing, all words of a block at once), and their
    ids are gathered; only new words are spelt out and encoded, many in one call."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [str(x.get("type")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.by_word = bool(splits) and splits[0].get("behavior") == "Removed" and "\\s" in str(splits[0].get("pattern")) and "Lowercase" in steps
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.cores: dict[str, bytes] = {}
        self._empty()

    def _empty(self) -> None:
        self.keys, self.place = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for unknown ones."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        at = (h >> U(40)).astype(np.int64) & (SLOTS - 1)
        while len(todo):
            k = self.keys[at]
            hit = k == h[todo]
            out[todo[hit]] = self.place[at[hit]]
            on = ~hit & (k != 0)
            todo, at = todo[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        n = self.count + len(h)
        if n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros(max(n, len(x)), np.int64)]) for x in (self.begin, self.length))
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        size = np.array([len(x) // 4 for x in ids], np.int64)
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[self.count : n] = self.used + np.cumsum(size) - size
        self.length[self.count : n] = size
        self.used += len(flat)
        todo, at, own = h, (h >> U(40)).astype(np.int64) & (SLOTS - 1), np.arange(self.count, n)
        while len(todo):  # of several new hashes for one free slot the last one written stays, the others go on
            free = self.keys[at] == 0
            self.keys[at[free]] = todo[free]
            mine = free & (self.keys[at] == todo)
            self.place[at[mine]] = own[mine]
            todo, own, at = todo[~mine], own[~mine], (at[~mine] + 1) & (SLOTS - 1)
        self.count = n

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spell(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: of the letters, known ones or many in one call, and of what follows them."""
        out: list[bytes | None] = []
        split, fresh = [], []
        if len(self.cores) > CORES:
            self.cores.clear()
        for w in words:
            core = w.rstrip(TAIL)
            key = core.lower()
            if key.isalpha() and "Σ" not in core:
                split.append((len(out), key, w[len(core) :]))
                out.append(None)
                if key not in self.cores:
                    self.cores[key] = b""
                    fresh.append(key)
            else:
                out.append(self._plain(w))
        for i in range(0, len(fresh), 2000):
            some = fresh[i : i + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids)
            if len(owner) and owner[-1] == len(some) - 1 and (np.diff(owner) >= 0).all():
                ends = np.searchsorted(owner, np.arange(len(some) + 1))
                for k, key in enumerate(some):
                    self.cores[key] = ids[ends[k] : ends[k + 1]].tobytes()
            else:
                for key in some:
                    self.cores[key] = self._plain(key)
        for i, key, tail in split:
            if tail and tail not in self.cores:
                self.cores[tail] = self._plain(tail)
            out[i] = self.cores[key] + (self.cores[tail] if tail else b"")
        return out

    def encode(self, t: Texts) -> Iterator[bytes]:
        """Ids of each row of a block, as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            yield from (self._plain(t.raw(i).decode("utf-8", "surrogatepass")) for i in range(len(t.rows)))
            return
        h = np.where(t.hashes == 0, U(1), t.hashes)
        place = self._find(h)
        if (place < 0).any():
            new = np.flatnonzero(place < 0)
            if self.count + len(new) > SLOTS // 2:
                self._empty()
                new = np.arange(len(h))
            some, first = np.unique(h[new], return_index=True)
            spelt = [t.data[t.begin[i] : t.end[i]].tobytes().decode("utf-8", "surrogatepass") for i in new[first].tolist()]
            self._add(some, self._spell(spelt))
            place = self._find(h)
        size = self.length[place]
        upto = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(self.begin[place] - upto[:-1], size) + np.arange(upto[-1])]
        odd = any(s in t.data.tobytes() for s in self.special)
        for i in range(len(t.rows)):
            if odd and any(s in t.raw(i) for s in self.special):
                yield self._plain(t.raw(i).decode("utf-8", "surrogatepass"))
            else:
                yield ids[upto[t.first[i]] : upto[t.first[i + 1]]].astype("<u4").tobytes()


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """Pieces of every document's ids: PIECES.  path: a tokenizer's file, at the same place on all machines."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rb in it:
            keys = rb.column(0).to_pylist()
            for t in text_blocks(rb.column(1)):
                out = []
                for row, ids in zip(t.rows, enc.encode(t), strict=True):
                    ids += b"\0\0\0\0"
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        p = ids[i : i + 4 * capacity]
                        out.append((keys[row], k, i // 4, len(p) // 4, zlib.crc32(p)))
                yield batch(schema, *map(list, zip(*out, strict=True)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


class Fit:
    """Bins by room left, for best-fit in constant time: a bit for each room that some bin has."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []

    def open(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.mask |= 1 << room
        self.bins.append(items)

    def put(self, item: int, size: int) -> None:
        m = self.mask >> size
        if not m:
            self.open([item], self.capacity - size)
            return
        room = size + (m & -m).bit_length() - 1
        own = self.by_room[room]
        b = own.pop()
        if not own:
            self.mask ^= 1 << room
        self.bins[b].append(item)
        self.by_room[room - size].append(b)
        self.mask |= 1 << (room - size)


def best_fit(sizes: list[int], order, capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    f = Fit(capacity)
    for b in start:
        f.open(b, capacity - sum(sizes[i] for i in b))
    for i in order:
        f.put(i, sizes[i])
    return f.bins


def fills(sizes: list[int], bins: list[list[int]]) -> list[int]:
    return [sum(sizes[i] for i in b) for b in bins]


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Lower is fitter."""
    return len(bins), -sum((f / capacity) ** 2 for f in fills(sizes, bins)) / max(len(bins), 1)


def crossover(sizes: list[int], one: list[list[int]], other: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    full = fills(sizes, other)
    good = [b for b, f in zip(other, full, strict=True) if f >= WELL * capacity and rng.random() < 0.5]
    taken = {i for b in good for i in b}
    kept, out = [], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            out.extend(i for i in b if i not in taken)
    out.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(sizes, out, capacity, [list(b) for b in good] + kept)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    full = np.array(fills(sizes, bins))
    gone = set(np.argsort(full, kind="stable")[: max(2, len(bins) // 50)].tolist()) | set(rng.integers(len(bins), size=max(2, len(bins) // 50)).tolist())
    out = sorted((i for b in gone for i in bins[b]), key=lambda i: sizes[i] * (0.9 + 0.2 * rng.random()), reverse=True)
    return best_fit(sizes, out, capacity, [list(b) for k, b in enumerate(bins) if k not in gone])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), generations: int = GENERATIONS) -> list[list[int]]:
    """The fittest packing of pieces 0..n-1 that an island finds, elites of others among its first individuals."""
    if not sizes:
        return []
    rng = np.random.default_rng(seed)
    least = max(ceil(sum(sizes) / capacity), sum(2 * x > capacity for x in sizes))
    by_size = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    people = [best_fit(sizes, by_size, capacity), *([list(b) for b in e] for e in elites)]
    if min(map(len, people)) > least:
        while len(people) < POPULATION:
            noise = rng.random(len(sizes)) * 0.3 + 0.85
            people.append(best_fit(sizes, sorted(by_size, key=lambda i: sizes[i] * noise[i], reverse=True), capacity))
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for k in range(generations):
        if len(ranked[0][2]) <= least:
            break
        a, b = rng.integers(len(ranked), size=2)
        child = crossover(sizes, ranked[min(a, b)][2], ranked[max(a, b) if a != b else 0][2], capacity, rng)
        child = mutate(sizes, child, capacity, rng)
        ranked.append((fitness(sizes, child, capacity), len(people) + k, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[:POPULATION]
    return ranked[0][2]


ROW = "doc_id long, piece int, start long, length long, ids_crc32 long, cell int, island int, item int, bin int"


def _island(capacity: int, epoch: int):
    """One island's epoch: its pieces as rows (own = true), with the elite of its neighbour from the second epoch on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.own].sort_values(["item"] if epoch else ["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = own.length.tolist()
        elites = []
        if epoch:
            for rows in (own, pdf[~pdf.own].sort_values("item")):
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(rows.bin.tolist()):
                    bins.setdefault(b, []).append(i)
                if len(rows) == len(own):
                    elites.append(list(bins.values()))
        cell, island = int(pdf.cell.iloc[0]), int(pdf.island.iloc[0])
        bins = evolve(sizes, capacity, (cell * ISLANDS + island) * EPOCHS + epoch, elites)
        at = np.empty(len(own), np.int32)
        for k, b in enumerate(bins):
            at[b] = k
        return own.assign(cell=np.int32(cell), island=np.int32(island), item=np.arange(len(own), dtype=np.int32), bin=at)[[c.split()[0] for c in ROW.split(", ")]]

    return run


def packed_cells(items: DataFrame, cells: int, capacity: int, level: int) -> DataFrame:
    """ROW of the winning island of each cell."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(cells)).cast("int"))
    dealt = cut(dealt)  # the islands of a cell must see the same pieces
    now = dealt.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS))))).withColumns({"item": F.lit(0), "bin": F.lit(0), "own": F.lit(True)})
    now = cut(now.groupBy("cell", "island").applyInPandas(_island(capacity, 0), ROW), dealt)
    for epoch in range(1, EPOCHS):
        elite = now.withColumns({"island": ((F.col("island") + 1) % ISLANDS).cast("int"), "own": F.lit(False)})
        now = cut(now.withColumn("own", F.lit(True)).unionByName(elite).groupBy("cell", "island").applyInPandas(_island(capacity, epoch), ROW))
    best = now.groupBy("cell", "island").agg(F.max("bin").alias("bins")).groupBy("cell").agg(F.min(F.struct("bins", "island")).alias("b")).select("cell", F.col("b.island").alias("island"))
    return now.join(best, ["cell", "island"], "left_semi")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """PIECES with sequence_id and offset for each piece of docs."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]
    all_ = cut(pieces(docs, path, id_col, text_col, capacity))
    whole = all_.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    items, out = all_.where(F.col("length") < capacity), [whole]
    before = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)

    def done(rows: DataFrame) -> None:
        out.append(rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*names, "sequence_id", "offset"))

    count, level, held, bins = items.count(), 0, None, 0
    while count:
        cells = max(1, count // GROUP)
        number = F.lit(level + 1).cast("long") * (1 << 56) + F.col("cell").cast("long") * (1 << 24) + F.col("bin")
        rows = packed_cells(items, cells, capacity, level).select(*names, number.alias("sequence_id"))
        rows = cut(rows.withColumn("fill", F.sum("length").over(Window.partitionBy("sequence_id"))))
        if held is not None and rows.select("sequence_id").distinct().count() >= bins:
            done(held)  # mixing the groups' pieces saved nothing, so the level before stands
            break
        if cells == 1:
            done(rows)
            break
        done(rows.where(F.col("fill") >= WELL * capacity))
        held = rows.where(F.col("fill") < WELL * capacity)
        items = held.select(*names)
        count, bins = held.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        level += 1
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
