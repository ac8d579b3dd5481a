"""Benchmark decontamination: pairs of near words find the stretches that can hold a test item, Smith-Waterman alignment scores them.

No pair of a document and an item that reaches the threshold is lost.  An alignment is a row of matches; a step to the
next match that goes d words on in the item and e in the document has max(d, e) - 1 errors at least and adds 2 less these
to the score.  So only steps with d, e <= 2 add anything, and 2 + (2 for each pair of words that both texts hold side by
side, 1 for each other pair of words that are at most two apart in both) bounds the score from above.  Each document
position counts once for an item, in a window as wide as an alignment that reaches the threshold can be; windows whose
bound reaches it are aligned.  An item so short that one equal word reaches the threshold has its words as seeds.

Items go to the tasks in tables of at most about `TABLE` words; each table costs a pass over the documents.  A pair is
found and aligned where the document is read, so an item that leaked a million times is no task's burden.

Each candidate is aligned: match 2, mismatch -1, gap -1, local.  Its score is the best alignment over the one that the
whole item would have; pairs with a score of at least `threshold` are contaminated.

Nulls and ties: null, empty or blank texts and items have no seeds and match nothing; rows with a null id match nothing;
items of fewer than `least_words` words are ignored, as a common word would mark every document that has it; items that
repeat an id each count, the best score of an id is kept; rows that repeat a document's id are one document here, with its
best score; texts of any length are searched whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.shared import U, Texts, among, batch, combine, mix, small_batches, text_blocks

MATCH, MISS, GAP = 2, -1, -1
#: Words of the items of one table (some 30 MB with their seeds); hits that a task holds at once.
TABLE, HITS = 1 << 19, 1 << 21


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score, and where in b it ends (the first of the best).

    Row by row of the shorter one; gaps along a row are a running maximum, as each costs the same."""
    if not len(a) or not len(b):
        return 0, 0
    steps = np.arange(len(b) + 1) * -GAP
    above, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        here = np.zeros(len(b) + 1, np.int64)
        here[1:] = np.maximum(np.maximum(above[:-1] + np.where(b == x, MATCH, MISS), above[1:] + GAP), 0)
        above = np.maximum.accumulate(here + steps) - steps
        k = int(above.argmax())
        if above[k] > best:
            best, end = int(above[k]), k
    return best, end


def pairs_of(w: np.ndarray, apart: int) -> np.ndarray:
    """One hash by position for the word there and the word `apart` further on; for 0 the word alone."""
    return combine(w[: len(w) - apart], w[apart:]) if apart else mix(w)


def items_of(items: DataFrame, id_col: str, text_col: str, least_words: int = 1) -> DataFrame:
    """(item, words) of each distinct item row that has an id and enough words."""
    schema = pa.schema([("item", pa.int64()), ("version", pa.int64()), ("words", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            keys = rb.column(0).to_pylist()
            for t in text_blocks(rb.column(1), lower=True):
                out = [(keys[row], t.version(i), t.words(i).tobytes()) for i, row in enumerate(t.rows) if keys[row] is not None and len(t.words(i)) >= max(1, least_words)]
                if out:
                    yield batch(schema, *map(list, zip(*out, strict=True)))

    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "item long, version long, words binary")
    return rows.dropDuplicates(["item", "version"]).select("item", "words")


class Table:
    """Some items: their words, and by seed hash the items that hold it and how far apart its words are there."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float) -> None:
        self.names, self.words = [r[0] for r in rows], [np.frombuffer(r[1], U) for r in rows]
        self.full = np.array([MATCH * len(w) for w in self.words], np.int64)
        self.threshold = threshold
        # s points are 2 m - x with m matches and x errors; such an alignment has m + x <= 3 len - s words of a document
        least = np.ceil(self.full * threshold - 1e-6).astype(np.int64)
        self.span = np.maximum(3 * self.full // MATCH - least, 1)
        self.widest = int(self.span.max(initial=1))
        seeds = [(pairs_of(w, d), k, d) for k, w in enumerate(self.words) for d in ((0,) if MATCH / self.full[k] >= threshold else (1, 2)) if len(w) > d]
        lens = [len(s[0]) for s in seeds]
        hashes = np.concatenate([s[0] for s in seeds]) if seeds else np.empty(0, U)
        owner, apart = (np.repeat(np.array([s[i] for s in seeds], np.int64), lens) for i in (1, 2))
        order = np.lexsort((apart, owner, hashes))
        hashes, owner, apart = hashes[order], owner[order], apart[order]
        first = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)]  # of an item's equal seeds the closest
        hashes, self.owner, self.apart = hashes[first], owner[first], apart[first]
        self.keys, start = np.unique(hashes, return_index=True)
        self.start = np.r_[start, len(hashes)]
        bits = 1 << max(16, (32 * len(self.keys)).bit_length())
        self.have = np.zeros(bits // 8, np.uint8)
        k = mix(self.keys) & U(bits - 1)
        np.bitwise_or.at(self.have, (k >> U(3)).astype(np.int64), (1 << (k & U(7)).astype(np.uint8)).astype(np.uint8))

    def stretches(self, t: Texts) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, end) of the texts' stretches that an item's bound lets reach the threshold."""
        found = []
        for apart in (0, 1, 2):
            if len(t.hashes) <= apart or not len(self.keys):
                continue
            g = pairs_of(t.hashes, apart)
            at = np.flatnonzero(among(self.have, g))
            place = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            at, place = (x[self.keys[place] == g[at]] for x in (at, place))
            row = np.searchsorted(t.first, at, "right") - 1
            inside = at + apart < t.first[row + 1]
            found.append(np.stack([at[inside], place[inside], row[inside], np.full(inside.sum(), apart)]))
        if not found:
            return
        found = np.concatenate(found, axis=1)
        # rows of one block lie as far apart as the widest window, so that none holds words of two
        found[0] += found[2] * self.widest
        at, place, row, apart = found[:, np.argsort(found[0], kind="stable")]
        many = self.start[place + 1] - self.start[place]
        total = np.cumsum(many)
        length, a = int(len(t.hashes) + len(t.rows) * self.widest + 1), 0
        while a < len(at):  # parts overlap by the widest window: each window lies in one of them
            b = max(int(np.searchsorted(total, total[a] + HITS)), int(np.searchsorted(at, at[a] + 2 * self.widest, "right")))
            yield from self.reaching(t, length, *(x[a:b] for x in (at, place, row, apart, many)))
            if b >= len(at):
                break
            a = int(np.searchsorted(at, at[b] - self.widest))

    def reaching(self, t: Texts, length: int, at: np.ndarray, place: np.ndarray, row: np.ndarray, apart: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        own = np.repeat(np.arange(len(at)), many)
        post = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + self.start[place[own]]
        item = self.owner[post]
        worth = np.where(np.maximum(self.apart[post], apart[own]) > 1, 1, 2)
        code = item * length + at[own]
        order = np.lexsort((-worth, code))
        code = code[order]
        best = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        code, item, own, worth = code[best], item[order][best], own[order][best], worth[order][best]
        left = np.searchsorted(code, np.maximum(code - self.span[item], item * length))
        sums = np.r_[0, np.cumsum(worth)]
        bound = sums[1:] - sums[left] + MATCH
        good = np.flatnonzero(bound / self.full[item] >= self.threshold)
        item, own = item[good], own[good]
        begin = at[own] - row[own] * self.widest
        span, low, high = self.span[item], t.first[row[own]], t.first[row[own] + 1]
        a, b = np.maximum(begin - span, low), np.minimum(begin + span + 3, high)
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (row[own][1:] != row[own][:-1]) | (a[1:] > b[:-1])][: len(item)])
        for x, y in zip(new.tolist(), [*new[1:].tolist(), len(item)], strict=False):
            yield int(row[own[x]]), int(item[x]), int(a[x]), int(b[y - 1])


def tables(items: DataFrame, id_col: str, text_col: str, threshold: float, least_words: int = 1) -> Iterator[Table]:
    """The items in tables of about TABLE words; one empty table if there are none."""
    held, room, made = [], 0, False
    for item, w in items_of(items, id_col, text_col, least_words).toLocalIterator():
        held.append((item, bytes(w)))
        room += len(w) // 8
        if room >= TABLE:
            yield Table(held, threshold)
            held, room, made = [], 0, True
    if held or not made:
        yield Table(held, threshold)


def scored(docs: DataFrame, id_col: str, text_col: str, table: Table) -> DataFrame:
    """(id, item, score, begin, end) of the stretches of documents that reach the threshold for an item of the table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rb in it:
            keys = rb.column(0).to_pylist()
            for t in text_blocks(rb.column(1), lower=True):
                out = []
                for i, k, a, b in known.stretches(t):
                    key, w = keys[t.rows[i]], known.words[k]
                    if key is None:
                        continue
                    best, end = align(w, t.hashes[a:b])
                    score = best / (MATCH * len(w))
                    if score >= known.threshold:
                        begin = int(a - t.first[i])
                        out.append((key, known.names[k], score, begin + max(0, end - len(w)), begin + end))
                if out:
                    yield batch(schema, *map(list, zip(*out, strict=True)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, item long, score double, begin int, end int")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", threshold: float = 0.5, least_words: int = 5) -> DataFrame:
    """(id_col, item_col, score, begin, end): pairs of a document and an item that it contains, edited or not, with the
    word positions (from 0, end exclusive) of the passage that holds the best alignment."""
    small_batches(docs.sparkSession)
    rows = reduce(DataFrame.union, [scored(docs, id_col, text_col, t) for t in tables(items, item_col, text_col, threshold, least_words)])
    best = rows.groupBy("id", "item").agg(F.max_by(F.struct("score", "begin", "end"), F.struct("score", -F.col("begin"), -F.col("end"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.score", "b.begin", "b.end")
