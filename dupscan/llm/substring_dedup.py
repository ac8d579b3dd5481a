"""Substring dedup: suffix automata of reference shards find the word windows that an earlier document has too.

A window of `length` words belongs to one anchor: the least hash among its runs of about a third of that length.  Equal
windows have equal anchors, so what an anchor selects in a document, a segment of fewer than twice `length` words, can
only match segments of the same anchor.  This routes every segment to the one reference shard that
can match it; sending automata of all shards past all documents would cost their product.

* Equal segments are one entry of the reference, with the least id that has it.
* A task builds the generalised suffix automaton of a shard's segments, hands the least id of each up the suffix links,
  and streams the segments through it; where the match reaches `length` words the state names the least id.
* A shard of more than `SHARD` segments is split by window hash, so an automaton stays below about 25,000 words however
  often a passage recurs.  What the parts find is put together to one row for a segment before its members are joined.
* A first pass finds anchors that very many segments have; their segments are dealt into parts of about `PART`, so no
  task takes in all occurrences of one passage.  The members of one segment are dealt alike when they meet what was found
  for it; the copies of that are a row for `PART` members.

All words under windows that have a smaller id elsewhere are removed; windows are judged on the input.

Nulls and ties: a null text has no words; a null id neither removes nor is removed; rows with one id are separate texts
that never remove words from each other; a word is removed once however many windows cover it; no rows give no rows; a
text of any length is cut into segments like others, and other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dupscan.llm.shared import Texts, U, among, batch, bitmap, combine, cut, few, mix, ngrams, signed, small_batches, text_blocks

SHARD = 256
#: Segments of one anchor that lie together; anchors known to have more are at most this many (2 MB), which changes speed only.
PART, KNOWN = 4096, 1 << 17
FAR = 1 << 62
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    """Generalised suffix automaton over sequences of hashables, with the least owner of every substring."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.size, self.owner = [-1], [0], [FAR]

    def _state(self, size: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.owner.append(FAR)
        return len(self.size) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the substrings that end in p's longest one and c, apart from q's longer ones."""
        new = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def add(self, items: list, owner: int) -> None:
        last = 0
        for c in items:
            q = self.step[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
            else:
                p, last = last, self._state(self.size[last] + 1, {}, 0)
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][c]
                    self.link[last] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            if owner < self.owner[last]:
                self.owner[last] = owner

    def settle(self) -> None:
        """Hand owners up the suffix links; once, after all sequences are in."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if self.owner[v] < self.owner[up]:
                self.owner[up] = self.owner[v]

    def least_owners(self, items: list, length: int) -> list[int]:
        """For each run of `length` items the least owner of that run, FAR where none has it."""
        v = have = 0
        out = []
        for i, c in enumerate(items):
            while v and c not in self.step[v]:
                v = self.link[v]
                have = self.size[v]
            if c in self.step[v]:
                v, have = self.step[v][c], have + 1
            if i + 1 >= length:
                u = v
                while have >= length and self.size[self.link[u]] >= length:
                    u = self.link[u]
                out.append(self.owner[u] if have >= length else FAR)
        return out


def _calm(g: np.ndarray, view: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a row's windows, and where they change, where equal hashes lie close: an anchor stays as long as a window
    holds it and no smaller hash.  Ties have one hash, so equal windows still have equal anchors by hash; a text that
    repeats a word makes a segment for each few windows instead of one for each."""
    least = view.min(axis=1)
    last = np.arange(at + view.shape[1] - 1, at + view.shape[1] - 1 + len(view)) - view[:, ::-1].argmin(axis=1)
    change = np.r_[np.flatnonzero(least[1:] != least[:-1]) + 1, len(view)]
    own, first, j, k = np.empty(len(view), np.int64), [], 0, 0
    while j < len(view):
        while change[k] <= j:
            k += 1
        end = min(int(change[k]), int(last[j]) - at + 1)
        own[j:end] = last[j]
        first.append(j)
        j = end
    return own, np.array(first)


def segments(texts: Texts, length: int) -> Iterator[tuple]:
    """Of each row with a window: row, and by segment the anchor, a hash of its content, first window, number of windows."""
    k = max(1, length // 3)
    if len(texts.hashes) < length:
        return
    g, h = ngrams(texts.hashes, k), ngrams(texts.hashes, length)
    view = np.lib.stride_tricks.sliding_window_view(g, length - k + 1)
    at = np.concatenate([view[i : i + 32768].argmin(axis=1) + np.arange(i, min(i + 32768, len(view))) for i in range(0, len(view), 32768)])
    for i in range(len(texts.rows)):
        a, b = texts.first[i], texts.first[i + 1] - length + 1
        if a < b:
            own = at[a:b]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            if 4 * len(first) > b - a + 32:
                own, first = _calm(g, view[a:b], a)
            last = np.r_[first[1:], b - a] - 1
            yield i, g[own[first]], combine(h[a + first], h[a + last], (last - first).astype(U)), first, last - first + 1


def _rows(it: Iterator[pa.RecordBatch], length: int):
    for rb in it:
        keys = rb.column(0).to_pylist()
        for texts in text_blocks(rb.column(1)):
            for i, *found in segments(texts, length):
                yield keys[texts.rows[i]], texts, i, *found


def hot_anchors(src: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (sorted) that more than PART segments have, and into how many parts to deal their segments."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def count(it):
        held, room = [], 0

        def often():
            a, n = np.unique(np.concatenate(held), return_counts=True)
            return a[n >= 16], n[n >= 16]

        for *_, a, _, _, _ in _rows(it, length):
            held.append(a)
            room += len(a)
            if room > 500_000:
                a, n = often()
                yield batch(schema, signed(a), n)
                held, room = [], 0
        if held:
            a, n = often()
            yield batch(schema, signed(a), n)

    found = src.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > PART).orderBy(F.desc("n"), "anchor").limit(KNOWN).collect()
    a = np.array([r[0] for r in found], np.int64).view(U)
    order = np.argsort(a)
    return a[order], np.array([r[1] // PART + 1 for r in found], U)[order]


def removals(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(id, version, first, last): runs of words to remove; version is the text's hash, as rows may share an id."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    schema = pa.schema([("part", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(src, length))

    def list_all(it):
        held, room, (often, parts) = [], 0, hot.value
        for key, texts, i, a, s, f, w in _rows(it, length):
            part = a
            if len(often):
                at = np.minimum(np.searchsorted(often, a), len(often) - 1)
                part = np.where(often[at] == a, combine(a, mix(np.full(len(a), key).view(U)) % parts[at]), a)
            held.append((signed(part), signed(a), signed(s), np.full(len(a), key), np.full(len(a), texts.version(i)), f.astype(np.int32), w.astype(np.int32)))
            room += len(a)
            if room > 100_000:
                yield batch(schema, *map(np.concatenate, zip(*held, strict=True)))
                held, room = [], 0
        if held:
            yield batch(schema, *map(np.concatenate, zip(*held, strict=True)))

    segs = src.mapInArrow(list_all, "part long, anchor long, segment long, id long, version long, first int, windows int").repartition("part")
    # what lies together has one anchor; a part of a hot one is kept whole
    stats = segs.groupBy("part").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("anchor").alias("a"), F.max(F.xxhash64("segment", "version", "first", "windows")).alias("z"))
    # z: as all columns are used, the exchange above serves both sides
    stats = stats.where("(least < most or part <> a) and z is not null").select("part")
    shared = cut(segs.join(stats, "part").drop("part"))  # a semi-join would go below the exchange
    refs = cut(shared.groupBy("anchor", "segment").agg(F.min("id").alias("id"), F.count("*").alias("members")))
    n = refs.count()
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(refs.select("anchor", "segment", "id"), n))
    word_schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("id", pa.int64()), ("items", pa.binary())])

    def spell(it):
        """The words of the references' segments."""
        held, room = [], 0
        for key, texts, i, a, s, f, w in _rows(it, length):
            ids = texts.words(i)
            for x in np.flatnonzero(among(seen.value, combine(a, s, np.full(len(a), key).view(U)))).tolist():
                held.append((int(signed(a)[x]), int(signed(s)[x]), key, ids[f[x] : f[x] + w[x] + length - 1].tobytes()))
                room += 1
            if room > 5000:
                yield batch(word_schema, *map(list, zip(*held, strict=True)))
                held, room = [], 0
        if held:
            yield batch(word_schema, *map(list, zip(*held, strict=True)))

    spelt = src.mapInArrow(spell, "anchor long, segment long, id long, items binary").dropDuplicates(["anchor", "segment", "id"])
    sizes = refs.groupBy("anchor").agg(F.count("*").alias("n"))
    entries = spelt.join(refs, ["anchor", "segment", "id"], "left_semi").join(sizes, "anchor")
    shard_schema = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("segment", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("items", pa.binary())])

    def deal(it):
        for rb in it:
            out = []
            for a, s, key, items, count in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if count <= SHARD:
                    out.append((a, 0, s, key, 0, items))
                else:
                    ids = np.frombuffer(items, U)
                    salts = ngrams(ids, length) % U(2 * count // SHARD * length)
                    out.extend((a, int(x), s, key, i, ids[i : i + length].tobytes()) for i, x in enumerate(salts))
            for i in range(0, len(out), 5000):
                yield batch(shard_schema, *map(list, zip(*out[i : i + 5000], strict=True)))

    dealt = entries.select("anchor", "segment", "id", "items", "n").mapInArrow(deal, "anchor long, salt int, segment long, id long, first int, items binary")
    found_schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("shift", pa.int32()), ("least", pa.list_(pa.int64()))])

    def match(it):
        shard, held, out = None, [], []

        def solve():
            auto = Automaton()
            spelled = [np.frombuffer(items, U).tolist() for *_, items in held]
            for (_, _, _, key, _, _), items in zip(held, spelled, strict=True):
                auto.add(items, key)
            auto.settle()
            return [(a, s, first, auto.least_owners(items, length)) for (a, _, s, _, first, _), items in zip(held, spelled, strict=True)]

        for rb in it:
            for row in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if row[:2] != shard:
                    out.extend(solve())
                    shard, held = row[:2], []
                    if len(out) > 5000:
                        yield batch(found_schema, *map(list, zip(*out, strict=True)))
                        out = []
                held.append(row)
        out.extend(solve())
        if out:
            yield batch(found_schema, *map(list, zip(*out, strict=True)))

    found = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(match, "anchor long, segment long, shift int, least array<long>")
    # of a split shard's windows one row for a segment, no more than `length` entries
    found = found.groupBy("anchor", "segment").agg(F.min(F.array_min("least")).alias("earliest"), F.collect_list(F.struct("shift", "least")).alias("found"))
    # what is found for a segment with very many members is copied to as many parts as its members are dealt into
    hot = refs.where(F.col("members") > PART).select("anchor", "segment", F.floor(F.col("members") / PART).alias("more"))
    on, member = ["anchor", "segment"], shared
    if hot.limit(1).count():
        small = few(hot)
        part = F.pmod(F.xxhash64("id", "version", "first"), F.coalesce("more", F.lit(0)) + 1)
        member = shared.join(small(hot), on, "left").withColumn("part", part).drop("more")
        found = found.join(small(hot), on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("more", F.lit(0))))).drop("more")
        on = [*on, "part"]
    hits = member.join(found, on).where(F.col("earliest") < F.col("id"))
    run_schema = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def merge(it):
        """Runs of windows with an earlier owner, as runs of words."""
        for rb in it:
            out = []
            for key, version, first, windows, parts in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                flags = np.zeros(windows + 2, bool)
                for part in parts:
                    flags[1 + part["shift"] : 1 + part["shift"] + len(part["least"])] = np.array(part["least"]) < key
                earlier = np.flatnonzero(np.diff(flags.astype(int)))
                out.extend((key, version, first + a, first + b + length - 2) for a, b in zip(earlier[::2].tolist(), earlier[1::2].tolist(), strict=True))
            if out:
                yield batch(run_schema, *map(list, zip(*out, strict=True)))

    return hits.select("id", "version", "first", "windows", "found").mapInArrow(merge, "id long, version long, first int, last int")


def remove_words(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """Text without the words of the runs, words before, words removed.  Kept stretches keep their own white space and
    are joined by one line break; a text that loses nothing is unchanged."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    gone = np.zeros(len(spans) + 1, np.int64)
    for first, last in runs:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return text, len(spans), 0
    edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(int)))
    kept = [text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return "\n".join(kept), len(spans), int(gone.sum())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with text_col less the repeated windows, and n_words and n_removed (docs' own columns of these names go)."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select(*kept)
    runs = removals(docs, id_col, text_col, length)
    lists = runs.groupBy("id").agg(F.collect_list(F.struct("version", "first", "last")).alias("runs"))
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*kept).alias("row"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def apply(it):
        for rb in it:
            row, found = rb.column(0), rb.column(1).to_pylist()
            fields = {f.name: row.field(i) for i, f in enumerate(row.type)}
            texts, before, removed = [], [], []
            for text, runs in zip(fields[text_col].to_pylist(), found, strict=True):
                version = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63 if runs else 0
                t, n, r = remove_words(text, [(x["first"], x["last"]) for x in runs or () if x["version"] == version])
                texts.append(t)
                before.append(n)
                removed.append(r)
            fields |= {text_col: pa.array(texts, pa.string()), "n_words": pa.array(before, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields))

    return packed.join(lists, "id", "left").select("row", "runs").mapInArrow(apply, schema)


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of what dedup_substrings returned, without another Python worker a task."""
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \\x09-\\x0D]+", " "))
    return docs.select(F.col(id_col).cast("long"), F.col("n_words"), F.col("n_removed"), F.sha2(spaced, 256).alias("kept_sha256"))
