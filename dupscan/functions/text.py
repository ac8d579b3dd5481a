"""Column functions on texts and tokens; all but windows, rolling_hashes and places run in the JVM.  anchors and edit_distance
are for what runs in Python."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, a number, white space, or one other character; white space is spelt out, as engines differ on \s.
SPACE = r" \t\n\x0B\f\r"
TOKEN = rf"[\p{{L}}_][\p{{L}}\p{{N}}_]*|[0-9]+|[{SPACE}]+|[^{SPACE}]"
SOLID = rf"[\p{{L}}_][\p{{L}}\p{{N}}_]*|[0-9]+|[^{SPACE}]"
BASE, MODULUS = 31, 1_000_000_007
IDENTIFIER, LITERAL = "$ID", "$LIT"


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def solid_tokens(text: Column) -> Column:
    """The tokens that are not white space."""
    return F.regexp_extract_all(text, F.lit(SOLID), F.lit(0))


def places(tokens: Column) -> Column:
    """(start, line, col) arrays of tokens that cover a text: running sums of their sizes and line breaks, in Arrow
    batches; only numbers go to Python.  Lines begin at 1, columns at 0."""

    @F.arrow_udf("struct<start:array<long>,line:array<int>,col:array<int>>")
    def place(sizes: pa.Array, breaks: pa.Array, tails: pa.Array) -> pa.Array:
        count = sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(count)]
        size, lines, tail = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (sizes, breaks, tails))
        end, ended = np.cumsum(size), np.cumsum(lines)
        start, line = end - size, ended - lines
        # where the last line break before a token ended, or its text began
        edge = np.r_[0, np.maximum.accumulate(np.where(lines > 0, end - tail, 0))][: len(size)]
        base = np.repeat(np.r_[start, 0][at[:-1]], count)
        own = [(start - base, pa.int64()), (line - np.repeat(np.r_[line, 0][at[:-1]], count) + 1, pa.int32()), (start - np.maximum(edge, base), pa.int32())]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in own], ["start", "line", "col"])

    breaks = F.transform(tokens, lambda v: F.char_length(v) - F.char_length(F.replace(v, F.lit("\n"), F.lit(""))))
    return place(F.transform(tokens, F.char_length), breaks, F.transform(tokens, lambda v: F.char_length(F.substring_index(v, "\n", -1))))


def token_class(value: Column) -> Column:
    return (
        F.when(value.rlike(rf"^[{SPACE}]"), "Whitespace")
        .when(value.rlike(r"^[\p{L}_]"), "Identifier")
        .when(value.rlike(r"^[0-9]"), "Literal")
        .otherwise("Delimiter")
    )


def normalized(kind: Column, value: Column, mask: bool = True) -> Column:
    """Identifiers and literals by kind if mask; comments and white space as nothing."""
    plain = F.when(kind.isin("Comment", "Whitespace"), "")
    return (plain.when(kind == "Identifier", IDENTIFIER).when(kind == "Literal", LITERAL) if mask else plain).otherwise(value)


def masked(value: Column) -> Column:
    """normalized() of a token of the text lexer that is not white space."""
    return F.when(value.rlike(r"^[\p{L}_]"), IDENTIFIER).when(value.rlike(r"^[0-9]"), LITERAL).otherwise(value)


def normalized_string(tokens: Column) -> Column:
    """Normalised tokens, joined by one space, without empty ones."""
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def fingerprint(tokens: Column) -> Column:
    """Order-sensitive 128-bit hash of a token array."""
    return F.md5(F.array_join(tokens, " "))


def hash_string(token: Column) -> Column:
    """A token's value for the rolling hash, below MODULUS."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long") % MODULUS


def rolling_hash(tokens: Column) -> Column:
    """Polynomial hash of a window: the sum of hash_string(t_i) * BASE^(w-1-i), modulo MODULUS."""
    return F.aggregate(F.transform(tokens, hash_string), F.lit(0).cast("long"), lambda h, t: (h * BASE + t) % MODULUS)


def rolling_hashes(tokens: Column, width: int) -> Column:
    """rolling_hash of every window of width tokens, by position, in Arrow batches; empty for shorter arrays."""

    @F.pandas_udf("array<long>")
    def roll(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            h = np.zeros(max(0, len(v) - width + 1), np.int64)
            for j in range(width if len(h) else 0):
                h = (h * BASE + v[j : j + len(h)]) % MODULUS
            out.append(h)
        return pd.Series(out)

    return roll(F.transform(tokens, hash_string))


def windows(tokens: Column, width: int) -> Column:
    """fingerprint of every run of width tokens, by position; empty for shorter arrays.  In Arrow batches: hashing slices
    of the joined tokens costs a fraction of slicing and joining arrays for each window."""

    @F.arrow_udf("array<string>")
    def prints(lists: pa.Array) -> pa.Array:
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
        first, at, out = 0, [0], []
        for n, text in zip(count.tolist(), pc.binary_join(lists.cast(pa.list_(pa.binary())), b" "), strict=True):
            if n >= width:
                ends = np.cumsum(sizes[first : first + n] + 1) - 1
                begins = np.r_[0, ends[: n - width] + 1]
                data = memoryview(text.as_buffer())
                out.extend(md5(data[i:j], usedforsecurity=False).hexdigest() for i, j in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True))
            first += n
            at.append(len(out))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.string()))

    return prints(tokens)


def anchors(hashes: pa.Array, width: int) -> pa.Array:
    """Of lists of token hashes the distinct anchors of the windows of width tokens: of the runs of half a window's tokens
    inside a window, the least hash.  Texts that share a window share its anchor, and neighbouring windows mostly have the
    same: at a width of 50 there are about two anchors for 27 windows."""
    run = (width + 1) // 2
    span = width - run + 1
    count = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.maximum(count - width + 1, 0)
    own = np.repeat(np.arange(len(count)), number)
    low = np.empty(0, np.uint64)
    if len(own):
        h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        runs = np.zeros(len(h) - run + 1, np.uint64)
        for j in range(run):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(runs)]
        low, have = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), 1
        while 2 * have <= span:
            low, have = np.minimum(low[:-have], low[have:]), 2 * have
        if span > have:
            low = np.minimum(low[: have - span], low[span - have :])
        # the windows inside of one list; once where neighbours have the same, then once a list
        low = low[np.repeat(np.cumsum(count) - count - (np.cumsum(number) - number), number) + np.arange(len(own))]
        for order in (slice(None), None):
            order = np.lexsort((low, own)) if order is None else order
            own, low = own[order], low[order]
            new = np.r_[True, (low[1:] != low[:-1]) | (own[1:] != own[:-1])]
            own, low = own[new], low[new]
    at = np.r_[0, np.cumsum(np.bincount(own, minlength=len(count)))]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(low.view(np.int64), pa.int64()))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points: a column of the table is two whole numbers, one bit a row (Myers, Hyyro)."""
    lo, end = 0, min(len(a), len(b))
    step = end
    while step:  # common beginning
        if a.startswith(b[lo : lo + step], lo) and lo + step <= end:
            lo += step
        else:
            step //= 2
    a, b = a[lo:], b[lo:]
    hi, end = 0, min(len(a), len(b))
    step = end
    while step:  # common end
        if hi + step <= end and a.endswith(b[len(b) - hi - step : len(b) - hi], 0, len(a) - hi):
            hi += step
        else:
            step //= 2
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    m = len(a)
    full, where = (1 << m) - 1, {}
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    for c in set(b):
        where[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    up, down = full, 0  # rows where the column rises and falls
    for c in b:
        eq = where[c]
        x = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = ((down | ((x | up) ^ full)) << 1 | 1) & full
        up, down = ((x & up) << 1 | ((x | plus) ^ full)) & full, x & plus
    return len(b) + up.bit_count() - down.bit_count()


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two token arrays without empty tokens; 0 if both are empty."""
    a, b = (F.filter(x, lambda t: t != "") for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in characters; 1 if both are empty."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def text_lines(text: Column) -> Column:
    """Lines of a text: a final line break adds none, an empty text has none."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def content_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters start..end (exclusive); nothing when out of range."""
    return F.when((start >= 0) & (start <= end) & (end <= F.char_length(text)), F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def preview(text: Column, lines: int = 3) -> Column:
    parts = F.split(text, "\n")
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(F.size(parts) > lines, "\n...").otherwise(""))


def span_length(start: Column, end: Column) -> Column:
    return end - start


def span_is_empty(start: Column, end: Column) -> Column:
    return start == end


def signature_hex(number: Column) -> Column:
    """A numeric hash as lower-case hexadecimal text."""
    return F.lower(F.hex(number))
