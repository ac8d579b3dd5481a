"""Token arrays, windows, groups of equal windows, instances and maximal regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dupscan.functions import text as T
from dupscan.functions.python_lexer import TOKENS, python_tokens

#: Columns of a token row.
TOKEN_COLUMNS = [c.split()[0] for c in TOKENS.split(", ")]


def text_tokens(files: DataFrame, lower: bool = False) -> DataFrame:
    """Token rows of the text lexer; positions are running sums, as its tokens cover the whole text.  Nothing is shuffled."""
    rows = _placed(files, lower).select("file_id", F.posexplode("t").alias("idx", "t")).select("file_id", "idx", "t.*")
    breaks = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit("\n"), F.lit("")))
    tail = F.char_length(F.substring_index("value", "\n", -1))
    rows = rows.withColumns({"_breaks": breaks, "end": F.col("start") + F.char_length("value"), "token_type": T.token_class(F.col("value"))})
    end_col = F.when(F.col("_breaks") > 0, tail).otherwise(F.col("start_col") + F.char_length("value"))
    return rows.withColumns({"end_line": (F.col("start_line") + F.col("_breaks")).cast("int"), "end_col": end_col.cast("int")}).select(*TOKEN_COLUMNS)


def _placed(files: DataFrame, lower: bool) -> DataFrame:
    """(file_id, t): for each file the array of its tokens, white space too, with value, start, start_line and start_col."""
    content = F.lower("content") if lower else F.col("content")
    rows = files.select("file_id", T.all_tokens(content).alias("value")).withColumn("p", T.places(F.col("value")))
    return rows.select("file_id", F.arrays_zip("value", F.col("p.start").alias("start"), F.col("p.line").alias("start_line"), F.col("p.col").alias("start_col")).alias("t"))


def text_windows(files: DataFrame, width: int, mask: bool = False, lower: bool = True, min_lines: int = 1) -> DataFrame:
    """Windows of the text lexer's tokens with signatures and true positions, of min_lines lines or more: no token rows and
    no joins on positions."""
    solid = F.filter("t", lambda x: ~x["value"].rlike(f"^[{T.SPACE}]"))
    k = _placed(files, lower).select("file_id", solid.alias("k")).where(F.size("k") >= width)
    raw = F.col("k")["value"]
    k = k.select("file_id", "k", raw.alias("raw"), (F.transform(raw, T.masked) if mask else raw).alias("norm"))
    sigs = {"sig": T.windows(F.col("norm"), width)} | ({"raw_sig": T.windows(F.col("raw"), width)} if mask else {})
    k = k.select("file_id", "k", *(c.alias(name) for name, c in sigs.items()))
    first, last = (lambda i: F.col("k")[i]), (lambda i: F.col("k")[i + (width - 1)])
    tall = F.filter(F.sequence(F.lit(0), F.size("k") - width), lambda i: T.line_count(first(i)["start_line"], last(i)["start_line"]) >= min_lines)

    def window(i):
        end = last(i)["start"] + F.char_length(last(i)["value"])
        return F.struct(i.alias("pos"), *(F.col(name)[i].alias(name) for name in sigs), first(i)["start"].alias("start"), end.alias("end"), first(i)["start_line"].alias("start_line"), last(i)["start_line"].alias("end_line"))

    rows = k.select("file_id", F.explode(F.transform(tall, window)).alias("w")).select("file_id", "w.*")
    return rows if mask else rows.withColumn("raw_sig", F.col("sig"))


#: Lexers by language; each maps (files, on_error) to token rows.
LEXERS = {"python": python_tokens, "text": lambda files, on_error="fail": text_tokens(files)}


def register_lexer(language: str, lexer) -> None:
    LEXERS[language] = lexer


def tokens_of(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Token rows of files, each by its language's lexer; another language is an error (or skipped)."""
    if on_error == "fail":
        known = F.col("language").isin(*LEXERS)
        files = files.withColumn("language", F.when(known, F.col("language")).otherwise(F.raise_error(F.concat(F.lit("No tokenizer for language: "), F.coalesce("language", F.lit("null"))))))
    out = None
    for language, lexer in LEXERS.items():
        part = lexer(files.where(F.col("language") == language), on_error)
        out = part if out is None else out.unionByName(part)
    return out


def kept_tokens(tokens: DataFrame, mask: bool = True, ignore_comments: bool = True, ignore_whitespace: bool = True) -> DataFrame:
    """Token rows that take part in windows, numbered by k, with their normalised value in norm."""
    out = [kind for kind, gone in (("Comment", ignore_comments), ("Whitespace", ignore_whitespace)) if gone]
    rows = tokens.where(~F.col("token_type").isin(*out)) if out else tokens
    norm = T.normalized(F.col("token_type"), F.col("value"), mask)
    norm = F.when(F.col("token_type").isin("Comment", "Whitespace"), F.col("value")).otherwise(norm)
    return rows.withColumn("norm", norm).withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("idx")) - 1)


def arrays(kept: DataFrame) -> DataFrame:
    """(file_id, norm, raw): the token arrays of each file."""
    one = kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("k", "norm", "value"))).alias("a"))
    return one.select("file_id", F.col("a.norm").alias("norm"), F.col("a.value").alias("raw"))


def text_arrays(files: DataFrame, mask: bool = False, lower: bool = True) -> DataFrame:
    """arrays() for the text lexer without token rows: nothing is shuffled."""
    content = F.lower("content") if lower else F.col("content")
    raw = files.select("file_id", T.solid_tokens(content).alias("raw"))
    return raw.select("file_id", (F.transform("raw", T.masked) if mask else F.col("raw")).alias("norm"), "raw")


def windows(token_arrays: DataFrame, width: int, both: bool = False) -> DataFrame:
    """(file_id, pos, sig) of every window of width tokens; with both also raw_sig, of the tokens as written."""
    if not both:
        return token_arrays.where(F.size("norm") >= width).select("file_id", F.posexplode(T.windows(F.col("norm"), width)).alias("pos", "sig"))
    pairs = F.arrays_zip(T.windows(F.col("norm"), width).alias("sig"), T.windows(F.col("raw"), width).alias("raw_sig"))
    rows = token_arrays.where(F.size("norm") >= width).select("file_id", F.posexplode(pairs).alias("pos", "w"))
    return rows.select("file_id", "pos", "w.sig", "w.raw_sig")


def repeated(rows: DataFrame, by: str = "sig") -> DataFrame:
    """Window rows whose signature occurs more than once.  Singletons, most rows, never reach a list or a second shuffle
    with their payload: partial counts come first."""
    return rows.join(rows.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by), by, "left_semi")


def candidates(rows: DataFrame) -> DataFrame:
    """(sig, n, n_files, first_file, first_pos) of signatures that occur more than once."""
    agg = rows.groupBy("sig").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"), F.min(F.struct("file_id", "pos")).alias("f")).where("n > 1")
    return agg.select("sig", "n", "n_files", F.col("f.file_id").alias("first_file"), F.col("f.pos").cast("long").alias("first_pos"))


def located(rows: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """Window rows with the true positions of their first and last token."""
    first = kept.select("file_id", F.col("k").alias("pos"), "start", "start_line", "start_col")
    last = kept.select("file_id", (F.col("k") - (width - 1)).alias("pos"), "end", "end_line", "end_col")
    return rows.join(first, ["file_id", "pos"]).join(last, ["file_id", "pos"])


def within_units(rows: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """Window rows that lie in one unit: units begin at keywords of definitions in column 0, as else equal beginnings of
    neighbouring definitions would run on into each other's matches."""
    opens = (F.col("token_type") == "Keyword") & F.col("value").isin("def", "class", "async") & (F.col("start_col") == 0)
    units = kept.select("file_id", "k", F.sum(opens.cast("int")).over(Window.partitionBy("file_id").orderBy("k")).alias("unit"))
    first = units.select("file_id", F.col("k").alias("pos"), F.col("unit").alias("_u"))
    last = units.select("file_id", (F.col("k") - (width - 1)).alias("pos"), F.col("unit").alias("_v"))
    return rows.join(first, ["file_id", "pos"]).join(last, ["file_id", "pos"]).where("_u = _v").drop("_u", "_v")


def with_min_lines(rows: DataFrame, min_lines: int) -> DataFrame:
    """Rows of min_lines lines or more whose signature still occurs more than once among them."""
    return repeated(rows.where(T.line_count(F.col("start_line"), F.col("end_line")) >= min_lines))


def groups(rows: DataFrame) -> DataFrame:
    """(sig, clone_type, similarity, size, avg_lines): Type-1 where all instances have one raw signature, else Type-2."""
    agg = rows.groupBy("sig").agg(F.count("*").alias("size"), F.sum(T.line_count(F.col("start_line"), F.col("end_line"))).alias("_lines"), F.min("raw_sig").alias("_x"), F.max("raw_sig").alias("_y")).where("size > 1")
    kind = F.when(F.col("_x") == F.col("_y"), "Type-1").otherwise("Type-2")
    return agg.select("sig", kind.alias("clone_type"), F.lit(1.0).alias("similarity"), "size", (F.col("_lines").cast("double") / F.col("size")).alias("avg_lines"))


def instances(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with path and content of each instance; contents are fetched for surviving instances only."""
    return rows.join(files.select("file_id", "path", F.col("content").alias("_c")), "file_id").withColumn("content", T.content_slice(F.col("_c"), F.col("start"), F.col("end"))).drop("_c")


def regions(rows: DataFrame, width: int, bridge: int | None = None) -> DataFrame:
    """(file_a, pos_a, file_b, pos_b, length, overlaps): stretches of equal tokens, per pair of files and diagonal.

    Each window meets the previous and next one of its signature in (file, pos) order only, so a signature that occurs m
    times makes m - 1 pairs; every occurrence lies in a region with its neighbours.  Where another file comes between two
    files for a while, their windows on both sides still make one region if these overlap or touch, as then all tokens
    between them are equal; a longer part stands in the regions with that other file.  bridge: how far apart two windows
    of a region may begin, width if not given; 1 where rows lack windows on purpose.  For all pairs see `all_regions`."""
    order = Window.partitionBy("sig").orderBy("file_id", "pos")
    pairs = rows.select("sig", F.lag("file_id").over(order).alias("file_a"), F.lag("pos").over(order).alias("pos_a"), F.col("file_id").alias("file_b"), F.col("pos").alias("pos_b")).where("file_a is not null")
    return _islands(pairs, width, width if bridge is None else bridge)


def all_regions(rows: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """regions() over all pairs of a signature's windows; with `most` only of signatures that occur at most so often (the
    others stay with `regions`)."""
    if most is not None:
        rows = rows.join(rows.groupBy("sig").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("sig"), "sig", "left_semi")
    a = rows.select("sig", F.col("file_id").alias("file_a"), F.col("pos").alias("pos_a"))
    b = rows.select("sig", F.col("file_id").alias("file_b"), F.col("pos").alias("pos_b"))
    return _islands(a.join(b, "sig").where("file_a < file_b or file_a = file_b and pos_a < pos_b"), width, width)


def _islands(pairs: DataFrame, width: int, bridge: int) -> DataFrame:
    """Runs of windows on a diagonal, each at most `bridge` after the one before (gaps and islands)."""
    pairs = pairs.withColumn("diagonal", F.col("pos_b") - F.col("pos_a"))
    order = Window.partitionBy("file_a", "file_b", "diagonal").orderBy("pos_a")
    opens = F.coalesce(F.col("pos_a") > F.lag("pos_a").over(order) + bridge, F.lit(True)).cast("int")
    runs = pairs.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order))
    out = runs.groupBy("file_a", "file_b", "diagonal", "island").agg(F.min("pos_a").cast("long").alias("pos_a"), F.min("pos_b").cast("long").alias("pos_b"), (F.max("pos_a") - F.min("pos_a") + width).cast("long").alias("length"))
    overlaps = (F.col("file_a") == F.col("file_b")) & (F.col("pos_b") < F.col("pos_a") + F.col("length"))
    return out.select("file_a", "pos_a", "file_b", "pos_b", "length", overlaps.alias("overlaps"))


def exact_duplicates(token_arrays: DataFrame) -> DataFrame:
    """(fingerprint, n, first_file) of whole token sequences that several files have."""
    prints = token_arrays.select("file_id", T.fingerprint(F.col("norm")).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("file_id").alias("first_file")).where("n > 1")
