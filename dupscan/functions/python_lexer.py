"""Python source to token rows, with the standard library's tokenizer in Arrow batches."""

from __future__ import annotations

import io
import keyword
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYWORDS = frozenset(keyword.kwlist) - {"True", "False", "None"}
SOFT = frozenset(["match", "case", "type"])
DELIMITERS = frozenset("( ) [ ] { } , : ;".split())
LITERALS = frozenset(["NUMBER", "STRING", "FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END"])
SPACES = frozenset(["NEWLINE", "NL", "INDENT", "DEDENT"])
TOKENS = "file_id long, idx int, token_type string, value string, start long, end long, start_line int, end_line int, start_col int, end_col int"


class LexError(ValueError):
    """A file is no valid token sequence."""


def lex(source: str) -> list[tuple]:
    """(token_type, value, start, end, start_line, end_line, start_col, end_col) of each token; offsets and columns count
    characters, lines from 1, columns from 0.

    True, False and None are literals.  match, case and type are keywords only where they open a logical line and what
    follows is none of `= . , ) :`; a stray `$`, `?` or `!` is Unknown."""
    lines = source.splitlines(keepends=True) if "\r" not in source and "\f" not in source else io.StringIO(source, newline="").readlines()
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line))
    try:
        got = list(tokenize.generate_tokens(iter(lines).__next__ if lines else lambda: ""))
    except (tokenize.TokenError, IndentationError, SyntaxError) as e:
        raise LexError(str(e)) from e
    out, opens = [], True
    for k, t in enumerate(got):
        name = tokenize.tok_name[t.type]
        if name in ("ENDMARKER", "ENCODING"):
            continue
        if name in SPACES:
            kind = "Whitespace"
        elif name == "COMMENT":
            kind = "Comment"
        elif name in LITERALS:
            kind = "Literal"
        elif name == "NAME":
            after = got[k + 1].string if k + 1 < len(got) else ""
            if t.string in ("True", "False", "None"):
                kind = "Literal"
            elif t.string in KEYWORDS or t.string in SOFT and opens and after not in ("=", ".", ",", ")", ":"):
                kind = "Keyword"
            else:
                kind = "Identifier"
        elif name == "OP":
            kind = "Delimiter" if t.string in DELIMITERS else "Unknown" if t.string in ("$", "?", "!") else "Operator"
        else:
            kind = "Unknown"
        if kind not in ("Whitespace", "Comment"):
            opens = False
        elif name == "NEWLINE":
            opens = True
        at = [begins[min(r - 1, len(begins) - 1)] + c for r, c in (t.start, t.end)]
        out.append((kind, t.string, at[0], at[1], t.start[0], t.end[0], t.start[1], t.end[1]))
    return out


def python_tokens(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Token rows of FILES; with on_error = 'skip' a file that does not lex has none (see `lex_errors`)."""
    schema = pa.schema([("file_id", pa.int64()), ("idx", pa.int32()), ("token_type", pa.string()), ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((n, pa.int32()) for n in ("start_line", "end_line", "start_col", "end_col"))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for key, content in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                try:
                    rows = [(key, i, *t) for i, t in enumerate(lex(content or ""))]
                except LexError:
                    if on_error == "fail":
                        raise
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file_id", "content").mapInArrow(run, TOKENS)


def lex_errors(files: DataFrame) -> DataFrame:
    """(file_id, path, error) of files that do not lex."""
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            bad = []
            for key, path, content in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                try:
                    lex(content or "")
                except LexError as e:
                    bad.append((key, path, str(e)))
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*bad, strict=True), schema, strict=True)], schema=schema)

    return files.where((F.col("language") == "python") & F.col("content").isNotNull()).select("file_id", "path", "content").mapInArrow(run, "file_id long, path string, error string")
