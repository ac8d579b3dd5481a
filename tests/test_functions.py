import pytest
from pyspark.sql import functions as F

from dupscan.functions import text as T
from dupscan.functions.python_lexer import LexError, lex
from dupscan.operators import clones
from dupscan.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [(("def", "foo"), ("foo", "def"), 1.0), (("def",), ("class",), 0.0), (("a", "b"), ("b", "c"), 1 / 3), ((), (), 0.0), (("", "a"), ("a",), 1.0)],
)
def test_jaccard(spark, a, b, expected):
    assert one(spark, T.jaccard(arr(*a), arr(*b))) == pytest.approx(expected)


@pytest.mark.parametrize(("a", "b", "expected"), [("kitten", "sitting", 1 - 3 / 7), ("hello", "hello", 1.0), ("", "", 1.0), ("café", "cafe", 0.75), ("", "ab", 0.0)])
def test_levenshtein(spark, a, b, expected):
    assert one(spark, T.levenshtein_similarity(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_fingerprint_depends_on_order(spark):
    prints = [one(spark, T.fingerprint(arr(*x))) for x in (("a", "b"), ("a", "b"), ("b", "a"))]
    assert prints[0] == prints[1] != prints[2]


def test_rolling_windows(spark):
    got = one(spark, T.windows(arr("def", "foo", "bar", "baz"), 3))
    assert len(got) == 2 and got[0] != got[1]
    got = one(spark, T.windows(arr("X", "Y", "X", "Y", "X"), 2))
    assert got[0] == got[2] and got[1] == got[3]
    assert one(spark, T.windows(arr("a"), 3)) == []
    h = one(spark, T.rolling_hash(arr("世界", "你好")))
    assert 0 <= h < T.MODULUS
    first, second = (one(spark, T.hash_string(F.lit(x))) for x in ("世界", "你好"))
    assert h == (first * T.BASE + second) % T.MODULUS


@pytest.mark.parametrize(("start", "end", "expected"), [(0, 10, "def foo():"), (0, 100, ""), (4, 7, "foo"), (3, 3, ""), (5, 2, "")])
def test_content_slice(spark, start, end, expected):
    assert one(spark, T.content_slice(F.lit("def foo():\n    return 42"), F.lit(start), F.lit(end))) == expected


@pytest.mark.parametrize(("text", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("a\n\n", 2)])
def test_text_lines(spark, text, lines):
    assert one(spark, T.text_lines(F.lit(text))) == lines


def test_line_count_span_preview(spark):
    assert one(spark, T.line_count(F.lit(10), F.lit(15))) == 6
    assert one(spark, T.line_count(F.lit(5), F.lit(5))) == 1
    assert one(spark, T.span_length(F.lit(0), F.lit(10))) == 10
    assert one(spark, T.span_is_empty(F.lit(3), F.lit(3)))
    assert one(spark, T.preview(F.lit("a\nb\nc\nd"))) == "a\nb\nc\n..."
    assert one(spark, T.preview(F.lit("a\nb"))) == "a\nb"
    assert one(spark, T.signature_hex(F.lit(255))) == "ff"


def test_normalized(spark):
    rows = spark.createDataFrame([(1, i, k, v, 0, 0, 1, 1, 0, 0) for i, (k, v) in enumerate([("Keyword", "def"), ("Comment", "# c"), ("Identifier", "foo"), ("Whitespace", "\n"), ("Literal", "42")])], "file_id long, idx int, token_type string, value string, start long, end long, start_line int, end_line int, start_col int, end_col int")
    assert clones.arrays(clones.kept_tokens(rows)).first().norm == ["def", "$ID", "$LIT"]
    assert clones.arrays(clones.kept_tokens(rows, mask=False)).first().norm == ["def", "foo", "42"]
    assert clones.arrays(clones.kept_tokens(rows, ignore_comments=False)).first().norm == ["def", "# c", "$ID", "$LIT"]


@pytest.mark.parametrize(
    ("path", "extension", "language", "hidden", "skipped", "reachable"),
    [
        ("a/x.py", "py", "python", False, False, True),
        ("x.js", "js", "javascript", False, False, True),
        ("x.rs", "rs", "rust", False, False, True),
        ("x.unknown", "unknown", "unknown", False, False, True),
        (".hidden", None, "unknown", True, False, False),
        ("node_modules/x.py", "py", "python", False, False, False),
        ("src/build", None, "unknown", False, True, False),
        ("Makefile", None, "unknown", False, False, True),
        ("a.b/__init__.py", "py", "python", False, False, True),
        ("x.PY", "PY", "unknown", False, False, True),
    ],
)
def test_paths(spark, path, extension, language, hidden, skipped, reachable):
    p = F.lit(path)
    row = spark.range(1).select(S.extension(p).alias("e"), S.language_of(p).alias("l"), S.is_hidden(p).alias("h"), S.is_skipped(p).alias("s"), S.reachable(p).alias("r"), S.included(p, ["py"]).alias("i"), S.included(p, []).alias("a")).first()
    assert (row.e, row.l, row.h, row.s, row.r) == (extension, language, hidden, skipped, reachable)
    assert row.i == (extension == "py") and row.a


def test_lexer_classes_and_positions():
    source = "def f(x):\n    # note\n    return x + 42 if x is not None else match\n"
    tokens = lex(source)
    assert all(source[t[2] : t[3]] == t[1] for t in tokens if t[1].strip())
    kinds = {t[1]: t[0] for t in tokens}
    assert [kinds[x] for x in ("def", "f", "(", "# note", "return", "+", "42", "None", "is", "match")] == ["Keyword", "Identifier", "Delimiter", "Comment", "Keyword", "Operator", "Literal", "Literal", "Keyword", "Identifier"]
    ret = next(t for t in tokens if t[1] == "return")
    assert ret[4:] == (3, 3, 4, 10)


def test_lexer_soft_keywords_strings_errors():
    kinds = [t[0] for t in lex("match x:\n    case 1:\n        type = 2\n") if t[1] in ("match", "case", "type")]
    assert kinds == ["Keyword", "Keyword", "Identifier"]
    assert {t[0] for t in lex("f'a{b}c'\n") if t[1].strip()} >= {"Literal", "Identifier", "Delimiter"}
    assert next(t[0] for t in lex("a ? b\n") if t[1] == "?") == "Unknown"
    assert lex("") == []
    with pytest.raises(LexError):
        lex("(1,\n")
    with pytest.raises(LexError):
        lex("if x:\n        a\n    b\n")


def test_text_tokens_cover_the_text(spark):
    text = "Ab1 cd\n\n  42, é!\tx\n_y"
    files = spark.createDataFrame([(1, "p", text, "text"), (2, "q", "", "text")], S.FILES)
    got = [r.asDict() for r in clones.text_tokens(files).orderBy("file_id", "idx").collect()]
    assert "".join(t["value"] for t in got) == text
    for t in got:
        assert text[t["start"] : t["end"]] == t["value"]
        before = text[: t["start"]]
        assert t["start_line"] == before.count("\n") + 1
        assert t["start_col"] == len(before) - (before.rfind("\n") + 1)
        until = text[: t["end"]]
        assert (t["end_line"], t["end_col"]) == (until.count("\n") + 1, len(until) - (until.rfind("\n") + 1))


def test_places_of_tokens_in_several_texts(spark):
    texts = ["", "a\n\n b", "\n", "é x\ny  \n z", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1).select("i", "t", T.all_tokens(F.col("t")).alias("k"))
    got = rows.select("t", "k", T.places(F.col("k")).alias("p")).collect()
    assert len(got) == len(texts)
    for text, tokens, p in got:
        at = 0
        assert len(tokens) == len(p.start) == len(p.line) == len(p.col)
        for token, start, line, col in zip(tokens, p.start, p.line, p.col, strict=True):
            assert (start, line, col) == (at, text[:at].count("\n") + 1, at - (text[:at].rfind("\n") + 1))
            at += len(token)
