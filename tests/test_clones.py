import random

import pytest
from pyspark.sql import functions as F

from dupscan.config import DetectionConfig
from dupscan.functions import text as T
from dupscan.operators import clones, similarity, stats, syntax
from dupscan.plans.detector import detect, total_clones
from dupscan.sources.files import FILES

TWO = '''"""Sums."""


# first

def plus(a, b):
    """Add."""
    total = a + b
    return total


def join(left, right):
    """Also add."""
    both = left + right
    return both
'''


def python(spark, *sources):
    return spark.createDataFrame([(i, f"f{i}.py", s, "python") for i, s in enumerate(sources)], FILES)


def test_two_renamed_functions(spark):
    found = detect(python(spark, TWO), DetectionConfig(min_tokens=5, min_lines=2))
    groups = found.groups.collect()
    assert len(groups) == 7 and {g["size"] for g in groups} == {2} and {g.clone_type for g in groups} == {"Type-2"}
    region = found.regions.collect()
    inside = [r for r in region if r.length >= 16]
    assert len(inside) == 1 and inside[0].length == 16 and not inside[0].overlaps
    lines = sorted((r.start_line, r.end_line) for r in found.instances.collect())
    assert all(6 <= a <= b <= 9 or 12 <= a <= b <= 15 for a, b in lines)
    assert total_clones(found.groups).first().asDict() == {"groups": 7, "instances": 14}


def test_equal_functions_are_type_1(spark):
    body = "def f(a, b):\n    c = a * b\n    return c - 1\n"
    groups = detect(python(spark, body, body), DetectionConfig(min_tokens=8, min_lines=1)).groups.collect()
    assert groups and {g.clone_type for g in groups} == {"Type-1"} and {g.similarity for g in groups} == {1.0}


def test_unmasked_finds_no_renamed_copies(spark):
    groups = detect(python(spark, TWO), DetectionConfig(min_tokens=8, min_lines=1, mask=False)).groups
    assert groups.count() == 0


def test_short_files_and_no_files(spark):
    short = "def foo(bar):\n    pass\n"
    assert detect(python(spark, short, short), DetectionConfig(min_tokens=10, min_lines=3)).groups.count() == 0
    none = spark.createDataFrame([], FILES)
    found = detect(none)
    assert found.groups.count() == 0 and found.regions.count() == 0 and found.similar.count() == 0
    assert stats.file_statistics(none).first().asDict() == {"total_files": 0, "total_bytes": 0, "total_lines": 0, "by_language": {}}


def test_unknown_language_fails(spark):
    files = spark.createDataFrame([(1, "x.zig", "a", "zig")], FILES)
    with pytest.raises(Exception, match="No tokenizer"):
        detect(files).groups.collect()
    assert detect(files, DetectionConfig(on_error="skip")).groups.count() == 0


def test_bad_file_fails_or_is_skipped(spark):
    files = python(spark, TWO, "(1,\n")
    with pytest.raises(Exception, match="LexError"):
        detect(files, DetectionConfig(min_tokens=5, min_lines=2)).groups.collect()
    assert detect(files, DetectionConfig(min_tokens=5, min_lines=2, on_error="skip")).groups.count() == 7


def test_windows_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) for _ in range(12)]
    files = spark.createDataFrame([(i, str(i), t, "text") for i, t in enumerate(texts)], FILES)
    width, seen = 4, {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - width + 1):
            seen.setdefault(tuple(w[p : p + width]), []).append((i, p))
    expected = sorted((len(v), len({f for f, _ in v}), *min(v)) for v in seen.values() if len(v) > 1)
    rows = clones.windows(clones.text_arrays(files), width)
    for parts in (1, 7):
        got = clones.candidates(rows.repartition(parts)).collect()
        assert sorted((r.n, r.n_files, r.first_file, r.first_pos) for r in got) == expected
    pairs = {(v[i], v[j]) for v in seen.values() for i in range(len(v)) for j in range(i + 1, len(v))}
    runs = clones.all_regions(clones.repeated(rows), width).collect()
    covered = {((r.file_a, r.pos_a + k), (r.file_b, r.pos_b + k)) for r in runs for k in range(r.length - width + 1)}
    assert covered == pairs


def test_regions_with_another_file_between(spark):
    """Files 1 and 3 share 30 tokens, file 2 six of them: one region of 30 for the pair."""
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    texts = {1: ["xa", *w, "ya"], 2: ["xb", *w[12:18], "yb"], 3: ["xc", *w, "yc"]}
    files = spark.createDataFrame([(i, str(i), " ".join(t), "text") for i, t in texts.items()], FILES)
    rows = clones.repeated(clones.windows(clones.text_arrays(files), 5))
    got = {(r.file_a, r.file_b): r.length for r in clones.regions(rows, 5).collect()}
    assert got[1, 3] == 30 and got[1, 2] == got[2, 3] == 6


def test_edit_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["né", "two", "three", "four", "5", "six!"]) for _ in range(rng.randrange(0, 14))) for _ in range(40)]
    texts += texts[:6]
    lex = lambda t: [x for x in __import__("regex").findall(r"[\p{L}_][\p{L}\p{N}_]*|[0-9]+|[^ ]", t)]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join(lex(t)), i)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    runs = lambda s: {tuple(s.split()[k : k + 4]) for k in range(len(s.split()) - 3)}
    expected = {(min(i, j), max(i, j)): round(1 - distance(a, b) / max(len(a), len(b)), 9) for a, i in first.items() for b, j in first.items() if i < j and runs(a) & runs(b)}
    expected = {k: v for k, v in expected.items() if v >= 0.5}
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    own = similarity.representatives(clones.text_arrays(files))
    sizes = own.select("file_id", F.char_length(T.normalized_string(F.col("norm"))).alias("n"))
    pairs = similarity.sharing_pairs(clones.repeated(clones.windows(own, 4)), sizes, 0.5)  # no more similar than their lengths
    got = similarity.similar_pairs(pairs, own, "levenshtein", 0.5).collect()
    assert {(r.file_a, r.file_b): round(r.similarity, 9) for r in got} == expected and len(expected) > 5


def test_min_lines_before_or_after_grouping(spark):
    files = python(spark, TWO)
    config = DetectionConfig(min_tokens=5, min_lines=2)
    after = {}
    for r in detect(files, config).windows.collect():
        after.setdefault(r.sig, []).append(r.end_line - r.start_line + 1)
    kept = {s: sum(n >= 2 for n in v) for s, v in after.items()}
    assert {g.sig: g["size"] for g in detect(files, config).groups.collect()} == {s: n for s, n in kept.items() if n > 1}


def test_similar_files_are_type_3(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    files = spark.createDataFrame([(1, "a", body, "text"), (2, "b", body + " mu", "text"), (3, "c", body, "text"), (4, "d", "nothing here", "text")], FILES)
    found = detect(files, DetectionConfig(min_tokens=5, min_lines=1, similarity_threshold=0.8, mask=False)).similar.collect()
    assert {(r.file_a, r.file_b) for r in found} == {(1, 2), (2, 3)} and all(r.similarity == pytest.approx(10 / 11) for r in found)


def test_similar_files_with_another_file_between(spark):
    """File 2 holds every window that 1 and 3 share inside a longer text; 1 and 3 are still compared."""
    body = [f"w{chr(97 + i)}" for i in range(20)]
    texts = {1: [*body, "xa"], 2: [*body, *(f"long{chr(97 + i)}" for i in range(20))], 3: [*body, "ya"]}
    files = spark.createDataFrame([(i, str(i), " ".join(w), "text") for i, w in texts.items()], FILES)
    found = detect(files, DetectionConfig(min_tokens=5, min_lines=1, similarity_threshold=0.85, mask=False)).similar.collect()
    assert {(r.file_a, r.file_b) for r in found} == {(1, 3)} and found[0].similarity == pytest.approx(20 / 22)


@pytest.mark.parametrize("block", [2, 512])
def test_near_files_equal_brute_force(spark, monkeypatch, block):
    """Groups of near copies and one common passage, in lists of one block and of many."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + ["é", "7", "x_1"]
    passage, texts = [rng.choice(words) for _ in range(9)], [None, "", "one two"]
    for _ in range(4):
        body = [rng.choice(words) for _ in range(rng.randrange(12, 60))]
        for _ in range(9):
            own = list(body)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own + passage * rng.randrange(2)))
    texts += [" ".join([rng.choice(words) for _ in range(rng.randrange(1, 40))] + passage) for _ in range(12)] + texts[5:9]
    width, lex = 8, [(t or "").split() for t in texts]
    first = {}
    for i, t in enumerate(lex):
        first.setdefault(tuple(t), i)
    runs = lambda t: {t[k : k + width] for k in range(len(t) - width + 1)}
    pairs = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for a, i in first.items() for b, j in first.items() if i < j and runs(a) & runs(b)}
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    for threshold in (0.0, 0.7, 0.85):
        expected = {k: v for k, v in pairs.items() if v >= threshold}
        got = similarity.near_files(files, width, threshold).collect()
        assert len(got) == len(expected) > 20 and {(r.file_a, r.file_b): r.similarity for r in got} == expected
    edits = {(r.file_a, r.file_b): r.similarity for r in similarity.near_files(files, width, 0.85, edits=True).collect()}
    both = spark.createDataFrame([(*k, " ".join(lex[k[0]]), " ".join(lex[k[1]])) for k in expected], "a long, b long, x string, y string")
    assert edits == {(r.a, r.b): pytest.approx(r.s) for r in both.select("a", "b", T.levenshtein_similarity(F.col("x"), F.col("y")).alias("s")).collect()}


def test_metric_registry(spark):
    similarity.register_metric("zero", lambda a, b: F.lit(0.0))
    arrays = spark.createDataFrame([(1, ["a"]), (2, ["a"])], "file_id long, norm array<string>")
    pairs = spark.createDataFrame([(1, 2)], "file_a long, file_b long")
    assert similarity.similar_pairs(pairs, arrays, "zero").first().similarity == 0.0


def test_syntax_trees(spark):
    tree = syntax.parse("def f(x):\n    return x\n")
    assert tree.get(tree.root).kind == "Module" and tree.get(99) is None
    assert len(syntax.Span(0, 10)) == 10 and not syntax.Span(0, 10).is_empty() and syntax.Span(3, 3).is_empty()
    t = syntax.Tree()
    at = t.add(syntax.Node(7, "If").with_text("x").with_children(1, 2))
    assert at == 0 and t.get(0).id == 0 and t.get(0).children == (1, 2) and t.get(0).text == "x"
    with pytest.raises(syntax.ParseError):
        syntax.parse("def invalid syntax here")
    nodes = syntax.python_nodes(python(spark, TWO))
    groups = syntax.subtree_groups(nodes, 5).collect()
    assert any(g.n == 2 for g in groups)
    assert nodes.where("parent_id is null").count() == 1


def test_config_values():
    assert DetectionConfig() == DetectionConfig.balanced()
    assert (DetectionConfig.precise().min_tokens, DetectionConfig.precise().similarity_threshold) == (30, 0.8)
    assert DetectionConfig.fast().mode.value == "fast"
    for bad in ({"min_tokens": 0}, {"mode": "odd"}, {"similarity_threshold": 2}, {"on_error": "x"}, {"min_lines": -1}):
        with pytest.raises(ValueError):
            DetectionConfig(**bad)


THREE = '''"""Processors."""


def first(rows):
    out = []
    for row in rows:
        if row > 1:
            out.append(row * 2)
    return out


def second(items):
    res = []
    for item in items:
        if item > 5:
            res.append(item * 3)
    return res


def third(values):
    acc = []
    for value in values:
        if value > 9:
            acc.append(value * 4)
    return acc
'''


def test_regions_keep_to_definitions(spark):
    config = DetectionConfig(min_tokens=8, min_lines=3)
    found = sorted((r.start_line, r.end_line, r.length, r.overlaps) for r in detect(python(spark, THREE), config).regions.collect())
    assert [f[:2] for f in found] == [(12, 17), (20, 25)] and {f[2] for f in found} == {30} and not any(f[3] for f in found)
    uncut = detect(python(spark, THREE), config.with_(whole_units=False)).regions.collect()
    assert max(r.length for r in uncut) > 30


def test_text_windows_equal_windows_located_by_joins(spark):
    texts = ["a b 1 c\nd, e", "x y 2 z\nd, e\n\nf", "", "a b"]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, content string")
    kept = clones.kept_tokens(clones.text_tokens(files, lower=True), mask=True)
    names = ["file_id", "pos", "sig", "raw_sig", "start", "end", "start_line", "end_line"]
    want = clones.located(clones.windows(clones.arrays(kept), 4, both=True), kept, 4).where("end_line > start_line")
    got = clones.text_windows(files, 4, mask=True, min_lines=2)
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect()) != []
