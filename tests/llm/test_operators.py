"""Each operator against brute force, a round trip, or held-out accuracy, with odd inputs."""

import collections
import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupscan.llm import chat_format, decontaminate, embedding_dedup, html_extract, jaccard_join, packing, quality, queries, sharding, substring_dedup, url_filter
from dupscan.llm.shared import components, ngrams, shingle_sets, text_blocks, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=True):
    """Rows of documents from texts or (id, text) pairs; with a column whose name clashes with operators' own."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    return df.withColumns({"key": F.lit(1), "name": F.lit("x"), "size": F.lit(2), "score": F.lit(0.1), "shard": F.lit(3), "n_words": F.lit(4)}) if extra else df


def odd_texts():
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(6000))
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    near = []
    for k in range(12):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
        near.append(" ".join(w))
    return [None, "", "  \n\t", "a", "a b", "A B", "a b c d", "a b c d e", long, long, *near, base[0], "é ß ñ 世界", *["same text here for all of us"] * 6]


def shingles(text, n):
    w = words(text, True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def test_word_hashes_and_ngrams():
    import pyarrow as pa

    texts = ["a bb  a\n", None, "bb a", "", "x", "Éa éA", " lead"]
    got = [t.words(i).tolist() for t in text_blocks(pa.array(texts)) for i in range(len(t.rows))]
    flat = {}
    for text, hashes in zip(texts, got, strict=True):
        w = words(text)
        assert len(w) == len(hashes)
        for x, h in zip(w, hashes, strict=True):
            assert flat.setdefault(x, h) == h
    assert len(set(flat.values())) == len(flat)
    h = np.arange(50, dtype=np.uint64)
    for n in (1, 2, 3, 7, 16, 50):
        g = ngrams(h, n)
        assert len(g) == 51 - n and (ngrams(h[5 : 5 + n], n) == g[5]).all() if n <= 45 else len(g) == 51 - n
    block = next(iter(text_blocks(pa.array(["a b c", "a b"]))))
    assert [len(s) for s in shingle_sets(block, 2)] == [2, 1]


def abba():
    """Two words of 1,024 letters that a polynomial hash modulo a power of two takes for one."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_differ_have_hashes_that_differ():
    import pyarrow as pa

    rng = random.Random(2)
    some = {"".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)} | set(abba()) | {"x" * k for k in range(1, 300)}
    some = sorted(w for w in some if w.split() == [w])
    t = next(iter(text_blocks(pa.array([" ".join(some)]))))
    assert len(t.hashes) == len(some) == len(set(t.hashes.tolist()))
    again = [next(iter(text_blocks(pa.array([f" {w}\n"])))).hashes.tolist() for w in some[::50]]
    assert again == [[h] for h in t.hashes.tolist()[::50]]


def test_operators_tell_long_words_apart(spark):
    a, b = abba()
    texts = [f"{a} one two three four five", f"{b} one two three four five"]
    docs = documents(spark, texts, extra=False)
    assert {r.component_id for r in jaccard_join.jaccard_classes(docs, n=6).collect()} == {0, 1}
    assert {r.n_removed for r in substring_dedup.dedup_substrings(docs, length=6).collect()} == {0}
    items = spark.createDataFrame([(1, f"{a}")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items, least_words=1).collect()} == {0}
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, path, capacity=4096).collect()}
    ids = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert got == {k: zlib.crc32(np.array(i, "<u4").tobytes()) for k, i in enumerate(ids)}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


@pytest.mark.parametrize(("n", "percent", "light"), [(4, 85, None), (5, 80, None), (4, 85, 30), (2, 80, 200)])
def test_jaccard_classes(spark, n, percent, light):
    rows = list(enumerate(odd_texts()))
    got = jaccard_join.jaccard_classes(documents(spark, rows), n=n, percent=percent, light_below=light).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, n, percent)


@pytest.mark.parametrize("part", [4096, 5])
def test_jaccard_long_lists_and_blocks(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard_join, "LONG", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(100)] = f"z{rng.randrange(12)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_classes(documents(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, 4, 85)


def near_group(sets, most, seed=3):
    """Texts of one base with up to `most` of its 200 words changed, so that most are near several others, linked or not."""
    rng = random.Random(seed)
    texts = []
    for k in range(sets):
        w = [f"b{i}" for i in range(200)]
        for _ in range(rng.randrange(most)):
            w[rng.randrange(200)] = f"z{k}x{rng.randrange(10**6)}"
        texts.append(" ".join(w[: 200 - rng.randrange(40)]))
    return list(enumerate(texts))


def test_jaccard_group_of_several_hubs_makes_few_pairs(spark, monkeypatch):
    """One group of near copies whose lists have several hubs: the pairs made grow with the sets, not with their square."""
    made = []

    def counted(df, *done):
        out = cut(df, *done)
        if out.columns == ["a", "b", "sa", "sb"]:
            made.append(out.count())
        return out

    cut = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", counted)
    rows = near_group(600, 9)
    got = jaccard_join.jaccard_classes(documents(spark, rows), n=5, percent=80).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, 5, 80)
    assert made and max(made) <= 2 * len(rows)


@pytest.mark.parametrize(("long", "part"), [(3, 4096), (3, 5), (10**6, 4096)])
def test_jaccard_hubs_of_long_lists_lose_no_link(spark, monkeypatch, long, part):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "PAIRS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "PART", part)
    rows = near_group(150, 9, seed=4)
    got = jaccard_join.jaccard_classes(documents(spark, rows), n=5, percent=80).collect()
    assert sorted(tuple(r) for r in got) == classes(rows, 5, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_jaccard_least_need_equals_brute_force(spark, percent):
    def need(a, b):
        least = -(-percent * (a + b) // (100 + percent))
        return max(1, least - -(-percent * max(a, b) // 100) + 1)

    sizes = range(2, 121)
    rows = [(n, lo, hi) for n in sizes for lo in range(-(-percent * n // 100), n + 1) for hi in range(n, 100 * n // percent + 1)]
    got = spark.createDataFrame(rows, "n long, lo long, hi long").withColumn("c", jaccard_join.least_need(F.col("n"), F.col("lo"), F.col("hi"), percent)).collect()
    assert all(0 <= min(need(r.n, b) for b in range(r.lo, r.hi + 1)) - r.c <= 1 and r.c >= 1 for r in got)


def test_jaccard_pair_that_shares_just_the_needed_keys(spark):
    """apart() alone, on lists where the key that a pair shares is the longest of each set's: sizes 18 and 19 need one."""
    lists = {1: [(1, 18), (2, 18)], 2: [(1, 18), (3, 20)], 3: [(4, 19), (5, 18)], 4: [(4, 19), (6, 20)], 9: [(1, 18), (4, 19), (7, 20), (8, 20)]}
    rows = [(key, None, name, size, False, len(members)) for key, members in lists.items() for name, size in members]
    posts = spark.createDataFrame(rows, "key long, whole long, name long, size long, light boolean, len long")
    assert (1, 4) in {tuple(r) for r in jaccard_join.apart(posts, None, None, 85).collect()}


def test_jaccard_odd_rows(spark):
    empty = documents(spark, [])
    assert jaccard_join.jaccard_classes(empty).count() == 0
    rows = [(5, "p q r s t u"), (None, "p q r s t u"), (5, "p q r s t u"), (2, "p q r s t u"), (None, None), (5, "other words are here now")]
    got = jaccard_join.jaccard_classes(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(False, 2, 3, 2), (False, 5, 2, 5), (False, 5, 3, 2), (False, 5, 3, 2), (True, 0, 0, 0), (True, 0, 3, 0)]


def removed(rows, length):
    first = {}
    for key, t in rows:
        w = words(t)
        if key is not None:
            for i in range(len(w) - length + 1):
                g = tuple(w[i : i + length])
                first[g] = min(first.get(g, key), key)
    out = []
    for key, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if key is not None and first[tuple(w[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if key is None else key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("shard", "part"), [(256, 4096), (2, 4096), (2, 15), (256, 2), (2, 2)])
def test_substring_dedup(spark, monkeypatch, shard, part):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "PART", part)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(14)]
    rows = []
    for k in range(40):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        a, b = sorted(rng.sample(range(15), 2))
        rows.append((rng.randrange(30), " ".join(w[:5] + passage[a:b] + w[5:] + (passage if rng.random() < 0.2 else []))))
    rows += [(None, " ".join(passage)), (99, None), (98, ""), (97, "a " * 300), (96, "a " * 300), (3, " ".join(passage * 3))]
    got = substring_dedup.kept_digests(substring_dedup.dedup_substrings(documents(spark, rows), length=8)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == removed(rows, 8)


def test_substring_dedup_keeps_columns_and_clean_texts(spark):
    docs = documents(spark, ["one  two\nthree", None], extra=False)
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    assert {r.text for r in out.collect()} == {"one  two\nthree", None}
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_suffix_automaton():
    rng = random.Random(6)
    seqs = [[rng.choice("ab") for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    auto = substring_dedup.Automaton()
    for k, s in enumerate(seqs):
        auto.add(s, k)
    auto.settle()
    for s in [*seqs, list("abbaabab")]:
        for n in (2, 3, 4):
            expected = [min((k for k, t in enumerate(seqs) for j in range(len(t) - n + 1) if t[j : j + n] == s[i : i + n]), default=substring_dedup.FAR) for i in range(len(s) - n + 1)]
            assert auto.least_owners(s, n) == expected


def test_chat_round_trip(spark):
    texts = ["hi", "", None, "<|end|>\n", "\\", "\\<|user|>\n", "[/INST]</s>", "a\nb", "😀é"]
    rows, expected = [], {}
    for c in range(6):
        turns = [(random.Random(c * 10 + k).choice(["user", "assistant", "system", "tool", None, "we<|ird"]), texts[(c + k) % len(texts)]) for k in range(c + 1)]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
        plain = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in plain if r == "assistant")
        expected[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    assert got == expected
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_states_and_other_template(spark):
    order = {0: ["system", "user", "assistant"], 1: ["assistant", "user"], 2: ["user", "user"], 3: ["user", "assistant", "tool", "assistant", "user"]}
    df = spark.createDataFrame([(c, k, r, f"t{k}") for c, rs in order.items() for k, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    own = chat_format.Template(opening="[{role}]", closing="[/]", learns=frozenset({"user"}), guarded="[]")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(df, own), own).collect()}
    assert {c: r.valid for c, r in got.items()} == {0: True, 1: False, 2: False, 3: True}
    assert got[2].loss_chars == 4
    whole = "".join(t for r, x in (("user", "a[b]\\"), ("x]", "")) for t, _ in own.segments(r, x))
    assert own.read(whole) == [("user", "a[b]\\"), ("x]", "")]
    with pytest.raises(ValueError):
        own.read("[user]x")


def test_packing(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    made = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", ",", "!!", "'s", "***", "''t"]) for _ in range(rng.randrange(0, 120))) for _ in range(80)]
    texts = [None, "", "The <|endoftext|> end", "ΣΑΣ İi J\u030c É e\u0301", "a\u00a0b\tc  12½", *made, "word " * 700]
    docs = documents(spark, texts)
    got = packing.pack(docs, path, capacity=64).collect()
    expected = []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            p = np.array(ids[a : a + 64], "<u4")
            expected.append((i, k, a, len(p), zlib.crc32(p.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * sum(e[3] for e in expected) / 64 + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_genetic_packing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400).tolist()
    plain = packing.best_fit(sizes, sorted(range(400), key=sizes.__getitem__, reverse=True), 100)
    best = packing.evolve(sizes, 100, 7)
    assert sorted(i for b in best for i in b) == list(range(400)) and max(packing.fills(sizes, best)) <= 100
    assert packing.fitness(sizes, best, 100) <= packing.fitness(sizes, plain, 100)
    child = packing.crossover(sizes, plain, best, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(400)) and max(packing.fills(sizes, child)) <= 100
    assert packing.evolve([], 100, 1) == []


def test_genetic_packing_beats_best_fit():
    """Sets of three that fill a sequence exactly: best-fit misses the bound, breeding comes nearer."""
    rng = random.Random(3)
    sizes = []
    for _ in range(40):
        a, b = rng.randrange(380, 490), rng.randrange(255, 300)
        sizes += [a, b, 1000 - a - b]
    plain = packing.best_fit(sizes, sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), 1000)
    best = packing.evolve(sizes, 1000, 5, generations=150)
    assert len(plain) > 40 and len(best) < len(plain)
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and max(packing.fills(sizes, best)) <= 1000


def test_packing_levels_end(spark, monkeypatch):
    """Pieces of which no two fit together: no level saves a sequence, and packing ends with one for each."""
    monkeypatch.setattr(packing, "GROUP", 10)
    texts = ["word " * (40 + k % 3) for k in range(60)]
    got = packing.pack(documents(spark, texts), queries.tokenizer("word_bpe_49k.json"), capacity=64).collect()
    assert len(got) == 60 == len({r.sequence_id for r in got}) and {r.offset for r in got} == {0}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    rows = []
    for i in range(200):
        v = centre[i % 12] + rng.standard_normal(16) * [0.02, 0.05, 0.08, 1.0][i % 4]
        rows.append((i, [float(x) for x in v], i % 2 if i % 17 else None))
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None] * 16, 0), (303, [float("nan")] * 16, 0), (304, [float("inf")] * 16, 1), (305, rows[1][1], 1), (306, rows[1][1], 1), (1, rows[1][1], 1), (307, [x * 3 for x in rows[1][1]], 1), (308, [1.0, 2.0], 1), (309, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1))
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(list)
    for a, b in combinations(good, 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links[a].append(b)
            links[b].append(a)
    expected = []
    for k, (key, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        expected.append((key, len(links[k]), least, key == least))
    got = embedding_dedup.cosine_classes(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert embedding_dedup.cosine_classes(df.limit(0)).count() == 0


def test_rotated_codes_estimate_without_bias():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64))
    o = embedding_dedup.unit(x)
    turn = embedding_dedup.rotation(64)
    code, f = embedding_dedup.encode(o, turn)
    assert code.shape == (300, 8) and np.allclose(np.linalg.norm(turn, axis=0), 1)
    corner, z = embedding_dedup.corners(code), (o @ turn.T).astype(np.float32)
    estimate = corner @ z.T / f[:, None]
    error = (estimate - o @ o.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 0.004 and error.std() < 0.11
    least = embedding_dedup.least_estimate(f, 64, 0.98)
    assert len(embedding_dedup.candidates(corner, z, least, corner, z, least)[0]) < 300 * 300 / 20


def test_codes_lose_no_pair_near_the_threshold():
    """Pairs at a cosine of 0.98 to 0.985, the hardest ones: recall against brute force."""
    rng = np.random.default_rng(9)
    a = embedding_dedup.unit(rng.standard_normal((20_000, 64)))
    side = rng.standard_normal((20_000, 64))
    side = embedding_dedup.unit(side - (side * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.98, 0.985, (20_000, 1))
    b = a * cosine + side * np.sqrt(1 - cosine**2)
    turn = embedding_dedup.rotation(64)
    found = 0
    for k in range(0, 20_000, 500):
        own = []
        for v in (a[k : k + 500], b[k : k + 500]):
            code, f = embedding_dedup.encode(v, turn)
            own += [embedding_dedup.corners(code), (v @ turn.T).astype(np.float32), embedding_dedup.least_estimate(f, 64, 0.98)]
        i, j = embedding_dedup.candidates(*own)
        found += int((i == j).sum())
    assert found >= 0.9995 * 20_000


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>
<main><article class="post"><h1>Main &amp; title</h1><p>One <b>two</b><br>three &#233;&nbsp;x<p>Unclosed
 paragraph</p><script>var a = "</p>";</script><div id="cookie-notice">We use cookies</div>
<aside>side</aside><form><p>mail</p></form><ul><li>a<li>b</ul><section class="comments"><p>nice!</p></section></article></main>
<footer>&copy; us</footer></body></html>"""


def test_html_structure(spark):
    rows = [(1, "http://h.example/a", HTML), (2, None, None), (3, "x", ""), (1, "http://h.example/a", HTML)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    main = "Main & title\nOne two three é x\nUnclosed paragraph\na\nb"
    assert got == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "SHARD", 20)
    page = "<html><body><div>Home About Contact News Sport Weather Here</div><p>{0} {1} {2}</p><div>All rights reserved by the owners of this site</div></body></html>"
    rows = [(k, f"http://a.example/{k}", page.format(f"x{k}", f"y{k}", f"z{k}")) for k in range(30)]
    rows += [(100 + k, f"http://b.example/{k}", "<p>the very same page on this host twice over</p>") for k in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"x{k} y{k} z{k}" for k in range(30))
    assert all(got[100 + k] == "the very same page on this host twice over" for k in range(4))


def plain_blocks(page):
    found = html_extract.blocks(page)
    core = any(k == html_extract.CORE for _, k in found)
    return [t for t, k in found if k == (html_extract.CORE if core else html_extract.LOOSE)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<script>for(i=0;i<n;i++){f(i)}</script><p>after", ["after"]),
        ("<script>a='</p>'; // <!--</script ><p>after", ["after"]),
        ("<html><head><title>x</title><body><p>no end of the head", ["no end of the head"]),
        ("<head><meta charset=x>text ends it<p>b", ["text ends it", "b"]),
        ('<article><p class="ad">buy</p><p>b</p></article>', ["b"]),
        ("<a href=/o'brien>hello</a> there <b>it's</b> done", ["hello there it's done"]),
        ('<p title="5" tall">hello', ["hello"]),
        ("<p title='a>b' x=\"c>d\">e<p title=never closed", ["e"]),
        ('<article><div class="social-history">a</div><section id="related-work">b</section><h2 id="comments">c</h2></article>', ["a", "b", "c"]),
        ("<article><div class='ad-slot'>x</div><div class='comment-list'>y</div><p>z</p></article>", ["z"]),
        (f"<p>{'the story ' * 20}</p><article>teaser</article>", [("the story " * 20).strip(), "teaser"]),
        ("<p>a < b &amp; c</p><!-- no --><![CDATA[raw &amp; x]]></>y<?no?><!doctype no>", ["a < b & c", "raw &amp; x y"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><svg><text>no</text></svg>e<textarea><p>no</textarea>f", ["a", "b", "c", "d", "ef"]),
        ("<div hidden>no</div><nav><p>no<footer>no</footer></nav><p>yes<header>no</header>", ["yes"]),
        ("", []),
    ],
)
def test_html_blocks(page, expected):
    got = plain_blocks(page)
    assert [" ".join(t.split()) for t in got] == expected or [t.replace(" ", "") for t in got] == [t.replace(" ", "") for t in expected]


def test_html_long_page_null_url_and_clashing_columns(spark):
    page = "<article>" + "".join(f"<p>w{k} x{k}" for k in range(60_000)) + "</article>"
    df = spark.createDataFrame([(1, None, page), (2, None, None)], "page_id long, url string, html string").withColumns({"whole": F.lit(1), "run": F.lit(2), "n_chars": F.lit(3)})
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "\n".join(f"w{k} x{k}" for k in range(60_000)) and got[1].n_chars == len(got[1].text) and got[2].text == ""


def test_html_boilerplate_inside_articles(spark):
    """A line below each article goes, the title that other pages link to and articles that several pages carry stay."""
    line = "write to us if you know more about this story"
    title = "one title of many words that others link to"
    page = "<div>{2}</div><article><h1>{0}</h1><p>{1}</p><p>" + line + "</p></article><p>" + line + "</p>"
    copied = "a passage that three articles of one host have in common word by word"
    rows = [(k, "http://a.example/", page.format(title if k == 0 else f"t{k}", copied if k < 4 else f"u{k} v{k} and much more of the story of page {k}", title if k else "x")) for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == f"{title}\n{copied}" and got[3] == f"t3\n{copied}"
    assert got[5] == "t5\nu5 v5 and much more of the story of page 5"


def test_html_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    """Boilerplate on few of many pages of a host goes however the pages are dealt, as one suffix array over all has it."""
    monkeypatch.setattr(html_extract, "SHARD", 4)
    line = "all rights reserved by the owners of this site"
    rows = [(k, f"http://a.example/{k}", f"<p>u{k} v{k} w{k} {line if k % 25 == 0 else ''} x{k}</p>") for k in range(100)]
    rows += [(200 + k, f"http://b.example/{k}", f"<p>y{k} {line} z{k}</p>") for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for own in (rows[:100], rows[100:]):
        streams = [r[2][3:-4].split() for r in own]
        for r, s, gone in zip(own, streams, html_extract.repeated(streams), strict=True):
            assert got[r[0]] == " ".join(t for t, g in zip(s, gone, strict=True) if not g)
    assert got[25] == "u25 v25 w25 x25" and line in got[200]


def test_repeated_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(6)]
        own = {tuple(s): k for k, s in reversed(list(enumerate(streams)))}
        seen = collections.defaultdict(set)
        for s in streams:
            for i in range(len(s) - 2):
                seen[tuple(s[i : i + 3])].add(own[tuple(s)])
        for s, flags in zip(streams, html_extract.repeated(streams, 3, 2), strict=True):
            expected = [any(len(seen[tuple(s[i : i + 3])]) >= 2 for i in range(max(0, k - 2), min(k, len(s) - 3) + 1)) for k in range(len(s))]
            assert flags.tolist() == expected


def test_url_filters(spark):
    entries = spark.createDataFrame([("bad.example", "2024-01-10", "block"), ("bad.example", "2024-02-01", "none"), ("ok.bad.example", "2024-01-15", "allow"), ("twice.example", "2024-01-01", "allow"), ("twice.example", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("x.example", None, "block"), ("odd.example", "2024-01-01", "what")], "pattern string, effective string, action string")
    asked = [("http://bad.example/", "2024-01-09", "none"), ("https://u@a.BAD.example:80/x", "2024-01-10", "block"), ("http://bad.example", "2024-02-01", "none"), ("http://notbad.example", "2024-01-20", "none"), ("http://ok.bad.example/", "2024-01-14", "block"), ("http://ok.bad.example/", "2024-01-15", "allow"), ("http://ok.bad.example/", "2024-03-01", "allow"), ("http://twice.example", "2024-05-05", "block"), (None, "2024-01-20", "none"), ("nonsense", "2024-01-20", "none"), ("http://bad.example/", None, "none"), ("http://odd.example", "2024-02-02", "none"), ("http://bad.example/", "2024-01-09", "none")]
    captures = spark.createDataFrame([(u, d, a) for u, d, a in asked], "url string, day string, expected string").withColumns({"fetched": F.to_date("day"), "pattern": F.lit("clash")})
    got = url_filter.judge(captures, entries).collect()
    assert len(got) == len(asked) and all(r.action == r.expected and r.blocked == (r.action == "block") for r in got)
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert {r.action for r in url_filter.judge(captures, entries.limit(0)).collect()} == {"none"}


def test_url_filters_are_native(spark, data):
    plan = queries.op6_url_filters(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_quality_counts_a_repeated_id_once(spark):
    texts = [(k % 40, f"word{k % 40} and some more, of {k % 40} kinds" if k % 40 < 20 else "!!! $$ ### %%") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)] * 3, "doc_id long, quality int")
    once = quality.train(documents(spark, texts[:40], extra=False), labels)
    many = quality.train(documents(spark, texts, extra=False).repartition(7), labels)
    assert np.allclose(once["w"], many["w"]) and np.isclose(once["shift"], many["shift"])


def test_quality_odd_rows(spark):
    docs = documents(spark, [*odd_texts(), (None, "no id")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    out = quality.score(docs, model)
    assert out.columns.count("score") == 1 and {round(r.score, 6) for r in out.collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int"))
    assert quality.score(docs, one).where("score < 0.9").count() == 0
    assert quality.score(docs.limit(0), model).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(0, 10)), rng.integers(0, 5, rng.integers(0, 25))
        assert decontaminate.align(a, b)[0] == (smith_waterman(a, b) if len(a) and len(b) else 0)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"i{rng.randrange(500)}" for _ in range(rng.randrange(12, 40)))) for k in range(20)] + [(50, None), (51, ""), (52, "tiny one"), (None, "a b c d e f"), (3, "again i1 i2 i3 i4 i5")]
    filler = lambda: " ".join(f"f{rng.randrange(5000)}" for _ in range(80))
    docs, expected = [], set()
    for k in range(20):
        w = items[k][1].split()
        w[rng.randrange(len(w))] = "edited"
        w.insert(rng.randrange(len(w)), "new")
        docs.append((k, f"{filler()} {' '.join(w).upper()} {filler()}"))
        expected.add((k, k))
    docs += [(100, filler()), (101, None), (102, ""), (103, items[5][1]), (103, filler()), (None, items[6][1]), (104, "x tiny one y")]
    expected |= {(103, 5), (104, 52)}
    got = decontaminate.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1)), least_words=2).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and all(0.5 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark, docs), none).count() == 0
    assert decontaminate.contaminated(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("shards", [3, 7])
def test_sharding(spark, shards):
    texts = [*odd_texts(), *["big group"] * 40, *[f"pair {i // 2}" for i in range(30)], *[f"single {i}" for i in range(120)]]  # links fill two fifths
    docs = documents(spark, [*enumerate(texts), (None, "no id"), (4, "a b")])
    got = sharding.shard_documents(docs, shards=shards).collect()
    assert len(got) == len(texts) + 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(shards)) <= 1
    of = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 4}
    for i, t in enumerate(texts):
        if i != 4:
            raw = (t or "").encode()
            assert (of[i]["size"], of[i].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    split = sum(len({of[i].shard for i, t in enumerate(texts) if t == f"pair {k}"}) > 1 for k in range(15))
    assert split <= 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def aligned(docs, items, threshold=0.5):
    """{(document, item): score} by plain Smith-Waterman over all pairs."""
    ids = {}
    code = lambda t: [ids.setdefault(w, len(ids)) for w in words(t, True)]
    found = {}
    for d, t in docs:
        for i, x in items:
            score = smith_waterman(code(x), code(t)) / (2 * len(code(x)))
            if score >= threshold:
                found[d, i] = max(score, found.get((d, i), 0))
    return found


def decontaminated(spark, docs, items, least_words=1):
    got = decontaminate.contaminated(documents(spark, docs, extra=False), spark.createDataFrame(items, "item_id long, text string"), least_words=least_words).collect()
    return {(r.doc_id, r.item_id): r.score for r in got}


def test_decontamination_ignores_items_of_a_few_words(spark):
    docs = [(1, "the cat and the dog"), (2, "one two three four five six")]
    items = [(1, "the"), (2, "the dog"), (3, "two three four five"), (4, "one two three four five")]
    assert decontaminated(spark, docs, items, least_words=5) == {(2, 4): 1.0}


def test_decontamination_of_partial_copies(spark):
    """Five documents hold all of the item, many its first half only: all are found, however many they are."""
    rng = random.Random(4)
    w = [f"i{k}" for k in range(40)]
    fill = lambda: " ".join(f"f{rng.randrange(5000)}" for _ in range(10))
    docs = [(k, f"{fill()} {' '.join(w if k < 5 else w[:20])} {fill()}") for k in range(300)]
    got = decontaminated(spark, docs, [(1, " ".join(w))])
    assert got == {(k, 1): 1.0 if k < 5 else 0.5 for k in range(300)}


@pytest.mark.parametrize("hits", [1 << 21, 16])
def test_decontamination_equals_alignment_of_all_pairs(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "TABLE", 100)
    rng = random.Random(12)
    items = [(k, " ".join(f"i{rng.randrange(9 if k % 2 else 60)}" for _ in range(rng.randrange(1, 30)))) for k in range(24)]
    docs = []
    for k in range(60):
        w = items[k % 24][1].split()
        for _ in range(rng.randrange(len(w) + 1)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [f"x{rng.randrange(50)}"] if rng.random() < 0.7 else []
        docs.append((k, " ".join([*(f"i{rng.randrange(60)}" for _ in range(rng.randrange(20))), *w, *(f"f{k}" for k in range(rng.randrange(5)))])))
    expected = aligned(docs, items)
    assert len(expected) > 60 and decontaminated(spark, docs, items) == expected


@pytest.mark.parametrize("step", [2, 3, 4, 5])
def test_decontamination_of_copies_edited_at_every_few_words(spark, step):
    """Every third to fifth word replaced leaves no run of five, every second one inserted no two words side by side."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(24 + k))) for k in range(4)]
    docs = []
    for k, t in items:
        w = t.split()
        if step == 2:
            w = [x for j, v in enumerate(w) for x in (v, f"x{j}")]
        else:
            w[step - 1 :: step] = [f"x{j}" for j in range(len(w[step - 1 :: step]))]
        docs.append((k, f"before it {' '.join(w)} after it"))
    expected = aligned(docs, items)
    assert set(expected) == {(k, k) for k in range(4)}
    assert decontaminated(spark, docs, items) == expected


@pytest.mark.parametrize(("pairs", "single"), [(200, 0), (200, 100)])
def test_sharding_splits_few_groups_however_many_rows_are_linked(spark, pairs, single):
    texts = [*(f"pair {i // 2}" for i in range(2 * pairs)), *(f"alone {i}" for i in range(single))]
    docs = documents(spark, texts, extra=False)
    placed = sharding.shard_documents(docs, shards=40)
    out = sharding.cut_edges(placed, docs).first()
    of = {r.doc_id: r.shard for r in placed.collect()}
    cut = sum(of[2 * i] != of[2 * i + 1] for i in range(pairs))
    assert (out.groups, out.edges, out.split_groups, out.cut_edges) == (pairs, pairs, cut, cut)
    held = collections.Counter(of.values())
    assert len(held) == 40 and max(held.values()) - min(held.values()) <= 1
    assert cut == 0  # shares of an even number of rows: no pair has to be split


def test_sharding_cuts_no_more_than_the_best_deal(spark):
    """Groups of sizes that a search over all deals of whole groups fits into the shards."""
    rng = random.Random(11)
    for _ in range(3):
        sizes = [rng.randrange(2, 6) for _ in range(7)]
        texts = [t for k, n in enumerate(sizes) for t in [f"group {k}"] * n] + [f"alone {k}" for k in range(20)]
        docs = documents(spark, texts, extra=False)
        out = sharding.cut_edges(sharding.shard_documents(docs, shards=3), docs).first()
        assert out.edges == sum(n * (n - 1) // 2 for n in sizes) and out.cut_edges == 0


def test_sharding_gathers_a_group_of_many_shards(spark):
    """A third of all rows are one text: it fills its shards one after the other and leaves the others alone."""
    texts = [*["same"] * 400, *[f"single {i}" for i in range(800)]]
    got = sharding.shard_documents(documents(spark, texts, extra=False), shards=40).collect()
    held = collections.Counter(r.shard for r in got if r.doc_id < 400)
    assert len(held) == 14 and sorted(held.values())[1:] == [30] * 13
    assert set(collections.Counter(r.shard for r in got).values()) == {30}
