"""The pipeline's stages, each against brute force on its own input, and the queries' twins."""

import sys

sys.path.insert(0, "tests")

import corpus_pipeline
from compare import assert_same, connect

from dupscan.llm import decontaminate, queries
from dupscan.llm.shared import words

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if k == 0:
            bad = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
            assert len(bad & set(after)) <= 0.1 * len(bad) and len(set(before) - set(after) - bad) <= 0.25 * len(before)
        if k == 1:
            sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in ((i, words(t, True)) for i, t in before.items()) if w}
            for i in set(before) - set(after):  # each that goes has a near copy in its class, with a smaller id somewhere
                assert any(10 * len(sets[i] & s) >= 8 * len(sets[i] | s) for j, s in sets.items() if j != i)
            kept = sorted(set(after) & set(sets))
            for x, i in enumerate(kept):
                assert not any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in kept[:x])
        if k == 2:
            seen = set()
            for i in sorted(after):
                w = words(before[i])
                own = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
                assert (after[i] == before[i]) or own & seen
                left = words(after[i])
                if after[i] == before[i]:
                    assert not own & seen
                assert len(left) <= len(w)
                seen |= own
        if k == 3:
            items = {r.item_id: words(r.text, True) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
            for i, t in after.items():
                text = b" " + b" ".join(words(t, True)) + b" "
                assert not any(b" " + b" ".join(w) + b" " in text for w in items.values())
            out = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/2"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert set(before) - set(after) == out
        before = after
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_queries_run_and_equal_their_twins(spark):
    con = connect(FOLDER)
    for name, f in queries.QUERIES.items():
        out = f(spark, FOLDER)
        if name in queries.ORACLES:
            assert_same(out, queries.ORACLES[name], con)
        else:
            assert out.count() >= (0 if name.startswith("op9") else 1), name


def odd_folder(spark, folder, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _kept long, name string, n_words long, _bad long"
    spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 0.5, 1, 2, "x", -1, 3) for i, t in rows], kind).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with the names of operators' own."""
    good = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(None, None), (1, None), (2, ""), (3, good[0]), (3, good[0]), (3, good[1]), (None, good[2]), (5, " ".join(good) * 40), (6, good[0]), (7, " \t\n")]
    folder = odd_folder(spark, tmp_path / "odd", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.where("score <> 0.5 or n_words <> -1 or _kept <> 2").count() == 0
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 2, 3, 5, 6, 7}


def test_no_rows(spark, tmp_path):
    folder = odd_folder(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_computes_each_stage_once(spark, monkeypatch):
    """Rows that leave the first two stages are counted where they are made."""
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(stage, total):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)

            def count(it):
                for rb in it:
                    total.add(len(rb))
                    yield rb

            return out.mapInArrow(count, out.schema)

        return run

    stages = list(corpus_pipeline.STAGES)
    kept = [stages[0][1](spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER).count()]
    stages[:2] = [(name, counted(stage, total)) for (name, stage), total in zip(stages[:2], seen, strict=True)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    corpus_pipeline.run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert seen[0].value == kept[0] and 0 < seen[1].value <= kept[0]


def test_cut_deletes_what_is_done(spark):
    import glob

    from dupscan.llm.shared import cut

    first = cut(spark.range(100).groupBy("id").count())
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    name = first._jdf.queryExecution().logical().rdd().getCheckpointFile().get().rpartition("/")[2]
    assert glob.glob(f"{folder}/{name}")
    second = cut(first.where("id < 50"), first)
    assert not glob.glob(f"{folder}/{name}") and second.count() == 50
