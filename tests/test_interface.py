import json

import pytest

import dupscan
from dupscan import api, cli
from dupscan.operators.stats import summary
from dupscan.plans import report
from dupscan.plans.detector import detect
from dupscan.sources.files import CollectionError, collect_files, list_paths
from dupscan.streaming import incremental

BODY = "def work(a, b):\n    c = a * b\n    for i in range(c):\n        print(i, a)\n    return c - 1\n"


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.py": BODY, "pkg/__init__.py": BODY, "pkg/.hid.py": BODY, "build/x.py": BODY, ".git/y.py": BODY, "note.txt": "x", "s.pyi": BODY}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


def test_collect(spark, folder):
    files = collect_files(spark, [str(folder), str(folder / "a.py")]).collect()
    assert [f.path.removeprefix(f"{folder}/") for f in sorted(files, key=lambda f: f.file_id)] == ["a.py", "pkg/__init__.py"]
    assert {f.language for f in files} == {"python"} and files[0].content == BODY
    assert len(list_paths([str(folder)], ["py", "pyi"])) == 3
    with pytest.raises(CollectionError):
        list_paths([str(folder / "none")])


def test_unreadable(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="CollectionError"):
        collect_files(spark, [str(tmp_path)]).collect()
    row = collect_files(spark, [str(tmp_path)], on_error="skip").first()
    assert row.content is None and "bad.py" in row.error


def test_api(spark, folder):
    groups = api.detect_clones([str(folder)], api.DetectionConfig(min_tokens=10, min_lines=2), spark)
    assert groups and all(len(g) == g.size >= 2 for g in groups)
    g = groups[0]
    assert str(g.clone_type) == "Type-1" and g.avg_lines == sum(c.line_count for c in g.instances) / g.size and "CloneGroup" in repr(g)
    assert g.instances[0].content and g.instances[0].file.endswith(".py") and "Clone(" in repr(g.instances[0])
    assert api.CloneGroup(api.CloneType.TYPE1, (), 1.0, "x").avg_lines == 0.0
    with pytest.raises(OSError):
        api.detect_clones([str(folder / "none")], spark=spark)
    (folder / "bad.py").write_text("(1,\n")
    with pytest.raises(ValueError):
        api.detect_clones([str(folder)], spark=spark)
    assert dupscan.detect_clones is api.detect_clones


def test_cli(spark, folder, capsys):
    assert cli.main(["version"]) == 0 and dupscan.__version__ in capsys.readouterr().out
    assert cli.main(["-v", "check", str(folder), "--min-tokens", "10", "--min-lines", "2", "--mode", "odd"]) == 0
    got = capsys.readouterr()
    assert "[1] Type-1: 2 places of" in got.out and "balanced is used" in got.err and "tokens>=10" in got.out and "read: 2 files" in got.out
    assert cli.main(["-f", "json", "check", str(folder), "--min-tokens", "10", "--min-lines", "2"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["total_groups"] == len(found["groups"]) > 0
    assert cli.main(["-f", "sarif", "check", str(folder), "--min-tokens", "10", "--min-lines", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert cli.main(["check", str(folder / "note.txt")]) == 0 and "clones: none" in capsys.readouterr().out
    assert cli.main(["check", str(folder / "none")]) == 1


def test_report_texts(spark):
    assert list(report.text_report([], {"groups": 0, "instances": 0})) == ["clones: none"]
    assert json.loads("".join(report.json_report([], {"groups": 0, "instances": 0}))) == {"total_groups": 0, "total_instances": 0, "groups": []}
    assert dupscan.version() == dupscan.__version__
    assert summary({"total_files": 2, "total_lines": 3, "total_bytes": 4, "by_language": {"b": 1, "a": 1, "c": 5}}) == "2 files, 3 lines, 4 bytes, Languages: c: 5, a: 1, b: 1"


def test_incremental(spark, tmp_path):
    schema = "file_id long, content string"
    for i, text in enumerate(["a b c d e f", "x b c d e y"]):
        spark.createDataFrame([(i, text)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.start(stream, f"{tmp_path}/index", f"{tmp_path}/check", width=4).awaitTermination()
    got = incremental.repeated(spark, f"{tmp_path}/index").collect()
    assert [(r.n, r.first_batch, r.last_batch) for r in got] == [(2, 0, 1)]


def test_tables_as_sources(spark):
    from dupscan.sources.files import collect_table

    table = spark.createDataFrame([(1, "a b c d", "en"), (2, "a b c d", "en"), (3, None, "fr")], "id long, text string, lang string")
    files = collect_table(table, "id", "text", "text")
    from dupscan.config import DetectionConfig

    assert detect(files, DetectionConfig(min_tokens=3, min_lines=1, mask=False)).groups.count() == 2


NEAR = BODY.replace("c - 1", "c - 1 + len(str(a))")


def test_modes_differ(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text(BODY)
    (tmp_path / "b.py").write_text(NEAR)
    kinds = {}
    for mode in ("fast", "balanced"):
        config = api.DetectionConfig(mode=mode, min_tokens=10, min_lines=2, similarity_threshold=0.5)
        kinds[mode] = {str(g.clone_type) for g in api.detect_clones([str(tmp_path)], config, spark)}
    assert kinds["balanced"] - kinds["fast"] == {"Type-3"}
    strict = api.DetectionConfig(min_tokens=10, min_lines=2, similarity_threshold=1.0)
    assert "Type-3" not in {str(g.clone_type) for g in api.detect_clones([str(tmp_path)], strict, spark)}
    assert cli.main(["check", str(tmp_path), "--min-tokens", "10", "--min-lines", "2", "--threshold", "0.5"]) == 0 and "Type-3" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path), "--min-tokens", "10", "--min-lines", "2", "--mode", "fast"]) == 0 and "Type-3" not in capsys.readouterr().out
    precise = cli.parser().parse_args(["check", "x", "--mode", "precise"])
    assert precise.min_tokens is None


def test_errors_are_listed(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text(BODY)
    (tmp_path / "open.py").write_text("(1,\n")
    (tmp_path / "bytes.py").write_bytes(b"\xff\xfe")
    found = detect(collect_files(spark, [str(tmp_path)], on_error="skip"), api.DetectionConfig(on_error="skip"))
    assert sorted(r.path.rpartition("/")[2] for r in found.errors.collect()) == ["bytes.py", "open.py"]
    assert cli.main(["check", str(tmp_path), "--skip-errors"]) == 0
    assert capsys.readouterr().out.count("left out: ") == 2


def test_report_of_very_many_groups(spark):
    """Totals count all groups, and all are in the report."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(10_010))
    files = spark.createDataFrame([(i, f"f{i}", text, "text") for i in range(2)], "file_id long, path string, content string, language string")
    found = detect(files, api.DetectionConfig(mode="fast", min_tokens=5, min_lines=1, mask=False))
    total = report.totals(found)
    assert total == {"groups": 10_006, "instances": 20_012}
    got = json.loads("".join(report.json_report(report.streamed(found), total)))
    assert got["total_groups"] == len(got["groups"]) == 10_006 and all(len(g["instances"]) == 2 for g in got["groups"])
