import json

import pytest
from pyspark.sql import functions as F

from prosemeter.operators import exchange as X
from prosemeter.sources import catalog, config, readers, writers
from prosemeter.streaming import resume


def test_lines_and_parallel(spark, tmp_path):
    for name, text in (("o", " a \n\nb\n"), ("s", "x\ny\nz"), ("r0", "1\n2\n3\n"), ("r1", "4\r\n5\r\n6"), ("bad", "1\n")):
        (tmp_path / name).write_text(text)
    p = lambda n: str(tmp_path / n)
    assert [tuple(r) for r in readers.lines(spark, p("o")).orderBy("row_id").collect()] == [(0, "a"), (1, ""), (2, "b")]
    got = readers.parallel(spark, p("o"), [p("r0"), p("r1")], {"sys": p("s")}).orderBy("row_id").collect()
    assert [(r["orig"], r["sys"], r["refs"]) for r in got] == [("a", "x", ["1", "4"]), ("", "y", ["2", "5"]), ("b", "z", ["3", "6"])]
    with pytest.raises(ValueError, match="reference 1"):
        readers.parallel(spark, p("o"), [p("r0"), p("bad")], {"sys": p("s")})
    assert catalog.load(spark, "custom", "", {"sys": p("s")}, p("o"), [p("r0")]).count() == 3


def test_split_lines(spark, tmp_path):
    (tmp_path / "f").write_text("a <::::> b\nc\n")
    assert [r["parts"] for r in readers.split_lines(spark, str(tmp_path / "f")).orderBy("row_id").collect()] == [["a", "b"], ["c"]]


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert readers.records(spark, str(tmp_path / "a.json"), "x int").count() == 1
    assert readers.records(spark, str(tmp_path / "b.jsonl"), "x int").count() == 2
    with pytest.raises(ValueError):
        readers.records(spark, "x.txt")


def test_tsv_titles_responses(spark, tmp_path):
    (tmp_path / "train0.tsv").write_text('index\tlabel\tsentence\tPOS\tw_index\n1\t0\tsay "hi\tNN\t2\n')
    assert readers.folds(spark, str(tmp_path), 1).first()["sentence"] == 'say "hi'
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "My_Title.v1.json").write_text("[]")
    assert readers.titled_texts(spark, str(tmp_path / "d")).first()["title"] == "My_Title"
    docs = spark.createDataFrame([(0, "My Title"), (7, "other")], "doc_id long, title string")
    assert {r["doc_id"]: r["facts_json"] for r in readers.facts_folder(spark, str(tmp_path / "d"), docs).collect()} == {0: "[]", 7: None}
    line = lambda c: json.dumps({"custom_id": "a", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": c}}]}}})
    (tmp_path / "out.jsonl").write_text(line("one") + "\n\n" + line("two") + "\n")
    got = readers.batch_responses(spark, str(tmp_path / "out.jsonl"))
    assert got.select(X.reply_text()).first()[0] == "two"


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b c", ""), (2, "d", "x")], "id int, title string, note string")
    writers.replaced(rows, str(tmp_path / "t"))
    writers.replaced(rows.where("id = 1"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 1
    writers.per_title(rows, str(tmp_path / "p"))
    assert (tmp_path / "p" / "file_title=a_b_c").is_dir()
    writers.json_and_lines(rows.coalesce(1), str(tmp_path / "k"))
    assert len(json.loads("".join(p.read_text() for p in (tmp_path / "k" / "arrays").glob("part*")))) == 2
    stats = spark.createDataFrame([("m", 1.0, 1.0, 1.0, 2)], "metric string, mean double, min double, max double, count long")
    writers.result_files(rows, stats, str(tmp_path / "r"), "d", 2)
    assert any('"note"' not in line for p in (tmp_path / "r" / "results").glob("part*") for line in p.read_text().splitlines())
    assert "<td>a/b c</td>" in writers.html_report("t", {"rows": rows})
    assert writers.rounded({"a": [1.23456]}) == {"a": [1.235]}
    writers.request_file(X.requests(rows, F.col("id").cast("string"), F.col("title"), "m"), str(tmp_path / "q"))
    assert spark.read.schema(X.REQUEST).json(str(tmp_path / "q")).where("body.messages[0].content = 'd'").count() == 1


def test_config():
    y = config.yaml_mapping("# c\nopenlike:\n  gpt.x:\n    api_key: 'k'\n    base_url: http://h/v1 # c\n    model: m\nother:\n")
    assert config.resolve_model(y, "gpt.x").base_url == "http://h/v1"
    assert config.resolve_model(y, "none", "openlike").name == "m"
    with pytest.raises(KeyError):
        config.resolve_model(y, "none")
    assert config.ini_values("[a]\nx = 3\ny = [1, 2]\nz = __import__('os')\n") == {"x": 3, "y": [1, 2], "z": "__import__('os')"}
    with pytest.warns(DeprecationWarning):
        catalog.test_set(next(iter(catalog.ALIASES)))
    with pytest.raises(ValueError):
        catalog.test_set("nothing")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, c: json.dumps({"custom_id": i, "response": {"status_code": 200 if c else 500, "body": {"choices": [{"message": {"content": c}}]}}})
    (src / "1.json").write_text(line("a", "x") + "\n" + line("b", None))
    run = lambda: resume.collect_scores(resume.responses(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    assert {r[0] for r in resume.still_missing(wanted, str(tmp_path / "out")).collect()} == {"b", "c"}
    (src / "2.json").write_text(line("c", "y"))
    run()
    assert {r[0] for r in resume.still_missing(wanted, str(tmp_path / "out")).collect()} == {"b"}
