"""Round trips of the file formats, and entities of annotated articles."""

import dataclasses
import gzip
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import resolution
from skein.plans.articles import Settings
from skein.sources import files


def tok(i, word, after, ner, timex=None):
    return {"nlpToken": {"index": i, "word": word, "after": after, "ner": ner} | ({"timex": {"value": timex}} if timex else {})}


TOKENS = [tok(1, "New", " ", "LOCATION"), tok(2, "York", " ", "LOCATION"), "NP", tok(3, "mayor", " ", "O"), tok(4, "Ann", " ", "PERSON"), tok(5, "Lee", "", "PERSON")]
DATES = [tok(5, "1", " ", "DATE", "2024-03-01"), tok(6, "March", " ", "DATE", "2024-03-01"), tok(7, "2024", " ", "DATE", "2024-03-01")]


def test_lines_and_key_values(spark, tmp_path):
    df = spark.createDataFrame([("1", "a b"), ("2", "")], "key string, value string")
    files.write_key_values(df, f"{tmp_path}/kv")
    assert sorted(map(tuple, files.read_key_values(spark, f"{tmp_path}/kv").collect())) == [("1", "a b"), ("2", "")]
    files.write_lines(df, f"{tmp_path}/lines", "value")
    files.write_lines(df, f"{tmp_path}/lines", "value", "a")
    assert sorted(r[0] for r in files.read_lines(spark, f"{tmp_path}/lines").collect()) == ["", "", "a b", "a b"]


def test_a_line_without_one_separator_is_an_error(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("1~|~2~|~3\n")
    with pytest.raises(Exception, match="not one separator"):
        files.read_key_values(spark, f"{tmp_path}/bad.txt").collect()


def test_part_ranges(spark, tmp_path):
    (tmp_path / "parts.txt").write_text("0~|~(0, 250)\n1~|~(250, 400)\n")
    assert sorted(map(tuple, files.read_part_ranges(spark, f"{tmp_path}/parts.txt").collect())) == [(0, 0, 250), (1, 250, 400)]


def test_json_formats(spark, tmp_path):
    with gzip.open(tmp_path / "map.json.gz", "wt") as f:
        json.dump({"a": ["x", "y"], "b": []}, f)
    found = {r["key"]: r["value"] for r in files.read_map(spark, f"{tmp_path}/map.json.gz", "array<string>").collect()}
    assert found == {"a": ["x", "y"], "b": []}
    df = spark.createDataFrame([(1, "x"), (2, None)], "key long, value string")
    files.write_json_lines(df, f"{tmp_path}/jl", compress=True)
    assert sorted(map(tuple, files.read_json_lines(spark, f"{tmp_path}/jl", "key long, value string").collect())) == [(1, "x"), (2, None)]
    files.write_map(df.na.fill("z"), f"{tmp_path}/dump")
    assert sorted(map(tuple, files.read_map_lines(spark, f"{tmp_path}/dump").collect())) == [("1", "x"), ("2", "z")]
    (tmp_path / "one.json").write_text('{\n"td": false,\n"alpha": 10.0, "length": [3, 100], "other": 1}')
    assert files.read_json(spark, f"{tmp_path}/one.json").count() == 1
    assert files.load_config(spark, f"{tmp_path}/one.json", Settings) == dataclasses.replace(Settings(), td=False, alpha=10.0, length=(3, 100))


def test_matrices_threads_and_metrics(spark, tmp_path):
    files.write_matrix(spark.createDataFrame([(1, [0.5, 1.0])], "doc_id long, values array<float>"), f"{tmp_path}/m")
    assert files.read_matrix(spark, f"{tmp_path}/m").first()["values"] == [0.5, 1.0]
    files.write_matrix(spark.createDataFrame([(1, "t", 0.5)], "doc_id long, term string, weight double"), f"{tmp_path}/s")
    assert tuple(files.read_sparse(spark, f"{tmp_path}/s").first()) == (1, "t", 0.5)
    one = spark.createDataFrame([(1, 0.5)], "thread_id long, similarity double")
    files.write_threads(one, f"{tmp_path}/t", "a")
    files.write_threads(one, f"{tmp_path}/t", "b")
    assert {r["run"] for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {"a", "b"}
    files.append_metrics(one, f"{tmp_path}/log")
    files.append_metrics(one, f"{tmp_path}/log")
    assert files.read_json_lines(spark, f"{tmp_path}/log").count() == 2


def test_a_stored_graph_is_reused(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for force in (False, False, True):
        assert files.stored(spark, f"{tmp_path}/g", build, force).count() == 3
    assert len(built) == 2


def test_articles_and_their_entities(spark, tmp_path):
    ask = {"who": {"extracted": [{"parts": [TOKENS]}]}, "where": {"extracted": [{"parts": [TOKENS]}]}, "when": {"extracted": [{"parts": [DATES]}]}, "why": {"extracted": None}, "how": {}}
    whole = {"title": None, "text": "", "maintext": "main", "fiveWoneH": ask, "other": 1}
    plain = {"description": "d", "text": "t", "maintext": "main", "fiveWoneH": {"who": {"extracted": [{"parts": [[tok(1, "it", "", "O")]]}]}}}
    for name, a in (("a1", whole), ("a2", plain)):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump(a, f)
    rows = files.read_articles(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert (got["a1"]["title"], got["a1"]["text"], got["a2"]["description"], got["a2"]["text"]) == ("", "main", "d", "t")
    assert set(got["a1"]["answers"]) == {"who", "where", "when"}
    found = {}
    for r in resolution.resolve(rows, ("who", "where", "when")).collect():
        found.setdefault((r["doc_id"], r["q"]), []).append(r["entity"])
    assert found[("a1", "who")] == ["New York", "Ann Lee"] and found[("a1", "where")] == ["New York"]
    assert len(found[("a1", "when")]) == 2 and not any(k[0] == "a2" for k in found)


@pytest.mark.parametrize(("value", "day"), [("2024-03-05", "2024-03-05"), ("2024-03", "2024-03-01"), ("2024", "2024-01-01"), ("2024-W02", "2024-01-08"), ("2024-03-05T10:00", "2024-03-05"), ("PRESENT_REF", None)])
def test_start_of_a_time_expression(spark, value, day):
    got = spark.createDataFrame([(value,)], "v string").select(resolution.timex_start(F.col("v")).cast("string")).first()[0]
    assert got == day
