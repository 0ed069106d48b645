import json

from pyspark.sql import functions as F

import pytest

from framewise.plans import persist
from framewise.sources import config, files, logs


def test_mixed_log(spark, tmp_path):
    one = {"file": "a", "status": "correct", "elapsed": 0.5, "model_reply": {"source": "llm", "type": "ad", "reason": "r", "reply": "{x}"}}
    text = json.dumps(one) + "\n" + json.dumps({"file": "b", "status": "ignored"}) + "\nnot json\n" + json.dumps({"status": "summary", "total": 1}, indent=2)
    (tmp_path / "log.jsonl").write_text(text.replace("\nnot json", ""))
    rows, summaries = logs.results(spark, str(tmp_path))
    assert sorted((r["file"], r["status"]) for r in rows.collect()) == [("a", "correct"), ("b", "ignored")]
    assert summaries.count() == 1


def test_labels_features_overrides(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"a.jpg": "ad", "b.jpg": null}')
    assert logs.labels(spark, str(tmp_path / "labels.json")).count() == 2
    assert [tuple(r) for r in logs.labels(spark, str(tmp_path / "labels.json"), drop_null=True).collect()] == [("a.jpg", "ad")]
    assert logs.labels(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "f.jsonl").write_text('{"filename": "a", "network_logo": "Fox"}\n\n{"filename": "a", "logo_position": "center"}\n')
    got = logs.features(spark, str(tmp_path / "f.jsonl")).first()
    assert (got["network_logo"], got["logo_position"]) == (None, "center")
    (tmp_path / "o.json").write_text('[{"phash": "ffffffffffffffff", "label": "ad"}, {"phash": "0000000000000080", "label": "content"}]')
    assert [tuple(r) for r in logs.overrides(spark, str(tmp_path / "o.json")).orderBy("pos").collect()] == [(0, -1, "ad"), (1, 128, "content")]


def test_objects_in_any_layout(spark, tmp_path):
    one, two = {"a": 1, "t": 'x } { " y'}, {"b": {"c": [{"d": 2}, {"d": 3}]}}
    nested = json.dumps(two, indent=2)
    (tmp_path / "a.jsonl").write_text(json.dumps(one) + json.dumps(two) + "\n" + nested + "\n\nnot json\n" + nested + json.dumps(one) + "\n" + json.dumps(one))
    (tmp_path / "b.jsonl").write_text(nested)
    got = sorted(r["json"] for r in logs.json_objects(spark, str(tmp_path)).selectExpr("to_json(parse_json(json)) AS json").collect())
    want = [one] * 3 + [two] * 4
    assert sorted(json.dumps(json.loads(g), sort_keys=True) for g in got) == sorted(json.dumps(w, sort_keys=True) for w in want)
    # In small parts of files, objects go over their borders.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        assert logs.json_objects(spark, str(tmp_path)).count() == 7
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_record_of_appended_files(spark, tmp_path):
    path = str(tmp_path / "log")
    df = lambda x: spark.createDataFrame([("a", x)], "filename string, network_logo string")
    for x in ("one", "two", "three", "four"):
        logs.append(df(x), path)
    assert logs.features(spark, path).first()["network_logo"] == "four"


def test_overrides_and_evaluation_logs_come_back(spark, tmp_path):
    for rows in ([(-1, "ad"), (5, "content")], [(7, "ad")]):
        logs.append_overrides(spark.createDataFrame(rows, "phash long, label string").coalesce(1), str(tmp_path / "o"))
    assert [tuple(r) for r in logs.overrides(spark, str(tmp_path / "o")).orderBy("pos").collect()] == [(0, -1, "ad"), (1, 5, "content"), (2, 7, "ad")]
    lines = spark.createDataFrame([("a", "correct"), ("b", "incorrect")], "file string, status string")
    logs.write_evaluation(lines, spark.createDataFrame([(2, 1)], "total long, incorrect long"), str(tmp_path / "e"))
    rows, summaries = logs.results(spark, str(tmp_path / "e"))
    assert rows.count() == 2 and json.loads(summaries.first()["json"]) == {"status": "summary", "total": 2, "incorrect": 1}


def test_shared_folder_must_be_set_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        persist.shared_dir(Session())


def test_write_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "file string, status string")
    logs.write_results(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"file":"a"}'
    for _ in range(2):
        logs.append(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_listing_and_images(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for n in ("b.png", "a.jpg", "c.JPG", "d.txt"):
        (folder / n).write_bytes(b"x")
    assert sorted(r["name"] for r in files.listing(spark, str(folder)).collect()) == ["a.jpg", "b.png"]
    assert files.listing(spark, str(folder), any_case=True).count() == 3
    assert [r["name"] for r in files.evaluation_listing(spark, str(tmp_path)).collect()] == ["a.jpg", "b.png"]
    assert files.contents(spark, str(folder)).select(F.md5("content")).distinct().count() == 1
    assert files.images(spark, str(folder)).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"MATRIX_URL": "m", "unknown": 1, "enable_debounce": true}')
    c = config.load(str(tmp_path / "c.json"), {"DETECTOR_ENABLE_DEBOUNCE": "false"})
    assert (c.matrix_url, c.enable_debounce, c.auto_switch) == ("m", False, True)
    assert config.load(None, {}).classifier_profile == "nascar_on_fox"
