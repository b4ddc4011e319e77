import json

import pytest

from scoreloom.sources import adapters, cases


def test_errors_reports_and_manifest_below_a_folder(spark, tmp_path):
    for pipeline, errors in (("p1", [{"example_id": "a", "error": "x"}, {"example_id": "b", "error": None}]), ("p2", {"no": "list"})):
        (tmp_path / pipeline).mkdir()
        (tmp_path / pipeline / "_errors.json").write_text(json.dumps(errors))
    report = {"per_example_results": [{"test_id": "a", "metrics": [{"metric_name": "f1", "value": 0.5}]}]}
    (tmp_path / "p1" / "_evaluation_report.json").write_text(json.dumps(report))
    (tmp_path / "manifest.json").write_text(json.dumps({"docs": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"files": []}))
    rows = sorted(tuple(r) for r in cases.run_errors(spark, str(tmp_path)).collect() if r.example_id)
    assert rows == [("p1", "a", "x"), ("p1", "b", None)]
    assert [tuple(r) for r in cases.reports(spark, str(tmp_path)).collect()] == [("p1", "a", "f1", 0.5)]
    assert [json.loads(r.doc)["id"] for r in cases.manifest(spark, str(tmp_path / "manifest.json")).orderBy("n").collect()] == [1, 2]
    with pytest.raises(Exception, match="docs array"):
        cases.manifest(spark, str(tmp_path / "bad.json")).collect()


def test_reports_keep_every_row(spark, tmp_path):
    rows = spark.range(1500).selectExpr("id", "case when id = 7 then null else '<a|b>' end as name")
    assert cases.to_markdown(rows).count("\n") == 1501
    page = cases.to_html(rows, "Runs & scores")
    assert page.count("<tr>") == 1501 and "Runs &amp; scores" in page and "&lt;a|b&gt;" in page and "<td></td>" in page
    cases.write_rule_csv(rows, str(tmp_path / "rules"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rules")).count() == 1500


def test_image_hashes_are_of_the_bytes(spark):
    import hashlib

    rows = spark.createDataFrame([(1, b"abc"), (2, b"")], "page int, image binary")
    assert {r.page: r.sha256 for r in cases.image_hashes(rows, "page", "image").collect()} == {1: hashlib.sha256(b"abc").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_a_registered_provider_is_found_and_read(spark):
    mine = adapters.Provider("mine", 200, lambda raw: raw.get("made_by") == "mine", "predictions")
    adapters.register(mine)
    try:
        result = {"raw_output": {"made_by": "mine", "predictions": [{"label": "Text", "bbox": [0, 0, 1, 1]}]}}
        assert adapters.provider_of(result) is mine
        assert [r[:5] for r in adapters.regions(result)] == [("mine", 1, 0, "Text", None)]
    finally:
        del adapters.PROVIDERS["mine"]


def test_labels_that_are_unknown_stop_a_projection(spark):
    rows = spark.createDataFrame([("zebra",)], "label string")
    with pytest.raises(Exception, match="unknown layout label zebra"):
        adapters.projected(rows).collect()
