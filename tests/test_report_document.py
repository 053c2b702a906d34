"""The report as one file: the bytes of an indented dump."""

import json
import os

import pytest

from runlens.sources import report_file as RF
from runlens.sources import writers as W

from .conftest import scratch


def dumped(rows):
    ids = {n: [] for n in W.REPORT_LISTS}
    for i, b in rows:
        for name, holds in (("submitted", b != "incomplete"), ("completed", b in ("resolved", "unresolved", "error")), (b, True)):
            if holds:
                ids[name].append(i)
    doc = {f"{n}_ids": sorted(v) for n, v in ids.items()}
    doc |= {f"{n}_instances": len(v) for n, v in ids.items() if n != "incomplete"}
    doc |= {"schema_version": "1.0", "total_instances": len(rows)}
    return json.dumps(dict(sorted(doc.items())), indent=2)


BUCKETS = ["resolved", "unresolved", "error", "empty_patch", "incomplete"]


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_document_equals_the_dump(spark, n):
    odd = ["\u00e9\u4e2d", "\U0001f600\"\\", "a\tb\n", "\uffee", ""]
    rows = [((odd[i] if i < len(odd) else f"I-{i * 7919 % 100003}"), BUCKETS[i % (5 if n > 7 else 2)]) for i in range(n)]
    path = scratch(spark, "document")
    W.write_report(spark.createDataFrame(rows, "instance_id string, bucket string").repartition(5), path, with_document=True)
    with open(f"{path}/report.json", encoding="utf-8", newline="") as f:
        assert f.read() == dumped(rows)
    assert not [x for x in os.listdir(path) if "parts" in x]


def test_document_is_replaced_and_parts_of_lost_attempts_are_left_out(spark, tmp_path):
    file = str(tmp_path / "d.json")
    W.write_report_document(spark.createDataFrame([("a", "error")], "instance_id string, bucket string"), file)
    W.write_report_document(spark.createDataFrame([("b", "error")], "instance_id string, bucket string"), file)
    with open(file) as f:
        assert f.read() == dumped([("b", "error")])
    w = RF.JsonDocumentWriter(file)
    files, where = RF.location(w.parts)
    files.create_dir(where)
    for name, text in (("lost", "\"x\": 9"), ("kept", "\"x\": 1")):
        with files.open_output_stream(f"{where}/{name}") as out:
            out.write(text.encode())
    w.commit([RF.Part(1, f"{w.parts}/none", None, None), RF.Part(0, f"{w.parts}/kept", RF.FIELD, RF.FIELD)])
    with open(file) as f:
        assert f.read() == json.dumps({"x": 1}, indent=2)
    RF.JsonDocumentWriter(file).abort([])


def test_append_is_refused(spark, tmp_path):
    RF.register(spark)
    rows = spark.createDataFrame([], RF.TOKENS)
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format("json_document").mode("append").save(str(tmp_path / "x.json"))
