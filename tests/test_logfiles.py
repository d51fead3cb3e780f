"""Log files are cut by their lines, so that none is more than a task can sort."""

import time

import pytest

from rivulet import queries_capture, queries_delivery, queries_text
from rivulet.session import scratch
from rivulet.sources import logstream
from rivulet.streaming import capture

SF = "/root/testdata/sf0.001"


def test_a_longer_log_has_more_files(spark, monkeypatch):
    monkeypatch.setattr(queries_text, "FILE_LINES", 50)
    out = scratch(spark, "log")
    log = spark.range(1000).selectExpr("id as line_no", "concat('line ', id) as line")
    queries_text.written(log, out, 5)
    sizes = [spark.read.text(f"{out}/{name}").count() for name, _ in logstream.files(out)]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) < 200


@pytest.mark.parametrize("lines", [300, 1_000_000])
def test_queries_give_the_same_with_more_files(spark, monkeypatch, lines):
    monkeypatch.setattr(queries_text, "FILE_LINES", lines)
    many = []
    inner = queries_capture.files
    monkeypatch.setattr(queries_capture, "files", lambda path: many.append(inner(path)) or inner(path))
    runs = {r.reason: (r.runs, r.lines) for r in queries_capture.capture_runs(spark, SF).collect()}
    assert (len(many[0]) > 5) == (lines == 300)
    assert {k: v[0] for k, v in runs.items()} == {capture.WINDOW: 2, capture.PAUSED: 1, capture.STOPPED: 1, capture.END: 1, capture.NOTHING: 1, "all": None}
    assert runs["all"][1] == queries_text.log_text(spark, SF).count()
    key = lambda r: (r.event_no, r.op, r.log_pos, r.after_id)
    parsed = [key(r) for r in queries_delivery.log_files(spark, SF).orderBy("event_no").collect()]
    want = queries_text.change_feed(spark, SF).orderBy("id").collect()
    assert parsed == [(n, r.op, r.log_pos, None if r.op == "delete" else str(r.pk)) for n, r in enumerate(want, 1)]


def test_reading_a_part_is_linear(tmp_path):
    (tmp_path / "bin.1").write_bytes(b"x\n" * 2_000_000)
    reader = logstream.LogReader({"path": str(tmp_path)})
    began = time.process_time()
    assert sum(1 for p in reader.partitions({"file": "", "position": 0}, {"file": "bin.1", "position": 4_000_000}) for _ in reader.read(p)) == 2_000_000
    assert time.process_time() - began < 15
