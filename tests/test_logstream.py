"""The log as a stream: offsets, windows and restarts; runs under control."""

import os

import pytest

from rivulet.session import scratch
from rivulet.sources.logstream import LogReader, files, window_end
from rivulet.streaming import capture, pipeline


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    os.makedirs(folder)
    for name, n in (("bin.9", 40), ("bin.10", 25), ("bin.11", 1)):
        (folder / name).write_text("".join(f"{name} line {i} {'x' * (i % 7)}\n" for i in range(n)))
    return folder


def whole(log):
    return [(n, x) for n, _ in files(str(log)) for x in (log / n).read_text().splitlines()]


@pytest.mark.parametrize("size", [1, 7, 64, 500, 10_000])
@pytest.mark.parametrize("part", [3, 50, 10_000])
def test_windows_and_parts_read_each_line_once(log, tmp_path, size, part):
    assert [n for n, _ in files(str(log))] == ["bin.9", "bin.10", "bin.11"]
    reader = LogReader({"path": str(log), "progress": str(tmp_path / "progress"), "max_bytes": str(size), "part_bytes": str(part)})
    at, got, rounds = reader.initialOffset(), [], 0
    while (end := LogReader(vars_of(reader)).latestOffset()) != at:
        for p in reader.partitions(at, end):
            got += [(f, line) for f, _, line in reader.read(p)]
        at, rounds = end, rounds + 1
    assert got == whole(log) and (rounds == 1) == (size == 10_000)


def vars_of(reader):
    return {"path": reader.path, "progress": reader.progress, "max_bytes": str(reader.max_bytes)}


def test_a_line_waits_for_its_end(log):
    end = window_end(str(log), ("", 0), 9, 1 << 40)
    with open(log / "bin.11", "a") as f:
        f.write("half a li")
    assert window_end(str(log), end, 9, 1 << 40) == end
    with open(log / "bin.11", "a") as f:
        f.write("ne\n")
    assert window_end(str(log), end, 9, 1 << 40) == ("bin.11", end[1] + 12)
    assert window_end(str(log), ("", 0), 1, 1 << 40) == ("bin.9", os.path.getsize(log / "bin.9"))


def test_runs_paused_and_resumed_read_what_one_run_reads(spark, log, tmp_path):
    out, work, control = scratch(spark, "lines"), str(tmp_path / "work"), scratch(spark, "control")
    sink, window = pipeline.appender(out), capture.Window(max_bytes=280, part_bytes=100)
    once = lambda: capture.run_once(spark, str(log), work, sink, window, control)
    reasons = [once()[0], once()[0]]
    for state in (capture.PAUSED, capture.RUN, capture.STOPPED, capture.RUN):
        capture.command(spark, control, state)
        reasons.append(once()[0])
    assert reasons == [capture.WINDOW, capture.WINDOW, capture.PAUSED, capture.WINDOW, capture.STOPPED, capture.WINDOW]
    rest = capture.drain(spark, str(log), work, sink, capture.Window(), control)
    assert [r.reason for r in rest.collect()] == [capture.END]
    assert capture.run_once(spark, str(log), work, sink, window, control) == (capture.NOTHING, 0)
    got = [(r.file, r.line) for r in capture.captured(spark, out).orderBy("file_no", "position").collect()]
    assert got == whole(log)
    with pytest.raises(ValueError):
        capture.command(spark, control, "rest")
