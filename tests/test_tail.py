"""Lines appended to files arrive once and in order, a bounded number at a time, over restarts, rotation and truncation."""


import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.operators.store import Store
from fleetlens.sources import logs, tail
from fleetlens.streaming import jobs


def reader(tmp_path, **options):
    return tail.GrowingLinesReader({"path": str(tmp_path / "in"), "state": str(tmp_path / "state")} | {k: str(v) for k, v in options.items()})


def drained(r, start=None):
    """Batches of (path, seq, value) until nothing is new, and the last offset."""
    out, at = [], start if start is not None else r.initialOffset()
    while (end := r.latestOffset()) != at:
        parts = r.partitions(at, end)
        out.append([tuple(x[c] for c in ("path", "seq", "value")) for p in parts for b in r.read(p) for x in b.to_pylist()])
        at = end
    return out, at


def folder(tmp_path):
    (tmp_path / "in" / "h").mkdir(parents=True)
    return tmp_path / "in" / "h"


def test_lines_are_cut_as_they_are_read():
    text = b"one\n\ntwo\r\n" + b"x" * 25 + b"\nlast"
    got = list(tail.lines_from(pa.BufferReader(text), 0, longest=10))
    assert [x for x, _ in got] == [b"one\n", b"\n", b"two\r\n", b"x" * 10, b"x" * 10, b"x" * 5 + b"\n"] and [e for _, e in got][-1] == len(text) - 4
    assert [x for x, _ in tail.lines_from(pa.BufferReader(text), 4, 10, longest=10)] == [b"\n", b"two\r\n"]


def test_only_what_is_appended_comes(tmp_path):
    at = folder(tmp_path)
    (at / "a.log").write_text("old\n")
    r = reader(tmp_path)
    offset = r.initialOffset()
    assert drained(r, offset)[0] == []
    with (at / "a.log").open("a") as f:
        f.write("new\nhalf")
    (at / "b.log").write_text("other\n")
    got, offset = drained(r, offset)
    assert [x[1:] for b in got for x in b] == [(0, "new"), (1, "other")]
    with (at / "a.log").open("a") as f:
        f.write(" line\n")
    assert [x[1:] for b in drained(r, offset)[0] for x in b] == [(2, "half line")]


def test_batches_are_bounded_and_fair(tmp_path):
    at = folder(tmp_path)
    (at / "a.log").write_text("".join(f"a{i}\n" for i in range(95)))
    (at / "b.log").write_text("".join(f"b{i}\n" for i in range(3)))
    got, _ = drained(reader(tmp_path, rows=10, start="beginning"))
    assert [len(b) for b in got] == [10] * 9 + [8] and {x[2] for x in got[0]} >= {"b0", "b1", "b2"}
    rows = sorted(x for b in got for x in b)
    assert [v for p, _, v in rows if p.endswith("a.log")] == [f"a{i}" for i in range(95)] and sorted(s for _, s, _ in rows) == list(range(98))


def test_rotation_and_truncation(tmp_path):
    at = folder(tmp_path)
    (at / "a.log").write_text("1\n2\n")
    r = reader(tmp_path, start="beginning")
    got, offset = drained(r)
    with (at / "a.log").open("a") as f:
        f.write("3\n")
    end = r.latestOffset()
    (at / "a.log").rename(at / "a.log.1")  # after the batch was planned
    (at / "a.log").write_text("4\n")
    parts = r.partitions(offset, end)
    assert [x["value"] for p in parts for b in r.read(p) for x in b.to_pylist()] == ["3"]
    got, offset = drained(r, end)
    assert [x[2] for b in got for x in b] == ["4"]
    (at / "a.log").write_text("")
    drained(r, offset)
    (at / "a.log.1").write_text("5\n")  # shorter than what was read of it
    got, _ = drained(r, r.end)
    assert [x[2] for b in got for x in b] == ["5"]


def test_a_planned_batch_is_read_again_after_a_restart(tmp_path):
    at = folder(tmp_path)
    (at / "a.log").write_text("".join(f"{i}\n" for i in range(7)))
    first = reader(tmp_path, rows=3, start="beginning")
    start = first.initialOffset()
    end = first.latestOffset()
    first.partitions(start, end)
    again = reader(tmp_path, rows=3, start="beginning")
    assert [x["value"] for p in again.partitions(start, end) for b in again.read(p) for x in b.to_pylist()] == ["0", "1", "2"]
    later = reader(tmp_path, rows=3, start="beginning")  # a committed batch: Spark asks for what is new at once
    assert [x[2] for b in drained(later, end)[0] for x in b] == ["3", "4", "5", "6"]


@pytest.mark.parametrize("kind", ["files", "journal"])
def test_stream_over_restarts(spark, tmp_path, kind):
    at = folder(tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    line = (lambda i: f"m{i}") if kind == "files" else (lambda i: '{"MESSAGE": "m%d", "PRIORITY": "3"}' % i)
    n = 0
    for more in (5, 0, 4, 7):
        with (at / "x.log").open("a") as f:
            f.write("".join(line(n + i) + "\n" for i in range(more)))
        n += more
        lines = tail.growing_lines(spark, str(tmp_path / "in"), str(tmp_path / "ck" / "tail"), rows=3, start="beginning")
        rows = logs.file_lines(lines, F.current_timestamp()) if kind == "files" else logs.journal(lines, F.current_timestamp())
        q = jobs.append(rows, store, "logs", str(tmp_path / "ck"), every="0 seconds")
        q.processAllAvailable()
        q.stop()
    got = store.read("logs").orderBy("seq").collect()
    assert [(r["seq"], r["message"], r["host"]) for r in got] == [(i, f"m{i}", "h") for i in range(n)]


def test_short_ranges_of_many_files_are_one_task(tmp_path):
    at = folder(tmp_path)
    for k in range(20):
        (at / f"{k:02d}.log").write_text(f"{k}\n")
    r = reader(tmp_path, start="beginning")
    start = r.initialOffset()
    (part,) = r.partitions(start, r.latestOffset())
    assert [(x["seq"], x["value"], x["path"][-6:]) for b in r.read(part) for x in b.to_pylist()] == [(k, str(k), f"{k:02d}.log") for k in range(20)]
