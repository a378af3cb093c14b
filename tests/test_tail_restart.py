"""stream_tail: both runs bring lines, out of files that grew in between, and every batch of both counts."""

from fleetlens.plans import telemetry
from fleetlens.sources import tail
from fleetlens.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_both_runs_bring_lines_of_the_same_files(spark, monkeypatch):
    runs, append = [], jobs.append
    monkeypatch.setattr(jobs, "append", lambda *a, **k: runs.append(append(*a, **k)) or runs[-1])
    got = telemetry.stream_tail(spark, SF).collect()
    lines = [sum(p["numInputRows"] for p in q.recentProgress) for q in runs]
    assert len(lines) == 2 and min(lines) >= 400 and sum(lines) == sum(r["rows"] for r in got) == 1000
    assert all(r["bounded"] and r["numbered"] for r in got)


def test_a_batch_of_the_first_run_that_is_too_large_is_seen(spark, monkeypatch):
    growing, asked = tail.growing_lines, []

    def first_unbounded(*args, rows, **options):
        asked.append(rows)
        return growing(*args, rows=rows if asked[1:] else 10_000, **options)

    monkeypatch.setattr(telemetry, "TAIL_ROWS", 200, raising=False)
    assert {r["bounded"] for r in telemetry.stream_tail(spark, SF).collect()} == {True}
    monkeypatch.setattr(tail, "growing_lines", first_unbounded)
    got = telemetry.stream_tail(spark, SF).collect()
    assert {r["bounded"] for r in got} == {False} and sum(r["rows"] for r in got) == 1000


def test_files_grow_out_of_the_middle_of_a_line(spark, tmp_path):
    (tmp_path / "lines" / "h").mkdir(parents=True)
    text = "".join(f"line {i}\n" for i in range(30_000))
    (tmp_path / "lines" / "h" / "a.log").write_text(text)
    grown = tmp_path / "in" / "h" / "a.log"
    inodes = set()
    for share in (0.0, 0.3, 0.3, 1.0):
        tail.grown(spark, str(tmp_path / "lines"), str(tmp_path / "in"), share)
        assert grown.read_text() == text[: int(len(text) * share)]
        inodes.add(grown.stat().st_ino)
    assert len(inodes) == 1
