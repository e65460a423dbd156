"""Verdicts on strips whose lines come apart, twice, late or never."""

from datetime import datetime, timedelta

from swathgrid.streaming import admission, jobs

START = datetime(2024, 1, 1)
SCHEMA = "strip_id string, line int, lines int, n_samples bigint, n_valid bigint, ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def judged(spark, tmp_path, batches, wait=60, keep=600):
    session = admission.keyed_session(spark)
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    got = []
    for batch in batches:
        session.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = session.readStream.schema(SCHEMA).parquet(src)
        verdicts = admission.judge_strips(stream, "0 minutes", wait * 60_000, keep * 60_000)
        job = admission.start_judging(verdicts, out, log)
        rows = jobs.drain(job, lambda: session.read.schema(admission.VERDICT).parquet(out)).collect()
        got.append({(r.strip_id, r.n_samples, r.n_valid, r.status, r.is_daytime) for r in rows})
        assert len(rows) == len(got[-1])
    return got


def test_lines_in_any_batch(spark, tmp_path):
    batches = [
        [("a", 0, 9, 5, 0, at(0)), ("b", 0, 2, 5, 0, at(0)), ("c", 0, 1, 5, 2, at(0)), ("d", 3, 9, 5, 5, at(0))],
        # Again, a line nobody asked for, and the second line of b, which is its middle and last.
        [("a", 0, 9, 5, 5, at(1)), ("a", 5, 9, 5, 5, at(1)), ("b", 1, 2, 5, 0, at(1)), ("a", 4, 9, 6, 1, at(1))],
        [("a", 8, 9, 7, 0, at(2)), ("b", 0, 2, 5, 5, at(2)), ("c", 0, 1, 9, 9, at(2))],
        # Time passes: d never had a sampled line.
        [("z", 0, 9, 1, 0, at(100))],
        [("z", 4, 9, 1, 0, at(300))],
    ]
    got = judged(spark, tmp_path, batches)
    assert got[0] == {("c", 5, 2, "day", True)}
    assert got[1] == got[0] | {("b", 10, 0, "night", False)}
    assert got[2] == got[1] | {("a", 18, 1, "day", True)}
    assert ("d", 0, 0, "error", True) in got[3]
    assert ("z", 2, 0, "error", True) not in got[3]
    assert {v[0] for v in got[4]} <= {"a", "b", "c", "d", "z"}


def test_marks_are_forgotten_in_time(spark, tmp_path):
    one = lambda minute: [("a", 0, 1, 1, 1, at(minute))]
    got = judged(spark, tmp_path, [one(0), one(5), [("x", 0, 9, 1, 0, at(90))], [("a", 0, 1, 2, 0, at(95))]], wait=600, keep=60)
    assert got[1] == {("a", 1, 1, "day", True)}
    assert ("a", 2, 0, "night", False) in got[3]
