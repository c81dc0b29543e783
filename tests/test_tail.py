import pytest
import random
import time

from sparklog.operators.parse import filter_entries, parse
from sparklog.plans.builtins import builtin
from sparklog.sources.lines import lines_from_iterable
from sparklog.streaming.tail import follow, tail_lines

TEXT = "".join(f"2026-01-01 00:00:{i:02d},000 - app - {'ERROR' if i % 3 == 0 else 'INFO'} - m{i}\n" + "  trace\n" * (i % 2) for i in range(40))


def run(spark, path, check, got, expression="level == ERROR", **options):
    def sink(rows, batch):
        got.extend((r.generation, r.lineno, r.raw, r.entry_id, r.visible) for r in rows.collect())

    q = follow(tail_lines(spark, str(path), **options), builtin("python"), expression, sink, str(check), once=True)
    q.awaitTermination(120)
    assert q.exception() is None


def test_growth_equals_batch(spark, tmp_path):
    path, got, r = tmp_path / "a.log", [], random.Random(1)
    path.write_text("")
    at = 0
    for _ in range(4):
        step = r.randrange(1, len(TEXT) // 3)
        with path.open("a") as f:
            f.write(TEXT[at : at + step])
        at += step
        run(spark, path, tmp_path / "c", got)
    with path.open("a") as f:
        f.write(TEXT[at:])
    run(spark, path, tmp_path / "c", got, batch_bytes=200)
    t = builtin("python")
    rows = parse(lines_from_iterable(spark, [TEXT]), t, False)
    want = {(x.lineno, x.raw, x.entry_id) for x in rows.collect()}
    assert {(n, raw, e) for _, n, raw, e, _ in got} == want and len(got) == len(want)
    shown = {x.lineno for x in filter_entries(rows, t, "level == ERROR", False).collect()}
    assert {n for _, n, _, _, v in got if v} == shown


def test_once_reads_all_in_batches(spark, tmp_path):
    big, small, got, sizes = tmp_path / "a.log", tmp_path / "b.log", [], []
    big.write_text("".join(f"2026-01-01 00:00:00,000 - app - {'ERROR' if i % 3 == 0 else 'INFO'} - m{i}\n  trace {i}\n" for i in range(6000)) + "held")
    small.write_text("one\n")

    def sink(rows, batch):
        part = [(r.path, r.lineno, r.visible) for r in rows.collect()]
        sizes.append(len(part))
        got.extend(part)
        with big.open("a") as f:  # grows while it is read: what comes later isn't waited for
            f.write("x" * 200_000)

    lines = tail_lines(spark, f"{tmp_path}/*.log", batch_bytes=100_000)
    follow(lines, builtin("python"), "level == ERROR", sink, str(tmp_path / "c"), once=True).awaitTermination(120)
    assert sorted(got) == [(str(big), n, (n - 1) // 2 % 3 == 0) for n in range(1, 12001)] + [(str(small), 1, False)]
    assert 3 < len(sizes) < 9 and max(sizes) < 6000  # of 12,001


def test_tail_rotation_and_missing(spark, tmp_path):
    path, got = tmp_path / "a.log", []
    path.write_bytes(b"one\r\ntwo\nthr")
    run(spark, path, tmp_path / "c", got, None)
    assert [x[:3] for x in got] == [(0, 1, "one"), (0, 2, "two")]
    path.write_text("new\n")
    run(spark, path, tmp_path / "c", got, None)
    assert got[-1][:3] == (1, 1, "new") and len(got) == 3
    path.unlink()
    run(spark, path, tmp_path / "c", got, None)
    assert len(got) == 3
    path.write_text("new\nmore")
    run(spark, path, tmp_path / "c", got, None, flush_tail=True)
    assert got[-1][:3] == (1, 2, "more") and len(got) == 4


def test_stream_in_bursts(spark):
    import threading

    from sparklog.plans.builtins import builtin
    from sparklog.plans.template import FilterError
    from sparklog.streaming.pipe import bursts, follow_stream

    gate = threading.Event()

    def chunks():
        yield "2026-06-01 19:18:23,123 - a - ERROR - one\r\n  more\n2026-06-01 19:18:2"
        assert gate.wait(60)
        yield "4,123 - a - INFO - two\n  of two\n"
        yield "2026-06-01 19:18:25,123 - a - ERROR - three\n  tail"

    got = follow_stream(spark, chunks(), builtin("python"), "level == ERROR")
    assert [next(got), next(got)] == ["2026-06-01 19:18:23,123 - a - ERROR - one", "  more"]  # before the end has come
    gate.set()
    assert list(got) == ["2026-06-01 19:18:25,123 - a - ERROR - three", "  tail"]
    text = [f"x {i}\n" for i in range(25)]
    assert [x for b in bursts(text, 4) for x in b] == [f"x {i}" for i in range(25)] and max(map(len, bursts(text, 4))) <= 4
    assert list(follow_stream(spark, text, None, "line > 23", most=7)) == ["x 23", "x 24"] and list(bursts([])) == []
    with pytest.raises(FilterError):
        list(follow_stream(spark, ["x\n"], builtin("plain"), "level == 1"))

    def broken():
        yield "a\n"
        raise OSError("gone")

    with pytest.raises(OSError):
        list(bursts(broken()))


def test_backlog_of_a_stream_is_judged_together(spark, monkeypatch):
    from sparklog.plans.builtins import builtin
    from sparklog.streaming import pipe

    text = "".join(f"2026-06-01 19:18:23,123 - a - {'ERROR' if i % 3 == 0 else 'INFO'} - {i}\n  of {i}\n" for i in range(6000))
    asked, plain = [], pipe.parse_rows
    monkeypatch.setattr(pipe, "parse_rows", lambda *a: asked.append(1) or plain(*a))
    chunks = (text[i : i + 50_000] for i in range(0, len(text), 50_000))
    got = list(pipe.follow_stream(spark, chunks, builtin("python"), "level == ERROR", most=101))
    assert got == [x for i, x in enumerate(text.splitlines()) if i // 2 % 3 == 0]  # entries are cut by the bursts
    assert len(asked) < 30  # 119 bursts of 101 lines
    sizes = [len(b) for b in pipe.bursts((f"{i}\n" for i in range(1000)), 10)]
    assert max(sizes) <= 10 and sum(sizes) == 1000
