import pytest

from sparklog.operators.logframe import LogFrame
from sparklog.operators.parse import filter_entries, parse
from sparklog.plans.builtins import builtin
from sparklog.plans.template import LogIOError
from sparklog.sources.lines import lines_from_text, read_lines, read_template


def write(path, n):
    text = ""
    for i in range(n):
        text += f"2026-01-01 00:00:{i % 60:02d},{i % 1000:03d} - app - {'ERROR' if i % 7 == 0 else 'INFO'} - m{i}\n"
        text += "".join(f"  trace {k}\n" for k in range(40 if i % 50 == 0 else i % 7 == 0 and 2 or 0))
    path.write_text(text)
    return text.split("\n")[:-1]


@pytest.mark.parametrize("size", ["128m", "512"])
def test_numbers_and_entries_do_not_depend_on_splits(spark, tmp_path, size):
    lines = write(tmp_path / "a.log", 300)
    (tmp_path / "b.log").write_bytes(b"x\ry\r\n\r\n\nlast")
    (tmp_path / "c.log").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = read_lines(spark, str(tmp_path))
        rows = {(r.path.rsplit("/", 1)[1], r.lineno): r.raw for r in got.collect()}
        assert rows == {("a.log", i): x for i, x in enumerate(lines, 1)} | {("b.log", 1): "x\ry", ("b.log", 2): "", ("b.log", 3): "", ("b.log", 4): "last"}
        t = builtin("python")
        parsed = parse(read_lines(spark, str(tmp_path / "a.log")), t)
        entry, want, shown = 0, {}, []
        for i, x in enumerate(lines, 1):
            entry = entry if x.startswith("  ") else i
            want[i] = entry
            shown += [i] * ("ERROR" in lines[entry - 1])
        assert {r.lineno: r.entry_id for r in parsed.collect()} == want
        assert sorted(r.lineno for r in filter_entries(parsed, t, "level == ERROR").collect()) == shown
        assert LogFrame(read_lines(spark, str(tmp_path / "a.log"))).template.name == "python"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts(spark):
    df = spark.createDataFrame([("a", "x\ny\n"), ("b", ""), ("c", None), ("d", "\n"), ("e", "z\r")], "id string, t string")
    rows = [(r.path, r.lineno, r.raw) for r in lines_from_text(df, "t", df.id).orderBy("path", "lineno").collect()]
    assert rows == [("a", 1, "x"), ("a", 2, "y"), ("d", 1, ""), ("e", 1, "z")]


def test_missing(spark, tmp_path):
    with pytest.raises(LogIOError):
        read_lines(spark, str(tmp_path / "nope"))
    (tmp_path / "t.lxt").write_text("name: t\nentry: %{a}\n")
    assert read_template(spark, str(tmp_path / "t.lxt")).name == "t"


def test_written_lines(spark, tmp_path):
    lines = write(tmp_path / "a.log", 50)
    LogFrame(read_lines(spark, str(tmp_path / "a.log"))).write_lines(str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == lines


def test_numbered_lines_are_dealt_by_ranges(spark, tmp_path, monkeypatch):
    from sparklog.sources import lines as module

    monkeypatch.setattr(module, "BLOCK_LINES", 7)
    text = write(tmp_path / "a.log", 120)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(text, 1)], "i long, x string")
    t, entry, want = builtin("python"), 0, {}
    for i, x in enumerate(text, 1):
        entry = entry if x.startswith("  ") else i
        want[i] = entry
    for rows in (module.lines_from_rows(df, "x", "i"), module.lines_from_iterable(spark, ["\n".join(text)]), module.lines_from_text(spark.createDataFrame([("\n".join(text),)], "t string"), "t")):
        assert rows.select("block").distinct().count() > 10
        assert {r.lineno: r.entry_id for r in parse(rows, t).collect()} == want
        shown = {r.lineno for r in filter_entries(parse(rows, t), t, "level == ERROR").collect()}
        assert shown == {i for i in want if "ERROR" in text[want[i] - 1]}


@pytest.mark.parametrize("size", ["128m", "700"])
@pytest.mark.parametrize("expression", ["level == ERROR", "line > 40 && level != INFO", "not level == ERROR", "raw ~ HEADER", "message ~ m7"])
def test_scan_order_and_windows_agree(spark, tmp_path, size, expression):
    from sparklog.sources.lines import lines_from_rows

    text = write(tmp_path / "a.log", 90)
    (tmp_path / "b.log").write_text("# HEADER\n  of b\n" + "\n".join(text[50:160]) + "\n")
    texts = {"a.log": text, "b.log": ["# HEADER", "  of b", *text[50:160]]}
    t = builtin("python")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        kept = LogFrame(read_lines(spark, str(tmp_path)), t, expression)
        got = {(r.path.rsplit("/", 1)[1], r.lineno): (r.entry_id, r.visible, r.raw, r.f.message) for r in kept.marked().collect()}
        again = {(r.path.rsplit("/", 1)[1], r.lineno) for r in LogFrame(read_lines(spark, str(tmp_path)), t).cache().filter(expression).rows().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    df = spark.createDataFrame([(p, i, x) for p, rows in texts.items() for i, x in enumerate(rows, 1)], "p string, i long, x string").repartition(5)
    other = LogFrame(lines_from_rows(df, "x", "i", "p"), t, expression)
    want = {(r.path, r.lineno): (r.entry_id, r.visible, r.raw, r.f.message) for r in other.marked().collect()}
    assert got == want and again == {k for k, v in want.items() if v[1]}
    for p, rows in texts.items():
        entry = 0
        for i, x in enumerate(rows, 1):
            entry = entry if (x.startswith("  ") or x.startswith("#")) and i > 1 else i
            assert got[p, i][0] == entry and got[p, i][1] == got[p, entry][1] and got[p, i][2] == x


def test_positions_in_several_files(spark, tmp_path):
    for name, n in (("a.log", 5), ("b.log", 8)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    log = LogFrame(read_lines(spark, str(tmp_path)), builtin("plain"))
    a, b = sorted(r.path for r in log.rows().select("path").distinct().collect())
    raws = lambda df: [r.raw for r in df.collect()]
    assert raws(log.goto(4, a)) == ["a.log 4"] and raws(log.goto(7, a)) == ["b.log 1"] and raws(log.goto(99, b)) == ["b.log 8"]
    assert raws(log.page(4, 4, path=a)) == ["a.log 4", "a.log 5", "b.log 1", "b.log 2"]
    assert raws(log.page(2, 4, False, b)) == ["a.log 4", "a.log 5", "b.log 1", "b.log 2"]
    assert raws(log.search("LOG 1", 2, path=a)) == ["b.log 1"] and raws(log.search("log 1", 2, path=b)) == ["a.log 1"]
    assert raws(log.search("log 5", 1, False, path=b)) == ["a.log 5"]
    assert raws(log.first()) == ["a.log 1"] and raws(log.last()) == ["b.log 8"]
    assert log.position(2, b).first()["rank"] == 7
