"""Filters on a small Serilog sample; line numbers worked out by hand."""

import pytest

from sparklog.operators.logframe import LogFrame
from sparklog.plans.builtins import builtin
from sparklog.plans.filter_lang import c_double, parse
from sparklog.plans.template import FilterError
from sparklog.sources.lines import lines_from_iterable

TEXT = """header without a shape
2026-03-01 08:00:00.000 +01:00 [INF] started Ünïcode
2026-03-01 08:00:00.250 +01:00 [DBG]: cache warm
   key=1
2026-03-01 08:15:30.000 +01:00 [ERR] request FAILED
   at main
   at run
2026-03-01 23:59:59.999 +01:00 [WRN] slow disk
2026-03-02 08:00:00.000 +01:00 [FTL]: failed again
"""
CASES = [
    ("level == ERR", [5, 6, 7]), ("level=ERR", [5, 6, 7]), ("level != INF", [3, 4, 5, 6, 7, 8, 9]), ("not level == INF", [1, 3, 4, 5, 6, 7, 8, 9]),
    ("message ~ failed", [5, 6, 7, 9]), ("message contains FAIL", [5, 6, 7, 9]), ("message !~ failed", [2, 3, 4, 8]), ("message ~ ''", [2, 3, 4, 5, 6, 7, 8, 9]),
    ("raw ~ header", [1]), ("raw ~ 'at main'", []), ("message ~ ünïcode", []), ("message ~ Ünïcode", [2]),
    ("level==ERR || level==FTL", [5, 6, 7, 9]), ("level==ERR or level==FTL and line < 9", [5, 6, 7]), ("!(level==INF || level==DBG) && line>1", [5, 6, 7, 8, 9]),
    ("NOT level==INF AND line<=3", [1, 3, 4]), ("line >= 0x5", [5, 6, 7, 8, 9]), ("lineno == 2.0", [2]), ("line == nan", []), ("line != nan", [1, 2, 3, 4, 5, 6, 7, 8, 9]),
    ("timestamp == 2026-03-01", [2, 3, 4, 5, 6, 7, 8]), ("timestamp != 2026-03-01", [9]), ("timestamp == '2026-03-01 08:00'", [2, 3, 4]), ("timestamp == '2026-03-01 08:00:00'", [2, 3, 4]),
    ("timestamp == '2026-03-01 08:00:00.250'", [3, 4]), ("timestamp == 08:00", [2, 3, 4, 9]), ("timestamp >= 08:15", [5, 6, 7, 8]), ("timestamp < 08:00:00.2", [2, 9]),
    ("timestamp > '2026-03-01'", [2, 3, 4, 5, 6, 7, 8, 9]), ("timestamp ~ 08:15", [5, 6, 7]), ("timestamp ~ junk", []), ("level > INF", [8]), ("level <= 'ERR'", [3, 4, 5, 6, 7]),
]


@pytest.fixture(scope="module")
def frame(spark):
    return LogFrame(lines_from_iterable(spark, [TEXT]), builtin("serilog")).cache()


@pytest.mark.parametrize("text, want", CASES)
def test_lines(frame, text, want):
    assert sorted(r.lineno for r in frame.filter(text).rows().collect()) == want


@pytest.mark.parametrize("text", ["", "level", "level ==", "level == ERR &&", "(level == ERR", "level == ERR)", "nope == 1", "timestamp == junk", "timestamp > junk", "line ~ 3", "line == x", "level == 'x", "level == ERR WRN", "&& level == ERR", "not", "level ?? 1"])
def test_errors(text):
    with pytest.raises(FilterError):
        parse(text, builtin("serilog"))


def test_numbers():
    assert [c_double(x) for x in ("0x1F", " 1e3", "-.5", "inf", "1d", "", "1 ", "0x1p3")] == [31, 1000, -0.5, float("inf"), None, None, None, 8]
    with pytest.raises(FilterError):
        parse("status > high", builtin("apache"))
    assert parse("status == high", builtin("apache")).number is None


def test_frame(spark, frame):
    assert frame.stats().first().asDict() == {"total": 9, "matched": 5, "visible": 9}
    some = frame.filter("message ~ failed")
    assert some.stats().first().visible == 4
    assert [r.lineno for r in some.goto(6).collect()] == [6] and [r.lineno for r in some.goto(99).collect()] == [9]
    assert some.search("AT RUN").first()[1] is not None
    assert [(r.lineno, r.wrapped) for r in some.search("failed", 5, inclusive=False).collect()] == [(9, False)]
    assert [(r.lineno, r.wrapped) for r in some.search("failed", 9, inclusive=False).collect()] == [(5, True)]
    assert [(r.lineno, r.wrapped) for r in some.search("failed", 9, forward=False, inclusive=False).collect()] == [(5, False)]
    assert [r.lineno for r in some.page(6, 2).collect()] == [6, 7] and [r.lineno for r in some.page(7, 2, forward=False).collect()] == [6, 7]
    assert some.search("nowhere").collect() == []
    assert [(r.entry_id, r.continuations) for r in some.entries().orderBy("entry_id").collect()] == [(5, ["   at main", "   at run"]), (9, [])]
    assert list(some.print_lines())[1] == "   at main"
    assert {(r.state, r.name) for r in frame.inspect(1).collect()} == {("did not match template", "raw")}
    assert [(r.name, r.value, r.more) for r in frame.inspect(5, shown=7).orderBy("pos").collect()] == [("timestamp", "2026-03", 23), ("level", "ERR", 0), ("message", "request", 7)]
    other, why = some.with_template(builtin("plain"))
    assert why is None and other.rows().count() == 2
    other, why = frame.filter("level == ERR").with_template(builtin("plain"))
    assert "level" in why and other.rows().count() == 9


def test_empty(spark):
    frame = LogFrame(lines_from_iterable(spark, []))
    assert frame.template.name == "plain" and frame.stats().first().asDict() == {"total": 0, "matched": 0, "visible": 0}
