import pytest

from sparklog.operators.parse import parse_rows
from sparklog.plans import tsfmt
from sparklog.plans.template import parse


@pytest.mark.parametrize(
    "fmt, text, want",
    [
        ("%Y-%m-%d", "2026-06-01", 1780272000), ("%b %e", "Jun  1", 13046400), ("%Y-%m-%d %H:%M:%S.%f%z", "2026-06-01 00:00:01.5 +02:00", 1780272001.5),
        ("%y-%j", "26-152", 1780272000), ("%y", "69", 3124224000), ("%y", "70", 0), ("%d/%B/%Y:%I %p", "1/june/2026:12 am", 1780272000),
        ("%d/%b/%Y %I%p", "01/JUN/2026 1PM", 1780272000 + 46800), ("%Y-%m-%d", "2026-02-31", 1772496000), ("%H:%M:%S", "23:59:60", 86400),
        ("%A %H", "Monday 7", 25200), ("%H%Z", "7 CEST", 25200), ("%H%%", "7%", 25200), ("%Y", "0000", -62167219200),
    ],
)
def test_values(spark, fmt, text, want):
    got = tsfmt.parse(text, fmt)
    assert got[:2] == (pytest.approx(want), len(text))
    t = parse(f'entry: %{{t}}\nfield t: format="{fmt}"')
    df = spark.createDataFrame([("p", 0, 1, text)], "path string, block long, lineno long, raw string")
    assert parse_rows(df, t).first().n.t == pytest.approx(want)


@pytest.mark.parametrize("fmt, text", [("%Y", "202"), ("%m", "13"), ("%m", "0"), ("%d", "32"), ("%H", "24"), ("%j", "367"), ("%z", "+1:2"), ("%q", "q"), ("%b", "jux"), ("%Y %m", "202601"), ("%p", "xm"), ("%f", "")])
def test_mismatches(fmt, text):
    assert tsfmt.parse(text, fmt) is None


def test_literals():
    assert tsfmt.literal("2026-06-01", "%H:%M")[0] == 1780272000
    assert tsfmt.literal("19:18", "%Y-%m-%d")[1] == {"hour", "minute"}
    assert tsfmt.literal("2026-06-01 junk", "%Y-%m-%d") is None
    assert tsfmt.parse("1.1234567890", "%S.%f")[1] == 11
