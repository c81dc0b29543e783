from pyspark.sql import functions as F

from sparklog.functions import text as fn
from sparklog.functions.color import style


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_severity(spark):
    want = {"ERR": 4, "WARNING": 3, "FTL": 5, "CRITICAL": 5, "debug": 1, "TRACE": 0, "hello": -1, "Fault": 5, "Default": 2, "notice": 2, "": -1, "Verbose": 0}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", fn.severity_class(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in rows} == want


def test_text(spark):
    lit = F.lit
    assert value(spark, fn.ascii_lower(lit("ÀBC"))) == "Àbc"
    assert value(spark, fn.ascii_lower(lit("ABC"))) == "abc"
    assert value(spark, fn.equal_ignoring_case(lit("aB"), lit("Ab"))) and not value(spark, fn.equal_ignoring_case(lit("à"), lit("À")))
    assert [value(spark, fn.find(lit("xAbab"), n, fold=f)) for n, f in (("ab", True), ("ab", False), ("", True), ("q", True))] == [1, 3, 0, -1]
    assert value(spark, fn.trim(lit(" \t a b \r\n"))) == "a b"
    assert value(spark, fn.truncate(lit("abc"), 2)) == "ab"
    assert value(spark, fn.hit_positions(lit("aAaa"), "aa")) == [0, 1, 2] and value(spark, fn.hit_positions(lit("b"), "aa")) == []
    assert value(spark, fn.mask_control(lit("a\tb\x01"))) == "a b "
    assert value(spark, fn.expand_tabs(lit("a\tbc\t\x02d"))) == "a       bc      ?d"
    assert value(spark, fn.wrap(lit("abcde"), 2)) == ["ab", "cd", "e"] and value(spark, fn.wrap(lit(""), 2)) == []


def test_style(spark):
    names = ["FATAL", "ERR", "WRN", "INF", "DBG", "TRC"]
    assert [value(spark, style(F.lit(x), F.lit(False), True, 0x5FAFD7)) for x in names] == ["bold red", "red", "yellow", "256:74", "cyan", "grey"]
    assert value(spark, style(F.lit("ERR"), F.lit(True), True, None)) == "dim"
    assert value(spark, style(F.lit("WRN"), F.lit(False), False, None)) == ""
