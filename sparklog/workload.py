"""Queries over the tables: typed rows are rendered as log lines, which are then parsed,
filtered and looked at. The SQL computes the answers from the typed columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .functions.color import rgb_to_256, style
from .operators import infer as inf
from .operators.detect import detect, ratios
from .operators.logframe import LogFrame, template_list
from .operators.parse import evaluate, filter_entries, parse, parse_rows, segments, visible, with_integers, with_moment
from .plans.builtins import all_builtins, builtin
from .plans.template import Template
from .plans.template import parse as parse_template
from .sources.lines import lines_from_rows, lines_from_text, read_lines, read_template, write_template
from .sources.shared import shared_folder
from .streaming.tail import follow, tail_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LEVEL = "CASE event_type WHEN 'error' THEN 'ERR' WHEN 'purchase' THEN 'WRN' WHEN 'signup' THEN 'INF' WHEN 'view' THEN 'DBG' ELSE 'VRB' END"
PY_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'CRITICAL' END"
MAC_TYPE = "CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Fault' WHEN 'signup' THEN 'Info' WHEN 'view' THEN 'Debug' ELSE 'Default' END"
STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'purchase' THEN 201 WHEN 'signup' THEN 302 WHEN 'view' THEN 200 ELSE 404 END"
VALUE = "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)"
MESSAGE = f"concat('user=', user_id, ' type=', event_type, ' value=', {VALUE})"
T = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"

#: Lines of events, by template.
SHAPES = {
    "serilog": f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), ' +00:00 [', {LEVEL}, CASE WHEN user_id % 2 = 0 THEN ']: ' ELSE '] ' END, {MESSAGE})",
    "syslog": f"concat(date_format(ts, 'MMM '), lpad(CAST(day(ts) AS STRING), 2, ' '), date_format(ts, ' HH:mm:ss'), ' host', user_id, ' ', event_type, '[7]: ', {MESSAGE})",
    "syslog-iso": f"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+02:00 host', user_id, ' ', event_type, ': ', {MESSAGE})",
    "dmesg": f"concat('[', lpad({VALUE}, 12, ' '), '] ', {MESSAGE})",
    "python": f"concat({T}, ',', date_format(ts, 'SSS'), ' - app.', user_id, ' - ', {PY_LEVEL}, ' - ', {MESSAGE})",
    "macos": f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '-0700 0x', lower(hex(user_id)), '   ', {MAC_TYPE}, '   0x0   ', user_id, '  -1  kernel: ', {MESSAGE})",
    "apache": f"concat('10.0.0.', user_id % 256, ' - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '?v=', {VALUE}, ' HTTP/1.1\" ', {STATUS}, ' ', user_id * 37)",
    "plain": MESSAGE,
}
ORDERS = """name: orders
entry: %{id:int} | %{priority} | %{price:float} | %{day} | %{status:word}
field priority: values="1-URGENT|2-HIGH|3-MEDIUM|4-NOT SPECIFIED|5-LOW"
field day: format="%Y-%m-%d"
"""
LINEITEM = """name: lineitem
entry: %{order:int} %{line:int} %{quantity:float} %{price:float} <%{flag}/%{status}> %{shipped}
field flag: values=A|N|R
field status: values=O|F
field shipped: type=timestamp format="%d/%b/%Y"
"""
VARIANTS = """name: variants
entry: A %{id:int} %{value:float} %{kind:word}
entry: B %{id:int} %{kind:word}
"""

#: The same rows in SQL.
_E = f"""e AS (SELECT event_id + 1 AS lineno, ts, event_id, user_id, event_type, value, {LEVEL} AS lvl, {PY_LEVEL} AS pylvl, {MAC_TYPE} AS mac, {STATUS} AS status,
 CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t,
 'user=' || user_id || ' type=' || event_type || ' value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS msg FROM events)"""


def _sql(body: str) -> str:
    return f"WITH {_E} {body}"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_lines(spark: SparkSession, sf: str, shape: str) -> DataFrame:
    return lines_from_rows(_table(spark, sf, "events"), F.expr(SHAPES[shape]), F.expr("event_id + 1"))


def _register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _flat(rows: DataFrame, template: Template) -> DataFrame:
    numbers = [F.col("n")[f.name].alias(f"n_{f.name}") for f in template.fields if f.type in ("int", "float")]
    numbers += [F.round(F.col("n")[f.name] * 1e6).cast("long").alias(f"us_{f.name}") for f in template.fields if f.type == "timestamp"]
    return rows.select("lineno", "matched", *[F.col("f")[f.name].alias(f"f_{f.name}") for f in template.fields], *numbers)


#: Parsed columns of each shape.
_FIELDS = {
    "serilog": "t || ' +00:00' AS f_timestamp, lvl AS f_level, msg AS f_message, epoch_us(ts) AS us_timestamp",
    "syslog": "strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') AS f_timestamp, 'host' || user_id AS f_host, event_type || '[7]' AS f_proc, msg AS f_message, epoch_us(make_timestamp(1970, month(ts), 1, hour(ts), minute(ts), CAST(second(ts) AS DOUBLE))) + (day(ts) - 1) * 86400000000 AS us_timestamp",
    "syslog-iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00' AS f_timestamp, 'host' || user_id AS f_host, event_type AS f_proc, msg AS f_message, epoch_us(ts) AS us_timestamp",
    "dmesg": "v AS f_time, msg AS f_message, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS n_time",
    "python": "strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS f_timestamp, 'app.' || user_id AS f_logger, pylvl AS f_level, msg AS f_message, epoch_us(ts) // 1000 * 1000 AS us_timestamp",
    "macos": "t || '-0700' AS f_timestamp, '0x' || lower(to_hex(user_id)) AS f_thread, mac AS f_type, '0x0' AS f_activity, CAST(user_id AS VARCHAR) AS f_pid, '-1' AS f_ttl, 'kernel' AS f_process, msg AS f_message, epoch_us(ts) AS us_timestamp, CAST(user_id AS DOUBLE) AS n_pid, CAST(-1 AS DOUBLE) AS n_ttl",
    "apache": "'10.0.0.' || (user_id % 256) AS f_host, '-' AS f_ident, 'u' || user_id AS f_user, strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS f_timestamp, 'GET /' || event_type || '?v=' || v || ' HTTP/1.1' AS f_request, CAST(status AS VARCHAR) AS f_status, CAST(user_id * 37 AS VARCHAR) AS f_size, epoch_us(date_trunc('second', ts)) AS us_timestamp, CAST(status AS DOUBLE) AS n_status",
    "plain": "msg AS f_message",
}
for _shape, _cols in _FIELDS.items():
    _register(f"parse_{_shape.replace('-', '_')}", _sql(f"SELECT lineno, true AS matched, {_cols} FROM e"))(
        lambda spark, sf, s=_shape: _flat(parse_rows(event_lines(spark, sf, s), builtin(s)), builtin(s))
    )


@_register("parse_custom", "SELECT o_orderkey + 1 AS lineno, true AS matched, CAST(o_orderkey AS VARCHAR) AS f_id, o_orderpriority AS f_priority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS f_price, strftime(o_orderdate, '%Y-%m-%d') AS f_day, o_orderstatus AS f_status, CAST(o_orderkey AS DOUBLE) AS n_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS n_price, epoch_us(date_trunc('day', o_orderdate)) AS us_day FROM orders")
def parse_custom(spark, sf):
    t = parse_template(ORDERS)
    return _flat(parse_rows(order_lines(spark, sf), t), t)


def order_lines(spark, sf):
    raw = F.expr("concat(o_orderkey, ' | ', o_orderpriority, ' | ', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' | ', date_format(o_orderdate, 'yyyy-MM-dd'), ' | ', o_orderstatus)")
    return lines_from_rows(_table(spark, sf, "orders"), raw, F.expr("o_orderkey + 1"))


@_register("parse_wide", "SELECT l_orderkey * 100 + l_linenumber AS lineno, true AS matched, CAST(l_orderkey AS VARCHAR) AS f_order, CAST(l_linenumber AS VARCHAR) AS f_line, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS f_quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS f_price, l_returnflag AS f_flag, l_linestatus AS f_status, strftime(l_shipdate, '%d/%b/%Y') AS f_shipped, CAST(l_orderkey AS DOUBLE) AS n_order, CAST(l_linenumber AS DOUBLE) AS n_line, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS n_quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS n_price, epoch_us(date_trunc('day', l_shipdate)) AS us_shipped FROM lineitem")
def parse_wide(spark, sf):
    t = parse_template(LINEITEM)
    return _flat(parse_rows(wide_lines(spark, sf), t), t)


def wide_lines(spark, sf):
    raw = F.expr("concat(l_orderkey, ' ', l_linenumber, ' ', CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING), ' ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), ' <', l_returnflag, '/', l_linestatus, '> ', date_format(l_shipdate, 'dd/MMM/yyyy'))")
    return lines_from_rows(_table(spark, sf, "lineitem"), raw, F.expr("l_orderkey * 100 + l_linenumber"))


def variant_lines(spark, sf):
    raw = F.expr(f"CASE WHEN user_id % 3 = 0 THEN concat('B ', user_id, ' ', event_type) WHEN user_id % 3 = 1 THEN concat('A ', user_id, ' ', {VALUE}, ' ', event_type) ELSE concat('C ', user_id) END")
    return lines_from_rows(_table(spark, sf, "events"), raw, F.expr("event_id + 1"))


@_register("parse_variants", _sql("SELECT lineno, user_id % 3 < 2 AS matched, CASE WHEN user_id % 3 < 2 THEN CAST(user_id AS VARCHAR) ELSE '' END AS f_id, CASE WHEN user_id % 3 = 1 THEN v ELSE '' END AS f_value, CASE WHEN user_id % 3 < 2 THEN event_type ELSE '' END AS f_kind, CASE WHEN user_id % 3 < 2 THEN CAST(user_id AS DOUBLE) END AS n_id, CASE WHEN user_id % 3 = 1 THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS n_value FROM e"))
def parse_variants(spark, sf):
    t = parse_template(VARIANTS)
    return _flat(parse_rows(variant_lines(spark, sf), t), t)


@_register("parse_pruned", _sql("SELECT lineno, lvl AS level FROM e WHERE lvl = 'ERR'"))
def parse_pruned(spark, sf):
    """Only one field is captured."""
    rows = parse_rows(event_lines(spark, sf, "serilog"), builtin("serilog"), ["level"])
    return rows.where(F.col("f.level") == "ERR").select("lineno", F.col("f.level").alias("level"))


# Filters: name, shape, expression, WHERE over e.
_TOD = "(epoch(ts) - floor(epoch(ts) / 86400) * 86400)"
FILTERS = [
    ("filter_eq", "serilog", "level == ERR", "lvl = 'ERR'"),
    ("filter_eq_alias", "serilog", "level=ERR", "lvl = 'ERR'"),
    ("filter_ne", "serilog", "level != ERR", "lvl <> 'ERR'"),
    ("filter_contains", "serilog", "message ~ TYPE=Err", "contains(msg, 'type=err')"),
    ("filter_contains_word", "serilog", "message contains 'type=err'", "contains(msg, 'type=err')"),
    ("filter_not_contains", "serilog", "message !~ TYPE=E", "NOT contains(msg, 'type=e')"),
    ("filter_gt_number", "apache", "status > 302", "status > 302"),
    ("filter_ge_number", "apache", "status >= 404", "status >= 404"),
    ("filter_lt_number", "apache", "status < 0302", "status < 302"),
    ("filter_le_number", "apache", "status <= 3.02e2", "status <= 302"),
    ("filter_eq_number", "apache", "status == 0200", "status = 200"),
    ("filter_hex_number", "apache", "status == 0xC8", "status = 200"),
    ("filter_ne_number", "apache", "status != 200", "status <> 200"),
    ("filter_number_as_text", "apache", "status ~ 0", "contains(CAST(status AS VARCHAR), '0')"),
    ("filter_float", "dmesg", "time > 100.5", "CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) > 100.5"),
    ("filter_order_text", "apache", "size > 1000", "CAST(user_id * 37 AS VARCHAR) > '1000'"),
    ("filter_le_text", "serilog", "level <= INF", "lvl <= 'INF'"),
    ("filter_and", "serilog", "level == ERR && message ~ 'user=1'", "lvl = 'ERR' AND contains(msg, 'user=1')"),
    ("filter_or", "serilog", "level == ERR || level == WRN", "lvl IN ('ERR', 'WRN')"),
    ("filter_not", "serilog", "not level == ERR", "lvl <> 'ERR'"),
    ("filter_paren", "serilog", "!(level == ERR or level == WRN) and line > 10", "lvl NOT IN ('ERR', 'WRN') AND lineno > 10"),
    ("filter_precedence", "serilog", "level == ERR or level == WRN and not line <= 100", "lvl = 'ERR' OR (lvl = 'WRN' AND lineno > 100)"),
    ("filter_raw", "serilog", "raw ~ '[ERR]'", "lvl = 'ERR' "),
    ("filter_line", "serilog", "line >= 10 && lineno < 20", "lineno >= 10 AND lineno < 20"),
    ("filter_empty_needle", "serilog", "message ~ ''", "true"),
    ("ts_day", "serilog", 'timestamp == "2024-01-05"', "CAST(ts AS DATE) = DATE '2024-01-05'"),
    ("ts_not_day", "serilog", 'timestamp != "2024-01-05"', "CAST(ts AS DATE) <> DATE '2024-01-05'"),
    ("ts_hour_range", "serilog", "timestamp >= '2024-01-05 10:00' && timestamp < '2024-01-05T11:00:00'", "ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-05 11:00:00'"),
    ("ts_minute", "serilog", "timestamp == '2024-01-01 00:06'", "date_trunc('minute', ts) = TIMESTAMP '2024-01-01 00:06:00'"),
    ("ts_second", "serilog", "timestamp == '2024-01-01 00:06:29'", "date_trunc('second', ts) = TIMESTAMP '2024-01-01 00:06:29'"),
    ("ts_exact", "serilog", "timestamp == '2024-01-01 00:06:29.165275'", "ts = TIMESTAMP '2024-01-01 00:06:29.165275'"),
    ("ts_after_day", "serilog", "timestamp > 2024-01-02", "ts > TIMESTAMP '2024-01-02 00:00:00'"),
    ("ts_time_of_day", "serilog", "timestamp >= 19:18:25.5", f"{_TOD} >= 69505.5"),
    ("ts_time_of_day_minute", "serilog", "timestamp == 19:18", f"{_TOD} >= 69480 AND {_TOD} < 69540"),
    ("ts_as_text", "serilog", "timestamp ~ '2024-01-05 1'", "contains(t, '2024-01-05 1')"),
    ("ts_without_year", "syslog", "timestamp >= 'Jan 15 12:00:00'", "ts >= date_trunc('year', ts) + INTERVAL 14 DAY + INTERVAL 12 HOUR"),
    ("ts_other_year", "syslog", "timestamp < 2024-01-01", "true"),
]
for _name, _shape, _expr, _where in FILTERS:
    _register(_name, _sql(f"SELECT lineno, event_id FROM e WHERE {_where}"))(
        lambda spark, sf, s=_shape, x=_expr: filter_entries(parse_rows(event_lines(spark, sf, s), builtin(s)), builtin(s), x).select("lineno", (F.col("lineno") - 1).alias("event_id"))
    )

# A field that a shape lacks: number comparisons fall back to the texts, '' against the value.
_LACK = [("missing_ne", "value != 5", "user_id % 3 = 0 OR user_id % 3 = 1 AND abs(CAST(v AS DOUBLE) - 5) >= 1e-9"), ("missing_lt", "value < 5", "user_id % 3 = 0 OR user_id % 3 = 1 AND CAST(v AS DOUBLE) < 5"), ("missing_gt", "value > 5", "user_id % 3 = 1 AND CAST(v AS DOUBLE) > 5")]
for _name, _expr, _where in _LACK:
    # Rows of no shape continue the entry above: they have its verdict.
    _register(f"{_name}_variant", _sql(f", j AS (SELECT lineno, CASE WHEN user_id % 3 < 2 OR lineno = 1 THEN coalesce({_where}, false) AND user_id % 3 < 2 END AS own FROM e), k AS (SELECT lineno, last_value(own IGNORE NULLS) OVER (ORDER BY lineno) AS v FROM j) SELECT lineno FROM k WHERE v"))(
        lambda spark, sf, x=_expr: filter_entries(parse_rows(variant_lines(spark, sf), parse_template(VARIANTS)), parse_template(VARIANTS), x).select("lineno")
    )


def error_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as Python logging lines; errors have two indented lines after them. Each user is
    a file of its own; the first line of each third user's file is of no shape."""
    raw = F.expr(f"filter(array(CASE WHEN user_id % 3 = 0 AND event_id = first THEN '# header' END, {SHAPES['python']}, CASE WHEN event_type = 'error' THEN '  File \"app.py\"' END, CASE WHEN event_type = 'error' THEN concat('  value ', {VALUE}) END), x -> x IS NOT NULL)")
    events = _table(spark, sf, "events")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    rows = events.join(firsts, "user_id").select("user_id", "event_id", F.posexplode(raw).alias("i", "raw"))
    header = (F.col("raw") == "# header").cast("int")
    return lines_from_rows(rows, "raw", F.when(header == 1, 1).otherwise(2 + F.col("event_id") * 4 + F.col("i")), F.col("user_id").cast("string"))


_LINES = f"""{_E}, f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id),
x AS (SELECT CAST(e.user_id AS VARCHAR) AS path, e.event_id, pylvl, msg, event_type, e.user_id % 3 = 0 AND e.event_id = first AS h FROM e JOIN f USING (user_id)),
l AS (SELECT path, CAST(1 AS BIGINT) AS lineno, false AS matched, NULL AS event_id, NULL AS pylvl, NULL AS msg FROM x WHERE h
 UNION ALL SELECT path, 2 + event_id * 4 + CAST(h AS INT), true, event_id, pylvl, msg FROM x
 UNION ALL SELECT path, 3 + event_id * 4 + CAST(h AS INT), false, event_id, pylvl, NULL FROM x WHERE event_type = 'error'
 UNION ALL SELECT path, 4 + event_id * 4 + CAST(h AS INT), false, event_id, pylvl, NULL FROM x WHERE event_type = 'error')"""
_ENTRY = "CASE WHEN lineno = 1 THEN 1 ELSE max(CASE WHEN matched THEN lineno END) OVER (PARTITION BY path ORDER BY lineno) END"


@_register("continuations", f"WITH {_LINES} SELECT path, lineno, matched, NOT matched AND lineno > 1 AS cont, CAST({_ENTRY} AS BIGINT) AS entry_id FROM l")
def continuations(spark, sf):
    return parse(error_lines(spark, sf), builtin("python")).select("path", "lineno", "matched", "cont", "entry_id")


@_register("filter_with_continuations", f"WITH {_LINES} SELECT path, lineno FROM l WHERE lineno > 1 AND pylvl = 'ERROR'")
def filter_with_continuations(spark, sf):
    t = builtin("python")
    return filter_entries(parse_rows(error_lines(spark, sf), t), t, "level == ERROR").select("path", "lineno")


@_register("unmatched_first_ne", f"WITH {_LINES} SELECT path, lineno FROM l WHERE lineno > 1 AND pylvl <> 'ERROR'")
def unmatched_first_ne(spark, sf):
    t = builtin("python")
    return filter_entries(parse_rows(error_lines(spark, sf), t), t, "level != ERROR").select("path", "lineno")


@_register("unmatched_first_not", f"WITH {_LINES} SELECT path, lineno FROM l WHERE lineno = 1 OR pylvl <> 'ERROR'")
def unmatched_first_not(spark, sf):
    t = builtin("python")
    return filter_entries(parse_rows(error_lines(spark, sf), t), t, "not level == ERROR").select("path", "lineno")


@_register("unmatched_first_raw", f"WITH {_LINES} SELECT path, lineno FROM l WHERE lineno = 1")
def unmatched_first_raw(spark, sf):
    t = builtin("python")
    return filter_entries(parse_rows(error_lines(spark, sf), t), t, "raw ~ '# HEADER'").select("path", "lineno")


@_register("evaluate_rows", f"WITH {_LINES} SELECT path, lineno, matched AND pylvl = 'ERROR' AS verdict FROM l WHERE pylvl IS NOT NULL UNION ALL SELECT path, lineno, false FROM l WHERE pylvl IS NULL")
def evaluate_rows(spark, sf):
    t = builtin("python")
    return evaluate(parse_rows(error_lines(spark, sf), t), t, "level == ERROR").select("path", "lineno", "verdict")


@_register("entries", f"WITH {_LINES} SELECT path, min(lineno) AS entry_id, any_value(msg) AS message, CAST(count(*) - 1 AS INTEGER) AS n_continuations FROM l WHERE pylvl = 'ERROR' GROUP BY path, event_id")
def entries(spark, sf):
    frame = LogFrame(error_lines(spark, sf), builtin("python"), "level == ERROR")
    return frame.entries().select("path", "entry_id", F.col("f.message").alias("message"), F.size("continuations").alias("n_continuations"))


def _serilog(spark, sf, expression=None) -> LogFrame:
    return LogFrame(event_lines(spark, sf, "serilog"), builtin("serilog"), expression)


@_register("stats", f"WITH {_LINES} SELECT count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (lineno > 1 AND pylvl = 'ERROR') AS visible FROM l")
def stats(spark, sf):
    return LogFrame(error_lines(spark, sf), builtin("python"), "level == ERROR").stats()


@_register("severity", _sql("SELECT lineno, CASE lvl WHEN 'ERR' THEN 4 WHEN 'WRN' THEN 3 WHEN 'INF' THEN 2 WHEN 'DBG' THEN 1 ELSE 0 END AS severity FROM e"))
def severity(spark, sf):
    return _serilog(spark, sf).rows().select("lineno", fn.severity_class(F.col("f.level")).alias("severity"))


@_register("severity_counts", _sql("SELECT CASE lvl WHEN 'ERR' THEN 4 WHEN 'WRN' THEN 3 WHEN 'INF' THEN 2 WHEN 'DBG' THEN 1 ELSE 0 END AS severity, count(*) AS n FROM e GROUP BY 1"))
def severity_counts(spark, sf):
    return _serilog(spark, sf).rows().groupBy(fn.severity_class(F.col("f.level")).alias("severity")).agg(F.count("*").alias("n"))


@_register("style", _sql("SELECT lineno, CASE lvl WHEN 'ERR' THEN 'red' WHEN 'WRN' THEN 'yellow' WHEN 'INF' THEN '' WHEN 'DBG' THEN 'cyan' ELSE 'grey' END AS style FROM e"))
def style_of_level(spark, sf):
    return _serilog(spark, sf).rows().select("lineno", style(F.col("f.level"), F.col("cont"), True, None).alias("style"))


@_register("search_next", _sql("SELECT lineno, lineno < 500 AS wrapped FROM e WHERE lvl = 'ERR' ORDER BY lineno < 500, lineno LIMIT 1"))
def search_next(spark, sf):
    return _serilog(spark, sf).search("[err]", 500).select("lineno", "wrapped")


@_register("search_next_exclusive", _sql("SELECT lineno, lineno <= 1 AS wrapped FROM e WHERE lvl = 'ERR' ORDER BY lineno <= 1, lineno LIMIT 1"))
def search_next_exclusive(spark, sf):
    return _serilog(spark, sf).search("[err]", 1, inclusive=False).select("lineno", "wrapped")


@_register("search_previous", _sql("SELECT lineno, lineno >= 500 AS wrapped FROM e WHERE lvl = 'ERR' AND event_type = 'error' ORDER BY lineno >= 500, lineno DESC LIMIT 1"))
def search_previous(spark, sf):
    return _serilog(spark, sf, "level == ERR").search("TYPE=error", 500, forward=False, inclusive=False).select("lineno", "wrapped")


@_register("search_wrapped", _sql("SELECT lineno, true AS wrapped FROM e WHERE lvl = 'ERR' ORDER BY lineno LIMIT 1"))
def search_wrapped(spark, sf):
    return _serilog(spark, sf).search("[err]", 10**9).select("lineno", "wrapped")


@_register("search_hits", _sql("SELECT lineno, CAST(instr(msg, 'type=') - 1 + length(t) + 14 + CAST(user_id % 2 = 0 AS INT) AS INTEGER) AS at FROM e"))
def search_hits(spark, sf):
    rows = _serilog(spark, sf).rows()
    return rows.select("lineno", F.explode(fn.hit_positions(F.col("raw"), "TYPE=")).alias("at"))


@_register("goto_line", _sql("SELECT lineno FROM e WHERE lvl = 'ERR' AND lineno >= 300 ORDER BY lineno LIMIT 1"))
def goto_line(spark, sf):
    return _serilog(spark, sf, "level == ERR").goto(300).select("lineno")


@_register("goto_beyond", _sql("SELECT max(lineno) AS lineno FROM e WHERE lvl = 'ERR'"))
def goto_beyond(spark, sf):
    return _serilog(spark, sf, "level == ERR").goto(10**9).select("lineno")


@_register("page_forward", _sql("SELECT lineno FROM e WHERE lvl = 'ERR' AND lineno >= 300 ORDER BY lineno LIMIT 20"))
def page_forward(spark, sf):
    return _serilog(spark, sf, "level == ERR").page(300, 20).select("lineno")


@_register("page_back", _sql("SELECT lineno FROM e WHERE lvl = 'ERR' AND lineno <= 300 ORDER BY lineno DESC LIMIT 20"))
def page_back(spark, sf):
    return _serilog(spark, sf, "level == ERR").page(300, 20, forward=False).select("lineno")


@_register("first_last", _sql("SELECT 'first' AS which, min(lineno) AS lineno FROM e UNION ALL SELECT 'last', max(lineno) FROM e"))
def first_last(spark, sf):
    frame = _serilog(spark, sf)
    return frame.first().select(F.lit("first").alias("which"), "lineno").unionByName(frame.last().select(F.lit("last").alias("which"), "lineno"))


@_register("position", _sql("SELECT count(*) FILTER (lineno <= 300) AS rank, count(*) AS of, CAST(count(*) FILTER (lineno <= 300) * 100 // count(*) AS BIGINT) AS percent FROM e WHERE lvl = 'ERR'"))
def position(spark, sf):
    return _serilog(spark, sf, "level == ERR").position(300)


@_register("inspect", _sql("SELECT lineno, 'matched' AS state, name, type, unit, substr(value, 1, 20) AS value, CAST(greatest(length(value) - 20, 0) AS INTEGER) AS more FROM (SELECT lineno, 'timestamp' AS name, 'timestamp' AS type, '' AS unit, t || ' +00:00' AS value FROM e UNION ALL SELECT lineno, 'level', 'enum', '', lvl FROM e UNION ALL SELECT lineno, 'message', 'string', '', msg FROM e)"))
def inspect(spark, sf):
    return _serilog(spark, sf).inspect(shown=20).select("lineno", "state", "name", "type", "unit", "value", "more")


@_register("inspect_states", f"WITH {_LINES} SELECT state, name, count(*) AS n FROM (SELECT CASE WHEN matched THEN 'matched' WHEN lineno > 1 THEN 'continuation of previous entry' ELSE 'did not match template' END AS state, unnest(CASE WHEN matched THEN ['timestamp', 'logger', 'level', 'message'] ELSE ['raw'] END) AS name FROM l) GROUP BY ALL")
def inspect_states(spark, sf):
    return LogFrame(error_lines(spark, sf), builtin("python")).inspect().groupBy("state", "name").agg(F.count("*").alias("n"))


@_register("segments", _sql("SELECT lineno, 'timestamp' AS field, 0 AS start, CAST(length(t) + 7 AS INTEGER) AS length FROM e UNION ALL SELECT lineno, 'level', CAST(length(t) + 9 AS INTEGER), 3 FROM e UNION ALL SELECT lineno, 'message', CAST(length(t) + 14 + CAST(user_id % 2 = 0 AS INT) AS INTEGER), CAST(length(msg) AS INTEGER) FROM e"))
def segment_rows(spark, sf):
    t = builtin("serilog")
    return segments(parse_rows(event_lines(spark, sf, "serilog"), t), t).select("lineno", F.inline("segments"))


@_register("print_lines", _sql("SELECT t || ' +00:00 [ERR' || CASE WHEN user_id % 2 = 0 THEN ']: ' ELSE '] ' END || msg AS raw FROM e WHERE lvl = 'ERR' ORDER BY lineno"))
def print_lines(spark, sf):
    return _serilog(spark, sf, "level == ERR").lines_out()


@_register("moments", _sql("SELECT lineno, ts AS moment FROM e"))
def moments(spark, sf):
    t = builtin("serilog")
    return with_moment(parse_rows(event_lines(spark, sf, "serilog"), t), t).select("lineno", F.col("ts.timestamp").alias("moment"))


@_register("integers", _sql("SELECT lineno, user_id AS pid, CAST(-1 AS BIGINT) AS ttl FROM e"))
def integers(spark, sf):
    t = builtin("macos")
    return with_integers(parse_rows(event_lines(spark, sf, "macos"), t), t).select("lineno", "i.pid", "i.ttl")


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


@_register("template_list", f"SELECT * FROM (VALUES {_values([(i, n) for i, n in enumerate(['plain', 'syslog', 'syslog-iso', 'dmesg', 'serilog', 'python', 'macos', 'apache'])])}) v(pos, name)")
def templates(spark, sf):
    return template_list(spark).select("pos", "name")


@_register("export_roundtrip", f"SELECT * FROM (VALUES {_values([('plain', 1, 1), ('syslog', 4, 1), ('syslog-iso', 4, 1), ('dmesg', 2, 1), ('serilog', 3, 2), ('python', 4, 1), ('macos', 8, 1), ('apache', 7, 1)])}) v(name, n_fields, n_variants)")
def export_roundtrip(spark, sf):
    rows = [parse_template(t.to_lxt()) for t in all_builtins().values()]
    return spark.createDataFrame([(t.name, len(t.fields), len(t.variants)) for t in rows], "name string, n_fields int, n_variants int")


@_register("detect", f"SELECT * FROM (VALUES {_values([(s, s if s not in ('syslog-iso',) else 'syslog-iso') for s in sorted(SHAPES)])}) v(shape, detected)")
def detected(spark, sf):
    rows = [(s, detect(event_lines(spark, sf, s)).name) for s in sorted(SHAPES)]
    return spark.createDataFrame(rows, "shape string, detected string")


@_register("detect_ratio", "SELECT * FROM (VALUES ('apache', 0.0), ('dmesg', 0.0), ('macos', 0.0), ('python', 1.0), ('serilog', 0.0), ('syslog', 0.0), ('syslog-iso', 0.0)) v(name, ratio)")
def detect_ratio(spark, sf):
    return spark.createDataFrame(ratios(event_lines(spark, sf, "python")), "name string, ratio double")


@_register("infer_report", "SELECT 'timestamp:timestamp logger:word level:enum message:string' AS fields, 200 AS matched, 200 AS total")
def infer_report(spark, sf):
    raw = F.expr(f"concat({T}, ',', date_format(ts, 'SSS'), ' - app.', user_id, ' - ', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, ' - user ', user_id, ' did ', event_type)")
    lines = lines_from_rows(_table(spark, sf, "events"), raw, F.expr("event_id + 1"))
    template, report = inf.infer(lines, "events", overrides={1: {"name": "logger"}})
    fields = " ".join(f"{f.name}:{f.type}" for f in template.fields)
    return spark.createDataFrame([(fields, report.matched, report.total)], "fields string, matched int, total int")


@_register("template_switch", _sql("SELECT lineno, t || ' +00:00 [ERR' || CASE WHEN user_id % 2 = 0 THEN ']: ' ELSE '] ' END || msg AS message FROM e WHERE lvl = 'ERR' UNION ALL SELECT lineno, t || ' +00:00 [' || lvl || CASE WHEN user_id % 2 = 0 THEN ']: ' ELSE '] ' END || msg FROM e WHERE lvl <> 'ERR'"))
def template_switch(spark, sf):
    """Under another template the lines are parsed anew; a filter it can't take is dropped."""
    frame, why = _serilog(spark, sf, "level == ERR").with_template(builtin("plain"))
    return frame.rows().select("lineno", F.col("f.message").alias("message")).where(F.lit(why is not None))


@_register("refilter", _sql("SELECT lineno FROM e WHERE lvl = 'WRN'"))
def refilter(spark, sf):
    return _serilog(spark, sf, "level == ERR").clear().filter("level == WRN").rows().select("lineno")


@_register("document_lines", "SELECT doc_id, CAST(i AS BIGINT) AS lineno, regexp_replace(string_split(body, chr(10))[i], '\\r$', '') AS raw FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS body, text FROM documents) d, range(1, 100000) r(i) WHERE text <> '' AND i <= len(string_split(body, chr(10)))")
def document_lines(spark, sf):
    docs = _table(spark, sf, "documents")
    return lines_from_text(docs, "text", F.col("doc_id").cast("string"), keep=["doc_id"]).select("doc_id", "lineno", "raw")


@_register("conversation_search", "SELECT conv_id, turn, CAST(i AS BIGINT) AS lineno FROM (SELECT conv_id, turn, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS body FROM conversations WHERE text <> '') c, range(1, 10000) r(i) WHERE i <= len(string_split(body, chr(10))) AND contains(translate(string_split(body, chr(10))[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ')")
def conversation_search(spark, sf):
    t = builtin("plain")
    path = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    lines = lines_from_text(_table(spark, sf, "conversations"), "text", path, keep=["conv_id", "turn"])
    return filter_entries(parse_rows(lines, t), t, "raw ~ 'THE '").select("conv_id", "turn", "lineno")


@_register("text_functions", "SELECT doc_id, length(a) AS n_trimmed, instr(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') - 1 AS at, left(text, 31) AS short, regexp_replace(text, '[\\x00-\\x1F]', ' ', 'g') AS masked FROM (SELECT *, regexp_replace(regexp_replace(text, '^[ \\t]+', ''), '[ \\t\\r\\n]+$', '') AS a FROM documents)")
def text_functions(spark, sf):
    t = F.col("text")
    cols = [F.length(fn.trim(t)).cast("long").alias("n_trimmed"), fn.find(t, "THE", fold=True).cast("long").alias("at"), fn.truncate(t, 31).alias("short"), fn.mask_control(t).alias("masked")]
    return _table(spark, sf, "documents").select("doc_id", *cols)


@_register("colors", f"SELECT * FROM (VALUES {_values([('#5FAFD7', 74), ('#FF0000', 196), ('#000000', 16), ('#FFFFFF', 231), ('#8A8A8A', 245)])}) v(rgb, c256)")
def colors(spark, sf):
    rows = ["#5FAFD7", "#FF0000", "#000000", "#FFFFFF", "#8A8A8A"]
    return spark.createDataFrame([(x, rgb_to_256(int(x[1:], 16))) for x in rows], "rgb string, c256 int")


@_register("visible_counts", _sql("SELECT CASE lvl WHEN 'ERR' THEN true ELSE false END AS visible, count(*) AS n FROM e GROUP BY 1"))
def visible_counts(spark, sf):
    t = builtin("serilog")
    rows = visible(parse_rows(event_lines(spark, sf, "serilog"), t), t, "level == ERR")
    return rows.groupBy("visible").agg(F.count("*").alias("n"))


def _written(spark: SparkSession, sf: str) -> str:
    """Events as Python logging lines in text files; errors have a continuation."""
    at = shared_folder(spark, "lines")
    more = "CASE WHEN event_type = 'error' THEN concat('\n  event ', event_id) ELSE '' END"
    rows = _table(spark, sf, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    rows.select(F.expr(f"concat({SHAPES['python']}, ' event=', event_id, {more})").alias("value")).write.text(at)
    return at


@_register("scan_files", _sql("SELECT event_id FROM e WHERE pylvl = 'ERROR' UNION ALL SELECT event_id FROM e WHERE pylvl = 'ERROR'"))
def scan_files(spark, sf):
    """Files are read, numbered, parsed and filtered; an error's two lines have its event."""
    t = builtin("python")
    rows = filter_entries(parse(read_lines(spark, _written(spark, sf)), t), t, "level == ERROR")
    return rows.select(F.regexp_extract("raw", r"event[ =]([0-9]+)$", 1).cast("long").alias("event_id"))


@_register("stream_follow", _sql("SELECT event_id, false AS cont FROM e WHERE pylvl = 'ERROR' UNION ALL SELECT event_id, true FROM e WHERE pylvl = 'ERROR'"))
def stream_follow(spark, sf):
    """The same files tailed by a streaming query with a filter, in several batches."""
    at, out, check = _written(spark, sf), shared_folder(spark, "followed"), shared_folder(spark, "check")
    event = F.regexp_extract("raw", r"event[ =]([0-9]+)$", 1).cast("long").alias("event_id")

    def sink(rows, batch):
        rows.where("visible").select(event, "cont").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    lines = tail_lines(spark, f"{at.removeprefix('file://')}/part-*", batch_bytes=4 << 20)
    query = follow(lines, builtin("python"), "level == ERROR", sink, check, once=True)
    query.awaitTermination()
    return spark.read.schema("event_id long, cont boolean").parquet(*[f"{out}/batch=*"])


@_register("wrapped_values", "SELECT doc_id, CAST(i AS INTEGER) AS part, substr(left(text, 500), CAST((i - 1) * 40 + 1 AS BIGINT), 40) AS piece FROM documents, range(1, 14) r(i) WHERE text <> '' AND (i - 1) * 40 < least(length(text), 500)")
def wrapped_values(spark, sf):
    """Values cut at 500 characters and wrapped at 40."""
    pieces = F.posexplode(fn.wrap(fn.truncate(F.col("text"), 500), 40)).alias("part", "piece")
    return _table(spark, sf, "documents").select("doc_id", pieces).withColumn("part", F.col("part") + 1).withColumn("piece", F.col("piece"))


def _shaped(spark: SparkSession, sf: str, definition: str, line: str) -> DataFrame:
    """Events rendered by a SQL expression and parsed by a definition."""
    lines = lines_from_rows(_table(spark, sf, "events"), F.expr(line), F.expr("event_id + 1"))
    return parse_rows(lines, parse_template(definition))


@_register("ts_twelve_hours", "SELECT event_id + 1 AS lineno, true AS matched, epoch_us(date_trunc('second', ts)) AS us, 'user=' || user_id AS rest FROM events")
def ts_twelve_hours(spark, sf):
    """Two-digit years, hours of twelve, names of days and months, a literal per cent sign."""
    t = 'name: t\nentry: %{when} 100%% %{rest}\nfield when: format="%a %d %b %y %I:%M:%S %p"\n'
    rows = _shaped(spark, sf, t, "concat(date_format(ts, 'EEE dd MMM yy hh:mm:ss a'), ' 100% user=', user_id)")
    return rows.select("lineno", "matched", F.round(F.col("n.when") * 1e6).cast("long").alias("us"), F.col("f.rest").alias("rest"))


@_register("ts_day_of_year", "SELECT event_id + 1 AS lineno, true AS matched, epoch_us(date_trunc('minute', ts)) AS us FROM events")
def ts_day_of_year(spark, sf):
    t = 'name: t\nentry: <%{when}>\nfield when: format="%Y/%j %H:%M 100%%"\n'
    rows = _shaped(spark, sf, t, "concat('<', date_format(ts, 'yyyy/DDD HH:mm'), ' 100%>')")
    return rows.select("lineno", "matched", F.round(F.col("n.when") * 1e6).cast("long").alias("us"))


@_register("duplicate_field", "SELECT event_id + 1 AS lineno, user_id % 2 = 0 AS matched, CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END AS a, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS b FROM events")
def duplicate_field(spark, sf):
    """A field that stands twice has its last text; a line must end where its pattern does."""
    t = "name: t\nentry: %{a:word} %{b:int} %{a:word}\n"
    rows = _shaped(spark, sf, t, "concat('x ', user_id, ' ', event_type, CASE WHEN user_id % 2 = 0 THEN ' \\t' ELSE ' more' END)")
    return rows.select("lineno", "matched", F.col("f.a").alias("a"), F.col("f.b").alias("b"))


@_register("default_layout", "SELECT event_id + 1 AS lineno, epoch_us(date_trunc('second', ts)) AS us, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 2 END AS severity FROM events")
def default_layout(spark, sf):
    """A timestamp without a layout has the default one; a field named pri is the severity."""
    t = "name: t\ndescription: of defaults\nentry: %{at:timestamp} %{Pri} - %{text}\nfield Pri: type=word color=#5FAFD7\n"
    template = parse_template(t)
    severity = F.col("f")[template.fields[template.severity].name]
    rows = _shaped(spark, sf, t, f"concat({T}, ' ', CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'WARN' ELSE 'info' END, ' - x')")
    return rows.select("lineno", F.round(F.col("n.at") * 1e6).cast("long").alias("us"), fn.severity_class(severity).alias("severity"))


@_register("long_literal", "SELECT event_id + 1 AS lineno, user_id % 2 = 0 AS matched FROM events")
def long_literal(spark, sf):
    """Literal text of more than 63 bytes."""
    text = "a long literal, " * 6
    rows = _shaped(spark, sf, f"name: t\nentry: {text}%{{n:int}}\n", f"concat('{text}', CASE WHEN user_id % 2 = 0 THEN '' ELSE 'x' END, user_id)")
    return rows.select("lineno", "matched")


@_register("filter_timestamp_text", _sql("SELECT lineno FROM e WHERE contains(t, ' 13:0') OR NOT contains(t, '2024')"))
def filter_timestamp_text(spark, sf):
    """A timestamp's text where the value is no timestamp."""
    return _serilog(spark, sf, "timestamp ~ ' 13:0' or timestamp !~ 2024").rows().select("lineno")


_BAD = ["timestamp == junk", "bogus == 1", "level ==", "level == ERR &&", "(level == ERR", "timestamp > junk", "line ~ 3", "level == ERR", "not (line < 3 || raw ~ 'x y')"]


@_register("filter_errors", f"SELECT * FROM (VALUES {_values([(x.replace(chr(39), chr(34)), i >= 7) for i, x in enumerate(_BAD)])}) v(expression, compiles)")
def filter_errors(spark, sf):
    from .plans.filter_lang import compile_filter
    from .plans.template import FilterError

    def compiles(x: str) -> bool:
        try:
            compile_filter(x, builtin("serilog"))
        except FilterError:
            return False
        return True

    return spark.createDataFrame([(x.replace("'", '"'), compiles(x)) for x in _BAD], "expression string, compiles boolean")


@_register("follow_pipe", _sql("SELECT lineno FROM e WHERE pylvl = 'ERROR' UNION ALL SELECT lineno FROM e WHERE pylvl = 'ERROR'"))
def follow_pipe(spark, sf):
    """Lines of a pipe, filtered burst by burst; an error's second line continues it."""
    from .streaming.pipe import follow_stream

    more = "CASE WHEN event_type = 'error' THEN concat('\n  line=', event_id + 1) ELSE '' END"
    line = F.expr(f"concat({SHAPES['python']}, ' line=', event_id + 1, {more}, '\n')").alias("x")
    events = _table(spark, sf, "events")
    parts = max(1, -(-events.count() // 100_000))
    rows = events.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").select(line)
    chunks = rows.mapInPandas(lambda batches: (pd.DataFrame({"x": ["".join(b["x"])]}) for b in batches if len(b)), "x string")
    got = follow_stream(spark, (r.x for r in chunks.toLocalIterator(prefetchPartitions=True)), builtin("python"), "level == ERROR", most=4000)
    numbers, at = (int(x.rsplit("=", 1)[1]) for x in got), shared_folder(spark, "piped")
    some = np.fromiter(islice(numbers, 1 << 20), np.int64)
    while True:
        spark.createDataFrame(pa.table({"lineno": some})).coalesce(1).write.mode("append").parquet(at)
        if not len(some := np.fromiter(islice(numbers, 1 << 20), np.int64)):
            return spark.read.schema("lineno long").parquet(at)


@_register("template_file", "SELECT o_orderkey + 1 AS lineno, o_orderpriority AS priority FROM orders WHERE o_orderpriority LIKE '1%'")
def template_file(spark, sf):
    """A definition is written, read again and used."""
    at = shared_folder(spark, "orders.lxt")
    write_template(spark, parse_template(ORDERS), at)
    frame = LogFrame(order_lines(spark, sf), read_template(spark, at), "priority ~ urgent", fields=[])
    return frame.rows().select("lineno", F.col("f.priority").alias("priority"))


@_register("style_fields", _sql("SELECT lineno, 'host' AS field, '256:74' AS style FROM e UNION ALL SELECT lineno, 'proc', '256:37' FROM e UNION ALL SELECT lineno, 'timestamp', '256:245' FROM e UNION ALL SELECT lineno, 'message', '' FROM e"))
def style_fields(spark, sf):
    """How the fields of a built-in template are drawn."""
    t = builtin("syslog")
    rows = LogFrame(event_lines(spark, sf, "syslog"), t).rows()
    cells = [F.struct(F.lit(f.name).alias("field"), style(F.lit(""), F.col("cont"), False, f.color).alias("style")) for f in t.fields]
    return rows.select("lineno", F.inline(F.array(*cells)))


@_register("equal_fold", "SELECT event_id, upper(event_type) = 'ERROR' AS same FROM events")
def equal_fold(spark, sf):
    return _table(spark, sf, "events").select("event_id", fn.equal_ignoring_case(F.col("event_type"), F.lit("eRRor")).alias("same"))


@_register("goto_files", f"WITH {_LINES} (SELECT path, lineno FROM l WHERE (path, lineno) >= ('3', 500) ORDER BY path, lineno LIMIT 1)")
def goto_files(spark, sf):
    """A position among several files."""
    return LogFrame(error_lines(spark, sf), builtin("python")).goto(500, "3").select("path", "lineno")


@_register("numbered_files", _sql("SELECT lineno + (SELECT count(*) FROM e x WHERE x.pylvl = 'ERROR' AND x.event_id < e.event_id) AS lineno, event_id FROM e"))
def numbered_files(spark, sf):
    """Line numbers of one file."""
    at = shared_folder(spark, "lines")
    more = "CASE WHEN event_type = 'error' THEN concat('\n  event ', event_id) ELSE '' END"
    rows = _table(spark, sf, "events").coalesce(1).sortWithinPartitions("event_id")
    rows.select(F.expr(f"concat({SHAPES['python']}, ' event=', event_id, {more})").alias("value")).write.text(at)
    lines = read_lines(spark, at).where(~F.startswith("raw", F.lit("  ")))
    return lines.select("lineno", F.regexp_extract("raw", r"event=([0-9]+)$", 1).cast("long").alias("event_id"))
