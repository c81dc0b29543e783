"""Lines to typed rows, and filters over entries with their continuations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans import pattern, tsfmt
from ..plans.filter_lang import compile_filter, fields_of, names_of
from ..plans.template import Template
from ..sources.lines import Scan, scan_of


def parse_rows(lines: DataFrame, template: Template, fields: list[str] | None = None) -> DataFrame:
    """Adds matched, cont, f and n to lines, row by row.

    fields: the ones to extract (all by default); the others' parts of the pattern don't
    capture. One regex a line gives all slots; the Generate keeps the optimizer from copying it
    into each use."""
    wanted = None if fields is None else set(fields)
    p = pattern.build(template, wanted)
    slots = F.split(F.regexp_replace("raw", F.lit(p.regex), F.lit(p.replacement)), "\n")
    rows = lines.withColumn("_p", F.explode(F.array(slots)))
    at = {s: k + 1 for k, s in enumerate(p.slots)}
    slot = lambda key: F.coalesce(F.get("_p", F.lit(at[key])), F.lit(""))
    matched = F.size("_p") > 1
    texts, numbers = [], []
    for i, field in enumerate(template.fields):
        if wanted is not None and field.name not in wanted:
            continue
        text = slot((i, "")) if (i, "") in at else F.lit("")
        texts.append(text.alias(field.name))
        number = F.lit(None).cast("double")
        if field.type in ("int", "float"):
            number = F.when(text != "", text.cast("double"))
        elif field.type == "timestamp":
            parts = {part: slot((j, part)) for j, part in at if j == i and part}
            number = F.when(text != "", tsfmt.epoch(parts))
        numbers.append(number.alias(field.name))
    out = rows.withColumns({"matched": matched, "f": F.struct(*texts), "n": F.struct(*numbers)}).drop("_p")
    return out.withColumn("cont", ~F.col("matched") & (F.col("lineno") > 1))


def _carried(ends: DataFrame) -> DataFrame:
    """ends: (path, block, own), own being the last of a block, maybe null. Gives the last of
    the blocks before each as carry; one row a block."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("carry", F.last("own", ignorenulls=True).over(before)).drop("own")


def _split(rows: DataFrame, own: Column, blocks: bool, slim: DataFrame) -> DataFrame:
    """Adds _own, the value of own of the entry that a row is or continues, to rows in any order.
    slim: the same rows with the fields that own needs.

    Rows that are no continuation have their own. Only narrow rows, and the continuations' raw
    lines, are shuffled: to a window in each file block."""
    heads = rows.where(~F.col("cont")).withColumn("_own", own)
    fixed = ("path", "block", "lineno", "matched", "cont", "f", "n")
    rest = [c for c in rows.columns if c not in fixed]
    narrow = slim.select("path", "block", "lineno", F.when(F.col("cont"), F.struct(*rest)).alias("_row"), F.when(~F.col("cont"), own).alias("_own"))
    in_block = Window.partitionBy("path", "block").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    more = narrow.withColumn("_own", F.last("_own", ignorenulls=True).over(in_block)).where("_row is not null")
    if blocks:
        ends = narrow.groupBy("path", "block").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("lineno"))).alias("own"))
        more = more.join(_carried(ends), ["path", "block"], "left").withColumn("_own", F.coalesce("_own", "carry"))
    empty = {"matched": F.lit(False), "cont": F.lit(True)}
    for name, value in (("f", F.lit("")), ("n", F.lit(None).cast("double"))):
        empty[name] = F.struct(*[value.alias(k) for k in rows.schema[name].dataType.names])
    columns = [F.col(f"_row.{c}") if c in rest else empty[c].alias(c) if c in empty else F.col(c) for c in rows.columns]
    return heads.unionByName(more.select(*columns, "_own"))


def _fill_in_order(batches):
    """Adds entry_id and visible to Arrow batches whose rows of a file block follow each other.
    _v: verdicts of rows that are no continuation; _carry: what a block begins with."""
    block, entry, verdict = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        path, number, line = batch["path"], batch["block"].to_numpy(), batch["lineno"].to_numpy()
        head = ~batch["cont"].to_numpy(zero_copy_only=False)
        new = np.ones(len(head), bool)
        new[1:] = (number[1:] != number[:-1]) | pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
        new[0] = (path[0].as_py(), int(number[0])) != block
        place = np.arange(len(head))
        last = np.maximum.accumulate(np.where(head, place, -1))
        begin = np.maximum.accumulate(np.where(new, place, -1))
        inside = (last >= 0) & (last >= begin)
        e, v = batch["_e"].to_numpy(zero_copy_only=False), batch["_c"].to_numpy(zero_copy_only=False)
        v = np.array([bool(x) for x in v]) if v.dtype == object else v
        before = np.where(begin < 0, np.nan if entry is None else entry, e.astype(float))
        e = np.where(inside, line[np.maximum(last, 0)], before)
        v = np.where(inside, batch["_v"].to_numpy(zero_copy_only=False)[np.maximum(last, 0)], np.where(begin < 0, bool(verdict), v)).astype(bool)
        block, entry, verdict = (path[-1].as_py(), int(number[-1])), None if np.isnan(e[-1]) else int(e[-1]), bool(v[-1])
        ids = pa.array(np.nan_to_num(e).astype(np.int64), mask=np.isnan(e))
        keep = [c for c in batch.schema.names if c not in ("_e", "_c", "_v")]
        yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [ids, pa.array(v)], keep + ["entry_id", "visible"])


def _ends(scan: Scan, template: Template, expression: str | None, verdict: Column) -> DataFrame:
    """(path, block, _lo, _before, own): own is the last entry of a block. One number a row, its
    id and verdict, is enough to find it."""
    used = [] if expression is None else fields_of(expression, template)
    tested = parse_rows(scan.text.withColumn("lineno", F.lit(2)), template, used)
    code = F.shiftleft("_id", 1) + verdict.cast("long")
    tested = tested.select("path", "block", "_id", code.alias("_code"), F.when(F.col("matched"), code).alias("_hit"))
    blocks = scan.numbered(tested, F.max("_hit").alias("_last"), F.min("_code").alias("_first"))
    # A file's first line is an entry even if no shape matches it.
    last = F.coalesce("_last", F.when(F.col("_before") == 0, F.col("_first")))
    own = F.struct((F.shiftright(last, 1) - F.col("_lo") + F.col("_before") + 1).alias("e"), (last % 2 == 1).alias("v"))
    return blocks.select("path", "block", "_lo", "_before", F.when(last.isNotNull(), own).alias("own"))


def _ends_by_line(scan: Scan, template: Template, verdict: Column) -> DataFrame:
    """The same where a verdict needs the line's number, which is known only afterwards: the
    last entry's text is kept for each block."""
    tested = scan.text.withColumn("_hit", F.col("raw").rlike(pattern.build(template, set()).regex))
    row = F.struct(F.col("_id"), F.col("raw"))
    blocks = scan.numbered(tested, F.max_by(row, F.when(F.col("_hit"), F.col("_id"))).alias("_last"), F.min_by("raw", "_id").alias("_first"))
    last = F.coalesce("_last", F.when(F.col("_before") == 0, F.struct(F.col("_lo").alias("_id"), F.col("_first").alias("raw"))))
    ends = blocks.withColumn("_end", last)
    ends = ends.select("path", "block", "_lo", "_before", F.col("_end.raw").alias("raw"), (F.col("_end._id") - F.col("_lo") + F.col("_before") + 1).alias("lineno"))
    own = F.when(F.col("raw").isNotNull(), F.struct(F.col("lineno").alias("e"), verdict.alias("v")))
    return parse_rows(ends, template).select("path", "block", "_lo", "_before", own.alias("own"))


def _in_order(scan: Scan, template: Template, expression: str | None, fields: list[str] | None) -> DataFrame:
    """Parsed rows with entry_id and visible, of files in the order of their scan: one pass that
    only tests lines, for the blocks' line numbers and last entries, and one that parses."""
    verdict = F.lit(True) if expression is None else compile_filter(expression, template)
    carry = _ends_by_line(scan, template, verdict) if expression and "line" in names_of(expression, template) else _ends(scan, template, expression, verdict)
    carry = _carried(carry)
    rows = scan.join(scan.text, carry).withColumn("lineno", F.col("_id") - F.col("_lo") + F.col("_before") + 1)
    rows = rows.select("path", "block", "lineno", "raw", F.col("carry.e").alias("_e"), F.coalesce("carry.v", F.lit(False)).alias("_c"))
    rows = parse_rows(rows, template, fields).withColumn("_v", verdict)
    if pattern.build(template).total:
        return rows.withColumns({"entry_id": F.col("lineno"), "visible": F.col("_v")}).drop("_e", "_c", "_v")
    kept = StructType([f for f in rows.schema.fields if f.name not in ("_e", "_c", "_v")]).add("entry_id", "long").add("visible", "boolean")
    return rows.mapInArrow(_fill_in_order, kept)


def mark(lines: DataFrame, template: Template, expression: str | None = None, blocks: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Parsed rows with entry_id (the line of the entry that a row is or continues) and visible
    (the filter's verdict on that entry; continuations are never judged themselves).

    blocks: whether a path may have several blocks. fields: those wanted in f and n; what the
    filter looks at is there too. Templates that match every line have no continuations."""
    if fields is not None and expression is not None:
        fields = [*fields, *fields_of(expression, template)]
    if (scan := scan_of(lines)) is not None:
        return _in_order(scan, template, expression, fields)
    used = [] if expression is None else fields_of(expression, template)
    return visible(parse_rows(lines, template, fields), template, expression, blocks, True, parse_rows(lines, template, used))


def attach(rows: DataFrame, template: Template, blocks: bool = True) -> DataFrame:
    """Adds entry_id: the line of the entry that a row is or continues."""
    return visible(rows, template, None, blocks, True).drop("visible")


def parse(lines: DataFrame, template: Template, blocks: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Parsed rows: path, lineno, raw, matched, cont, entry_id, f, n (and block)."""
    return mark(lines, template, None, blocks, fields).drop("visible")


def visible(rows: DataFrame, template: Template, expression: str | None, blocks: bool = True, ids: bool = False, slim: DataFrame | None = None) -> DataFrame:
    """Adds visible, a row's verdict, to parsed rows; with ids also entry_id. Rows that have
    entry_id already look up their entry's verdict. slim: the same rows, parsed for no more
    fields than the filter looks at."""
    if expression is None and not ids:
        return rows.withColumn("visible", F.lit(True))
    verdict = F.lit(True) if expression is None else compile_filter(expression, template)
    if pattern.build(template).total:
        out = rows.withColumn("visible", verdict)
        return out.withColumn("entry_id", F.col("lineno")) if ids else out
    if "entry_id" in rows.columns and not ids:
        heads = rows.where(~F.col("cont")).withColumn("visible", verdict)
        found = heads.select("path", "entry_id", "visible")
        more = rows.where("cont").join(found, ["path", "entry_id"], "left").select(*rows.columns, F.coalesce("visible", F.lit(False)).alias("visible"))
        return heads.unionByName(more)
    out = _split(rows, F.struct(F.col("lineno").alias("e"), verdict.alias("v")), blocks, rows if slim is None else slim)
    out = out.withColumn("visible", F.coalesce("_own.v", F.lit(False)))
    return (out.withColumn("entry_id", F.col("_own.e")) if ids else out).drop("_own")


def filter_entries(rows: DataFrame, template: Template, expression: str | None, blocks: bool = True) -> DataFrame:
    """The visible rows."""
    return visible(rows, template, expression, blocks).where("visible").drop("visible")


def evaluate(rows: DataFrame, template: Template, expression: str) -> DataFrame:
    """Adds verdict: the filter on each row alone, continuations included."""
    return rows.withColumn("verdict", compile_filter(expression, template))


def with_moment(rows: DataFrame, template: Template) -> DataFrame:
    """Adds ts.<name>: timestamps without zone, of the wall clock, for the timestamp fields."""
    micros = lambda c: F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    names = [f.name for f in template.fields if f.type == "timestamp"]
    if not names:
        return rows
    return rows.withColumn("ts", F.struct(*[micros(F.col("n")[k]).alias(k) for k in names]))


def with_integers(rows: DataFrame, template: Template) -> DataFrame:
    """Adds i.<name>: int fields as exact longs (null where they overflow). Filters compare
    doubles; this is a convenience."""
    names = [f.name for f in template.fields if f.type == "int"]
    return rows.withColumn("i", F.struct(*[F.col("f")[k].try_cast("long").alias(k) for k in names])) if names else rows


def segments(rows: DataFrame, template: Template) -> DataFrame:
    """Adds segments: for each field with text, its name and the first place of that text at or
    after the end of the field before it (fields in pattern order)."""
    acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<field:string,start:int,length:int>>").alias("out"))
    texts = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col("f")[f.name].alias("text")) for f in template.fields])

    def step(a: Column, x: Column) -> Column:
        at = F.instr(F.substring(F.col("raw"), a["at"] + 1, F.length("raw")), x["text"])
        hit = (x["text"] != "") & (at > 0)
        begin = a["at"] + at - 1
        return F.struct(
            F.when(hit, begin + F.length(x["text"])).otherwise(a["at"]).alias("at"),
            F.when(hit, F.concat(a["out"], F.array(F.struct(x["name"].alias("field"), begin.alias("start"), F.length(x["text"]).alias("length"))))).otherwise(a["out"]).alias("out"),
        )

    return rows.withColumn("segments", F.when(F.col("matched"), F.aggregate(texts, acc, step, lambda a: a["out"])))


