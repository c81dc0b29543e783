"""A log with its template: filters, search, positions, fields and counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lower_literal, mask_control
from ..plans.builtins import all_builtins
from ..plans.filter_lang import compile_filter
from ..plans.template import FilterError, LogError, Template
from .detect import detect
from .parse import mark, parse, visible

#: Characters of a value that are shown by default, and the page's overlap.
SHOWN, OVERLAP = 500, 2


class LogFrame:
    """Lines parsed by a template and filtered. Immutable: methods give new frames, and every
    result is a lazy DataFrame over rows()."""

    def __init__(self, lines: DataFrame, template: Template | None = None, expression: str | None = None, blocks: bool = True, fields: list[str] | None = None):
        """fields: those that rows have in f and n, all by default; parsing fewer is faster."""
        self.lines, self.blocks, self.fields = lines, blocks, fields
        self.template = template or detect(lines)
        self.expression = expression
        if expression is not None:
            compile_filter(expression, self.template)
        self._cached: DataFrame | None = None

    def cache(self) -> "LogFrame":
        """Keeps the parsed rows, with all fields; later filters and look-ups read them."""
        self._cached = parse(self.lines, self.template, self.blocks).persist()
        return self

    def parsed(self) -> DataFrame:
        return parse(self.lines, self.template, self.blocks, self.fields) if self._cached is None else self._cached

    def marked(self) -> DataFrame:
        """All rows with visible."""
        if self._cached is not None:
            return visible(self._cached, self.template, self.expression, self.blocks)
        return mark(self.lines, self.template, self.expression, self.blocks, self.fields)

    def rows(self) -> DataFrame:
        """The visible rows."""
        return self.marked().where("visible").drop("visible", "block")

    def _with(self, template: Template, expression: str | None, cached: DataFrame | None = None) -> "LogFrame":
        fields = self.fields if template is self.template else None
        out = LogFrame(self.lines, template, expression, self.blocks, fields)
        out._cached = cached
        return out

    def filter(self, expression: str) -> "LogFrame":
        """The same rows under another filter; FilterError if it can't be compiled."""
        compile_filter(expression, self.template)
        return self._with(self.template, expression, self._cached)

    def clear(self) -> "LogFrame":
        return self._with(self.template, None, self._cached)

    def with_template(self, template: Template) -> tuple["LogFrame", str | None]:
        """The lines parsed anew. A filter that the new template can't take is dropped; then
        the second value says why."""
        try:
            if self.expression is not None:
                compile_filter(self.expression, template)
            return self._with(template, self.expression), None
        except FilterError as e:
            return self._with(template, None), str(e)

    def stats(self) -> DataFrame:
        """One row: total, matched and visible (continuations included)."""
        return self.marked().agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if("visible").alias("visible"))

    def entries(self) -> DataFrame:
        """One row an entry: its line, and its continuations as an array in order. An entry is
        one row whatever its length: for logs, not for one entry of a whole file."""
        rows = self.rows()
        more = F.array_sort(F.collect_list(F.when(F.col("cont"), F.struct("lineno", "raw"))))
        head = F.max_by(F.struct("lineno", "raw", "matched", "f", "n"), F.when(~F.col("cont"), F.lit(1)))
        return rows.groupBy("path", "entry_id").agg(head.alias("head"), F.transform(more, lambda m: m["raw"]).alias("continuations")).select("path", "entry_id", "head.*", "continuations")

    # Positions: keyset look-ups, no global numbering. With several files a position is a path
    # and a line, in that order; without a path all lines count as of one file.

    def _at(self, lineno: int, path: str | None):
        """The rows' positions, and the position of a line."""
        if path is None:
            return F.struct("lineno", "path"), F.struct(F.lit(lineno).cast("long").alias("lineno"), F.lit("").alias("path"))
        return F.struct("path", "lineno"), F.struct(F.lit(path).alias("path"), F.lit(lineno).cast("long").alias("lineno"))

    def _order(self, path: str | None, forward: bool = True) -> list:
        return [k if forward else F.desc(k) for k in (("lineno", "path") if path is None else ("path", "lineno"))]

    def goto(self, lineno: int, path: str | None = None) -> DataFrame:
        """The first visible row at or after a line, else the last one."""
        here, want = self._at(lineno, path)
        rows = self.rows().withColumn("_ahead", here >= want)
        ahead, back = rows.where("_ahead").orderBy(*self._order(path)).limit(1), rows.where("not _ahead").orderBy(*self._order(path, False)).limit(1)
        return ahead.unionByName(back).orderBy(F.desc("_ahead")).limit(1).drop("_ahead")

    def search(self, text: str, cursor: int = 1, forward: bool = True, inclusive: bool = True, path: str | None = None) -> DataFrame:
        """The next visible row whose raw line has the text (ASCII case ignored), and wrapped:
        whether the search went over the log's end. inclusive: the cursor's own row counts."""
        here, want = self._at(cursor, path)
        own = (F.col("lineno") == cursor) & (F.lit(True) if path is None else F.col("path") == path)
        behind = here < want if forward else here > want
        behind = (behind & ~own) if inclusive else (behind | own)
        hits = self.rows().where(F.contains(ascii_lower(F.col("raw")), F.lit(lower_literal(text))))
        return hits.withColumn("wrapped", behind).orderBy("wrapped", *self._order(path, forward)).limit(1)

    def page(self, cursor: int, rows: int, forward: bool = True, path: str | None = None) -> DataFrame:
        """So many visible rows from a line on, or up to it."""
        here, want = self._at(cursor, path)
        own = (F.col("lineno") == cursor) & (F.lit(True) if path is None else F.col("path") == path)
        some = self.rows().where((here >= want if forward else here <= want) | own)
        return some.orderBy(*self._order(path, forward)).limit(rows).orderBy(*self._order(path))

    def first(self) -> DataFrame:
        return self.rows().orderBy("path", "lineno").limit(1)

    def last(self) -> DataFrame:
        return self.rows().orderBy(F.desc("path"), F.desc("lineno")).limit(1)

    def position(self, lineno: int, path: str | None = None) -> DataFrame:
        """Rank of a line among the visible ones, their number, and the share in per cent."""
        here, want = self._at(lineno, path)
        at = F.count_if(here <= want if path is not None else F.col("lineno") <= lineno)
        return self.rows().agg(at.alias("rank"), F.count("*").alias("of"), F.coalesce(F.floor(at * 100 / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("long").alias("percent"))

    def inspect(self, lineno: int | None = None, shown: int = SHOWN) -> DataFrame:
        """One row a field: lineno, state, name, type, unit, value (control characters as
        blanks, cut) and more (characters cut off). Rows that no shape matched have one field,
        raw. shown: 1 to 10000."""
        if not 1 <= shown <= 10_000:
            raise LogError("between 1 and 10000 characters are shown")
        rows = self.rows() if lineno is None else self.rows().where(F.col("lineno") == lineno)
        cell = lambda name, kind, unit, value: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(unit).alias("unit"), value.alias("v"))
        cells = F.array(*[cell(f.name, f.type, f.unit, F.col("f")[f.name]) for f in self.template.fields])
        raw = F.array(cell("raw", "string", "", F.col("raw")))
        state = F.when(F.col("matched"), "matched").when(F.col("cont"), "continuation of previous entry").otherwise("did not match template")
        flat = rows.select("path", "lineno", state.alias("state"), F.posexplode(F.when(F.col("matched"), cells).otherwise(raw)).alias("pos", "c"))
        value = mask_control(F.col("c.v"))
        return flat.select("path", "lineno", "state", "pos", "c.name", "c.type", "c.unit", F.substring(value, 1, shown).alias("value"), F.greatest(F.length(value) - shown, F.lit(0)).alias("more"))

    def lines_out(self) -> DataFrame:
        """The visible raw lines in file order."""
        return self.rows().orderBy("path", "lineno").select("raw")

    def print_lines(self) -> Iterator[str]:
        """The visible raw lines, one partition at a time."""
        for r in self.lines_out().toLocalIterator(prefetchPartitions=True):
            yield r.raw

    def write_lines(self, path: str) -> None:
        """The visible raw lines as text files, in order from file to file."""
        self.rows().repartitionByRange("path", "lineno").sortWithinPartitions("path", "lineno").select("raw").write.text(path)


def template_list(spark) -> DataFrame:
    """Names and descriptions of the built-in templates, in order."""
    return spark.createDataFrame([(i, t.name, t.description) for i, t in enumerate(all_builtins().values())], "pos int, name string, description string")
