"""Lines as rows (path, block, lineno, raw), in any order; lineno counts from 1 in each path."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.template import LogIOError, Template, parse

SCHEMA = "path string, block long, lineno long, raw string"
#: Lines of a block where lines are numbered beforehand.
BLOCK_LINES = 1 << 20


def _block(lineno: Column) -> Column:
    return F.floor((lineno - 1) / BLOCK_LINES).cast("long")


def strip_cr(c: Column) -> Column:
    """Without one trailing carriage return."""
    return F.regexp_replace(c, r"\r\z", "")


#: Blocks (one for each 128 MB of a file, or each file) of which a table of one row each is
#: broadcast; of more the optimizer chooses.
FEW_BLOCKS = 200_000


@dataclass
class Scan:
    """Files as they are scanned. text: (path, block, _id, raw), rows of a block one after
    another, _id growing; few: whether a table of one row a block may be broadcast."""

    text: DataFrame
    few: bool
    paths: list[str]

    def numbered(self, text: DataFrame, *more: Column) -> DataFrame:
        """(path, block, _lo, _before): the first _id of each block and the lines before it;
        more: aggregates of a block's rows."""
        blocks = text.groupBy("path", "block").agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"), *more)
        before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")

    def join(self, text: DataFrame, blocks: DataFrame) -> DataFrame:
        return text.join(F.broadcast(blocks) if self.few else blocks, ["path", "block"])


def scan_of(lines: DataFrame) -> Scan | None:
    """What read_lines() scans, if these are its lines."""
    return getattr(lines, "_sparklog_scan", None)


def _stored(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    try:
        return spark.read.option("lineSep", "\n").text(paths)
    except AnalysisException as e:
        raise LogIOError(str(e).splitlines()[0]) from e


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files. Only a newline ends a line; one trailing carriage return goes.

    Line numbers: rows of a file block are numbered in the order of the scan, and a prefix sum
    over one row a block says how many lines come before the block. Nothing but those rows is
    shuffled, and broadcast where they are few. LogIOError if a path can't be read."""
    text = _stored(spark, paths)
    listed = sorted(text.inputFiles())
    rows = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"), strip_cr(F.col("value")).alias("raw"),
    )
    size = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scan = Scan(rows, len(listed) + size // (32 << 20) <= FEW_BLOCKS, listed)
    numbered = scan.join(rows, scan.numbered(rows))
    out = numbered.select("path", "block", (F.col("_id") - F.col("_lo") + F.col("_before") + 1).alias("lineno"), "raw")
    out._sparklog_scan = scan
    return out


def lines_from_text(df: DataFrame, text: str, path: str | Column = "", keep: list[str] | None = None) -> DataFrame:
    """Lines of each row's text, as of a file of its own named by path (a column or a name).
    A text's last newline ends its last line; an empty text has no lines, a null one neither."""
    c = F.col(text)
    body = F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    lines = F.when(c != "", F.split(body, "\n"))
    where = path if isinstance(path, Column) else F.lit(path)
    out = df.select(where.alias("path"), *(keep or []), F.posexplode(lines).alias("_i", "_raw"))
    number = (F.col("_i") + 1).cast("long")
    return out.select("path", *(keep or []), _block(number).alias("block"), number.alias("lineno"), strip_cr(F.col("_raw")).alias("raw"))


def lines_from_rows(df: DataFrame, raw: str | Column, lineno: str | Column, path: str | Column | None = None) -> DataFrame:
    """Lines from rows that are one line each and know their number (from 1; gaps are fine).
    A path's lines are dealt by ranges of numbers, so a path may be of any length."""
    where = F.lit("") if path is None else path if isinstance(path, Column) else F.col(path)
    number = lineno if isinstance(lineno, Column) else F.col(lineno)
    line = raw if isinstance(raw, Column) else F.col(raw)
    number = number.cast("long")
    return df.select(where.alias("path"), _block(number).alias("block"), number.alias("lineno"), line.alias("raw"))


def lines_from_iterable(spark: SparkSession, chunks: Iterable[str], path: str = "(stdin)") -> DataFrame:
    """Lines of a stream of text chunks, such as standard input, read to its end."""
    text = "".join(chunks)
    lines = text.removesuffix("\n").split("\n") if text else []
    rows = [(path, (i - 1) // BLOCK_LINES, i, x.removesuffix("\r")) for i, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(lines: DataFrame, n: int, indented: bool = True) -> list[str]:
    """The first n lines that are not empty (nor indented, if so asked). Of files only the
    head is read."""
    def wanted(some: DataFrame) -> DataFrame:
        some = some.where(F.length("raw") > 0)
        return some if indented else some.where(~F.substring("raw", 1, 1).isin(" ", "\t"))

    if (scan := scan_of(lines)) is None:
        return [r.raw for r in wanted(lines).orderBy("path", "lineno").limit(n).select("raw").collect()]
    out: list[str] = []
    for path in scan.paths:
        head = _stored(lines.sparkSession, path).select(strip_cr(F.col("value")).alias("raw"))
        out += [r.raw for r in wanted(head).limit(n - len(out)).collect()]
        if len(out) == n:
            break
    return out


def read_template(spark: SparkSession, path: str) -> Template:
    """A template from a file in any store that Spark reads."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as e:
        raise LogIOError(str(e).splitlines()[0]) from e
    return parse("".join(r.value for r in rows))


def write_template(spark: SparkSession, template: Template, path: str) -> None:
    """A template's definition as a file in any store that Spark writes; never over another."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        raise LogIOError(f"{path} is there already")
    out = store.create(where, False)
    out.write(bytearray(template.to_lxt().encode()))
    out.close()
