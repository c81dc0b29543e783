"""Tailing files that grow, shrink or are replaced, as a streaming source, and filtering them.

The source `logtail` gives (path, generation, lineno, raw). A read begins where the last one
ended. The unterminated end of a file is held back until its newline comes (a sink can't take
it back), unless flush_tail is set. A file shorter than what was read is read anew from its
start under the next generation; a missing file keeps its place. Files are opened by driver and
executors, so they are local files or mounted ones.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.parse import parse_rows
from ..plans.filter_lang import compile_filter
from ..plans.template import Template
from ..sources.shared import read_text, write_text

SCHEMA = "path string, generation int, lineno long, raw string"
#: Bytes of one file that a batch takes at most (whole lines; a longer line is taken whole).
BATCH_BYTES = 64 << 20
#: The reference interval for looking at files, where nothing tells of changes.
INTERVAL = "500 milliseconds"


@dataclass
class Slice(InputPartition):
    """Bytes of a file, the number of their first line, and the file's generation."""

    path: str
    begin: int
    end: int
    lineno: int
    generation: int


def _complete(path: str, begin: int, size: int, most: int, flush: bool) -> tuple[int, int, bool]:
    """(end, lines) of the whole lines from begin on, in about `most` bytes, and whether that
    limit left bytes unread."""
    at, lines, end = begin, 0, begin
    with open(path, "rb") as f:
        f.seek(begin)
        while at < size and (at - begin < most or end == begin):
            data = f.read(min(1 << 16, size - at))
            if not data:
                break
            cut = data.rfind(b"\n")
            if cut >= 0:
                lines += data.count(b"\n")
                end = at + cut + 1
            at += len(data)
    if flush and at >= size > end:
        lines, end = lines + 1, size
    return end, lines, end > begin and at < size


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns = json.loads(options["paths"])
        self.most = int(options.get("batch_bytes", BATCH_BYTES))
        self.flush = options.get("flush_tail", "false").lower() == "true"
        self.files: dict[str, list[int]] | None = None  # path: generation, bytes, lines read

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files, left = {k: list(v) for k, v in (self.files or {}).items()}, {}
        for path in sorted({p for pattern in self.patterns for p in glob.glob(pattern)}):
            generation, done, lines = files.get(path, [0, 0, 0])
            try:
                size = os.path.getsize(path)
                if size < done:
                    generation, done, lines = generation + 1, 0, 0
                end, more, cut = _complete(path, done, size, self.most, self.flush)
            except OSError:
                continue
            files[path] = [generation, end, lines + more]
            if cut:
                left[path] = size
        self.files = files
        return {"files": files} | ({"left": left} if left else {})

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.files is None:  # restarted: go on from the offset that is on record
            self.files = {k: list(v) for k, v in end["files"].items()}
        out = []
        for path, (generation, stop, _) in end["files"].items():
            before = start["files"].get(path, [0, 0, 0])
            begin, lines = (before[1], before[2]) if before[0] == generation else (0, 0)
            if stop > begin:
                out.append(Slice(path, begin, stop, lines + 1, generation))
        return out

    def read(self, partition: Slice):
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            at, lineno = partition.begin, partition.lineno
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    break
                at += len(line)
                line = line[:-1] if line.endswith(b"\n") else line
                line = line[:-1] if line.endswith(b"\r") else line
                yield partition.path, partition.generation, lineno, line.decode(errors="replace")
                lineno += 1

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Options: paths (a JSON list of paths or patterns), batch_bytes, flush_tail."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def tail_lines(spark: SparkSession, paths: str | list[str], batch_bytes: int = BATCH_BYTES, flush_tail: bool = False) -> DataFrame:
    """A streaming DataFrame of the files' lines."""
    spark.dataSource.register(LogTail)
    listed = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return spark.readStream.format("logtail").option("paths", listed).option("batch_bytes", str(batch_bytes)).option("flush_tail", str(flush_tail)).load()


class Follower:
    """Applies a template and a filter to batches of lines; entries may go on in later batches.

    One row a file (the last entry's line and verdict) is carried from batch to batch, in
    state_dir, named by batch, so that a batch that is run again gives the same rows."""

    def __init__(self, template: Template, expression: str | None, sink: Callable[[DataFrame, int], None], state_dir: str):
        self.template, self.sink, self.state_dir = template, sink, state_dir
        self.verdict = F.lit(True) if expression is None else compile_filter(expression, template)

    def _carried(self, spark: SparkSession, batch: int) -> list[tuple]:
        return [tuple(x) for x in json.loads(read_text(spark, f"{self.state_dir}/{batch}.json") or "[]")]

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        before = self._carried(spark, batch - 1)
        carry = spark.createDataFrame(before, "path string, generation int, _entry long, _shown boolean")
        rows = parse_rows(lines, self.template).withColumn("_own", self.verdict)
        w = Window.partitionBy("path", "generation").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(~F.col("cont"), F.struct(F.col("lineno").alias("e"), F.col("_own").alias("v")))
        rows = rows.withColumn("_last", F.last(own, ignorenulls=True).over(w)).join(carry, ["path", "generation"], "left")
        rows = rows.withColumns({"entry_id": F.coalesce("_last.e", "_entry"), "visible": F.coalesce("_last.v", "_shown", F.lit(False))}).drop("_last", "_entry", "_shown", "_own").persist()
        ends = rows.groupBy("path", "generation").agg(F.max_by(F.struct("entry_id", "visible"), "lineno").alias("s")).select("path", "generation", "s.*").collect()
        now = {(r[0], r[1]): r for r in before} | {(r.path, r.generation): (r.path, r.generation, r.entry_id, r.visible) for r in ends}
        newest = {p: g for p, g in sorted(now)}
        self.sink(rows, batch)
        rows.unpersist()
        write_text(spark, f"{self.state_dir}/{batch}.json", json.dumps([v for (p, g), v in now.items() if newest[p] == g]))


def follow(lines: DataFrame, template: Template, expression: str | None, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that gives sink each batch's rows with entry_id and visible. once: only
    what is there now, all of it; the query that is returned has ended then. The template is
    fixed beforehand; detect() it on the first lines."""
    state = f"{checkpoint}/carry"
    writer = lines.writeStream.foreachBatch(Follower(template, expression, sink, state)).option("checkpointLocation", checkpoint)
    return _until_read(writer.trigger(availableNow=True)) if once else writer.trigger(processingTime=INTERVAL).start()


def _until_read(writer: DataStreamWriter) -> StreamingQuery:
    """Spark asks such a source for its end once a query, and that is one batch: queries follow
    each other until every file is read up to the size that the first one saw."""
    goal = None
    while True:
        query = writer.start()
        with suppress(StreamingQueryException):  # the caller asks for it
            query.awaitTermination()
        progress = None if query.exception() else query.lastProgress
        end = json.loads(progress.json)["sources"][0]["endOffset"] if progress else None
        left = end.get("left", {}) if isinstance(end, dict) else {}
        goal = left if goal is None else goal
        if not any(end["files"][path][1] < goal.get(path, 0) for path in left):
            return query
