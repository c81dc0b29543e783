"""Standard input and other streams, filtered as they come.

Lines are taken in bursts: what comes until a pause, or so many. Each burst is parsed and
judged by Spark; the driver holds one burst, what has come meanwhile and the last entry's
verdict. Lines that wait already are taken together, so that a stream faster than Spark costs
no query for each small burst.
"""

from __future__ import annotations

import gc
import threading
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.parse import parse_rows
from ..plans.filter_lang import compile_filter, fields_of
from ..plans.template import Template

#: Seconds until the first burst may end, and of a pause that ends one.
FIRST, PAUSE = 0.2, 0.15
#: Lines of a burst at most; and of one that takes what has come while Spark was busy.
BURST, BEHIND = 50_000, 100_000


class _Waiting:
    """Lines that have come and weren't taken yet; whoever puts more than so many waits."""

    def __init__(self, room: int):
        self.room, self.parts, self.n, self.ended, self.turn = room, deque(), 0, False, threading.Condition()

    def put(self, lines: list[str]) -> None:
        for i in range(0, len(lines), self.room):
            part = lines[i : i + self.room]
            with self.turn:
                self.turn.wait_for(lambda: self.n + len(part) <= self.room)
                self.parts.append(part)
                self.n += len(part)
                self.turn.notify_all()

    def end(self) -> None:
        with self.turn:
            self.ended = True
            self.turn.notify_all()

    def take(self, most: int, wait: float | None) -> list[str]:
        """Some lines; none after a pause or at the end."""
        out: list[str] = []
        with self.turn:
            self.turn.wait_for(lambda: self.n or self.ended, wait)
            while self.parts and len(out) < most:
                part = self.parts.popleft()
                if len(part) > most - len(out):
                    self.parts.appendleft(part[most - len(out) :])
                    part = part[: most - len(out)]
                out += part
            self.n -= len(out)
            self.turn.notify_all()
        return out


def bursts(chunks: Iterable[str], most: int = BURST, first: float = FIRST, pause: float = PAUSE, behind: int = 0) -> Iterator[list[str]]:
    """Whole lines of a stream, in bursts; the unterminated last line comes at the end. A reader
    that is faster than Spark waits. behind: lines that a burst after the first may have if as
    many are there already when it begins."""
    waiting = _Waiting(2 * max(most, behind))
    failed: list[BaseException] = []

    def read() -> None:
        rest: list[str] = []
        try:
            for chunk in chunks:
                head, newline, tail = chunk.rpartition("\n")
                if newline:
                    waiting.put([x.removesuffix("\r") for x in ("".join(rest) + head).split("\n")])
                    rest = []
                if tail:
                    rest.append(tail)
            if rest:
                waiting.put(["".join(rest).removesuffix("\r")])
        except BaseException as e:  # noqa: BLE001  told to the reader of the bursts
            failed.append(e)
        waiting.end()

    threading.Thread(target=read, daemon=True).start()
    wait, room = first, most
    while got := waiting.take(room, None):
        while len(got) < most and (more := waiting.take(most - len(got), wait)):
            got += more
        wait, room = pause, max(most, behind)
        yield got
    if failed:
        raise failed[0]


def _frame(spark: SparkSession, lines: list[str], path: str, done: int) -> DataFrame:
    """Lines as rows, in their order."""
    try:
        raw = pa.array(lines, pa.string())
    except UnicodeEncodeError:  # bytes that were no UTF-8
        raw = pa.array([x.encode("utf-8", "replace").decode() for x in lines], pa.string())
    rows = spark.createDataFrame(pa.table({"lineno": np.arange(done + 1, done + 1 + len(lines)), "raw": raw}))
    return rows.select(F.lit(path).alias("path"), F.lit(0).cast("long").alias("block"), "lineno", "raw")


def follow_stream(spark: SparkSession, chunks: Iterable[str], template: Template | None = None, expression: str | None = None, path: str = "(stdin)", most: int = BURST) -> Iterator[str]:
    """The visible raw lines of a stream, burst by burst. Without a template the first burst
    decides which it is."""
    done, kept, shown, verdict, used = 0, 0, False, None, []
    for lines in bursts(chunks, most, behind=BEHIND):
        df = _frame(spark, lines, path, done)
        if template is None:
            template = detect(df)
        if verdict is None:
            verdict = F.lit(True) if expression is None else compile_filter(expression, template)
            used = [] if expression is None else fields_of(expression, template)
        judged = parse_rows(df, template, used).select("lineno", (~F.col("cont")).alias("head"), F.coalesce(verdict, F.lit(False)).alias("v")).toArrow()
        head, v = (np.zeros(len(lines), bool) for _ in range(2))
        at = judged["lineno"].to_numpy() - done - 1
        head[at], v[at] = judged["head"].to_numpy(), judged["v"].to_numpy()
        last = np.maximum.accumulate(np.where(head, np.arange(len(lines)), -1))
        visible = np.where(last < 0, shown, v[last])
        for i in np.flatnonzero(visible).tolist():
            yield lines[i]
        shown = bool(visible[-1])
        done, kept = done + len(lines), kept + len(lines)
        if kept >= BURST:  # handles of past bursts are cycles; until these go, the JVM keeps the rows
            del df
            gc.collect()
            kept = 0
