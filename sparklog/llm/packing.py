"""Packing into fixed-length sequences.

Documents are dealt into randomised groups (a hash of the doc_id) of a bounded volume of text;
each group is packed on its own. Whole sequences are cut from documents longer than one; what
remains of each document is placed by first-fit decreasing: a tournament tree over the bins'
free capacities gives the first bin that fits. At the end the emptiest bins are dissolved into
the gaps of the others (cutting documents there), which leaves less than one sequence of
padding in a group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .shared import trim

#: Characters of text in a group, about; more documents make more groups.
GROUP_CHARS = 6_000_000


class Tournament:
    """Bins in order, each with a free capacity; an inner node knows the larger of its two."""

    def __init__(self, capacity: int, bins: int):
        self.base = 1 << max(1, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Takes size from the first bin that has it free; gives the bin."""
        free, i = self.free, 1
        while i < self.base:
            i *= 2
            if free[i] < size:
                i += 1
        at = i - self.base
        left = free[i] - size
        while True:
            free[i] = left
            if i == 1:
                return at
            i //= 2
            left = max(free[2 * i], free[2 * i + 1])


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, bin) of all documents. Each id is in one piece, no bin
    has over capacity ids, and all bins together have less than capacity ids of room."""
    pieces, rest, bins = [], [], 0
    for doc, n in enumerate(sizes):
        for at in range(0, n - capacity + 1, capacity):
            pieces.append((doc, at, capacity, bins))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, doc))
    rest.sort(key=lambda x: (-x[0], x[1]))
    if not rest:
        return pieces
    tree = Tournament(capacity, len(rest))
    held: list[list[tuple[int, int, int]]] = []
    for n, doc in rest:
        at = tree.place(n)
        if at == len(held):
            held.append([])
        held[at].append((doc, sizes[doc] - n, n))
    room = [capacity - sum(x[2] for x in h) for h in held]
    drop = sum(room) // capacity
    order = sorted(range(len(held)), key=lambda i: (room[i], i))
    keep, loose = order[: len(order) - drop], [x for i in order[len(order) - drop :] for x in held[i]]
    for i in keep:
        while loose and room[i]:
            doc, at, n = loose.pop()
            take = min(n, room[i])
            held[i].append((doc, at, take))
            room[i] -= take
            if take < n:
                loose.append((doc, at + take, n - take))
    return pieces + [(*x, bins + k) for k, i in enumerate(keep) for x in held[i]]


def _packed(pdf: pd.DataFrame, path: str, end: int, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
    stop = np.array([end], np.uint32)
    ids = [np.concatenate([x, stop]) for x in Encoder.of(path).encode(pdf["text"].tolist())]
    doc = pdf["doc_id"].tolist()
    known = pdf["known"].tolist()
    group = int(pdf["grp"].iloc[0])
    fill: dict[int, int] = {}
    rows = []
    for d, at, n, b in pack([len(x) for x in ids], capacity):
        offset = fill.get(b, 0)
        fill[b] = offset + n
        rows.append((doc[d] if known[d] else None, at, n, zlib.crc32(ids[d][at : at + n].astype("<u4").tobytes()), len(ids[d]), (group << 32) + b, offset))
    trim()
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def sequences(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A document's ids are those of its text (null: empty) and the id end.

    Rows with a null doc_id are packed like others, dealt by their text; repeated rows are
    packed as often as they stand there. Other columns are not read."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("key", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))))
    sizes = src.groupBy("key").agg(F.sum(F.length("text").cast("long") + 1).alias("chars"))
    chars, most = sizes.agg(F.sum("chars"), F.max("chars")).first()
    groups = max(1, -(-(chars or 0) // GROUP_CHARS))
    grp = F.pmod("key", F.lit(groups))
    if (most or 0) > 2 * GROUP_CHARS:  # rows of one key, too many for a group: dealt row by row
        many = sizes.where(F.col("chars") > 2 * GROUP_CHARS).select("key", F.ceil(F.col("chars") / GROUP_CHARS).alias("slices"))
        src = src.join(many, "key", "left")
        grp = F.when(F.col("slices").isNull(), grp).otherwise(F.pmod(F.xxhash64("key", F.pmod(F.monotonically_increasing_id(), F.col("slices"))), F.lit(groups)))
    src = src.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text", grp.cast("long").alias("grp"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return src.groupBy("grp").applyInPandas(lambda pdf: _packed(pdf, tokenizer, end, capacity), schema)
