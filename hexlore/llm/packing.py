"""Best-fit packing (operator 2): bounded-space online best-fit in two passes, without a shuffle of texts.

First each task cuts its documents into pieces and packs them online, in the order of arrival, into a fixed number of
open bins. What is then still in open bins, a bounded number of pieces per task, is packed once more: those pieces,
numbers alone, meet in tasks of about GROUP_PIECES, longest first, under the same rule with more open bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlore.llm import wordbpe
from hexlore.llm.common import cut_lineage
from hexlore.llm.hashing import slices

#: Pieces of open bins that meet in a task of the second pass, and the bins that it keeps open.
GROUP_PIECES, GROUP_BINS = 50_000, 65_536
#: Rows of an output batch.
BATCH = 8192


class BestFit:
    """Open bins keyed by free space in a bitset: bit f is set while some open bin has f places free.

    A piece goes to the open bin with the least room that still takes it. If none does, a new bin opens; when all
    ``open_bins`` are in use, the fullest closes first. Full bins close at once. closed lists what has closed.
    """

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0) -> None:
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.bits, self.n_open = 0, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def take(self, room: int) -> int:
        stack = self.by_room[room]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        self.n_open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the place in it of a piece of 1 to capacity tokens."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_id = self.take(room)
        else:
            if size < self.capacity and self.n_open >= self.open_bins:
                self.closed.append(self.take((self.bits & -self.bits).bit_length() - 1))
            bin_id, room = self.next_id, self.capacity
            self.next_id += 1
        left = room - size
        if left:
            self.by_room[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(bin_id)
        return bin_id, self.capacity - room


def pack(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, if asked for).

    A document is its token ids and then end_id, so a null or empty text is one piece of one token. Documents longer
    than capacity are cut into capacity-long pieces, the last may be shorter; no others are cut. Null and repeated
    ids are carried as they are, each row a document of its own; an empty table gives no rows. open_bins bounds the
    bins that a task of the first pass keeps open, and with them what is packed a second time, so part-filled ends of
    tasks are filled from one another, however many tasks there are. Columns besides id_col and text_col are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset", "open"]
    types = {"id": source.schema["id"].dataType, "piece": T.IntegerType(), "ids": T.ArrayType(T.IntegerType()), "open": T.BooleanType()}
    schema = T.StructType([T.StructField(n, types.get(n, T.LongType())) for n in names])

    def first(batches):
        bpe = wordbpe.load(path)
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        held: dict[int, list[tuple]] = {}
        done: list[tuple] = []
        arrow = None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

        for batch in batches:
            arrow = arrow or [batch.column(0).type, pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int32())] * with_ids, *[pa.int64()] * 2, pa.bool_()]
            for at, part in slices(batch.column(1)):
                keys = batch.column(0).slice(at, len(part)).to_pylist()
                for key, ids in zip(keys, bpe.token_ids(part.to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        bin_id, offset = bins.place(len(cut))
                        held.setdefault(bin_id, []).append((key, piece, start, len(cut), zlib.crc32(cut.tobytes()), *[cut.astype(np.int32)] * with_ids, bin_id, offset))
                        while bins.closed:
                            done.extend((*r, False) for r in held.pop(bins.closed.pop()))
                    if len(done) >= BATCH:
                        yield table(done)
                        done = []
        done.extend((*r, True) for rows in held.values() for r in rows)
        for at in range(0, len(done), BATCH):
            yield table(done[at : at + BATCH])

    packed = cut_lineage(source.mapInArrow(first, schema))
    left = packed.where("open")
    groups = max(1, -(-left.count() // GROUP_PIECES))

    def second(batches):
        bins = BestFit(capacity, GROUP_BINS, (1 << 62) | (TaskContext.get().partitionId() << 40))
        for batch in batches:
            found = [bins.place(n) for n in batch.column(3).to_pylist()]
            bins.closed.clear()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-3], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), batch.columns[-1]],
                names=names
            )

    again = left.repartition(groups, "sequence_id").sortWithinPartitions(F.col("length").desc(), "sequence_id", "offset").mapInArrow(second, schema)
    out = packed.where("not open").unionByName(again)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
