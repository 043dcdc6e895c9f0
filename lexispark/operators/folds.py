"""Running choices over sorted rows: what each row's fate does to the next one's can't be a running sum."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


class State(Protocol):
    def many(self, rows: pa.RecordBatch) -> list[pa.Array]:
        """The new columns of the rows that come next; the state goes on from there."""


def sorted_fold(
    rows: DataFrame, keys: list[str], order: list[str | Column], make: Callable[[], State], new: str
) -> DataFrame:
    """Rows with new columns (DDL) that a state gives while it reads the rows of its key in order.

    Rows are dealt by key, sorted, and read as a stream, so a task holds one batch and one state however many rows a
    key has; a key's rows are read by one task, as each depends on those before it.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(new).fields])
    names, places = [f.name for f in schema.fields], [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            own = list(zip(*[b.column(k).to_pylist() for k in places], strict=True))
            ends = [i for i in range(1, len(own)) if own[i] != own[i - 1]] + [len(own)]
            begin = 0
            for end in ends if own else []:
                if state is None or own[begin] != at:
                    at, state = own[begin], make()
                part = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *state.many(part)], names)
                begin = end

    return placed.mapInArrow(run, schema)


class Budget:
    """Takes rows while two budgets last, a number of rows and a sum; a row that is too large is passed over.

    Its columns are given by place: sizes, and the room and the rows that a key has at first, the same in all of its rows.
    """

    def __init__(self, size: int, room: int, rows: int):
        self.places, self.room, self.rows = (size, room, rows), None, None

    def many(self, rows: pa.RecordBatch) -> list[pa.Array]:
        sizes, room, count = (rows.column(k).to_numpy() for k in self.places)
        if self.room is None:
            self.room, self.rows = int(room[0]), int(count[0])
        taken = np.zeros(len(sizes), bool)
        left = np.flatnonzero(sizes <= self.room)
        while len(left) and self.rows > 0:  # rows that fit one after the other, then those that still fit
            total = np.cumsum(sizes[left])
            k = min(int(np.searchsorted(total, self.room, "right")), self.rows)
            taken[left[:k]] = True
            self.rows -= k
            self.room -= int(total[k - 1])
            left = left[k:]
            left = left[sizes[left] <= self.room]
        return [pa.array(taken)]
