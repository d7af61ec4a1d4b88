"""Small helpers shared by the operators: column selection and passes over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.words import tidy

#: The white space that the operators' word rules name: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns an operator needs and no others, so that extra columns, whatever their names, cannot clash.

    A null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *[docs[c] for c in more])


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text, or one row where a text is longer; what the task has freed goes back at its end."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = batch.num_rows if size <= most_bytes else max(1, batch.num_rows * most_bytes // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    tidy()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; nulls as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_place(docs: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` with its batches changed in Python: the same columns, some rows fewer or other values.  No column is added, so none can clash."""
    return docs.mapInArrow(change, docs.schema)


#: Keys with so large a share of the rows (one in so many) that there can be no more than this number of them.
HEAVY = 1000


def with_groups(rows: DataFrame, groups: DataFrame, on: str, of: str, size: str, total: int) -> DataFrame:
    """The equi-join of rows with their groups, a row of ``groups`` for each value of ``of``, of which ``size`` is the number of rows of all ``total``.

    Groups with a thousandth of the rows or more, a thousand at most, are broadcast, so their rows do not meet in one task; all others
    meet by a shuffle."""
    heavy = F.broadcast(groups.where(F.col(size) * HEAVY >= total))
    light = groups.where(F.col(size) * HEAVY < total)
    few = rows.join(heavy, F.col(on) == F.col(of))
    rest = rows.join(heavy.select(F.col(of).alias(fresh(rows, "heavy"))), F.col(on) == F.col(fresh(rows, "heavy")), "left_anti")
    return few.unionByName(rest.join(light, F.col(on) == F.col(of)))
