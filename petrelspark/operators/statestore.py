"""The known states of a search, kept by the hash of their marking.

A state is found by 128 bits over its net and marking (``hashed``), and equal hashes are told apart by the marking itself.  What a round adds is
a run of its own; runs of one size class are merged when there are several, so there are few at any time and a state is
written again a logarithmic number of times.  A large run lies in folders by hash, and a lookup reads only those that
the sought hashes fall in, so what a round costs follows its frontier and not all that is known.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.staging import remove, session_dir

#: Rows of a folder; folders of a run at most; runs of a size class that are merged.
FOLDER_ROWS, MOST_FOLDERS, RUNS = 262_144, 1024, 8
#: Columns by which states are found.
SOUGHT = ["h1", "h2", "net_id", "marking"]
COLUMNS = ["net_id", "state_id", "level", "marking", "h1", "h2"]


def hashed(net: Column, marking: Column) -> list[Column]:
    """Two 64-bit hashes of a net's marking; the second one also takes the marking backwards, so it is no function of the first."""
    return [F.xxhash64(net, marking).alias("h1"), F.xxhash64(F.lit("second"), F.reverse(marking), net).alias("h2")]


@dataclass(frozen=True)
class _Run:
    rows: int
    folders: int
    at: DataFrame
    path: str | None = None


class StateStore:
    """Rows (net_id, state_id, level, marking, h1, h2); the runs' files stay until the session's folder is swept, but those of merged runs go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, []

    def add(self, rows: DataFrame, n: int) -> None:
        """Take ``n`` staged rows as a run, and merge runs of its size class where there are enough."""
        self.runs.append(_Run(n, 1, rows))
        while len(self.runs) >= RUNS and self.runs[-RUNS].rows <= RUNS * max(1, self.runs[-1].rows):
            last = self.runs[-RUNS:]
            del self.runs[-RUNS:]
            self.runs.append(self._merged(last))

    def _merged(self, runs: list[_Run]) -> _Run:
        n = sum(r.rows for r in runs)
        folders = min(MOST_FOLDERS, 1 << max(0, (n // FOLDER_ROWS)).bit_length()) if n >= 2 * FOLDER_ROWS else 1
        rows = reduce(DataFrame.union, [r.at.select(*COLUMNS) for r in runs])
        path, schema = f"{session_dir(self.spark)}/store-{uuid.uuid4().hex}", rows.schema
        if folders == 1:
            rows.write.parquet(path)
            at = self.spark.read.schema(schema).parquet(path)
        else:  # one shuffle, after which each task writes the folders that it holds
            dealt = rows.withColumn("folder", F.pmod("h1", F.lit(folders)).cast("int")).repartition(folders, "folder")
            dealt.write.partitionBy("folder").parquet(path)
            at = self.spark.read.schema(dealt.schema).parquet(path)
        for r in runs:
            if r.path:
                remove(self.spark, r.path)
        return _Run(n, folders, at, path)

    def near(self, sought: DataFrame) -> DataFrame:
        """The known rows (``SOUGHT`` and state_id) among which those with the hashes of ``sought`` (h1) are."""
        most = max(r.folders for r in self.runs)
        hit = [r[0] for r in sought.select(F.pmod("h1", F.lit(most)).cast("int").alias("at")).distinct().collect()] if most > 1 else []  # MOST_FOLDERS numbers at most
        parts = []
        for r in self.runs:
            mine = {h % r.folders for h in hit}
            at = r.at.where(F.col("folder").isin(sorted(mine))) if 1 < r.folders and len(mine) < r.folders else r.at
            parts.append(at.select(*SOUGHT, "state_id"))
        return reduce(DataFrame.union, parts)

    def every(self) -> DataFrame:
        """All known rows."""
        return reduce(DataFrame.union, [r.at.select(*COLUMNS) for r in self.runs])
