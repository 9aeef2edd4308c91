"""A table kept by appended, mergeable deltas: one block per micro-batch, merged when read, compacted by powers.

Micro-batch ``e`` writes the partial states of its own rows as block ``e`` of tier 0, reading nothing else.
After every ``fan`` micro-batches their blocks are merged into one block of tier 1, after ``fan`` of those into one of
tier 2, and so on, so each partial row is rewritten once per tier and a reader merges at most ``fan - 1`` blocks
of each tier.  Block ``b`` of tier ``t`` stands for micro-batches ``b * fan^t`` up to ``(b + 1) * fan^t - 1``; a reader takes the
largest finished blocks (those with a success mark), so a block that is being written, or was left half written by a lost
driver, is not seen.  A micro-batch that runs again writes the same blocks again.  Compacted blocks are dealt and sorted by ``cluster`` (hours,
for gold), so that a reader of a few windows skips the row groups of all others.

With ``cluster_deltas`` the blocks of single micro-batches are laid out that way too, and ``options`` go to the
Parquet writer (Bloom filters, row group size).

Nothing is deleted: blocks that a higher tier stands for can be removed once no reader started before that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN = 8


@dataclass(frozen=True)
class DeltaTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    cluster: tuple[str, ...] = ()
    fan: int = FAN
    cluster_deltas: bool = False
    options: dict[str, str] = field(default_factory=dict)

    def append(self, partial: DataFrame, epoch: int) -> None:
        """Write micro-batch ``epoch``, then the blocks that it completes."""
        self._write(partial, 0, epoch)
        tier, done = 0, epoch + 1
        while done % self.fan == 0:
            done //= self.fan
            parts = self._frame([self._block(tier, b) for b in range((done - 1) * self.fan, done * self.fan) if self._finished(tier, b)])
            tier += 1
            self._write(self.merge(parts), tier, done - 1)

    def read(self) -> DataFrame:
        """The merged table; empty until a micro-batch has been written."""
        return self.merge(self._frame([self._block(t, b) for t, b in self.blocks()]))

    def blocks(self) -> list[tuple[int, int]]:
        """The largest finished blocks, (tier, number), that together stand for every micro-batch once."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path}/tier=*/block=*/_SUCCESS")
        marks = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        found = []
        for mark in marks or []:
            block = mark.getPath().getParent()
            found.append((int(block.getParent().getName().split("=")[1]), int(block.getName().split("=")[1])))
        taken, spans = [], []
        for tier, block in sorted(found, key=lambda x: (-x[0], x[1])):
            first, last = block * self.fan**tier, (block + 1) * self.fan**tier - 1
            if not any(a <= first and last <= b for a, b in spans):
                taken.append((tier, block))
                spans.append((first, last))
        return taken

    def _block(self, tier: int, block: int) -> str:
        return f"{self.path}/tier={tier}/block={block}"

    def _finished(self, tier: int, block: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._block(tier, block)}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _frame(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _write(self, rows: DataFrame, tier: int, block: int) -> None:
        if self.cluster and (tier or self.cluster_deltas):
            rows = rows.repartitionByRange(*self.cluster).sortWithinPartitions(*self.cluster)
        (rows.select(*self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", "static").options(**self.options)
         .parquet(self._block(tier, block)))
