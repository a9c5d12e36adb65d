"""A ledger of committed micro-batches, and state tables that go with it.

Structured Streaming delivers a micro-batch to ``foreachBatch`` at least once: after a failure the same batch id comes
again with the same rows.  A batch that writes several tables commits by entering its id into the ledger last, in the
shared folder.  Until then its writes are made again; after that the batch is skipped.

State is kept by batch: each batch writes ``state-<name>/batch=<id>`` anew and reads what the last *committed* batch
before it wrote, so a batch that is given again starts from the same state, whatever its first attempt has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ternlens.session import remove_folder


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.folder = self._path("ledger")
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def committed(self) -> list[int]:
        """Ids of the committed batches that the ledger still lists, ascending."""
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(self.folder))

    def done(self, batch: int) -> bool:
        """Whether the batch, or a later one, has been committed (batches commit in order)."""
        return any(b >= batch for b in self.committed())

    def state(self, name: str, batch: int) -> DataFrame | None:
        """The state that the last committed batch before ``batch`` wrote."""
        before = [b for b in self.committed() if b < batch]
        return self.spark.read.parquet(f"{self.root}/state-{name}/batch={before[-1]}") if before else None

    def put_state(self, name: str, batch: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.root}/state-{name}/batch={batch}")

    def commit(self, batch: int, states: tuple[str, ...] = (), keep: int = 2) -> None:
        """Enters the batch; entries and states older than the last ``keep`` go."""
        self.fs.create(self._path(f"ledger/{batch:012d}"), True).close()
        for old in self.committed()[:-keep]:
            for name in states:
                remove_folder(self.spark, f"{self.root}/state-{name}/batch={old}")
            self.fs.delete(self._path(f"ledger/{old:012d}"), False)
