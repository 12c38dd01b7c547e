"""Snapshot classes as a Spark data source: `spark.read.format("host_classes").load(path)`.

A namespace is a folder with one folder a class (class=<name>) of Parquet files of (host_id, seq, properties), properties JSON text. The source plans one task a
file, takes over conditions on the class, so that only asked classes are listed and read, and gives no rows for a class that isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition


@dataclass
class ClassFile(InputPartition):
    name: str
    path: str


class ClassReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.asked = path, None

    def pushFilters(self, filters):
        """Conditions on the class are done with; all others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("class",):
                self.asked = values if self.asked is None else self.asked & values
            else:
                yield f

    def _files(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[ClassFile]:
        from pyarrow import fs

        store, root = self._files()
        listed = lambda folder: store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        if self.asked is None:
            names = sorted(d.base_name.removeprefix("class=") for d in listed(root) if d.base_name.startswith("class="))
        else:
            names = sorted(self.asked)
        return [ClassFile(n, f.path) for n in names for f in sorted(listed(f"{root}/class={n}"), key=lambda f: f.path) if f.is_file and f.base_name.endswith(".parquet")]

    def read(self, partition: ClassFile | None) -> Iterator:
        if partition is not None:
            import pyarrow as pa
            from pyarrow import parquet

            store, _ = self._files()
            with store.open_input_file(partition.path) as file:
                for batch in parquet.ParquetFile(file).iter_batches(columns=["host_id", "seq", "properties"]):
                    yield pa.RecordBatch.from_arrays([batch.column("host_id"), pa.array([partition.name] * batch.num_rows), batch.column("seq"), batch.column("properties")], ["host_id", "class", "seq", "properties"])


class ClassSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "host_classes"

    def schema(self) -> str:
        return "host_id bigint, class string, seq bigint, properties string"

    def reader(self, schema) -> ClassReader:
        return ClassReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take over conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClassSource)
