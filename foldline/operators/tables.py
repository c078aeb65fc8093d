"""Written tables: lineage cuts, and generations that are put in force by one pointer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster shares; a temporary folder only where none is set and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="foldline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/foldline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Generations:
    """Generations of a target group: each is a set of tables in its own folder, and one of them serves.

    ``promote`` makes a file that is named by the next epoch and holds the generation's name. A file system makes a file
    that isn't to be overwritten only once, so of two writers one fails; a crash before it changes nothing that is read.
    Readers take the name in the file of the highest epoch; a file that was left without one uses its epoch up.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("pointer").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def write(self, generation: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{generation}/{name}")

    def serving(self) -> tuple[int, str | None]:
        if not self.fs.exists(self._path("pointer")):
            return 0, None
        names = sorted((x for x in (x.getPath().getName() for x in self.fs.listStatus(self._path("pointer"))) if x.isdigit()), reverse=True)
        for name in names:
            source = self.fs.open(self._path(f"pointer/{name}"))
            held = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
            source.close()
            if held.endswith("\n"):
                return int(names[0]), held[:-1]
        return int(names[0]) if names else 0, None

    def promote(self, generation: str, expected_epoch: int) -> int:
        """Puts a generation in force if no other was promoted meanwhile."""
        epoch, _ = self.serving()
        if epoch == expected_epoch:
            try:
                out = self.fs.create(self._path(f"pointer/{epoch + 1:020d}"), False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error) and "already exists" not in str(error):
                    raise
            else:
                out.write(bytearray(f"{generation}\n".encode()))
                out.close()
                return epoch + 1
        raise ValueError(f"the serving epoch is {self.serving()[0]}, not {expected_epoch}")

    def read(self, table: str) -> DataFrame:
        _, generation = self.serving()
        if generation is None:
            raise ValueError("no generation serves")
        return self.spark.read.parquet(f"{self.root}/{generation}/{table}")
