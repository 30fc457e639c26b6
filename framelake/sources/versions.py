"""A catalogue that persists, in versions that no writer can lose.

path/data-<id> holds a version's rows as Parquet, and path/version-<n> its name, created only if it isn't there yet. A change is made on the newest version and offered as the next;
if another writer was first, it is made again on that one's. So updates of several writers are applied one after the other, and readers always see a whole version.

Deleting a job marks its row first, then takes its files away, then the row: a crash in between leaves a marked row, which recover() finishes. Marked jobs aren't listed.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = re.compile(r"[\w-]+", re.ASCII)


class Catalogue:
    """schema: of the rows, with job_id; a column `deleting` is the catalogue's own."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema + ", deleting boolean"

    def _fs(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def newest(self) -> int:
        """The number of the newest version, 0 without any."""
        fs, _ = self._fs("")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n[8:]) for n in names if re.fullmatch(r"version-\d+", n)), default=0)

    def _named(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/version-{version}").first()["value"]

    def read(self, version: int | None = None, marked: bool = False) -> DataFrame:
        """The rows of the newest version or a given one."""
        version = self.newest() if version is None else version
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._named(version)}") if version else self.spark.createDataFrame([], self.schema)
        return rows if marked else rows.filter("deleting is null or not deleting").drop("deleting")

    def _offer(self, version: int, name: str) -> bool:
        """Creates the version if no other writer has."""
        fs, target = self._fs(f"version-{version}")
        if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create then
            try:
                with os.fdopen(os.open(target.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(name)
                return True
            except FileExistsError:
                return False
        try:
            out = fs.create(target, False)
        except Exception as e:
            if fs.exists(target):
                return False
            raise e
        out.write(name.encode())
        out.close()
        return True

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """change(rows) as the next version; its number. The change is made again if another writer came first."""
        for _ in range(tries):
            version, name = self.newest(), f"data-{uuid.uuid4().hex}"
            change(self.read(version, marked=True)).coalesce(1).write.parquet(f"{self.path}/{name}")
            if self._offer(version + 1, name):
                return version + 1
            fs, target = self._fs(name)
            fs.delete(target, True)
            time.sleep(0.05)
        raise RuntimeError(f"{tries} other writers came first")

    def upsert(self, rows: DataFrame) -> int:
        """Rows by job_id, in place of those there."""
        new = rows.withColumn("deleting", F.lit(False))
        return self.update(lambda old: old.join(new, "job_id", "left_anti").unionByName(new.select(*old.columns)))

    def delete(self, job_id: str, files: list[str]) -> bool:
        """Takes a job's files (names below a folder of the job's own, of its result first) and its row away. Whether the result existed; an id of other than word
        characters and hyphens names no job."""
        if not _ID.fullmatch(job_id):
            return False
        self.update(lambda old: old.withColumn("deleting", F.coalesce("deleting", F.lit(False)) | (F.col("job_id") == job_id)))
        return self._finish(job_id, files)

    def _finish(self, job_id: str, files: list[str]) -> bool:
        gone = []
        for name in files:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            gone.append(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True))
        self.update(lambda old: old.filter(F.col("job_id") != job_id))
        return bool(gone and gone[0])

    def recover(self, files: Callable[[str], list[str]]) -> list[str]:
        """Finishes deletions that were cut off; files(job_id) names a job's files. The ids."""
        marked = [r["job_id"] for r in self.read(marked=True).filter("deleting").select("job_id").collect()]
        for job_id in marked:
            self._finish(job_id, files(job_id))
        return marked

    def tidy(self, keep: int = 10) -> None:
        """Takes versions before the last `keep` away, data first."""
        last = self.newest()
        fs, root = self._fs("")
        for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            name = s.getPath().getName()
            if re.fullmatch(r"version-\d+", name) and int(name[8:]) <= last - keep:
                for old in (self._named(int(name[8:])), name):
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
