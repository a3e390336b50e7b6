"""Tables of years with versions: data is written aside, and one small file makes it the next version.

Below the table's folder, data/<id> has what a load wrote, a folder for each year, and versions/<number> says in which folder each year of that version is. A
version's file is created only if there is none of its number yet, and all of it is there at once, so a reader sees the version before or after, never half a load;
of two loads at the same time one fails and may be repeated. A load that fails deletes what it wrote and leaves no version. Years that a load doesn't touch
are not copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class YearTable:
    def __init__(self, spark: SparkSession, folder: str, year: str = "year"):
        self.spark, self.folder, self.year = spark, folder.rstrip("/"), year
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        at = self._path("versions")
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """(version, {"schema": ..., "years": year -> folder below this one}); version 0 is the empty table."""
        have = self.versions()
        version = version if version is not None else (have or [0])[-1]
        if version == 0:
            return 0, {"schema": None, "years": {}}
        if version not in have:
            raise ValueError(f"no version {version}")
        stream = self.fs.open(self._path(f"versions/{version:012d}"))
        try:
            return version, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest one by default."""
        _, state = self.state(version)
        if not state["schema"]:
            raise ValueError("nothing is stored")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.folder}/{p}" for p in sorted({p for p in state["years"].values()})]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load(self, rows: DataFrame, replace: bool = False) -> int:
        """Adds the years of rows as the next version, whose number is returned. A year that is there already is an error, unless it is to be replaced."""
        before, state = self.state()
        own = f"data/{uuid.uuid4().hex}"
        try:
            self._write(rows, own)
            years = [f.getPath().getName() for f in self.fs.listStatus(self._path(own)) if f.isDirectory()]
            if clash := sorted({y.split("=", 1)[1] for y in years} & set(state["years"])):
                if not replace:
                    raise ValueError(f"year {clash[0]} is stored already")
            after = {"schema": rows.schema.jsonValue(), "years": state["years"] | {y.split("=", 1)[1]: f"{own}/{y}" for y in years}}
            if state["schema"] and [(f["name"], f["type"]) for f in state["schema"]["fields"]] != [(f["name"], f["type"]) for f in after["schema"]["fields"]]:
                raise ValueError("the columns are not those of the table")
            self._commit(before + 1, after)
        except BaseException:
            self.fs.delete(self._path(own), True)
            raise
        return before + 1

    def _write(self, rows: DataFrame, own: str) -> None:
        # The year stays in the files, so a year's folder can be read by itself.
        rows.withColumn("_year", F.col(self.year)).write.partitionBy("_year").parquet(f"{self.folder}/{own}")

    def _commit(self, version: int, state: dict) -> None:
        """A file is written aside and renamed; renaming fails where the number is taken."""
        aside, to = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version:012d}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(state), "utf-8"))
        stream.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(aside, to, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise ValueError(f"version {version} was made by another load") from None
            raise

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the last few, and data that none of those names."""
        have = self.versions()
        used = {p.split("/")[1] for v in have[-keep:] for p in self.state(v)[1]["years"].values()}
        for v in have[:-keep]:
            self.fs.delete(self._path(f"versions/{v:012d}"), False)
        at = self._path("data")
        for f in self.fs.listStatus(at) if self.fs.exists(at) else []:
            if f.getPath().getName() not in used:
                self.fs.delete(f.getPath(), True)
