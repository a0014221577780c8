"""Versions of a set of tables, each there whole or not at all, below one folder.

A commit first writes the rows of its tables to folders of their own and then one small file, versions/<n>.json, that names the folders of all tables. Readers go by
that file alone: a job that fails leaves folders that nobody names, and the version before stays as it is. A version's file is made only if there is none of its
number, so of two writers that began from one version one commits, and the other reads anew and tries again."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has made the version."""


class _Local:
    """A folder of this machine, or one that is mounted."""

    def names(self, folder: str) -> list[str]:
        return os.listdir(folder) if os.path.isdir(folder) else []

    def text(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def put(self, path: str, text: str) -> bool:
        """A new file with all of the text; False if there is one already."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        made = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(made, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(made, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)


class _Hadoop:
    """A folder of a store that Spark reaches; its rename has to refuse a name that is taken, as HDFS does."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark = spark

    def names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self.path(folder))] if self.files.exists(self.path(folder)) else []

    def text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def put(self, path: str, text: str) -> bool:
        made = self.path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.files.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.files.exists(self.path(path)) and self.files.rename(made, self.path(path))
        if not done:
            self.files.delete(made, False)
        return done


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = _Hadoop(spark, root) if "://" in root else _Local()

    def _file(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def version(self) -> int:
        """The last version; 0 before the first."""
        return max((int(n[:-5]) for n in self.store.names(f"{self.root}/versions") if n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        version = self.version() if version is None else version
        return json.loads(self.store.text(self._file(version))) if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it was in a version; the last one if none is named."""
        found = self.tables(version)
        if table not in found:
            raise KeyError(table)
        return self.spark.read.schema(T.StructType.fromJson(found[table]["schema"])).parquet(f"{self.root}/data/{found[table]['folder']}")

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """The version after base, with these tables and all others as they were. Raises Conflict if base isn't the last one any more."""
        told = self.tables(base)
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/data/{folder}")
            told[name] = {"folder": folder, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).jsonValue()}
        if not self.store.put(self._file(base + 1), json.dumps(told, ensure_ascii=False)):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def update(self, change: Callable[[int], dict[str, DataFrame]], attempts: int = 20) -> int:
        """Commits what change makes of the last version; where another writer was faster, of the version that it made."""
        for k in range(attempts):
            base = self.version()
            try:
                return self.commit(change(base), base)
            except Conflict:
                if k == attempts - 1:
                    raise
        raise AssertionError

    def merge(self, table: str, new: DataFrame, keys: Iterable[str], attempts: int = 20) -> int:
        """JN14, SNK8: rows of new take the place of those with equal keys (nulls are equal), and others are added. Of rows of new with equal keys one counts, the same each time."""
        keys = list(keys)
        rest = [c for c in new.columns if c not in keys]
        once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, *(F.col("__r")[c].alias(c) for c in rest)) if rest else new.distinct()

        def change(base: int) -> dict[str, DataFrame]:
            if table not in self.tables(base):
                return {table: once}
            old = self.read(table, base)
            same = [old[k].eqNullSafe(once[k]) for k in keys]
            kept = old.join(once.select(*keys), same, "left_anti")
            return {table: kept.unionByName(once.select(*kept.columns))}

        return self.update(change, attempts)

    def unnamed(self) -> list[str]:
        """Folders of data that no version names: of commits that failed, or that are under way."""
        named = {t["folder"] for n in self.store.names(f"{self.root}/versions") if n.endswith(".json") for t in self.tables(int(n[:-5])).values()}
        return sorted(set(self.store.names(f"{self.root}/data")) - named)
