"""Tables in named parts that change by versions: what is not touched is neither read nor written.

A version is a small JSON manifest: the folders of each part, and notes.  A
change writes new folders beside the old ones with Spark's own commit of tasks
and then one manifest; before that readers see the old version, and a writer
that is lost leaves only folders that no manifest names (``vacuum``).  The
number of the next version is claimed by creating a file that must not be
there, so of two changes of one version the second fails and can be tried
again.  All goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another change of the same version came first."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join((self.folder, *names)))

    def _list(self, *names: str) -> list[str]:
        at = self._path(*names)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, n: int) -> dict:
        stream = self._fs.open(self._path("manifest", f"v{n:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        return [int(x[1:-5]) for x in self._list("manifest") if x.startswith("v") and x.endswith(".json")]

    def current(self) -> tuple[int, dict[str, list[str]], dict]:
        """(version, folders of each part, notes) of the last version; 0 if there is none."""
        found = self.numbers()
        if not found:
            return 0, {}, {}
        m = self._manifest(found[-1])
        return found[-1], m["parts"], m["notes"]

    def read(self, schema: StructType | str, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of these parts (None: of all), those that are not there left out."""
        _, have, _ = self.current()
        paths = [f"{self.folder}/data/{x}" for p in (have if parts is None else dict.fromkeys(parts)) for x in have.get(p, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last versions and the folders that none of these names; not while a change is under way."""
        found = self.numbers()
        named = {x.split("/")[0] for n in found[-keep:] for paths in self._manifest(n)["parts"].values() for x in paths}
        gone = [x for x in self._list("data") if x not in named]
        for x in gone:
            self._fs.delete(self._path("data", x), True)
        for n in found[:-keep]:
            self._fs.delete(self._path("manifest", f"v{n:010d}.json"), False)
        return len(gone)


class Change:
    """Parts to replace, extend or drop; nothing is seen before ``commit``."""

    def __init__(self, versions: Versions):
        self.versions = versions
        self.base, parts, notes = versions.current()
        self.parts = {p: list(x) for p, x in parts.items()}
        self.notes = dict(notes)

    def _write(self, df: DataFrame, by: str | None = None) -> str:
        name = uuid.uuid4().hex
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.versions.folder}/data/{name}")
        return name

    def read(self, schema: StructType | str, part: str) -> DataFrame:
        """The rows of a part as this change leaves it, written but not yet committed."""
        return self.versions.spark.read.schema(schema).parquet(*[f"{self.versions.folder}/data/{x}" for x in self.parts[part]])

    def put(self, part: str, df: DataFrame) -> Change:
        self.parts[part] = [self._write(df)]
        return self

    def add(self, part: str, df: DataFrame) -> Change:
        self.parts.setdefault(part, []).append(self._write(df))
        return self

    def put_each(self, df: DataFrame, by: str, extend: bool = False) -> list[str]:
        """Replace (or extend) a part for each value of a column, by=value, in one job; the column is not stored."""
        name = self._write(df, by)
        found = [x for x in self.versions._list("data", name) if x.startswith(f"{by}=")]
        for part in found:
            self.parts[part] = (self.parts.get(part, []) if extend else []) + [f"{name}/{part}"]
        return found

    def drop(self, part: str) -> Change:
        self.parts.pop(part, None)
        return self

    def commit(self) -> int:
        v, n = self.versions, self.base + 1
        claim = v._path("manifest", f"claim-{n:010d}")
        try:
            v._fs.create(claim, False).close()
        except Exception as e:
            raise Conflict(f"version {n} of {v.folder} is another writer's") from e
        draft = v._path("manifest", f"draft-{uuid.uuid4().hex}")
        out = v._fs.create(draft, True)
        out.write(bytearray(json.dumps({"parts": self.parts, "notes": self.notes}).encode()))
        out.close()
        if not v._fs.rename(draft, v._path("manifest", f"v{n:010d}.json")):
            raise Conflict(f"version {n} of {v.folder} could not be named")
        return n

    def give_up_claim(self) -> None:
        """Take back the claim of a writer that was lost between its claim and its manifest."""
        self.versions._fs.delete(self.versions._path("manifest", f"claim-{self.base + 1:010d}"), False)
