"""A keyed table that many batches write and readers see as one.

Every batch becomes a run: an immutable folder of Parquet files, divided by the hash of the key into a fixed
number of buckets. A small manifest names the runs that make up the table. It is replaced as a whole: a
writer puts down version n + 1, which fails if another writer was faster, and then tries again on top of
that. So a reader that has looked at a manifest works on a snapshot, a repeated batch is recognised by its
number, and there is no moment without data.

As soon as ``fanout`` runs of one level exist they are merged into one of the next level, reduced to what the
table keeps of a key. A table of n batches therefore has at most ``fanout`` runs for each of
log n levels, and reading a few keys opens the files of their buckets only. Merged runs leave the
manifest at once; their files stay ``grace`` seconds longer for readers that were planned before.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQUENCE = "_sequence"  # number of the run that brought a row, to settle rows that are equal otherwise
BUCKET = "tidemark_bucket"
BUCKETS, FANOUT, GRACE = 16, 8, 24 * 3600.0
KEPT_MANIFESTS = 50


class Files:
    """The few file operations that a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.system = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.system.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self.system.listStatus(path))

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Put down a whole file under a name that must be free; False if it is taken."""
        draft = self._path(f"_draft-{uuid.uuid4().hex}")
        stream = self.system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(name)
        self.system.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(
            self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(target), none)
            return True
        except Exception as error:  # py4j wraps what Java throws
            if "FileAlreadyExistsException" not in str(error):
                raise
            self.system.delete(draft, False)
            return False

    def remove(self, name: str) -> None:
        self.system.delete(self._path(name), True)


class RunTable:
    """See above. ``keep`` reduces rows that carry ``SEQUENCE`` to those that the table keeps of every key."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], keep: Callable[[DataFrame], DataFrame],
                 buckets: int = BUCKETS, fanout: int = FANOUT, grace: float = GRACE):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), list(keys), keep
        self.buckets, self.fanout, self.grace = buckets, fanout, grace
        self.files = Files(spark, path)

    # the manifest -------------------------------------------------------

    def manifest(self) -> dict:
        """The newest version; the first writer's number of buckets holds for all."""
        versions = self.files.names("manifest")
        if not versions:
            return {"version": 0, "buckets": self.buckets, "schema": None, "runs": [], "sources": {}, "retired": []}
        return json.loads(self.files.read(f"manifest/{versions[-1]}"))

    def _commit(self, change: Callable[[dict], bool]) -> bool:
        """Apply a change to the newest version until no other writer came between; the change may decline."""
        while True:
            state = self.manifest()
            if not change(state):
                return False
            now, state["version"] = time.time(), state["version"] + 1
            gone = [r for r in state["retired"] if r["at"] + self.grace <= now]
            state["retired"] = [r for r in state["retired"] if r not in gone]
            if self.files.create(f"manifest/{state['version']:012d}.json", json.dumps(state)):
                for run in gone:
                    self.files.remove(run["folder"])
                for old in self.files.names("manifest")[:-KEPT_MANIFESTS]:
                    self.files.remove(f"manifest/{old}")
                return True

    # writing --------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int, level: int) -> tuple[dict, T.StructType]:
        folder = f"data/{uuid.uuid4().hex}"
        kept = self.keep(rows)
        # One file per bucket, or several where adaptive execution finds a bucket too large.
        kept.withColumn(BUCKET, self._bucket(buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(
            f"{self.path}/{folder}")
        held = [int(name.split("=")[1]) for name in self.files.names(folder) if name.startswith(BUCKET)]
        return {"folder": folder, "level": level, "buckets": held}, kept.schema

    def append(self, rows: DataFrame, source: str | None = None, number: int | None = None) -> bool:
        """Add a batch; a numbered batch of a source that is already in the table changes nothing."""
        state = self.manifest()

        def known(s: dict) -> bool:
            return source is not None and s["sources"].get(source, -1) >= number

        if known(state):
            return False
        run, schema = self._write(rows.withColumn(SEQUENCE, F.lit(state["version"] + 1).cast("long")), state["buckets"], 0)

        def add(s: dict) -> bool:
            if known(s):
                return False
            if s["schema"] is None:
                s["schema"], s["buckets"] = schema.jsonValue(), state["buckets"]
            if run["buckets"]:
                s["runs"].append(run)
            if source is not None:
                s["sources"][source] = number
            return True

        if not self._commit(add):
            self.files.remove(run["folder"])
            return False
        while self._merge(self._full_level()):
            pass
        return True

    def _full_level(self) -> list[dict]:
        runs = self.manifest()["runs"]
        for level in sorted({r["level"] for r in runs}):
            same = [r for r in runs if r["level"] == level]
            if len(same) >= self.fanout:
                return same
        return []

    def _merge(self, runs: list[dict]) -> bool:
        if not runs:
            return False
        state = self.manifest()
        merged, _ = self._write(self._rows(state, runs, None), state["buckets"], max(r["level"] for r in runs) + 1)
        old = {r["folder"] for r in runs}

        def swap(s: dict) -> bool:
            if not old <= {r["folder"] for r in s["runs"]}:
                return False  # another writer has merged some of them
            s["runs"] = [r for r in s["runs"] if r["folder"] not in old] + [merged]
            s["retired"] += [{"folder": folder, "at": time.time()} for folder in sorted(old)]
            return True

        if not self._commit(swap):
            self.files.remove(merged["folder"])
        return True

    def compact(self) -> None:
        """Merge all runs into one; readers and writers go on."""
        runs = self.manifest()["runs"]
        if len(runs) > 1:
            self._merge(runs)

    # reading --------------------------------------------------------------

    def _rows(self, state: dict, runs: list[dict], wanted: set[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{r['folder']}/{BUCKET}={b}" for r in runs for b in r["buckets"] if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """What the table keeps now, of all keys or of the ``wanted`` ones (a table with the key columns).

        For wanted keys only the files of their buckets are read.
        """
        state = self.manifest()
        if state["schema"] is None:
            raise ValueError(f"nothing is stored below {self.path}")
        if wanted is None:
            return self.keep(self._rows(state, state["runs"], None)).drop(SEQUENCE)
        # At most one row per bucket.
        touched = {r[0] for r in wanted.select(self._bucket(state["buckets"])).distinct().collect()}
        rows = self._rows(state, state["runs"], touched)
        names = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in self.keys])
        same = fold(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in self.keys])
        return self.keep(rows.join(names, same, "left_semi")).drop(SEQUENCE)

