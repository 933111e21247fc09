"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: `data/` holds shard files, each written once; `manifest/` tables of changes (files
added and removed) and, at every `CHECKPOINT` versions, of all files; `commits/<version>` is the commit: a
small JSON file that names the version's change table, the latest whole table and the rows' schema.

A commit is written under another name, closed, and then given its name without overwriting: by a hard
link on a local file system, else by a rename that fails where the name is taken. So a version
is there whole or not at all; of two writers of one version one wins, and the other starts over from
the newer version. A failed run leaves unlisted files, which no reader sees. A commit file that can't
be read, which no writer of this kind leaves, is no version.

Arrivals are appended as small shards. The tier of a file is the power of `FANOUT` that its size has
over the smallest shard; `FANOUT` or more files of one tier below the target are one run, and merged
into files of the target size. Merging reads whole files into as many tasks as files come out, without
a shuffle, `RUN_FILES` files at most at a time. It goes on until no tier has a run. Superseded files stay for
readers of older versions until `vacuum`.

Manifests are tables: a commit writes its changes alone, and files of a version are the whole table
plus the changes since. The driver holds the files of one arrival or of one run, and, where a version is
read, the paths that the reader lists in any case.

Edge cases: an empty arrival commits a version with the same files (its schema is kept from the first
append); rows, nulls, repeated rows and extra columns are stored as they are; all appends have the
columns of the first; a store without commits has version 0 and can't be read; a null `arrival` is one too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corvane.llm.common import fresh

TARGET_BYTES, SMALLEST_BYTES, FANOUT, ARRIVAL_ROWS = 128 << 20, 1 << 20, 4, 2000
#: versions from one whole manifest to the next, and files of a merge
CHECKPOINT, RUN_FILES = 10, 1000

FILES = "path string, bytes bigint, tier int"


class Store:
    """A compacted table at `root`, a folder that all machines reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, smallest_bytes: int = SMALLEST_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target_bytes, smallest_bytes, fanout
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(self.root).getFileSystem(self.conf)
        self.linked = self.fs.getUri().getScheme() == "file"

    def _path(self, *names: str):
        return self.hadoop.Path("/".join([self.root, *names]))

    # ---- commits -----------------------------------------------------------------------------------

    def _commit_file(self, version: int):
        return self._path("commits", f"{version:012d}")

    def _read_commit(self, version: int) -> dict | None:
        """The commit of `version`; None if it is not there, or not a whole one."""
        path = self._commit_file(version)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()
        return found if isinstance(found, dict) and "changes" in found else None

    def _versions(self) -> list[int]:
        """The numbers of commit files, largest first."""
        if not self.fs.exists(self._path("commits")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("commits"))]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        return next((n for n in self._versions() if self._read_commit(n)), 0)

    def _publish(self, version: int, text: str) -> bool:
        """Make the commit file with this text; False if the version is taken."""
        path, draft = self._commit_file(version), self._path("commits", f".{version:012d}-{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        out.write(text.encode())
        out.close()
        try:
            if self.linked:
                plain = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(plain(path), plain(draft))
            else:
                options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, path, options)
        except Exception as e:  # the JVM says that the file exists
            if "AlreadyExists" not in str(e):
                raise
            return False
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)
        return True

    def _commit(self, added: list[tuple[str, int, int]], removed: list[tuple[str, int, int]], base: int, version: int, schema: str | None = None) -> bool:
        """Make `version` of `base` with these changes; False if another writer has made that version."""
        before = self._read_commit(base) or {"whole": None, "since": [], "schema": schema}
        name = f"{version:012d}-{uuid.uuid4().hex}"
        rows = [(*f, 1) for f in added] + [(*f, -1) for f in removed]
        self.spark.createDataFrame(rows, f"{FILES}, change int").coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        found = {"changes": name, "whole": before["whole"], "since": [*before["since"], name], "schema": before["schema"] or schema}
        if len(found["since"]) >= CHECKPOINT:
            self._fold(found).withColumn("change", F.lit(1)).write.parquet(f"{self.root}/manifest/{name}-whole")
            found |= {"whole": f"{name}-whole", "since": []}
        return self._publish(version, json.dumps(found))

    # ---- files -------------------------------------------------------------------------------------

    def _fold(self, commit: dict) -> DataFrame:
        tables = [f"{self.root}/manifest/{n}" for n in [commit["whole"], *commit["since"]] if n]
        rows = self.spark.read.schema(f"{FILES}, change int").parquet(*tables)
        return rows.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("tier").alias("tier"), F.sum("change").alias("held")).where("held > 0").drop("held")

    def files(self, version: int | None = None) -> DataFrame:
        """(path, bytes, tier) of the files of a version, the latest by default."""
        commit = self._read_commit(self.version() if version is None else version)
        return self._fold(commit) if commit else self.spark.createDataFrame([], FILES)

    def tier(self, size: int) -> int:
        tier, top = 0, self.smallest
        while size > top and top < self.target:
            tier, top = tier + 1, top * self.fanout
        return tier

    def _listed(self, where: str) -> list[tuple[str, int, int]]:
        """The shards that a write left in a folder."""
        found = [(f"{where}/{f.getPath().getName()}", f.getLen()) for f in self.fs.listStatus(self._path(where)) if f.getPath().getName().startswith("part-")]
        return [(p, n, self.tier(n)) for p, n in sorted(found)]

    # ---- arrivals ----------------------------------------------------------------------------------

    def _next(self) -> tuple[int, int]:
        """The latest whole version, and the number of the next one: past every commit file, whole or not."""
        numbers = self._versions()
        return next((n for n in numbers if self._read_commit(n)), 0), max(numbers, default=0) + 1

    def _add(self, made: list[tuple[str, int, int]], schema: T.StructType) -> int:
        while True:
            now, then = self._next()
            if self._commit(made, [], now, then, schema.json()):
                return then

    def append(self, df: DataFrame, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        """Store an arrival as small shards; returns the version that has it."""
        where = f"data/{uuid.uuid4().hex}"
        df.write.options(maxRecordsPerFile=rows_per_shard).parquet(f"{self.root}/{where}")
        return self._add(self._listed(where), df.schema)

    def append_each(self, df: DataFrame, arrival: Column, rows_per_shard: int = ARRIVAL_ROWS) -> int:
        """Store several arrivals, told apart by a value of few kinds, in one job: a version each. Returns their number."""
        where = f"data/{uuid.uuid4().hex}"
        (name,) = fresh(df, "arrival")
        df.withColumn(name, arrival).write.partitionBy(name).options(maxRecordsPerFile=rows_per_shard).parquet(f"{self.root}/{where}")
        folders = sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(where)) if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))
        for folder in folders:
            self._add(self._listed(f"{where}/{folder}"), df.schema)
        if not folders:
            self._add([], df.schema)
        return len(folders)

    # ---- merges ------------------------------------------------------------------------------------

    def run(self, version: int) -> list[tuple[str, int, int]]:
        """The files of the lowest tier that has a run, RUN_FILES at most; none if no tier has one."""
        low = self.files(version).where(F.col("bytes") < self.target // 2)
        ready = [r[0] for r in low.groupBy("tier").count().where(F.col("count") >= self.fanout).collect()]  # a row a tier
        return [tuple(r) for r in low.where(F.col("tier") == min(ready)).orderBy("path").limit(RUN_FILES).collect()] if ready else []

    def compact(self) -> int:
        """Merge runs until there is none; returns the latest version. Of two writers' merges of one version one is dropped."""
        while True:
            now, then = self._next()
            run = self.run(now)
            if not run:
                return now
            total = sum(n for _, n, _ in run)
            where = f"data/{uuid.uuid4().hex}"
            self._rows([p for p, _, _ in run], now).coalesce(max(1, round(total / self.target))).write.parquet(f"{self.root}/{where}")
            self._commit(self._listed(where), run, now, then)

    def _rows(self, paths: list[str], version: int) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self._read_commit(version)["schema"]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default."""
        version = self.version() if version is None else version
        return self._rows([r["path"] for r in self.files(version).select("path").collect()], version)

    def vacuum(self) -> int:
        """Delete the data files that the latest version doesn't list; returns their number. No writer may be active."""
        listed = {r["path"] for r in self.files().select("path").collect()}
        stale = []
        found = self.fs.listFiles(self._path("data"), True)
        at = self.fs.makeQualified(self._path()).toUri().getPath().rstrip("/") + "/"
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().startswith("part-") and path.toUri().getPath().removeprefix(at) not in listed:
                stale.append(path)
        for p in stale:
            self.fs.delete(p, False)
        return len(stale)


def file_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes, text_md5) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("bytes"), F.md5(text).alias("text_md5"))
