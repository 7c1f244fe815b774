"""A table of the latest row of each key, kept as a log: batches are written as they come and merged when they are read.

    delta/batch=N/__bucket=B   the rows of batch N, the last of each key
    commits/batch=N            how many; a batch counts only once this is there
    base/version=V/__bucket=B  what compaction made of bucket B
    bases/version=V            a row for each bucket: its folder, and the last batch merged into it

A batch costs what it holds, however large the table is. A batch that is replayed overwrites its own folder, so it counts once.
compact() rewrites only buckets that batches since the last version touch, and its version counts once its list is there; readers
never see half of it. Folders that no version names are deleted by vacuum() alone.

Cases: of equal times the row with the greatest hash of its columns counts; a null key is a key; a batch without rows leaves no
trace; columns that come later are null before, and those that stop are null after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyagree.operators.cells import keep_latest
from polyagree.sources.files import exists

BUCKET = "__bucket"


class LatestStore:
    """The store at `path`: rows by `key`, the latest by `order`, in `buckets` parts by the key's hash."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _latest(self, rows: DataFrame) -> DataFrame:
        return keep_latest(rows, self.key, F.col(self.order), F.xxhash64(*sorted(rows.columns)))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _list(self, name: str, schema: str) -> list:
        """Rows of small tables of what is committed."""
        return self.spark.read.schema(schema).json(f"{self.path}/{name}").collect() if exists(self.spark, f"{self.path}/{name}") else []

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch under its number; the same number again takes its place."""
        self._bucketed(self._latest(rows)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/batch={batch}")
        touched = self._touched([batch])
        row = self.spark.createDataFrame([(batch, touched)], "number long, touched array<int>")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/batch={batch}")

    def _touched(self, batches: list[int]) -> list[int]:
        """Buckets that have files of a batch, from the folders' names."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path
        out: set[int] = set()
        for b in batches:
            folder = where(f"{self.path}/delta/batch={b}/{BUCKET}=*")
            found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
            out |= {int(x.getPath().getName().split("=")[1]) for x in found or ()}
        return sorted(out)

    def _state(self) -> tuple[dict[int, tuple[str, int]], list]:
        """Folder and last batch of each bucket of the last version, and the batches that came since, if they have rows."""
        rows = self._list("bases", "version long, bucket int, folder string, upto long")
        last = max((r.version for r in rows), default=-1)
        base = {r.bucket: (r.folder, r.upto) for r in rows if r.version == last}
        return base, sorted((r for r in self._list("commits", "number long, touched array<int>") if r.number > last and r.touched), key=lambda r: r.number)

    def _read(self, base: list[str], batches: list, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of folders of buckets, those of `batches` among them."""
        folders = base + [f"delta/batch={r.number}/{BUCKET}={b}" for r in batches for b in r.touched if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def read(self) -> DataFrame | None:
        """The latest row of each key; None before the first batch."""
        base, batches = self._state()
        rows = self._read([f for f, _ in base.values()], batches)
        return None if rows is None else self._latest(rows)

    def compact(self) -> int | None:
        """Merge the batches since the last version into the buckets they touch; the number of buckets rewritten, None without a batch."""
        base, batches = self._state()
        if not batches:
            return None
        version, buckets = batches[-1].number, sorted({b for r in batches for b in r.touched})
        rows = self._latest(self._read([base[b][0] for b in buckets if b in base], batches, buckets))
        self._bucketed(rows).repartition(min(self.buckets, len(buckets)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base/version={version}")
        made = base | {b: (f"base/version={version}/{BUCKET}={b}", version) for b in buckets}
        listed = self.spark.createDataFrame([(version, b, folder, upto) for b, (folder, upto) in made.items()], "version long, bucket int, folder string, upto long")
        listed.coalesce(1).write.mode("overwrite").json(f"{self.path}/bases/version={version}")
        return len(buckets)

    def vacuum(self) -> int:
        """Delete batches that the last version holds and folders that it does not name; call it when no reader has an older version open."""
        rows = self._list("bases", "version long, bucket int, folder string, upto long")
        last = max((r.version for r in rows), default=-1)
        named = {r.folder for r in rows if r.version == last}
        old = [f"delta/batch={r.number}" for r in self._list("commits", "number long, touched array<int>") if r.number <= last]
        old += [f"commits/{f.split('/')[1]}" for f in old]
        old += [r.folder for r in rows if r.folder not in named] + [f"bases/version={v}" for v in {r.version for r in rows} if v != last]
        for f in set(old):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(set(old))


def upsert_latest(stream: DataFrame, key: list[str], order: str, target: str, checkpoint: str, compact_every: int = 16, buckets: int = 64):
    """Keep the latest row of each key of a stream in the store at `target`; every so many batches are compacted."""

    def merge(batch: DataFrame, number: int) -> None:
        store = LatestStore(batch.sparkSession, target, key, order, buckets)
        store.append(batch, number)
        if number % compact_every == compact_every - 1:
            store.compact()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(wanted: DataFrame, store: LatestStore) -> DataFrame:
    """Wanted keys that the store does not have yet: where a run that was stopped goes on."""
    done = store.read()
    if done is None:
        return wanted
    done = done.select(*(F.col(k).alias(f"__{k}") for k in store.key)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in store.key]
    return wanted.join(done, same, "left_anti")
