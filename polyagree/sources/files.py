"""Readers and writers of the tables and of the formats that sources come in."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the folder in spark.checkpoint.dir, which all executors share, and read it again: cuts the lineage and survives lost executors. A temporary folder in local mode alone."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="polyagree-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", sep: str = ",", keep_bad: bool = False) -> DataFrame:
    """All columns are strings unless a schema is given; empty strings stay, and so does the key 'nan'; bad lines are dropped or kept apart."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, sep=sep, emptyValue="", nullValue="\x00", mode="PERMISSIVE" if keep_bad else "DROPMALFORMED")
    return reader.schema(schema).csv(path) if schema else reader.csv(path).na.fill("")  # an empty cell without quotes is read as null


def read_csv_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """UTF-8, or Latin-1 where the bytes of a line are not UTF-8; lines that do not fit the columns are dropped."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return read_csv(spark, path, schema, "ISO-8859-1" if broken else "UTF-8")


def columns_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names in the header of a CSV file; no row is read."""
    return spark.read.options(header=True, sep=sep, enforceSchema=False).csv(path).limit(0).columns


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def preferred(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that there is, as a reviewed file before the one it was made from."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_grid(spark: SparkSession, folder: str, pattern: str, names: list[str], columns: list[str]) -> DataFrame:
    """Rows of the CSV files of a folder whose names match, with what the pattern's groups hold as `names`; a file may lack columns, and there may be none."""
    found = [f for f in _listed(spark, folder) if re.fullmatch(pattern, f.rsplit("/", 1)[-1])]
    frames = []
    for f in sorted(found):
        rows = read_csv(spark, f)
        parts = re.fullmatch(pattern, f.rsplit("/", 1)[-1]).groups()
        frames.append(rows.select(*(F.lit(x).alias(n) for n, x in zip(names, parts)), *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)))
    return read_many(frames) if frames else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*names, *columns]))


def read_glob(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of all CSV files that a glob finds, each by the names in its own header, with the given columns; none found is an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    frames = [read_csv(spark, f) for f in sorted(x.getPath().toString() for x in found if x.isFile())]
    rows = [r.select(*(F.col(c) if c in r.columns else F.lit(None).cast("string").alias(c) for c in columns)) for r in frames]
    return read_many(rows) if rows else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def read_archive(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of the files in tar archives, packed or not, whose names end so; an archive is read by one task, member by member."""

    def members(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with tarfile.open(fileobj=io.BytesIO(data.as_buffer())) as archive:
                    for m in archive:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pa.RecordBatch.from_pydict({"archive": [name], "member": [m.name], "content": [archive.extractfile(m).read()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(members, "archive string, member string, content binary")


def _listed(spark: SparkSession, folder: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [x.getPath().toString() for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if x.isFile()]


def read_json_tree(spark: SparkSession, path: str, levels: int, at: tuple[str, ...] = ()) -> DataFrame:
    """(key1 .. key<levels>, value) rows of nested JSON objects below the path `at`; what lies deeper stays as JSON text."""
    kind: T.DataType = T.StringType()
    for _ in range(levels):
        kind = T.MapType(T.StringType(), kind)
    for name in reversed(at):
        kind = T.StructType([T.StructField(name, kind)])
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    rows = rows.select(F.col(".".join(["v", *at])).alias("v"))
    for k in range(1, levels + 1):
        rows = rows.select(*(f"key{j}" for j in range(1, k)), F.explode("v").alias(f"key{k}", "v"))
    return rows.withColumnRenamed("v", "value")


def read_variant(spark: SparkSession, folder: str, variant: str) -> DataFrame:
    """CSV files whose names hold the variant, with the file's name as a column."""
    rows = spark.read.options(header=True, pathGlobFilter=f"*{variant}*.csv").csv(folder)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def read_many(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) rows of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("key", "value"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_records(spark: SparkSession, path: str, fields: list[str], separator: str = "%%\n") -> DataFrame:
    """Text of records between separators, with lines `Field: value`."""
    names = {f: f.lower().replace("-", "_") for f in fields}
    rows = spark.read.text(path, lineSep=separator).withColumn("value", F.regexp_replace("value", "\n[ \t]+", " "))  # a line that goes on is indented
    found = rows.select(*(F.nullif(F.regexp_extract("value", f"(?m)^{f}: (.*)$", 1), F.lit("")).alias(n) for f, n in names.items()))
    return found.where(F.coalesce(*names.values()).isNotNull())


def html_items(pages: DataFrame, tag: str = "li") -> DataFrame:
    """page_id, pos and text of the elements of one kind, tags taken out."""
    found = F.regexp_extract_all("html", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "raw")).select("page_id", "pos", F.trim(F.regexp_replace("raw", "(?s)<[^>]*>", "")).alias("text"))


def preserve_failed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones of keys that new rows lack."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("mergeSchema", True)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None, quote_all: bool = True) -> None:
    writer = df.write.mode("overwrite").options(header=True, quoteAll=quote_all, escape='"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def suffixed(name: str, **off: bool) -> str:
    """A name of an output that tells which parts were switched off, so that a partial run never takes the place of a whole one."""
    return name + "".join(f"_no_{k}" for k, v in sorted(off.items()) if v)


def write_with_backup(df: DataFrame, path: str, stamp: str, dry_run: bool = False) -> str | None:
    """Overwrite a table after its last state was written beside it, named by `stamp`; returns where. A dry run writes nothing."""
    spark = df.sparkSession
    kept = f"{path}.backup-{stamp}" if exists(spark, path) else None
    if dry_run:
        return kept
    if kept:
        spark.read.parquet(path).write.mode("overwrite").parquet(kept)
    staged = f"{path}.new-{stamp}"  # the new state may be read from the old one
    df.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)
    return kept


def append_evolving(df: DataFrame, path: str) -> None:
    """Append rows; columns may be new or missing, reads merge them."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)
