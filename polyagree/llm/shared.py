"""What several operators of this subpackage need: the shared folder, staged tables, and words as numpy spans."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters that part words.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java pattern of a run of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches by bytes as texts may be very long."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # memory of large arrays goes back when they do
    env.setdefault("MALLOC_ARENA_MAX", "1")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(32 << 20))
    for key, value in (("maxRecordsPerBatch", "4000"), ("maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) in (None, "10000", "67108864b"):  # the defaults; a session's own setting stays
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="polyagree-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd", group: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts the lineage and survives lost executors. `group`: bytes of a row group that a writer holds."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    (df.write.option("compression", codec) if group is None else df.write.option("compression", codec).option("parquet.block.size", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hash_sample(rows: DataFrame, most: int, seed: int, key: str = "doc_id") -> DataFrame:
    """About `most` rows, those with the least hashes of `key`, and over twice as many only by repeats of one key; all rows if they are as few.

    A threshold on the hash needs no sort, and sends no more rows the more tasks there are. Should more than twice `most` be under
    it (keys that repeat), the threshold falls to where about `most` are, by a count of the hashes in 4096 bins below it.
    """
    n = rows.count()
    if n <= most:
        return rows
    hashed = F.xxhash64(F.lit(seed), key)
    least, share = -(1 << 63), int((most / n - 0.5) * 2 * (1 << 63)) - 1
    found = rows.where(hashed <= F.lit(share).cast("long"))
    if found.count() <= 2 * most:
        return found
    width = max(1, (share - least) // 4096)
    bins = found.groupBy(F.floor((hashed.cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")) / width).cast("long").alias("bin")).count().orderBy("bin").collect()  # 4098 rows at most
    kept, upto = 0, bins[0].bin
    for b in bins:
        if kept and kept + b["count"] > 2 * most:
            break
        kept, upto = kept + b["count"], b.bin
    return rows.where(hashed <= F.lit(min(share, least + width * (upto + 1) - 1)).cast("long"))


def crc_of_id(col) -> F.Column:
    """crc32 of an integer id written as decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


def text_bytes(col="text") -> F.Column:
    """UTF-8 of the text; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def buffer_of(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow binary or string array without nulls, without copying."""
    import pyarrow as pa

    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the number of words of each row. Rows part words as spaces do."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a row begins here
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return starts, ends, counts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE_KEY = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a polynomial over random byte keys, then mixed. Equal bytes, equal hashes.

    Two of a billion different words share a hash with a chance of about 3 in 100.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    base = np.uint64(_BASE)
    live, k = np.arange(len(starts)), 0
    longest = int(lengths.max())
    while len(live) > 256 and k < longest:
        out[live] = out[live] * base + _BYTE_KEY[raw[starts[live] + k]]
        k += 1
        live = live[lengths[live] > k]
    for i in live if k < longest else ():  # a few very long words
        tail = _BYTE_KEY[raw[starts[i] + k : ends[i]]]
        powers = _powers(len(tail))
        with np.errstate(over="ignore"):  # modulo 2^64
            out[i] = out[i] * (powers[0] * base) + (tail * powers).sum(dtype=np.uint64)
    return _mixed(out ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _powers(n: int) -> np.ndarray:
    """base^(n-1) ... base^0, modulo 2^64."""
    up = np.full(n, np.uint64(_BASE))
    up[0] = 1
    return np.cumprod(up, dtype=np.uint64)[::-1]


def row_blocks(offsets: np.ndarray, most: int):
    """Runs of rows of about `most` bytes: (first row, row after the last)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
