"""How alike the texts of a group are phrased: mean cosine over all pairs of TF-IDF vectors, without making a pair."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyagree.functions import text as X

#: Characters of a block of texts that a task works out at once. A group with more is dealt over parts of about as many.
LIMIT = 1 << 19


def _grams(texts, least: int = 3, most: int = 5):
    """Runs of `least` to `most` characters of words with a space at either end: (row, gram, times) for each run of a row, gram numbers from 0, and (place, size) of each gram in the last value, all texts in one."""
    import numpy as np

    lengths = np.array([len(x) for x in texts], np.int64)
    c = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.r_[0, np.repeat(np.arange(len(texts)), lengths + 1)]
    space = (c == 32) | (c >= 9) & (c <= 13)
    c[space] = 32
    keep = ~(space & np.r_[False, space[:-1]])
    c, row, space = c[keep], row[keep], space[keep]
    letters, code = np.unique(c, return_inverse=True)
    base, key, bound = len(letters), code, len(letters)
    inside, rows, numbers, places, sizes, seen = np.ones(len(c), bool), [], [], [], [], 0
    for n in range(2, most + 1):
        if n > len(c):
            break
        key, inside = key[:-1], inside[:-1]
        if bound > (1 << 62) // base:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key, bound = key * base + code[n - 1 :], bound * base
        if n > 2:
            inside = inside & ~space[n - 2 : len(c) - 1]  # no space but at the ends
        if n < least:
            continue
        at = np.flatnonzero(inside)
        distinct, first, number = np.unique(key[at], return_index=True, return_inverse=True)
        rows.append(row[at + 1])
        numbers.append(number + seen)
        places.append(at[first])
        sizes.append(np.full(len(distinct), n))
        seen += len(distinct)
    none = [np.zeros(0, np.int64)]
    pairs, times = np.unique(np.concatenate(rows or none) * max(1, seen) + np.concatenate(numbers or none), return_counts=True)
    return pairs // max(1, seen), pairs % max(1, seen), times, (np.concatenate(places or none), np.concatenate(sizes or none), c.astype("<u4").tobytes().decode("utf-32-le"))


def _unit(row, times, idf, rows: int):
    """Weights of grams of rows, whose vectors have length 1."""
    import numpy as np

    w = times * idf
    return w / np.sqrt(np.bincount(row, w * w, rows))[row]


def _blocks(batches, limit: int) -> Iterator:
    """Tables of whole groups, about `limit` characters each, of batches sorted by their first column; the second is the text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, batch]).combine_chunks() if rest is not None else batch
        code = rest.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        block = np.cumsum(np.add.reduceat(pc.utf8_length(rest.column(1)).to_numpy().astype(np.int64), starts)) // limit
        cuts = starts[np.flatnonzero(block[1:] != block[:-1]) + 1]
        for a, b in zip(np.r_[0, cuts], cuts):
            yield rest.slice(a, b - a)
        if len(cuts):
            rest = rest.slice(cuts[-1])
    if rest is not None:
        yield rest


def _whole(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, n, q) of groups that fit into a block."""

    def of(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches, limit):
            groups = block.column(0).combine_chunks().dictionary_encode()
            mine, size = groups.indices.to_numpy().astype(np.int64), len(groups.dictionary)
            n = np.bincount(mine, minlength=size)
            row, gram, times, (places, _, _) = _grams(block.column(1).to_pylist())
            cells, cell, df = np.unique(mine[row] * max(1, len(places)) + gram, return_inverse=True, return_counts=True)
            idf = np.log((n[mine[row]] + 1) / (df[cell] + 1)) + 1
            s = np.bincount(cell, _unit(row, times, idf, block.num_rows), len(cells))
            q = np.bincount(cells // max(1, len(places)), s * s, size)
            yield pa.RecordBatch.from_arrays([groups.dictionary, pa.array(n.astype(np.int64)), pa.array(q)], [group, "n", "q"])

    schema = T.StructType([rows.schema[group], T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType())])
    return rows.repartition(group).dropDuplicates().sortWithinPartitions(group).select(group, "__text").mapInArrow(of, schema)


def _parted(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, q) of groups dealt over `__part`: parts count their n-grams, learn what all parts have counted, and send one row for each n-gram. The empty n-gram stands for the rows."""

    def counted(key, texts):
        import numpy as np
        import pyarrow as pa

        _, gram, _, (places, sizes, whole) = _grams(texts.column("__text").to_pylist())
        names = ["", *(whole[i : i + n] for i, n in zip(places.tolist(), sizes.tolist()))]
        df = np.r_[texts.num_rows, np.bincount(gram, minlength=len(places))].astype(np.int64)
        return pa.table({group: pa.repeat(key[0], len(names)), "__part": pa.repeat(key[1], len(names)), "gram": pa.array(names, pa.string()), "df": df})

    def summed(key, texts, counts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        row, gram, times, (places, sizes, whole) = _grams(texts.column("__text").to_pylist())
        names = pa.array(["", *(whole[i : i + n] for i, n in zip(places.tolist(), sizes.tolist()))], pa.string())
        df = counts.column("df").to_numpy()[pc.index_in(names, value_set=counts.column("gram").combine_chunks()).to_numpy()]
        idf = np.log((df[0] + 1) / (df[1:] + 1)) + 1
        s = np.bincount(gram, _unit(row, times, idf[gram], texts.num_rows), len(places))
        return pa.table({group: pa.repeat(key[0], len(s)), "gram": names[1:], "s": s, "n": pa.repeat(pa.scalar(int(df[0]), pa.int64()), len(s))})

    own = rows.schema[group]
    long, string, double = T.LongType(), T.StringType(), T.DoubleType()
    of = lambda **columns: T.StructType([own, *(T.StructField(k, v) for k, v in columns.items())])
    rows = rows.repartition(group, "__part").dropDuplicates().select(group, "__part", "__text")
    df = rows.groupBy(group, "__part").applyInArrow(counted, of(__part=long, gram=string, df=long))
    df = df.withColumn("df", F.sum("df").over(Window.partitionBy(group, "gram")))
    sums = rows.groupBy(group, "__part").cogroup(df.groupBy(group, "__part")).applyInArrow(summed, of(gram=string, s=double, n=long))
    s = sums.groupBy(group, "gram").agg(F.sum("s").alias("s"), F.max("n").alias("n"))
    return s.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))


def mean_similarity(texts: DataFrame, group: str, row: list[str], text: str) -> DataFrame:
    """(group, n, similarity) of each group with a text; similarity is null for fewer than two.

    Weights are counts times ln((n + 1) / (df + 1)) + 1 within the group, vectors have length 1. Over such vectors the cosines of
    all pairs sum to half of the squared length of their sum less n, so a group costs its n-grams, not its pairs. Rows of a group
    are told apart by `row`. Texts are shuffled once, and their n-grams stay in the task; only groups of more than LIMIT characters, which the driver
    lists, are dealt over parts that exchange a row for each n-gram of a part.
    """
    kept = texts.where(X.present(F.col(text)) & F.col(group).isNotNull()).select(group, *(F.col(c).alias(f"__row{i}") for i, c in enumerate(row)), F.lower(text).alias("__text"))
    size = F.sum(F.char_length("__text"))
    large = {r[0]: -(-r[1] // LIMIT) for r in kept.groupBy(group).agg(size.alias("size")).where(F.col("size") > LIMIT).collect()}
    if large:
        parts = F.create_map(*(F.lit(x) for kv in large.items() for x in kv))[F.col(group)]
        kept = kept.withColumn("__parts", parts)
        split = kept.where("__parts is not null").withColumn("__part", F.pmod(F.xxhash64(*(c for c in kept.columns if c.startswith("__row")), "__text"), F.col("__parts").cast("long"))).drop("__parts")
        squared = _whole(kept.where("__parts is null").drop("__parts"), group, LIMIT).unionByName(_parted(split, group))
    else:
        squared = _whole(kept, group, LIMIT)
    n = F.col("n")
    return squared.select(group, "n", F.when(n > 1, F.round((F.col("q") - n) / (n * (n - 1)), 4)).alias("similarity"))
