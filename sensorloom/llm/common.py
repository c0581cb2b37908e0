"""Shared pieces of the training-data operators: scratch storage, word hashing, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: White space that separates words in every contract here: space and \t \n \v \f \r.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"

#: A broadcast side may hold this many bytes at most; beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20

#: Keys with more than this share of all rows (one in HOT_KEYS) are joined where they are, while their side holds HOT_BYTES at most.
HOT_KEYS, HOT_BYTES = 256, 24 << 20

#: Bytes of text that Python handles at once.
SLICE_BYTES = 4 << 20

_own_base: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder serves, but only in local mode.
    """
    global _own_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_base = _own_base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path made by this package."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


class Scratch:
    """Materialized tables of one computation; ``drop`` removes them once its result is written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = []


def _held(kind: T.DataType, column: Column) -> Column:
    """Bytes that a value holds, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.aggregate(column, F.lit(8).cast("long"), lambda total, x: total + _held(kind.elementType, x)), F.lit(8))
        return F.greatest(F.size(column), F.lit(0)) * 16 + 8
    return F.lit(8)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a materialized table for broadcast if it holds ``limit`` bytes (BROADCAST_BYTES) at most; else Spark shuffles it."""
    limit = BROADCAST_BYTES if limit is None else limit
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        total = total + _held(f.dataType, F.col(quoted(f.name)))
    return F.broadcast(df) if (df.agg(F.sum(total)).first()[0] or 0) <= limit else df


def keyed_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, a table with one row per value of ``key``, whatever the skew of ``rows``.

    A small ``one`` is broadcast. Else keys with more than a share of 1 / HOT_KEYS of all rows are HOT_KEYS at most:
    if their side is small it is broadcast, so that their rows stay where they are; all other keys are shuffled.
    Null keys find nothing; many of them stay where they are, too. Both tables are read more than once, so they should be written ones.
    """
    marked = small_side(one)
    if marked is not one:
        return rows.join(marked, key, how)
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_KEYS > total)
    hot = [r[0] for r in counts.select(key).collect()]  # HOT_KEYS at most
    if not hot:
        return rows.join(one, key, how)
    named = F.col(key).isin([x for x in hot if x is not None])
    stays = F.coalesce(named | F.col(key).isNull() if None in hot else named, F.lit(False))
    return rows.filter(~stays).join(one, key, how).unionByName(rows.filter(stays).join(small_side(one.filter(named), HOT_BYTES), key, how))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` beside all columns of ``docs`` as one struct ``row``: no name can clash, ``unboxed`` gives them back."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    return docs.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(rows: DataFrame, columns: list[str], *more: Column, **changed: Column) -> DataFrame:
    """The columns of a boxed table, with those of ``changed`` in place of their own."""
    own = {c.lower(): v for c, v in changed.items()}
    return rows.select(*[own.get(c.lower(), F.col("row")[c]).alias(c) for c in columns], *more)


def fresh_names(taken: list[str], names: tuple[str, ...]) -> dict[str, str]:
    """A name for each of ``names`` that no column of ``taken`` has in any case, lengthened by underscores."""
    held, out = {c.lower() for c in taken}, {}
    for name in names:
        own = name
        while own.lower() in held:
            own = f"{own}_"
        held.add(own.lower())
        out[name] = own
    return out


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose ``column`` holds about ``limit`` bytes, so that what Python makes of one stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(sizes) // limit
        borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, z in zip(borders, borders[1:]):
            if z > a:
                yield batch.slice(a, z - a)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of a start and a size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values over all bits (unsigned, wraps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words per text, all words in a row) by the separators above; a null text has none."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = cut.values
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(real))[cut.offsets.to_numpy()]
    return np.diff(before), words if real.all() else words.filter(pa.array(real))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, distinct words by number)."""
    table = words.dictionary_encode()
    return table.indices.to_numpy().astype(np.int64), table.dictionary


def hash_distinct(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def hash_words(words: pa.Array) -> np.ndarray:
    """The same, with each distinct word hashed once."""
    number, distinct = coded(words)
    return hash_distinct(distinct)[number]


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each ``k`` consecutive entries of ``h``; as many as ``len(h) - k + 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    b = np.uint64(base | 1)
    for i in range(1, k):
        out *= b
        out += h[i : i + n]
    return mix64(out)


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with each byte replaced by its entry in ``table`` (which leaves bytes over 127 as they are); null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(table[data])])
