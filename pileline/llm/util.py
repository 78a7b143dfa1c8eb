"""Small helpers that the operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is space and the bytes 9 to 13; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def text_of(name: str) -> Column:
    """The column as text; null counts as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for an empty or blank text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def pieces(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """The values of a column of texts or bytes in runs of about ``most`` bytes, each with its place, so that memory follows
    the run (or one long value) and not the batch."""
    start, size, sizes = 0, 0, pc.binary_length(column).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if sizes:
        yield start, column.slice(start).to_pylist()


def each(column: pa.Array) -> Iterator:
    """The values of a column of texts or bytes, one by one."""
    for _, some in pieces(column):
        yield from some


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where that is unset, as in tests, one under /tmp, but only for a
    master on this machine: on a cluster executors would each write to a folder of their own."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return told or f"file:///tmp/checkpoints/pileline-{os.getuid()}"


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: lineage ends there and lost executors cost nothing that was done before."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _filed(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows from a new Parquet table in the shared folder, and its path. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder; unlike a checkpoint it is columnar and has a known size."""
    return _filed(df)[0]


class Shelf:
    """Staged tables of one run of an operator, which go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        table, path = _filed(df)
        self.held.append((table, path))
        return table

    def keep(self, df: DataFrame) -> DataFrame:
        """A staged table that is not of the shelf."""
        return staged(df)

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            _files(self.spark, path).delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
            self.held = [x for x in self.held if x[0] is not table]

    def clear(self) -> None:
        self.drop(*[t for t, _ in self.held])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of MD5; the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))
