"""Pieces that several operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_of(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where Spark runs in this process (tests)."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or _local_folder())
    return folder or context.getCheckpointDir()


def _local_folder() -> str:
    """A folder on this machine that goes when the process ends."""
    path = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: computed once, and safe against the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or a variant that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt over as many tasks as shuffles have, for what makes many rows or much work of few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


#: Rows up to which a table of a few numbers a row is sent to every executor (some megabytes).
FEW = 100_000


def sent_if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A table of a few numbers a row, marked for broadcast if it has at most ``most`` rows; larger ones are joined by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted_join(rows: DataFrame, table: DataFrame, key: Sequence[str], rows_of_key: str, by: str, crowd: int = 1000, salts: int = 64, how: str = "inner") -> DataFrame:
    """Inner or left join on ``key``; rows of keys that have ``crowd`` or more of them are spread over salts.

    table: one row a key, written already, with the number of the key's rows in the column ``rows_of_key``. by: a column of ``rows`` that tells rows of a key apart.
    """
    heavy, light = table.filter(F.col(rows_of_key) >= crowd), table.filter(F.col(rows_of_key) < crowd)
    if heavy.isEmpty():
        return rows.join(table, [*key], how).select(*rows.columns, *[c for c in table.columns if c not in key])
    new = [c for c in table.columns if c not in key]
    salt, part = free_name(rows, "salt"), free_name(rows, "part")
    parts = heavy.withColumn(salt, F.explode(F.array(*map(F.lit, range(salts))))).withColumn(part, F.lit(True))
    first = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(parts.select(*key, salt, part, *[F.col(c).alias(f"heavy_{c}") for c in new]), [*key, salt], "left")
    one = F.when(F.col(part), F.col(salt)).otherwise(-1)  # rows that are placed go on under their salt, without a partner
    second = first.withColumn(salt, one).join(light.withColumn(salt, F.lit(-1)), [*key, salt], "left")
    whole = second.filter(F.col(part) | F.col(rows_of_key).isNotNull()) if how == "inner" else second
    return whole.select(*rows.columns, *[F.coalesce(c, f"heavy_{c}").alias(c) for c in new])


def small_batches(rows: int = 1000) -> None:
    """Has Spark hand Python ``rows`` rows at a time where the session has its default of 10,000: texts can be long, and batches are held in memory on both sides."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def by_slices(kind: str, arrow: pa.DataType, make: Callable[[], Callable[..., list]], *columns: Column, step: int = 500) -> Column:
    """A column of type ``kind`` that Python makes, ``step`` rows at a time to keep little in memory.

    make: called once for each task, gives the function from lists of the columns' values to the list of results.
    """

    small_batches()

    def results(f: Callable[..., list], arrays: tuple[pa.Array, ...]) -> pa.Array:
        parts = [pa.array(f(*[a.slice(at, step).to_pylist() for a in arrays]), arrow) for at in range(0, len(arrays[0]), step)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    if len(columns) == 1:

        @F.arrow_udf(kind)
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = make()
            for a in batches:
                yield results(f, (a,))

        return one(*columns)

    @F.arrow_udf(kind)
    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for arrays in batches:
            yield results(f, arrays)

    return several(*columns)


def running_starts(lengths: Column, step: int = 256) -> Column:
    """Exclusive running sums of an array of lengths, as array<bigint>.

    Sums run over ``step`` values at a time and then over the sums, so that arrays of any length stay
    near linear although appending copies an array.
    """
    empty = F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(step)), lambda k: F.slice(lengths, k + 1, step))
    local = F.transform(
        chunks,
        lambda chunk: F.aggregate(
            chunk,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("starts")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        ),
    )
    whole = F.aggregate(
        local,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("parts")),
        lambda acc, part: F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["parts"], F.transform(part["starts"], lambda s: s + acc["at"])).alias("parts")),
    )
    return F.flatten(whole["parts"])
