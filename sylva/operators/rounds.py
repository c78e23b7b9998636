"""What operators that go in rounds share: tables that cut lineage, and sums over a whole order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; without one only a single machine gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="sylva-")
        context.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later rounds neither repeat it nor lose it with an executor."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, but as Parquet, which takes far less room for ids and paths. Files stay until the folder goes."""
    _folder(df.sparkSession)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def running(df: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """df in ranges of ``order``, with the inclusive running sum of each of ``sums`` over the whole of it.

    Ranges are sorted apart and summed inside; each starts from the totals of those before it. One row a range meets in
    one place.
    """
    here = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumns({f"_x_{k}": v for k, v in sums.items()}))
    totals = here.groupBy("_part").agg(*[F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = here.withColumns({f"_i_{k}": F.sum(f"_x_{k}").over(inside) for k in sums}).join(starts, "_part")
    return out.select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums])


#: Rows that are handed back at once.
ROWS_AT_ONCE = 10_000


class _Held(list):
    """Rows of a group, for a function of all of them."""

    add = list.append

    def __init__(self, fn: Callable[[list[tuple]], list[tuple]]):
        self.fn = fn

    def end(self) -> list[tuple]:
        return self.fn(self)


def grouped(df: DataFrame, group: list[str], order: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``fn`` on the rows of each group, without the group's columns and in order; what it returns, after the group's
    columns, has ``schema``. Many small groups share a batch, so a group costs its rows and no call into a worker."""
    return streamed(df, group, order, lambda: _Held(fn), schema)


def streamed(df: DataFrame, group: list[str], order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """As ``grouped``, but each row is handed to ``add`` of what ``make`` gives for its group, which need not keep it; ``end``
    returns the group's rows."""
    rest = [c for c in df.columns if c not in group]
    rows = df.select(*group, *rest).repartition(*group).sortWithinPartitions(*group, *order)
    kinds = [f"{g} {df.schema[g].dataType.simpleString()}" for g in group]
    out_schema = df.sparkSession.createDataFrame([], ", ".join([*kinds, schema])).schema
    arrow, n = to_arrow_schema(out_schema), len(group)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held is None or row[:n] != now:
                    if held is not None:
                        out += [(*now, *x) for x in held.end()]
                        if len(out) >= ROWS_AT_ONCE:
                            yield packed(out)
                            out = []
                    now, held = row[:n], make()
                held.add(row[n:])
        if held is not None:
            out += [(*now, *x) for x in held.end()]
        if out:
            yield packed(out)

    return rows.mapInArrow(run, out_schema)
