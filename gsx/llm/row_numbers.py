"""Rows of a table by number, and bitmaps of those that go.

A stage that drops rows decides on small tables of row numbers.  The numbers that go become bitmaps
of BITS rows each, and a scan of the table leaves out their rows in place: texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gsx.llm.texts import unused_name
from gsx.session import settle

#: Rows of one bitmap; the built-in aggregate fixes it.
BITS = 32768
#: Bytes of bitmaps that are broadcast, an eighth of a byte per row; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _place(number: Column) -> Column:
    return F.pmod(number, F.lit(BITS))


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1


def _files(docs: DataFrame) -> DataFrame | None:
    """(file, rows) if ``docs`` is each row of its Parquet files once, else None."""
    try:
        places = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except Exception as error:
        if getattr(error, "getCondition", lambda: None)() is None:
            raise
        return None
    per = (
        places.groupBy("file", F.floor(F.col("at") / BITS).alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bitmap_count(F.bitmap_construct_agg(_place(F.col("at")))).alias("bits"),
            F.max("at").alias("last"),
        )
        .groupBy("file")
        .agg(F.sum("n").alias("rows"), F.sum("bits").alias("bits"), F.max("last").alias("last"))
    )
    per = settle(per)
    odd = per.filter(~(F.col("rows").eqNullSafe(F.col("bits")) & F.col("rows").eqNullSafe(F.col("last") + 1)))
    return None if odd.limit(1).count() else per.select("file", "rows")


class NumberedRows:
    """``rows``: a table with a column ``name`` that numbers its rows from 0 by file and place.

    The numbers are the same in every scan.  Anything but whole Parquet files (a filter, a join, rows
    of the driver, a column called _metadata) is written to the shared folder first.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.name = unused_name("number", self.columns)
        hidden = "_metadata" in {c.lower() for c in self.columns}
        files = None if hidden else _files(docs)
        if files is None:
            docs = settle(docs.toDF(*[f"c{k}" for k in range(len(self.columns))]))
            files = _files(docs)
        inner = [f"c{k}" for k in range(len(self.columns))]
        # one row per file meets in the window
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        offsets = settle(files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")))
        placed = docs.select(
            *[F.col(_quoted(c)).alias(k) for c, k in zip(docs.columns, inner)],
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("at"),
        )
        self.rows = placed.join(F.broadcast(offsets), "file").select(
            *[F.col(k).alias(c) for k, c in zip(inner, self.columns)], (F.col("offset") + F.col("at")).alias(self.name)
        )

    def without(self, gone: DataFrame) -> DataFrame:
        """The table without the rows of the numbers in ``gone``, a frame of one column."""
        part, bitmap = unused_name("part", self.rows.columns), unused_name("bitmap", self.rows.columns)
        number = F.col(gone.columns[0])
        bitmaps = settle(
            gone.groupBy(F.floor(number / BITS).alias(part)).agg(F.bitmap_construct_agg(_place(number)).alias(bitmap))
        )
        small = bitmaps.count() * (BITS // 8) <= BROADCAST_BYTES
        joined = self.rows.withColumn(part, F.floor(F.col(self.name) / BITS)).join(
            F.broadcast(bitmaps) if small else bitmaps.hint("merge"), part, "left"
        )
        goes = F.coalesce(_is_set(F.col(bitmap), _place(F.col(self.name))), F.lit(False))
        return joined.filter(~goes).select(*[F.col(_quoted(c)) for c in self.columns])


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
