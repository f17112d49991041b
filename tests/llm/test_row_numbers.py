"""Row numbers of files and other frames, and rows left out by bitmaps."""

import pytest
from llm_rows import EDGE
from pyspark.sql import functions as F

from gsx.llm import row_numbers
from gsx.llm.row_numbers import NumberedRows
from gsx.session import settle


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("bits_apart", [1, 7])
def test_rows_go_by_number(spark, monkeypatch, limit, bits_apart):
    monkeypatch.setattr(row_numbers, "BROADCAST_BYTES", limit)
    docs = settle(spark.range(100_000).repartition(3).withColumn("number", F.col("id") * 2))
    table = NumberedRows(docs)
    rows = table.rows.collect()
    assert sorted(r[table.name] for r in rows) == list(range(100_000))
    gone = {r["id"] for r in rows if r[table.name] % bits_apart == 0}
    left = table.without(table.rows.filter(F.col(table.name) % bits_apart == 0).select(table.name))
    assert left.columns == docs.columns
    assert sorted(r["id"] for r in left.collect()) == sorted(set(range(100_000)) - gone)


def test_nothing_goes_and_no_rows(spark, edge, none):
    for frame in (edge, none, settle(edge), settle(none)):
        table = NumberedRows(frame)
        assert table.without(table.rows.filter("false").select(table.name)).count() == frame.count()
        assert table.without(table.rows.select(table.name)).count() == 0


def test_other_frames_are_written_first(spark, edge):
    files = settle(edge)
    odd = [
        files.filter("doc_id > 3"),
        files.unionByName(files),
        files.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")),
        edge.withColumn("_metadata", F.lit("own")).withColumn("a.b", F.lit(1)),
        files.alias("a").join(files.alias("b"), F.expr("a.doc_id = b.doc_id")).select("a.*"),
    ]
    for frame in odd:
        table = NumberedRows(frame)
        numbers = sorted(r[table.name] for r in table.rows.collect())
        assert numbers == list(range(frame.count())) and len(numbers) <= 4 * len(EDGE)
        left = table.without(table.rows.filter(F.col(table.name) == 0).select(table.name))
        assert left.columns == frame.columns and left.count() == len(numbers) - 1
