"""Batches and samples."""

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import common


def test_blocks_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (0, 5, 20, 1, 1, 0, 3)])], ["t"])
    parts = list(common.blocks(batch, 0, 6))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 6 for p in parts)


def test_samples_are_bounded_and_repeat(spark):
    docs = spark.createDataFrame([(i % 40, f"t{i % 30}") for i in range(200)], "doc_id long, text string")
    chosen = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    one, two = (sorted(map(tuple, common.bounded_sample(docs.repartition(n), chosen, 15, 1, ["label"]).collect())) for n in (1, 7))
    assert one == two and 0 < len(one) <= 15 and len({r[1] for r in one}) == len({r[0] for r in one}) == len(one)


def test_labels_that_may_be_learned_from(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    import zlib

    got = {r.doc_id: r.label for r in common.labelled(labels, "toxic").collect()}
    assert got == {i: i % 2 for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}
