"""What the operators share."""

import pyarrow as pa

from plotgauge.llm import common


def test_batches_end_by_bytes(spark):
    """Texts long enough to fill a batch by bytes before its rows are reached; every row arrives, and sizes that the session chose stay."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) AS text")
    found = common.map_texts(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 300
    assert max(r["size"] for r in found) < 2 * common.BATCH_BYTES
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
        common.short_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith("1000000")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
