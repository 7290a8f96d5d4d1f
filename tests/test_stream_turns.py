"""The turns of a registered stream are cut from rows that were worked out once."""

import tempfile

from pyspark.sql import functions as F

from payguard.plans import catalog_streams as ST


class Done:
    def awaitTermination(self):
        pass

    def exception(self):
        return None


def test_turns_work_their_rows_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x
    rows = spark.range(90).select(F.udf(count, "long")("id").alias("ms"))
    folder = tempfile.mkdtemp(dir="/tmp", prefix="pg-turns-")
    ST.in_turns(rows, folder, lambda source, k: Done())
    assert sorted(r.ms for r in spark.read.parquet(f"{folder}/src/*").collect()) == list(range(90))
    assert made.value == 90
