import random

from pyspark.sql import functions as F

from folioscope.operators.indexing import batch_ids
from folioscope.operators.scans import running, width_block


def test_running_equals_plain_loop_on_a_hot_key(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", i, rng.randint(-5, 5), rng.random() < 0.3)
            for i in range(1500)]
    df = spark.createDataFrame(data, "k string, i long, v long, flag boolean")
    for inclusive in (True, False):
        got = running(df, ["k"], ["i"], width_block(F.col("i"), 37),
                      {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("flag"), F.col("i")))}, inclusive)
        want, total, last = {}, {}, {}
        for k, i, v, flag in data:
            before = (total.get(k, 0), last.get(k))
            total[k] = total.get(k, 0) + v
            if flag:
                last[k] = i
            want[i] = (total[k], last.get(k)) if inclusive else before
        assert {r.i: (r.s, r.m) for r in got.collect()} == want


def test_batches_of_32(spark):
    ids = spark.range(70).withColumnRenamed("id", "vec_id")
    sizes = sorted(r["count"] for r in batch_ids(ids, 32, width=10).groupBy("batch_id").count().collect())
    assert sizes == [6, 32, 32]
