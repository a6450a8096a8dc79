"""What the steps between written tables leave behind."""

import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from saldo.llm.components import CLEANUP, written


def shuffle_files(spark):
    top = Path(spark.conf.get("spark.local.dir", tempfile.gettempdir()))
    return {x for x in top.glob("blockmgr-*/*/shuffle_*")}


def test_shuffle_files_go_with_the_write(spark):
    keys = spark.range(50_000).withColumn("k", F.xxhash64("id") % 9_000)
    before, conf = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    plain = tempfile.mkdtemp() + "/plain"
    counted = keys.groupBy("k").count()
    counted.write.parquet(plain)
    assert shuffle_files(spark) - before  # without it they stay
    before = shuffle_files(spark)
    again = written(keys.groupBy("k").agg(F.max("id").alias("id")), "counted")
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left
    assert again.count() == counted.count()
    assert spark.conf.get(CLEANUP, None) == conf
