"""Stage tables leave nothing else on disk."""

import os
import time

from lakemill.llm.common import CLEANUP, discard, stage


def test_shuffle_files_go_with_the_plan(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    made = stage(spark.range(0, 1000, 1, 4).repartition(3, "id"), "shuffled")
    end = time.time() + 5
    while time.time() < end and files() - before:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) == setting
    discard(made)
