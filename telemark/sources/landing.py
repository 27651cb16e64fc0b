"""Landing deliveries as files in arrival order.

A file stream takes files by modification time and reads batch order as arrival
order. Tasks finish in any order, so what they write has to be put in order
before a stream sees it.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame

ORDER = ("received_us", "delivery_id")
#: Rows of a file; with the files of a trigger it bounds what one key has in a micro-batch.
FILE_ROWS = 100_000


def land_in_order(deliveries: DataFrame, path: str, file_rows: int = FILE_ROWS) -> int:
    """Add ``deliveries`` to the folder ``path`` as files in order of ``ORDER``; the number of files.

    Files hold consecutive ranges of some ``file_rows`` rows. They are written aside, given
    ascending modification times later than those of the folder's files, and published in that
    order, so a stream gets the same answer however many files it takes at a time. The driver
    handles file names only. Loads come in arrival order; on a store without settable
    modification times, streams should take one load per trigger.
    """
    spark = deliveries.sparkSession
    aside = f"{path}/_landing-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(deliveries.count() / file_rows))
    deliveries.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).write.parquet(aside)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    folder, staged = hadoop_path(path), hadoop_path(aside)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    present = [f.getModificationTime() for f in store.listStatus(folder) if f.isFile()]
    start = max([int(time.time() * 1000), *(t + 1 for t in present)])
    written = [f.getPath() for f in store.listStatus(staged) if f.getPath().getName().startswith("part-")]
    # the partition's number follows "part-"
    written.sort(key=lambda p: int(p.getName().split("-")[1]))
    for i, file in enumerate(written):
        store.setTimes(file, start + i, -1)
        store.rename(file, hadoop_path(f"{path}/arrived-{start:015d}-{i:07d}.parquet"))
    store.delete(staged, True)
    return len(written)
