"""Deliveries in arrival order as a stream, whatever the files' names and times.

A landed load is cut into steps, consecutive ranges of receipt order with a bounded number of rows, one folder each; the load becomes
visible with its manifest (``Commits``), so landing touches no file twice and the driver handles one name per load. The stream's
offsets are positions ``(load, step)``: a trigger takes the next ``stepsPerTrigger`` steps, or all that are there if the option is
left out, and the answer does not depend on it. A source is not told where a restarted query stands, so it notes the position of every
batch it plans, as the name of an empty file beside the query's checkpoint.

The reader runs in Python workers, so the folder must be one that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from telemark.sources.schemas import DELIVERY
from telemark.streaming.commits import Commits

ORDER = ("received_us", "delivery_id")
#: Rows of a step; with the steps of a trigger it bounds what one key has in a micro-batch.
STEP_ROWS = 100_000
FORMAT = "telemark_arrivals"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def land(deliveries: DataFrame, root: str, load: int, step_rows: int = STEP_ROWS) -> bool:
    """Adds load ``load`` to ``root``; False where it, or a later one, is there. Loads come in arrival order."""
    commits = Commits(deliveries.sparkSession, root)
    if load <= commits.snapshot().load:
        return False
    landing = commits.begin(load)
    steps = max(1, -(-deliveries.count() // step_rows))
    ranged = deliveries.select(*DELIVERY.names).repartitionByRange(steps, *ORDER).sortWithinPartitions(*ORDER)
    ranged.withColumn("step", F.spark_partition_id()).write.mode("overwrite").partitionBy("step").parquet(f"{root}/arrivals/load={load}")
    landing.commit()
    return True


def read_stream(spark: SparkSession, root: str, checkpoint: str, steps_per_trigger: int | None = None) -> DataFrame:
    """Deliveries landed under ``root``, in arrival order across micro-batches; ``checkpoint`` is the query's checkpoint folder."""
    spark.dataSource.register(ArrivalSource)
    reader = spark.readStream.format(FORMAT).option("root", root).option("positions", f"{checkpoint}/arrivals")
    if steps_per_trigger:
        reader = reader.option("stepsPerTrigger", steps_per_trigger)
    return reader.load()


def run_caught_up(stream: DataFrame, sink, checkpoint: str, partitions: int | None = None) -> None:
    """Process what has landed, trigger by trigger, then stop; a later call continues from there.

    The query has ``partitions`` shuffle partitions, the session's if left out. A checkpoint with state keeps those it began with."""
    conf = stream.sparkSession.conf
    before = conf.get(SHUFFLE_PARTITIONS)
    if partitions:
        conf.set(SHUFFLE_PARTITIONS, partitions)
    try:
        # a query runs in a copy of its session, made here
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    finally:
        conf.set(SHUFFLE_PARTITIONS, before)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


class ArrivalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return DELIVERY

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options["root"], self.options["positions"], int(self.options.get("stepsPerTrigger", 0)))


class Step(InputPartition):
    def __init__(self, load: int, step: int) -> None:
        self.load, self.step = load, step


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, root: str, positions: str, most: int) -> None:
        self.root, self.positions, self.most = root, positions, most
        self.position: tuple[int, int] | None = None

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def _noted(self) -> tuple[int, int]:
        store, folder = fs.FileSystem.from_uri(self.positions)
        names = (f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        return max((tuple(map(int, n.split("-"))) for n in names if n[:1].isdigit()), default=(-1, -1))

    def _note(self, position: tuple[int, int]) -> None:
        """Planned up to here: batches planned earlier are done, and later offsets are not in the query's log."""
        store, folder = fs.FileSystem.from_uri(self.positions)
        earlier = self._noted()
        if position > earlier:
            store.create_dir(folder)
            store.open_output_stream(f"{folder}/{position[0]}-{position[1]}").close()
            if earlier > (-1, -1):
                store.delete_file(f"{folder}/{earlier[0]}-{earlier[1]}")

    def _loads(self) -> list[int]:
        """Loads up to the newest manifest, in order."""
        store, root = self._store()
        listed = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
        names = sorted(f.base_name for f in listed if f.base_name.startswith("load-"))
        if not names:
            return []
        with store.open_input_stream(f"{root}/_commits/{names[-1]}") as text:
            last = json.loads(text.read())["load"]
        folders = store.get_file_info(fs.FileSelector(f"{root}/arrivals", allow_not_found=True))
        return sorted(n for n in (int(f.base_name.partition("=")[2]) for f in folders if f.base_name.startswith("load=")) if n <= last)

    def _steps(self, after: tuple[int, int], upto: tuple[int, int] | None = None) -> Iterator[tuple[int, int]]:
        store, root = self._store()
        for load in self._loads():
            if load < after[0] or (upto and load > upto[0]):
                continue
            folders = store.get_file_info(fs.FileSelector(f"{root}/arrivals/load={load}"))
            for step in sorted(int(f.base_name.partition("=")[2]) for f in folders if f.base_name.startswith("step=")):
                if (load, step) > after and (upto is None or (load, step) <= upto):
                    yield load, step

    def initialOffset(self) -> dict:
        return {"load": -1, "step": -1}

    def latestOffset(self) -> dict:
        last = self._noted() if self.position is None else self.position
        for n, step in enumerate(self._steps(last), 1):
            last = step
            if n == self.most:
                break
        self.position = last
        return {"load": last[0], "step": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Step]:
        upto = (end["load"], end["step"])
        self._note(upto)
        return [Step(*s) for s in self._steps((start["load"], start["step"]), upto)]

    def read(self, partition: Step) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        folder = f"{root}/arrivals/load={partition.load}/step={partition.step}"
        for file in store.get_file_info(fs.FileSelector(folder)):
            if file.base_name.endswith(".parquet"):
                with store.open_input_file(file.path) as source:
                    yield from pq.ParquetFile(source).iter_batches(batch_size=10_000, columns=DELIVERY.names)
