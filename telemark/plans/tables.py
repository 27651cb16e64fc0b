"""The engine's tables over one data folder.

Landing tables (deliveries, legacy packets) are derived from ``events`` and
written once per session; so are the ledger tables that lookups, reports and
audits read, as an operator of the engine would keep them. Operators themselves
are always computed from the landing tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.operators import audit, identity, jobs, legacy, results, sequence
from telemark.session import settle, shared_folder, use_utc
from telemark.sources import arrivals, command_sample, sample

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_LANDED: dict[tuple[str, str], str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        use_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def _written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = settle(build(), name)
        # a fresh plan over the same files, so that self-joins resolve
        return _WRITTEN[key].select("*")

    def arrivals(self) -> str:
        """Folder of the deliveries landed in arrival order, for stream readers."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _LANDED:
            path = self.scratch("arrivals")
            arrivals.land(self.deliveries(), path, 0)
            _LANDED[key] = path
        return _LANDED[key]

    def scratch(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    # -- landing --------------------------------------------------------------

    def deliveries(self) -> DataFrame:
        return self._written("deliveries", lambda: sample.deliveries(self.spark, self.sf_dir))

    def boundary(self) -> DataFrame:
        return sample.boundary_attempts(self.spark, self.sf_dir)

    def legacy_packets(self) -> DataFrame:
        return self._written(
            "legacy_packets", lambda: sample.legacy_packets(self.spark, self.sf_dir)
        )

    # -- ledger ---------------------------------------------------------------

    def outcome(self) -> DataFrame:
        return self._written(
            "outcome",
            lambda: identity.delivery_outcome(identity.identify(self.deliveries())),
        )

    def accepted(self) -> DataFrame:
        return self.outcome().where("request_state = 'NEW' and packet_state = 'PACKET'")

    def packets(self) -> DataFrame:
        return self._written(
            "packets",
            lambda: results.packets_table(
                self.outcome(),
                sequence.sequence_disposition(self.accepted(), settled=True, carried=("raw_body",)),
            ),
        )

    def disposed(self) -> DataFrame:
        return self.packets().select(
            F.col("source_receipt_id").alias("delivery_id"), "received_us", "payload_id",
            "boot_id", "sequence_number", "sequence_disposition", "missing_before",
        )

    def receipts(self) -> DataFrame:
        return identity.receipts(self.outcome())

    def request_identities(self) -> DataFrame:
        return identity.request_ledger(self.deliveries())

    def sequence_states(self) -> DataFrame:
        return sequence.sequence_state(self.disposed())

    def jobs(self, backlog: bool = False) -> DataFrame:
        return sample.jobs(
            self.packets().withColumnRenamed("source_receipt_id", "delivery_id"), backlog
        )

    def attempts(self, backlog: bool = False) -> DataFrame:
        return sample.attempts(self.jobs(backlog), backlog)

    def job_status(self, backlog: bool = False) -> DataFrame:
        return self._written(
            "backlog_jobs" if backlog else "jobs",
            lambda: jobs.job_status(self.jobs(backlog), self.attempts(backlog)),
        )

    def processed(self) -> DataFrame:
        return self._written(
            "processed", lambda: results.stored_results(self.packets(), self.job_status())
        )

    def audit_history(self) -> DataFrame:
        return audit.audit_history(
            audit.delivery_events(self.outcome(), self.disposed()),
            audit.work_events(self.attempts()),
            audit.boundary_events(self.boundary()),
        )

    def audit(self) -> DataFrame:
        return self._written("audit", self.audit_history)

    # -- legacy ---------------------------------------------------------------

    def health_samples(self) -> DataFrame:
        return legacy.health_samples(self.legacy_packets())

    def commands(self) -> DataFrame:
        return sample.commands(self.spark, self.sf_dir)

    # -- version 1 commands ---------------------------------------------------

    def _landed(self, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        return self._written(build.__name__, lambda: build(self.spark, self.sf_dir))

    def command_frames_v1(self) -> DataFrame:
        return self._landed(command_sample.command_frames)

    def ack_deliveries(self) -> DataFrame:
        return self._landed(command_sample.ack_deliveries)

    def state_events(self) -> DataFrame:
        return self._landed(command_sample.state_events)

    def operator_requests(self) -> DataFrame:
        return self._landed(command_sample.operator_requests)
