"""Deliveries into a stored ledger, load after load, each one whole or not at all.

A load meets what is stored through two key ledgers (request ids and packet keys with owner and digest) and the
sequence state; no body of an earlier load is read. Bodies over the evidence cap are refused before a receipt exists.
A packet that equals a stored mark although no packet of that number is stored contradicts the state: its receipt says so and
it becomes no packet. Receipts, packets, results, audit rows, keys and state of a load are published together (``commits``).

Loads come in arrival order. Rows are judged by their own order ``(received_us, delivery_id)`` within a load.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators import audit, identity, results, sequence
from telemark.operators.identity import PACKET_KEY, is_candidate, passes_validation
from telemark.operators.scale import attach_group_facts
from telemark.operators.sequence import STATE_CONFLICT
from telemark.session import settle
from telemark.sources.schemas import AUDIT, PACKET, PROCESSED, RECEIPT, SEQUENCE_STATE, struct
from telemark.streaming.commits import Commits, RefusedLoad, Snapshot
from telemark.streaming.key_ledger import KeyLedger

#: Receipt time of a stored owner: before every row of a load.
STORED_US = -(1 << 62)
CONFLICTS = struct("payload_id bigint, boot_id bigint, sequence_number bigint, received_us bigint, delivery_id bigint")
REFUSED = struct("delivery_id bigint, received_us bigint, request_id string, body_size int, body_sha256 string, reason string")
Worker = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Ledger:
    """The stored tables under ``root``."""

    SCHEMAS = {
        "receipts": RECEIPT, "packets": PACKET, "audit": AUDIT, "processed": PROCESSED, "security_rejected": REFUSED, "state_conflicts": CONFLICTS,
    }

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.commits = spark, Commits(spark, root)
        self.requests = KeyLedger(
            self.commits, "request_keys", "canonical_request_id string",
            "delivery_id bigint, received_us bigint, content_type string, body_sha256 string",
        )
        self.packets = KeyLedger(
            self.commits, "packet_keys", "payload_id bigint, boot_id bigint, sequence_number bigint", "delivery_id bigint, body_sha256 string"
        )

    def table(self, name: str) -> DataFrame:
        return self.commits.read(name, self.SCHEMAS[name])

    def sequence_state(self, at: Snapshot | None = None) -> DataFrame:
        return self.commits.read_folders("sequence_state", SEQUENCE_STATE, at)

    # -- one load ---------------------------------------------------------------

    def load(self, number: int, deliveries: DataFrame, worker: Worker | None = None) -> bool:
        """Adds load ``number``; False where it, or a later one, is stored. ``worker`` turns the load's packets into (attempts, job status)."""
        try:
            load = self.commits.begin(number)
        except RefusedLoad:
            return False
        sized = deliveries.withColumn("_reason", wire.boundary_rejection(F.lit(None).cast("string"), F.length("raw_body")))
        load.append("security_rejected", sized.where(F.col("_reason").isNotNull()).select(
            "delivery_id", "received_us", "request_id", F.length("raw_body").alias("body_size"),
            F.sha2("raw_body", 256).alias("body_sha256"), F.col("_reason").alias("reason"),
        ))
        kept = sized.where(F.col("_reason").isNull()).drop("_reason").withColumn("body_sha256", F.sha2("raw_body", 256))
        identified = settle(self._identified(kept, load.seen), "identified")
        state = self.sequence_state(load.seen)
        owned = settle(self.packets.lookup(identified.where(is_candidate()).select(*PACKET_KEY), load.seen), "owned")
        fresh = identified.where(is_candidate()).join(owned.select(*PACKET_KEY), PACKET_KEY, "left_anti")
        conflicts = load.append("state_conflicts", sequence.state_conflicts(fresh.select(*CONFLICTS.names), state).drop("state_conflict"))
        outcome = settle(self._outcome(identified, owned, conflicts, load.seen), "outcome")
        accepted = outcome.where("request_state = 'NEW' and packet_state = 'PACKET'")
        disposed = settle(sequence.sequence_disposition(accepted, state), "disposed")
        load.append("receipts", identity.receipts(outcome).select(*RECEIPT.names))
        packets = load.append("packets", results.packets_table(outcome, disposed).select(*PACKET.names))
        history = [
            audit.delivery_events(outcome, disposed),
            audit.state_conflict_events(conflicts.withColumn("state_conflict", F.lit(STATE_CONFLICT))),
            audit.boundary_events(sized.where(F.col("_reason").isNotNull()).select(
                F.col("delivery_id").alias("attempt_id"), "received_us", "request_id", "raw_body",
                F.lit(True).alias("token_ok"), F.lit(None).cast("string").alias("declared_length"),
            )),
        ]
        if worker:
            attempts, status = worker(packets)
            history.append(audit.work_events(attempts))
            load.append("processed", results.stored_results(packets, status).select(*PROCESSED.names))
        load.append("audit", audit.audit_history(*history))
        load.replace("sequence_state", sequence.merged_state(state, disposed).select(*SEQUENCE_STATE.names))
        self.requests.add(load, identified.where("request_state = 'NEW' and canonical_request_id is not null").select(*self.requests.columns))
        self.packets.add(load, accepted.select(*self.packets.columns))
        load.commit()
        return True

    def _identified(self, rows: DataFrame, at: Snapshot) -> DataFrame:
        """Request identity by digests, then decoding and validation by the owner's header and receipt time."""
        rows = rows.withColumn("canonical_request_id", wire.canonical_request_id("request_id"))
        named = rows.where(F.col("canonical_request_id").isNotNull())
        owned = self.requests.lookup(named.select("canonical_request_id"), at)
        facts = _firsts(named, owned, ["canonical_request_id"], "content_type", "body_sha256")
        rows = attach_group_facts(rows, facts, ["canonical_request_id"], row_id="delivery_id")
        owner = F.col("fact.delivery_id")
        is_new = owner.isNull() | (owner == F.col("delivery_id"))
        same = F.col("body_sha256") == F.col("fact.body_sha256")
        found = wire.compute_once(
            rows,
            request_state=F.when(is_new, "NEW").when(same, "REPLAY").otherwise("CONFLICT"),
            first_delivery_id=F.coalesce(owner, F.col("delivery_id")),
            judged_received_us=F.when(is_new, F.col("received_us")).otherwise(F.col("fact.owner_us")),
            judged_content_type=F.when(is_new, F.col("content_type")).otherwise(F.col("fact.content_type")),
        ).drop("fact")
        return wire.validate_frames(
            found, received_us="judged_received_us", header_rejection=wire.header_rejection("judged_content_type", "request_id")
        )

    def _outcome(self, identified: DataFrame, owned: DataFrame, conflicts: DataFrame, at: Snapshot) -> DataFrame:
        """Packet identity by digests; ``conflicts`` and their replays contradict the state and name no packet."""
        earlier = self.commits.read("state_conflicts", CONFLICTS, at).select("delivery_id")
        known = conflicts.select("delivery_id").unionByName(earlier).select(
            F.col("delivery_id").alias("first_delivery_id"), F.lit(True).alias("_contradicts")
        )
        rows = identified.join(known, "first_delivery_id", "left").withColumn("_contradicts", F.coalesce("_contradicts", F.lit(False)))
        reaches = (F.col("request_state") != "CONFLICT") & passes_validation() & ~F.col("_contradicts")
        stored = owned.withColumn("received_us", F.lit(STORED_US).cast("bigint"))
        facts = _firsts(rows.where(is_candidate() & ~F.col("_contradicts")), stored, PACKET_KEY, "body_sha256")
        facts = facts.select(*(F.col(k).alias(f"_{k}") for k in PACKET_KEY), "n", "fact")
        keys = [f"_{k}" for k in PACKET_KEY]
        keyed = rows.withColumns({f"_{k}": F.when(reaches, F.col(k)) for k in PACKET_KEY})
        placed = attach_group_facts(keyed, facts, keys, row_id="delivery_id")
        first = F.coalesce("fact.delivery_id", "first_delivery_id")
        states = wire.compute_once(
            placed,
            packet_state=F.when(
                reaches,
                F.when(first == F.col("first_delivery_id"), "PACKET")
                .when(F.col("body_sha256") == F.col("fact.body_sha256"), "DUPLICATE").otherwise("CONFLICT"),
            ),
            origin_delivery_id=F.when(reaches, first),
        ).drop("fact", *keys)
        contradicts = F.col("_contradicts") & (F.col("request_state") != "CONFLICT")
        done = identity.with_outcome(states)
        return done.withColumns({
            "validation_status": F.when(contradicts, "CONFLICT").otherwise(F.col("validation_status")),
            "rejection_reason": F.when(contradicts, STATE_CONFLICT).otherwise(F.col("rejection_reason")),
            "response_code": F.when(contradicts, 409).otherwise(F.col("response_code")),
        }).drop("_contradicts")


def _firsts(rows: DataFrame, owned: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Stored owners, and of the other keys with more than one row the first arrival: (keys, n, fact).

    Rows are counted without what they carry; only rows of repeated keys reach the struct's minimum."""
    carried_of = lambda at: F.struct(F.col("received_us").alias("at"), "delivery_id", F.col(at).alias("owner_us"), *carried)
    stored = owned.select(*keys, F.lit(2).cast("bigint").alias("n"), carried_of("received_us").alias("fact"))
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = rows.select(*keys, "received_us", "delivery_id", *carried).join(repeated, keys)
    fresh = few.groupBy(*keys).agg(F.max("n").alias("n"), F.min(carried_of("received_us")).alias("fact"))
    return stored.unionByName(fresh.join(owned.select(*keys), keys, "left_anti"))


def load_sink(ledger: Ledger, worker: Worker | None = None):
    """A ``foreachBatch`` sink: one load per micro-batch, refused when repeated."""
    return lambda batch, batch_id: ledger.load(batch_id, batch, worker)
