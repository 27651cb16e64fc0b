"""Later loads on top of a stored ledger, with the batch operators.

A load needs from the ledger only the deliveries its own rows can meet: the
owners of the request ids it presents and the sources of the packet keys it
carries. They are found by semi joins on distinct keys and join the load as
earlier arrivals, so every rule works unchanged.

Loads come in arrival order: no delivery of a load was received before those of
an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators import identity
from telemark.operators.identity import PACKET_KEY
from telemark.sources.schemas import DELIVERY

COLUMNS = DELIVERY.fieldNames()


def _packet_keys(deliveries: DataFrame) -> DataFrame:
    return wire.decode_frames(deliveries).select(*PACKET_KEY).where("boot_id is not null").distinct()


def context_of(load: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored deliveries (an outcome table) that the load's rows can meet."""
    new = stored.where(F.col("request_state") == "NEW")
    ids = load.select(
        wire.canonical_request_id("request_id").alias("canonical_request_id")
    ).where(F.col("canonical_request_id").isNotNull()).distinct()
    owners = new.join(ids, "canonical_request_id", "left_semi").select(*COLUMNS)
    keys = _packet_keys(load.select(*COLUMNS).unionByName(owners))
    sources = (
        new.where(F.col("packet_state") == "PACKET")
        .join(keys, PACKET_KEY, "left_semi")
        .select(*COLUMNS)
    )
    return owners.unionByName(sources).dropDuplicates(["delivery_id"])


def load_outcome(load: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of the load's deliveries given everything stored before."""
    together = (
        load.select(*COLUMNS)
        .withColumn("_loaded", F.lit(True))
        .unionByName(context_of(load, stored).withColumn("_loaded", F.lit(False)))
    )
    outcome = identity.delivery_outcome(identity.identify(together))
    return outcome.where("_loaded").drop("_loaded")
