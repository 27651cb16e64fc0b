"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query runs in full into the no-op sink; landing and
ledger tables are written first and timed on their own.
"""

from __future__ import annotations

import json
import os
import time

from telemark.functions import legacy_wire, wire
from telemark.operators import legacy
from telemark.plans.catalog import QUERIES
from telemark.plans.tables import Tables
from telemark.session import build_session

HEADLINE = (
    "frame_decode", "frame_encode", "rejection_reason", "request_identity", "packet_identity",
    "delivery_outcome", "receipt_ledger", "sequence_disposition", "sequence_state", "processed",
    "health_assessment", "session_health", "raw_view", "processed_view", "consistency_check",
    "job_status", "audit_events", "packet_timeline", "fk_violations", "service_counters",
    "legacy_demux", "legacy_sequence_gap", "limit_violations", "alert_rules", "command_status",
    "codec_round_trip",
)
CODEC_FRAMES = 5_000_000


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def codec_frames_per_second(spark) -> float:
    """Legacy encode, packet decode and payload decode of a frame table."""
    from pyspark.sql import functions as F

    n = F.col("id")
    body = legacy_wire.health_body(
        n % 16384, F.lit(wire.PROJECT_EPOCH_US * 1000) + n * 1000,
        (22000 + n % 8000) / 1000.0, (n % 6000) / 100.0, n % 13001 - 6500, n % 4, n % 2,
    )

    def round_trip() -> None:
        packets = wire.with_crc(spark.range(CODEC_FRAMES), body, "raw_packet")
        back = legacy.sound(legacy_wire.decode_packets(packets))
        sink(back.select(*(c.alias(k) for k, c in legacy_wire.health_fields().items())))

    round_trip()
    return round(CODEC_FRAMES / timed(round_trip))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.files.minPartitionNum": cpus,
            "spark.sql.files.openCostInBytes": "0",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, sf_dir)
    setup = {
        "landing_tables": timed(lambda: (tables.deliveries(), tables.legacy_packets())),
        "ledger_tables": timed(lambda: tables.packets()),
    }
    queries = {}
    for name in HEADLINE:
        queries[name] = timed(lambda: sink(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "setup": setup,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "deliveries": tables.deliveries().count(),
                "codec_frames_per_second": codec_frames_per_second(spark),
            }
        )
    )


if __name__ == "__main__":
    main()
