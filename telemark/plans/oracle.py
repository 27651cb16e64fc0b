"""The same results in plain SQL over the given tables, written independently of
the Spark operators: from the frame fields, not from the encoded bytes, except
where bytes are the result. Used to check the registered queries."""

from __future__ import annotations

DAY_US = "86400000000"

# Event-derived frames and deliveries (FIXTURES.md part B).
FRAMES = f"""
ev AS (
  SELECT event_id AS e, user_id, event_type, value,
         epoch_us(ts) + 731::BIGINT * {DAY_US} AS sample_us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn
  FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events),
fr0 AS (
  SELECT *, (CASE WHEN e%13=0 THEN 129600 WHEN e%17=0 THEN 21600 ELSE 1 END)::BIGINT AS delay
  FROM ev),
fr AS (
  SELECT e, sample_us, event_type, sample_us + delay * 1000000::BIGINT AS received_us,
    (CASE WHEN e%37=0 THEN 2 ELSE 1 END)::BIGINT AS protocol_version,
    (CASE WHEN e%41=0 THEN 2 ELSE 1 END)::BIGINT AS payload_id,
    CASE WHEN e%43=0 THEN 0::BIGINT ELSE user_id + 1 END AS boot_id,
    (rn + rn // 7)::BIGINT AS sequence_number,
    CASE WHEN e%47=0 THEN sample_us - 1000::BIGINT * {DAY_US}
         WHEN e%53=0 THEN sample_us + (delay + 600) * 1000000::BIGINT
         ELSE sample_us END AS timestamp_us,
    CASE WHEN e%61=0 THEN 15001::BIGINT
         ELSE floor(value*50)::BIGINT - 6000 END AS temperature_centi_c,
    CASE WHEN e%101=0 THEN 50001::BIGINT ELSE 20000 + (e*137)%16000 END AS base_mv,
    (CASE WHEN e%103=0 THEN 4 WHEN event_type='view' THEN 0 WHEN event_type='click' THEN 1
         WHEN event_type IN ('purchase','error') THEN 2 ELSE 3 END)::BIGINT AS operating_mode,
    CASE WHEN e%107=0 THEN 64::BIGINT WHEN event_type='error' THEN e%64
         ELSE 0::BIGINT END AS fault_flags
  FROM fr0)"""

DELIVERIES = FRAMES + """,
dl AS (
  SELECT e*8 + copy AS delivery_id, fr.e, copy,
    received_us + (CASE copy WHEN 1 THEN 60 WHEN 2 THEN 120 WHEN 3 THEN 5 WHEN 4 THEN 10 ELSE 0 END)
      * 1000000::BIGINT AS received_us,
    protocol_version, payload_id, boot_id, sequence_number, timestamp_us, temperature_centi_c,
    base_mv + (CASE WHEN copy IN (2,4) THEN 1 ELSE 0 END) AS voltage_mv,
    operating_mode, fault_flags,
    CASE WHEN e%67=0 THEN 'text/plain' WHEN e%71=0 THEN 'Application/Octet-Stream; v=1'
         ELSE 'application/octet-stream' END AS content_type,
    CASE WHEN e%73=0 THEN NULL ELSE printf('%08x-0000-4000-8000-%012x', e,
         (CASE WHEN copy IN (3,4) THEN 0 ELSE copy END)::BIGINT) END AS request_id,
    e%29=0 AS bad_crc, e%31=0 AS cut, (e%31<>0 AND e%211=0) AS is_empty
  FROM fr JOIN (VALUES (0),(1),(2),(3),(4)) c(copy)
    ON copy=0 OR (copy=1 AND e%5=0) OR (copy=2 AND e%19=0) OR (copy=3 AND e%23=0)
       OR (copy=4 AND e%59=0 AND e%211<>0)),
d AS (
  SELECT *, NOT cut AND NOT is_empty AS whole,
    CASE WHEN is_empty THEN '' ELSE concat_ws(',', protocol_version, payload_id, boot_id,
      sequence_number, timestamp_us, temperature_centi_c, voltage_mv, operating_mode, fault_flags,
      bad_crc, cut) END AS body
  FROM dl)"""

# CRC-32 in SQL, for the results that contain bytes.
CRC_TABLE = """
crct AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT,0,0,0,0,0,0,0,0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS tab)"""


def crc(hex_text: str) -> str:
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, "
        f"list_transform(range(1, length({hex_text})//2 + 1), lambda p: "
        f"('0x' || substr({hex_text}, (2*p-1)::BIGINT, 2))::BIGINT)), "
        f"lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"
    )


FRAME_BODY_HEX = (
    "printf('%02X%02X%08X%08X%016X%04X%04X%02X%02X', protocol_version, payload_id, boot_id, "
    "sequence_number, timestamp_us, (temperature_centi_c + 65536) % 65536, voltage_mv, "
    "operating_mode, fault_flags)"
)

BYTES = DELIVERIES + "," + CRC_TABLE + f""",
bx AS (SELECT d.*, {FRAME_BODY_HEX} AS body_hex FROM d),
by0 AS (SELECT bx.*, {crc('body_hex')} AS true_crc FROM bx, crct),
by1 AS (
  SELECT *, body_hex || printf('%08X', CASE WHEN bad_crc THEN xor(true_crc, 1::BIGINT)
    ELSE true_crc END) AS full_hex FROM by0),
b AS (
  SELECT *, CASE WHEN is_empty THEN '' WHEN cut THEN substr(full_hex, 1, 54)
    ELSE full_hex END AS raw_hex FROM by1)"""


def reason(received: str = "received_us", body: str = "") -> str:
    p = body
    return f"""CASE WHEN {p}is_empty THEN 'EMPTY_BODY'
      WHEN {p}protocol_version <> 1 THEN 'UNSUPPORTED_PROTOCOL_VERSION'
      WHEN {p}cut THEN 'INVALID_FRAME_LENGTH'
      WHEN {p}bad_crc THEN 'CRC_MISMATCH'
      WHEN {p}payload_id <> 1 THEN 'UNSUPPORTED_PAYLOAD_ID'
      WHEN {p}boot_id = 0 THEN 'INVALID_BOOT_ID'
      WHEN {p}timestamp_us < 1767225600000000 THEN 'TIMESTAMP_BEFORE_PROJECT_EPOCH'
      WHEN {p}timestamp_us > {received} + 300000000 THEN 'TIMESTAMP_TOO_FAR_IN_FUTURE'
      WHEN {p}temperature_centi_c NOT BETWEEN -10000 AND 15000 THEN 'TEMPERATURE_OUT_OF_RANGE'
      WHEN {p}voltage_mv NOT BETWEEN 0 AND 50000 THEN 'VOLTAGE_OUT_OF_RANGE'
      WHEN {p}operating_mode > 3 THEN 'INVALID_OPERATING_MODE'
      WHEN {p}fault_flags & 192 <> 0 THEN 'RESERVED_FAULT_BITS_SET' END"""


HEADER = """CASE WHEN lower(trim(split_part(coalesce(content_type,''), ';', 1)))
        <> 'application/octet-stream' THEN 'INVALID_CONTENT_TYPE'
      WHEN request_id IS NULL OR NOT regexp_full_match(request_id,
        '[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')
        THEN 'INVALID_REQUEST_ID' END"""


def packet_id_sql(prefix: str = "") -> str:
    return (
        f"printf('TLM-P%02d-B%08X-S%08X', {prefix}payload_id, {prefix}boot_id, "
        f"{prefix}sequence_number)"
    )


def ledger(source: str = "d", ctes: str = DELIVERIES) -> str:
    """Request identity, validation, packet identity, outcome and packets."""
    return ctes + f""",
w1 AS (
  SELECT {source}.*,
    CASE WHEN request_id IS NULL THEN delivery_id
      ELSE first_value(delivery_id) OVER w END AS first_delivery_id,
    CASE WHEN request_id IS NULL THEN body ELSE first_value(body) OVER w END AS first_body,
    CASE WHEN request_id IS NULL THEN received_us
      ELSE first_value(received_us) OVER w END AS first_received
  FROM {source} WINDOW w AS (PARTITION BY request_id ORDER BY received_us, delivery_id)),
v AS (
  SELECT *, CASE WHEN delivery_id = first_delivery_id THEN 'NEW'
      WHEN body = first_body THEN 'REPLAY' ELSE 'CONFLICT' END AS request_state,
    {HEADER} AS header_rejection, {reason('first_received')} AS frame_rejection
  FROM w1),
cand AS (
  SELECT *, first_value(delivery_id) OVER k AS origin, first_value(body) OVER k AS origin_body
  FROM v WHERE request_state='NEW' AND header_rejection IS NULL AND frame_rejection IS NULL
  WINDOW k AS (PARTITION BY payload_id, boot_id, sequence_number ORDER BY received_us, delivery_id)),
st AS (
  SELECT *, CASE WHEN delivery_id = origin THEN 'PACKET' WHEN body = origin_body THEN 'DUPLICATE'
    ELSE 'CONFLICT' END AS packet_state FROM cand),
oc AS (
  SELECT v.*, v.request_state = 'REPLAY' AS is_replay,
    CASE WHEN v.request_state <> 'CONFLICT' THEN st.packet_state END AS packet_state,
    CASE WHEN v.request_state <> 'CONFLICT' THEN st.origin END AS origin_delivery_id
  FROM v LEFT JOIN st ON st.delivery_id = v.first_delivery_id),
o AS (
  SELECT *,
    CASE WHEN request_state='CONFLICT' THEN 'CONFLICT'
      WHEN header_rejection IS NOT NULL OR frame_rejection IS NOT NULL THEN 'REJECTED'
      WHEN packet_state='PACKET' THEN 'ACCEPTED' ELSE packet_state END AS validation_status,
    CASE WHEN request_state='CONFLICT' THEN 'REQUEST_ID_REUSED_WITH_DIFFERENT_BODY'
      WHEN header_rejection IS NOT NULL THEN header_rejection
      WHEN frame_rejection IS NOT NULL THEN frame_rejection
      WHEN packet_state='CONFLICT' THEN 'SEQUENCE_CONFLICT' END AS rejection_reason
  FROM oc),
pk0 AS (
  SELECT *, {packet_id_sql()} AS packet_id,
    max(sequence_number) OVER (PARTITION BY payload_id, boot_id ORDER BY received_us, delivery_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
  FROM st WHERE packet_state='PACKET'),
pk AS (
  SELECT *,
    CASE WHEN h IS NULL THEN 'FIRST' WHEN sequence_number = h + 1 THEN 'IN_ORDER'
      WHEN sequence_number > h THEN 'GAP' ELSE 'LATE' END AS sequence_disposition,
    CASE WHEN h IS NULL THEN sequence_number WHEN sequence_number > h THEN sequence_number - h - 1
      ELSE 0::BIGINT END AS missing_before,
    CASE WHEN sequence_number > h THEN h END AS high_water_before
  FROM pk0)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


T_CLASS = """CASE WHEN temperature_centi_c < -4000 OR temperature_centi_c >= 8500 THEN 'CRITICAL'
  WHEN temperature_centi_c < -2000 OR temperature_centi_c >= 6200 THEN 'WARNING' ELSE 'NOMINAL' END"""
V_CLASS = """CASE WHEN voltage_mv < 22000 OR voltage_mv > 34000 THEN 'CRITICAL'
  WHEN voltage_mv < 26000 OR voltage_mv > 30000 THEN 'WARNING' ELSE 'NOMINAL' END"""
F_CLASS = """CASE WHEN fault_flags & 56 <> 0 THEN 'CRITICAL' WHEN fault_flags & 7 <> 0 THEN 'WARNING'
  ELSE 'NOMINAL' END"""
WORST = f"""CASE WHEN 'CRITICAL' IN (({T_CLASS}), ({V_CLASS}), ({F_CLASS})) THEN 'CRITICAL'
  WHEN 'WARNING' IN (({T_CLASS}), ({V_CLASS}), ({F_CLASS})) THEN 'WARNING' ELSE 'NOMINAL' END"""
FAULTS = """array_to_string(list_filter([
  CASE WHEN fault_flags & 1 <> 0 THEN 'OVER_TEMPERATURE' END,
  CASE WHEN fault_flags & 2 <> 0 THEN 'UNDER_VOLTAGE' END,
  CASE WHEN fault_flags & 4 <> 0 THEN 'OVER_VOLTAGE' END,
  CASE WHEN fault_flags & 8 <> 0 THEN 'TEMPERATURE_SENSOR_FAULT' END,
  CASE WHEN fault_flags & 16 <> 0 THEN 'VOLTAGE_SENSOR_FAULT' END,
  CASE WHEN fault_flags & 32 <> 0 THEN 'INTERNAL_PAYLOAD_FAULT' END], lambda x: x IS NOT NULL), '|')"""
MODE = "['SAFE','STANDBY','SCIENCE','CALIBRATION'][operating_mode + 1]"


def result_columns(worst: str = WORST) -> str:
    return f"""temperature_centi_c / 100.0::DOUBLE AS temperature_c, voltage_mv / 1000.0::DOUBLE AS voltage_v,
    {MODE} AS operating_mode, {FAULTS} AS fault_names, {worst} AS classification,
    received_us - timestamp_us > {DAY_US} AS is_stale, 'telemetry-v1' AS processor_version"""


def iso(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN {us} % 1000000 = 0 THEN '' ELSE printf('.%06d', {us} % 1000000) END || 'Z'"
    )


def work(ctes: str, backlog: bool = False) -> str:
    """Jobs, attempts and job status of the packets ``pk``."""
    pending = "e%50=30" if backlog else "false"
    untried = "e%25=5" if backlog else "false"
    return ctes + f""",
jb AS (
  SELECT 'JOB-' || packet_id AS job_id, packet_id, received_us AS created_us, e,
    CASE WHEN {pending} THEN NULL ELSE received_us END AS queued_us FROM pk),
att AS (
  SELECT job_id, packet_id, e, created_us, n AS attempt_no, created_us + n * 2000000::BIGINT AS ended_us,
    CASE WHEN e%10=0 THEN 'temporary' WHEN e%10=1 AND n=1 THEN 'temporary'
      WHEN e%10=2 THEN 'permanent' WHEN e%10=3 THEN 'temporary' ELSE 'success' END AS outcome
  FROM jb JOIN (VALUES (1::BIGINT),(2),(3)) a(n)
    ON n = 1 OR (n = 2 AND e%10 IN (0,1)) OR (n = 3 AND e%10 = 0)
  WHERE NOT ({untried})),
la AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_no DESC) = 1),
js0 AS (
  SELECT jb.*, la.attempt_no, la.ended_us, la.outcome,
    CASE WHEN la.outcome IS NULL AND queued_us IS NULL THEN 'PENDING_QUEUE'
      WHEN la.outcome IS NULL THEN 'QUEUED' WHEN la.outcome='success' THEN 'COMPLETE'
      WHEN la.outcome='permanent' OR la.attempt_no >= 3 THEN 'FAILED' ELSE 'RETRY_WAIT' END AS state
  FROM jb LEFT JOIN la USING (job_id)),
js AS (
  SELECT job_id, packet_id, created_us, queued_us, state, coalesce(attempt_no, 0)::BIGINT AS attempt_count,
    3::BIGINT AS max_attempts,
    CASE WHEN state='RETRY_WAIT' THEN ended_us + least(1 << (attempt_no - 1), 300)::BIGINT * 1000000 END
      AS next_attempt_us,
    CASE WHEN state='COMPLETE' THEN ended_us END AS completed_us,
    CASE WHEN state='FAILED' THEN ended_us END AS failed_us,
    NULL::BIGINT AS lease_expires_us,
    CASE WHEN state='COMPLETE' OR outcome IS NULL THEN NULL
      WHEN outcome='temporary' THEN 'OSError: worker unavailable'
      ELSE 'ValueError: stored fields differ' END AS last_error,
    CASE WHEN state='PENDING_QUEUE' THEN 'PENDING_QUEUE' ELSE 'QUEUED' END AS queue_status
  FROM js0)"""


BOUNDARY = """
bd AS (
  SELECT event_id*4 + kind AS attempt_id, kind,
    epoch_us(ts) + 731::BIGINT * 86400000000 + 2000000 AS received_us
  FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events JOIN (VALUES (0),(1),(2),(3)) k(kind)
    ON (kind=0 AND event_id%83=0) OR (kind=1 AND event_id%89=0) OR (kind=2 AND event_id%79=0)
      OR (kind=3 AND event_id%97=0)),
be AS (
  SELECT 'B-' || attempt_id AS event_id, received_us AS occurred_us, 'ground-api' AS service_name,
    CASE WHEN kind=3 THEN 'vendor.authentication.failed'
      ELSE 'telemetry.delivery.security_rejected' END AS event_name,
    CASE WHEN kind=3 THEN 'unauthenticated' ELSE 'local-token:vendor-simulator' END AS actor_identity,
    'REJECTED' AS outcome,
    CASE kind WHEN 0 THEN 'INVALID_CONTENT_LENGTH' WHEN 3 THEN 'INVALID_VENDOR_TOKEN'
      ELSE 'BODY_TOO_LARGE' END AS reason,
    NULL::BIGINT AS receipt_id, NULL::VARCHAR AS packet_id, NULL::VARCHAR AS job_id
  FROM bd)"""

AUDIT = work(ledger()) + "," + BOUNDARY + f""",
dx AS (SELECT *, CASE WHEN packet_state IS NOT NULL THEN {packet_id_sql()} END AS pid FROM o WHERE NOT is_replay),
de0 AS (
  SELECT delivery_id, received_us, 'telemetry.delivery.received' AS event_name, 0 AS k,
    'local-token:vendor-simulator' AS actor_identity, 'RECORDED' AS outcome, NULL AS reason,
    NULL AS packet_id, NULL AS job_id FROM dx WHERE request_state='NEW'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.delivery.request_id_conflict', 0,
    'local-token:vendor-simulator', 'CONFLICT', rejection_reason, NULL, NULL FROM dx
    WHERE request_state='CONFLICT'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.delivery.rejected', 1, 'ground-api',
    'REJECTED', rejection_reason, NULL, NULL FROM dx WHERE validation_status='REJECTED'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.delivery.duplicate', 1, 'ground-api',
    'DUPLICATE', NULL, pid, 'JOB-' || pid FROM dx WHERE packet_state='DUPLICATE'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.delivery.sequence_conflict', 1, 'ground-api',
    'CONFLICT', rejection_reason, pid, NULL FROM dx WHERE packet_state='CONFLICT'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.packet.accepted', 1, 'ground-api',
    'PENDING_QUEUE', NULL, pid, 'JOB-' || pid FROM dx WHERE packet_state='PACKET'
  UNION ALL SELECT delivery_id, received_us, 'telemetry.processing.queued', 2, 'ground-api',
    'QUEUED', NULL, pid, 'JOB-' || pid FROM dx WHERE packet_state='PACKET'),
de AS (
  SELECT 'D-' || delivery_id || '-' || k AS event_id, received_us AS occurred_us,
    'ground-api' AS service_name, event_name, actor_identity, outcome, reason,
    CASE WHEN k < 2 THEN delivery_id END AS receipt_id, packet_id, job_id FROM de0),
we AS (
  SELECT 'A-' || job_id || '-' || attempt_no || '-0' AS event_id, ended_us - 1000000 AS occurred_us,
    'payload-worker' AS service_name, 'telemetry.processing.claimed' AS event_name,
    'payload-worker' AS actor_identity, 'PROCESSING' AS outcome, NULL AS reason,
    NULL::BIGINT AS receipt_id, packet_id, job_id FROM att
  UNION ALL
  SELECT 'A-' || job_id || '-' || attempt_no || '-1', ended_us, 'payload-worker',
    CASE WHEN outcome='success' THEN 'telemetry.processing.completed'
      WHEN outcome='permanent' OR attempt_no >= 3 THEN 'telemetry.processing.failed'
      ELSE 'telemetry.processing.retry_scheduled' END, 'payload-worker',
    CASE WHEN outcome='success' THEN 'COMPLETE' WHEN outcome='permanent' OR attempt_no >= 3
      THEN 'FAILED' ELSE 'RETRY_WAIT' END,
    CASE outcome WHEN 'temporary' THEN 'OSError: worker unavailable'
      WHEN 'permanent' THEN 'ValueError: stored fields differ' END,
    NULL, packet_id, job_id FROM att),
au AS (SELECT * FROM de UNION ALL SELECT * FROM we UNION ALL SELECT * FROM be)"""

RECEIPTS = """
rc AS (
  SELECT delivery_id AS receipt_id, received_us, validation_status, rejection_reason,
    CASE WHEN request_state='CONFLICT' THEN first_delivery_id
      WHEN packet_state IN ('DUPLICATE','CONFLICT') THEN origin_delivery_id END AS duplicate_of_receipt_id
  FROM o WHERE NOT is_replay)"""

STATE = """
ss AS (
  SELECT payload_id, boot_id, max(sequence_number) AS high_water_sequence,
    count(*) AS accepted_packet_count, sum(missing_before)::BIGINT AS missing_packet_count
  FROM pk GROUP BY ALL)"""

# Legacy packets (FIXTURES.md B.2).
LEGACY = f"""
le AS (
  SELECT event_id AS e, event_type, value, epoch_us(ts) + 731::BIGINT * {DAY_US} AS sample_us,
    (CASE WHEN event_type='signup' THEN 101 WHEN event_id%11=0 THEN 200 ELSE 100 END)::BIGINT AS apid
  FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events),
ln AS (SELECT *, row_number() OVER (PARTITION BY apid ORDER BY e) - 1 AS n FROM le),
lp AS (
  SELECT e AS packet_no, e, event_type, apid, ((n + n // 9) & 16383)::BIGINT AS sequence_count, sample_us,
    sample_us * 1000 AS timestamp_ns, (sample_us + (e%2000)*1000) * 1000 AS received_ns,
    22000 + (e*53)%8000 AS mv, floor(value*15)::BIGINT AS centi_c, (e*7919)%13001 - 6500 AS wheel_rpm,
    e%4 AS mode, (CASE WHEN event_type='error' AND e%7=0 THEN 1 ELSE 0 END)::BIGINT AS fault_flags,
    (CASE WHEN e%3=0 THEN 1 ELSE 0 END)::BIGINT AS status, e%100 AS applied_value,
    '10.0.0.' || (e%200 + 1) || ':5005' AS source, e%29=0 AS bad_crc, e%31=0 AS cut,
    CASE WHEN e%31=0 THEN 'LENGTH_MISMATCH' WHEN e%29=0 THEN 'CRC_MISMATCH' END AS packet_rejection
  FROM ln),
hs AS (
  SELECT *, mv / 1000.0::DOUBLE AS bus_voltage_v, centi_c / 100.0::DOUBLE AS battery_temp_c
  FROM lp WHERE apid = 100 AND packet_rejection IS NULL),
gp AS (
  SELECT *, lag(sequence_count) OVER (PARTITION BY apid ORDER BY e) AS previous_count
  FROM lp WHERE packet_rejection IS NULL),
gaps AS (
  SELECT packet_no, received_ns, apid, sequence_count, previous_count,
    coalesce((((sequence_count - previous_count - 1) % 16384) + 16384) % 16384, 0)::BIGINT AS gap FROM gp),
al AS (
  SELECT packet_no, received_ns AS created_ns, sequence_count AS telemetry_sequence, 'bus_voltage_v' AS parameter,
    bus_voltage_v AS value, CASE WHEN mv < 24000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    CASE WHEN mv < 24000 THEN 'Bus voltage below 24.0 V' ELSE 'Bus voltage below 26.0 V' END AS message
  FROM hs WHERE mv < 26000
  UNION ALL SELECT packet_no, received_ns, sequence_count, 'battery_temp_c', battery_temp_c,
    CASE WHEN centi_c > 6500 THEN 'CRITICAL' ELSE 'WARNING' END,
    CASE WHEN centi_c > 6500 THEN 'Battery temperature above 65 C' ELSE 'Battery temperature above 55 C' END
  FROM hs WHERE centi_c > 5500
  UNION ALL SELECT packet_no, received_ns, sequence_count, 'wheel_rpm', wheel_rpm::DOUBLE, 'CRITICAL',
    'Reaction wheel speed exceeds 5500 RPM' FROM hs WHERE abs(wheel_rpm) > 5500
  UNION ALL SELECT packet_no, received_ns, sequence_count, 'fault_flags', fault_flags::DOUBLE, 'CRITICAL',
    'Spacecraft fault flag is set' FROM hs WHERE fault_flags <> 0)"""

ACK_HEX = "printf('%08X%02X%08X%016X', e, status, applied_value, timestamp_ns)"
HEALTH_HEX = (
    "printf('%016X%04X%04X%08X%02X%02X', timestamp_ns, mv, (centi_c + 65536) % 65536, "
    "(wheel_rpm + 4294967296) % 4294967296, mode, fault_flags)"
)
LEGACY_BYTES = LEGACY + "," + CRC_TABLE + f""",
lx AS (
  SELECT lp.*, printf('%04X%04X%04X', 2048 + apid, 49152 + sequence_count,
      (CASE WHEN apid=101 THEN 20 ELSE 21 END)::BIGINT) ||
    CASE WHEN apid=101 THEN {ACK_HEX} ELSE {HEALTH_HEX} END AS body_hex FROM lp),
ly AS (SELECT lx.*, {crc('body_hex')} AS true_crc FROM lx, crct),
lz AS (
  SELECT *, body_hex || printf('%08X', CASE WHEN bad_crc THEN xor(true_crc, 1::BIGINT) ELSE true_crc END) AS full_hex
  FROM ly),
lb AS (SELECT *, CASE WHEN cut THEN substr(full_hex, 1, length(full_hex) - 2) ELSE full_hex END AS raw_hex FROM lz)"""

COMMANDS = f"""
cm AS (
  SELECT event_id AS id, epoch_us(ts) + 731::BIGINT * {DAY_US} AS created_us,
    CASE WHEN event_id%17=0 THEN 'FORMAT_STORAGE' WHEN event_type='click' THEN 'SET_MODE'
      WHEN event_type='purchase' THEN 'SET_WHEEL_RPM' ELSE 'RESET_FAULTS' END AS name,
    CASE WHEN event_type='purchase' THEN (event_id*31)%14001 - 7000 WHEN event_type='click' THEN event_id%6
      ELSE event_id%2 END AS argument, event_id%3=0 AS dry_run
  FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events WHERE event_type IN ('click','purchase','view')),
cv0 AS (
  SELECT *, CASE name WHEN 'SET_MODE' THEN 1 WHEN 'SET_WHEEL_RPM' THEN 2 WHEN 'RESET_FAULTS' THEN 3 END::BIGINT AS opcode,
    CASE name WHEN 'SET_MODE' THEN 0 WHEN 'SET_WHEEL_RPM' THEN -6000 WHEN 'RESET_FAULTS' THEN 0 END AS lo,
    CASE name WHEN 'SET_MODE' THEN 3 WHEN 'SET_WHEEL_RPM' THEN 6000 WHEN 'RESET_FAULTS' THEN 0 END AS hi FROM cm),
cv AS (
  SELECT *, CASE WHEN opcode IS NULL THEN 'unsupported command: ' || name
      WHEN argument NOT BETWEEN lo AND hi
        THEN 'argument ' || argument || ' outside [' || lo || ', ' || hi || '] for ' || name END AS reason
  FROM cv0),
ok AS (
  SELECT *, CASE WHEN dry_run THEN 'DRY_RUN_VALIDATED' ELSE 'QUEUED' END AS first_status
  FROM cv WHERE reason IS NULL),
ak AS (
  SELECT id AS command_id, (CASE WHEN id%5=0 THEN 1 ELSE 0 END)::BIGINT AS status, id%100 AS applied_value,
    created_us + 2000000 AS at_us, id*2 + 1 AS ack_no FROM ok WHERE NOT dry_run AND id%2=0
  UNION ALL SELECT e, status, applied_value, received_ns // 1000, packet_no*2 FROM lp
    WHERE apid=101 AND packet_rejection IS NULL),
ce AS (
  SELECT id AS command_id, 0::BIGINT AS event_order, created_us + 1000000 AS at_us, 'command_status' AS subject,
    CASE WHEN id%19=0 THEN 'DISPATCH_ERROR' ELSE 'DISPATCHED' END AS status,
    CASE WHEN id%19=0 THEN 'send failed' ELSE 'UDP target spacecraft:5006' END AS detail
  FROM ok WHERE NOT dry_run
  UNION ALL SELECT command_id, 1, at_us, 'command_ack', CASE WHEN status=0 THEN 'ACKED' ELSE 'REJECTED' END,
    'spacecraft applied_value=' || applied_value FROM ak)"""
LEGACY_COMMANDS = LEGACY + "," + COMMANDS

FIELDS = (
    "protocol_version, payload_id, boot_id, sequence_number, timestamp_us, temperature_centi_c, "
    "voltage_mv, operating_mode, fault_flags"
)
_whole = lambda c: f"CASE WHEN whole THEN {c} END"
_whole_fields = ", ".join(f"{_whole(f)} AS {f}" for f in FIELDS.split(", "))

CANDIDATE_RESULTS = ledger() + f""",
cr AS (SELECT packet_id, e, {result_columns()} FROM pk),
sr AS (
  SELECT * REPLACE (CASE WHEN e%21<>0 THEN classification WHEN classification='NOMINAL' THEN 'WARNING'
    ELSE 'NOMINAL' END AS classification) FROM cr WHERE e%3=0)"""

_bounds = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
_rpm_hex = "printf('%08X', 0)"


def _window_start(ns: str, width_us: int) -> str:
    return f"(({ns} // 1000) // {width_us}) * {width_us}"


def _sliding(source: str, ns: str, labels: str, amount: str) -> str:
    """Five one-minute slides cover each event."""
    return f"""SELECT {_window_start(ns, 60000000)} - s * 60000000::BIGINT AS window_start_us, {labels},
      sum({amount})::BIGINT AS increase FROM {source}, range(5) r(s) GROUP BY ALL"""


def _islands(name: str, severity: str, label: str, source: str, ns: str, width: int) -> str:
    return f"""SELECT '{name}' AS rule, '{severity}' AS severity, label, min(tick) AS t0, max(tick) + {width} AS t1 FROM (
      SELECT *, sum(opens) OVER (PARTITION BY label ORDER BY tick) AS island FROM (
        SELECT label, tick, CASE WHEN tick - lag(tick) OVER (PARTITION BY label ORDER BY tick) <= {width}
          THEN 0 ELSE 1 END AS opens
        FROM (SELECT DISTINCT {label} AS label, ({ns} + 4999999999) // 5000000000 AS tick FROM {source})))
      GROUP BY label, island"""


ORACLES: dict[str, str] = {
    "deliveries": with_(BYTES, "SELECT delivery_id, received_us, request_id, content_type, raw_hex FROM b"),
    "receipt_ledger": with_(
        ledger("b", BYTES),
        f"""SELECT delivery_id AS receipt_id, request_id AS presented_request_id, request_id AS canonical_request_id,
          'local-token:vendor-simulator' AS identity, received_us, (length(raw_hex)//2)::BIGINT AS raw_body_size,
          sha256(unhex(raw_hex)) AS body_sha256, validation_status, rejection_reason,
          CASE WHEN origin_delivery_id IS NOT NULL THEN {packet_id_sql()} END AS parsed_packet_id,
          CASE WHEN request_state='CONFLICT' THEN first_delivery_id
            WHEN packet_state IN ('DUPLICATE','CONFLICT') THEN origin_delivery_id END AS duplicate_of_receipt_id,
          CASE WHEN origin_delivery_id IS NOT NULL THEN {packet_id_sql()} END AS logical_packet_id,
          CASE WHEN validation_status='ACCEPTED' THEN 'QUEUED' ELSE 'NOT_APPLICABLE' END AS queue_status
        FROM o WHERE NOT is_replay""",
    ),
    "quarantine": with_(
        ledger("b", BYTES),
        """SELECT delivery_id AS receipt_id, received_us, raw_hex AS raw_body, rejection_reason
        FROM o WHERE NOT is_replay AND validation_status='REJECTED'""",
    ),
    "security_rejected": with_(
        BOUNDARY, "SELECT event_id, occurred_us, event_name, actor_identity, outcome, reason FROM be"
    ),
    "audit_events": with_(AUDIT, "SELECT * FROM au"),
    "processed_upsert": with_(
        CANDIDATE_RESULTS,
        "SELECT * EXCLUDE (e) FROM sr UNION ALL SELECT * EXCLUDE (e) FROM cr WHERE packet_id NOT IN (SELECT packet_id FROM sr)",
    ),
    "result_conflicts": with_(
        CANDIDATE_RESULTS,
        """SELECT packet_id, sr.classification AS stored_classification, cr.classification AS candidate_classification
        FROM sr JOIN cr USING (packet_id) WHERE sr.classification <> cr.classification""",
    ),
    "legacy_packets": with_(LEGACY_BYTES, "SELECT packet_no, received_ns, source, raw_hex FROM lb"),
    "legacy_demux": with_(
        LEGACY,
        """SELECT packet_no, CASE WHEN packet_rejection IS NOT NULL THEN NULL WHEN apid=100 THEN 'telemetry.health'
          WHEN apid=101 THEN 'telemetry.command_ack' END AS subject,
          CASE WHEN packet_rejection IS NOT NULL THEN 'rejected' WHEN apid IN (100,101) THEN 'accepted'
            ELSE 'unsupported' END AS result,
          CASE WHEN packet_rejection IS NOT NULL THEN 'unknown' WHEN apid=100 THEN 'health'
            WHEN apid=101 THEN 'command_ack' ELSE apid::VARCHAR END AS apid_label FROM lp""",
    ),
    "legacy_envelope": with_(
        LEGACY,
        """SELECT packet_no, 'telemetry.health' AS subject, '{"apid":100,"sequence_count":' || sequence_count ||
          ',"received_ns":' || received_ns || ',"source":"' || source || '","data":{"timestamp_ns":' || timestamp_ns ||
          ',"bus_voltage_v":' || bus_voltage_v || ',"battery_temp_c":' || battery_temp_c || ',"wheel_rpm":' || wheel_rpm ||
          ',"mode":' || mode || ',"fault_flags":' || fault_flags || '}}' AS value FROM hs
        UNION ALL SELECT packet_no, 'telemetry.command_ack', '{"apid":101,"sequence_count":' || sequence_count ||
          ',"received_ns":' || received_ns || ',"source":"' || source || '","data":{"command_id":' || e ||
          ',"status":' || status || ',"applied_value":' || applied_value || ',"timestamp_ns":' || timestamp_ns || '}}'
        FROM lp WHERE apid=101 AND packet_rejection IS NULL""",
    ),
    "legacy_envelope_parse": with_(
        LEGACY + ", x AS (SELECT *, packet_no%97=0 OR packet_no%101=0 AS is_malformed FROM hs)",
        """SELECT packet_no, """
        + ", ".join(
            f"CASE WHEN NOT is_malformed THEN {c} END AS {c}"
            for c in ("timestamp_ns", "bus_voltage_v", "battery_temp_c", "wheel_rpm", "mode", "fault_flags", "sequence_count")
        )
        + ", is_malformed FROM x",
    ),
    "frame_decode": with_(
        BYTES,
        f"""SELECT delivery_id, {_whole_fields},
          {_whole("CASE WHEN bad_crc THEN xor(true_crc, 1::BIGINT) ELSE true_crc END")} AS wire_crc FROM b""",
    ),
    "frame_crc": with_(
        BYTES,
        f"SELECT delivery_id, {_whole('true_crc')} AS calculated_crc, {_whole('NOT bad_crc')} AS matches FROM b",
    ),
    "frame_encode": with_(
        FRAMES + "," + CRC_TABLE + f""",
        g AS (SELECT *, base_mv AS voltage_mv, false AS is_empty, false AS cut, false AS bad_crc FROM fr),
        g1 AS (SELECT g.*, {FRAME_BODY_HEX} AS body_hex, {reason()} AS encode_rejection FROM g)""",
        f"""SELECT e, encode_rejection, CASE WHEN encode_rejection IS NULL
          THEN body_hex || printf('%08X', {crc('body_hex')}) END AS raw_hex FROM g1, crct""",
    ),
    "packet_id": with_(
        DELIVERIES,
        f"""SELECT delivery_id, {_whole(packet_id_sql())} AS packet_id, whole AS is_id, false AS request_is_id FROM d""",
    ),
    "engineering_units": with_(
        DELIVERIES,
        f"""SELECT delivery_id, {_whole("temperature_centi_c / 100.0::DOUBLE")} AS temperature_c,
          {_whole("voltage_mv / 1000.0::DOUBLE")} AS voltage_v FROM d""",
    ),
    "sample_time": with_(
        DELIVERIES,
        f"SELECT delivery_id, {_whole('timestamp_us')} AS timestamp_us, {_whole(iso('timestamp_us'))} AS sample_time FROM d",
    ),
    "fault_names": with_(
        DELIVERIES,
        f"SELECT delivery_id, {_whole('fault_flags')} AS fault_flags, {_whole(FAULTS)} AS fault_names FROM d",
    ),
    "health_temperature": with_(DELIVERIES, f"SELECT delivery_id, {_whole(T_CLASS)} AS temperature_class FROM d"),
    "health_voltage": with_(DELIVERIES, f"SELECT delivery_id, {_whole(V_CLASS)} AS voltage_class FROM d"),
    "health_faults": with_(
        DELIVERIES,
        f"SELECT delivery_id, CASE WHEN whole AND fault_flags < 64 THEN {F_CLASS} END AS fault_class FROM d",
    ),
    "freshness": with_(
        DELIVERIES + f", x AS (SELECT *, {reason()} AS r FROM d)",
        f"SELECT delivery_id, CASE WHEN received_us - timestamp_us > {DAY_US} THEN 'STALE' ELSE 'CURRENT' END AS freshness FROM x WHERE r IS NULL",
    ),
    "health_assessment": with_(
        DELIVERIES + f", x AS (SELECT *, {reason()} AS r FROM d)",
        f"""SELECT delivery_id, {T_CLASS} AS temperature_class, {V_CLASS} AS voltage_class, {F_CLASS} AS fault_class,
          CASE WHEN received_us - timestamp_us > {DAY_US} THEN 'STALE' ELSE 'CURRENT' END AS freshness,
          {WORST} AS classification FROM x WHERE r IS NULL""",
    ),
    "processed": with_(ledger(), f"SELECT packet_id, {result_columns()} FROM pk"),
    "scaled_wire_units": """WITH x AS (
        SELECT event_id AS e, (CASE WHEN event_id%7=0 THEN '-' ELSE '' END) || (event_id//10000) || '.' ||
          printf('%04d', event_id%10000) AS display, CASE WHEN event_id%7=0 THEN -1 ELSE 1 END AS sign
        FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events)
      SELECT e, display, (sign * ((e + 50) // 100))::BIGINT AS centi, (sign * ((e + 5) // 10))::BIGINT AS milli FROM x""",
    "legacy_decode": with_(
        LEGACY_BYTES,
        """SELECT packet_no, 0::BIGINT AS packet_version, 0::BIGINT AS packet_type, apid, sequence_count,
          (CASE WHEN apid=101 THEN 20 ELSE 21 END)::BIGINT AS data_length,
          substr(raw_hex, 13, length(raw_hex) - 20) AS payload_hex FROM lb""",
    ),
    "legacy_health": with_(
        LEGACY,
        """SELECT packet_no, received_ns, sequence_count, timestamp_ns, bus_voltage_v, battery_temp_c, wheel_rpm, mode,
          fault_flags FROM hs""",
    ),
    "legacy_ack": with_(
        LEGACY,
        """SELECT packet_no, received_ns, sequence_count, e AS command_id, status, applied_value, timestamp_ns
        FROM lp WHERE apid=101 AND packet_rejection IS NULL""",
    ),
    "legacy_encode": with_(
        LEGACY + "," + CRC_TABLE + f""",
        x AS (SELECT e, printf('%04X%04X0015', 2148, 49152 + sequence_count) || {HEALTH_HEX} AS body_hex FROM lp)""",
        f"SELECT e, body_hex || printf('%08X', {crc('body_hex')}) AS raw_hex FROM x, crct",
    ),
    "legacy_command_frame": with_(
        LEGACY_COMMANDS,
        """SELECT id AS frame_no, CASE WHEN id%31<>0 THEN id END AS command_id,
          CASE WHEN id%31<>0 THEN coalesce(opcode, 0) END AS opcode, CASE WHEN id%31<>0 THEN argument END AS argument,
          CASE WHEN id%31<>0 THEN (created_us + 1000000) * 1000 END AS issued_ns,
          CASE WHEN id%31=0 THEN 'INVALID_COMMAND_LENGTH' WHEN id%29=0 THEN 'CRC_MISMATCH' END AS command_rejection
        FROM cv WHERE NOT dry_run""",
    ),
    "limit_violations": with_(LEGACY, "SELECT * FROM al"),
    "rejection_reason": with_(DELIVERIES, f"SELECT delivery_id, {reason()} AS frame_rejection FROM d"),
    "header_validation": with_(DELIVERIES, f"SELECT delivery_id, {HEADER} AS header_rejection FROM d"),
    "delivery_outcome": with_(
        ledger(),
        """SELECT delivery_id, is_replay, validation_status, rejection_reason,
          (CASE WHEN request_state='CONFLICT' THEN 409 WHEN header_rejection IS NOT NULL AND NOT is_replay THEN 400
            WHEN validation_status='REJECTED' THEN 422 WHEN validation_status='CONFLICT' THEN 409
            WHEN is_replay OR validation_status='DUPLICATE' THEN 200 ELSE 202 END)::BIGINT AS response_code,
          origin_delivery_id FROM o""",
    ),
    "legacy_rejection": with_(LEGACY, "SELECT packet_no, packet_rejection FROM lp"),
    "command_validation": with_(
        COMMANDS.split("ok AS")[0].rstrip().rstrip(","),
        """SELECT id, name, argument, dry_run, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'invalid' END AS result,
          reason, CASE WHEN reason IS NULL THEN CASE WHEN dry_run THEN 'DRY_RUN_VALIDATED' ELSE 'QUEUED' END END AS status,
          opcode FROM cv""",
    ),
    "constraint_report": with_(
        work(ledger()) + ", u AS (SELECT * FROM d WHERE whole)",
        """SELECT table_name, rule, violations::BIGINT AS violations FROM (
          SELECT 'receipts' AS table_name, unnest(['body_size','validation_status','queue_status']) AS rule, 0 AS violations
          UNION ALL SELECT 'packets', 'payload_positive', count(*) FILTER (payload_id <= 0) FROM u
          UNION ALL SELECT 'packets', 'boot_positive', count(*) FILTER (boot_id <= 0) FROM u
          UNION ALL SELECT 'packets', 'sequence_u32', 0
          UNION ALL SELECT 'packets', 'missing_nonnegative', 0
          UNION ALL SELECT 'packets', 'disposition', count(*) FILTER (delivery_id%45=0) FROM u
          UNION ALL SELECT 'sequence_states', unnest(['high_water_u32','accepted_nonnegative','missing_nonnegative']), 0
          UNION ALL SELECT 'jobs', unnest(['attempts_nonnegative','max_attempts_positive','state']), 0
          UNION ALL SELECT 'processed', 'classification', 0)""",
    ),
    "raw_view": with_(
        work(ledger("b", BYTES)),
        f"""SELECT pk.packet_id AS message_id, delivery_id AS receipt_id, lower(raw_hex) AS raw_hex,
          sha256(unhex(raw_hex)) AS body_sha256, {iso('received_us')} AS received_at, protocol_version,
          printf('PAYLOAD-%02d', payload_id) AS payload_id, boot_id, sequence_number,
          {iso('timestamp_us')} AS sample_time, sequence_disposition, missing_before, state AS processing_state
        FROM pk LEFT JOIN js ON js.packet_id = pk.packet_id""",
    ),
    "processed_view": with_(
        work(ledger()) + f", cr AS (SELECT packet_id, {result_columns()} FROM pk)",
        f"""SELECT js.packet_id AS message_id, temperature_c, voltage_v, operating_mode, fault_names, classification,
          CASE WHEN is_stale THEN 'STALE' WHEN NOT is_stale THEN 'CURRENT' END AS freshness, processor_version,
          CASE WHEN state='COMPLETE' THEN {iso('completed_us')} END AS processed_at,
          CASE WHEN state<>'COMPLETE' THEN state END AS processing_state,
          (CASE state WHEN 'COMPLETE' THEN 200 WHEN 'FAILED' THEN 422 ELSE 202 END)::BIGINT AS response_code
        FROM js LEFT JOIN cr ON cr.packet_id = js.packet_id AND state='COMPLETE'""",
    ),
    "duplicate_links": with_(
        ledger(),
        f"""SELECT delivery_id AS receipt_id, packet_state AS link, origin_delivery_id AS original_receipt_id,
          {packet_id_sql()} AS packet_id, 'JOB-' || {packet_id_sql()} AS job_id
        FROM o WHERE NOT is_replay AND packet_state IN ('DUPLICATE','CONFLICT')""",
    ),
    "command_acks": with_(
        LEGACY_COMMANDS,
        """SELECT command_id, name, ack_no, CASE WHEN status=0 THEN 'ACKED' ELSE 'REJECTED' END AS new_status,
          'spacecraft applied_value=' || applied_value AS detail FROM ak JOIN ok ON id = command_id""",
    ),
    "orphan_acks": with_(LEGACY_COMMANDS, "SELECT * FROM ak WHERE command_id NOT IN (SELECT id FROM ok)"),
    "consistency_check": with_(
        ledger(),
        """SELECT packet_id, delivery_id AS source_receipt_id,
          concat_ws('|', CASE WHEN e%50=0 THEN 'voltage_mv' END, CASE WHEN e%77=0 THEN 'operating_mode' END) AS differing
        FROM pk WHERE e%50=0 OR e%77=0""",
    ),
    "fk_violations": with_(
        AUDIT + "," + RECEIPTS + "," + STATE + f""",
        r2 AS (SELECT receipt_id FROM rc WHERE receipt_id%97<>0),
        p2 AS (SELECT * FROM pk WHERE boot_id%31<>0),
        done AS (SELECT packet_id, job_id FROM js WHERE state='COMPLETE'),
        refs AS (
          SELECT 'receipt_duplicate_of' AS c, duplicate_of_receipt_id::VARCHAR AS k FROM rc WHERE receipt_id%97<>0
          UNION ALL SELECT 'identity_first_receipt', min_by(delivery_id, received_us * 8 + copy)::VARCHAR FROM d
            WHERE request_id IS NOT NULL GROUP BY request_id
          UNION ALL SELECT 'packet_source_receipt', delivery_id::VARCHAR FROM p2
          UNION ALL SELECT 'audit_receipt', receipt_id::VARCHAR FROM au),
        refp AS (
          SELECT 'state_high_water_packet' AS c, printf('TLM-P%02d-B%08X-S%08X', payload_id, boot_id, high_water_sequence) AS k FROM ss
          UNION ALL SELECT 'job_packet', packet_id FROM jb
          UNION ALL SELECT 'processed_packet', packet_id FROM done
          UNION ALL SELECT 'audit_packet', packet_id FROM au)""",
        """SELECT c AS constraint_name, k AS missing_key, count(*) AS child_rows FROM refs
        WHERE k IS NOT NULL AND k NOT IN (SELECT receipt_id::VARCHAR FROM r2) GROUP BY ALL
        UNION ALL SELECT c, k, count(*) FROM refp
        WHERE k IS NOT NULL AND k NOT IN (SELECT packet_id FROM p2) GROUP BY ALL""",
    ),
    "lookup_command": with_(
        LEGACY_COMMANDS,
        """SELECT a.id, name, argument, first_status AS status, (CASE WHEN ok.id IS NULL THEN 404 ELSE 200 END)::BIGINT AS response_code
        FROM (SELECT DISTINCT command_id AS id FROM ak) a LEFT JOIN ok ON ok.id = a.id""",
    ),
    "service_counters": with_(
        work(ledger()) + "," + BOUNDARY,
        f"""SELECT counter, value::BIGINT AS value FROM (
          SELECT 'payload_messages_received_total' AS counter, count(*) AS value FROM o
          UNION ALL SELECT 'payload_messages_rejected_total', count(*) FROM o
            WHERE validation_status IN ('REJECTED','CONFLICT') AND NOT is_replay
          UNION ALL SELECT 'payload_duplicate_messages_total', count(*) FROM o WHERE packet_state='DUPLICATE'
          UNION ALL SELECT 'payload_sequence_gaps_total', sum(missing_before) FROM pk
          UNION ALL SELECT 'payload_processing_successes_total', count(*) FROM att WHERE outcome='success'
          UNION ALL SELECT 'payload_processing_failures_total', count(*) FROM att WHERE outcome<>'success'
          UNION ALL SELECT 'payload_stale_results_total', count(*) FROM pk JOIN js USING (packet_id)
            WHERE state='COMPLETE' AND received_us - timestamp_us > {DAY_US}
          UNION ALL SELECT 'vendor_authentication_failures_total', count(*) FROM bd WHERE kind=3
          UNION ALL SELECT 'database_errors_total', 0)""",
    ),
    "rejection_breakdown": with_(
        ledger(),
        "SELECT validation_status, rejection_reason, count(*) AS receipts FROM o WHERE NOT is_replay GROUP BY ALL",
    ),
    "queue_depth": with_(
        work(ledger(), True),
        "SELECT count(*) AS payload_processing_queue_depth FROM js WHERE state NOT IN ('COMPLETE','FAILED')",
    ),
    "job_status": with_(work(ledger(), True), "SELECT * FROM js"),
    "sequence_state": with_(
        ledger() + "," + STATE,
        "SELECT *, printf('TLM-P%02d-B%08X-S%08X', payload_id, boot_id, high_water_sequence) AS last_high_water_packet_id FROM ss",
    ),
    "legacy_ingest_counts": with_(
        LEGACY,
        """SELECT CASE WHEN packet_rejection IS NOT NULL THEN 'rejected' WHEN apid IN (100,101) THEN 'accepted'
            ELSE 'unsupported' END AS result,
          CASE WHEN packet_rejection IS NOT NULL THEN 'unknown' WHEN apid=100 THEN 'health'
            WHEN apid=101 THEN 'command_ack' ELSE apid::VARCHAR END AS apid_label, count(*) AS packets
        FROM lp GROUP BY ALL""",
    ),
    "legacy_gap_totals": with_(LEGACY, "SELECT apid, sum(gap)::BIGINT AS missing FROM gaps GROUP BY apid"),
    "latency_histogram": with_(
        LEGACY
        + ", x AS (SELECT greatest(received_ns - timestamp_ns, 0) AS ns FROM hs), y AS (SELECT count(*) AS n, sum(ns)::BIGINT AS total FROM x)",
        " UNION ALL ".join(
            f"SELECT '{b}' AS le_ms, (SELECT count(*) FROM x WHERE ns <= {b}000000) AS cumulative, n AS observations, total AS total_ns FROM y"
            for b in _bounds
        )
        + " UNION ALL SELECT '+Inf', n, n, total FROM y",
    ),
    "alert_counts": with_(LEGACY, "SELECT severity, parameter, count(*) AS alerts FROM al GROUP BY ALL"),
    "latest_gauges": with_(
        LEGACY,
        """SELECT bus_voltage_v AS latest_bus_voltage_v, battery_temp_c AS latest_battery_temp_c FROM hs
        ORDER BY received_ns DESC, packet_no DESC LIMIT 1""",
    ),
    "command_counters": with_(
        LEGACY_COMMANDS,
        """SELECT 'mission_api_command_requests_total' AS metric, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'invalid' END AS label_1,
          dry_run::VARCHAR AS label_2, count(*) AS value FROM cv GROUP BY ALL
        UNION ALL SELECT 'command_dispatch_total', CASE WHEN ce.status='DISPATCHED' THEN 'sent' ELSE 'error' END, name, count(*)
        FROM ce JOIN ok ON id = command_id WHERE ce.event_order=0 GROUP BY ALL
        UNION ALL SELECT 'processor_messages_total', subject, 'ok', count(*) FROM ce GROUP BY ALL
        UNION ALL SELECT 'processor_messages_total', 'health', CASE WHEN packet_no%97=0 OR packet_no%101=0 THEN 'error' ELSE 'ok' END,
          count(*) FROM hs GROUP BY ALL""",
    ),
    "request_identity": with_(ledger(), "SELECT delivery_id, request_state, first_delivery_id FROM v"),
    "packet_identity": with_(ledger(), "SELECT delivery_id, packet_state, origin AS origin_delivery_id FROM st"),
    "sequence_disposition": with_(
        ledger(),
        """SELECT payload_id, boot_id, sequence_number, received_us, delivery_id, sequence_disposition, missing_before,
          high_water_before FROM pk""",
    ),
    "wide_sequence_state": """
      WITH n AS (
        SELECT DISTINCT l_linenumber::BIGINT AS boot_id, l_orderkey AS k,
          CASE WHEN l_orderkey % 1009 = 0 THEN [0, 1, 3][(l_orderkey // 1009) % 3 + 1]::BIGINT * 1073741824 + l_orderkey
               ELSE 3221225471 - l_orderkey END AS s FROM lineitem),
      l AS (SELECT boot_id, count(*) AS n, list({'h': s, 'missing': 0::BIGINT, 'late': 0::BIGINT} ORDER BY k) AS x
            FROM n GROUP BY boot_id),
      f AS (SELECT boot_id, n, x[1].h AS first, list_reduce(x, lambda a, b:
          CASE WHEN (b.h - a.h + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647
               THEN {'h': b.h, 'missing': a.missing + (b.h - a.h + 4294967296) % 4294967296 - 1, 'late': a.late}
               ELSE {'h': a.h, 'missing': a.missing, 'late': a.late + 1} END) AS r FROM l)
      SELECT boot_id, r.h AS high_water_sequence, n AS accepted_packet_count, first + r.missing AS missing_packet_count,
        r.late AS late_packet_count FROM f""",
    "sequence_decision": with_(
        ledger(),
        """SELECT delivery_id, payload_id, boot_id, sequence_number, disposition, missing_count,
          disposition <> 'CONFLICT' AS accepted, disposition NOT IN ('CONFLICT','DUPLICATE') AS should_queue,
          disposition NOT IN ('CONFLICT','DUPLICATE','LATE_OR_OUT_OF_ORDER') AS should_advance_high_water
        FROM (SELECT st.delivery_id, st.payload_id, st.boot_id, st.sequence_number,
            CASE WHEN st.packet_state <> 'PACKET' THEN st.packet_state
              WHEN sequence_disposition='FIRST' THEN CASE WHEN st.sequence_number=0 THEN 'FIRST_IN_ORDER' ELSE 'FIRST_WITH_GAP' END
              WHEN sequence_disposition='LATE' THEN 'LATE_OR_OUT_OF_ORDER' ELSE sequence_disposition END AS disposition,
            coalesce(missing_before, 0)::BIGINT AS missing_count
          FROM st LEFT JOIN pk USING (delivery_id))""",
    ),
    "missing_ranges": with_(
        ledger(),
        """SELECT payload_id, boot_id, sequence_number, CASE WHEN h IS NULL THEN 0 ELSE h + 1 END AS missing_from,
          sequence_number - 1 AS missing_to, missing_before AS missing_count FROM pk WHERE missing_before > 0""",
    ),
    "legacy_sequence_gap": with_(LEGACY, "SELECT packet_no, apid, sequence_count, previous_count, gap FROM gaps"),
    "command_status": with_(
        LEGACY_COMMANDS
        + ", lc AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY command_id ORDER BY at_us DESC, event_order DESC) = 1)",
        """SELECT id, name, argument, coalesce(lc.status, first_status) AS status, detail AS status_detail,
          coalesce(at_us, created_us) AS updated_us FROM ok LEFT JOIN lc ON id = command_id""",
    ),
    "packet_timeline": with_(
        AUDIT,
        """SELECT packet_id, occurred_us, event_id, event_name, outcome,
          lag(outcome) OVER (PARTITION BY packet_id ORDER BY occurred_us, event_id) AS previous_outcome
        FROM au WHERE packet_id IS NOT NULL""",
    ),
    "latest_telemetry": with_(
        LEGACY,
        """SELECT received_ns, packet_no, timestamp_ns, sequence_count, bus_voltage_v, battery_temp_c, wheel_rpm, mode,
          fault_flags FROM hs ORDER BY received_ns DESC, packet_no DESC LIMIT 500""",
    ),
    "latest_alerts": with_(
        LEGACY, "SELECT * FROM al ORDER BY created_ns DESC, packet_no DESC, parameter LIMIT 500"
    ),
    "latest_audit": with_(AUDIT, "SELECT * FROM au ORDER BY occurred_us DESC, event_id DESC LIMIT 1000"),
    "pending_jobs": with_(
        work(ledger(), True),
        """SELECT job_id, state, created_us, next_attempt_us FROM js WHERE state='PENDING_QUEUE'
          OR (state='RETRY_WAIT' AND next_attempt_us <= 1769904000000000) ORDER BY created_us, job_id LIMIT 1000""",
    ),
    "recoverable_jobs": with_(
        work(ledger(), True),
        """SELECT job_id, state, created_us, next_attempt_us FROM js WHERE state IN ('PENDING_QUEUE','QUEUED')
          OR (state='RETRY_WAIT' AND next_attempt_us <= 1769904000000000) ORDER BY created_us, job_id LIMIT 10000""",
    ),
    "operator_feed": with_(
        LEGACY + """,
        fv AS (SELECT packet_no, parameter FROM al QUALIFY row_number() OVER (PARTITION BY packet_no ORDER BY
          CASE parameter WHEN 'bus_voltage_v' THEN 1 WHEN 'battery_temp_c' THEN 2 WHEN 'wheel_rpm' THEN 3 ELSE 4 END) = 1)""",
        """SELECT 'telemetry.processed' AS subject, hs.packet_no, parameter, NULL AS severity, wheel_rpm
        FROM hs LEFT JOIN fv ON fv.packet_no = hs.packet_no
        UNION ALL SELECT 'alerts.limit', packet_no, parameter, severity, NULL FROM al
        UNION ALL SELECT 'advisories.limit', e, NULL, 'INFO', NULL FROM lp WHERE event_type='error' AND e%31=0""",
    ),
    "legacy_processed": with_(
        LEGACY,
        """SELECT packet_no, sequence_count, len(v)::BIGINT AS violation_count, array_to_string(v, '|') AS violations FROM (
          SELECT packet_no, sequence_count, list_filter([
            CASE WHEN mv < 24000 THEN 'bus_voltage_v:CRITICAL' WHEN mv < 26000 THEN 'bus_voltage_v:WARNING' END,
            CASE WHEN centi_c > 6500 THEN 'battery_temp_c:CRITICAL' WHEN centi_c > 5500 THEN 'battery_temp_c:WARNING' END,
            CASE WHEN abs(wheel_rpm) > 5500 THEN 'wheel_rpm:CRITICAL' END,
            CASE WHEN fault_flags <> 0 THEN 'fault_flags:CRITICAL' END], lambda x: x IS NOT NULL) AS v FROM hs)""",
    ),
    "frame_rate": with_(
        LEGACY,
        f"""SELECT {_window_start('received_ns', 60000000)} AS window_start_us, count(*) AS frames,
          count(*) / 60.0::DOUBLE AS frames_per_second FROM hs GROUP BY 1""",
    ),
    "gap_increase": with_(LEGACY, _sliding("gaps", "received_ns", "apid", "gap") + " HAVING sum(gap) > 0"),
    "alert_increase": with_(LEGACY, _sliding("al", "created_ns", "severity", "1")),
    "telemetry_series": with_(
        LEGACY,
        f"""SELECT {_window_start('received_ns', 60000000)} AS window_start_us,
          sum(mv)::BIGINT::DOUBLE / count(*)::DOUBLE / 1000.0::DOUBLE AS mean_bus_voltage_v,
          sum(centi_c)::BIGINT::DOUBLE / count(*)::DOUBLE / 100.0::DOUBLE AS mean_battery_temp_c,
          arg_max(bus_voltage_v, (received_ns, packet_no)) AS last_bus_voltage_v,
          arg_max(battery_temp_c, (received_ns, packet_no)) AS last_battery_temp_c FROM hs GROUP BY 1""",
    ),
    "alert_rules": with_(
        LEGACY,
        "SELECT rule, severity, label, (t0 * 5000000)::BIGINT AS start_us, (t1 * 5000000)::BIGINT AS end_us FROM ("
        + """SELECT 'TelemetryStopped' AS rule, 'critical' AS severity, 'health' AS label, p + 18 AS t0, tick AS t1 FROM (
            SELECT tick, lag(tick) OVER (ORDER BY tick) AS p FROM (
              SELECT DISTINCT (received_ns + 4999999999) // 5000000000 AS tick FROM hs)) WHERE p + 18 < tick UNION ALL
          SELECT 'TelemetryStopped', 'critical', 'health', p + 18, NULL FROM (
            SELECT max((received_ns + 4999999999) // 5000000000) AS p FROM hs) WHERE (p + 18) * 5000000 <= 1769904000000000 UNION ALL """
        + _islands("TelemetrySequenceGap", "warning", "apid::VARCHAR", "(SELECT * FROM gaps WHERE gap > 0)", "received_ns", 60)
        + " UNION ALL "
        + _islands("CriticalVehicleLimit", "critical", "parameter", "(SELECT * FROM al WHERE severity='CRITICAL')", "created_ns", 12)
        + ")",
    ),
    "session_health": with_(
        ledger() + "," + STATE + f", g AS (SELECT *, {WORST} AS cls FROM pk)",
        f"""SELECT ss.*, printf('TLM-P%02d-B%08X-S%08X', ss.payload_id, ss.boot_id, high_water_sequence) AS last_high_water_packet_id,
          a.* EXCLUDE (payload_id, boot_id) FROM ss JOIN (SELECT payload_id, boot_id,
            count(*) FILTER (cls='NOMINAL') AS nominal_packets, count(*) FILTER (cls='WARNING') AS warning_packets,
            count(*) FILTER (cls='CRITICAL') AS critical_packets,
            count(*) FILTER (received_us - timestamp_us > {DAY_US}) AS stale_packets
          FROM g GROUP BY ALL) a ON a.payload_id = ss.payload_id AND a.boot_id = ss.boot_id""",
    ),
    "codec_round_trip": """WITH x AS (
        SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, l_partkey::BIGINT % 30000 AS mv FROM lineitem)
      SELECT count(*) AS packets, sum((k*8 + n) % 16384)::BIGINT AS sum_count, sum(k*1000 + n)::BIGINT AS sum_ns,
        sum(mv)::BIGINT AS sum_mv, sum(mv - 15000)::BIGINT AS sum_centi_c, sum(mv*3 - 45000)::BIGINT AS sum_rpm,
        sum(n % 4)::BIGINT AS sum_mode FROM x""",
}

# -- version 1 commands and acknowledgements (FIXTURES.md B.6) ------------------


def _uuid_sql(number: str, tail: int) -> str:
    return f"printf('%08x-0000-4000-8000-%012x', {number}, {tail}::BIGINT)"


V1_COMMANDS = f"""
ic AS (
  SELECT event_id AS e, event_type, {_uuid_sql('event_id', 7)} AS command_id,
    (CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END)::BIGINT AS opcode,
    epoch_us(ts) + 731::BIGINT * {DAY_US} AS issued_us,
    CASE WHEN event_type='click' THEN 30 ELSE 10 END * 1000000::BIGINT AS life_us,
    CASE WHEN event_type='click' THEN event_id%3 END AS argument
  FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events WHERE event_type IN ('click','purchase','view')),
cf AS (
  SELECT *, e%31<>0 AS whole, (CASE WHEN e%37=0 THEN 2 ELSE 1 END) AS version,
    (CASE WHEN e%47=0 THEN 2 ELSE 1 END)::BIGINT AS payload_id, (CASE WHEN e%53=0 THEN 9 ELSE opcode END)::BIGINT AS op,
    (CASE WHEN e%59=0 THEN 2 WHEN argument IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS arg_len,
    (CASE WHEN e%43=0 THEN 1 ELSE 0 END)::BIGINT AS reserved,
    CASE WHEN e%67=0 THEN issued_us ELSE issued_us + life_us END AS expires_us,
    CASE WHEN e%61=0 AND argument IS NOT NULL THEN 7 ELSE argument END AS arg,
    issued_us + (CASE WHEN e%73=0 THEN 45 WHEN e%79=0 THEN -3 ELSE 1 END) * 1000000::BIGINT AS at_us
  FROM ic),
cg AS (
  SELECT *, CASE WHEN version<>1 THEN 'UNSUPPORTED_PROTOCOL_VERSION' WHEN NOT whole THEN 'INVALID_FRAME_LENGTH'
      WHEN e%29=0 THEN 'CRC_MISMATCH' WHEN e%41=0 THEN 'INVALID_FRAME_TYPE' WHEN reserved<>0 THEN 'RESERVED_BYTE_SET'
      WHEN payload_id<>1 THEN 'WRONG_PAYLOAD_ID' WHEN op=9 THEN 'UNKNOWN_OPCODE'
      WHEN e%59=0 THEN 'INVALID_ARGUMENT_LENGTH' WHEN arg > 2 THEN 'INVALID_ARGUMENT_VALUE'
      WHEN e%67=0 THEN 'INVALID_EXPIRY' END AS frame_rejection
  FROM cf)"""

V1_ACKS = V1_COMMANDS + f""",
av AS (
  SELECT e, k, opcode, issued_us, e*4 + k AS ack_no, e%29=0 AS orphan,
    CASE WHEN e%29=0 THEN {_uuid_sql('e', 9)} ELSE command_id END AS command_id,
    (CASE WHEN e%7=0 AND k=2 THEN 3 WHEN k=2 THEN 4 ELSE k+1 END)::BIGINT AS ack_type,
    (CASE WHEN e%7=0 AND k=2 THEN CASE WHEN e%2=0 THEN 10 ELSE 7 END ELSE 0 END)::BIGINT AS reason_code,
    e%5 + 1 AS boot_id,
    issued_us + (CASE WHEN e%17=0 AND k=2 THEN 60 ELSE k+1 END) * 1000000::BIGINT AS event_us
  FROM ic JOIN (VALUES (0),(1),(2)) s(k) ON k=0 OR (k=1 AND e%13<>0 AND e%11<>0) OR (k=2 AND e%13<>0)),
ar AS (SELECT *, row_number() OVER (PARTITION BY boot_id ORDER BY ack_no) - 1 AS rn FROM av),
ad AS (
  SELECT ar.*, copy, rn + rn // 9 AS sequence_number, ack_no*4 + copy AS delivery_id,
    event_us + (CASE copy WHEN 1 THEN 30 WHEN 2 THEN 40 ELSE 0 END) * 1000000::BIGINT AS received_us,
    event_us + (CASE WHEN copy=2 THEN 1 ELSE 0 END) AS sent_us,
    CASE WHEN ack_no%31=0 THEN opcode%3 + 1 ELSE opcode END AS op,
    (CASE WHEN ack_no%37=0 THEN 99 ELSE reason_code END)::BIGINT AS rcode
  FROM ar JOIN (VALUES (0),(1),(2)) c(copy) ON copy=0 OR (copy=1 AND ack_no%17=0) OR (copy=2 AND ack_no%19=0)),
an AS (
  SELECT *, CASE WHEN ack_no%23=0 THEN 'CRC_MISMATCH' WHEN ack_no%37=0 THEN 'INVALID_REASON_CODE' END AS frame_rejection FROM ad),
ai AS (
  SELECT *, first_value(delivery_id) OVER w AS origin, first_value(sent_us) OVER w AS first_sent
  FROM an WHERE frame_rejection IS NULL
  WINDOW w AS (PARTITION BY boot_id, sequence_number ORDER BY received_us, delivery_id)),
au1 AS (SELECT * FROM ai WHERE delivery_id = origin)"""

V1_EVENTS = V1_ACKS + """,
se AS (
  SELECT command_id, e*16 + k AS event_no, issued_us AS at_us, event, NULL::VARCHAR AS reason
  FROM ic, (VALUES (0,'VALIDATED'),(1,'QUEUED'),(2,'SENT')) g(k, event)
  UNION ALL SELECT command_id, e*16 + 5, issued_us, 'SENT', NULL FROM ic WHERE (e*16 + 2)%3=0
  UNION ALL SELECT command_id, e*16 + 8 + k, event_us, ['RECEIVED','ACCEPTED','REJECTED','EXECUTED'][ack_type],
    CASE reason_code WHEN 10 THEN 'EXECUTION_ABORTED' WHEN 7 THEN 'MODE_INHIBIT' END FROM av WHERE NOT orphan
  UNION ALL SELECT command_id, e*16 + 6 + k, issued_us + 6000000, event, NULL
    FROM ic, (VALUES (0,'TIMED_OUT'),(1,'UNKNOWN')) g(k, event) WHERE e%17=0),
sl AS (
  SELECT command_id, list({'n': event_no, 't': at_us, 'e': event, 'r': coalesce(reason, '')} ORDER BY event_no) AS evs
  FROM se GROUP BY command_id),
-- the path as text: state@event@time;...
sw AS (
  SELECT command_id, list_reduce(list_prepend('CREATED@-1@0',
      list_transform(evs, lambda x: x.e || '@' || x.n || '@' || x.t || '@' || x.r)),
    lambda acc, x: CASE WHEN
      list_contains(CASE split_part(split_part(acc, ';', -1), '@', 1)
        WHEN 'CREATED' THEN ['VALIDATED'] WHEN 'VALIDATED' THEN ['QUEUED'] WHEN 'QUEUED' THEN ['SENT']
        WHEN 'SENT' THEN ['RECEIVED','ACCEPTED','EXECUTED','REJECTED','TIMED_OUT']
        WHEN 'RECEIVED' THEN ['ACCEPTED','EXECUTED','REJECTED','TIMED_OUT']
        WHEN 'ACCEPTED' THEN ['EXECUTED','REJECTED','TIMED_OUT'] WHEN 'TIMED_OUT' THEN ['UNKNOWN']
        WHEN 'UNKNOWN' THEN (CASE WHEN split_part(x, '@', 4)='EXECUTION_ABORTED' THEN ['EXECUTED']
          ELSE ['EXECUTED','REJECTED'] END)
        ELSE ['-'] END, split_part(x, '@', 1)) THEN acc || ';' || x ELSE acc END) AS path FROM sl),
sp AS (SELECT command_id, unnest(string_split(path, ';')) AS x, generate_subscripts(string_split(path, ';'), 1) AS i FROM sw),
sh0 AS (
  SELECT command_id, split_part(x, '@', 2)::BIGINT AS event_no, split_part(x, '@', 3)::BIGINT AS at_us,
    split_part(x, '@', 1) AS to_state, i FROM sp),
sh1 AS (
  SELECT *, lag(to_state) OVER w AS from_state, lead(at_us) OVER w AS next_us FROM sh0
  WINDOW w AS (PARTITION BY command_id ORDER BY i)),
sh AS (SELECT * FROM sh1 WHERE event_no >= 0)"""

_cmd = lambda c: f"CASE WHEN whole THEN {c} END"

ORACLES |= {
    "command_frame_v1": with_(
        V1_COMMANDS,
        f"""SELECT e AS frame_no, {_cmd('command_id')} AS command_id, {_cmd('payload_id')} AS payload_id, {_cmd('op')} AS opcode,
          {_cmd('arg_len')} AS argument_length, {_cmd('reserved')} AS reserved, {_cmd('issued_us')} AS issued_us,
          {_cmd('expires_us')} AS expires_us, {_cmd('arg')} AS argument, frame_rejection,
          CASE WHEN frame_rejection IS NULL THEN CASE WHEN issued_us > at_us + 2000000 THEN 'CLOCK_SKEW'
            WHEN at_us > expires_us + 2000000 THEN 'COMMAND_EXPIRED' END END AS clock_rejection FROM cg""",
    ),
    "ack_frame_v1": with_(
        V1_ACKS,
        """SELECT delivery_id, received_us, command_id, 1::BIGINT AS payload_id, op AS opcode, ack_type, 0::BIGINT AS reserved,
          rcode AS reason_code, boot_id, sequence_number, sent_us AS event_us, frame_rejection FROM an""",
    ),
    "ack_identity": with_(
        V1_ACKS,
        """SELECT delivery_id, CASE WHEN delivery_id=origin THEN 'ACK' WHEN sent_us=first_sent THEN 'DUPLICATE'
          ELSE 'ACK_SEQUENCE_CONFLICT' END AS ack_state, origin AS origin_delivery_id FROM ai""",
    ),
    "ack_sequence": with_(
        V1_ACKS + """, q AS (SELECT *, max(sequence_number) OVER (PARTITION BY boot_id ORDER BY received_us, delivery_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM au1)""",
        """SELECT 1::BIGINT AS payload_id, boot_id, sequence_number, received_us, delivery_id,
          CASE WHEN h IS NULL THEN 'FIRST' WHEN sequence_number=h+1 THEN 'IN_ORDER' WHEN sequence_number>h THEN 'GAP'
            ELSE 'LATE' END AS sequence_disposition,
          CASE WHEN h IS NULL THEN sequence_number WHEN sequence_number>h THEN sequence_number-h-1 ELSE 0 END AS missing_before,
          CASE WHEN sequence_number>h THEN h END AS high_water_before FROM q""",
    ),
    "ack_correlation": with_(
        V1_ACKS,
        """SELECT delivery_id, command_id, CASE WHEN orphan THEN 'ORPHAN' WHEN op=opcode THEN 'MATCHED' ELSE 'MISMATCHED' END AS correlation,
          ['RECEIVED','ACCEPTED','REJECTED','EXECUTED'][ack_type] AS ack_name,
          CASE rcode WHEN 0 THEN 'NONE' WHEN 7 THEN 'MODE_INHIBIT' WHEN 10 THEN 'EXECUTION_ABORTED' END AS reason FROM au1""",
    ),
    "command_history": with_(V1_EVENTS, "SELECT command_id, event_no, at_us, from_state, to_state FROM sh"),
    "illegal_transitions": with_(
        V1_EVENTS, "SELECT * FROM se WHERE event_no NOT IN (SELECT event_no FROM sh)"
    ),
    "command_deadlines": with_(
        V1_EVENTS + """, dd AS (
          SELECT sh.command_id, to_state AS last_state, coalesce(next_us, 1769904000000000) AS next_us,
            at_us + 1000000::BIGINT * CASE WHEN to_state IN ('SENT','RECEIVED') THEN 5
              WHEN to_state='ACCEPTED' THEN CASE opcode WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 5 END END AS deadline_us
          FROM sh JOIN ic ON ic.command_id = sh.command_id)""",
        """SELECT command_id, last_state, deadline_us, last_state AS from_state, 'TIMED_OUT' AS to_state FROM dd WHERE next_us > deadline_us
        UNION ALL SELECT command_id, last_state, deadline_us, 'TIMED_OUT', 'UNKNOWN' FROM dd WHERE next_us > deadline_us""",
    ),
    "operator_idempotency": """WITH c AS (
        SELECT event_id*4 + copy AS request_no, event_id AS e, copy FROM (SELECT * REPLACE (event_id + 1 AS event_id) FROM events) AS events JOIN (VALUES (0),(1),(2)) k(copy)
          ON copy=0 OR (copy=1 AND event_id%5=0) OR (copy=2 AND event_id%7=0)
        WHERE event_type='click')
      SELECT request_no, CASE copy WHEN 0 THEN 'NEW' WHEN 1 THEN 'REPLAY' ELSE 'CONFLICT' END AS intent,
        e*4 AS first_request_no FROM c""",
}

ORACLES["delivery_stream"] = with_(
    ledger(),
    """SELECT o.delivery_id, request_state, first_delivery_id, o.packet_state, origin_delivery_id, validation_status,
      rejection_reason, sequence_disposition, missing_before
    FROM o LEFT JOIN (SELECT delivery_id, sequence_disposition, missing_before FROM pk) p
      ON p.delivery_id = o.delivery_id AND o.request_state='NEW'""",
)

ORACLES["ledger_load"] = ORACLES["delivery_outcome"]

ORACLES["ledger_loads"] = with_(
    AUDIT,
    """SELECT * FROM au WHERE event_id NOT LIKE 'B-%' UNION ALL BY NAME
      SELECT 'B-' || (delivery_id + 7) AS event_id, received_us AS occurred_us, 'ground-api' AS service_name,
        'telemetry.delivery.security_rejected' AS event_name, 'local-token:vendor-simulator' AS actor_identity, 'REJECTED' AS outcome,
        'BODY_TOO_LARGE' AS reason, NULL::BIGINT AS receipt_id, NULL::VARCHAR AS packet_id, NULL::VARCHAR AS job_id
      FROM d WHERE copy = 0 AND e % 301 = 0""",
)
