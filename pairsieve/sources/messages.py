"""Message envelopes as JSON text, and acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "struct<k: bigint>"
ENVELOPE = f"msg_type string, payload {PAYLOAD}, seq bigint, session_id string, _bad string"

c = F.col


def to_text() -> Column:
    """Compact JSON with sorted keys from session_id, seq, msg_type and payload text."""
    return F.to_json(
        F.struct(
            "msg_type", F.from_json("payload", PAYLOAD).alias("payload"), "seq", c("session_id").cast("string").alias("session_id")
        )
    )


def parse(df: DataFrame, text: str) -> DataFrame:
    """Typed envelope columns; malformed text is flagged and kept, never dropped."""
    got = F.from_json(c(text), ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = df.withColumn("_env", got)
    ok = c("_env._bad").isNull() & c("_env.seq").isNotNull() & c("_env.msg_type").isNotNull() & c("_env.session_id").isNotNull()
    fields = [F.when(ok, c(f"_env.{n}")).alias(n) for n in ("session_id", "seq", "msg_type", "payload")]
    return parsed.select(*df.columns, ok.alias("is_valid"), *fields)


def match_acks(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """State of every message: acked, mismatch (wrong type) or timeout (no acknowledgement)."""
    a = acks.select("session_id", c("ack_seq").alias("seq"), "ack_type")
    both = sends.join(a, ["session_id", "seq"], "left")
    return both.withColumn(
        "state", F.when(c("ack_type").isNull(), "timeout").when(c("ack_type") != c("msg_type"), "mismatch").otherwise("acked")
    )
