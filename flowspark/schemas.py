"""Schemas of flow records, request and alert messages, statistics and logs."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

# NetFlow v2 column names, in the order of the feature vector.
FEATURES = [
    "PROTOCOL", "L7_PROTO", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS",
    "TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS",
    "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT",
    "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT",
    "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES",
    "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS",
    "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT",
    "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT",
    "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE",
    "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE",
]
IDENTITY = ["IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT"]
CLASS = "Attack"
LABEL = "Label"
# End of fixed values.

FLOW = T.StructType(
    [
        T.StructField("IPV4_SRC_ADDR", T.StringType()),
        T.StructField("L4_SRC_PORT", T.IntegerType()),
        T.StructField("IPV4_DST_ADDR", T.StringType()),
        T.StructField("L4_DST_PORT", T.IntegerType()),
        *[T.StructField(name, T.DoubleType()) for name in FEATURES],
        T.StructField(LABEL, T.IntegerType()),
        T.StructField(CLASS, T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("IPV4_SRC_ADDR", T.StringType()),
        T.StructField("L4_SRC_PORT", T.IntegerType()),
        T.StructField("IPV4_DST_ADDR", T.StringType()),
        T.StructField("L4_DST_PORT", T.IntegerType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("send_timestamp", T.DoubleType()),
        T.StructField("metadata", METADATA),
        T.StructField("packet", T.ArrayType(T.DoubleType())),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("metadata", METADATA),
        T.StructField("classification_time", T.DoubleType()),
        T.StructField("latency", T.DoubleType()),
        T.StructField("worker_name", T.StringType()),
        T.StructField("is_malicious", T.BooleanType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

ITEM_COUNT = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.LongType())]
)

STATISTICS = T.StructType(
    [
        T.StructField("total_packets", T.LongType()),
        T.StructField("total_malicious", T.LongType()),
        T.StructField("malicious_ips", T.ArrayType(ITEM_COUNT)),
        T.StructField("targeted_ips", T.ArrayType(ITEM_COUNT)),
        T.StructField("avg_latency", T.DoubleType()),
        T.StructField("avg_classification_time", T.DoubleType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("stats", STATISTICS),
        T.StructField("packet_info", ALERT),
    ]
)

WORKER_FILE = T.StructType(
    [
        T.StructField("processed_packets", T.LongType()),
        T.StructField("total_timer", T.DoubleType()),
    ]
)


def required_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every leaf of a nested schema as a dotted path."""
    paths = []
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            paths += required_paths(field.dataType, f"{prefix}{field.name}.")
        else:
            paths.append(prefix + field.name)
    return paths


def _has_all(parts: list[str]):
    """A test of one list item: none of its parts is missing."""
    return lambda item: reduce(lambda a, b: a & b, [item[p].isNotNull() for p in parts])


def is_complete(column: str, schema: T.StructType):
    """True when no required leaf of the struct ``column`` is missing, inside lists too."""
    ok = F.col(column).isNotNull()
    for field in schema.fields:
        name, kind = f"{column}.{field.name}", field.dataType
        if isinstance(kind, T.StructType):
            ok = ok & is_complete(name, kind)
        else:
            ok = ok & F.col(name).isNotNull()
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            ok = ok & F.forall(name, _has_all(kind.elementType.names))
    return ok


def parse_messages(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse the JSON text ``column``; adds ``message`` and ``valid``.

    JSON keys are matched to the schema without regard to case, as the writers and readers of
    these messages differ in it. Only keys are: a quote inside a value is escaped. Texts whose keys are
    all spelled as in the schema are parsed as they are.
    """
    text, keys = F.col(column), sorted({k for path in required_paths(schema) for k in path.split(".")})
    named = "|".join(map(re.escape, keys))
    behind = F.octet_length(F.substring_index(text, '"', -1))  # no key lies behind the last quote
    head = F.substring(text.cast("binary"), F.lit(1), F.octet_length(text) - behind).cast("string")
    other = head.rlike(rf'"(?!(?:{named})")(?i:{named})"')
    spelled = text
    for key in keys:
        spelled = F.regexp_replace(spelled, rf'(?i)(?<!\\)"{re.escape(key)}"(?=\s*:)', f'"{key}"')
    text = F.when(other, spelled).otherwise(text)
    parsed = df.withColumn("message", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
    return parsed.withColumn("valid", is_complete("message", schema))


def validate(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split messages into valid rows (parsed) and rejected rows (raw text kept)."""
    parsed = parse_messages(df, column, schema)
    return (
        parsed.filter("valid").drop("valid"),
        parsed.filter("NOT valid").drop("valid", "message"),
    )


def check_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """Keep rows whose feature vector has ``width`` elements."""
    return df.filter(F.size(column) == width)
