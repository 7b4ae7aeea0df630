"""Readers and writers."""

from flowspark.sources.file_records import FileRecords, register_file_records  # noqa: F401
from flowspark.sources.readers import (  # noqa: F401
    alert_stream, log_leaves, message_stream, read_clients, read_flows, read_flows_csv, read_json_glob,
    read_metric_log, read_packets, read_round_losses, read_scaler, read_train_log, request_stream,
)
from flowspark.sources.sinks import (  # noqa: F401
    write_csv, write_flows, write_json, write_metric_log, write_round_losses, write_scaler,
    write_train_log,
)
