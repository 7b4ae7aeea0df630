"""Structured Streaming jobs: scoring, live monitor answers, snapshots."""

from flowspark.streaming.event_time import on_time, save_closed, split_late, window_totals  # noqa: F401
from flowspark.streaming.live import (  # noqa: F401
    alert_snapshots, committed, current, finished, flat_alerts, latest_batch, live_latest, live_top,
    live_totals, live_workers, once, run_until_drained, save_batches, save_changes, save_result,
    snapshot_messages, snapshots,
)
from flowspark.streaming.scoring import (  # noqa: F401
    dead_letter, score_messages, score_stream, write_alerts,
)
