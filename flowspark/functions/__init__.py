"""Column functions: parsing, formatting, logistic helpers, sampling keys."""

from flowspark.functions.scalar import (  # noqa: F401
    alert_id, bce, client_dataset, client_no, decide, hash_key, latency_s, run_key, sigmoid,
    to_float, to_int,
)
from flowspark.functions.text import (  # noqa: F401
    fmt_bool, fmt_compact, fmt_duration, fmt_pct, fmt_seconds,
)
