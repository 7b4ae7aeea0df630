"""Scalar column functions. All are built-in expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NON_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_float(c) -> Column:
    """Text to double; anything that is not a number becomes 0."""
    c = _col(c)
    number = c.rlike(_NUMBER) | c.rlike(_NON_FINITE)
    return F.coalesce(F.when(number, c.try_cast("double")), F.lit(0.0))


def to_int(c) -> Column:
    """Text to int; anything that is not a whole number becomes 0."""
    c = _col(c)
    return F.coalesce(F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int")), F.lit(0))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def decide(logit) -> Column:
    """Positive when the probability is above one half; exactly one half is negative."""
    return _col(logit) > F.lit(0.0)


def bce(logit, label) -> Column:
    """Binary cross-entropy of a logit in its overflow-free form."""
    z, y = _col(logit), _col(label).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def client_no(c) -> Column:
    """Number of a client named ``client-<n>: <dataset>``."""
    return F.regexp_extract(_col(c), r"-(\d+)", 1).cast("int")


def client_dataset(c) -> Column:
    """Upper-case dataset part of a client named ``client-<n>: <dataset>``."""
    return F.upper(F.element_at(F.split(_col(c), " "), 2))


def run_key(c) -> Column:
    """Run key of a log file name: its parts between the first and the extension."""
    parts = F.split(_col(c), "[_.]")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def latency_s(sent, now) -> Column:
    """Seconds between two timestamps, to the microsecond."""
    span = F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(_col(sent).cast("timestamp"))
    return span / F.lit(1e6)


def epoch_to_timestamp(c) -> Column:
    """Epoch seconds (fractions kept to the microsecond) to a timestamp."""
    return F.timestamp_micros(F.round(_col(c) * F.lit(1e6)).cast("long"))


def hash_key(key, seed: int) -> Column:
    """32 hex digits, uniform over rows with distinct keys, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def alert_id(*cols) -> Column:
    """A stable identifier from the key columns of an alert."""
    return F.md5(F.concat_ws(":", *[_col(c).cast("string") for c in cols]))
