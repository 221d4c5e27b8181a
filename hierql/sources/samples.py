"""Sample logs that need no file: a list of names, and loading by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hierql.model import EventStore

from .synthetic import synthetic

#: name -> (description, how the log is made)
SAMPLES = {
    "small": ("100 traces of 10 events, 20 activities", {"traces": 100}),
    "variants": ("1 000 traces of 10 events in 100 variants", {"traces": 1_000, "variants": 100}),
    "selective": ("1 000 traces of 10 events, attr_1 is 'hit' in 10 % of them", {"traces": 1_000, "matching_percent": 10}),
    "long": ("10 traces of 1 000 events", {"traces": 10, "events_per_trace": 1_000}),
}


def samples() -> list[dict[str, str]]:
    """Names and descriptions of the samples."""
    return [{"name": name, "description": text} for name, (text, _) in SAMPLES.items()]


def load_sample(spark: SparkSession, name: str) -> EventStore:
    if name not in SAMPLES:
        raise KeyError(f"no sample is called {name}")
    return synthetic(spark, **SAMPLES[name][1])
