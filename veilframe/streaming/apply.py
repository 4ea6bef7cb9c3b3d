"""Policies on streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from veilframe.functions.members import Caller
from veilframe.model import PolicyError, RuleSet
from veilframe.operators.apply import apply_rule_set


def apply_to_stream(df: DataFrame, rule_set: RuleSet, caller: Caller, **options) -> DataFrame:
    """As ``apply_rule_set``: scalar transforms, filters and stream-static detokenizing. Aggregations need whole tables."""
    if not df.isStreaming:
        raise PolicyError("not a streaming frame")
    if any(t.kind == "aggregation" for _, ts in rule_set.transforms for t in ts):
        raise PolicyError("aggregations need whole tables; apply them to each batch with each_batch()")
    return apply_rule_set(df, rule_set, caller, **options)


def each_batch(rule_set: RuleSet, caller: Caller, sink: Callable[[DataFrame, int], None], **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: any rule set, its aggregates over one batch each."""
    return lambda batch, n: sink(apply_rule_set(batch, rule_set, caller, **options), n)
