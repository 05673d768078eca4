"""Scalar expressions of the ledger; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, halves away from zero; null if either is null."""
    micros = F.timestamp_diff("MICROSECOND", start, end).cast("decimal(20,0)")
    return F.round(micros / F.lit(1000).cast("decimal(20,0)"), 0).cast("bigint")


def graph_of(activity_type: Column) -> Column:
    """An activity type up to its last dot; null without a dot."""
    return F.nullif(F.regexp_extract(activity_type, r"(?s)^(.*)\.[^.]*$", 1), F.lit(""))


def kind_of(output_json: Column) -> Column:
    """INTERRUPT before COMMAND before UPDATE; a field counts if it is there and not null."""
    has = lambda path: F.get_json_object(output_json, path).isNotNull()
    return F.when(has("$.langgraph_interrupts"), "INTERRUPT").when(has("$.langgraph_command"), "COMMAND").otherwise("UPDATE")


def short(text: Column, length: int = 8, mark: str = "...") -> Column:
    """The first characters of a hash, marked as cut."""
    return F.concat(F.left(text, F.lit(length)), F.lit(mark))


def fence(prefix: str = "") -> Column:
    """(schedule time, attempt) as one value that orders like the pair."""
    return F.struct(F.col(f"{prefix}fence_scheduled_at"), F.col(f"{prefix}attempt"))


def distinct_from(a: Column, b: Column) -> Column:
    """Null-safe inequality, of structs too."""
    return ~a.eqNullSafe(b)


def tokens(prefix: str = "") -> Column:
    """Tokens in and out, missing ones counted as none."""
    return F.coalesce(F.col(f"{prefix}tokens_in"), F.lit(0)) + F.coalesce(F.col(f"{prefix}tokens_out"), F.lit(0))


def task_path(parts: Column) -> Column:
    """A sortable path: ``~`` and the parts, numbers padded to ten digits."""
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 10, "0")).otherwise(p))
    return F.concat(F.lit("~"), F.array_join(padded, ", "))


def sorted_ids(ids: Column) -> Column:
    """Ids for a header: sorted and distinct; null (not sent) if there are none."""
    clean = F.array_sort(F.array_distinct(ids))
    return F.when(F.size(clean) > 0, clean)


def is_sequence_number(value: Column) -> Column:
    """Whether a text is a non-negative integer as a header carries it."""
    return value.rlike(r"^(0|[1-9][0-9]*)$")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def starts_with(column: Column, prefix: str) -> Column:
    """A prefix test that takes ``_`` and ``%`` as they are."""
    return column.startswith(prefix)
