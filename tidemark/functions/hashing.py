"""Identity: canonical JSON, its hash, and the keys made of it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = "\x1f"


def canonical(text: str | None) -> str | None:
    """A JSON text with sorted keys, without spaces, characters as they are. Numbers keep their Python form, so 1.0
    stays 1.0, which the JVM's variant type would not keep."""
    if text is None:
        return None
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(StringType())
def content_hash(texts: pd.Series) -> pd.Series:
    """sha256 of the canonical form."""
    return texts.map(lambda t: hashlib.sha256(canonical(t).encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def request_hash(texts: pd.Series) -> pd.Series:
    """sha256 of sorted JSON with ASCII escapes: the hash of model requests."""
    return texts.map(lambda t: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def message_hash(texts: pd.Series) -> pd.Series:
    """Request hash of a list of messages without their ``id`` and replay mark."""

    def strip(text: str) -> str:
        kept = [{k: v for k, v in m.items() if k not in ("id", "replayed")} for m in json.loads(text)]
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()

    return texts.map(strip, na_action="ignore")


def flat_hash(json_column: Column) -> Column:
    """The canonical hash in the JVM, for JSON without fractional numbers."""
    return F.sha2(F.to_json(F.parse_json(json_column)), 256)


def key_of(*parts: Column) -> Column:
    """sha256 over parts with a unit separator; null if a part is null (``concat_ws`` would skip it)."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.lit(SEPARATOR), p.cast("string"))][1:]), 256)


def effect_key() -> Column:
    return key_of(*map(F.col, ("namespace", "workflow_id", "run_id", "seq", "name", "idx")))


def llm_key() -> Column:
    return key_of(*map(F.col, ("namespace", "workflow_id", "run_id", "seq", "call_idx", "request_hash")))


def run_lock() -> Column:
    """A run's lock number: crc32 of its key, 31 bits."""
    return F.crc32(F.concat_ws("|", "namespace", "workflow_id", "run_id").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def claim_of(data: Column) -> Column:
    """A payload's claim: sha256 of its bytes."""
    return F.sha2(data, 256)
