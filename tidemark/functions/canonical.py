"""One spelling for every JSON value, and hashes of it."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_value(value: Any) -> Any:
    """Numbers as doubles to nine decimals without -0, containers member by member; booleans, texts and null as they are."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        value = round(float(value), 9) if math.isfinite(value) else float(value)
        return value + 0.0
    if isinstance(value, dict):
        return {k: canonical_value(v) for k, v in value.items()}
    return [canonical_value(v) for v in value]


def canonical_text(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(canonical_value(json.loads(text)), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError, OverflowError):
        return None


def _canonical(text: pd.Series) -> pd.Series:
    return text.map(canonical_text)


def canonical_json(text: Column) -> Column:
    """JSON text of any nesting with sorted keys, numbers to nine decimals, escapes for all but ASCII and no spaces; null for what is no JSON. Nesting has no bound, so it is a small Arrow-batched helper, not an expression."""
    return F.pandas_udf(_canonical, StringType())(text)


def json_key(text: Column) -> Column:
    """SHA-256 of the canonical form: the same for any order of keys and spelling of numbers. Null and empty objects are one key."""
    return F.sha2(canonical_json(F.coalesce(text, F.lit("{}"))), 256)
