"""Canonical JSON, receipts and ordered digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_bytes(value: object) -> bytes:
    """JSON with sorted keys, no spaces, UTF-8; NaN is an error."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def receipt(value: object) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


@F.pandas_udf(T.StringType())
def json_receipt(text: pd.Series) -> pd.Series:
    """Receipt of a JSON text; null where it does not parse. Floats keep Python's form, which to_json does not."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else receipt(json.loads(s))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null stays null, and a text that does not parse is an error."""
    return text.map(lambda s: None if s is None else canonical_bytes(json.loads(s)).decode())


def seal_holds(key: str) -> Callable[[str], Column]:
    """Whether a JSON object's value under key is the receipt of the rest of it; false where it does not parse."""

    def one(s: str | None) -> bool:
        try:
            record = json.loads(s or "")
            return isinstance(record, dict) and record.pop(key, None) == receipt(record)
        except ValueError:
            return False

    @F.pandas_udf(T.BooleanType())
    def holds(text: pd.Series) -> pd.Series:
        return text.map(one)

    return holds


def row_digest(*cols: str) -> Column:
    """SHA-256 of the canonical JSON of integer and string columns, inside the JVM."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def ordered_digest(df: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """One digest per group over `key NUL value` lines in key order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: F.concat(x.k.cast("string"), F.lit("\0"), x.v))
    return df.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
