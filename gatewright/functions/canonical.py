"""Canonical JSON and content digests.

Canonical: keys sorted, no spaces, UTF-8 unescaped, Python's number forms; NaN is refused.
Spark's ``to_json`` writes other number forms, so digests need Python: a scalar Arrow UDF
for columns, plain functions for single documents. For mere equality of JSON values,
``to_json`` of a VARIANT is enough and stays in the JVM.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value, prefix: str = "sha256:") -> str:
    return prefix + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sealed(value: dict, field: str = "content_digest") -> dict:
    """The document with the digest of everything else in it."""
    body = {k: v for k, v in value.items() if k != field}
    return body | {field: digest(body)}


def verify_seal(value: dict, field: str = "content_digest") -> None:
    body = {k: v for k, v in value.items() if k != field}
    if value.get(field) != digest(body):
        raise ValueError("the content digest does not match")


@F.pandas_udf(StringType())
def _digest_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else digest(json.loads(t), ""))


def json_digest(column: Column | str, prefix: str = "sha256:") -> Column:
    """sha256 of the canonical form of JSON text, NULL for NULL."""
    return F.concat(F.lit(prefix), _digest_of(column))


def same_value(column: Column | str) -> Column:
    """A key that is equal for equal JSON values, whatever their spacing and order of keys."""
    return F.to_json(F.parse_json(column))
