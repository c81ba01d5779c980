"""Identities: canonical digests, names derived from them, and their Arrow functions."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def digest(value: object) -> str:
    """SHA-256 of the value as JSON: keys sorted, no escapes beyond JSON's own, no blanks, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def block_hash(kind: str, content: str, structured: dict) -> str:
    return digest([kind, content, structured])


def block_id(source: str, path: list[str], content_hash: str, occurrence: int) -> str:
    return "b-" + digest([digest([source, path, content_hash]), occurrence])[:32]


def asset_id(source: str, reference: str) -> str:
    return "a-" + digest([source, reference])[:32]


def section_id(source: str, path: list[str]) -> str:
    return "s-" + digest([source, path])[:32]


def document_id(source: str) -> str:
    return "d-" + digest(source)[:32]


def passage_id(*parts: object) -> str:
    return "p-" + digest(list(parts))[:40]


def material_id(reference: object, text: str) -> str:
    return "e-" + digest([reference, text])[:32]


def external_identity(provider: str, account: str, external: str) -> str:
    return hashlib.sha256("\0".join((provider, account, external)).encode()).hexdigest()


@F.pandas_udf(StringType())
def name_uuid(space: pd.Series, name: pd.Series) -> pd.Series:
    """uuid5 of a name in a namespace."""
    return pd.Series([str(uuid.uuid5(uuid.UUID(s), n)) if s and n is not None else None for s, n in zip(space, name, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """digest() of JSON texts; null where the text is none."""

    def one(t: str | None) -> str | None:
        try:
            return digest(json.loads(t)) if t is not None else None
        except ValueError:
            return None

    return text.map(one)
