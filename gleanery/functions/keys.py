"""Deterministic keys: hash ranks, blind ids, digests, canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rank_key(seed: int | str, purpose: str, key: Column | str) -> Column:
    """Hex digest of ``seed:purpose:key``; ascending order of it is a fixed pseudo-random order.  Null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:{purpose}:"), key.cast("string")), 256)


def blind_id(prefix: str, purpose: str, key: Column | str) -> Column:
    """``prefix-`` and 20 digits of the digest of ``purpose:key``; with an empty purpose of the key's own digits."""
    key = F.col(key) if isinstance(key, str) else key
    digits = F.sha2(F.concat(F.lit(f"{purpose}:"), key), 256) if purpose else key
    return F.concat(F.lit(f"{prefix}-"), F.substring(digits, 1, 20))


def row_digest(*cols: str) -> Column:
    """Digest of a row's fields; null and empty differ, and so do fields split elsewhere."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, characters beyond ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json_text(text: pd.Series) -> pd.Series:
    """JSON text in canonical form; null for null, for text that is no JSON and for repeated keys."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical_json(json.loads(x, object_pairs_hook=unique))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def identity_key(name: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded; null unless 1 to 80 characters remain."""
    import unicodedata

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        key = " ".join(unicodedata.normalize("NFKC", x).split()).casefold()
        return key if 1 <= len(key) <= 80 else None

    return name.map(one)
