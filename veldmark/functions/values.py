"""Checks of configured values and states of texts."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .components import share_limit
from .text import parsed_boolean, parsed_date, parsed_integer, plain_decimal


def description_state(c: Column) -> Column:
    return F.when(c.isNull(), "NULL").when(F.regexp_replace(c, r"[\x00-\x20]+", "") == "", "BLANK").otherwise("VALUE")


def bookmark_error(c: Column, kind: str, *, choices: tuple[str, ...] = (), pattern: str | None = None, most: int | None = None) -> Column:
    """Error code of a value for a bookmark of a kind, null if it fits."""
    good = {"INTEGER": parsed_integer(c).isNotNull(), "DECIMAL": plain_decimal(c).isNotNull(), "DATE": parsed_date(c).isNotNull(), "BOOLEAN": parsed_boolean(c).isNotNull(), "ENUM": c.isin(*choices) if choices else F.lit(False), "TEXT": F.lit(True)}[kind]
    error = F.when(c.isNull() | (c == ""), "VALUE_MISSING").when(~F.coalesce(good, F.lit(False)), f"{kind}_INVALID")
    if pattern is not None:
        error = error.when(~c.rlike(f"^(?:{pattern})$"), "PATTERN_MISMATCH")
    if most is not None:
        error = error.when(F.length(c) > most, "VALUE_TOO_LONG")
    return error


def share_in_range(share: Column, most: int | Decimal) -> Column:
    """Whether a share (10^-12 percent) is at most a configured percentage."""
    return share <= share_limit(most)


def config_hash(*layers: list[tuple[str, str | None]]) -> str:
    """SHA-256 over the layers of a configuration, keys in order."""
    text = "\x1e".join("\x1f".join(f"{k}={chr(0) if v is None else v}" for k, v in sorted(layer, key=lambda kv: kv[0])) for layer in layers)
    return hashlib.sha256(text.encode()).hexdigest()
