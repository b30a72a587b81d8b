"""Canonical texts and their SHA-256 fingerprints, in lower-case hex."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators of canonical texts and the mark of a missing part.
PART, RECORD, MISSING = "\x1f", "\x1e", "\x00"


def canonical(version: int, *parts: Column) -> Column:
    """Version and parts, joined; a null part is U+0000, an empty one is empty."""
    return F.concat_ws(PART, F.lit(str(version)), *(F.coalesce(p, F.lit(MISSING)) for p in parts))


def has_reserved(*parts: Column) -> Column:
    """Whether a part holds a character that canonical texts reserve."""
    found = F.lit(False)
    for p in parts:
        found = found | F.coalesce(p.rlike(r"[\x00\x1e\x1f]"), F.lit(False))
    return found


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def packed(digest: Column) -> Column:
    """A digest in hex as its 32 bytes, for a shuffle; any other text as its own bytes behind 33 zero bytes, so that no two texts become one."""
    return F.when(digest.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(digest)).otherwise(F.concat(F.lit(bytes(33)), F.encode(digest, "UTF-8")))


def unpacked(digest: Column) -> Column:
    """The text that was packed."""
    return F.when(F.octet_length(digest) == 32, F.lower(F.hex(digest))).otherwise(F.decode(F.substring(digest, 34, 2**31 - 1), "UTF-8"))


def combined(*hex_digests: Column) -> Column:
    """SHA-256 over the raw bytes of digests, one after another."""
    return F.sha2(F.concat(*(F.unhex(d) for d in hex_digests)), 256)


def amount_text(micro: Column) -> Column:
    """Micro-units as an amount with six places."""
    return (micro.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(24,6)").cast("string")


def identity(version: int, supplier: Column, group: Column, reference: Column, discount: Column | None = None) -> Column:
    parts = (supplier, group, reference) if discount is None else (supplier, group, discount, reference)
    return sha(canonical(version, *parts))


def article(version: int, description: Column, fields: dict[str, Column] | None = None) -> Column:
    """From version 2 on, names stand before values, the description's first and then those of mapped fields in order, so that no two fields can change places."""
    if version < 2:
        return sha(canonical(version, description))
    named = [part for code, value in sorted((fields or {}).items()) for part in (F.lit(code), value)]
    return sha(canonical(version, F.lit("DESCRIPTION"), description, *named))


def references(version: int, values: dict[str, Column]) -> Column:
    """Of normalised references by type, in order of type; one that is mapped but empty is null."""
    return sha(canonical(version, *(part for kind, value in sorted(values.items()) for part in (F.lit(kind), value))))


def price(version: int, amount: Column, currency: Column, components: Column | None = None) -> Column:
    """components: array of code and percentage text, in order of code."""
    text = canonical(version, amount, currency)
    if components is not None:
        more = F.flatten(F.transform(components, lambda c: F.array(c["code"], F.coalesce(c["percentage"], F.lit(MISSING)))))
        text = F.concat_ws(PART, text, more)
    return sha(text)


def ordered_hash(rows: DataFrame, group: str, line: Column, order: Column, name: str) -> DataFrame:
    """group and SHA-256 over its lines in order, each ended by U+001E; groups without rows are absent.

    The hash is over one sequence, so one task reads a group, but a line at a time: Spark
    deals and sorts the lines (spilling where they are many), and the task keeps a hash state.
    """
    sorted_lines = rows.select(F.col(group).alias("g"), order.alias("o"), line.alias("line")).repartition("g").sortWithinPartitions("g", "o").select("g", "line")
    types = dict(sorted_lines.dtypes)

    def run(batches):
        here, state, begun = None, None, False
        for batch in batches:
            keys, digests = [], []
            for g, text in zip(batch.column("g").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if not begun or g != here:
                    if begun:
                        keys.append(here)
                        digests.append(state.hexdigest())
                    here, state, begun = g, hashlib.sha256(), True
                state.update((text or "").encode() + RECORD.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("g").type), pa.array(digests, pa.string())], ["g", "h"])
            kind = batch.schema.field("g").type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([here], kind), pa.array([state.hexdigest()], pa.string())], ["g", "h"])

    return sorted_lines.mapInArrow(run, f"g {types['g']}, h string").select(F.col("g").alias(group), F.col("h").alias(name))
