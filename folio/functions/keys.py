"""Content keys: a canonical JSON text of a value, and hashes of it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folio.schema import SCHEMA_VERSION


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def json_item(value: Column) -> Column:
    """A value as it stands in a JSON list, nulls kept."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return listed.substr(F.lit(2), F.length(listed) - 2)


def content_key(*parts: Column) -> Column:
    """SHA-256 of the JSON list of the parts; a struct counts as an object (its fields are to be in code-point order)."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_item(p) for p in parts]), F.lit("]")), 256)


def stable_seed(key: Column, bits: int = 32) -> Column:
    """The first bits of a hexadecimal key as a number."""
    return F.conv(F.substring(key, 1, bits // 4), 16, 10).cast("long")


def clip_key(kind: str, family: str, version: str, request: Column) -> Column:
    """The key of a clip: its kind, who makes it, and all fields of the request (a struct)."""
    return content_key(F.lit(kind), F.lit(family), F.lit(version), F.lit(SCHEMA_VERSION), request)


def request(**fields: Column) -> Column:
    """A request as a struct with its fields in code-point order, as `clip_key` wants it."""
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])
