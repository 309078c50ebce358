"""Nested values: finite leaves, canonical text and hashes at any depth."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import finite


def finite_tree(value: Column, kind: T.DataType) -> Column:
    """The value with null in place of every number that isn't finite, however deep in
    structs, lists and map values it stands. Types without such numbers stay as they are."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(value)
    if not _has_numbers(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite_tree(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite_tree(x, kind.valueType))
    fields = [x for f in kind.fields for x in (F.lit(f.name), finite_tree(value.getField(f.name), f.dataType))]
    return F.when(value.isNotNull(), F.named_struct(*fields))


def _has_numbers(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_numbers(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_numbers(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_numbers(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def finite_table(df: DataFrame) -> DataFrame:
    """A table without numbers that aren't finite, at any depth."""
    return df.select(*(finite_tree(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def encode(value: object, form: str = "json") -> str:
    """A value with sorted keys: "json" (the usual separators), "compact" (none but , and :)
    or "yaml"."""
    if form == "yaml":
        import yaml

        return yaml.safe_dump(value, sort_keys=True, allow_unicode=True)
    if form not in ("json", "compact"):
        raise ValueError(f"unknown form {form!r}")
    return json.dumps(value, sort_keys=True, separators=(",", ":") if form == "compact" else None)


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def config_hashes(config: dict, form: str = "json", without: tuple[str, ...] = ("pipeline_version",)) -> tuple[str, str]:
    """(hash, semantic hash) of a configuration; the latter leaves out the keys that say
    which code ran, so that configurations of two versions can be compared."""
    meant = {k: v for k, v in config.items() if k not in without}
    return short_hash(encode(config, form)), short_hash(encode(meant, form))


def list_hash(items: list) -> str:
    """Hash of a list, in its order."""
    return short_hash(json.dumps(list(items), ensure_ascii=False))


def canonical_text(value: Column, kind: T.DataType, form: str = "json", without: tuple[str, ...] = ()) -> Column:
    """Text of a nested value, equal for equal values: keys sorted at all depths, numbers
    as JSON in Python has them, null for what isn't finite and for missing fields. `without`
    leaves out keys of the outermost level. Null gives null."""

    @F.pandas_udf("string")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            found = json.loads(text)
            return encode({k: v for k, v in found.items() if k not in without} if without else found, form)

        for batch in batches:
            yield batch.map(one, na_action="ignore").astype(object).where(batch.notna(), None)

    plain = finite_tree(value, kind)
    if not isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        plain, held = F.struct(plain.alias("v")), True
    else:
        held = False
    text = F.to_json(plain, {"ignoreNullFields": "false"})
    text = F.regexp_extract(text, r"(?s)^\{\"v\":(.*)\}$", 1) if held else text
    return again(F.when(value.isNotNull(), text))


def canonical_hash(value: Column, kind: T.DataType, form: str = "json", without: tuple[str, ...] = ()) -> Column:
    """16 hex digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(canonical_text(value, kind, form, without), 256), 1, 16)
