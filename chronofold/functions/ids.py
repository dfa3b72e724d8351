"""Deterministic identities and name normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: namespace of the name-based UUIDs; ids must agree across systems.
NAMESPACE = "ba1d50eb-87a6-5d25-9c90-f86e8501d91f"


def json_array(*parts: Column) -> Column:
    """Compact JSON array of strings (keys cannot run into each other)."""
    return F.to_json(F.array(*parts))


def uuid5(text: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of the UTF-8 text: SHA-1 with version and variant bits set."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)),
                       F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def entity_id(kind: str, *keys: Column) -> Column:
    return uuid5(json_array(F.lit(kind), *keys))


def market_id(kind: str, *keys: Column) -> Column:
    return F.sha2(json_array(F.lit(kind), *keys), 256)


@F.pandas_udf(StringType())
def _fold_unicode(names: pd.Series) -> pd.Series:
    import unicodedata

    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def plain(name: Column) -> Column:
    """Names of ASCII letters need no Unicode folding and stay on the JVM."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\x09-\x0d\x1c-\x1f ]+", " "))


def with_normal_name(rows: DataFrame, name: str, out: str = "normal_name") -> DataFrame:
    """Compatibility-folded, case-folded, whitespace-collapsed name.

    Only distinct non-ASCII names cross into Python, and their folds are joined back.
    """
    ascii_only = F.col(name).rlike(r"^[\x00-\x7f]*$")
    odd = rows.filter(~ascii_only).select(name).distinct().withColumn("_fold", _fold_unicode(F.col(name)))
    return rows.join(odd, name, "left").withColumn(out, F.when(ascii_only, plain(F.col(name))).otherwise(F.col("_fold"))).drop("_fold")


def alias_key(canonical: Column, normal_name: Column) -> Column:
    return F.concat_ws(":", F.lit("declared-alias"), canonical, F.sha2(normal_name, 256))
