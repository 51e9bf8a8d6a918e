"""Text: globs, key projection, redaction, hashing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


def glob(value: Column, pattern: str) -> Column:
    """A pattern with stars for any characters. (O035)"""
    return value.rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def detail_key(key: Column, renamed: dict[str, str], prefixes: list[str]) -> Column:
    """A given name, else the key without its longest known prefix in lower case. (O036)"""
    bare = key
    for p in sorted(prefixes, key=len):
        bare = F.when(key.startswith(p), F.substring(key, len(p) + 1, 10_000)).otherwise(bare)
    out = F.lower(bare)
    for k, v in renamed.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def redact(key: Column, value: Column, exact: dict[str, str], containing: dict[str, str]) -> Column:
    """Masks by rule: mask, last4 or hash; an exact name first, then the first rule whose text the key contains. (O037)"""
    forms = {"mask": F.lit("***"), "last4": F.concat(F.lit("***"), F.right(value, F.lit(4))), "hash": F.sha2(value, 256), "keep": value}
    out = value
    for part, rule in reversed(containing.items()):
        out = F.when(F.lower(key).contains(part.lower()), forms[rule]).otherwise(out)
    for name, rule in exact.items():
        out = F.when(key == name, forms[rule]).otherwise(out)
    return out


#: Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@pandas_udf(LongType())
def fnv1a(s: pd.Series) -> pd.Series:
    """The 64 bits as a signed integer; null of null. (O181)"""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return s.map(lambda x: None if x is None else signed(fnv1a64(x.encode()))).astype("Int64")
