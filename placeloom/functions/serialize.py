"""Canonical JSON, digests and identifiers."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    mantissa, _, e = repr(abs(x)).lower().partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(e or 0) if whole.strip("0") else int(e or 0) - (len(fraction) - len(fraction.lstrip("0")))
    digits = digits.rstrip("0")
    n, k = point, len(digits)
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = digits[:n] + "." + digits[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + digits
    else:
        out = digits[0] + ("." + digits[1:] if k > 1 else "") + "e" + ("+" if n > 0 else "-") + str(abs(n - 1))
    return ("-" if x < 0 else "") + out


def canonical_json(value) -> str:
    """RFC 8785: keys by UTF-16 units, shortest strings, ECMAScript numbers."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return _number(float(value))


@F.pandas_udf(T.StringType())
def jcs(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for null and for what is no JSON."""

    def one(text):
        try:
            return None if text is None else canonical_json(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def seal(document: Column) -> Column:
    return F.sha2(jcs(document), 256)


def bundle_id(uuid: Column) -> Column:
    """``bnd_`` and the hex of a UUID; null for anything else."""
    return F.when(uuid.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.concat(F.lit("bnd_"), F.regexp_replace(uuid, "-", "")))


def uuid_of(bundle: Column) -> Column:
    """The way back; null for anything that ``bundle_id`` does not make."""
    return F.when(bundle.rlike("^bnd_[0-9a-f]{32}$"), F.regexp_replace(bundle, "^bnd_(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def artifact_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def directory_digest(files: DataFrame) -> DataFrame:
    """One digest over the sorted (path, sha256) pairs, as a JSON array of arrays."""
    listed = F.array_sort(F.collect_list(F.array("path", "sha256")))
    return files.agg(F.sha2(F.to_json(listed), 256).alias("sha256"))


ABSOLUTE = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//", re.I)


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolute_urls(texts: pd.Series) -> pd.Series:
    """All absolute URLs among the strings of a JSON tree, keys aside."""

    def walk(x):
        if isinstance(x, str):
            if ABSOLUTE.match(x):
                yield x
        elif isinstance(x, (list, dict)):
            for y in x.values() if isinstance(x, dict) else x:
                yield from walk(y)

    def one(text):
        try:
            return None if text is None else list(walk(json.loads(text)))
        except ValueError:
            return None

    return texts.map(one)


def frozen(itinerary: Column, frame: Column, itinerary_fields: list[str], frame_fields: list[str]) -> Column:
    """The approved itinerary and its local frame as one canonical JSON text.

    Fields of one name in both are refused when the plan is made; a row without a frame, or with half of one, is an error.
    """
    clash = sorted(set(itinerary_fields) & set(frame_fields))
    if clash:
        raise ValueError(f"the frame would overwrite {', '.join(clash)}")
    whole = frame.isNotNull()
    for f in frame_fields:
        whole &= frame[f].isNotNull()
    both = F.struct(*(itinerary[f].alias(f) for f in itinerary_fields), *(frame[f].alias(f) for f in frame_fields))
    return F.when(whole, jcs(F.to_json(both, {"ignoreNullFields": "false"}))).otherwise(F.raise_error(F.lit("an itinerary is frozen with its whole local frame")).cast("string"))

