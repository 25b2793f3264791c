"""Listing templates of wikitext as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Template names.
TEMPLATES = ("see", "do", "eat", "drink", "sleep", "buy", "go", "listing", "marker", "vcard")
_OPEN = re.compile(r"\{\{\s*(" + "|".join(TEMPLATES) + r")\s*(?=[|}])", re.I)


def listings(text: str) -> list[dict]:
    """Templates (nested ones inside a value are kept as text) as name and arguments."""
    out = []
    for m in _OPEN.finditer(text or ""):
        depth, links, fields, at, start = 1, 0, [], m.end(), m.end()
        while at < len(text) and depth:
            two = text[at : at + 2]
            if two in ("{{", "}}", "[[", "]]"):
                depth += (two == "{{") - (two == "}}")
                links += (two == "[[") - (two == "]]")
                at += 2
                if not depth:
                    fields.append(text[start : at - 2])
                continue
            if text[at] == "|" and depth == 1 and links <= 0:
                fields.append(text[start:at])
                start = at + 1
            at += 1
        if depth:
            continue  # never closed
        values = dict((k.strip().lower(), v.strip()) for k, eq, v in (f.partition("=") for f in fields[1:]) if eq)
        out.append({"template": m[1].lower(), "fields": {k: v for k, v in values.items() if v}})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])))
def parse_listings(texts: pd.Series) -> pd.Series:
    return texts.map(listings)
