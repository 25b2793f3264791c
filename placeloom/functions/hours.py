"""A subset of the opening-hours grammar: weekly rules as intervals, judged at a local minute.

Rules part by ``;``, later ones replacing earlier ones on their days: ``[days] times|off|closed``, ``24/7``;
days ``Mo``, ``Mo-Fr``, ``Mo,We`` (ranges may wrap the week); times ``hh:mm-hh:mm``, past midnight too, by ``,``.
Quoted comments are free text; ``PH`` rules are dropped here and asked of the country's calendar by the caller.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
_DAY = "(?:" + "|".join(DAYS) + ")"
_RULE = re.compile(rf"^(?:({_DAY}(?:\s*-\s*{_DAY})?(?:\s*,\s*{_DAY}(?:\s*-\s*{_DAY})?)*)(?:\s+|$))?(.*)$", re.S)
_TIME = re.compile(r"^(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})$")


def weekly(expression: str | None) -> list[tuple[int, int]] | None:
    """Sorted, merged minutes of the week [from, to) that are open; null if the text is beyond the subset."""
    if expression is None or not expression.strip():
        return None
    days: list[list[tuple[int, int]]] = [[] for _ in DAYS]
    for rule in re.sub(r'"[^"]*"', " ", expression).split(";"):
        rule = rule.strip()
        if not rule or re.match(r"^PH\b", rule):
            continue
        if rule == "24/7":
            days = [[(0, 1440)] for _ in DAYS]
            continue
        named, rest = _RULE.match(rule).groups()
        chosen = range(7)
        if named:
            chosen = []
            for part in re.split(r"\s*,\s*", named):
                ends = [DAYS.index(d) for d in re.split(r"\s*-\s*", part)]
                chosen += [(ends[0] + k) % 7 for k in range((ends[-1] - ends[0]) % 7 + 1)]
        spans = []
        if rest.strip() not in ("off", "closed"):
            for piece in rest.split(",") if rest.strip() else ["00:00-24:00"] if named else [""]:
                m = _TIME.match(piece.strip())
                if not m:
                    return None
                a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
                if a >= 1440 or b > 2880 or int(m[2]) > 59 or int(m[4]) > 59:
                    return None
                spans.append((a, b if b > a else b + 1440))
        for d in chosen:
            days[d] = spans
    week = 7 * 1440
    cut = []
    for d, spans in enumerate(days):
        for a, b in spans:
            a, b = a + d * 1440, b + d * 1440
            cut += [(a, min(b, week)), (0, b - week)] if b > week else [(a, b)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(cut):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("open", T.IntegerType()), T.StructField("close", T.IntegerType())])))
def weekly_intervals(expressions: pd.Series) -> pd.Series:
    """Each distinct text is parsed once a batch."""
    known = {e: weekly(e) for e in expressions.dropna().unique()}
    return expressions.map(lambda e: None if e is None or known.get(e) is None else [{"open": a, "close": b} for a, b in known[e]])


def state_at(intervals: Column, local: Column) -> Column:
    """open, closed or hours_unknown at a local timestamp."""
    minute = (F.weekday(local) * 1440 + F.hour(local) * 60 + F.minute(local)).cast("int")
    return F.when(intervals.isNull(), "hours_unknown").when(F.exists(intervals, lambda w: (w["open"] <= minute) & (minute < w["close"])), "open").otherwise("closed")
