"""Published prose: wrapped lines, fences, event frames, romanised twins, speeds."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import expected_scripts, romanise_greek, script_check, script_counts

WIDTH = 92


@F.pandas_udf(T.StringType())
def wrapped(texts: pd.Series) -> pd.Series:
    """Lines of at most 92 columns; long words stay whole."""
    return texts.map(lambda t: None if t is None else "\n".join(textwrap.fill(line, WIDTH, break_long_words=False, break_on_hyphens=False) for line in t.split("\n")))


@F.pandas_udf(T.StringType())
def fenced(texts: pd.Series) -> pd.Series:
    """The text between fences longer than any run of backticks in it, three at least."""

    def one(t):
        if t is None:
            return None
        fence = "`" * max([3, *(len(r) + 1 for r in re.findall("`+", t))])
        return f"{fence}\n{t}\n{fence}"

    return texts.map(one)


def event_frames(stream: Column) -> Column:
    """Array of (event, data) of a finished text of server-sent frames; comments and an unfinished tail are left out."""
    lines = F.regexp_replace(stream, "\r\n|\r", "\n")
    frames = F.filter(F.split(F.regexp_extract(lines, r"(?s)^(.*)\n\n", 1), "\n\n"), lambda f: f != "")
    value = lambda f, name: F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return F.filter(F.transform(frames, lambda f: F.struct(F.coalesce(F.get(value(f, "event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(value(f, "data"), "\n").alias("data"))), lambda f: f["data"] != "")


def latin_twin(tag: Column, name: Column, has_twin: Column) -> Column:
    """Struct (tag, name, confidence) of the derived Latin name: for Greek names whose script is as their tag says, without one; null otherwise.

    The tag keeps its region.  Confidence is 0.9 times the share of Latin letters, to two places.
    """
    latin = romanise_greek(name)
    counts = script_counts(latin)
    share = F.aggregate(F.filter(counts, lambda c: c["script"] == "Latn"), F.lit(0), lambda t, c: t + c["n"]) / F.aggregate(counts, F.lit(0), lambda t, c: t + c["n"])
    region = F.filter(F.slice(F.split(tag, "-"), 2, 9), lambda x: ~x.rlike("^[A-Za-z]{4}$"))
    own = F.array_join(F.concat(F.array(F.lower(F.get(F.split(tag, "-"), F.lit(0))), F.lit("Latn")), region), "-")
    greek = (script_check(name, tag) == "match") & F.array_contains(expected_scripts(tag), "Grek")
    return F.when(greek & ~has_twin, F.struct(own.alias("tag"), latin.alias("name"), F.round(0.9 * share, 2).alias("confidence")))


def walk_seconds(metres: Column, kmh: Column) -> Column:
    """Whole seconds at a speed held to 3.5..5 km/h; halves go to the even one."""
    return F.bround(metres / (F.least(F.greatest(kmh, F.lit(3.5)), F.lit(5.0)) / 3.6)).cast("long")


def post_checks(words: Column, verbatim: Column, coordinates: Column, least: int = 40, most: int = 220) -> Column:
    """Why a narration is refused, the first reason in order: its length, a run of words taken from its source, a pair of coordinates; null to keep it."""
    return F.when(~words.between(least, most), "words").when(verbatim, "verbatim").when(coordinates, "coordinate")
