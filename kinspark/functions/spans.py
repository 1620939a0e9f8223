"""Spans of regular expressions in texts, as arrays of structs, inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,text:string>>"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, stop, text) of every match, or of one of its groups, in order; positions count code points.

    Matches and the gaps between them alternate, so a match starts behind all gaps and
    matches before it. A group is sought in its match; it must not occur there earlier.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
    begin = lambda i: total(sizes(gaps), i + 1) + total(sizes(whole), i)
    found = F.transform(whole, lambda m, i: F.struct(begin(i).alias("start"), (begin(i) + F.length(m)).alias("stop"), m.alias("text")))
    if group == 0:
        return found.cast(SPAN)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(
        F.arrays_zip(found.alias("f"), inner.alias("g")),
        lambda z: F.struct(
            (z["f"]["start"] + F.call_function("locate", z["g"], z["f"]["text"]) - 1).alias("start"),
            (z["f"]["start"] + F.call_function("locate", z["g"], z["f"]["text"]) - 1 + F.length(z["g"])).alias("stop"),
            z["g"].alias("text"),
        ),
    ).cast(SPAN)


def keep_first(ordered: Column, element: str) -> Column:
    """Of spans in order, those of which neither end lies in a span kept before."""
    empty = F.array().cast(f"array<{element}>")
    inside = lambda a, x: ((a["start"] <= x["start"]) & (x["start"] < a["stop"])) | ((a["start"] < x["stop"]) & (x["stop"] <= a["stop"]))
    return F.aggregate(ordered, empty, lambda acc, x: F.when(F.exists(acc, lambda a: inside(a, x)), acc).otherwise(F.array_append(acc, x)))
