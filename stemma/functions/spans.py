"""Quote location: exact, then by words whatever their case and white space, then fuzzy for what is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _compact(text: str) -> tuple[str, np.ndarray]:
    """text in lower case with one blank for each run of white space, and the place in text of each character of that."""
    blank = np.fromiter(map(str.isspace, text), bool, len(text))
    kept = np.flatnonzero(~(blank & np.r_[False, blank[:-1]]))
    small = (" " if blank[i] else c if len(c := text[i].lower()) == 1 else text[i] for i in kept.tolist())
    return "".join(small), kept


def _pattern(needle: Column) -> Column:
    """The needle's words, literally but in any case, with any white space between; null without words or with more than PATTERN_WORDS."""
    words = F.filter(F.split(needle, r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(words).between(1, PATTERN_WORDS), F.concat(F.lit("(?iu)"), F.array_join(quoted, "\\s+")))


#: Words of a needle that a pattern may have: matching it takes stack for each of them.
PATTERN_WORDS = 200
_BLANK = " \t\n\x0b\f\r"  # what \\s means to the pattern


def _fold(c: str) -> str:
    """One character for one, as patterns compare them."""
    up = "i" if c == "İ" else u if len(u := c.upper()) == 1 else c
    return low if len(low := up.lower()) == 1 else up


def _by_words(needle: str, text: str) -> tuple[int, int] | None:
    """Where the pattern of any number of words matches first."""
    words = "".join(" " if c in _BLANK else _fold(c) for c in needle).split(" ")
    blank = np.fromiter((c in _BLANK for c in text), bool, len(text))
    kept = np.flatnonzero(~(blank & np.r_[False, blank[:-1]]))
    sought = " ".join(w for w in words if w)
    at = "".join(" " if blank[i] else _fold(text[i]) for i in kept.tolist()).find(sought) if sought else -1
    return (int(kept[at]), int(kept[at + len(sought) - 1]) + 1) if at >= 0 else None


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = 0
    for c in b:
        x = row | where.get(c, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity of lower-cased, space-collapsed texts."""
    a, b = (" ".join(x.lower().split()) for x in (a or "", b or ""))
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _fuzzy(needle: str, text: str, threshold: float):
    """The best window of the needle's length by common subsequence, the earliest among equals -> (start, end, score, tier)."""
    n, (h, at) = " ".join((needle or "").lower().split()), _compact(text or "")
    if not n or not h:
        return None, None, 0.0, "reject"
    size = min(len(n), len(h))
    step, last = max(1, size // 8), len(h) - size
    found = {p: lcs(n, h[p : p + size]) for p in range(0, last + 1, step)}  # coarse starts
    most = max(found.values())
    where = min(p for p, s in found.items() if s == most)
    for g in sorted(found, key=lambda p: (-found[p], p)):  # a shift by one gains at most one
        for p in range(max(0, g - step + 1), min(last, g + step - 1) + 1):
            if p in found:
                continue
            left = p - p % step
            reach = min(size, found[left] + p - left, found.get(left + step, size) + left + step - p)
            if reach > most or reach == most and p < where:
                s = found[p] = lcs(n, h[p : p + size])
                if s > most or s == most and p < where:
                    most, where = s, p
    best = 2 * most / (len(n) + size)
    if best < threshold:
        return None, None, round(best, 4), "reject"
    return int(at[where]), int(at[where + size - 1]) + 1, round(best, 4), "fuzzy"


def _place(needle: str, text: str, threshold: float):
    """What the pattern's tier left: needles too long for it by their words, then all fuzzily."""
    met = _by_words(needle, text) if needle and text and len(needle.split()) > PATTERN_WORDS else None
    return (*met, 1.0, "exact") if met else _fuzzy(needle, text, threshold)


def locate(pairs: DataFrame, needle: str = "needle", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """pairs with start, end, score, tier. Python sees only rows that neither of the first two tiers finds, and needles too long for a pattern.

    Null or blank needles and texts are rejected; among equal places the first counts."""
    there = (F.coalesce(F.length(needle), F.lit(0)) > 0) & (F.coalesce(F.length(text), F.lit(0)) > 0)
    found = pairs.withColumn("_at", F.when(there, F.expr(f"position(`{needle}`, `{text}`) - 1")).otherwise(F.lit(-1))).withColumn("_len", F.length(needle))
    found = found.withColumn("_words", F.when(there & (F.col("_at") < 0), F.regexp_substr(text, _pattern(F.col(needle)))))
    found = found.withColumns({"_at": F.when(F.col("_words").isNotNull(), F.expr(f"position(_words, `{text}`) - 1")).otherwise(F.col("_at")), "_len": F.coalesce(F.length("_words"), "_len")})
    exact = found.filter("_at >= 0").select(*pairs.columns, F.col("_at").alias("start"), (F.col("_at") + F.col("_len")).alias("end"), F.lit(1.0).alias("score"), F.lit("exact").alias("tier"))

    @F.pandas_udf("start int, end int, score double, tier string")
    def fuzzy(n: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_place(a, b, threshold) for a, b in zip(n, t)], columns=["start", "end", "score", "tier"]).astype({"start": "Int32", "end": "Int32"})

    rest = found.filter("_at < 0").withColumn("_m", fuzzy(needle, text)).select(*pairs.columns, "_m.start", "_m.end", "_m.score", "_m.tier")
    return exact.unionByName(rest)


def best_chunk(located: DataFrame, record: str, order: str) -> DataFrame:
    """Of a record's located chunks the best: exact, then score, then the earliest; records with none get no row."""
    w = Window.partitionBy(record).orderBy(F.desc(F.col("tier") == "exact"), F.desc("score"), order)
    return located.filter("tier <> 'reject'").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def merged(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of a key's spans; touching ones join."""
    w = Window.partitionBy(key).orderBy(start, end)
    past = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.when(F.col(start) <= past, 0).otherwise(1))
    islands = new.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def gaps(covered: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What merged spans leave of each text, trimmed of blanks at both ends; empty gaps are left out."""
    edges = covered.select(key, F.col("start").alias("z"), F.col("end").alias("a")).unionByName(texts.select(key, F.length(text).alias("z"), F.lit(None).cast("int").alias("a")))
    w = Window.partitionBy(key).orderBy("z", F.col("a").asc_nulls_last())
    raw = edges.withColumn("start", F.coalesce(F.lag("a").over(w), F.lit(0))).filter("start < z").select(key, "start", F.col("z").alias("end"))
    cut = raw.join(texts.select(key, F.col(text).alias("_t")), key).withColumn("_g", F.expr("substring(_t, start + 1, end - start)"))
    lead, tail = F.length("_g") - F.length(F.regexp_replace("_g", r"^\s+", "")), F.length("_g") - F.length(F.regexp_replace("_g", r"\s+$", ""))
    out = cut.withColumn("_l", lead).withColumn("_r", tail).select(key, (F.col("start") + F.col("_l")).alias("start"), (F.col("end") - F.col("_r")).alias("end"), "_t")
    return out.filter("start < end").withColumn("gap", F.expr("substring(_t, start + 1, end - start)")).drop("_t")


def annotate(text: str, places: list[tuple[int, int, str]]) -> str:
    """Numbered markers before each located quote, in order; fuzzy ones get a star and move to their word's start."""
    out, at = [], 0
    for n, (start, _, tier) in enumerate(sorted(places), 1):
        if tier == "fuzzy":
            while start > at and not text[start - 1].isspace():
                start -= 1
        out += [text[at:start], f"⟦{n}{'*' if tier == 'fuzzy' else ''}⟧"]
        at = start
    return "".join([*out, text[at:]])
