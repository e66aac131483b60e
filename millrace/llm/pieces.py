"""Cutting texts over a size limit into overlapping pieces at their own breaks.

The least possible number of pieces places targets of equal length over the whole text. Each target snaps to the strongest break near
it, or else to the line end nearest to it in all the room that the limit leaves. If the last piece then is over the limit, targets are placed
again for one piece more. A cut falls inside a line only where the room holds no line end, and there at a sentence end, else at
white space, else between any two code points but CR and LF.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.shared import bounded, ship

#: Kinds of breaks from weak to strong.
KINDS = ("character", "space", "sentence", "line", "block_line", "blank_line", "section")
CHARACTER, SPACE, SENTENCE, LINE, BLOCK_LINE, BLANK_LINE, SECTION = range(7)

_LINE_END = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?;。！？｡।؟][\"'”’」』)\]]*\s+|[。！？｡」』]")
_SPACE = re.compile(r"\s+")
_HEAD = re.compile(r"#{1,6} |module |import |def |class |property |let |type |/\*\*|\"\"\"")


def line_breaks(text: str) -> tuple[list[int], list[int], int]:
    """Places behind line ends, the strength of each, and the length of the longest line without its end."""
    places, strengths, longest, last, blank = [], [], 0, 0, False
    size = len(text)
    for m in _LINE_END.finditer(text):
        start, at = m.span()
        line = start - last
        longest = max(longest, line)
        blank = line == 0 or (text[last].isspace() and text[last:start].isspace())
        last = at
        if at < size:
            c = text[at]
            places.append(at)
            if c in " \t\r\n":
                strengths.append(BLANK_LINE if blank and c in " \t" else LINE)
            elif blank:
                strengths.append(SECTION if _HEAD.match(text, at) else BLANK_LINE)
            else:
                strengths.append(BLOCK_LINE if c not in ")]}" else LINE)
    return places, strengths, max(longest, size - last)


def _best(places: list[int], strengths: list[int], low: int, high: int, target: float, near: float) -> int | None:
    """Index of the strongest break within `near` of the target, else of the nearest; None where low..high has none."""
    a, b = bisect_left(places, low), bisect_right(places, high)
    if a >= b:
        return None
    c, d = bisect_left(places, target - near, a, b), bisect_right(places, target + near, a, b)
    if c < d:
        return max(range(c, d), key=lambda k: (strengths[k], -abs(places[k] - target)))
    return min((k for k in (c - 1, c) if a <= k < b), key=lambda k: abs(places[k] - target))


def _inside(text: str, low: int, high: int, target: float, near: float) -> tuple[int, int]:
    """A place in low..high where no line ends, and its kind."""
    for kind, pattern in ((SENTENCE, _SENTENCE), (SPACE, _SPACE)):
        a = max(low, int(target - near))
        found = [m.end() for m in pattern.finditer(text, max(0, a - 1), min(high, int(target + near))) if a <= m.end() < high]
        if found:
            return min(found, key=lambda p: abs(p - target)), kind
    at = max(low, min(high, round(target)))
    if text[at - 1 : at + 1] == "\r\n":
        at += 1 if at < high else -1
    return at, CHARACTER


def cut_places(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """(start, end, kind of the break at the end) of each piece, and the length of the longest line."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    places, strengths, longest = line_breaks(text)
    count = max(1, -(-(len(text) - overlap) // (limit - overlap)))
    while (out := _snapped(text, places, strengths, limit, overlap, count)) is None:
        count += max(1, count >> 6)  # one by one; by a 64th where there are many
    return out, longest


def _snapped(text: str, places: list[int], strengths: list[int], limit: int, overlap: int, count: int) -> list[tuple[int, int, int]] | None:
    """Pieces for `count` targets of equal length, or None if the last one is over the limit."""
    size, out, start, last = len(text), [], 0, 0
    for i in range(1, count):
        target = overlap + i * (size - overlap) / count
        low, high = max(last, start + overlap) + 1, min(start + limit, size - 1)
        if low > high:
            break  # the text is used up
        aim = min(target, high)
        k = _best(places, strengths, low, high, aim, limit / 8)
        end, kind = (places[k], strengths[k]) if k is not None else _inside(text, low, high, aim, limit / 8)
        out.append((start, end, kind))
        start, last = end - overlap, end
    if size - start > limit:
        return None
    return [*out, (start, size, SECTION)]


PIECES = "id bigint, piece int, n_pieces int, start_pos bigint, end_pos bigint, end_kind string, longest_line bigint"


def pieces(records: DataFrame, limit: int, overlap: int, texts: bool = True) -> DataFrame:
    """One row for each piece of each record whose content has more than `limit` code points.

    `records` has `id` and `content`; further columns are ignored, rows that repeat an id count once, and
    records at or under the limit, empty or null give no row. Every piece has at most `limit` code points, each but the first begins `overlap` code points
    before the end of the one before, and the pieces without their overlaps joined together are the text. `end_kind`
    names the break at the end (`end` for the last piece); `longest_line` is the record's. Column `text` is
    left out if not `texts`.
    """

    def batches(it):
        for b in it:
            rows = []
            for i, t in zip(b["id"], b["content"], strict=True):
                found, longest = cut_places(t, limit, overlap)
                for k, (s, e, kind) in enumerate(found):
                    name = "end" if k + 1 == len(found) else KINDS[kind]
                    rows.append((i, k, len(found), s, e, name, longest, *([t[s:e]] if texts else [])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind_of.split(", ")])

    ship(records.sparkSession)
    kind_of = PIECES + (", text string" if texts else "")
    long = records.select("id", "content").where(F.length("content") > limit)
    if not texts:
        return long.mapInPandas(batches, kind_of).dropDuplicates(["id", "piece"])
    # only texts of ids that repeat are shuffled, to be cut once
    again = bounded(long.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    once = long.join(again, "id", "left_anti").unionByName(long.join(again, "id", "left_semi").dropDuplicates(["id"]))
    return once.mapInPandas(batches, kind_of)


def broken(cut_up: DataFrame, limit: int, overlap: int) -> DataFrame:
    """One row for each id of rows of `pieces` with their texts: `digest`, the MD5 of the pieces put together without their overlaps, and
    counts that are 0 where pieces are right: n_over (longer than the limit), n_apart (beginning not `overlap` before the end of the
    one before, or sharing other text with it), n_unlike (a break named a line's that is none), n_unforced (a cut inside a line
    although its piece holds a line end behind the overlap)."""
    side = Window.partitionBy("id").orderBy("piece")
    own = F.when(F.col("piece") > 0, F.substring("text", overlap + 1, limit)).otherwise(F.col("text"))
    shared = F.substring("text", 1, overlap) == F.lag(F.expr(f"right(text, {overlap})")).over(side)
    apart = (F.col("piece") > 0) & ((F.col("start_pos") != F.lag("end_pos").over(side) - overlap) | ((F.lit(overlap) > 0) & ~shared))
    inside, last = F.col("end_kind").isin("character", "space", "sentence"), F.col("end_kind") == "end"
    rows = cut_up.select("id", "piece", own.alias("own"), (F.length("text") > limit).alias("over"), F.coalesce(apart, F.lit(False)).alias("apart"), inside.alias("inside"), last.alias("last"))
    at_end = F.col("own").rlike(r"[\r\n]\z")
    return rows.groupBy("id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x["own"]), "").cast("binary")).alias("digest"),
        F.count_if("over").alias("n_over"), F.count_if("apart").alias("n_apart"), F.count_if(~F.col("inside") & ~F.col("last") & ~at_end).alias("n_unlike"),
        F.count_if(F.col("inside") & F.col("own").rlike(r"[\r\n]")).alias("n_unforced"),
    )
