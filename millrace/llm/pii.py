"""Personal data by bootstrapped contextual extraction.

Seeds are the identifiers that the base patterns find. The word before an identifier induces a
lexical pattern (kind, word). Patterns and the values they stand before are a graph, and Spark scores
it iteratively: a pattern is as good as the mean score of its values, and a value as good as its
patterns together make it; seeds stay at 1. Rounds go on until the scores have settled. Values of a like shape that no base pattern accepts, but
that stand behind patterns of high confidence and support, are taken in as further identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. What precedes the @ of an address is read from there to the left.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words with a digit or an at sign, and what precedes them.
MENTION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: Groups of digits with marks and brackets, single spaces between them.
GROUP = r"[(+]*+[0-9][0-9()+./-]*+(?![^\s.,;:!?\"'<>\[\]{}()])"
RUN = re.compile(rf"(?<!\S){GROUP}(?: {GROUP})++")
#: Addresses with spaces around the sign, or with the word at for it; dots may be words too.
MAIL = re.compile(
    r"(?<!\S)[(<\[\"']*+([A-Za-z0-9._%+-]++(?: ?@ ?| ?[(\[](?:at|@)[)\]] ?| at )"
    r"([A-Za-z0-9-]++(?:(?:\.| dot | ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)*+))", re.I
)
MAIL_HINT = re.compile(r"@|\bat\b", re.I)
LABELS = re.compile(r"\.| dot | ?[(\[]dot[)\]] ?", re.I)
HINT = re.compile(r"[0-9@]|\bat\b", re.I)
CONTEXT = 48
#: Scores have settled when no confidence changes by more.
TOLERANCE = 1e-4
CONFIDENCE, SUPPORT = 0.9, 5
SPAN = "array<struct<start:int,place:int,end:int,kind:string,context:string,value:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in DOMAIN.finditer(text):
        at = match.start()
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at:
            done = match.end()
            yield begin, done


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Base identifiers as (start, place of the kind, end, kind), sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def shape(value: str) -> str | None:
    """The kind whose shape a value has that no base pattern took."""
    digits = sum(c.isdigit() for c in value)
    if value.count("@") == 1 and not value.startswith("@") and not value.endswith("@"):
        return "email"
    if not value.strip("0123456789+-./()"):
        if value.count(".") == 3 and 4 <= digits <= 12:
            return "ip"
        if 14 <= digits <= 19:
            return "card"
        if 7 <= digits <= 13:
            return "phone"
    return None


def _run(text: str, match: re.Match) -> Iterator[tuple[int, int, str]]:
    """The longest beginnings of a run of digit groups that have the shape of a phone number and of a card."""
    digits, found = 0, {}
    for n, group in enumerate(re.finditer("[^ ]+", match[0])):
        digits += sum(c.isdigit() for c in group[0])
        if digits > 19:
            break
        kind = "phone" if 7 <= digits <= 13 else "card" if 14 <= digits else None
        if not n:
            alone = kind  # a first group with that shape is a mention of its own
        elif kind and kind != alone:
            found[kind] = match.start() + group.end()
    for kind, end in found.items():
        start, value = match.start(), text[match.start() : end].rstrip(".,;:/+-(")
        whole = value[0] == "(" and value.find(")") == len(value) - 1
        if whole or (value[0] == "(" and value.count("(") > value.count(")")):
            start, value = start + 1, value[1:]
        if whole or value.count(")") > value.count("("):
            value = value.rstrip(")")
        yield start, start + len(value), kind


def context(text: str, start: int) -> str:
    """The last word before a place, in lower case; empty at the start of a text."""
    before = text[max(0, start - CONTEXT) : start].split()
    return before[-1].lower() if before else ""


def _read(text: str | None) -> tuple[list[tuple], list[tuple]]:
    if not text or not HINT.search(text):
        return [], []
    base = base_spans(text)
    seeds = [(*s, context(text, s[0]), text[s[0] : s[2]].lower()) for s in base]
    begins, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(begins, end)
        return not before or reach[before - 1] <= start

    found, runs = [], {kind: [] for kind in KINDS}
    for m in RUN.finditer(text):
        # What base patterns found ends a run.
        first = bisect_left(begins, m.start())
        if first < len(base) and begins[first] < m.end():
            m = RUN.match(text, m.start(), begins[first])
        for start, end, kind in _run(text, m) if m else ():
            if free(start, end):
                found.append((start, end, kind, m.start()))
                runs[kind].append((start, end))
    for m in MAIL.finditer(text) if MAIL_HINT.search(text) else ():
        labels = LABELS.split(m[2])
        if len(labels) > 1 and len(labels[-1]) > 1 and labels[-1].isalpha() and free(*m.span(1)):
            found.append((*m.span(1), "email", m.start()))
            runs["email"].append(m.span(1))
    for m in MENTION.finditer(text):
        value = m[0].strip(".,;:!?\"'()<>[]{}")
        kind = shape(value)
        if kind is None:
            continue
        start = m.start() + m[0].index(value)
        end = start + len(value)
        # A part of a longer mention of its kind is none.
        around = bisect_right(runs[kind], (start, len(text))) - 1
        if free(start, end) and (around < 0 or runs[kind][around][1] < end):
            found.append((start, end, kind, start))
    more = sorted((a, KINDS.index(k), b, k, context(text, at), text[a:b].lower()) for a, b, k, at in found)
    return seeds, more


def extract(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All identifiers of every row of ``docs`` (text): ``doc`` (a struct of the kept columns), ``base`` and ``more``.

    The last two are arrays of (start, place, end, kind, context, value), sorted by start and the order of the
    kinds; places are code points, end exclusive. ``more`` is what the bootstrapped patterns added, and
    overlaps with nothing in ``base``. A NULL text counts as empty; equal rows are read each for itself.
    """

    @F.pandas_udf(f"base {SPAN}, more {SPAN}")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [_read(t) for t in texts]
        return pd.DataFrame({"base": [f[0] for f in found], "more": [f[1] for f in found]})

    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), read(F.col("text").cast("string")).alias("__found")
    ).select("doc", "__found.base", "__found.more")
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "mentions", compression="zstd")
    patterns = score_patterns(rows)
    candidates = rows.where(F.size("more") > 0).select("__row", F.explode("more").alias("m"))
    taken = candidates.join(patterns, (F.col("m.kind") == patterns["kind"]) & (F.col("m.context") == patterns["context"]))
    # Where a number can end in two places and both are believed, the longer one counts.
    taken = taken.groupBy("__row", "m.start").agg(F.max_by("m", "m.end").alias("m"))
    taken = stage(taken.groupBy("__row").agg(F.array_sort(F.collect_list("m")).alias("__taken")), "taken")
    return rows.join(taken, "__row", "left").select(
        "doc", "base", F.coalesce("__taken", F.array().cast(SPAN)).alias("more")
    )


def score_patterns(rows: DataFrame) -> DataFrame:
    """The patterns (kind, context) of high confidence and support, at the fixed point of the scores; staged.

    Values with one pattern only give back a fixed part of its confidence, so that they are solved for within
    a round; rounds are needed for values with several patterns. Scores only grow from round to round, so the
    fixed point is the least one above the seeds.
    """
    seeds = rows.select(F.explode("base").alias("s"), F.lit(1.0).alias("seed"))
    others = rows.select(F.explode("more").alias("s"), F.lit(0.0).alias("seed"))
    seen = seeds.unionByName(others).where(F.col("s.context") != "")
    edges = seen.groupBy(F.col("s.kind").alias("kind"), F.col("s.context").alias("context"), F.col("s.value").alias("value"))
    edges = stage(edges.agg(F.max("seed").alias("seed")), "edges")
    patterns = edges.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("support"))
    # A pattern without support gives its values nothing.
    patterns = stage(patterns.where("support > 0"), "patterns")
    part = 0.99 * F.col("support") / (F.col("support") + SUPPORT)
    held = stage(edges.join(patterns, ["kind", "context"]).select("kind", "context", "value", "seed", part.alias("part")), "held")
    values = held.groupBy("kind", "value").agg(F.max("seed").alias("known"), F.count(F.lit(1)).alias("n_patterns"))
    held = stage(held.join(stage(values, "values"), ["kind", "value"]), "placed")
    single = F.when((F.col("known") == 0) & (F.col("n_patterns") == 1), F.col("part")).otherwise(0.0)
    sums = held.groupBy("kind", "context").agg(F.sum("known").alias("fixed"), F.sum(single).alias("back"))
    sums = stage(patterns.join(sums, ["kind", "context"]), "sums")
    several = stage(held.where("known = 0 and n_patterns > 1").select("kind", "context", "value", "part"), "several")
    solved = F.col("fixed") / (F.col("n") - F.col("back"))
    scored = stage(sums.withColumn("confidence", solved), "scored")
    while not several.isEmpty():
        edge = several.join(scored.select("kind", "context", "confidence"), ["kind", "context"])
        # A value is as good as its patterns together make it.
        score = 1 - F.exp(F.sum(F.log1p(-F.col("part") * F.col("confidence"))))
        believed = stage(edge.groupBy("kind", "value").agg(score.alias("score")), "believed")
        more = several.join(believed, ["kind", "value"]).groupBy("kind", "context").agg(F.sum("score").alias("more"))
        now = (F.col("fixed") + F.coalesce("more", F.lit(0.0))) / (F.col("n") - F.col("back"))
        last = scored.withColumnRenamed("confidence", "last").join(more, ["kind", "context"], "left")
        scored = stage(last.withColumn("confidence", now).drop("more"), "scored")
        change = scored.agg(F.max(F.abs(F.col("confidence") - F.col("last")))).first()[0]
        scored = scored.drop("last")
        if change <= TOLERANCE:
            break
    good = (F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)
    return stage(scored.where(good).select("kind", "context"), "good")


def masked(text: Column, spans: Column) -> Column:
    """The text with every identifier replaced by its kind in angle brackets."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str | None, spans) -> str | None:
            if text is None or spans is None or not len(spans):
                return text
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], s["place"])):
                if s["end"] > at:
                    parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"] if s["start"] >= at else []
                    at = s["end"]
            return "".join([*parts, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return mask(text, spans)
