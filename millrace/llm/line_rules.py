"""Quality rules, line first, in DataFrame operations only.

Every line is judged by itself: lines of navigation, boilerplate or broken punctuation are removed. A
document that loses too much of its text, or that fails the base rules on its whole text, is
rejected. All of it happens inside the row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words, and the symbols that are counted.
PARTING = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Share of a document's word characters that its lines may lose.
MOST_LOST = 0.6
#: Navigation: a line of so many short labels between bars, arrows or bullets.
BARS, LONGEST_LABEL, LEAST_LABELS = "[|»›•]", 40, 4
#: Phrases of lines that pages repeat around their text.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy",
    "cookie settings", "we use cookies", "enable javascript", "lorem ipsum", "sign up for our newsletter", "skip to content",
)
#: Punctuation: this many runs of symbols, or of marks of exclamation, in one line.
NOISE, MOST_NOISE = ("[#*$%&<>]{2,}", "!{2,}"), 3


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once, also where ``use`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def navigation(line: Column) -> Column:
    """Whether a line is labels between bars; it may end with a bar, and with blanks and dots.

    The line is split, as a pattern that repeats the labels would take stack for each of them.
    """

    def judged(labels: Column) -> Column:
        n, last = F.size(labels), F.element_at(labels, -1)
        bare = F.rtrim(last, F.lit(" ."))
        before = F.forall(F.slice(labels, 1, n - 1), lambda x: F.length(x).between(1, LONGEST_LABEL))
        open_end = (n >= LEAST_LABELS) & (F.length(last) > 0) & (F.length(bare) <= LONGEST_LABEL)
        return (n >= LEAST_LABELS) & before & (open_end | ((n > LEAST_LABELS) & (bare == "")))

    return _once(F.split(line, BARS), judged)


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, boilerplate or noise."""
    noise = [F.regexp_count(line, F.lit(p)) >= MOST_NOISE for p in NOISE]
    phrases = [F.contains(F.lower(line), F.lit(p)) for p in BOILERPLATE]
    return reduce(Column.__or__, [navigation(line), *noise, *phrases])


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.coalesce(F.array_remove(F.split(text, PARTING), ""), F.array().cast("array<string>"))


def repeated_words(of: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more, the first one included.

    The windows' hashes carry their position in the low bits. Sorted, equal windows are neighbours;
    what the position took from the hash is made good by comparing neighbours word by word. Two
    different windows could only hide a third between them if their remaining 40 or more bits agreed.
    """
    n = F.size(of)
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def marked(low: Column) -> Column:
        def mark(i: Column) -> Column:
            key = F.xxhash64(*[F.get(of, i + k) for k in range(3)])
            return key.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), mark))

    def covered(low: Column) -> Column:
        return _once(marked(low), lambda ordered: _covered(ordered, of, low))

    return F.when(n >= 3, _once(mask, covered)).otherwise(F.lit(0)).cast("long")


def _covered(ordered: Column, of: Column, low: Column) -> Column:
    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        equal = [F.get(of, i + k) == F.get(of, j + k) for k in range(3)]
        return F.coalesce(reduce(Column.__and__, [a.bitwiseXOR(b).between(F.lit(0), low), *equal]), F.lit(False))

    twice = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)))
    at = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low).cast("int")))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        at,
        start,
        lambda done, i: F.struct((done["n"] + F.least(F.lit(3), i - done["last"])).alias("n"), i.alias("last")),
        lambda done: done["n"],
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """Apply the rules to ``docs`` (text); its columns are kept, and these are added or replaced.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``; ``kept_lines`` (the
    lines that passed, joined again), ``lost`` (share of the word characters that went), ``base_failed``
    and ``kept``. NULL and empty texts have no word, so they fail the base rules. Equal rows have
    equal results.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = words(F.col("__text"))
    lines = F.split(F.col("__text"), "\n")
    spoken = F.filter("__lines", lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    passes = F.filter("__spoken", lambda line: ~line_fails(line))
    measured = (
        docs.withColumn("__text", text)
        .withColumns({"__words": of, "__lines": lines})
        .withColumn("__spoken", spoken)
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("__words")),
                "kept_lines": F.array_join(passes, "\n"),
            }
        )
    )
    chars = F.length(F.regexp_replace("kept_lines", PARTING, ""))
    lost = F.when(F.col("word_chars") > 0, 1 - chars / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = measured.withColumns({"lost": lost, "base_failed": failed})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MOST_LOST))
    return judged.drop("__text", "__words", "__lines", "__spoken")
