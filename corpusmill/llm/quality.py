"""Line-first cleaning: rules judge each line, failing lines go, a document that loses too much text goes too.

Only DataFrame functions run here. Null and empty texts have no words and fail the base rule. Repeated rows get equal
results, an empty table gives an empty one; texts of any length are judged whole. Further columns pass through ``judge``
untouched, except that its own result columns win over equal names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, packed, word_array

SYMBOLS = "#*$%&|<>"
#: Full stops and their like of many scripts; those of spaced scripts need white space behind them.
SENTENCE_END = r"""[.!?…]["'”’»)\]]*([\x20\x09-\x0D]|$)|[。！？｡．؟۔।॥։።។៕။]"""
BOILERPLATE = (
    r"(?i)(released under the|licensed under|all rights reserved|terms of (use|service)|privacy policy"
    r"|use cookies|cookie policy|enable javascript|click here|sign up|subscribe now|skip to content)"
)
#: Lower-case pieces, one of which any boilerplate phrase holds; finding them is cheaper than the phrases.
HINTS = (
    "released under", "licensed under", "all rights", "terms of", "privacy", "cookie", "enable java", "click here", "sign up", "subscribe", "skip to",
)
#: Between the entries of menus and the steps of breadcrumbs.
SEPARATORS = "|»›·•→"
#: A line fails with more than one symbol for 3 words, one shout "!!" for 4 words or one separator for 4 words, and with one
#: boilerplate phrase for 20 words or less, so that a phrase alone fells no long paragraph.
SYMBOL_WORDS, SHOUT_WORDS, SEPARATOR_WORDS, BOILERPLATE_WORDS = 3, 4, 4, 20
#: A line of so many words needs the end of a sentence somewhere.
PROSE_WORDS = 4
#: A document goes if its failing lines hold more than this share (percent) of its characters.
MOST_LOST = 50
LEAST_WORDS, MOST_REPEATED = 50, 50


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _held(text: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column, n: Column) -> Column:
    """True for a line of n words that looks like markup, navigation, shouting, boilerplate or text without sentences."""
    low = F.lower(line)
    hinted = reduce(or_, [F.contains(low, F.lit(h)) for h in HINTS])
    return (n > 0) & (
        (_held(line, SYMBOLS) * SYMBOL_WORDS > n)
        | (_held(line, SEPARATORS) * SEPARATOR_WORDS > n)
        | ((F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) * SHOUT_WORDS > 2 * n)
        | ((n >= PROSE_WORDS) & ~line.rlike(SENTENCE_END))
        | (hinted & (_count(line, BOILERPLATE) * BOILERPLATE_WORDS >= n) & line.rlike(BOILERPLATE))
    )


#: Low bits of a sort key that hold a place; a longer text is sorted by its words.
PLACE_BITS = 24


def _repeated(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Each window becomes one number, the upper bits of its hash above its place, so equal windows are neighbours once the
    numbers are sorted. Where unequal windows share those bits the windows themselves are sorted instead.
    """
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    place_of = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    window = lambda i: [F.get(words, i + k) for k in range(3)]
    number = lambda i: F.shiftleft(hash_of(F.xxhash64(*window(i))), PLACE_BITS) + i

    def count(keys: Column) -> Column:
        after = lambda x, k: F.coalesce(hash_of(x) == hash_of(F.get(keys, k + 1)), F.lit(False))
        before = lambda x, k: F.coalesce(hash_of(x) == hash_of(F.get(keys, k - 1)), F.lit(False))
        unequal = lambda x, y: reduce(or_, [a != b for a, b in zip(window(place_of(x)), window(place_of(y)), strict=True)])
        clash = F.size(F.filter(keys, lambda x, k: after(x, k) & unequal(x, F.get(keys, k + 1)))) > 0
        found = F.filter(keys, lambda x, k: after(x, k) | before(x, k))
        return F.when(clash, _covered(_exact_starts(words, n))).otherwise(_covered(F.sort_array(F.transform(found, place_of))))

    fast = F.element_at(F.transform(F.array(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), number))), count), 1)
    return F.when(n < 4, F.lit(0).cast("long")).when(n < 1 << PLACE_BITS, fast).otherwise(_covered(_exact_starts(words, n)))


def _covered(starts: Column) -> Column:
    """Words in the windows at the sorted places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _exact_starts(words: Column, n: Column) -> Column:
    """Sorted places of the windows that occur twice or more, by sorting the windows."""
    triples = F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c"))
    order = F.sort_array(F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["t"] == F.get(s, k)["t"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))

    return F.element_at(F.transform(F.array(order), starts), 1)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the cleaned text ``clean_text``."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    held_text, held_words, held_lines = (free_name(c, docs.columns) for c in ("_t", "_w", "_l"))
    t, lines, words = F.col(held_text), F.col(held_lines), F.col(held_words)
    full = F.filter(lines, lambda x: x.rlike(WORD))
    counted = F.transform(lines, lambda x: F.struct(x.alias("s"), _count(x, WORD).alias("n")))
    good = F.transform(F.filter(counted, lambda x: ~line_fails(x["s"], x["n"])), lambda x: x["s"])
    n = F.size(words)
    base = docs.drop(*[c for c in own if c != text])
    out = base.withColumn(held_text, F.coalesce(F.col(text), F.lit(""))).withColumns({held_words: word_array(t), held_lines: F.split(t, "\n")})
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": (F.length(t) - _held(t, " \t\n\x0b\x0c\r")).cast("long"),
            "n_symbols": _held(t, SYMBOLS).cast("long"),
            "n_dup_lines": F.element_at(F.transform(F.array(full), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"),
            "n_repeat_words": _repeated(words, n),
            "clean_text": F.array_join(good, "\n"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.length(t) - F.length("clean_text")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * lost <= MOST_LOST * F.length(t))).drop(held_text, held_words, held_lines)


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed; the columns of ``docs``, whatever their names. Null and empty texts go, repeated rows
    have equal fates, an empty table stays empty, long texts are judged whole."""
    judged = judge(packed(docs, F.col("text").alias("text")))
    # a filter would be pushed down and work the rules out a second time; a generator takes what is there
    some = F.when(F.col("kept"), F.array("clean_text")).otherwise(F.array().cast("array<string>"))
    out = judged.select("row", F.explode(some).alias("clean"))
    kind = {"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    given = {"text": F.col("clean"), **kind}
    return out.select(*[given.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
