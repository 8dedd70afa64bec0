"""Glossary forms in queries as spans of the text that was typed, and plans that add the other forms of what was found.

A query is normalised with the place of each of its characters kept. Forms of one word are looked up word by word, one Aho-Corasick
automaton finds all others in one pass, and a join gives the terms. Longest spans win; a form that several terms claim triggers none of them. Null texts have no spans.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..session import few, settled

#: Forms of one automaton; more are dealt to several, each of which sees all queries.
MOST_FORMS = 200_000
# Terms of a plan, forms added for a term, tokens and characters added in all, characters of a query.
MOST_TERMS, MOST_ADDED, MOST_TOKENS, MOST_CHARS, MOST_QUERY = 5, 4, 32, 768, 8192
#: Places that a task holds before it hands them on.
MOST_PLACES = 20_000
#: Characters that join the parts of a code, and one that belongs to codes.
JOINTS, SLASH = ".:-", "/"
BLANKS, PARTS = re.compile(" {2,}"), re.compile(r"\w+")


def mapped(text: str) -> tuple[str, list[int], list[int]]:
    """(normalised text, start and end in the text of each of its characters): each character with its combining marks is composed and
    lower-cased, white space is one space, none at the ends."""
    bases = [i for i, c in enumerate(text) if i == 0 or not unicodedata.combining(c)]
    parts = []
    for a, b in itertools.pairwise([*bases, len(text)]):
        cluster = text[a:b]
        shown = " " if cluster.isspace() else unicodedata.normalize("NFC", cluster).lower().replace("̇", "")
        parts += [(" " if c.isspace() else c, a, b) for c in shown]
    out = []
    for blank, run in itertools.groupby(parts, lambda p: p[0] == " "):
        held = list(run)
        out += [(" ", held[0][1], held[-1][2])] if blank else held
    if out and out[0][0] == " ":
        out = out[1:]
    if out and out[-1][0] == " ":
        out.pop()
    return "".join(c for c, _, _ in out), [a for _, a, _ in out], [b for _, _, b in out]


class _Shown(dict):
    """What ``mapped`` makes of a character by itself; of one that joins others or becomes several, two blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        shown = " " if c.isspace() else unicodedata.normalize("NFC", c).lower().replace("̇", "")
        self[code] = shown = "  " if unicodedata.combining(c) or len(shown) != 1 else " " if shown.isspace() else shown
        return shown


_SHOWN = _Shown()


def placed(text: str):
    """(normalised text, start of a character in the text, end of one), as ``mapped`` has them. Where each character becomes one, only the
    runs of blanks that it shortens are noted."""
    low = text.translate(_SHOWN)
    if len(low) != len(text):
        low, starts, ends = mapped(text)
        return low, starts.__getitem__, ends.__getitem__
    lead = len(low) - len(low.lstrip(" "))
    low = low.strip(" ")
    if "  " not in low:
        return low, lambda p: p + lead, lambda p: p + lead + 1
    behind, gone = [0], [lead]
    for run in BLANKS.finditer(low):
        gone.append(gone[-1] + run.end() - run.start() - 1)
        behind.append(run.end() - gone[-1] + lead)
    low = BLANKS.sub(" ", low)
    start = lambda p: p + gone[bisect_right(behind, p) - 1]
    return low, start, lambda p: start(p) + 1 if low[p] != " " else start(p + 1)


def normal(form: str | None) -> str:
    """The key of a form."""
    value = " ".join(unicodedata.normalize("NFC", form or "").split()).lower().replace("̇", "")
    return unicodedata.normalize("NFC", value)


def _part(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a span stands by itself as a phrase, and as an identifier: no part of a longer code, which joints hold together."""
    left, right = start - 1, end
    before, after = text[left:start] if start else "", text[end : end + 1]
    phrase = not (before and _part(before) and _part(text[start])) and not (after and _part(after) and _part(text[end - 1]))
    while left >= 0 and text[left] in JOINTS:
        left -= 1
    while right < len(text) and text[right] in JOINTS:
        right += 1
    beyond = [text[i] for i in (left, right) if 0 <= i < len(text)]
    return phrase, not any(_part(c) or c == SLASH for c in beyond)


def keyed(forms: DataFrame) -> DataFrame:
    """Adds ``norm`` to forms (form, ...); empty ones go."""

    def run(batches):
        for batch in batches:
            yield batch.append_column("norm", pa.array([normal(f) for f in batch.column("form").to_pylist()], pa.string()))

    return forms.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in forms.schema) + ", norm string").where("norm <> ''")


def phrases(low: str, whole: set[str], automaton):
    """(form, start, end, code) of the phrases in a normalised text. A form that is one word is a phrase where it is a whole word; what is
    no phrase is no code either."""
    size = len(low)
    for word in PARTS.finditer(low):
        form = word.group()
        if form in whole:
            a, b = word.span()
            alone = (a == 0 or low[a - 1] == " ") and (b == size or low[b] == " ")
            yield form, a, b, alone or bounded(low, a, b)[1]
    free: dict[str, int] = {}
    for last, form in automaton.iter(low) if len(automaton) else ():
        a, b = last + 1 - len(form), last + 1
        if a < free.get(form, 0):
            continue
        free[form] = b
        phrase, code = bounded(low, a, b)
        if phrase:
            yield form, a, b, code


def located(batches, forms: list[str], key: str, text: str, once: bool = False):
    """Record batches of the places of some forms in batches of texts, none of more than MOST_PLACES rows; ``once``: one place of a form in
    a text."""
    import ahocorasick

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())

    def handed(batch, rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        keys = batch.column(key).take(pa.array(columns[0], pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]], names=[key, "norm", "start", "end", "matched", "phrase", "code"])

    whole = {form for form in forms if PARTS.fullmatch(form)}
    automaton = ahocorasick.Automaton()
    for form in forms:
        if form not in whole:
            automaton.add_word(form, form)
    automaton.make_automaton()
    for batch in batches:
        rows = []
        for i, value in enumerate(batch.column(text)):
            typed = value.as_py() or ""
            low, start, end = placed(typed)
            seen: set[str] = set()
            for form, a, b, code in phrases(low, whole, automaton):
                if once:
                    if form in seen:
                        continue
                    seen.add(form)
                first, past = start(a), end(b - 1)
                rows.append((i, form, first, past, typed[first:past], True, code))
                if len(rows) == MOST_PLACES:
                    yield handed(batch, rows)
                    rows = []
        if rows:
            yield handed(batch, rows)


def occurrences(queries: DataFrame, norms: DataFrame, key: str, text: str, most: int = MOST_FORMS, once: bool = False) -> DataFrame:
    """(key, norm, start, end, matched, phrase, code): every place of every form (norm), from the left and each form's own places apart;
    ``once``: one of them for each text."""
    spark = queries.sparkSession
    found = norms.select("norm").distinct()
    slices = -(-found.count() // most) or 1
    dealt = F.pmod(F.xxhash64("norm"), F.lit(slices))
    kind = queries.schema[key].dataType.simpleString()
    passes = []
    for k in range(slices):
        held = spark.sparkContext.broadcast([r.norm for r in found.where(dealt == k).collect()])  # about ``most`` forms

        def run(batches, held=held):
            yield from located(batches, held.value, key, text, once)

        passes.append(queries.select(key, text).mapInArrow(run, f"`{key}` {kind}, norm string, start long, end long, matched string, phrase boolean, code boolean"))
    out = passes[0]
    for other in passes[1:]:
        out = out.unionByName(other)
    return out


def claims(known: DataFrame) -> DataFrame:
    """Keyed forms (term_id, form, norm, mode, can_trigger, can_search) with ``shared``: whether several terms claim the form."""
    shared = known.groupBy("norm").agg((F.count_distinct("term_id") > 1).alias("shared"))
    return known.join(shared, "norm")


def triggers(known: DataFrame) -> DataFrame:
    """Forms (norm, term_id, form, mode) that trigger: those that one term alone claims."""
    return claims(known).where("can_trigger AND NOT shared").select("norm", "term_id", "form", "mode")


def contested(known: DataFrame) -> DataFrame:
    """Triggering forms (norm, term_id, form) that several terms claim."""
    return claims(known).where("can_trigger AND shared").select("norm", "term_id", "form").distinct()


def spans(places: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, term_id, form, start, end, matched): of overlapping places of triggering forms the longest stays, then the first, then the
    least term and form."""
    own = few(triggers(known))
    met = places.join(own, "norm").where((F.col("mode") == "identifier") & F.col("code") | (F.col("mode") == "phrase") & F.col("phrase"))
    row = F.struct((F.col("start") - F.col("end")).alias("o"), "start", "term_id", "norm", "form", "end", "matched")
    # places that no chain of overlaps joins can't bar each other
    along = W.partitionBy(key).orderBy("start", "end")
    apart = F.col("start") >= F.coalesce(F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chained = met.withColumn("_apart", apart.cast("int")).withColumn("_chain", F.sum("_apart").over(along.rowsBetween(W.unboundedPreceding, 0)))
    gathered = chained.groupBy(key, "_chain").agg(F.array_sort(F.collect_set(row)).alias("c"))
    clear = lambda acc, x: ~F.exists(acc, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
    taken = F.aggregate("c", F.filter("c", lambda x: F.lit(False)), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return gathered.select(key, F.inline(taken)).select(key, "term_id", "form", "start", "end", "matched")


def refused(places: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, term_id, form): forms of a query that several terms claim, for each of them."""
    # rows of both sides are there once, and a form has one norm
    return places.where("phrase").select(key, "norm").distinct().join(few(contested(known)), "norm").select(key, "term_id", "form")


def refusals(places: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, forms, terms): how many forms ``refused`` has for a query, in lower case, and how many terms. Places are dealt out by query
    before the claims of a form multiply them."""
    claimed = contested(known)
    low, none = F.lower("form").alias("low"), F.lit(None)
    either = claimed.select("norm", low, none.cast("long").alias("term_id")).unionByName(claimed.select("norm", none.cast("string").alias("low"), "term_id"))
    met = places.where("phrase").select(key, "norm").repartition(key).join(few(either.distinct()), "norm")
    return met.select(key, "low", "term_id").distinct().groupBy(key).agg(F.count("low").alias("forms"), F.count("term_id").alias("terms"))


def plans(queries: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, expanded, added, skipped) for each query: the forms that its first terms add within the budgets, each on a line of its
    own behind the query, and what was left out with the reason. Status: no_match, applied, limited."""
    known = settled(keyed(known))
    places = settled(occurrences(queries, known, key, text))
    found = spans(places, known, key).groupBy(key, "term_id").agg(F.min("start").alias("first"))
    terms = settled(found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "term_id"))).alias("terms")))
    there = places.select(key, "norm", "phrase", "code").distinct().join(few(known.select("norm", "mode").distinct()), "norm").where((F.col("mode") == "identifier") & F.col("code") | (F.col("mode") == "phrase") & F.col("phrase"))
    there = there.select(key, "norm").distinct().withColumn("there", F.lit(True))
    listed = terms.select(key, F.posexplode("terms").alias("place", "t")).select(key, "place", "t.term_id")
    # what is counted of a form is counted once, not for each query
    tokens = F.size(F.regexp_extract_all(F.lower("form"), F.lit(TOKEN), F.lit(1)))
    searched = settled(known.where("can_search").select("term_id", "form", "norm", tokens.alias("n"), F.length("form").alias("size")))
    shown = listed.where(F.col("place") < MOST_TERMS).join(few(searched), "term_id", "left").join(there, [key, "norm"], "left").where("there IS NULL AND form IS NOT NULL")
    # of terms past the last one taken no form is added: one row each says that something was left out
    total = searched.groupBy("term_id").agg(F.count_distinct("norm").alias("_all"))
    held = there.join(few(searched.select("term_id", "norm").distinct()), "norm").groupBy(key, "term_id").agg(F.count("*").alias("_held"))
    past = listed.where(F.col("place") >= MOST_TERMS).join(few(total), "term_id", "left").join(held, [key, "term_id"], "left").where("_all IS NULL OR coalesce(_held, 0) < _all")
    past = past.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "term_id"))).alias("past"))
    row = F.struct("place", "term_id", "form", "norm", "n", "size")
    offered = shown.groupBy(key).agg(F.array_sort(F.collect_set(row)).alias("offered"))
    note = lambda x, why, form: F.struct(x["term_id"].alias("term_id"), F.lit(why).alias("reason"), form.alias("form"))
    skip = "array<struct<term_id:bigint,reason:string,form:string>>"
    start = F.struct(
        F.array().cast("array<string>").alias("added"), F.array().cast("array<string>").alias("norms"), F.array().cast(skip).alias("skipped"), F.lit(0).alias("tokens"), F.lit(0).alias("chars"),
        F.length(text).alias("size"), F.array().cast("array<string>").alias("dense"), F.lit(-1).alias("place"), F.lit(0).alias("of_term"),
    )

    def step(acc: Column, x: Column) -> Column:
        of_term = F.when(x["place"] == acc["place"], acc["of_term"]).otherwise(0)
        new = ~F.array_contains(acc["norms"], x["norm"])
        over_aliases = new & (of_term == MOST_ADDED)
        n, size = x["n"], x["size"]
        over_tokens, over_chars = acc["tokens"] + n > MOST_TOKENS, acc["chars"] + size > MOST_CHARS
        taken = new & (of_term < MOST_ADDED) & ~over_tokens & ~over_chars
        lengthy = taken & (acc["size"] + 1 + size > MOST_QUERY)
        none = F.lit(None).cast("string")
        why = F.when(over_aliases, F.array(note(x, "max_added_aliases_per_term", none)))
        why = why.when(new & (of_term < MOST_ADDED) & over_tokens, F.array(note(x, "max_added_tokens", x["form"]))).when(new & (of_term < MOST_ADDED) & over_chars, F.array(note(x, "max_added_chars", x["form"])))
        why = why.when(lengthy, F.array(note(x, "max_query_text_chars", x["form"]))).otherwise(F.array().cast(skip))
        some = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.concat(acc["added"], some(taken, x["form"])).alias("added"), F.concat(acc["norms"], some(taken, x["norm"])).alias("norms"), F.concat(acc["skipped"], why.cast(skip)).alias("skipped"),
            (acc["tokens"] + F.when(taken, n).otherwise(0)).alias("tokens"), (acc["chars"] + F.when(taken, size).otherwise(0)).alias("chars"),
            (acc["size"] + F.when(taken & ~lengthy, 1 + size).otherwise(0)).alias("size"), F.concat(acc["dense"], some(taken & ~lengthy, x["form"])).alias("dense"),
            x["place"].alias("place"), (of_term + F.when(new, 1).otherwise(0)).alias("of_term"),
        )

    # a form that was skipped for one term may still come in by a later one, as it was not added
    folded = queries.select(key, text).join(offered, key, "left").join(past, key, "left").join(terms.select(key, F.lit(True).alias("has")), key, "left")
    out = folded.withColumn("f", F.aggregate(F.coalesce("offered", F.array().cast("array<struct<place:int,term_id:bigint,form:string,norm:string,n:int,size:int>>")), start, step))
    notes = F.transform("past", lambda x: note(x, "max_terms_per_query", F.lit(None).cast("string")))
    out = out.withColumn("skipped", F.concat("f.skipped", F.coalesce(notes, F.array()).cast(skip)))
    status = F.when(F.col("has").isNull(), "no_match").when(F.size("skipped") > 0, "limited").otherwise("applied")
    return out.select(key, status.alias("status"), F.array_join(F.concat(F.array(F.col(text)), "f.dense"), "\n").alias("expanded"), F.col("f.added").alias("added"), "skipped")
