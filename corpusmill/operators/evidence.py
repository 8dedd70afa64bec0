"""Evidence in texts: complete forms, quotes, spans, retained runs of words, best paragraphs, and texts cut in half."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound, normalise
from .chunks import GAP, units

# Fixed values of retained excerpts: words of a run, its share of the excerpt's words, its characters, and excerpts of a text.
LEAST_WORDS, LEAST_SHARE, LEAST_CHARS, MOST_SPANS = 8, 0.4, 48, 3
#: Words that say nothing about a paragraph.
EVIDENCE_STOP_WORDS = (
    "этот", "этого", "этой", "этим", "этими", "для", "при", "как", "что", "или", "also", "with", "from", "that", "this", "they",
    "about", "into", "using", "used", "настройте", "используется", "сообщение", "сообщения", "сообщении", "сообщений", "письмо", "письма",
    "документ", "документа", "document", "message", "email",
)
NEGATION = r"(?iU)(?<!\w)(?:не|нет|без|not|no)(?!\w)"
_JOINT = "[.:-]"


def form_pattern(form: str, mode: str = "phrase") -> str:
    """A regular expression for a normalised form that stands by itself. In mode "identifier" it is also no part of a longer code:
    dots, colons and hyphens join codes, a slash belongs to them."""
    key = re.sub(r"\s+", " ", form).strip().lower()
    body = r"\Q" + key.replace(r"\E", r"\E\\E\Q") + r"\E"
    if mode == "identifier":
        return rf"(?U)(?:^|[^\w/.:-]){_JOINT}*{body}(?!{_JOINT}*[\w/])"
    return "(?U)" + (r"(?<!\w)" if key[0].isalnum() or key[0] == "_" else "") + body + (r"(?!\w)" if key[-1].isalnum() or key[-1] == "_" else "")


def holds_form(text: Column, forms: list[str], mode: str = "phrase") -> Column:
    """Whether the text holds one of the forms complete."""
    low, known = normalise(text), [f for f in forms if f.strip()]
    return F.lit(False) if not known else low.rlike("|".join(f"(?:{form_pattern(f, mode)})" for f in known))


def has_negation(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NEGATION)


def line_span(text: Column, first: Column | int, last: Column | int) -> Column:
    """(start, end) in characters of the lines first to last, from 0, the last not included; null outside the text or if empty."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    size = lambda ls, n: F.aggregate(F.slice(ls, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
    span = lambda ls: F.when((first >= 0) & (first < last) & (last <= F.size(ls)), F.struct(size(ls, first).alias("start"), size(ls, last).alias("end")))
    return bound(lines, span)


def unique_quote(text: Column, quote: Column) -> Column:
    """(start, end) of a quote that stands in the text once, whatever white space parts its words; null if it is not there or
    there twice, overlapping ones included."""
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    safe = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?U)"), F.array_join(safe, r"\s+"))

    def span(p: Column) -> Column:
        at = F.regexp_instr(text, p)
        again = F.regexp_instr(F.substring(text, at + 1, F.length(text)), p) > 0
        return F.when((at > 0) & ~again, F.struct((at - 1).alias("start"), (at - 1 + F.length(F.regexp_substr(text, p))).alias("end")))

    return F.when(F.size(words) > 0, bound(pattern, span))


def evidence_terms(text: Column) -> Column:
    """Distinct words of four characters or more, or with a digit, that say something."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 4) | w.rlike("[0-9]")) & ~w.isin(*EVIDENCE_STOP_WORDS)))


def best_paragraphs(paragraphs: DataFrame, key: str, place: str, text: str, title: str, content: str) -> DataFrame:
    """(key, place, score) of the paragraph that beats all others of its key; none where the best share a score. A paragraph counts
    with two shared words of the content, or one with a digit; shared words of the title count half."""
    shared = F.array_intersect(evidence_terms(F.col(text)), evidence_terms(F.col(content)))
    titled = F.size(F.array_intersect(evidence_terms(F.col(text)), evidence_terms(F.col(title))))
    score = bound(shared, lambda s: F.when((F.size(s) < 2) & ~F.exists(s, lambda w: w.rlike("[0-9]")), 0).otherwise(2 * F.size(s) + titled))
    scored = paragraphs.select(key, place, score.alias("score"))
    best = scored.groupBy(key).agg(F.max_by(place, "score").alias(place), F.max("score").alias("score"), F.count("*").alias("_n"))
    ties = scored.join(best.select(key, F.col("score").alias("_best")), key).where("score = _best").groupBy(key).agg(F.count("*").alias("_ties"))
    return best.join(ties, key).where("score > 0 AND _ties = 1 AND _n > 1").select(key, place, "score")


# ---------------------------------------------------------------- per text

_WORD = re.compile(r"\w+(?:[-']\w+)*")


def retained(text: str | None, excerpt: str | None) -> list[tuple[int, int]]:
    """Spans of the longest runs of words that a text shares with an excerpt, each of LEAST_WORDS and of LEAST_SHARE of the excerpt
    or more and at one place of the text only; at most MOST_SPANS, none overlapping."""
    source, asked = list(_WORD.finditer(text or "")), list(_WORD.finditer(excerpt or ""))
    known, wanted = [m[0] for m in source], [m[0] for m in asked]
    least = max(LEAST_WORDS, -(-2 * len(wanted) // 5))
    seeds: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(known) - least + 1):
        seeds.setdefault(tuple(known[i : i + least]), []).append(i)
    longest: dict[tuple[int, int], str] = {}
    for j in range(len(wanted) - least + 1):
        for i in seeds.get(tuple(wanted[j : j + least]), ()):
            if i and j and known[i - 1] == wanted[j - 1]:
                continue  # part of a run that began before
            n = least
            while i + n < len(known) and j + n < len(wanted) and known[i + n] == wanted[j + n]:
                n += 1
            # a shorter end may match where the punctuation of the whole run differs
            for size in range(n, least - 1, -1):
                quote = excerpt[asked[j].start() : asked[j + size - 1].end()]
                if len(quote) >= LEAST_CHARS:
                    longest[j, size] = quote
    best: set[tuple[int, int]] = set()
    found = 0
    for (_, size), quote in sorted(longest.items(), key=lambda x: -x[0][1]):
        if size < found:
            break
        pattern = re.compile(r"\s+".join(map(re.escape, quote.split())))
        m = pattern.search(text)
        if m and not pattern.search(text, m.start() + 1):
            best.add(m.span())
            found = size
    out: list[tuple[int, int]] = []
    for a, b in sorted(best):
        if len(out) < MOST_SPANS and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def retained_excerpts(pairs: DataFrame, key: str, text: str, excerpt: str) -> DataFrame:
    """(key, spans) of each pair of a text and an excerpt."""
    kind = pairs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(text).to_pylist(), batch.column(excerpt).to_pylist(), strict=True)
            found = [[{"start": a, "end": b} for a, b in retained(t, e)] for t, e in rows]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, spans)], names=[key, "spans"])

    return pairs.select(key, text, excerpt).mapInArrow(run, f"{key} {kind}, spans array<struct<start:long,end:long>>")


_RULE = re.compile(r"\|?(\s*:?-+:?\s*\|)+\s*:?-*:?\s*")


def halves(text: str) -> list[str]:
    """Two parts of about equal size at a blank line outside code, or of one table at a row, with its head in both; the text alone
    where neither can be."""
    parts = list(units(text))
    if len(parts) > 1:
        size, k = len(parts[0]), 1
        while k < len(parts) and size + len(parts[k]) < len(text) // 2:
            size += len(parts[k])
            k += 1
        return [GAP.join(parts[:k]), GAP.join(parts[k:])] if k < len(parts) else [text]
    lines = text.strip().split("\n")
    head = next((i + 2 for i in range(len(lines) - 1) if lines[i].lstrip().startswith("|") and _RULE.fullmatch(lines[i + 1].strip())), None)
    rows = lines[head:] if head else []
    if len(rows) < 2 or not all(r.lstrip().startswith("|") and r.rstrip().endswith("|") for r in rows):
        return [text]
    total, size, k = sum(len(r) + 1 for r in rows), 0, 0
    while k < len(rows) - 1 and 2 * size < total:
        size += len(rows[k]) + 1
        k += 1
    return ["\n".join(lines[:head] + rows[:k]), "\n".join(lines[:head] + rows[k:])]
