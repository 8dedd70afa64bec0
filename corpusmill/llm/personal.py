"""Personal data: patterns propose spans, boosted trees judge them by format and context, calibrated thresholds pick what is redacted.

Only DataFrame functions run on the rows. Four base kinds stand by their own rules (form, octets, Luhn sum, number of digits). Further
generators propose whatever could be a written-out mail address, a number without a plus sign, an IBAN, a social security number, a card in
odd groups or an IPv6 or hardware address; their spans overlap freely. Spark's gradient-boosted trees are fitted on TRAINING labelled
snippets, which Spark makes from a seed: forms and their look-alikes (orders, versions, times, sums, bad checksums) in plain and in
telling contexts. The trees become one SQL expression. On snippets that no tree saw, each kind gets the lowest score from which on
PRECISION of what is picked is right; a kind that never gets there picks nothing. Overlapping picks leave the best one, and a pick
that touches a base span gives way to it.

Positions are code points. Null and empty texts have no spans; repeated rows get equal results; an empty table gives an empty one. No
pattern repeats a group without bound or looks back over a run, so long texts of any content take time in proportion to
their length. Other columns pass through ``redact`` untouched and are not read by ``scan``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Labelled snippets, and the share of right picks that a threshold is set for.
TRAINING, PRECISION = 12_000, 0.98
TREES, DEPTH = 12, 4
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of the generators: written-out addresses, numbers without a plus, bank accounts, social security, odd cards, IPv6 or hardware addresses.
MORE_KINDS = ("mail", "tel", "iban", "ssn", "pan", "net")
KINDS = BASE_KINDS + MORE_KINDS
MASK = "[PERSONAL]"

# A text's own control characters 1 to 4 become 5, then 1 stands around matches, 2 for a separator outside numbers, 3 for a dot in a domain.
_OWN, _FREE = "\x01\x02\x03\x04", "\x05\x05\x05\x05"
_NEAR = 40
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,said:string,before:string,after:string>>"
_LOCAL = r"[A-Za-z0-9._%+\x03-]"
#: A match starts where its run of characters starts or where the last match ended, so no run is read twice.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]{12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

GENERATORS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])",
    "tel": r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\)[\x20./-]?|[0-9]{2,5}[\x20./-])[0-9]{3,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "pan": r"(?<![0-9A-Za-z.])[0-9]{4}[./_\x20-]{1,3}[0-9]{4,6}[./_\x20-]{1,3}[0-9]{4,5}(?:[./_\x20-]{1,3}[0-9]{1,7})?(?![0-9A-Za-z])",
    "net": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?:(?:::?|-)[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:-])",
}
#: What a text holds if its generator can propose anything.
HINTS = {
    "mail": r"(?i)[\[({\x20]at[\])}\x20]", "tel": r"[0-9][)\x20./-]{1,2}[0-9]{3}", "iban": r"[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]",
    "ssn": r"[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}", "pan": r"[0-9]{4}[./_\x20-]{1,3}[0-9]{4}", "net": r"[0-9A-Fa-f][:-][0-9A-Fa-f:]{1,5}[:-][0-9A-Fa-f]",
}
CUES = {
    "call": r"\b(?:tel|phone|call|mobile|cell|fax|contact|ring|reach|whatsapp|sms|dial)\b",
    "write": r"\b(?:e-?mail|mail|write|contact|reach|address|send)\b",
    "bank": r"\b(?:iban|account|bank|transfer|payment|pay|konto|compte|cuenta)\b",
    "pay": r"\b(?:card|visa|mastercard|amex|credit|debit|pan)\b",
    "identity": r"\b(?:ssn|social|security|tax|identity|passport|personal)\b",
    "host": r"\b(?:ip|ipv6|host|client|mac|device|router|address)\b",
    "thing": r"\b(?:order|invoice|version|isbn|issn|ref|reference|ticket|error|page|pages|date|lot|serial|part|total|sum|score|patent|build|release|section|chapter|item|sku|time|at|from|to|clock|ratio|shipment|model)\b",
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sums(numbers: Column, block: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... numbers; blocks keep what is copied small."""
    zero = F.lit(0).cast("long")
    grown = lambda part, first: F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    part = lambda i: F.slice(numbers, i * block + 1, block)
    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int"))
    totals = F.transform(blocks, lambda i: F.aggregate(part(i), zero, lambda acc, x: acc + x))
    firsts = _let(grown(totals, zero), lambda s: F.slice(s, 1, F.size(s) - 1))
    return F.flatten(F.transform(firsts, lambda first, i: _let(grown(part(i), first), lambda s: F.slice(s, 1, F.size(s) - 1))))


def _matches(kind: str, text: Column, pattern: str) -> Column:
    """The spans of a pattern from left to right."""
    plain = lambda c: F.translate(c, "\x02\x03", " .")

    def spans(pieces: Column) -> Column:
        size = lambda i: F.length(F.get(pieces, i))
        of = lambda starts: F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
            lambda i: F.struct(
                F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + size(i)).alias("end"), plain(F.get(pieces, i)).alias("said"),
                plain(F.right(F.get(pieces, i - 1), F.lit(_NEAR))).alias("before"), plain(F.left(F.get(pieces, i + 1), F.lit(_NEAR))).alias("after"),
            ),
        )
        return F.when(F.size(pieces) > 1, _let(_sums(F.transform(pieces, lambda p: F.length(p).cast("long"))), of)).otherwise(_none())

    return _let(F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x01")), "\x01", -1), spans)


def _none() -> Column:
    return F.array().cast(_SPANS)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _base(text: Column) -> Column:
    """The base spans, by kind and start."""
    n = lambda x: F.length(_digits(x["said"]))
    domains = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x03")
    chains = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\x02")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _matches("email", domains, EMAIL)).otherwise(_none()),
        F.when(text.rlike(IP), F.filter(_matches("ip", text, IP), lambda x: x["said"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))).otherwise(_none()),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(_matches("card", chains, CARD), lambda x: n(x).between(13, 19) & F.call_function("luhn_check", _digits(x["said"])))).otherwise(_none()),
        F.when(F.contains(text, F.lit("+")), F.filter(_matches("phone", text, PHONE), lambda x: n(x).between(9, 15))).otherwise(_none()),
    )


def _proposed(text: Column) -> Column:
    """The spans of all generators."""
    return F.concat(*[F.when(text.rlike(HINTS[k]), _matches(k, text, p)).otherwise(_none()) for k, p in GENERATORS.items()])


def _mod97(c: Column) -> Column:
    """Letters as 10 to 35; the number modulo 97."""
    value = lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(F.expr("0") + F.ascii(x) - 48)
    step = lambda acc, x: F.when(x == "", acc).otherwise((acc * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97)
    return F.aggregate(F.split(c, ""), F.lit(0), step)


def _features(x: Column) -> dict[str, Column]:
    """Numbers that the trees see of a proposed span: its form, its checksums, and what stands around it."""
    said, before, after = x["said"], F.lower(x["before"]), F.lower(x["after"])
    plain = F.upper(F.regexp_replace(said, "[^0-9A-Za-z]", ""))
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    number = lambda c: c.cast("double")
    return {
        **{f"is_{k}": flag(x["kind"] == k) for k in MORE_KINDS},
        "size": number(F.length(said)), "digits": number(F.length(_digits(said))), "letters": number(F.length(F.regexp_replace(said, "[^A-Za-z]", ""))),
        "groups": number(F.size(F.split(said, "[^0-9A-Za-z]+"))), "separators": number(F.size(F.array_distinct(F.split(F.regexp_replace(said, "[0-9A-Za-z]", ""), "")))),
        "luhn": flag((x["kind"] == "pan") & F.call_function("luhn_check", _digits(said))),
        "mod97": flag((x["kind"] == "iban") & (_mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1)),
        "bracket": flag(said.rlike(r"[\[({]")), "zero": flag(said.rlike(r"^\(?0")), "never": flag(said.rlike(r"^(?:000|666|9)|[\x20.-]00[\x20.-]|0000$")),
        "dotted": flag(said.rlike(r"(?i)dot[\])}]?\x20?[a-z]{2,6}$|\.[A-Za-z]{2,6}$")), "hex": flag(said.rlike("[A-Fa-f]")), "dash": flag(F.contains(said, F.lit("-"))),
        **{f"cue_{k}": flag(before.rlike(p)) for k, p in CUES.items()},
        "glued": flag(before.rlike(r"[=*/$€£#._:+-]\x20?$")), "number_before": flag(before.rlike(r"[0-9][\s.,/-]{0,2}$")),
        "number_after": flag(after.rlike(r"^[\s,/*=-]{0,2}[0-9]|^[.:][0-9]|^\x20?[%=*€$]")),
    }


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, bound, tree up to the bound, tree beyond) or numbers, their weights, and each kind's threshold."""

    names: tuple[str, ...]
    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def score(self, features: Column) -> Column:
        """The probability that the trees give a span."""

        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, bound, low, high = tree
            return F.when(features[self.names[feature]] <= bound, value(low)).otherwise(value(high))

        margin = reduce(add, [F.lit(w) * value(t) for w, t in zip(self.weights, self.trees, strict=True)])
        return 1 / (1 + F.exp(-2 * margin))


def _tree(lines: list[str]):
    """A tree of Spark's printed form, taken from the front of the lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    _, feature, _, bound = line[line.index("(") + 1 : line.rindex(")")].split(" ")
    low = _tree(lines)
    lines.pop(0)
    return int(feature), float(bound), low, _tree(lines)


def snippets(spark: SparkSession, n: int = TRAINING, seed: int = 5) -> DataFrame:
    """(id, text, kind, private): labelled snippets, one proposed span in each, as many of each kind."""
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k + 100 * seed)), F.lit(m))
    digits = lambda k, m: F.lpad(pick(k, 10**m).cast("string"), m, "0")
    one = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (pick(k, len(values)) + 1).cast("int"))
    joined = lambda k, seps, *parts: _let(one(k, seps), lambda s: F.call_function("concat_ws", s, *parts))
    between = lambda k, low, high, m: F.lpad((low + pick(k, high - low)).cast("string"), m, "0")
    name, host = one(1, ["anna.k", "j_smith", "info", "max.muster", "lee99", "dr.wong"]), one(2, ["mail", "example", "web-post", "uni", "firm"])
    top = one(3, ["com", "org", "de", "fr", "net", "es"])
    plain = ["", "and then ", "the words of ", "it is said that ", "le petit ", "der Tag "]
    things = ["order ", "invoice no. ", "version ", "isbn ", "ref ", "ticket ", "error ", "pages ", "serial ", "total of ", "patent ", "score ", "item "]
    calls, pays, banks, ids = ["call ", "phone: ", "tel. ", "mobile ", "reach me on "], ["card ", "visa ", "credit card: "], ["iban ", "account ", "transfer to "], ["ssn ", "social security no. ", "tax id "]
    hosts = ["ip ", "client ", "mac ", "device ", "host "]
    card = _let(F.concat(F.lit("4"), digits(10, 14)), lambda c: F.concat(c, F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(c, d.cast("string")))), 1).cast("string")))
    broken = lambda c: F.concat(F.substring(c, 1, 15), ((F.substring(c, 16, 1).cast("int") + 1 + pick(11, 8)) % 10).cast("string"))
    split = lambda c: joined(12, [".", "/", "_", " - ", "--", ". "], F.substring(c, 1, 4), F.substring(c, 5, 4), F.substring(c, 9, 4), F.substring(c, 13, 4))
    bban, land = F.concat(digits(13, 9), digits(14, 9)), one(15, ["DE", "FR", "ES", "IT", "NL"])
    check = F.lpad((98 - _mod97(F.concat(bban, land, F.lit("00")))).cast("string"), 2, "0")
    wrong = F.lpad(((98 - _mod97(F.concat(bban, land, F.lit("00"))) + 1 + pick(16, 90)) % 97).cast("string"), 2, "0")
    quads = [F.substring(bban, 4 * i + 1, 4) for i in range(5)]
    iban = lambda c: joined(17, [" ", "", "-"], F.concat(land, c), *quads)
    hexes = [F.lpad(F.lower(F.hex(pick(20 + i, 65536))), 4, "0") for i in range(8)]
    local, area = F.concat(digits(31, 3), one(32, ["-", ".", " "]), digits(33, 4)), F.concat(between(34, 201, 990, 3))
    every = plain + things
    forms = {
        "mail": [
            (one(40, plain + calls), F.concat(name, one(41, [" [at] ", "(at)", " (at) ", "[at]"]), host, one(42, [" [dot] ", "(dot)", ".", "[dot]"]), top), 1),
            (one(40, ["write to ", "e-mail: ", "mail me: "]), F.concat(name, F.lit(" at "), host, F.lit(" dot "), top), 1),
            (one(40, plain), F.concat(one(43, ["look", "met", "was", "he is"]), F.lit(" at "), one(44, ["home", "noon", "once", "work"]), one(45, [".and", ".then", " dot matrix", ".so-on", ".Ereon"])), 0),
        ],
        "tel": [
            (one(50, plain + calls), F.concat(F.lit("("), area, F.lit(") "), local), 1),
            (one(50, calls), joined(51, ["-", " ", "."], area, local), 1), (one(50, calls), F.concat(F.lit("0"), area, one(52, [" ", "/", "-"]), digits(53, 3), digits(54, 4)), 1),
            (one(50, things), joined(51, ["-", " ", "."], area, local), 0), (one(50, every), joined(51, ["/", " ", "."], digits(55, 2), digits(56, 4), digits(57, 4)), 0),
            (one(50, plain), F.concat(between(55, 1, 29, 2), F.lit("."), digits(56, 3), F.lit("."), digits(57, 3)), 0), (one(50, plain), joined(51, [" ", "."], area, digits(31, 3), digits(33, 3)), 0),
        ],
        "iban": [(one(60, plain + banks), iban(check), 1), (one(60, banks), iban(check), 1), (one(60, every), iban(wrong), 0), (one(60, things), iban(wrong), 0)],
        "ssn": [
            (one(70, ids), joined(71, ["-", " "], between(72, 101, 660, 3), between(73, 10, 99, 2), between(74, 1000, 9999, 4)), 1),
            (one(70, things), joined(71, ["-", " ", "."], digits(72, 3), digits(73, 2), digits(74, 4)), 0), (one(70, plain), joined(71, [" ", "."], digits(72, 3), digits(73, 2), digits(74, 4)), 0),
            (one(70, every), joined(71, ["-", " "], F.lit("000"), digits(73, 2), digits(74, 4)), 0), (one(70, ids), joined(71, ["-", " "], between(72, 901, 999, 3), digits(73, 2), F.lit("0000")), 0),
        ],
        "pan": [(one(80, plain + pays), split(card), 1), (one(80, pays), split(card), 1), (one(80, every), split(_let(card, broken)), 0), (one(80, things), split(_let(card, broken)), 0), (one(80, ["date ", "from ", "pages "]), F.concat_ws("-", digits(81, 4), digits(82, 4), digits(83, 4)), 0)],
        "net": [
            (one(90, plain + hosts), F.concat_ws(":", *hexes), 1), (one(90, hosts), F.concat_ws("::", F.concat_ws(":", *hexes[:3]), hexes[3]), 1),
            (one(90, plain + hosts), F.concat_ws(":", *[F.substring(h, 2, 2) for h in hexes[:6]]), 1),
            (one(90, ["time ", "at ", "clock ", "ratio ", *plain]), F.concat_ws(":", *[between(92 + i, 0, 60, 2) for i in range(4)]), 0), (one(90, every), F.concat_ws("-", *[digits(92 + i, 3) for i in range(4)]), 0),
        ],
    }
    after = one(97, ["", ".", ", thank you", " and so on", " was seen", ")"])
    rows = [F.struct(F.lit(kind).alias("kind"), F.concat(before, said, after).alias("text"), F.lit(private).alias("private"), (F.length(before) + F.length(said)).cast("long").alias("upto")) for kind, made in forms.items() for before, said, private in made]
    which = F.array(*[F.when(F.pmod("id", F.lit(len(rows))) == i, r) for i, r in enumerate(rows)])
    return spark.range(0, n, 1, 2).select("id", F.element_at(F.filter(which, lambda r: r.isNotNull()), 1).alias("row")).select("id", "row.*")


def examples(rows: DataFrame) -> DataFrame:
    """(id, kind, private, features) for each proposed span of labelled snippets; what doesn't lie at the labelled place isn't private."""
    found = rows.select("id", "upto", F.col("kind").alias("meant"), "private", F.explode(_proposed(F.col("text"))).alias("x"))
    label = (F.col("private") == 1) & (F.col("x.kind") == F.col("meant")) & (F.col("x.end") == F.col("upto"))
    near = (F.col("private") == 0) | (F.col("x.kind") == F.col("meant"))  # another kind's span over a private one is no error
    return found.where(near).select("id", F.col("x.kind").alias("kind"), label.cast("double").alias("private"), F.struct(*[c.alias(k) for k, c in _features(F.col("x")).items()]).alias("features"))


def fit(spark: SparkSession, n: int = TRAINING, precision: float = PRECISION) -> Model:
    """Trees from three quarters of n snippets, thresholds from the others: n rows at most come to the driver, as kinds, scores and labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = materialize(examples(snippets(spark, n)).select("id", "kind", "private", "features.*"))
    names = tuple(c for c in rows.columns if c not in ("id", "kind", "private"))
    held = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    seen = VectorAssembler(inputCols=list(names), outputCol="vector").transform(rows.where(~held)).select("vector", "private")
    fitted = GBTClassifier(featuresCol="vector", labelCol="private", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxMemoryInMB=64, cacheNodeIds=False).fit(seen)
    trees = tuple(_tree(t.toDebugString.strip().splitlines()[1:]) for t in fitted.trees)
    model = Model(names, trees, tuple(map(float, fitted.treeWeights)), {})
    judged = rows.where(held).select("kind", "private", model.score(F.struct(*names)).alias("score")).collect()
    return Model(names, trees, model.weights, {k: threshold([(r.score, r.private) for r in judged if r.kind == k], precision) for k in MORE_KINDS})


def threshold(scores: list[tuple[float, float]], precision: float) -> float:
    """The lowest score from which on this share or more is labelled, in steps of equal scores; above 1 if there is none."""
    at, right, n = math.inf, 0.0, 0
    ordered = sorted(scores, reverse=True)
    for k, (score, label) in enumerate(ordered):
        right, n = right + label, n + 1
        if (k + 1 == len(ordered) or ordered[k + 1][0] < score) and right >= precision * n:
            at = score
    return at - 1e-9 if at < math.inf else 2.0


def _chosen(proposed: Column, base: Column, model: Model) -> Column:
    """The proposed spans from their thresholds on, without those that touch a base span or a better one."""
    told = lambda x: F.struct(*[c.alias(k) for k, c in _features(x).items()])
    bound = lambda x: reduce(lambda c, k: F.when(x["kind"] == k, F.lit(model.thresholds[k])).otherwise(c), MORE_KINDS, F.lit(2.0))
    scored = F.transform(proposed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _let(told(x), model.score).alias("score"), x["kind"].alias("kind"), bound(x).alias("bound")))
    free = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    picked = F.filter(F.filter(scored, lambda x: x["score"] >= x["bound"]), free)
    form = "struct<start:bigint,end:bigint,score:double,kind:string,bound:double>"
    first = F.struct(F.array().cast(f"array<{form}>").alias("done"), F.lit(None).cast(form).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        apart = last.isNotNull() & (x["start"] >= last["end"])
        better = last.isNull() | (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (x["end"] - x["start"] > last["end"] - last["start"]))
        return F.struct(F.when(apart, F.concat(acc["done"], F.array(last))).otherwise(acc["done"]).alias("done"), F.when(apart | better, x).otherwise(last).alias("last"))

    return F.aggregate(F.array_sort(picked), first, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def spans(text: Column, model: Model) -> Column:
    """All spans of a text, by kind as in KINDS and start."""
    slim = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    of = lambda xs, kind: F.filter(xs, lambda x: x["kind"] == kind)
    order = lambda xs: F.concat(*[of(xs, kind) for kind in MORE_KINDS])

    def found(t: Column) -> Column:
        return _let(_base(t), lambda base: F.concat(slim(base), order(slim(_chosen(_proposed(t), base, model)))))

    # no span is without a digit, an "@" or a written-out "at"
    may = text.rlike(r"[0-9@]|[\[({\x20](?:at|AT)[\])}\x20]")
    return F.when(may, _let(F.translate(text, _OWN, _FREE), found)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans) for each row, spans by kind and start."""
    model = model or fit(docs.sparkSession)
    return docs.select("doc_id", spans(F.coalesce("text", F.lit("")), model).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with each run of overlapping spans in ``text`` replaced by MASK."""
    model = model or fit(docs.sparkSession)
    t = F.coalesce("text", F.lit(""))
    ordered = lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    zero = F.lit(0).cast("long")

    def masked(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = (x["start"] >= acc["end"]) | (acc["out"] == "")
            gap = F.substring(t, (acc["end"] + 1).cast("int"), (x["start"] - acc["end"]).cast("int"))
            return F.struct(F.when(new, F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"), F.greatest(acc["end"], x["end"]).alias("end"))

        folded = F.aggregate(xs, F.struct(F.lit("").alias("out"), zero.alias("end")), step)
        return _let(folded, lambda acc: F.concat(acc["out"], F.substring(t, (acc["end"] + 1).cast("int"), F.lit(2**31 - 1))))

    return docs.withColumn("text", _let(ordered(spans(t, model)), lambda xs: F.when(F.size(xs) > 0, masked(xs)).otherwise(F.col("text"))))
