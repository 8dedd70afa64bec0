"""Two glossary terms made one: what each field and form becomes, what must be chosen first, and a digest that binds the choice to what was seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise

# Fields that a merge takes from either side, and those of them that make a new revision of the source text.
FIELDS = ("original_name", "original_description", "canonical_locale", "kind", "infotype_number", "enabled")
SOURCE_FIELDS = ("original_name", "original_description", "canonical_locale")
#: A term: its fields, revisions, and forms with their locale and rights.
ALIASES = "array<struct<alias:string,locale:string,auto_expand:boolean,search_enabled:boolean>>"
TERM = f"struct<{','.join(f'{f}:' + ('boolean' if f == 'enabled' else 'string') for f in FIELDS)},source_revision:bigint,version:bigint,aliases:{ALIASES}>"


def _has(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _key(alias: Column) -> Column:
    return F.replace(normalise(alias), F.lit("̇"), F.lit(""))


def canonical(c: Column, kind) -> Column:
    """A value as JSON with the keys of structs and maps in order, nulls kept: equal values give equal texts whatever the order of their
    fields. ``kind`` is the column's type."""
    name = kind.typeName()
    if name == "struct":
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif name == "array":
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif name == "map":
        pairs = F.array_sort(F.map_entries(c))
        body = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(canonical(e["key"], kind.keyType), F.lit(":"), canonical(e["value"], kind.valueType))), ","), F.lit("}"))
    elif name == "string":
        body = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    else:
        body = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(body)


def merged(rows: DataFrame, source: str, target: str, choices: str, alias_choices: str) -> DataFrame:
    """Rows with ``merged`` (a TERM), ``unresolved`` and ``digest``. choices: map of field to "source" or "target"; alias_choices: map of a form's
    key to its (locale, auto_expand, search_enabled).

    A field is the target's unless the source is chosen or the target has none. Fields that both have and that differ need a choice, and
    so do forms that both have with other rights or another locale, unless the name itself is the form; ``unresolved`` lists them and is
    empty for a merge that may be saved. Two different numbers never merge: "infotype_number" then stands in ``unresolved`` whatever was
    chosen. The names that give way become forms. Null terms, choices and lists are empty.
    """
    s, t = F.col(source), F.col(target)
    chosen = lambda f: F.try_element_at(F.col(choices), F.lit(f))
    take = {f: F.when((chosen(f) == "source") | chosen(f).isNull() & ~F.coalesce(_has(t[f]), F.lit(False)), s[f]).otherwise(t[f]) for f in FIELDS}
    differ = lambda f: F.coalesce(_has(s[f]) & _has(t[f]) & (s[f] != t[f]), F.lit(False))
    open_ = [F.when(differ(f) & (F.lit(f == "infotype_number") | chosen(f).isNull()), F.lit(f)) for f in FIELDS]
    name = _key(take["original_name"])
    none = F.array().cast(ALIASES)
    keyed = lambda xs: F.transform(F.coalesce(xs, none), lambda a: F.struct(_key(a["alias"]).alias("k"), a.alias("a")))
    as_form = lambda x: F.struct(x["original_name"].alias("alias"), x["canonical_locale"].alias("locale"), F.lit(True).alias("auto_expand"), F.lit(True).alias("search_enabled"))
    names = F.filter(F.array(*[F.when(F.coalesce(_has(x["original_name"]), F.lit(False)), F.struct(_key(x["original_name"]).alias("k"), as_form(x).alias("a"))) for x in (t, s)]), lambda x: x.isNotNull())
    out = rows.withColumns({"_name": name, "_both": F.concat(keyed(t["aliases"]), keyed(s["aliases"]), names)})
    # the first of each key, in order; the name is no form of itself
    first = F.aggregate(
        "_both", F.array().cast(out.schema["_both"].dataType.simpleString()),
        lambda acc, x: F.when((x["k"] == "") | (x["k"] == F.col("_name")) | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    right = lambda x: F.try_element_at(F.col(alias_choices), x["k"])
    given = lambda x: F.struct(x["a"]["alias"].alias("alias"), *[F.when(right(x).isNotNull(), right(x)[c]).otherwise(x["a"][c]).alias(c) for c in ("locale", "auto_expand", "search_enabled")])
    other = lambda x, y: (x["k"] == y["k"]) & reduce(lambda a, b: a | b, [~x["a"][c].eqNullSafe(y["a"][c]) for c in ("locale", "auto_expand", "search_enabled")])
    clash = F.array_distinct(F.transform(F.filter(keyed(s["aliases"]), lambda x: (x["k"] != F.col("_name")) & right(x).isNull() & F.exists(keyed(t["aliases"]), lambda y: other(x, y))), lambda x: F.concat(F.lit("aliases["), x["k"], F.lit("]"))))
    changed = reduce(lambda a, b: a | b, [~take[f].eqNullSafe(t[f]) for f in SOURCE_FIELDS]).cast("long")
    made = F.struct(*[take[f].alias(f) for f in FIELDS], (F.coalesce(t["source_revision"], F.lit(1)) + changed).alias("source_revision"), (F.coalesce(t["version"], F.lit(1)) + 1).alias("version"), F.transform(first, given).alias("aliases"))
    out = out.withColumns({"merged": made, "unresolved": F.concat(F.filter(F.array(*open_), lambda x: x.isNotNull()), clash)}).drop("_name", "_both")
    seen = F.struct(*[F.col(c).alias(n) for n, c in (("source", source), ("target", target), ("selections", choices), ("aliases", alias_choices), ("merged", "merged"))])
    kind = out.select(seen.alias("v")).schema["v"].dataType
    return out.withColumn("digest", F.sha2(canonical(seen, kind).cast("binary"), 256))
