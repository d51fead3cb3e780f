"""Scalar functions on statements, literals, identifiers and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(sql: Column) -> Column:
    """White space collapsed, ends trimmed, no semicolons at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(sql), "\\s+", " "), ";+$", ""))


def clauses(text: Column) -> Column:
    """The parts of a text between commas outside parentheses, trimmed, without empty ones."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = (c == ",") & (s["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"), F.when(cut, F.array_append(s["parts"], s["part"])).otherwise(s["parts"]).alias("parts"))

    parts = F.aggregate(F.split(text, ""), zero, step, lambda s: F.array_append(s["parts"], s["part"]))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def quoted(name: Column) -> Column:
    """An identifier in backticks."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def scalar_kind(raw: Column) -> Column:
    """What a decoded literal is: null, string, int, float or raw."""
    t = F.trim(raw)
    return (
        F.when(F.upper(t) == "NULL", "null")
        .when(F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'")) & (F.length(t) >= 2), "string")
        .when(t.rlike("^[+-]?[0-9]+$"), "int")
        .when(t.rlike("^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("raw")
    )


def scalar(raw: Column, kind: Column | None = None) -> Column:
    """The decoded literal as text; quotes go, and \\' and \\\\ lose their backslash. kind: its scalar_kind(), where that is
    a column already."""
    t, kind = F.trim(raw), scalar_kind(raw) if kind is None else kind
    inner = F.replace(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))
    return F.when(kind == "string", inner).when(kind != "null", t)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what is none."""
    return F.to_json(F.try_parse_json(text))


def first_key(row: Column) -> Column:
    """The name of the key column of a row image (map): id, else the first *_id, else the first value that is not null."""
    names = F.array_sort(F.map_keys(row))
    ids = F.filter(names, lambda k: F.endswith(F.lower(k), F.lit("_id")))
    full = F.filter(F.map_entries(row), lambda e: e["value"].isNotNull())
    return F.when(F.array_contains(names, "id"), "id").when(F.size(ids) > 0, F.get(ids, F.lit(0))).otherwise(F.get(full, F.lit(0))["key"])


def elapsed_label(seconds: Column) -> Column:
    """An age as minutes, hours and minutes, or days."""
    m = F.floor(seconds / 60)
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("min"))
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(m < 1440, hours).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("j")))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def preview(text: Column, most: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(most))


def clean_map(row: Column) -> Column:
    """A map of binary keys and values as text."""
    return F.map_from_entries(F.transform(F.map_entries(row), lambda e: F.struct(F.make_valid_utf8(e["key"].cast("string")), F.make_valid_utf8(e["value"].cast("string")))))


#: Fixed value: the namespace of URLs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The UUID of a name (version 5, from SHA-1): the same content has the same id, whoever makes it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def renamed_keys(json: Column, columns: Column) -> Column:
    """JSON text with the keys UNKNOWN_COL{n} of its objects, at every depth, renamed to columns[n] (an array, from 0).

    Works on the canonical text: there a quote that follows { or , and comes before such a name begins a key, since quotes
    inside texts are escaped. An ordinal beyond the columns stays, for unresolved() to find.
    """
    parts = F.split(canonical_json(json), '(?<=[{,])"UNKNOWN_COL(?=[0-9]+":)')
    number = lambda p: F.regexp_extract(p, "^([0-9]+)", 1)

    def name(p: Column) -> Column:
        known = F.get(columns, number(p).cast("int"))
        escaped = F.replace(F.replace(known, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), F.coalesce(escaped, F.concat(F.lit("UNKNOWN_COL"), number(p))), F.regexp_replace(p, "^[0-9]+", ""))

    return canonical_json(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(name(p))), ""))


def unresolved(json: Column) -> Column:
    """Whether an object of the JSON text still has a key UNKNOWN_COL{n}."""
    return canonical_json(json).rlike('[{,]"UNKNOWN_COL[0-9]+":')
