"""Scalar functions as column expressions: ids, numbers, tokens, keys and text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def edge_id(u: Column, v: Column) -> Column:
    """Canonical id of an undirected edge: the smaller end, a bar, the larger end."""
    return F.concat_ws(SEPARATOR, F.least(u, v), F.greatest(u, v))


def normalise_edge_id(text: Column) -> Column:
    """`b|a` to `a|b`; null unless there are exactly two non-blank parts."""
    parts = F.transform(F.split(text, "\\|"), lambda t: F.trim(t))
    good = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(good, edge_id(F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))))


def finite_number(text: Column) -> Column:
    """A number as a script language reads it: blank is 0, hexadecimal is read, a trailing letter, NaN and
    infinities are refused (null)."""
    t = F.trim(text)
    decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
        .when(decimal, t.try_cast("double"))
    )
    return F.when(F.abs(value) < float("inf"), value)


def tokens(text: Column) -> Column:
    """Parts between white space, commas and semicolons, without blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,;]+"), lambda x: x != "")


def accession_tokens(text: Column, scores: bool = False) -> Column:
    """Tokens without other than letters and digits; with `scores`, bracketed numbers go first."""
    body = F.regexp_replace(text, r"\(\s*\d*\.?\d+\s*\)", " ") if scores else text
    return F.filter(F.transform(tokens(body), lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")), lambda x: x != "")


def length_ratio(a: Column, b: Column) -> Column:
    """Longer over shorter; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


def base_name(text: Column) -> Column:
    """File name up to its first dot, without underscores."""
    return F.replace(F.substring_index(text, ".", 1), F.lit("_"), F.lit(""))


def parent_id(cluster: Column) -> Column:
    """A dotted id without its last part; an id of one part is its own."""
    return F.regexp_replace(cluster, r"\.[^.]+$", "")


def dotted_key(cluster: Column) -> Column:
    """Sort key of a dotted id: parts in turn, numbers by value and before words."""
    part = lambda p: F.struct(F.when(p.rlike(r"^\d+$"), 0).otherwise(1).alias("word"), F.coalesce(F.when(p.rlike(r"^\d{1,18}$"), p.try_cast("long")), F.lit(0)).alias("number"), p.alias("text"))
    return F.transform(F.split(cluster, r"\."), part)


def node_key(node: Column) -> Column:
    """Sort key of a node id that may be a number: numbers first, by value."""
    number = node.try_cast("long")
    return F.struct(number.isNull().alias("word"), number.alias("number"), node.alias("text"))


def hash32(text: Column, bits: int = 32) -> Column:
    """FNV-1a over the UTF-8 bytes of a text."""
    codes = F.transform(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).try_cast("long"))
    codes = F.filter(codes, lambda c: c.isNotNull())
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << bits).cast("long")))


def string_angle(a: Column, b: Column) -> Column:
    """A direction in [0, 2 pi) fixed by two ids: a 31-multiplier hash modulo 2 ** 32."""
    codes = F.transform(F.split(F.concat_ws("|", a, b), ""), lambda t: F.ascii(t))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: F.pmod(s * 31 + c, F.lit(1 << 32).cast("long")))
    return h / F.lit(float(1 << 32)) * F.lit(2) * F.pi()


def node_radius(size: Column) -> Column:
    return 7 + 3 * F.ln(F.greatest(size, F.lit(1)).cast("double"))


def edge_width(weight: Column) -> Column:
    return F.greatest(F.lit(1.0), F.sqrt(F.greatest(weight, F.lit(0.0))))


def csv_cell(text: Column) -> Column:
    """Quoted only where needed, quotes doubled."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def markdown_cell(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def html_text(text: Column) -> Column:
    """Text with the five characters of markup as references."""
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def json_first(document: Column, *paths: str) -> Column:
    """The first path of a JSON text that has a value."""
    return F.coalesce(*[F.get_json_object(document, p) for p in paths])


def _units(value: Column, digits: int) -> Column:
    """value * 10**digits to the nearest whole number, ties to even, from 73 bits after the point; in whole numbers of 64
    bits, for up to six digits."""
    own = F.floor(value)
    scaled = (value - own) * float(1 << 36)  # scaling by powers of two and splitting off whole parts is exact
    top = F.floor(scaled)
    low = F.floor((scaled - top) * float(1 << 37)) * F.lit(10**digits).cast("long")
    high = top * F.lit(10**digits).cast("long") + F.shiftright(low, 37)
    q = own * F.lit(10**digits).cast("long") + F.shiftright(high, 36)
    r = high.bitwiseAND(F.lit((1 << 36) - 1))
    more = low.bitwiseAND(F.lit((1 << 37) - 1)) > 0
    return q + ((r > 1 << 35) | ((r == 1 << 35) & (more | (q % 2 == 1)))).cast("long")


def _units_wide(value: Column, digits: int) -> Column:
    """The same for more digits, in decimals."""
    whole, rest = F.lit(0).cast("decimal(38,0)"), value
    for bits in (26, 27, 20):  # scaling by powers of two and splitting off whole parts is exact
        scaled = rest * float(1 << bits)
        part = F.floor(scaled)
        whole = (whole * F.lit(1 << bits).cast("decimal(10,0)") + part.cast("decimal(19,0)")).cast("decimal(38,0)")
        rest = scaled - part
    units = (whole * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)")
    one, half = (F.lit(str(1 << k)).cast("decimal(23,0)") for k in (73, 72))
    q, r = F.call_function("div", units, one), units % one
    return q + ((r > half) | ((r == half) & (q % 2 == 1))).cast("long")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text of a double, rounded from its exact binary value, ties to even: 0.03125 gives 0.0312 at four
    digits, and 0.26875, which lies below that decimal, 0.2687. Numbers of more than 15 digits, those after the
    point that are kept counted, are rounded from their shortest decimal; below 1e-6, bits beyond the 73rd are cut."""
    v = value.cast("double")
    few = F.abs(v) < 1e15 / 10**digits
    near = F.when(few, F.abs(v)).otherwise(0.0)
    if digits <= 6:  # the number appears once, so that the compiled row function stays small
        signed = (_units(near, digits) * F.when(v < 0, -1).otherwise(1)).cast("decimal(18,0)")
        exact = (signed * F.lit(f"1E-{digits}").cast(f"decimal({digits + 1},{digits})")).cast(f"decimal(38,{digits})").cast("string")
    else:
        q = _units_wide(near, digits)
        text = F.concat(F.call_function("div", q, F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((q % 10**digits).cast("string"), digits, "0"))
        exact = F.concat(F.when((v < 0) & (q > 0), "-").otherwise(""), text)
    shortest = F.bround(v.cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.when(few, exact).when(F.abs(v) < 1e18, shortest)


def edited_name(name: Column) -> Column:
    """Default name of an edited copy."""
    return F.concat(F.regexp_replace(name, r"(?i)\.csv$", ""), F.lit("_edited"))


def flatten_comments(document: Column) -> Column:
    """Texts of all FUNCTION comments of an annotation record, trimmed and joined by a space."""
    kind = "struct<comments:array<struct<commentType:string,texts:array<struct<value:string>>>>>"
    own = F.filter(F.from_json(document, kind)["comments"], lambda c: c["commentType"] == "FUNCTION")
    texts = F.flatten(F.transform(own, lambda c: F.coalesce(c["texts"], F.array().cast("array<struct<value:string>>"))))
    return F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t["value"])), lambda t: t != ""), " ")
