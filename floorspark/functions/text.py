"""Text, time and claim helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorspark.functions.formulas import col

# The characters a browser trims.
WHITESPACE = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Characters escaped for display, the ampersand first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def leading_int(value: Column | str) -> Column:
    """The integer a text starts with, else null."""
    digits = F.regexp_extract(col(value), r"^\s*([+-]?\d+)", 1)
    return digits.try_cast("int")


def trimmed_or(value: Column | str, default: str | None = None) -> Column:
    """Trimmed text; blank text becomes the default."""
    kept = F.nullif(F.btrim(col(value), F.lit(WHITESPACE)), F.lit(""))
    return kept if default is None else F.coalesce(kept, F.lit(default))


def escape_markup(value: Column | str) -> Column:
    escaped = F.coalesce(col(value).cast("string"), F.lit(""))
    for plain, entity in ESCAPES:
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    return escaped


def iso_day(value: Column | str) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd")


def clock_time(value: Column | str) -> Column:
    """Hours and minutes; a missing time, or the zero of an unset one, shows as empty."""
    unset = F.unix_millis(col(value).cast("timestamp")) == 0
    return F.when(col(value).isNull() | unset, "").otherwise(F.date_format(col(value), "HH:mm"))


def fixed(value: Column | str, places: int) -> Column:
    return F.format_string(f"%.{places}f", col(value))


def grouped_thousands(value: Column | str) -> Column:
    return F.format_number(col(value), 0)


def role_claim(header: Column | str) -> Column:
    """The role a bearer token claims; null for anything malformed.

    The claims stand between the first two dots. The scheme in front of the
    token has no dot, so it needs no removing.
    """
    payload = F.split_part(F.coalesce(col(header), F.lit("")), F.lit("."), F.lit(2))
    decoded = F.try_to_binary(F.translate(payload, "-_", "+/"), F.lit("base64"))
    claims = decoded.cast("string")
    read = F.from_json(F.when(is_one_value(claims), claims), "struct<role:string>", STRICT_JSON)
    return read["role"]


# Plain JSON only, as a browser parses it.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def elements(text: Column) -> Column:
    """The texts of a JSON list's elements, given without its brackets."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT_JSON)


def is_one_value(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    Spark's parser stops after the first value. The text is therefore read once
    inside a list and once inside an object: what would end the list early is
    not allowed in the object, and what would go on in one not in the other.
    """
    inside = F.from_json(F.concat(F.lit('{"a":'), text, F.lit("}")), "map<string,string>", STRICT_JSON)
    return F.coalesce((F.size(elements(text)) == 1) & (F.size(inside) == 1), F.lit(False))


def display_author(own_role: str = "trolley") -> Column:
    """Who a chat line is shown as."""
    name = F.nullif(F.col("sender_name"), F.lit(""))
    return F.when(F.col("sender_role") == own_role, F.coalesce(name, F.lit("You"))).otherwise("Office")
