"""Plan-photo extraction results: admission, parsing, normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.functions.text import STRICT_JSON, elements, is_one_value, role_claim
from floorspark.sources.schemas import EXTRACTION

# Fixed values.
MAX_IMAGE_LENGTH = 8 * 1024 * 1024 * 4 / 3
NO_ROWS = "[]"
RESPONSE_TEXT = "$.candidates[0].content.parts[0].text"
JSON_BLANKS = " \t\n\r"


def admission(role: Column | None = None) -> Column:
    """Status of a request, by the first check it fails."""
    role = role_claim("authorization") if role is None else role
    return (
        F.when(~role.eqNullSafe(F.lit("authenticated")), "authenticated caller required")
        .when(F.coalesce("image_len", F.lit(0)) == 0, "missing imageBase64")
        .when(F.col("image_len") > MAX_IMAGE_LENGTH, "image too large")
        .when(~F.coalesce(F.col("upstream_status").between(200, 299), F.lit(False)), "upstream error")
        .otherwise("ok")
    )


def admitted(requests: DataFrame) -> DataFrame:
    return requests.where(admission() == "ok")


def response_text(response: Column | str) -> Column:
    """The text inside an extraction response; a missing one stands for no rows."""
    return F.coalesce(F.get_json_object(response, RESPONSE_TEXT), F.lit(NO_ROWS))


def _text(requests: DataFrame) -> Column:
    """The text of a request: out of its raw ``response`` where there is one,
    else its ``body``. A missing text stands for no rows."""
    if "response" in requests.columns:
        return response_text("response")
    return F.coalesce("body", F.lit(NO_ROWS))


def _unreadable(given: Column, read: Column, name: str) -> Column:
    return F.when(given.isNotNull() & read.isNull(), f"unreadable {name}")


def _given(raw: Column) -> Column:
    """One element of a list, its cells as they stand there."""
    return F.struct(raw.alias("raw"), F.from_json(raw, EXTRACTION, STRICT_JSON).alias("cells"))


def _read(raw: Column, given: Column) -> Column:
    """One element of a list as a row, or the reason why it is none."""
    kinds = {"weight_kg": "decimal(18,3)", "planned_qty": "decimal(18,3)", "is_trial": "boolean", "is_doubles": "boolean"}
    names = [part.split(":")[0].strip() for part in EXTRACTION[len("struct<") : -1].split(",")]
    cells = {name: given[name].try_cast(kinds[name]) if name in kinds else given[name] for name in names}
    reasons = [_unreadable(given[name], cells[name], name) for name in kinds]
    reasons.append(_unreadable(given["planned_qty"], cells["planned_qty"].try_cast("int"), "planned_qty"))
    is_object = F.coalesce(F.startswith(F.btrim(raw, F.lit(JSON_BLANKS)), F.lit("{")), F.lit(False))
    reason = F.when(~is_object, "not an object").otherwise(F.coalesce(*reasons))
    return F.struct(raw.alias("raw"), reason.alias("reason"), F.struct(*[c.alias(n) for n, c in cells.items()]).alias("row"))


def sorted_out(requests: DataFrame) -> DataFrame:
    """Every list element of every request, and every text that is no list.

    One row each: req_id, row_no (in the order of the text, null for a text that
    is no list), the columns of an extracted job, ``reason`` (null for a row that
    can be saved) and ``raw``, the text of the element or of the whole. Texts are
    read once; nothing is left out, and nothing that is unreadable ends the job.
    """
    text = F.btrim(_text(requests), F.lit(JSON_BLANKS))
    is_list = is_one_value(text) & F.startswith(text, F.lit("["))
    found = requests.select("req_id", text.alias("_text"), is_list.alias("_is_list"))
    inside = F.expr("substr(_text, 2, greatest(length(_text) - 2, 0))")
    found = found.withColumn("_raws", F.when(F.col("_is_list"), F.coalesce(elements(inside), F.array().cast("array<string>"))))
    # The outer form keeps Spark from reading each text again just to drop empty lists.
    # Elements are read before they become rows: written out behind that, the read
    # would be repeated for every cell that is asked for and every filter on them.
    given = F.posexplode_outer(F.transform("_raws", _given)).alias("row_no", "_given")
    each = found.select("req_id", "_text", "_is_list", given)
    each = each.where(~F.col("_is_list") | F.col("row_no").isNotNull()).withColumn("_raw", F.col("_given.raw"))
    each = each.withColumn("_entry", _read(F.col("_raw"), F.col("_given.cells")))
    whole = ~F.col("_is_list")
    return each.select(
        "req_id",
        "row_no",
        "_entry.row.*",
        F.when(whole, "not a list").otherwise(F.col("_entry.reason")).alias("reason"),
        F.when(whole, F.col("_text")).otherwise(F.col("_raw")).alias("raw"),
    )


def extracted_rows(requests: DataFrame) -> DataFrame:
    """One row per extracted job that can be saved, in the order of the text."""
    return sorted_out(requests).where(F.col("reason").isNull()).drop("reason", "raw")


def parse_failures(requests: DataFrame) -> DataFrame:
    """What could not be read, whole texts or single elements, and why."""
    return sorted_out(requests).where(F.col("reason").isNotNull()).select("req_id", "row_no", "raw", "reason")


def normalised(rows: DataFrame) -> DataFrame:
    """Extracted rows as job columns.

    Flags default to false. Doubles come from the flag, or from a ratio of two
    cores to one mould; any other or no ratio means single.
    """
    per_mould = F.regexp_extract("ratio", r"^\s*(\d+)\s*/\s*1\s*$", 1)
    doubles = F.coalesce("is_doubles", per_mould == "2", F.lit(False))
    return rows.withColumns(
        {
            "planned_qty": F.col("planned_qty").try_cast("int"),
            "is_trial": F.coalesce("is_trial", F.lit(False)),
            "is_doubles": doubles,
        }
    ).drop("ratio")
