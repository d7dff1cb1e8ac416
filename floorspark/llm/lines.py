"""Repeated passages by windows of three lines.

Three consecutive lines that are not blank make a window, at any length. Because many
texts put a whole paragraph on one line, sentences are windows besides: three
consecutive ones, of SENTENCE_CHARS together, that are not whole lines already. Of all
windows with the same three lines or sentences the first stays, by doc_id and then
place; what later ones cover is removed, blank lines between them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join
from floorspark.session import stored

#: Lines of a window.
WINDOW = 3
#: Characters that the sentences of a window must have together where they are not
#: lines of their own: shorter ones ("Yes. No. Yes.") repeat by chance. Windows of
#: whole lines have no such minimum.
SENTENCE_CHARS = 40

_LINE_ENDS = r"(?<=\n)|(?<=[.!?] )"
_BLANK = " \t\r\n"


def _pieces(text: Column) -> Column:
    """The text cut after each line's end; joined, the pieces give the text."""
    return F.split(text, _LINE_ENDS)


def _cut(text: Column) -> Column:
    """The text with a line's end for the blank after a sentence: the same cuts as in
    _pieces, at a third of the time of an expression that looks behind."""
    for mark in ".!?":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    return text


def _lines(docs: DataFrame) -> DataFrame:
    """Adds ``heads``, for each real line, two hashes of it, and ``lines``, the pieces
    that are not blank: text, place, number of the real line, and whether no other such
    piece comes before (first) or after it (last) in that line."""
    real = docs.withColumn("real", F.split("text", "\n"))
    trimmed = F.transform("real", lambda x: F.trim(x, F.lit(_BLANK)))
    hashed = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.hash(x).alias("check")))

    def pieces(line: Column, number: Column) -> Column:
        return F.transform(F.split(_cut(line), "\n"), lambda p: F.struct(F.trim(p, F.lit(_BLANK)).alias("said"), number.alias("row")))

    every = F.flatten(F.transform("real", pieces))
    docs = real.withColumns({"heads": hashed, "every": every}).drop("real")
    placed = F.transform("every", lambda x, i: F.struct(x["said"], i.alias("place"), x["row"]))
    docs = docs.withColumn("filled", F.filter(placed, lambda x: x["said"] != "")).drop("every")

    def marked(x: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get("filled", i - 1)["row"]), F.get("filled", i + 1)["row"]
        edge = lambda other: ~x["row"].eqNullSafe(other)
        return F.struct(x["said"].alias("line"), x["place"], x["row"], edge(before).alias("first"), edge(after).alias("last"))

    return docs.withColumn("lines", F.transform("filled", marked)).drop("filled")


def _windows(docs: DataFrame) -> DataFrame:
    """One row per window: two hashes of its lines and the pieces it covers.

    A line is hashed once; a window's hashes are made of those of its lines."""
    lines = _lines(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text")).drop("text")
    ends = F.filter("lines", lambda x: x["last"])
    lines = lines.withColumns({"starts": F.filter("lines", lambda x: x["first"]), "ends": ends})
    whole = lambda x: x["first"] & x["last"]
    head = lambda row: F.get("heads", row)
    own = lambda x: F.struct(F.xxhash64(x["line"]).alias("hash"), F.hash(x["line"]).alias("check"))
    # A sentence that is a whole line has the line's hashes already.
    said = F.transform("lines", lambda x: F.struct(F.when(whole(x), head(x["row"])).otherwise(own(x)).alias("head"), F.length(x["line"]).alias("chars"), x["place"].alias("place"), whole(x).alias("whole")))
    lines = lines.withColumn("sentences", F.when(F.exists("lines", lambda x: ~whole(x)), said))

    def hashes(heads: list[Column], lo: Column, hi: Column) -> Column:
        return F.struct(
            F.xxhash64(*[h["hash"] for h in heads]).alias("hash"),
            F.hash(*[h["check"] for h in heads]).alias("check"),
            lo.alias("lo"),
            hi.alias("hi"),
        )

    def of_lines(i: Column) -> Column:
        heads = [head(F.get("starts", i + j)["row"]) for j in range(WINDOW)]
        return hashes(heads, F.get("starts", i)["place"], F.get("ends", i + WINDOW - 1)["place"])

    def of_sentences(i: Column) -> Column:
        run = [F.get("sentences", i + j) for j in range(WINDOW)]
        chars = sum((x["chars"] for x in run[1:]), run[0]["chars"])
        counts = (chars >= SENTENCE_CHARS) & ~(run[0]["whole"] & run[1]["whole"] & run[2]["whole"])
        return F.when(counts, hashes([x["head"] for x in run], run[0]["place"], run[-1]["place"]))

    def each(name: str, window) -> Column:
        last = F.size(name) - WINDOW
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, window)

    both = F.concat(each("starts", of_lines), F.filter(each("sentences", of_sentences), lambda x: x.isNotNull()))
    # The outer form: the other one lets Spark move a filter down to the text
    # and cut it anew for every window.
    found = lines.select("id", "version", both.alias("windows"))
    return found.select("id", "version", F.inline_outer("windows")).where("hash is not null and id is not null")


def _covered(docs: DataFrame) -> DataFrame:
    """For each document with later occurrences, the places they cover."""
    # Stored, because texts would be cut and hashed once for each of the two uses.
    windows = stored(_windows(docs), "windows")
    # One number orders occurrences by doc_id, then place.
    order = F.col("id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("lo")
    seen = windows.groupBy("hash", "check").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    repeated = seen.where("n > 1").select("hash", "check", "first")
    later = lookup_join(windows, repeated, ["hash", "check"], "inner").where(order > F.col("first"))
    ranges = later.select("id", "version", F.struct("lo", "hi").alias("range"))
    return ranges.groupBy("id", "version").agg(F.collect_list("range").alias("ranges"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents without the passages that an earlier one, or they themselves,
    have already.

    ``docs`` has doc_id, text and any other columns, which stay as they are; new
    are n_lines (lines that are not blank) and n_removed (of those, removed),
    in place of columns of these names.
    ``text`` is what is left, cut out in whole lines; a text that repeats wholly
    becomes empty.

    Lines are counted as sentences where a line holds several. A null text stays null,
    with no lines. Texts of fewer than three lines or sentences stay. Repeated rows are
    the same document: what stays in one stays in all. Rows without doc_id stay and do
    not count as occurrences.
    """
    covered = _covered(docs.select("doc_id", "text"))
    covered = covered.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "ranges")
    # Other columns travel in one, where their names cannot clash.
    others = [c for c in docs.columns if c != "text"]
    out = docs.select("doc_id", "text", F.xxhash64("text").alias("_version"), F.struct(*others).alias("row"))
    out = out.join(covered.withColumnRenamed("_version", "_own"), (F.col("doc_id") == F.col("_id")) & (F.col("_version") == F.col("_own")), "left")
    gone = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"]))))
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    out = out.withColumn("pieces", F.when(F.size("gone") > 0, _pieces(F.col("text"))))
    places = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone"))
    left = F.array_join(F.transform(places, lambda i: F.get("pieces", i)), "")
    removed = F.size(F.filter("gone", lambda i: F.trim(F.get("pieces", i), F.lit(_BLANK)) != ""))
    text = F.when(F.size("gone") > 0, left).otherwise(F.col("text"))
    # Every piece that is not blank has one first character that is not.
    counted = F.regexp_count(_cut(F.col("text")), F.lit(rf"[^{_BLANK}][^\n]*+"))
    new = {
        "n_lines": F.coalesce(counted, F.lit(0)).cast("long"),
        "n_removed": F.when(F.size("gone") > 0, removed).otherwise(0).cast("long"),
    }
    own = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return out.select(*own, *[value.alias(c) for c, value in new.items()])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents as :func:`remove_repeats` leaves them, with n_chars brought
    up to date. Documents of which nothing is left go."""
    others = [c for c in docs.columns if c != "text"]
    done = remove_repeats(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    # Unpacked from a list, so that Spark does not move the filter on the new text
    # down to where the text would be put together anew for each of its pieces.
    done = done.select("row", F.inline_outer(F.array(F.struct("text", "n_lines", "n_removed"))))
    changed = F.col("n_removed") > 0
    left = done.where(~changed | (F.trim("text", F.lit(_BLANK)) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return left.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
