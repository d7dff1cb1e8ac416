"""Personal data by patterns of characters and, from those, of context.

Four kinds are found by their form. They are the seeds of a bootstrap: the words
around known instances are lexical patterns, and a pattern is as sure of a kind
as its distinct instances are known to be of it; an identifier of no known form
is as sure as the sure patterns it stands in make it together. Rounds go on until one
adds neither a pattern nor an identifier; sureness never falls from round to round.
Identifiers that are sure enough count as found wherever they stand.

Only Spark expressions are used. Positions come from the lengths of what lies
between matches, summed along each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join
from floorspark.session import stored

KINDS = ("email", "ip", "card", "phone")

#: The forms. Possessive repetitions change no match, as what follows them, if
#: anything, cannot begin with their characters; they need no stack for long ones.
_PARTS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"[0-9]++(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A match of these can only begin where a run of its first class does, or where
#: the last match ended; saying so keeps long runs from being tried throughout.
_STARTS = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)", "ip": r"(?:(?<![0-9])|\G)"}
#: Other identifiers: runs with four digits or an at sign, or groups of digits with
#: blanks or brackets between them that have four digits together. Neither ends in a
#: mark, so that one at the end of a sentence counts as well.
_RUN = r"A-Za-z0-9._%+@/-"
_GROUP = r"[0-9]++(?:[./-]++[0-9]++)*+(?![A-Za-z_%+@])"
_SPACED = rf"(?=(?:[\x20()./-]*+[0-9]){{4}})\(?+{_GROUP}(?:[\x20()]{{1,2}}+{_GROUP})++"
_SOLID = rf"(?=(?:[A-Za-z._%+@/-]*+[0-9]){{4}}|[A-Za-z0-9._%+/-]*+@[._%+@/-]*+[A-Za-z0-9])[{_RUN}]*(?<=[A-Za-z0-9])"
_OTHER = rf"(?<![{_RUN}])(?:{_SPACED}|{_SOLID})"

#: Words on each side that make a pattern, and the characters they are cut from.
CONTEXT_CHARS = 60
#: Distinct known instances a pattern needs; sureness from which a pattern speaks,
#: and from which an identifier counts as found.
LEAST_KNOWN, SURE_PATTERN, SURE = 3, 0.6, 0.9


def _may_hold(text: Column, kind: str) -> Column:
    """A quick test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.rlike(text, F.lit({"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "other": r"[0-9@]"}[kind]))


def _words(text: Column, count: int, last: bool) -> Column:
    """The outermost words of a stretch of text, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}:=#]+"), lambda w: w != "")
    n = F.size(words)
    return F.array_join(F.slice(words, F.greatest(n - count + 1, F.lit(1)), F.lit(count)) if last else F.slice(words, 1, count), " ")


def _matches(named: DataFrame, kind: str) -> DataFrame:
    """Every match of a form: its order, the characters before it since the last
    one, its text, and the text on both sides."""
    form = _STARTS.get(kind, "") + _PARTS[kind] if kind in _PARTS else _OTHER
    some = named.where(_may_hold(F.col("text"), kind))
    some = some.withColumn("gaps", F.split("text", form)).withColumn("hits", F.regexp_extract_all("text", F.lit(form), F.lit(0)))

    def hit(value: Column, i: Column) -> Column:
        before, after = F.get("gaps", i), F.get("gaps", i + 1)
        return F.struct(
            i.alias("turn"),
            F.length(before).alias("gap"),
            value.alias("value"),
            F.right(before, F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(after, F.lit(CONTEXT_CHARS)).alias("after"),
        )

    found = some.select("id", "version", F.transform("hits", hit).alias("found"))
    found = found.select("id", "version", F.inline_outer("found")).where("turn is not null")
    return found.withColumn("kind", F.lit(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    size = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))
        .when(kind == "card", F.when(size.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(10, 15))
        .otherwise(True)
    )


def find_spans(named: DataFrame) -> DataFrame:
    """All matches of (id, version, text) with start and end in code points,
    ``valid`` ones only; ``kind`` is one of KINDS or other."""
    every = None
    for kind in (*KINDS, "other"):
        found = _matches(named, kind)
        every = found if every is None else every.unionByName(found)
    every = every.dropDuplicates(["id", "version", "kind", "turn"])
    along = Window.partitionBy("id", "version", "kind").orderBy("turn")
    every = every.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(along))
    every = every.withColumn("start", F.col("end") - F.length("value"))
    return every.where(_valid(F.col("kind"), F.col("value"))).drop("gap", "turn")


def _edges(spans: DataFrame) -> DataFrame:
    """(pattern, value, known): which instance stands in which pattern; known is
    its kind by form, or null."""
    left, right = (lambda n: _words(F.col("before"), n, True)), (lambda n: _words(F.col("after"), n, False))
    patterns = F.array(
        F.concat(F.lit("2- "), left(2)),
        F.concat(F.lit("-2 "), right(2)),
        F.concat(F.lit("1-1 "), left(1), F.lit(" _ "), right(1)),
    )
    known = F.when(F.col("kind") != "other", F.col("kind"))
    edges = spans.select(F.explode(patterns).alias("pattern"), F.lower("value").alias("value"), known.alias("known"))
    return edges.distinct()


def _learned(spans: DataFrame) -> DataFrame:
    """(value, kind): identifiers of no known form that patterns are sure of."""
    edges = stored(_edges(spans), "edges")
    seeds = edges.where("known is not null").select("value", F.col("known").alias("kind"), F.lit(1.0).alias("sure")).distinct()
    sure = seeds
    sizes = edges.groupBy("pattern").agg(F.countDistinct("value").alias("size"))
    links = stored(edges.select("pattern", "value").distinct(), "pattern-links")
    reached = None
    while True:
        told = lookup_join(links, sure, ["value"], "inner")
        patterns = told.groupBy("pattern", "kind").agg(F.sum("sure").alias("known"), F.sum((F.col("sure") >= SURE).cast("int")).alias("firm"))
        patterns = patterns.where(F.col("firm") >= LEAST_KNOWN)
        # One more unknown instance than seen keeps small patterns modest.
        patterns = lookup_join(patterns, sizes, ["pattern"], "inner").withColumn("trust", F.col("known") / (F.col("size") + 0.5))
        patterns = patterns.where(F.col("trust") >= SURE_PATTERN).select("pattern", "kind", "trust")
        open_links = edges.where("known is null").select("pattern", "value")
        patterns = stored(patterns, "patterns")
        votes = lookup_join(open_links, patterns, ["pattern"], "inner")
        scored = votes.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("trust"))))).alias("sure"))
        sure = stored(seeds.unionByName(scored), "sure")
        now = patterns.count(), sure.where(F.col("sure") >= SURE).count()
        if now == reached or not now[0]:
            break
        reached = now
    found = sure.where(F.col("sure") >= SURE).join(seeds.select("value").distinct(), "value", "left_anti")
    return found.groupBy("value").agg(F.max_by("kind", F.struct("sure", "kind")).alias("learned"))


def _free(spans: DataFrame) -> DataFrame:
    """Other identifiers that overlap no span of a known form."""
    own = Window.partitionBy("id", "version").orderBy("start", "end")
    base = F.col("kind") != "other"
    ahead = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("id", "version").orderBy(F.desc("start"), F.desc("end")))
    behind = F.max(F.when(base, F.col("end"))).over(own)
    marked = spans.withColumn("behind", behind).withColumn("ahead", ahead)
    clear = (F.coalesce("behind", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True)))
    return marked.where(base | clear).drop("behind", "ahead")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per
    row: doc_id, n_email, n_ip, n_card, n_phone (by form), base_sha256 (of the
    spans by form), spans (all, as kind:start:end by start, then kind, joined by
    commas; code points, end exclusive), n_learned (spans that the patterns add).

    Null and empty texts have no spans. Repeated rows have the same result, rows
    that share a doc_id each that of its own text; rows without doc_id are
    searched too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    spans = stored(_free(find_spans(named.select("id", "version", "text"))), "spans")
    learned = _learned(spans)
    spans = spans.withColumn("value", F.lower("value"))
    more = lookup_join(spans.where("kind = 'other'"), learned, ["value"], "inner").withColumn("kind", F.col("learned")).withColumn("base", F.lit(False))
    every = spans.where("kind <> 'other'").withColumn("base", F.lit(True)).unionByName(more.drop("learned"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), "end", "kind", "base")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    counts.append(F.count(F.when(~F.col("base"), 1)).alias("n_learned"))
    grouped = every.groupBy("id", "version").agg(*counts, F.array_sort(F.collect_list(entry)).alias("found"))

    def written(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")

    grouped = grouped.withColumn("base_spans", written(F.filter("found", lambda e: e["base"]))).withColumn("spans", written(F.col("found")))
    out = named.select("doc_id", "id", "version").join(grouped, ["id", "version"], "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_learned", F.lit(0)).cast("long").alias("n_learned"),
    )
