"""Benchmark passages in documents, by SimHash windows of the size of an item.

Only Spark expressions are used. A window has as many words as an item and holds
a shingle of an item of that size; any other window has similarity 0. Windows are
tried at every start, unless shingles of no such item weigh so much in them that
they cannot reach the similarity. Each window's fingerprint is looked up among all
items of that size by blocks: two fingerprints within RADIUS bits differ in some block
by at most BLOCK_RADIUS, and every item is stored under all values that close.
Candidates are confirmed by the exact weighted Jaccard of their shingles.

A shingle is a 64-bit number: a hash above its weight in the six lowest bits. The
weight is the number of its letters and digits, 63 at most, so that runs of
short common words count for less.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.session import stored

#: Words of a shingle, bits of a block, and the distance searched in a block.
SHINGLE, BLOCK_BITS, BLOCK_RADIUS = 5, 8, 2
#: Fingerprints as close as this share a close block, by counting.
RADIUS = 64 // BLOCK_BITS * (BLOCK_RADIUS + 1) - 1
#: Bits of a hash that name a text's place on the bitmap of texts with hits, which is
#: sent to every task: 4 MB at any size of the data. When it fills up, more texts are
#: shuffled, none is missed.
ROUTE_BITS = 25
#: Starts of a stretch whose windows are cut out together.
STRETCH = 64

_WEIGHT = 63
_NEAR_MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    run = [F.get(words, at + i) for i in range(k)]
    letters = sum((F.length(w) for w in run[1:]), F.length(run[0]))
    return F.xxhash64(*run).bitwiseAND(F.lit(~_WEIGHT)).bitwiseOR(F.least(letters, F.lit(_WEIGHT)).cast("long"))


def shingles_of(words: Column, k: int) -> Column:
    """The shingle at each word with k - 1 words after it; empty for fewer."""
    n = F.size(words)
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _shingle(words, i, k))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(_WEIGHT)))


def _lanes(hashes: Column, wide: int) -> Column:
    """SimHash with the votes of 64 / ``wide`` bits counted in one number each."""
    mask = sum(1 << at for at in range(0, 64, wide))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    total = F.aggregate(hashes, F.lit(0).cast("long"), lambda t, x: t + x["weight"])

    def lane(b: Column) -> Column:
        step = lambda t, x: t + F.call_function("shiftright", x["hash"], b).bitwiseAND(F.lit(signed(mask))) * x["weight"]
        return F.aggregate(hashes, F.lit(0).cast("long"), step)

    def bits(whole: Column, b: Column, votes: Column) -> Column:
        for at in range(0, 64, wide):
            share = F.shiftrightunsigned(votes, at).bitwiseAND(F.lit((1 << wide) - 1))
            one = F.call_function("shiftleft", F.lit(1).cast("long"), b + at)
            whole = whole.bitwiseOR(F.when(share * 2 > total, one).otherwise(F.lit(0).cast("long")))
        return whole

    lanes = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda b: F.struct(b.alias("b"), lane(b).alias("votes")))
    return F.aggregate(lanes, F.lit(0).cast("long"), lambda whole, x: bits(whole, x["b"], x["votes"]))


def fingerprint(shingles: Column) -> Column:
    """64-bit SimHash of weighted shingles: a bit is set where more than half of the
    weight is for it.

    Four votes of 16 bits share a number, as long as the weights fit.
    """
    # Any bit of the hash: the shingle's own upper bits, mixed once more.
    hashes = F.transform(shingles, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.bitwiseAND(F.lit(_WEIGHT)).alias("weight")))
    return F.when(F.size(shingles) * _WEIGHT < 1 << 16, _lanes(hashes, 16)).otherwise(_lanes(hashes, 32))


def _block(value: Column, b: Column) -> Column:
    return F.call_function("shiftright", value, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _items(benchmark: DataFrame) -> DataFrame:
    """Items that have words: id, size, shingle length, shingles in order."""
    words = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    words = words.withColumn("size", F.size("words")).withColumn("k", F.least("size", F.lit(SHINGLE)))
    shingles = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        shingles = F.when(F.col("k") == k, shingles_of(F.col("words"), k)).otherwise(shingles)
    # item_id may be null or repeat, so items get a number once they are stored.
    items = words.select(F.monotonically_increasing_id().alias("number"), "item", "size", "k", shingles.alias("shingles"))
    items = items.withColumn("shape", F.array_distinct("shingles"))
    return items.withColumn("print", fingerprint(F.col("shape")))


def _hits(named: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """For each text and size, the places of shingles that an item of the size has."""
    own = items.where(F.col("k") == k)
    shingles = own.select("size", F.explode("shape").alias("shingle")).distinct()
    docs = named.select("doc_id", "version", words_of(F.col("text")).alias("words"))
    # The outer form: Spark adds a size filter to the other one and, moving it
    # down, would split the text anew for every shingle.
    found = docs.select("doc_id", "version", F.posexplode_outer(shingles_of(F.col("words"), k)).alias("at", "shingle"))
    places = found.join(shingles, "shingle").groupBy("doc_id", "version", "size").agg(F.collect_set("at").alias("places"))
    sizes = places.groupBy("doc_id", "version").agg(F.collect_list(F.struct("size", "places")).alias("sizes"))
    return sizes.select("doc_id", "version", F.lit(k).alias("k"), "sizes")


def _place() -> Column:
    """A text's place on the bitmap, from 1."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "version"), 64 - ROUTE_BITS) + 1


def _with_hits(named: DataFrame, hits: DataFrame) -> DataFrame:
    """The texts that have hits, and by chance a few more, before any text moves."""
    pages = hits.groupBy(F.bitmap_bucket_number(_place()).alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place())).alias("_bits"))
    at = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    routed = named.withColumn("_page", F.bitmap_bucket_number(_place())).join(F.broadcast(pages), "_page")
    return routed.where(set_).drop("_page", "_bits")


def _windows(named: DataFrame, hits: DataFrame, k: int, percent: int) -> DataFrame:
    """All windows that may reach the similarity with an item of k-word shingles.

    Those hold a shingle of an item of their size, so each begins at most its own
    length before one. Shingles that no such item has cannot be shared: a window
    where they weigh too much is left out. Windows are cut out of stretches of the
    text, so that no window carries the whole text along."""
    own = hits.where(F.col("k") == k).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "sizes")
    same = named["doc_id"].eqNullSafe(own["_id"]) & (named["version"] == own["_version"])
    # Both sides are shuffled at every size: few texts are left here.
    docs = named.join(own.hint("merge"), same)
    # Words in a step of their own, so that a text is not split for every shingle.
    docs = docs.select("doc_id", "version", words_of(F.col("text")).alias("words"), "sizes")
    docs = docs.select("doc_id", "version", shingles_of(F.col("words"), k).alias("found"), "sizes")
    docs = docs.select("doc_id", "version", "found", F.inline_outer("sizes"))
    docs = docs.withColumn("places", F.array_sort("places"))
    width = F.col("size") - k + 1
    last = F.greatest(F.size("found") - width, F.lit(0))

    # Each window once: under the first of the places in it.
    def starts(at: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("places", i - 1)).otherwise(F.lit(-1))
        lo, hi = F.greatest(before + 1, at - width + 1, F.lit(0)), F.least(at, last)
        cuts = F.sequence(lo, hi, F.lit(STRETCH))
        stretch = lambda s: F.struct(
            s.alias("lo"),
            F.least(s + STRETCH - 1, hi).alias("hi"),
            F.slice("found", s + 1, F.least(F.lit(STRETCH), hi - s + 1) + width - 1).alias("part"),
        )
        return F.when(lo <= hi, F.transform(cuts, stretch)).otherwise(F.array().cast("array<struct<lo:int,hi:int,part:array<bigint>>>"))

    known = F.array_distinct(F.transform("places", lambda at: F.get("found", at)))
    docs = docs.select("doc_id", "version", "size", known.alias("known"), F.flatten(F.transform("places", starts)).alias("stretches"))
    parts = docs.select("doc_id", "version", "size", "known", F.inline_outer("stretches"))
    parts = parts.select("doc_id", "version", "size", "lo", "hi", "part", F.array_intersect("known", "part").alias("known"))
    windows = parts.select("doc_id", "version", "size", "lo", "part", "known", F.explode_outer(F.sequence("lo", "hi")).alias("start"))
    seen = F.array_distinct(F.slice("part", F.col("start") - F.col("lo") + 1, F.col("size") - k + 1))
    windows = windows.select("doc_id", "version", "start", "size", seen.alias("seen"), "known")
    windows = windows.where(_weight(F.array_intersect("seen", "known")) * 100 >= _weight(F.col("seen")) * percent)
    return windows.drop("known")


def _found(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """(doc_id, version, item_id, start, n_words, similarity); version is a hash
    of the text."""
    named = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    items = stored(_items(benchmark), "items")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect()) or [SHINGLE]
    hits = stored(reduce(DataFrame.unionByName, [_hits(named, items, k) for k in lengths]), "hits")
    routed = _with_hits(named, hits)
    windows = reduce(DataFrame.unionByName, [_windows(routed, hits, k, percent) for k in lengths])
    windows = stored(windows, "windows").withColumn("print", fingerprint(F.col("seen")))

    blocks = F.sequence(F.lit(0), F.lit(64 // BLOCK_BITS - 1))
    near = F.explode(F.array(*[F.lit(m) for m in _NEAR_MASKS]))
    index = items.select("number", "size", "print", F.explode(blocks).alias("block"))
    index = index.select("number", "size", F.col("print").alias("item_print"), "block", near.alias("mask"))
    index = index.withColumn("value", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("mask"))).drop("mask")
    probes = windows.select("*", F.explode(blocks).alias("block"))
    probes = probes.withColumn("value", _block(F.col("print"), F.col("block")))
    pairs = probes.join(index, ["size", "block", "value"])
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    pairs = pairs.where(F.bit_count(apart) <= RADIUS)
    # Of the blocks that bring a pair together, only the first counts.
    first = F.lit(None).cast("int")
    for b in reversed(range(64 // BLOCK_BITS)):
        first = F.when(F.bit_count(_block(apart, F.lit(b))) <= BLOCK_RADIUS, F.lit(b)).otherwise(first)
    pairs = pairs.where(F.col("block") == first).select("doc_id", "version", "start", "number", "seen")

    pairs = pairs.join(items.select("number", "item", "size", "shape"), "number")
    shared = _weight(F.array_intersect("seen", "shape"))
    pairs = pairs.withColumn("shared", shared).withColumn("both", _weight(F.col("seen")) + _weight(F.col("shape")) - F.col("shared"))
    sure = pairs.where(F.col("shared") * 100 >= F.col("both") * percent)
    sure = sure.withColumn("similarity", F.col("shared") / F.col("both"))
    return sure.groupBy("doc_id", "version", F.col("item").alias("item_id")).agg(
        F.max_by("start", F.struct("similarity", -F.col("start"))).cast("long").alias("start"),
        F.max_by("size", "similarity").cast("long").alias("n_words"),
        F.max("similarity").alias("similarity"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents that hold a benchmark item, nearly or exactly.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns
    are ignored. Returns one row per document and item found: doc_id, item_id,
    start (word from 0 of the best window, the first of equals), n_words (of the
    item), similarity (weighted Jaccard of the window's and the item's shingles,
    at least percent/100).

    Null texts and texts or items without words match nothing. An item of fewer
    than five words is one shingle, its whole sequence. Repeated rows count as one
    document, rows that share a doc_id each by their own text; rows without
    doc_id are searched too. Equal items are each reported; items that share an item_id
    count as one, with the best similarity of them.
    """
    return _found(docs, benchmark, percent).drop("version")


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    leaks = _found(docs, benchmark, percent).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    same = docs["doc_id"].eqNullSafe(leaks["_id"]) & (F.xxhash64(docs["text"]) == leaks["_version"])
    return docs.join(leaks, same, "left_anti")
