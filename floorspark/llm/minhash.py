"""Near-duplicate texts by circulant MinHash with exact confirmation.

Two permutations of the 32-bit universe make all coordinates of a signature: the
first places each shingle, the second is read circularly shifted by one more
place for each coordinate. Bands of coordinates give candidates; a link counts
only after the exact Jaccard of the full shingle sets.

Equal sets are one class from the start. Within a bucket of a band not all pairs
are tried: members are compared with a few hubs, found links merge classes, and
only members whose class still differs from another's go on to more hubs. In the
end every two members of a bucket are in one class or were compared, so classes
are what all pairs of the buckets would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.llm.links import components
from floorspark.llm.words import BLANK, Words, text_slices
from floorspark.plans.skew import lookup_join
from floorspark.session import stored

#: Coordinates of a band, and bands: a pair at 0.8 is missed once in 190,000.
ROWS, BANDS = 6, 40
#: Members up to which all pairs of a bucket are compared at once.
FEW = 4
#: Growth of the number of hubs from round to round: few new ones at a time, so that
#: most members are in one class before the many would meet them.
MORE_HUBS = 8
#: Coordinates of the longer signature that members of open buckets get, and
#: the standard deviations below the threshold from which it rules a pair out.
SKETCH, SURE = 1920, 6.0
#: Shingles up to which a member of an open bucket brings its set along, folded to 16
#: bits each, so that pairs are measured where they meet.
BROUGHT = 2048

_PACKED = SKETCH // 64  # numbers that hold one bit of each coordinate
_SKETCHED = "id long, bands array<long>, sketch array<long>, whole long, folded array<smallint>"
_SIGNATURE = "id long, version long, n_shingles long, set_a long, set_b long, bands array<long>"


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant(sets: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Signatures (size x texts) of shingle sets laid end to end; none is empty.

    The first permutation places the folded shingles; coordinate k is the least
    value of the second permutation shifted by k.
    """
    placed = _permuted((sets ^ (sets >> np.uint64(32))).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    out = np.empty((size, len(at) - 1), dtype=np.uint32)
    work = np.empty_like(placed)
    for k in range(size):
        np.add(placed, np.uint32(k), out=work)
        np.minimum.reduceat(_permuted(work), at[:-1], out=out[k])
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each text) of runs of texts."""
    for lo, hi, data, offsets in text_slices(texts):
        grams, at = Words(data, offsets, BLANK).shingles(k)
        yield lo, [np.unique(grams[at[i] : at[i + 1]]) for i in range(hi - lo)]


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = {name: [] for name in ("n", "a", "b", "bands")}
            for _, sets in shingle_sets(batch.column("text"), k):
                sizes = np.array([len(s) for s in sets])
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), BANDS), dtype=np.int64)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes[full])])
                    keys[full] = _band_keys(circulant(np.concatenate([sets[i] for i in full]), at, ROWS * BANDS))
                parts["n"].append(sizes)
                parts["a"].append(np.array([(d >> 64) - (1 << 63) for d in digests], dtype=np.int64))
                parts["b"].append(np.array([(d & ((1 << 64) - 1)) - (1 << 63) for d in digests], dtype=np.int64))
                parts["bands"].append(keys)
            n, a, b, bands = (np.concatenate(parts[x]) if parts[x] else np.zeros(0, np.int64) for x in parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("version"), *(pa.array(x.astype(np.int64)) for x in (n, a, b)), _lists(bands, BANDS)],
                ["id", "version", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts x BANDS): the bucket of each band."""
    keys = np.empty((signature.shape[1], BANDS), dtype=np.int64)
    for band in range(BANDS):
        rows = signature[band * ROWS : (band + 1) * ROWS].T.copy()
        keys[:, band] = [xxhash.xxh3_64_intdigest(r.tobytes(), seed=band) - (1 << 63) for r in rows]
    return keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets, the longer signature, the size and the folded set of stored sets."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in part.column("grams")]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            signature = circulant(np.concatenate(sets), at, SKETCH)
            bits = np.ascontiguousarray((signature & np.uint32(1)).T)
            packed = np.ascontiguousarray(np.packbits(bits.astype(bool), axis=1)).view(np.int64)
            lists = _lists(_band_keys(signature), BANDS), _lists(packed, _PACKED)
            folded = [_folded(s) if len(s) <= BROUGHT else None for s in sets]
            more = pa.array([len(s) for s in sets], pa.int64()), pa.array(folded, pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists, *more], ["id", "bands", "sketch", "whole", "folded"])


def _folded(grams: np.ndarray) -> np.ndarray:
    return np.unique(grams >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _set_bytes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, sets in shingle_sets(batch.column("text"), k) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "grams"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                place[place == len(y)] = 0
                shared = int(np.count_nonzero(y[place] == x))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _merged(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their class as found so far."""
    if labels is None:
        return members.withColumn("label", F.col("id"))
    now = lookup_join(members.drop("label"), labels, ["id"])
    return now.withColumn("label", F.coalesce("label", "id"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that have several classes."""
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    several = several.where("lo <> hi").select("bucket")
    return lookup_join(members, several, ["bucket"], "left_semi")


def _with_hubs(members: DataFrame, upto: float) -> DataFrame:
    """Marks the hubs of this round in open buckets.

    ``turn`` orders the members; hubs are those whose turn comes within ``upto`` of the
    bucket's size. Where few members are outside the bucket's largest class, those are
    hubs: two members of different classes cannot both be in the largest, so the bucket
    is done with this round.
    """
    classes = members.groupBy("bucket", "label").agg(F.count("*").alias("in_class"))
    largest = F.max(F.struct("in_class", "label"))
    held = classes.groupBy("bucket").agg(largest.alias("largest"), F.sum("in_class").alias("held"))
    held = held.select("bucket", F.col("largest.label").alias("main"), (F.col("held") - F.col("largest.in_class")).alias("others"))
    outside = (F.col("others") <= upto * MORE_HUBS) & (F.col("label") != F.col("main"))
    marked = lookup_join(members.drop("hub"), held, ["bucket"]).withColumn("hub", _first() | (F.col("turn") * F.col("size") < upto) | outside)
    return marked.drop("main", "others")


def _first() -> Column:
    """The members that all others of a bucket meet at first."""
    return (F.col("turn") == F.col("least")) | (F.col("size") <= FEW)


def _may_reach(percent: int) -> Column:
    """Whether the longer signatures of two members leave room for the threshold.

    One bit of each coordinate agrees as often as the sets, and by chance in half
    of the rest. Pairs at the threshold would differ in more bits than allowed here
    once in a thousand million, were the coordinates independent; the tests measure
    how far pairs at exactly 0.8 stray.
    """
    size, odds = SKETCH, (1 - percent / 100) / 2
    most = size * odds + SURE * (size * odds * (1 - odds)) ** 0.5
    # One expression for all numbers: written out, it would swell every plan.
    apart = F.zip_with("sketch", "sketch_a", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda total, n: total + n)
    return differ <= int(most)


def _folded_reach(percent: int) -> Column:
    """Whether the folded sets of two members leave room for the threshold.

    Folding makes sets share more, or fewer by as many shingles as fell together in
    the smaller loss of the two; with that added, no pair at the threshold is ruled
    out. Pairs of which one brings no set are left to the confirmation.
    """
    lost = F.least(F.col("whole") - F.size("folded"), F.col("whole_a") - F.size("folded_a"))
    shared = F.size(F.array_intersect("folded", "folded_a")) + lost
    reach = shared * (100 + percent) >= (F.col("whole") + F.col("whole_a")) * percent
    return F.col("folded").isNull() | F.col("folded_a").isNull() | reach


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared buckets): members of different classes with the hubs of
    this round."""
    sketched = "sketch" in members.columns
    extra = [F.col(c).alias(f"{c}_a") for c in ("sketch", "bands", "whole", "folded")] if sketched else []
    hubs = members.where("hub").select("bucket", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("turn").alias("turn_a"), *extra)
    near = (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent) & (F.col("label") != F.col("label_a"))
    if sketched:
        # A pair that shares several buckets meets in the first of them only; a
        # bucket that another text of the same doc_id brought counts by itself.
        first = F.array_min(F.array_intersect("bands", "bands_a")) == F.col("bucket")
        own = F.array_contains("bands", F.col("bucket")) & F.array_contains("bands_a", F.col("bucket"))
        near = near & _may_reach(percent) & (first | ~own) & _folded_reach(percent)
    once = ~F.col("hub") | (F.struct("turn", "id") > F.struct("turn_a", "a"))
    pairs = members.join(hubs, "bucket").where(once & (F.col("a") != F.col("id")) & near)
    return pairs.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    for side in ("a", "b"):
        own = sets.select(F.col("key").alias(side), F.col("grams").alias(f"grams_{side}"))
        pairs = pairs.join(own, side)
    return pairs.mapInArrow(_confirmed(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose word-shingle sets have a Jaccard of percent/100.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per
    row of ``docs``: doc_id, n_shingles (size of the set of k-word shingles),
    component_id (least doc_id reachable over links) and kept (doc_id equals
    component_id).

    A text of fewer than k words has its whole word sequence as its only
    shingle. A null or wordless text has none and is linked with nothing. Rows
    with one doc_id are one document: a candidate by each of its texts,
    confirmed by the one with the least hash; a repeated row repeats its result.
    A row without doc_id gets its n_shingles, no component_id, and is kept.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    sizes = stored(named.mapInArrow(_signatures(k), _SIGNATURE), "signatures")
    linked = sizes.where("n_shingles > 0 and id is not null")
    classes = linked.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "version")).alias("one"))
    classes = stored(classes.select("set_a", "set_b", F.col("one.id").alias("id"), F.col("one.version").alias("version")), "classes")
    chosen = classes.select("id", "version")
    member = linked.join(chosen, ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    member = member.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    member = member.withColumn("turn", F.xxhash64("id") / F.lit(2.0**64) + 0.5)
    buckets = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("turn").alias("least")).where("size > 1")
    members = stored(lookup_join(member, buckets, ["bucket"], "inner"), "members")

    speaking = classes.groupBy("id").agg(F.min("version").alias("version")).join(members.select("id").distinct(), "id")
    texts = named.join(speaking, ["id", "version"], "left_semi").dropDuplicates(["id"])
    sets = stored(texts.select(F.col("id").alias("key"), "text").mapInArrow(_set_bytes(k), "key long, grams binary"), "sets")

    labels, upto = None, float(MORE_HUBS)
    members = members.withColumns({"label": F.col("id"), "hub": _first()})
    best_first = True
    while not members.isEmpty():
        pairs = _hub_pairs(members, percent)
        if best_first:
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        links = stored(_links(pairs.select("a", "b"), sets, percent), "confirmed")
        if not links.isEmpty():
            if labels is not None:
                for side in ("a", "b"):
                    own = labels.select(F.col("id").alias(side), F.col("label").alias("to"))
                    links = links.join(own, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
            found = components(links.select("a", "b"))
            if labels is not None:
                step = found.select(F.col("id").alias("label"), F.col("label").alias("next"))
                old = lookup_join(labels, step, ["label"]).select("id", F.coalesce("next", "label").alias("label"))
                found = old.unionByName(found.join(labels.select("id"), "id", "left_anti"))
            labels = stored(found, "labels")
        if best_first:
            best_first = False  # only the best pair of each was tried: the same hubs once more
        else:
            # What has been a hub was compared with all the others of its bucket.
            members, upto = members.where("not hub"), upto * MORE_HUBS
        members = stored(_open(_merged(members, labels)), "members")
        if "sketch" not in members.columns:
            open_sets = sets.withColumnRenamed("key", "id").join(members.select("id").distinct(), "id", "left_semi")
            members = members.join(open_sets.mapInArrow(_sketched, _SKETCHED), "id")
        members = stored(_with_hubs(members, upto), "members")

    final = classes.select("set_a", "set_b", "id", F.col("id").alias("component_id"))
    if labels is not None:
        final = lookup_join(final, labels, ["id"]).withColumn("label", F.coalesce("label", "id"))
        least = final.groupBy("label").agg(F.min("id").alias("least"))
        final = lookup_join(final, least, ["label"]).withColumn("component_id", F.col("least"))
    final = final.select("set_a", "set_b", "component_id")
    out = lookup_join(sizes.withColumn("doc_id", F.col("id")), final, ["set_a", "set_b"])
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its
    columns. Of repeated rows one stays; rows without doc_id all stay."""
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null")
    kept = kept.select(F.col("doc_id").alias("__copy_id"), F.col("version").alias("__copy_version")).distinct()
    named = docs.where("doc_id is not null").withColumn("__copy_version", F.xxhash64("text"))
    named = named.withColumn("__copy_id", F.col("doc_id").cast("long"))
    chosen = named.join(kept, ["__copy_id", "__copy_version"], "left_semi").dropDuplicates(["__copy_id", "__copy_version"])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))
