"""Exact duplicates by counting quotient filters and byte verification.

Every partition puts the 64-bit fingerprints of its texts into a counting quotient
filter: the high bits of a fingerprint, its quotient, name a run; the run keeps the
low bits, the remainders, sorted and each with its count. Quotient and remainder
together are the fingerprint, so runs of the same quotient merge without loss, by
merging sorted remainders and adding counts. Fingerprints that end with a count above
one may be copies: only texts whose fingerprint is on the route of those go on, to be
compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join
from floorspark.session import stored

#: Fingerprints that a run of the merged filter holds on average.
RUN = 4096
#: Bits of a fingerprint that name its place on the route: a bitmap of 4 MB at any
#: size of the data. When it fills up, more texts are compared, none is missed.
ROUTE_BITS = 25

_FILTER = "quotient long, remainders array<long>, counts array<long>"


def normalised(text: Column) -> Column:
    """The text in which every run of ASCII blanks is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class QuotientFilter:
    """Sorted distinct fingerprints with their counts, cut into runs by quotient."""

    def __init__(self, quotient_bits: int, fingerprints: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.bits = quotient_bits
        self.fingerprints = np.zeros(0, np.uint64) if fingerprints is None else fingerprints
        self.counts = np.zeros(0, np.int64) if counts is None else counts

    def merged(self, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """This filter and more (fingerprint, count) pairs, in any order."""
        every = np.concatenate([self.fingerprints, fingerprints])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return QuotientFilter(self.bits, every[first], np.add.reduceat(counts, first) if len(first) else counts)

    def _low(self) -> np.uint64:
        return np.uint64(64 - self.bits)

    def runs(self) -> pa.RecordBatch:
        """One row per occupied quotient: its sorted remainders and their counts."""
        quotients = self.fingerprints >> self._low() if self.bits else np.zeros_like(self.fingerprints)
        remainders = self.fingerprints & np.uint64((1 << (64 - self.bits)) - 1)
        first = np.flatnonzero(np.concatenate([[True], quotients[1:] != quotients[:-1]])) if len(quotients) else np.zeros(0, np.int64)
        ends = pa.array(np.concatenate([first, [len(quotients)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64))) for v in (remainders.view(np.int64), self.counts)]
        return pa.RecordBatch.from_arrays([pa.array(quotients[first].astype(np.int64)), *lists], ["quotient", "remainders", "counts"])


def fingerprints_of(quotients: np.ndarray, remainders: np.ndarray, quotient_bits: int) -> np.ndarray:
    """Fingerprints from their two parts."""
    high = quotients.astype(np.uint64) << np.uint64(64 - quotient_bits) if quotient_bits else np.uint64(0)
    return high | remainders.view(np.uint64)


def _built(quotient_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = QuotientFilter(quotient_bits)
        for batch in batches:
            found = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            table = table.merged(found, np.ones(len(found), np.int64))
        yield table.runs()

    return run


def _merged(quotient_bits: int):
    """Merges rows that are sorted by quotient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = QuotientFilter(quotient_bits)
        for batch in batches:
            quotients = batch.column("quotient").to_numpy(zero_copy_only=False)
            if not len(quotients):
                continue
            sizes = np.diff(batch.column("remainders").offsets.to_numpy())
            remainders, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("remainders", "counts"))
            table = table.merged(fingerprints_of(np.repeat(quotients, sizes), remainders, quotient_bits), counts)
            # All runs below the last quotient are complete.
            last = np.uint64(int(quotients[-1]) << (64 - quotient_bits)) if quotient_bits else np.uint64(0)
            done = int(np.searchsorted(table.fingerprints, last))
            yield QuotientFilter(quotient_bits, table.fingerprints[:done], table.counts[:done]).runs()
            table = QuotientFilter(quotient_bits, table.fingerprints[done:], table.counts[done:])
        yield table.runs()

    return run


def quotient_filter(fingerprints: DataFrame, quotient_bits: int) -> DataFrame:
    """The merged filter of a table with a column ``fingerprint``: one row per
    occupied quotient with its sorted remainders and their counts."""
    built = fingerprints.select("fingerprint").mapInArrow(_built(quotient_bits), _FILTER)
    return built.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(_merged(quotient_bits), _FILTER)


def repeated(table: DataFrame, quotient_bits: int) -> DataFrame:
    """The fingerprints of a filter that count more than once, with their count."""
    each = table.select("quotient", F.explode(F.arrays_zip("remainders", "counts")).alias("slot")).where("slot.counts > 1")
    high = F.shiftleft(F.col("quotient"), 64 - quotient_bits) if quotient_bits else F.lit(0).cast("long")
    return each.select(high.bitwiseOR(F.col("slot.remainders")).alias("fingerprint"), F.col("slot.counts").alias("count"))


def _route(repeats: DataFrame) -> bytearray:
    """Bitmap of the high bits of the given fingerprints."""
    place = F.shiftrightunsigned("fingerprint", 64 - ROUTE_BITS)
    pages = repeats.groupBy(F.bitmap_bucket_number(place + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    out, size = bytearray((1 << ROUTE_BITS) // 8 + 4096), 4096
    for page in pages.collect():  # 1,024 pages of 4 KB at most
        out[(page["page"] - 1) * size : page["page"] * size] = page["bits"]
    return out


def _routed(route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            bits = np.frombuffer(route.value, dtype=np.uint8) if bits is None else bits
            place = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - ROUTE_BITS)
            hit = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    return run


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Which rows of ``docs`` have the same normalised text, and which of them stays.

    ``docs`` has doc_id and the text; other columns are ignored. Returns one row per
    row: doc_id, keep_id (the least doc_id of the same text), group_size, kept
    (doc_id equals keep_id) and text_sha256 of the normalised text.

    A null text is an empty one. Rows without doc_id count in their group; they are
    kept only where no row of the text has one, and then have no keep_id. Repeated
    rows of the least doc_id are all kept; :func:`without_copies` leaves one.
    """
    plain = normalised(F.col(text))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("text"))
    named = named.withColumn("fingerprint", F.xxhash64("text"))
    digests = stored(named.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256")), "digests")
    quotient_bits = max(0, math.ceil(math.log2(max(1, digests.count() / RUN))))
    repeats = stored(repeated(quotient_filter(digests, quotient_bits), quotient_bits), "repeats")

    route = docs.sparkSession.sparkContext.broadcast(bytes(_route(repeats)))
    suspects = named.select("fingerprint", "doc_id", "text").mapInArrow(_routed(route), "fingerprint long, doc_id long, text string")
    # Equal keys are equal byte by byte; each task brings a text's copies as one row.
    groups = suspects.groupBy("fingerprint", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
    groups = stored(groups.select(F.sha2("text", 256).alias("text_sha256"), "least", "size"), "groups")
    found = lookup_join(digests.select("doc_id", "text_sha256"), groups, ["text_sha256"])
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(keep.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == keep, F.lit(False))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each normalised text, that of the least doc_id, with all columns."""
    kept = exact_duplicates(docs, text).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_text")).distinct()
    named = docs.withColumns({"__kept_text": F.sha2(normalised(F.col(text)), 256), "__kept_id": F.col("doc_id").cast("long")})
    same = (named["__kept_text"] == kept["__kept_text"]) & named["__kept_id"].eqNullSafe(kept["__kept_id"])
    return named.join(kept, same, "left_semi").dropDuplicates(["__kept_text"]).select(*docs.columns)
