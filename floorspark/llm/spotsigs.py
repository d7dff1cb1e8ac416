"""Fingerprints of documents by SpotSigs.

A signature is an anchor with the chain of the next content words after it: a common
word, or the beginning of a sentence, so that texts in any language have signatures.
At a text's end a chain is as long as the words that are left. The sequence of all
words is one more signature of every text; texts of different words thus never share a
fingerprint. A text's fingerprint is its set of signatures, and likeness is the Jaccard
of two sets. Sets whose lengths differ too much are never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorspark.llm.words import NOT_ALNUM, Words, mix, text_slices
from floorspark.plans.skew import lookup_join
from floorspark.session import stored

#: Common words that start a signature; English, German, French, Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their "
    "there they this to was were which will with you "
    "auch auf aus bei das dem den der des die durch ein eine einen einer es für ich im ist mit nach nicht noch sich "
    "sie sind so und vom von vor war wie zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour que qui "
    "se ses son sur un une "
    "al como con de del el en es esta ha la las lo los más no para pero por que se ser si sin su sus un una y"
).split()
#: Content words in a signature's chain.
CHAIN = 2
#: Marks after which a sentence begins.
SENTENCE_ENDS = b".!?\n"
#: Characters of text handled at a time.
CHUNK_CHARS = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The anchor that stands for the beginning of a sentence.
_SENTENCE = np.uint64(0xC2B2AE3D27D4EB4F)
_ENDS = np.isin(np.arange(256), list(SENTENCE_ENDS))


def _anchor_hashes() -> np.ndarray:
    raw = [w.encode() for w in sorted(set(ANCHORS))]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), NOT_ALNUM).hash)


_ANCHOR_HASHES = _anchor_hashes()


def _begins(words: Words, data: np.ndarray) -> np.ndarray:
    """The words that begin a sentence: the first of a text, and those with a mark
    between them and the word before."""
    marks = np.concatenate([[0], np.cumsum(_ENDS[data])])
    begins = np.ones(len(words.start), dtype=bool)
    begins[1:] = marks[words.start[1:]] > marks[words.end[:-1]]
    first = words.first[:-1]
    begins[first[first < len(begins)]] = True
    return np.flatnonzero(begins)


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct signatures of each text; none for an empty text. A text
    without words is its own only signature."""
    out = []
    for lo, hi, data, offsets in text_slices(texts):
        words = Words(data, offsets, NOT_ALNUM)
        h = words.hash
        place = np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)
        anchor = _ANCHOR_HASHES[place] == h
        content = np.flatnonzero(~anchor)
        common, begins = np.flatnonzero(anchor), _begins(words, data)
        starts = np.concatenate([common, begins])
        value = np.concatenate([h[common], np.full(len(begins), _SENTENCE)])
        link = np.searchsorted(content, starts)
        owner = np.searchsorted(words.first, starts, side="right") - 1
        left = np.searchsorted(content, words.first[1:])[owner] - link
        for j in range(CHAIN):
            there = left > j
            value[there] = mix(value[there] * _STEP + h[content[link[there] + j]])
        order = np.argsort(owner, kind="stable")
        value = value[order]
        at = np.searchsorted(owner[order], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            said = h[words.first[i] : words.first[i + 1]]
            raw = said.tobytes() if len(said) else data[offsets[i] : offsets[i + 1]].tobytes()
            whole = [xxhash.xxh3_64_intdigest(raw)] if raw else []
            out.append(np.unique(np.concatenate([value[at[i] : at[i + 1]], np.array(whole, dtype=np.uint64)])))
    return out


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 1 for two empty ones; 0 without comparing
    where their lengths alone keep it under ``least``."""
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 1.0
    if len(x) < least * len(y) or not len(x):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    shared = int(np.count_nonzero(y[at] == x))
    return shared / (len(x) + len(y) - shared)


def fingerprint(signatures: np.ndarray) -> str:
    """Length and digest of a set."""
    return f"{len(signatures)}-{xxhash.xxh3_128_hexdigest(signatures.tobytes())}"


def _compared(run: list[tuple], following: str | None) -> dict[str, list]:
    """Result columns of consecutive documents (doc_id, text, copies); ``following`` is
    the text after the last of them, None where there is none for any of them. Of
    several copies of a row, all but the last are followed by their own text."""
    rows = []
    for n, (doc_id, text, copies) in enumerate(run):
        after = run[n + 1][1] if n + 1 < len(run) else following
        if copies > 1 and following is not None:
            rows.append((doc_id, text, text, copies - 1))
            copies = 1
        rows.append((doc_id, text, after if following is not None else "", copies))
    edited = [t[: len(t) - len(t) // 4] + a[: len(t) // 4] for _, t, a, _ in rows]
    sets = signature_sets(pa.array([*(r[1] for r in rows), *edited, *(r[2] for r in rows[-1:])], pa.string()))
    own, changed = sets[: len(rows)], sets[len(rows) : -1]
    after = [own[n] if r[2] == r[1] else own[n + 1] if n + 1 < len(rows) else sets[-1] for n, r in enumerate(rows)]
    return {
        "doc_id": [r[0] for r in rows],
        "n_chars": [len(r[1]) for r in rows],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": [fingerprint(s) for s in own],
        "edited_fingerprint": [fingerprint(s) for s in changed],
        "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=True)],
        "near_next": [likeness(a, b) if following is not None else None for a, b in zip(own, after, strict=True)],
        "copies": [r[3] for r in rows],
    }


def _in_sequence(kind: pa.DataType):
    """Compares each document with the next of its stretch. Rows come sorted by
    stretch and place; a stretch ends with copies of the document after it."""
    texts = [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    near = [(c, pa.float64()) for c in ("near_edited", "near_next")]
    schema = pa.schema([("doc_id", kind), ("n_chars", pa.int64()), *texts, *near, ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        chars, stretch = 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "stretch", "part", "copies"))
            for doc_id, text, where, part, copies in zip(*columns, strict=True):
                if part == 2:  # without doc_id: nothing follows
                    yield pa.RecordBatch.from_pydict(_compared([(doc_id, text, copies)], None), schema)
                    continue
                if waiting and where != stretch:
                    raise ValueError(f"stretch {stretch} ends without its next document")
                if part == 0 and waiting and waiting[-1][:2] == (doc_id, text):
                    waiting[-1] = (doc_id, text, waiting[-1][2] + copies)
                    continue
                if waiting and (chars > CHUNK_CHARS or part == 1):
                    yield pa.RecordBatch.from_pydict(_compared(waiting, text), schema)
                    waiting, chars = [], 0
                if part == 0:
                    waiting.append((doc_id, text, copies))
                    chars += len(text)
                    stretch = where
        if waiting:
            raise ValueError(f"stretch {stretch} ends without its next document")

    return run


def _stretch_of(heads: list[tuple[int, int]], ids: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """The stretch of each (doc_id, version): the last whose head is not above it."""
    first = np.array([h[0] for h in heads], dtype=np.int64)
    second = np.array([h[1] for h in heads], dtype=np.int64)
    lo, hi = (np.searchsorted(first, ids, side=s) for s in ("left", "right"))
    at = hi.copy()
    for one in np.unique(ids[hi > lo]):
        own = np.flatnonzero(ids == one)
        a, b = lo[own[0]], hi[own[0]]
        at[own] = a + np.searchsorted(second[a:b], versions[own], side="right")
    return at - 1


def _dealt(heads, count: int):
    """Deals rows to stretches; equal rows of a batch become one with their number, and
    a stretch's head is sent to the end of the stretch before it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heads.value
        before = {h: (n - 1) % len(known) for n, h in enumerate(known)}
        for batch in batches:
            versions = batch.column("version").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").cast(pa.int64())
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            keys = np.stack([missing.astype(np.int64), ids, versions], axis=1)
            _, rows, copies = np.unique(keys, axis=0, return_index=True, return_counts=True)
            part = np.where(missing[rows], 2, 0)
            stretch = versions[rows] % count
            named = np.flatnonzero(part == 0)
            if len(named):
                stretch[named] = _stretch_of(known, ids[rows[named]], versions[rows[named]])
            again = [(r, before[key]) for r in rows[named] if (key := (int(ids[r]), int(versions[r]))) in before]
            rows = np.concatenate([rows, np.array([r for r, _ in again], dtype=np.int64)])
            stretch = np.concatenate([stretch, np.array([s for _, s in again], dtype=np.int64)])
            part = np.concatenate([part, np.ones(len(again), dtype=np.int64)])
            copies = np.concatenate([copies, np.ones(len(again), dtype=np.int64)])
            columns = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "version", "text")]
            extra = [pa.array(x.astype(np.int64)) for x in (stretch, part, copies)]
            yield pa.RecordBatch.from_arrays([*columns, *extra], ["doc_id", "version", "text", "stretch", "part", "copies"])

    return run


def _heads(named: DataFrame, count: int) -> list[tuple[int, int]]:
    """The least (doc_id, version) of each of ``count`` ranges of them, found on these
    two numbers alone: as many rows as ranges, as Spark's own range bounds."""
    keys = named.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "version")
    cut = keys.repartitionByRange(count, "doc_id", "version").withColumn("range", F.spark_partition_id())
    least = cut.groupBy("range").agg(F.min(F.struct("doc_id", "version")).alias("head"))
    return sorted((r["head"]["doc_id"], r["head"]["version"]) for r in least.collect())


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, and how near they are to edits.

    ``docs`` has doc_id and text; other columns are ignored. The edited text has
    its last quarter (rounded down, in code points) replaced by as much of the
    beginning of the next document, by doc_id; the first follows the last.
    Returns one row per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (likeness of the fingerprint to
    the edited text's and to the next document's).

    A null text counts as empty; two empty texts are alike. A text without words
    is its own only signature. Rows with one doc_id follow each other by a hash
    of their texts, repeated rows too; those meet as one row with their number. A row
    without doc_id has no next document: its last quarter is cut off, and near_next is
    null.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("version", F.xxhash64("text"))
    count = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = docs.sparkSession.sparkContext.broadcast(_heads(named, count))
    whole = kind.simpleString()
    dealt = named.mapInArrow(_dealt(heads, count), f"doc_id {whole}, version long, text string, stretch long, part long, copies long")
    dealt = dealt.repartition(count, "stretch").sortWithinPartitions("stretch", "part", "doc_id", "version")
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[whole]
    found = dealt.select("doc_id", "text", "stretch", "part", "copies").mapInArrow(
        _in_sequence(arrow),
        f"doc_id {whole}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, copies long",
    )
    # In steps, so that no list is long.
    step = F.lit(1024)
    many = found.withColumn("some", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, step.cast("long"))))
    each = many.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.col("copies") - F.col("some"), step.cast("long")))))
    return each.drop("copies", "some", "one")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = signature_sets(batch.column("text"))
        ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        names = pa.array([fingerprint(s) for s in sets], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "name", "signatures"])


def similar(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with a likeness of percent/100, and the
    documents of each fingerprint.

    Returns (a, b, likeness) of fingerprints a < b, and (doc_id, fingerprint).
    Fingerprints lie in partitions by length, so wide that a partner is in the
    same or the next one. Within those, two sets as like as asked share one of
    their rarest signatures; only sets that do are compared. Texts without
    signatures pair with nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(named.mapInArrow(_sets, f"doc_id {kind}, name string, signatures array<long>"), "spots")
    sets = found.groupBy("name").agg(F.first("signatures").alias("signatures")).where("size(signatures) > 0")
    sets = stored(sets.withColumn("n", F.size("signatures")), "spot-sets")
    single = sets.select("name", "n", F.explode("signatures").alias("signature"))
    ranked = lookup_join(single, single.groupBy("signature").agg(F.count("*").alias("df")), ["signature"])
    rare = ranked.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("df", "signature"))).alias("order"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    width = np.log(100 / percent)
    # A set goes to its own partition and, to meet smaller ones, the one before.
    own = F.floor(F.log(F.col("n").cast("double")) / width)
    keys = rare.select("name", "n", own.alias("own"), F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("x"))
    keys = keys.select("name", "n", "own", F.col("x.signature").alias("signature"))
    left = keys.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("part"), "signature")
    right = keys.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("part"), "signature")
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    pairs = left.join(right, ["part", "signature"]).where(near).select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("name").alias(side), F.col("signatures").alias(f"set_{side}")), side)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = F.size("set_a") + F.size("set_b") - shared
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), shared.alias("shared"), both.alias("both"))
    pairs = pairs.where(F.col("shared") * 100 >= F.col("both") * percent)
    return pairs.select("a", "b", (F.col("shared") / F.col("both")).alias("likeness")), found.select("doc_id", F.col("name").alias("fingerprint"))
