"""Toxicity by nearest labelled examples.

Examples are a bounded, documented sample of the labelled documents. Terms are
the words that tell the sample's classes apart; their document frequencies come
from all documents. Each document gets its nearest examples by exact TF-IDF
cosine from a block-max inverted index: blocks of examples are scored in the
order of their upper bounds until no bound reaches the nearest found. Votes fall
with distance, and a logistic curve fitted on the examples, each left out of its
own vote, turns them into calibrated scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.llm.words import NOT_ALNUM, Words, text_slices
from floorspark.session import stored

#: Examples sampled of each class, and terms: bounds of what the driver holds.
EXAMPLES, TERMS = 4000, 4096
#: Least chi-square of a term against the label (p = 0.001), and least examples.
LEAST_CHI2, LEAST_EXAMPLES = 10.83, 3
#: Nearest examples that vote, and the examples of a block.
NEIGHBOURS, BLOCK = 15, 512
#: Added to a distance before it divides a vote, and the prior's share of votes.
SOFT, PRIOR_VOTES = 0.05, 0.5
EVIDENCE = 3
#: Documents that one task scores: their term counts are few bytes, but much work.
TASK_DOCS = 4000


def held_out(doc_id: Column) -> Column:
    """The documents whose labels are never learned."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


@dataclass
class Profile:
    """Examples of one direction: their terms and weights (length 1), how many
    of each class, and one example to name."""

    terms: np.ndarray
    weights: np.ndarray
    toxic: float
    clean: float
    name: str


class Index:
    """Block-max inverted index over distinct example vectors."""

    def __init__(self, profiles: list[Profile], n_terms: int, prior: float, rates: tuple[float, float]):
        # Examples of one leading term lie together, which makes bounds tight.
        profiles = sorted(profiles, key=lambda p: (int(p.terms[np.argmax(p.weights)]), p.terms.tobytes(), p.weights.tobytes()))
        self.profiles, self.prior, self.rates = profiles, prior, rates
        self.toxic = np.array([p.toxic * rates[1] for p in profiles])
        self.clean = np.array([p.clean * rates[0] for p in profiles])
        self.members = np.array([p.toxic + p.clean for p in profiles])
        n_blocks = -(-len(profiles) // BLOCK)
        self.bounds = np.zeros((n_terms, n_blocks), dtype=np.float64)
        #: For each block, the row of each of its terms (or -1), and the rows:
        #: the weights of the block's examples.
        self.rows = np.full((n_blocks, n_terms), -1, dtype=np.int16)
        self.postings: list[np.ndarray] = []
        for b in range(n_blocks):
            own = profiles[b * BLOCK : (b + 1) * BLOCK]
            terms = np.unique(np.concatenate([p.terms for p in own]))
            self.rows[b, terms] = np.arange(len(terms))
            weights = np.zeros((len(terms), BLOCK))
            for i, p in enumerate(own):
                weights[self.rows[b, p.terms], i] = p.weights
            self.postings.append(weights)
            self.bounds[terms, b] = weights.max(axis=1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, left_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest profiles that hold NEIGHBOURS examples, with all equally
        near, and their cosines; only profiles that share a term. One example
        of profile ``left_out`` does not count."""
        upper = weights @ self.bounds[terms]
        order = np.argsort(-upper, kind="stable")
        found, near = np.zeros(0, dtype=np.int64), np.zeros(0)
        least, done, step = 0.0, 0, 2
        while done < len(order) and upper[order[done]] > 0 and upper[order[done]] >= least - 1e-9:
            places, cosines = [found], [near]
            for b in order[done : done + step]:
                if upper[b] <= 0 or upper[b] < least - 1e-9:
                    break
                row = self.rows[b, terms]
                has = row >= 0
                cosine = weights[has] @ self.postings[b][row[has]]
                hit = np.flatnonzero(cosine >= max(least - 1e-9, 1e-12))
                places.append(hit + b * BLOCK)
                cosines.append(cosine[hit])
            done, step = done + step, step * 2
            found, near = np.concatenate(places), np.concatenate(cosines)
            if len(near) > NEIGHBOURS + 1:  # each profile holds an example, one may be left out
                keep = near >= np.partition(near, -NEIGHBOURS - 1)[-NEIGHBOURS - 1] - 1e-9
                found, near = found[keep], near[keep]
            best = np.lexsort((found, -near))
            found, near = found[best], near[best]
            count = np.cumsum(self.members[found] - (found == left_out))
            last = int(np.searchsorted(count, NEIGHBOURS))
            if last < len(near):
                least = near[last]
                keep = near >= least - 1e-9
                found, near = found[keep], near[keep]
        return found, near

    def vote(self, found: np.ndarray, near: np.ndarray, left_out: tuple[int, int] | None = None) -> float:
        """Share of the distance-weighted votes that are for toxic."""
        toxic, clean = self.toxic[found], self.clean[found]
        if left_out is not None:
            number, label = left_out
            (toxic if label else clean)[found == number] -= self.rates[label]
        weight = 1.0 / (SOFT + 1.0 - np.minimum(near, 1.0))
        unit = PRIOR_VOTES / SOFT
        for_it = float(weight @ toxic) + unit * self.prior
        return for_it / (for_it + float(weight @ clean) + unit * (1 - self.prior))


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x))


def _curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic curve from votes to labels by Newton steps, slightly damped."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (weights * (labels - p)) - 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(example, toxic, term): the distinct word hashes of each example."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            words = Words(data, offsets, NOT_ALNUM)
            own = [np.unique(words.hash[words.first[i] : words.first[i + 1]]) for i in range(hi - lo)]
            sizes = [len(x) for x in own]
            toxic = np.repeat(np.array(batch.column("toxic").slice(lo, hi - lo)), sizes)
            terms = np.concatenate(own) if own else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(terms.view(np.int64))], ["toxic", "term"])


def _counted(terms):
    """Each text's counts of the chosen terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets, NOT_ALNUM)
                place = np.searchsorted(known, words.hash)
                place[place == len(known)] = 0
                hit = np.flatnonzero(known[place] == words.hash) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(words.first, hit, side="right") - 1
                pairs, counts = np.unique(doc * max(1, len(known)) + place[hit], return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(known)))
                ends = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "version")),
                        pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
                    ],
                    ["doc_id", "version", "terms", "counts"],
                )

    return run


def _frequencies(n_terms: int):
    """Per task and term, in how many of the task's texts the term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            # A text's terms are distinct, so each entry is one text.
            counts += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["term", "texts"])

    return run


def _vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[terms]
    return weights / np.sqrt(weights @ weights) if len(weights) else weights


@dataclass
class Model:
    """What the tasks need: term weights, the index, the votes of documents
    without terms, and the curve."""

    idf: np.ndarray
    index: Index
    without_terms: float
    curve: tuple[float, float]

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, str | None]:
        if len(terms):
            found, near = self.index.nearest(terms, _vector(terms, counts, self.idf))
            vote = self.index.vote(found, near)
            order = np.lexsort((found, -near))[:EVIDENCE]
            named = ",".join(f"{self.index.profiles[found[i]].name}:{near[i]:.4f}" for i in order) or None
        else:
            vote, named = self.without_terms, None
        x = float(_logit(np.array([vote]))[0])
        return float(1 / (1 + np.exp(-(self.curve[0] * x + self.curve[1])))), named


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, str | None]] = {}
        for batch in batches:
            results = []
            for t, c in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, counts = (np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int32) for x in (t, c))
                key = terms.tobytes(), counts.tobytes()
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = model.value.score(terms, counts)
                results.append(known[key])
            scores = pa.array([r[0] for r in results], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), scores, pa.array([r[1] for r in results], pa.string())],
                ["doc_id", "version", "score", "evidence"],
            )

    return run


def _model(vectors: DataFrame, n_docs: int, examples: DataFrame, n_terms: int, totals: dict[int, int]) -> Model | None:
    """The model from the stored term counts of all documents and the sample."""
    df = np.zeros(n_terms)
    counted = vectors.select("terms").mapInArrow(_frequencies(n_terms), "term int, texts long")
    for row in counted.groupBy("term").agg(F.sum("texts").alias("texts")).collect():
        df[row["term"]] = row["texts"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    # A repeated row is one example; of several texts, that of the least version.
    rows = vectors.join(F.broadcast(examples), "doc_id").groupBy("doc_id", "toxic")
    rows = rows.agg(F.min_by(F.struct("terms", "counts"), "version").alias("own")).select("doc_id", "toxic", "own.*").collect()
    seen = {label: sum(r["toxic"] == label for r in rows) for label in (0, 1)}
    if not rows:
        return None
    rates = tuple(totals.get(c, 0) / seen[c] if seen[c] else 0.0 for c in (0, 1))
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    merged: dict[tuple, Profile] = {}
    owners = []
    empty = [0.0, 0.0]
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        terms, counts = np.array(r["terms"], dtype=np.int32), np.array(r["counts"], dtype=np.int32)
        if not len(terms):
            empty[r["toxic"]] += rates[r["toxic"]]
            owners.append((None, r["toxic"]))
            continue
        key = terms.tobytes(), counts.tobytes()
        if key not in merged:
            merged[key] = Profile(terms, _vector(terms, counts, idf), 0, 0, str(r["doc_id"]))
        merged[key].toxic += r["toxic"]
        merged[key].clean += 1 - r["toxic"]
        owners.append((key, r["toxic"]))
    index = Index(list(merged.values()), n_terms, prior, rates)
    place = {(p.terms.tobytes(), p.name): i for i, p in enumerate(index.profiles)}
    without = (empty[1] + prior) / (sum(empty) + 1)
    votes, alone = [], {}
    for key, label in owners:
        if key is None:
            votes.append(without)
            continue
        if (key, label) not in alone:
            p = merged[key]
            number = place[(p.terms.tobytes(), p.name)]
            found, near = index.nearest(p.terms, p.weights, left_out=number)
            alone[key, label] = index.vote(found, near, left_out=(number, label))
        votes.append(alone[key, label])
    labels = np.array([label for _, label in owners], dtype=float)
    curve = _curve(np.array(votes), labels, np.where(labels > 0, rates[1], rates[0]))
    return Model(idf, index, without, curve)


def _scores(docs: DataFrame, labels: DataFrame, examples_per_class: int) -> DataFrame:
    """(doc_id, version, score, evidence); version is a hash of the text."""
    spark = docs.sparkSession
    learned = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learned = learned.where(~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    picked = [learned.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples_per_class) for c in (0, 1)]
    examples = stored(picked[0].unionByName(picked[1]), "examples")
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))
    known = named.join(F.broadcast(examples), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", "version").alias("text"))

    seen = known.select("toxic", "text").mapInArrow(_all_words, "toxic int, term long")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pos, neg = float(counts.get(1, 0)), float(counts.get(0, 0))
    per_term = seen.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    n, rest = pos + neg, F.lit(pos + neg) - a - b
    chi2 = n * (a * (neg - b) - b * (pos - a)) ** 2 / (F.greatest(F.lit(pos * neg), F.lit(1.0)) * (a + b) * F.greatest(rest, F.lit(0.5)))
    telling = per_term.where(a + b >= LEAST_EXAMPLES).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    chosen = telling.orderBy(F.desc("chi2"), "term").limit(TERMS).select("term").collect()
    terms = np.sort(np.array([r["term"] for r in chosen], dtype=np.int64).view(np.uint64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    vectors = named.mapInArrow(_counted(spark.sparkContext.broadcast(terms)), f"doc_id {kind}, version long, terms array<int>, counts array<int>")
    vectors = stored(vectors, "term-counts")
    n_docs = vectors.count()
    model = _model(vectors, n_docs, examples, len(terms), totals)
    if model is None:
        scored = vectors.select("doc_id", "version", F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("evidence"))
    else:
        spread = vectors.repartition(n_docs // TASK_DOCS + 1)
        scored = spread.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {kind}, version long, score double, evidence string")
    return scored


def score_toxicity(docs: DataFrame, labels: DataFrame, examples_per_class: int = EXAMPLES) -> DataFrame:
    """Scores every whole text; ``labels`` has doc_id and toxic (0 or 1).

    ``docs`` has doc_id and text; other columns are ignored. Only labels of
    documents that are not held out are learned, and of those a sample of
    ``examples_per_class`` (fewest first by a hash) becomes the index; class
    rates come from all of them. Returns one row per row: doc_id, held_out,
    score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5),
    evidence (the nearest examples' doc_id and cosine, best first, or null).

    Null and empty texts, and texts without any term, get the rate of the
    examples without terms. Labels other than 0 and 1 are ignored, and of
    several labels of a document the largest counts. Without any learnable
    label every score is 0. Rows without doc_id are scored and not held out.
    """
    return _scores(docs, labels, examples_per_class).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, examples_per_class: int = EXAMPLES) -> DataFrame:
    """The documents predicted not to be toxic, with all their columns."""
    rejected = _scores(docs, labels, examples_per_class).where("score >= 0.5")
    rejected = rejected.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]) & (version == rejected["_version"]), "left_anti")
