"""Small tables and plain versions that the operators are compared with."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names an operator might use itself.
CLASHING = "id long, version string, label string, score double, row int, lines int, pieces string, epochs int, key string, _id int, text_hash int"
FOLDER = "/root/testdata/sf0.001"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, texts):
    rows = [(i, t, "en", "src0", len(t or ""), i, "v", "l", 0.5, i, i, "p", i, "k", i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def loaded(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def near_copies(count, words=120, seed=3):
    """Edits of one text, from slight to heavy, so that many pairs lie near 0.8."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randrange(1, words // 6)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(text))
    return out


def blank_words(text):
    lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, k):
    words = blank_words(text)
    if not words:
        return frozenset()
    return frozenset({tuple(words)}) if len(words) < k else frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def classes(texts, k, percent):
    """{doc_id: least doc_id reachable} over all pairs."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
                continue
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}
