from __future__ import annotations

import numpy as np
import pytest

from floorspark.llm import links, minhash
from floorspark.llm.queries import LLM_QUERIES

from tests.llm.fixtures import FOLDER, classes, clashing, docs_of, empty, loaded, near_copies, shingle_set


def found(df):
    return {r.doc_id: r for r in df.collect()}


def test_query_equals_all_pairs(spark):
    texts = {r.doc_id: r.text for r in loaded(spark, "documents").collect()}
    rows = found(LLM_QUERIES["op1_minhash"](spark, FOLDER))
    want = classes(texts, 2, 80)
    assert {i: r.component_id for i, r in rows.items()} == want
    assert {i: r.n_shingles for i, r in rows.items()} == {i: len(shingle_set(t, 2)) for i, t in texts.items()}
    assert all(r.kept == (i == want[i]) for i, r in rows.items())


@pytest.mark.parametrize("k", [2, 5])
def test_groups_near_the_threshold(spark, k):
    texts = near_copies(150) + near_copies(40, words=60, seed=9) + ["quite another text of its own"]
    rows = found(minhash.near_duplicates(docs_of(spark, texts), k=k))
    assert {i: r.component_id for i, r in rows.items()} == classes(dict(enumerate(texts)), k, 80)


def test_signature_is_the_shifted_permutation():
    sets = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = minhash.circulant(sets, np.array([0, 20, 49]), 8)
    placed = minhash._permuted((sets ^ (sets >> np.uint64(32))).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    for k in range(8):
        second = minhash._permuted(placed + np.uint32(k))
        assert list(got[k]) == [second[:20].min(), second[20:].min()]


def test_pairs_at_the_threshold_stay_within_the_sketch():
    """8,000 pairs of exactly 0.8, from 20 to 400 shingles: how far their bits stray."""
    rng = np.random.default_rng(7)
    odds = 0.1
    most = []
    for shared in (16, 40, 120, 320):
        sizes = shared + shared // 8
        for _ in range(20):
            sets, at = [], [0]
            for _ in range(100):
                values = rng.integers(0, 2**64, shared + shared // 4, dtype=np.uint64)
                both, rest = values[:shared], values[shared:]
                sets += [both, rest[: shared // 8], both, rest[shared // 8 :]]
                at += [at[-1] + sizes, at[-1] + 2 * sizes]
            bits = minhash.circulant(np.concatenate(sets), np.array(at), minhash.SKETCH) & 1
            differ = (bits[:, 0::2] != bits[:, 1::2]).sum(axis=0)
            most.append((differ.max() - minhash.SKETCH * odds) / (minhash.SKETCH * odds * (1 - odds)) ** 0.5)
    print("farthest pair of 8,000:", max(most))
    assert max(most) < minhash.SURE


def test_folded_sets_rule_out_no_pair_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows, true = [], set()
    for n in range(600):
        shared, each = int(rng.choice([4, 40, 144, 900])), 0
        each = shared // 8 if n % 2 else shared // 8 + 1 + n % 3
        values = rng.integers(0, 2**64, shared + 2 * each, dtype=np.uint64)
        sides = values[: shared + each], np.concatenate([values[:shared], values[shared + each :]])
        if 100 * shared >= 80 * (shared + 2 * each):
            true.add(n)
        folded = [minhash._folded(x).tolist() for x in sides]
        rows.append((n, len(sides[0]), folded[0], len(sides[1]), folded[1] if n % 50 else None))
    kind = "n long, whole long, folded array<smallint>, whole_a long, folded_a array<smallint>"
    left = {r.n for r in spark.createDataFrame(rows, kind).where(minhash._folded_reach(80)).collect()}
    assert true <= left
    assert {n for n in range(0, 600, 50)} <= left  # a side without a set is left to the confirmation
    assert len(left - true) < 60


def test_members_outside_the_largest_class_end_a_bucket_in_one_round(spark):
    """A bucket of 5,000 with 3 others: those are hubs, so none of its rows comes again."""
    rows = [(1, i, 7 if i < 5000 else i, 5003, (i + 1) / 5010, 1 / 5010, False) for i in range(5003)]
    rows += [(2, i, i, 5003, (i + 1) / 5010, 1 / 5010, False) for i in range(5003)]  # all apart: hubs by turn
    members = spark.createDataFrame(rows, "bucket long, id long, label long, size long, turn double, least double, hub boolean")
    marked = minhash._with_hubs(minhash._open(members), 8.0)
    hubs = {b: {r.id for r in marked.where("hub").collect() if r.bucket == b} for b in (1, 2)}
    assert {5000, 5001, 5002} <= hubs[1]
    assert len(hubs[1]) < 20 and len(hubs[2]) < 20
    again = minhash._open(marked.where("not hub")).groupBy("bucket").count().collect()
    assert [r.bucket for r in again] == [2]


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "one", "ONE", "two words", "Two  WORDS", long, long + " more", "one"]
    rows = found(minhash.near_duplicates(docs_of(spark, texts), k=2))
    assert [rows[i].component_id for i in range(10)] == [0, 1, 2, 3, 3, 5, 5, 7, 7, 3]
    assert [rows[i].n_shingles for i in range(7)] == [0, 0, 0, 1, 1, 1, 1]


def test_repeated_rows_and_missing_ids(spark):
    df = docs_of(spark, ["a b c", "a b c", "a b c", "x y z"], [5, 5, None, 9])
    rows = sorted(minhash.near_duplicates(df, k=2).collect(), key=str)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [(5, 5, True), (5, 5, True), (9, 9, True)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(2, None, True)]
    assert minhash.without_copies(df, k=2).count() == 3  # one row of 5, 9, and the one without doc_id


def test_empty_and_clashing(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []
    df = clashing(spark, ["a b c d e f", "a b c d e f", "other words here"])
    out = minhash.without_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_components_of_a_long_path(spark):
    n = 60
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (201, 202)], "a long, b long")
    got = {r.id: r.label for r in links.components(path).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1
    assert len({got[i] for i in (200, 201, 202)}) == 1
    assert got[0] != got[200]
