"""Toxicity, line dedup, decontamination, mixing and the pipeline."""

from __future__ import annotations

import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from floorspark.llm import decontam, lines, minhash, mixing, toxicity
from floorspark.llm.queries import LLM_QUERIES, LLM_SQL, MIX_WEIGHTS, _mix_sql
from floorspark.session import stored
from tests.checks import connect, differences, spark_rows, sql_rows
from tests.llm.fixtures import DOCS, FOLDER, classes, clashing, docs_of, empty, loaded, near_copies


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_matches_sql(spark, name):
    assert differences(spark_rows(LLM_QUERIES[name](spark, FOLDER)), sql_rows(connect("0.001"), LLM_SQL[name])) == []


def test_all_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())


# toxicity

INSULTS = ["vile", "rotten", "awful", "nasty"]


def toxic_corpus(count=400, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(30)] = rng.choice(INSULTS)
            words[rng.randrange(30)] = rng.choice(INSULTS)
        rows.append(" ".join(words))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    texts, labels = toxic_corpus()
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(spark, texts), marked).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r.held_out} == set(held)
    assert sum(rows[i].predicted == dict(labels)[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_held_out_labels_change_nothing(spark):
    texts, labels = toxic_corpus(120)
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [
        {r.doc_id: r.score for r in toxicity.score_toxicity(docs_of(spark, texts), spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, other)
    ]
    assert scores[0] == scores[1]


def test_index_equals_trying_all_examples(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(1)
    profiles = []
    for n in range(300):
        terms = np.sort(rng.choice(40, size=rng.integers(1, 6), replace=False)).astype(np.int32)
        weights = rng.random(len(terms)) + 0.1
        profiles.append(toxicity.Profile(terms, weights / np.sqrt(weights @ weights), float(n % 3 == 0), float(n % 3 > 0), str(n)))
    index = toxicity.Index(profiles, 40, 0.3, (1.0, 1.0))
    dense = np.zeros((300, 40))
    for i, p in enumerate(index.profiles):
        dense[i, p.terms] = p.weights
    for _ in range(50):
        terms = np.sort(rng.choice(40, size=rng.integers(1, 6), replace=False)).astype(np.int32)
        weights = rng.random(len(terms))
        weights /= np.sqrt(weights @ weights)
        cosine = dense[:, terms] @ weights
        found, near = index.nearest(terms, weights)
        best = np.sort(cosine[cosine > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(near[: len(best)], best)
        if len(best):
            assert set(found) >= set(np.flatnonzero(cosine > best[-1] + 1e-9))


def test_repeated_example_counts_once(spark):
    rows = [(0, 0, [0], [1])] * 1000 + [(1, 1, [1], [1]), (2, 2, [0, 1], [1, 1])]
    vectors = spark.createDataFrame(rows, "doc_id long, version long, terms array<int>, counts array<int>")
    examples = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity._model(vectors, len(rows), examples, 2, {0: 2, 1: 1})
    assert model.index.members.sum() == 3 and model.index.rates == (1.0, 1.0)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    texts = [None, "", "vile", "x " * 40_000]
    assert [r.score for r in toxicity.score_toxicity(docs_of(spark, texts), none).collect()] == [0.0] * 4
    assert toxicity.score_toxicity(empty(spark), none).collect() == []
    texts, labels = toxic_corpus(100)
    odd = [*labels, (1, None), (None, 1), (2, 7), (3, 0), (3, 1)]
    marked = spark.createDataFrame(odd, "doc_id long, toxic int")
    df = docs_of(spark, [*texts, None, "", texts[0], texts[0]], [*range(100), None, 500, 0, None])
    rows = toxicity.score_toxicity(df, marked).collect()
    assert len(rows) == 104 and len({r.score for r in rows if r.doc_id == 0}) == 1
    assert all(not r.held_out for r in rows if r.doc_id is None)
    extra = clashing(spark, texts)
    assert toxicity.without_toxic(extra, marked).columns == extra.columns


# line dedup


def plain_cut(text):
    return re.findall(r"[^\n]*?[.!?] |[^\n]*\n|[^\n]+$", text)


def plain_dedup(texts):
    """Three real lines of any length, or three sentences that are not all lines."""
    seen, out = set(), []
    for text in texts:
        pieces = plain_cut(text or "")
        rows, row = [], 0
        for p in pieces:
            rows.append(row)
            row += p.endswith("\n")
        kept = [(i, p.strip(" \t\r\n")) for i, p in enumerate(pieces) if p.strip(" \t\r\n")]
        real = {}
        for i, _ in kept:
            real.setdefault(rows[i], []).append(i)
        real = [(places, "".join(p for p, r in zip(pieces, rows, strict=True) if r == own).strip(" \t\r\n")) for own, places in sorted(real.items())]
        windows = [(run[0][0][0], run[2][0][-1], tuple(line for _, line in run)) for run in zip(real, real[1:], real[2:], strict=False)]
        whole = {places[0] for places, _ in real if len(places) == 1}
        for run in zip(kept, kept[1:], kept[2:], strict=False):
            if not all(i in whole for i, _ in run) and sum(len(line) for _, line in run) >= lines.SENTENCE_CHARS:
                windows.append((run[0][0], run[2][0], tuple(line for _, line in run)))
        gone = set()
        for lo, hi, run in sorted(windows):
            if run in seen:
                gone.update(range(lo, hi + 1))
            seen.add(run)
        out.append(("".join(p for i, p in enumerate(pieces) if i not in gone), sum(i in gone for i, _ in kept)))
    return out


def passages(count=60, seed=2):
    rng = random.Random(seed)
    sentence = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 9))).capitalize() + rng.choice([". ", "! ", ".\n", "\n\n", "? "])
    shared = ["".join(sentence() for _ in range(12)) for _ in range(4)]
    texts = []
    for _ in range(count):
        parts = ["".join(sentence() for _ in range(rng.randrange(6)))]
        parts += [rng.choice(shared) if rng.random() < 0.5 else sentence() for _ in range(3)]
        texts.append("".join(parts))
    return [*texts, texts[0], "Yes. No. Yes. ", "Yes. No. Yes. ", shared[0] + shared[0]]


def test_lines_equal_plain_version(spark):
    texts = passages()
    rows = {r.doc_id: r for r in lines.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(rows[i].text, rows[i].n_removed) for i in range(len(texts))] == plain_dedup(texts)
    assert rows[len(texts) - 2].n_removed == 0


def test_short_lines_repeat_like_long_ones(spark):
    """A menu of six short lines in three documents, one of them with other cuts."""
    menu = "Home\nShop\nFAQ\n\nBlog\nJobs\nHelp\n"
    texts = [menu + "First text.", "Before.\n" + menu + "Second text.", "A.\nB.\nC.", "A. B. C.\nD.", "One thing. And two more. And a third one here.", "One thing.\nAnd two more.\nAnd a third one here."]
    rows = {r.doc_id: r for r in lines.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(rows[i].text, rows[i].n_removed) for i in range(len(texts))] == plain_dedup(texts)
    assert rows[0].n_removed == 0 and rows[1].text == "Before.\nSecond text." and rows[3].n_removed == 0 and rows[5].text == ""


def test_very_long_text_without_and_with_breaks(spark):
    texts = ["word " * 60_000, "\n".join(f"l{i}" for i in range(4000)), "x\n" + "\n".join(f"l{i}" for i in range(4000))]
    rows = {r.doc_id: r for r in lines.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(rows[i].text, rows[i].n_removed) for i in range(3)] == plain_dedup(texts) and rows[2].text == "x\n"


def test_line_edges(spark):
    passage = "This line is long enough to count. So is this one, which follows. And a third one ends it.\n"
    texts = [None, "", "\n\n\n", passage, "New. " + passage + "Tail.", passage, passage * 3]
    df = docs_of(spark, texts)
    rows = {r.doc_id: r for r in lines.remove_repeats(df).collect()}
    assert rows[0].text is None and rows[0].n_lines == 0 and rows[3].text == passage
    assert rows[4].text == "New. Tail." and rows[5].text == "" and rows[6].text == ""
    left = {r.doc_id: r for r in lines.without_repeats(df).collect()}
    assert set(left) == {0, 1, 2, 3, 4} and left[4].n_chars == 10 and left[0].n_chars is None
    assert lines.remove_repeats(empty(spark)).collect() == []
    same = lines.remove_repeats(docs_of(spark, [passage] * 4, [1, 1, None, 2])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in same) == [(0, 0), (1, 0), (1, 0), (2, 3)]
    extra = clashing(spark, [passage, passage])
    assert lines.without_repeats(extra).columns == extra.columns


# decontamination


def plain_leaks(texts, items, percent=80):
    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]

    def shingles(w, k):
        return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]

    weight = lambda s: sum(min(63, len(g.replace(" ", ""))) for g in s)
    found = {}
    for d, text in texts.items():
        w = words(text)
        for i, item in items.items():
            x = words(item)
            k = min(5, len(x))
            if not k:
                continue
            b, own = set(shingles(x, k)), shingles(w, k)
            for start in range(max(1, len(w) - len(x) + 1)):
                a = set(own[start : start + len(x) - k + 1])
                if weight(a & b) * 100 >= percent * weight(a | b):
                    found[d, i] = max(found.get((d, i), 0), weight(a & b) / weight(a | b))
    return found


def test_leaks_equal_all_windows(spark):
    texts = {r.doc_id: r.text for r in loaded(spark, "documents").collect()}
    items = {r.item_id: r.text for r in loaded(spark, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r.similarity for r in LLM_QUERIES["op5_decontamination"](spark, FOLDER).collect()}
    assert got == plain_leaks(texts, items) and got


def test_leak_edges(spark):
    item = " ".join(f"Word{i}" for i in range(40))
    items = [(0, item), (1, None), (2, ""), (3, "two words"), (4, item.upper()), (5, "..."), (None, "three small words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = item.replace("Word39", "other").replace("Word0 ", "first ")
    texts = [None, "", f"Before, {item}; after", near, item[: len(item) // 2], "the two words here", "x", item + " " + "pad " * 20_000, "Three SMALL words"]
    rows = decontam.contaminated(docs_of(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = set(plain_leaks(dict(enumerate(texts)), dict(items)))
    assert got == want and {(2, 0), (2, 4), (3, 0), (5, 3), (8, None)} <= got and not {d for d, _ in got} & {0, 1, 4, 6}
    assert decontam.contaminated(empty(spark), bench).collect() == []
    assert decontam.contaminated(docs_of(spark, texts), bench.limit(0)).collect() == []
    df = docs_of(spark, [item, item, item, "clean"], [1, 1, None, None])
    assert [(r.doc_id, r.text) for r in decontam.without_leaks(df, bench).collect()] == [(None, "clean")]
    extra = clashing(spark, [item, "clean words"])
    out = decontam.without_leaks(extra, bench)
    assert out.columns == extra.columns and [r.doc_id for r in out.collect()] == [1]


def edited_items(seed=6):
    """Items with words put in or left out at one place, or their halves
    exchanged, in other text: many near 0.8, the best window between diagonals."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [[word() for _ in range(rng.randrange(30, 60))] for _ in range(12)]
    texts = []
    for item in items:
        for edit in range(1, 6):
            at = rng.randrange(4, len(item) - 4)
            more = [*item[:at], *(word() for _ in range(edit)), *item[at:]]
            for changed in (more, item[:at] + item[at + edit :], item[at:] + item[:at]):
                texts.append(" ".join([*(word() for _ in range(30)), *changed, *(word() for _ in range(30))]))
    return dict(enumerate(texts)), dict(enumerate(map(" ".join, items)))


def test_leaks_between_diagonals(spark):
    texts, items = edited_items()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs_of(spark, list(texts.values())), bench).collect()}
    want = plain_leaks(texts, items)
    assert got == want and sum(x < 0.82 for x in want.values()) >= 3


@pytest.mark.parametrize("size", [1, 7, 200, 1039, 1041])
def test_fingerprint_is_the_weighted_vote(spark, size):
    """Each bit by itself; short lists share numbers for their votes, long ones less."""
    rng = random.Random(size)
    shingles = [rng.getrandbits(64) - 2**63 for _ in range(size)]
    got = spark.createDataFrame([(shingles,)], "shingles array<long>").select(decontam.fingerprint(F.col("shingles")).alias("print")).first().print
    want = 0
    hashes = [(xxhash.xxh64_intdigest(struct.pack("<q", x), seed=42), x & 63) for x in shingles]
    for b in range(64):
        votes = sum(w if h >> b & 1 else -w for h, w in hashes)
        want |= (votes > 0) << b
    assert got % 2**64 == want


def test_long_text_that_repeats_an_item(spark):
    """A window at every start, over stretches and over the text's end."""
    words = [f"word{i}" for i in range(90)]
    text = " ".join([*(f"x{i}" for i in range(70)), *(words * 9), *words[:75]])
    got = decontam.contaminated(docs_of(spark, [text, " ".join(words[5:])]), spark.createDataFrame([(3, " ".join(words))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == plain_leaks({0: text, 1: " ".join(words[5:])}, {3: " ".join(words)})


def test_near_blocks_cover_the_radius():
    rng = random.Random(4)
    for _ in range(300):
        flips = rng.sample(range(64), decontam.RADIUS)
        blocks = [sum(f // decontam.BLOCK_BITS == b for f in flips) for b in range(64 // decontam.BLOCK_BITS)]
        assert min(blocks) <= decontam.BLOCK_RADIUS


# mixing


def plain_split(amount, nodes):
    """{name: granted} of (name, weight, capacity), shortages to siblings."""
    out, left = {}, dict((n, (w, c if w else 0)) for n, w, c in nodes)
    while left:
        pull = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * pull <= amount * w] if pull else list(left)
        if not full:
            return out | {n: amount * w // pull for n, (w, _) in left.items()}
        for n in full:
            out[n] = left.pop(n)[1]
            amount -= out[n]
    return out


def test_budgets_equal_plain_version(spark):
    rng = random.Random(8)
    rows = [(f"domain{rng.randrange(3)}", rng.choice(["en", "de"]), f"src{i}", rng.randrange(5000)) for i in range(30)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = MIX_WEIGHTS | {"domain1/de": 0, "domain2/en/src5": 9}
    got = {(r.domain, r.lang, r.source): int(r.granted) for r in mixing.leaf_budgets(leaves, weights, F.lit(40_000), 2).collect()}

    def cap(path):
        own = [r for r in rows if r[: len(path)] == path]
        if weights.get("/".join(path), 1) == 0:
            return 0
        if len(path) == 3:
            return own[0][3] * 2
        return sum(cap(p) for p in {r[: len(path) + 1] for r in own})

    want = {}

    def grant(path, amount):
        if len(path) == 3:
            want[path] = amount
            return
        below = sorted({r[: len(path) + 1] for r in rows if r[: len(path)] == path})
        shares = plain_split(amount, [(p, weights.get("/".join(p), 1), cap(p)) for p in below])
        for p in below:
            grant(p, shares[p])

    grant((), min(40_000, sum(cap(p) for p in {r[:1] for r in rows})))
    assert got == want


def test_mixing_edges(spark):
    assert mixing.mix_plan(empty(spark), MIX_WEIGHTS).collect() == []
    rows = [(i, "a b c" if i % 3 else None, None if i % 2 else "en", None if i % 5 == 0 else f"src{i % 4}", 5) for i in range(40)]
    rows += [rows[7], rows[7], (None, "a b", "en", "src1", 3)]
    df = spark.createDataFrame(rows, DOCS)
    df.createOrReplaceTempView("mixing_edges")
    con = connect("0.001")
    con.register("edge_docs", df.toPandas().astype({"doc_id": "Int64"}))
    got = mixing.mix_plan(df, MIX_WEIGHTS)
    assert differences(spark_rows(got), sql_rows(con, _mix_sql("edge_docs"))) == []
    extra = clashing(spark, ["a b c", "d e f"])
    out = mixing.mixed(extra, MIX_WEIGHTS)
    assert set(out.columns) == set(extra.columns) and out.columns[-1] == "epochs"


# pipeline


def test_each_stage_equals_its_plain_version(spark):
    docs = loaded(spark, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, FOLDER), name)
        before = {r.doc_id: r for r in docs.collect()}
        texts = {i: r.text for i, r in before.items()}
        left = {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            rows = toxicity.score_toxicity(docs, loaded(spark, "labels")).collect()
            assert set(left) == {r.doc_id for r in rows if not r.predicted}
        elif name == "line_dedup":
            plain = dict(zip(sorted(texts), plain_dedup([texts[i] for i in sorted(texts)]), strict=True))
            want = {i: t for i, (t, n) in plain.items() if not n or t.strip(" \t\r\n")}
            assert {i: r.text for i, r in left.items()} == want
            assert all(r.n_chars == len(r.text) for r in left.values())
        elif name == "minhash_dedup":
            assert set(left) == {i for i, c in classes(texts, 5, 80).items() if i == c}
        elif name == "decontamination":
            items = {r.item_id: r.text for r in loaded(spark, "benchmark").collect()}
            assert set(left) == set(texts) - {d for d, _ in plain_leaks(texts, items)}
        else:
            con = connect("0.001")
            con.register("stage_docs", docs.toPandas())
            want = {r[0]: r[1] for r in con.execute(f"select doc_id, epochs from ({_mix_sql('stage_docs')})").fetchall()}
            assert {i: r.epochs for i, r in left.items()} == want
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert all(left[i][c] == before[i][c] for i in left for c in docs.columns if name != "line_dedup" or c not in ("text", "n_chars"))
        docs = after


def test_stages_on_empty_and_clashing(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), FOLDER).collect() == []
    extra = clashing(spark, [*near_copies(5), None, ""])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, FOLDER).columns == extra.columns, name


def test_run_writes_every_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert set(rows.columns) == {"doc_id", "text", "lang", "source", "n_chars", "epochs"} and 0 < rows.count() < 200


def test_copies_of_one_class(spark):
    df = docs_of(spark, near_copies(30) + near_copies(30))
    want = {i for i, c in classes(dict(enumerate(near_copies(30) + near_copies(30))), 5, 80).items() if i == c}
    assert {r.doc_id for r in minhash.without_copies(df).collect()} == want


def test_line_windows_are_made_once(spark):
    """Both uses of the windows read them where they are stored: no text is cut again."""
    docs = docs_of(spark, ["one line here\ntwo lines here\nthree lines here\n"] * 3)
    plan = lines._covered(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "windows-" in plan
    assert "split(" not in plan
