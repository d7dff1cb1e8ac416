"""Merkle manifest, conversation repair and exact duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorspark.llm import copies, manifest, repair
from floorspark.llm.queries import LLM_QUERIES, damaged_conversations
from tests.llm.fixtures import DOCS, FOLDER, clashing, docs_of, empty, loaded

# the manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """Root and, for each leaf, the siblings before and after it, level by level."""
    level, proofs, places = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for leaf, place in enumerate(places):
            run = place // fanout * fanout
            proofs[leaf].append((level[run:place], level[place + 1 : run + fanout]))
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], proofs


def plain_manifest(rows, fanout):
    """{(doc_id, leaf): (subroot, root, proof)} of unequal rows."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0], plain_leaf(row)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        leaves = sorted(sources[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = leaves, *plain_tree([leaf for _, leaf in leaves], fanout)
    root, above = plain_tree([trees[s][1] for s in order], fanout)
    out = {}
    for source, up in zip(order, above, strict=True):
        leaves, subroot, proofs = trees[source]
        out |= {leaf: (subroot, root, proof + up) for leaf, proof in zip(leaves, proofs, strict=True)}
    return out


def found_manifest(docs, **options):
    return {
        (r.doc_id, r.leaf): (r.subroot, r.root, [(level.before, level.after) for level in r.proof])
        for r in manifest.manifest(docs, **options).collect()
    }


def columns_of(docs):
    return [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]


@pytest.mark.parametrize(("fanout", "block_levels"), [(3, 1), (3, 2), (2, 1), (4, 1), (3, 7)])
def test_every_proof_of_unequal_trees(spark, fanout, block_levels):
    """Sources of 1 to 40 rows: last runs of one, incomplete subtrees, several rounds."""
    rows = [(s * 100 + i, f"text {s} {i}", "en", f"src{s:02d}", i) for s in range(11) for i in range([1, 2, 3, 4, 9, 10, 27, 28, 31, 40, 5][s])]
    docs = spark.createDataFrame(rows, DOCS)
    got = found_manifest(docs, fanout=fanout, block_levels=block_levels)
    assert got == plain_manifest(columns_of(docs), fanout)


def test_manifest_of_the_documents(spark):
    docs = loaded(spark, "documents")
    rows = columns_of(docs)
    want = plain_manifest(rows, 3)
    assert found_manifest(docs, block_levels=2) == want
    by_id = {r.doc_id: r for r in LLM_QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()}
    changed = 0
    for row in rows:
        leaf = plain_leaf(row)
        subroot, root, proof = want[row[0], leaf]
        hit = zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
        folded = plain_leaf((*row[:4], row[4].replace("\n", ""))) if hit else leaf
        for before, after in proof:
            folded = digest(*before, folded, *after)
        got = by_id[row[0]]
        assert (got.leaf, got.subroot, got.root, got.folded_root, got.verified) == (leaf, subroot, root, folded, folded == root)
        assert got.proof_sha256 == digest(*(h for before, after in proof for h in (*before, *after)))
        changed += not got.verified
    assert 0 < changed < len(rows)


def test_manifest_edges(spark):
    assert manifest.manifest(empty(spark)).collect() == []
    one = manifest.manifest(docs_of(spark, ["only"])).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    long = "palabra ñ " * 200_000
    rows = [(None, None, None, None, None), (None, "x", "en", None, 1), (1, "", "en", "", 0), (2, long, "en", "é", 9), (2, "b", None, "z", None)]
    docs = spark.createDataFrame(rows, DOCS)
    for levels in (1, 7):
        assert found_manifest(docs, block_levels=levels) == plain_manifest(columns_of(docs), 3)
    named = manifest.manifest(clashing(spark, ["a", "b"]), carry=("label", "id"))
    assert {(r.doc_id, r.label, r.id) for r in named.collect()} == {(0, "l", 0), (1, "l", 1)}


def test_repeated_rows_are_leaves_of_their_own(spark):
    docs = docs_of(spark, ["same"] * 5, [7] * 5)
    rows = manifest.manifest(docs, block_levels=1).collect()
    root, proofs = plain_tree([plain_leaf((7, "src0", "en", 4, "same"))] * 5, 3)
    assert {r.root for r in rows} == {root}
    assert sorted([(level.before, level.after) for level in r.proof] for r in rows) == sorted(proofs)


def test_a_hot_source_is_spread_over_blocks(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    assert found_manifest(rows, block_levels=3) == plain_manifest(columns_of(rows), 3)


# conversations

_STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, letters, turns) of the cheapest edits of [(role, text, fault)], by trying all."""
    best = [None]

    def go(i, state, cost, letters, said, inserted):
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(rows) and state in ("", "a"):
            best[0] = min(best[0] or (cost, letters, said), (cost, letters, said))
        for role in ("user", "assistant"):
            if inserted < 3 and (state, role[0]) in _STEPS:
                go(i, role[0], cost + 5, letters + "I", (*said, f"{role}:"), inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, state, cost + 2, letters + "D", said, 0)
        if fault in ("blank", "duplicate"):
            return
        extra = 5 if fault == "truncated" else 0
        if (state, role[0]) in _STEPS:
            go(i + 1, _STEPS[state, role[0]], cost + extra, letters + "K", (*said, f"{role}:{text}"), 0)
        for other in ("user", "assistant"):
            if (state, other[0]) in _STEPS:
                go(i + 1, other[0], cost + extra + 1, letters + "R", (*said, f"{other}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    return best[0]


def plain_report(rows):
    """Report of one conversation's (turn, role, text) rows in order."""
    seen, judged = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, said = cheapest(judged)
    counts = [sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")]
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest("\n".join(said))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def reports(rows, conversations=None):
    return {r.conv_id: tuple(r)[1:] for r in repair.audited(rows, conversations).collect()}


TALK = "conv_id long, turn long, role string, text string"


def test_random_conversations_are_repaired_cheapest(spark):
    rng = random.Random(5)
    talks = {}
    for conv in range(300):
        roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", " "], ["Yes.", "No!", "and then", "", " \n", "Why?", f"t{rng.random()}."]
        talks[conv] = [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 9))]
    rows = spark.createDataFrame([(c, *r) for c, said in talks.items() for r in said], TALK).repartition(7)
    got = reports(rows)
    assert got == {c: plain_report(in_order(said)) for c, said in talks.items()}


def test_damaged_conversations(spark):
    raw = [tuple(r) for r in loaded(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    talks = {c: [] for c, *_ in raw}
    for conv, turn, role, text in raw:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in LLM_QUERIES["op12_conversation_repair"](spark, FOLDER).collect()}
    assert got == {c: plain_report(in_order(said)) for c, said in talks.items()}


def test_damage_by_kind_and_nulls(spark):
    rows = [(None, None, None, None), *[(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)]]
    talks = spark.createDataFrame(rows, TALK)
    found = {}
    for r in damaged_conversations(talks).collect():
        found.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    kinds = set()
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want = [("user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        assert found.get((conv, turn), []) == want
        kinds.add(min(kind, 5))
    assert kinds == set(range(6))


def test_repair_edges(spark):
    none = spark.createDataFrame([], TALK)
    assert repair.audited(none).collect() == [] and repair.repaired(none).collect() == []
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", digest())
    assert reports(none, ids) == {1: nothing, None: nothing}
    rows = [(None, None, "user", "Hm."), (None, 1, "assistant", "Yes."), (2, 5, None, "x."), (2, 5, None, "x."), (3, None, None, None)]
    talks = spark.createDataFrame([(*r, "v") for r in rows], f"{TALK}, kind string")
    got = reports(talks)
    assert got[None] == (0, 0, 0, 0, 0, 0, "KK", digest("user:Hm.\nassistant:Yes."))
    assert got[2] == plain_report([(5, " ", "x."), (5, " ", "x.")]) and got[3] == plain_report([(None, " ", " ")])
    edits = [tuple(r) for r in repair.repaired(talks).where("conv_id is null").collect()]
    assert edits == [(None, 1, "K", None, "user", "Hm."), (None, 2, "K", 1, "assistant", "Yes.")]


def test_inserted_turns_come_out(spark):
    talk = spark.createDataFrame([(1, 0, "user", "A?"), (1, 1, "system", "B."), (1, 2, "system", "unfinished")], TALK)
    edits = sorted(tuple(r)[1:] for r in repair.repaired(talk).collect())
    assert edits == [(1, "K", 0, "user", "A?"), (2, "R", 1, "assistant", "B.")]
    assert reports(talk)[1][5:7] == (3, "KRD")


def test_a_long_conversation_keeps_only_open_edits():
    """Alternating turns, a long run of copies, long texts: memory stays small."""
    given = []
    trellis = repair.Trellis(lambda letter, role, row: given.append(letter))

    def nodes():
        count, todo = 0, [trellis.root]
        while todo:
            node = todo.pop()
            count += 1
            todo.extend(node.kids)
        return count

    most = 0
    for i in range(4000):
        trellis.step("assistant" if i % 2 else "user", (i, "x" * 1000), False, False)
        most = max(most, nodes())
    assert len(given) > 3990 and most < 10
    for i in range(4000):
        trellis.step("user", (i, ""), False, True)
    assert nodes() < 10 and trellis.finish() == 8000 and len(given) == 8000


def test_a_crowded_conversation_in_spark(spark):
    """A third of all rows in one conversation, many of them copies."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).cast("long").alias("conv_id"),
        (F.col("id") / 3).cast("long").alias("turn"),
        F.when((F.col("id") / 3).cast("long") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 5 == 0, "Again.").otherwise(F.concat(F.lit("Said "), F.col("id"), F.lit("."))).alias("text"),
    )
    got = reports(rows)[0]
    kept = got[6].count("K") + got[6].count("R")
    assert got[2] == 400 - 2 and len(got[6].replace("I", "")) == 2000 and kept % 2 == 0


# exact duplicates


def plain_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), keep is None or i == keep, digest(text)) for i in ids]
    return sorted(out, key=str)


def found_groups(docs):
    return sorted((tuple(r) for r in copies.exact_duplicates(docs).collect()), key=str)


def test_exact_duplicates_of_the_documents(spark):
    docs = loaded(spark, "documents")
    got = found_groups(docs)
    assert got == plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert got == sorted((tuple(r) for r in LLM_QUERIES["op13_exact_dedup"](spark, FOLDER).collect()), key=str)


def test_duplicate_edges(spark):
    assert found_groups(empty(spark)) == []
    long = "wort " * 200_000
    texts = [None, "", " ", "\t\n", "a b", "a\x0b\x0c b", "a  b", "A b", long, long, "a b", "only null", "only null", "rep", "rep"]
    ids = [9, 8, 7, 6, 5, 4, None, 3, 2, 1, 0, None, None, 11, 11]
    docs = docs_of(spark, texts, ids)
    assert found_groups(docs) == plain_groups(list(zip(ids, texts, strict=True)))
    kept = copies.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 0, 1, 3, 4, 6, 8, 11]
    named = clashing(spark, ["x", "x"]).withColumns({"size": F.lit(1), "fingerprint": F.lit("f"), "keep_id": F.lit(2)})
    assert found_groups(named) == plain_groups([(0, "x"), (1, "x")])
    assert copies.without_copies(named).columns == named.columns


def test_a_hot_text_is_one_group(spark):
    hot = F.when(F.col("id") % 3 == 0, "the  same text").otherwise(F.concat(F.lit("text "), (F.col("id") / 2).cast("long")))
    docs = spark.range(6000, numPartitions=6).select(F.col("id").alias("doc_id"), hot.alias("text"))
    assert found_groups(docs) == plain_groups([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_filters_merge_without_loss(spark, bits):
    """Fingerprints, half of them negative, over several partitions."""
    rng = np.random.default_rng(4)
    prints = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    prints = np.concatenate([prints, prints[:500], np.repeat(prints[7], 900), [-1, -1, 0, 0]])
    rng.shuffle(prints)
    frame = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long").repartition(5)
    merged = copies.quotient_filter(frame, bits)
    rows = merged.collect()
    assert len({r.quotient for r in rows}) == len(rows)
    assert all(list(r.remainders) == sorted(set(r.remainders), key=lambda x: x % 2**64) for r in rows)
    parts = [copies.fingerprints_of(np.full(len(r.remainders), r.quotient), np.array(r.remainders, np.int64), bits).view(np.int64) for r in rows]
    values, counts = np.unique(prints, return_counts=True)
    back = dict(zip(np.concatenate(parts).tolist(), [c for r in rows for c in r.counts], strict=True))
    assert back == dict(zip(values.tolist(), counts.tolist(), strict=True))
    twice = {r.fingerprint: r["count"] for r in copies.repeated(merged, bits).collect()}
    assert twice == {v: c for v, c in back.items() if c > 1}


def test_texts_of_equal_fingerprint_are_told_apart(spark, monkeypatch):
    """Were all fingerprints equal, the bytes would still decide."""
    monkeypatch.setattr(copies.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    docs = docs_of(spark, ["a", "b", "a", "c c"])
    assert found_groups(docs) == plain_groups(list(enumerate(["a", "b", "a", "c c"])))
