"""Token counts, fingerprints, url lists, license scans, personal data."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from floorspark.llm import licenses, pii, spotsigs, tokens, urls
from floorspark.llm.queries import LLM_QUERIES, URL_RULES
from floorspark.session import new_folder
from tests.llm.fixtures import FOLDER, clashing, docs_of, empty, loaded, near_copies


def texts_of(spark):
    return {r.doc_id: r.text for r in loaded(spark, "documents").collect()}


# token counts


def test_token_counts(spark):
    texts = texts_of(spark)
    rows = LLM_QUERIES["op6_token_counts"](spark, FOLDER).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))
        assert r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 4096)


def test_cache_encodes_only_misses(spark):
    cache, model = new_folder(spark, "cache"), public_tokenizers.path("piece_bpe_32k.model")
    first = docs_of(spark, ["some text", "some text", None, "", "<s> special </s>"])
    a = {r.doc_id: r.n_tokens for r in tokens.count_tokens(first, model, cache).collect()}
    assert spark.read.parquet(cache).count() == 3
    more = docs_of(spark, ["some text", "new text"], [7, None])
    b = tokens.count_tokens(more, model, cache).collect()
    assert spark.read.parquet(cache).count() == 4
    assert a[0] == a[1] == {r.doc_id: r.n_tokens for r in b}[7] and a[2] == a[3] == 0
    other = tokens.count_tokens(more, public_tokenizers.path("byte_bpe_50k.json"), cache).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in other}[7] == len(plain.encode("some text", add_special_tokens=False).ids)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_repeated_rows_are_encoded_once(spark):
    cache, model = new_folder(spark, "cache"), public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the same text"] * 50 + ["another one"] * 30
    docs = docs_of(spark, texts, [5] * 50 + [None] * 30).repartition(6)
    rows = tokens.count_tokens(docs, model, cache).collect()
    assert len(rows) == 80 and len({(r.doc_id, r.n_tokens) for r in rows}) == 2
    assert spark.read.parquet(cache).count() == 2


def test_token_edges(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.count_tokens(empty(spark), model, new_folder(spark, "cache")).collect() == []
    rows = tokens.count_tokens(clashing(spark, ["x " * 5000]), model, new_folder(spark, "cache")).collect()
    assert rows[0].over_limit and rows[0].n_bytes == 10_000


# fingerprints


def test_fingerprints_and_edits(spark):
    docs = sorted(texts_of(spark).items())
    rows = {r.doc_id: r for r in LLM_QUERIES["op7_spotsigs"](spark, FOLDER).collect()}
    sets = dict(zip((d for d, _ in docs), spotsigs.signature_sets(__import__("pyarrow").array([t for _, t in docs])), strict=True))
    for n, (d, text) in enumerate(docs):
        after, following = docs[(n + 1) % len(docs)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert rows[d].n_chars == len(text)
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = set(sets[d].tolist()), set(sets[after].tolist())
        assert rows[d].near_next == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        assert (rows[d].fingerprint == rows[after].fingerprint) == (x == y)
    near = [r.near_edited for r in rows.values()]
    assert sum(near) / len(near) > 0.5 > 10 * sum(r.near_next for r in rows.values()) / len(rows)


def plain_signatures(text):
    """The signatures of a text as tuples of words, written anew."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    if not found:
        return {text} if text else set()
    words = [w for w, _, _ in found]
    chain = lambda n: tuple([w for w in words[n:] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN])
    out = {("whole", *words)}
    for n, (word, start, _) in enumerate(found):
        if word in spotsigs.ANCHORS:
            out.add((word, chain(n)))
        if n == 0 or re.search(r"[.!?\n]", low[found[n - 1][2] : start]):
            out.add((None, chain(n)))
    return out


def test_fingerprints_by_plain_signatures(spark):
    docs = sorted((d, t if len(t) < 4000 else t[:4000]) for d, t in texts_of(spark).items())
    docs += [(10**6 + i, t) for i, t in enumerate(["the", "The cat", "the cat sat. Down", "été là. Où\nça", "?!", "", "one two three", "one two three. Four"])]
    rows = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs_of(spark, [t for _, t in docs], [d for d, _ in docs])).collect()}
    sets = [plain_signatures(t) for _, t in docs]
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for n, (d, text) in enumerate(docs):
        quarter = len(text) // 4
        edited = plain_signatures(text[: len(text) - quarter] + docs[(n + 1) % len(docs)][1][:quarter])
        assert rows[d].near_edited == pytest.approx(like(sets[n], edited))
        assert rows[d].near_next == pytest.approx(like(sets[n], sets[(n + 1) % len(docs)]))
        assert rows[d].fingerprint.startswith(f"{len(sets[n])}-")


def test_repeated_rows_and_hot_ids_in_sequence(spark):
    texts = [f"text {i} of the one id" for i in range(300)] + ["a row that repeats"] * 5000 + [f"other {i}" for i in range(50)]
    ids = [7] * 300 + [8] * 5000 + list(range(20, 70))
    rows = spotsigs.fingerprint_edits(docs_of(spark, texts, ids).repartition(5)).collect()
    assert len(rows) == len(texts)
    again = [r.near_next for r in rows if r.doc_id == 8]
    assert len(again) == 5000 and sum(x < 1 for x in again) == 1
    tail = {r.doc_id: r for r in rows if r.doc_id >= 20}
    for i in range(49):
        text, after = f"other {i}", f"other {i + 1}"
        quarter = len(text) // 4
        assert tail[20 + i].edited_sha256 == hashlib.sha256((text[: len(text) - quarter] + after[:quarter]).encode()).hexdigest()


def test_stretches_split_one_id():
    heads = [(3, 5), (7, -4), (7, 10), (9, 0)]
    ids, versions = [3, 4, 7, 7, 7, 8, 9, 12], [6, -9, -4, 9, 10, 0, 0, 1]
    assert list(spotsigs._stretch_of(heads, __import__("numpy").array(ids), __import__("numpy").array(versions))) == [0, 0, 1, 1, 2, 2, 3, 3]


def test_fingerprint_edges(spark):
    texts = [None, "", "the", "!!!", "the cat the dog the bird the fish saw it", "the cat the dog the bird the fish saw it", "x" * 300_000]
    rows = {r.doc_id: r for r in spotsigs.fingerprint_edits(docs_of(spark, texts)).collect()}
    assert rows[0].near_next == 1.0 and rows[4].near_next == 1.0 and rows[4].fingerprint == rows[5].fingerprint
    assert rows[0].n_chars == 0 and rows[2].fingerprint != rows[3].fingerprint
    assert spotsigs.fingerprint_edits(empty(spark)).collect() == []
    one = spotsigs.fingerprint_edits(docs_of(spark, ["abcd efgh"], [4])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.near_next == 1.0
    rows = spotsigs.fingerprint_edits(docs_of(spark, ["a b", "c d e f", "c d e f"], [None, 1, 1])).collect()
    assert len(rows) == 3 and [r.near_next for r in rows if r.doc_id is None] == [None]
    assert len(spotsigs.fingerprint_edits(clashing(spark, ["a b", "c d"])).collect()) == 2


def test_similar_fingerprints(spark):
    texts = near_copies(60, words=80) + ["the first of all", ""]
    texts = [re.sub(r"w(\d+)", lambda m: ("the " if int(m[1]) % 3 == 0 else "") + m[0], t) for t in texts]
    pairs, members = spotsigs.similar(docs_of(spark, texts), 80)
    sets = {spotsigs.fingerprint(s): set(s.tolist()) for s in spotsigs.signature_sets(__import__("pyarrow").array(texts)) if len(s)}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert members.count() == len(texts)


# url lists


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)


def test_url_edges(spark):
    cases = [
        None, "", "example.com/en/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/a?b", "https://a.www.example.com/en/#x",
        "http://example.com/EN/", "http://example.com", "http://example.com?x=/en/", "http://notexample.com/en/", "ftp://x.net/es/1",
        "http://x.net/fr/", "http://x.net/de/", "http://net/es/", "http://.com/", "http://com./", "a://b://c.com/en/", "http://x.net/fr",
    ]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    for r in urls.judge_urls(pages, URL_RULES).collect():
        rule = plain_rule(r.host, r.path, URL_RULES)
        assert (r.rule, r.verdict) == ((rule.host + rule.path, rule.verdict) if rule else (None, "allow")), cases[r.page_id]
    by = {r.page_id: (r.host, r.path) for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert by[0] == by[1] == by[2] == ("", "") and by[3] == ("example.com", "/en/x") and by[8] == ("example.com", "")
    assert urls.judge_urls(pages.limit(0), URL_RULES).collect() == []
    extra = pages.selectExpr("page_id", "url", "'h' as host", "1 as rule", "2 as verdict")
    assert urls.judge_urls(extra, URL_RULES).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_trie_equals_trying_all_rules():
    rules = [urls.Rule(h, p, v) for h in ("a", "b.a", "c.b.a", "x") for p in ("/", "/p", "/p/", "/p/q/", "") for v in ("allow", "block") if len(h + p) % 3]
    trie = urls.Trie(rules)
    for host in ("a", "b.a", "z.b.a", "d.c.b.a", "ca", "x", "y"):
        for path in ("", "/", "/p", "/pq", "/p/", "/p/q", "/p/q/r", "/x/p/"):
            assert trie.match(host, path) == plain_rule(host, path, rules), (host, path)


# license scans


def test_license_base(spark):
    texts = texts_of(spark)
    phrases = [(p.label, p.text.lower().split()) for p in licenses.PHRASES]
    for r in LLM_QUERIES["op10_license_scan"](spark, FOLDER).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), texts[r.doc_id]))
        places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        at = [i for i, _ in places]
        base = {label for _, label in places}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | {""}


def test_license_notices(spark):
    gpl = "This work is licensed under the new GNU General Public License, version 3."
    texts = [None, "", "MIT license", "Under the MIT license under the MIT license; cc by-nc cc by nc", gpl, "all rights", "word " * 50_000 + "CC BY NC", "licensed under the law of the land"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (4, 0, 11, "cc-by-nc,mit")
    assert rows[4].labels == "gpl-3" and rows[4].n_base == 0 and rows[4].score == 1.0
    assert rows[6].first_word == 50_000 and all(rows[i].labels == "" and rows[i].score == 0 for i in (0, 1, 2, 5, 7))
    assert licenses.scan_licenses(empty(spark)).collect() == []
    twice = licenses.scan_licenses(docs_of(spark, ["cc by nc", "cc by nc", "none", "cc by nc"], [1, 1, 1, None])).collect()
    assert sorted(r.n_base for r in twice) == [0, 1, 1, 1]
    assert len(licenses.scan_licenses(clashing(spark, ["cc by nc"])).collect()) == 1


# personal data


def plain_spans(text):
    def ok(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            odd = sum(digits[::-1][::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[::-1][1::2])
            return 14 <= len(digits) <= 19 and odd % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = []
    for rank, kind in enumerate(pii.KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pii._PARTS[kind].replace("++", "+"), text) if ok(kind, m.group())]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def test_personal_data_by_form(spark):
    texts = texts_of(spark)
    for r in LLM_QUERIES["op3_personal_data"](spark, FOLDER).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_personal_data_edges(spark):
    texts = [
        None, "", "a@b.c_x@d.e, é +1 (988) 555-2485 1.2.3.4.5 999.1.1.1", "4041894974608795 4041 8949 7460 8795 4041894974608796",
        "x" * 40_000 + "@", "+123 +1234567890123456 " + "1 " * 3000, "a@b a@b. a@b.c. 001.002.003.255 1.2.3.256",
    ]
    rows = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(",".join(plain_spans(text or "")).encode()).hexdigest(), i
    assert rows[0].spans == "" and pii.find_personal_data(empty(spark)).collect() == []
    assert [r.n_email for r in pii.find_personal_data(docs_of(spark, ["a@b.c"] * 3, [1, 1, None])).collect()] == [1, 1, 1]
    assert len(pii.find_personal_data(clashing(spark, ["a@b.c"])).collect()) == 1


def test_context_finds_other_identifiers(spark):
    known = [f"Hello, my phone number: +1 (555) 555-{1000 + i} thank you" for i in range(12)]
    texts = [*known, "Hello, my phone number: 5551234567 thank you", "written to 5551234567 before", "order 99887766 of the day"]
    rows = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    assert rows[12].n_phone == 0 and rows[12].spans == "phone:24:34"
    assert rows[13].spans == "phone:11:21" and rows[14].spans == ""


def test_context_finds_spaced_groups(spark):
    known = [f"Hello, my phone number: +1 (555) 555-{1000 + i} thank you" for i in range(12)]
    spaced = ["Hello, my phone number: 030 123 456 thank you", "Hello, my phone number: (988) 555-2485 thank you", "Hello, my phone number: 030123456. Thank you"]
    rows = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, [*known, *spaced, "12 of 2021 15 days"])).collect()}
    assert [rows[i].spans for i in (12, 13, 14, 15)] == ["phone:24:35", "phone:24:38", "phone:24:33", ""]
    assert [rows[i].n_learned for i in (0, 12, 13, 14, 15)] == [0, 1, 1, 1, 0]


def test_rounds_go_on_to_the_end(spark):
    """Four levels: each pattern is learned from what the one before has found."""
    groups = [[f"+1 (555) 555-{1000 + i}" for i in range(120)]]
    groups += [[f"{k}0{i:03d}7788" for i in range(n)] for k, n in enumerate((54, 24, 10, 4), 1)]
    texts = [f"left{k} side{k} {v} right{k} end{k}" for k in range(4) for v in groups[k] + groups[k + 1]]
    rows = pii.find_personal_data(docs_of(spark, texts)).collect()
    assert sum(r.n_learned for r in rows) == len(texts) - 120
