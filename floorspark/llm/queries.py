"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspark.llm import copies, decontam, licenses, lines, manifest, minhash, mixing, pii, repair, spotsigs, tokens, toxicity, urls
from floorspark.session import new_folder, tune

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_SQL[name] = sql
        return build

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_register("op1_minhash")
def _op1(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, folder, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@_register("op6_token_counts")
def _op6(spark: SparkSession, folder: str) -> DataFrame:
    # A cache of its own for each run, so that every run does the whole work.
    return tokens.count_tokens(
        _table(spark, folder, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        cache=new_folder(spark, "token-counts"),
    )


#: The lists of the contract.
URL_RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]


@_register(
    "op8_url_filter",
    r"""
    with parts as (
        select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
        from pages
    ), split as (
        select page_id,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from parts
    ), rules(rule_host, rule_path, rule_verdict) as (
        values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), fitting as (
        select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
            max_by(rule_verdict, length(rule_host || rule_path)) as rule_verdict
        from split join rules
            on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        group by page_id
    )
    select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
    from split left join fitting using (page_id)
    """,
)
def _op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_table(spark, folder, "pages"), URL_RULES)


@_register("op5_decontamination")
def _op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_register(
    "op9_line_dedup",
    r"""
    with cut as (
        select doc_id, text, unnest(range(1, len(p) + 1)) as place, unnest(p) as piece
        from (select doc_id, text, string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) as p from documents)
    ), pieces as (
        select *, coalesce(sum(ends_with(piece, chr(10))::int) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) as row
        from cut
    ), lines as (
        select doc_id, place, row, trim(piece, ' ' || chr(9) || chr(13) || chr(10)) as line from pieces
        where trim(piece, ' ' || chr(9) || chr(13) || chr(10)) <> ''
    ), real_lines as (
        select doc_id, row, min(place) filter (trim(piece, ' ' || chr(9) || chr(13) || chr(10)) <> '') as lo,
            max(place) filter (trim(piece, ' ' || chr(9) || chr(13) || chr(10)) <> '') as hi, count(*) filter (trim(piece, ' ' || chr(9) || chr(13) || chr(10)) <> '') as n,
            trim(string_agg(piece, '' order by place), ' ' || chr(9) || chr(13) || chr(10)) as line
        from pieces group by doc_id, row having trim(string_agg(piece, '' order by place), ' ' || chr(9) || chr(13) || chr(10)) <> ''
    ), line_runs as (
        select doc_id, lo, lead(hi, 2) over w as hi, [line, lead(line, 1) over w, lead(line, 2) over w] as said
        from real_lines window w as (partition by doc_id order by row)
    ), sentence_runs as (
        select l.doc_id, place as lo, lead(place, 2) over w as hi,
            [l.line, lead(l.line, 1) over w, lead(l.line, 2) over w] as said, greatest(n, lead(n, 1) over w, lead(n, 2) over w) as most
        from lines l join real_lines r on r.doc_id = l.doc_id and r.row = l.row window w as (partition by l.doc_id order by place)
    ), windows as (
        select doc_id, lo, hi, said from line_runs where hi is not null
        union all
        select doc_id, lo, hi, said from sentence_runs where hi is not null and most > 1 and length(said[1]) + length(said[2]) + length(said[3]) >= 40
    ), later as (
        select * from windows qualify row_number() over (partition by said order by doc_id, lo) > 1
    ), gone as (
        select distinct doc_id, unnest(range(lo, hi + 1)) as place from later
    ), kept as (
        select doc_id, string_agg(piece, '' order by place) as text
        from pieces anti join gone using (doc_id, place) group by doc_id
    ), lost as (
        select doc_id, count(*) as n from lines join gone using (doc_id, place) group by doc_id
    ), counted as (
        select doc_id, count(*) as n from lines group by doc_id
    )
    select doc_id, coalesce(kept.text, '') as text, coalesce(counted.n, 0) as n_lines, coalesce(lost.n, 0) as n_removed
    from documents left join kept using (doc_id) left join counted using (doc_id) left join lost using (doc_id)
    """,
)
def _op9(spark: SparkSession, folder: str) -> DataFrame:
    return lines.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))


@_register("op10_license_scan")
def _op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


@_register("op2_toxicity")
def _op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register("op7_spotsigs")
def _op7(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.fingerprint_edits(_table(spark, folder, "documents"))


#: Target weights by path; what is not named weighs 1.
MIX_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2, "domain0/en": 4, "domain1/en": 3, "domain2/de": 2, "domain0/en/src3": 2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 4), 2, 7


def _mix_sql(table: str) -> str:
    """The rows of ``mix_plan`` over ``table``, level by level."""
    weight = "case {path} " + " ".join(f"when '{p}' then {w}" for p, w in MIX_WEIGHTS.items()) + " else 1 end"
    names = ["domain", "lang", "source"]
    steps = []
    for depth in (3, 2, 1):
        own, path = ", ".join(names[:depth]), " || '/' || ".join(names[:depth])
        below, what = ("leaf", f"tokens * {MIX_EPOCHS}") if depth == 3 else (f"cap{depth + 1}", "capacity")
        steps.append(
            f"cap{depth} as (select {own}, sum(tokens) as tokens, {weight.format(path=path)}::hugeint as weight, "
            f"case when {weight.format(path=path)} > 0 then sum({what}) else 0 end::hugeint as capacity from {below} group by {own})"
        )
    for depth in (1, 2, 3):
        own, up = ", ".join(names[:depth]), ", ".join(names[: depth - 1])
        part = f"partition by {up} " if up else ""
        order = f"{part}order by capacity / greatest(weight, 1), {names[depth - 1]}"
        amount = (
            f"(select least((select sum(tokens)::hugeint * {MIX_SHARE[0]} // {MIX_SHARE[1]} from leaf), (select sum(capacity) from cap1)))"
            if depth == 1
            else f"granted{depth - 1}.granted"
        )
        join = f" join granted{depth - 1} using ({up})" if up else ""
        steps += [
            f"in{depth} as (select {own}, cap{depth}.tokens as tokens, weight, capacity, {amount} as amount from cap{depth}{join})",
            f"at{depth} as (select *, amount - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0) as rest, "
            f"sum(weight) over ({order} rows between current row and unbounded following) as pull, row_number() over ({order}) as turn from in{depth})",
            f"first{depth} as (select *, min(case when capacity * pull > rest * weight then turn end) over ({part}) as start from at{depth})",
            f"level{depth} as (select *, max(case when turn = start then rest end) over ({part}) as level_rest, "
            f"max(case when turn = start then pull end) over ({part}) as level_pull from first{depth})",
            f"granted{depth} as (select {own}, tokens, case when start is null or turn < start then capacity else level_rest * weight // level_pull end as granted from level{depth})",
        ]
    return f"""
    with sized as (
        select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens,
            case when regexp_matches(coalesce(source, ''), '[0-9]$')
                then 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 3)::varchar else 'other' end as domain,
            coalesce(lang, '') as lang, coalesce(source, '') as source
        from {table}
    ), leaf as (
        select domain, lang, source, sum(n_tokens)::hugeint as tokens from sized group by all
    ), {", ".join(steps)},
    keyed as (
        select sized.*, least(case when tokens > 0 then granted // tokens else 0 end, {MIX_EPOCHS})::bigint as whole,
            granted - (case when tokens > 0 then granted // tokens else 0 end) * greatest(tokens, 1) as room
        from sized join granted3 using (domain, lang, source)
    ), placed as (
        select *, sum(n_tokens) over (
            partition by domain, lang, source order by md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::varchar, ''))
        ) as upto
        from keyed
    )
    select doc_id, domain, lang, source, n_tokens, epochs
    from (select *, least(whole + (upto <= room)::int, {MIX_EPOCHS})::bigint as epochs from placed)
    where epochs > 0
    """


@_register("op4_source_mixing", _mix_sql("documents"))
def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, folder, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


@_register("op3_personal_data")
def _op3(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, n: if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {byte}))"


def _leaf_sql(text: str) -> str:
    part = lambda v: f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')"
    return "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_MANIFEST_SQL = f"""
with recursive damaged as (
    select *, case when {_crc32_sql("doc_id::varchar")} % 2 = 0 then replace(text, chr(10), '') else text end as cut from documents
), leaf as (
    select doc_id, coalesce('=' || source, '') as tree, {_leaf_sql("text")} as leaf, {_leaf_sql("cut")} as found from damaged
), placed as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as m from leaf
), nodes as (
    select 0 as level, tree, idx, leaf as h, m from placed
    union all
    select level + 1, tree, idx // 3, sha256(string_agg(h, '' order by idx)), (m + 2) // 3 from nodes where m > 1 group by level, tree, idx // 3, m
), subroots as (
    select tree, level as depth, h as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as m from nodes where m = 1
), tops as (
    select 0 as level, idx, subroot as h, m from subroots
    union all
    select level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (m + 2) // 3 from tops where m > 1 group by level, idx // 3, m
), path as (
    -- For each leaf and level, its place there; the top tree's levels follow the source's.
    select p.doc_id, p.tree, p.idx as leaf_idx, s.depth, s.idx as top_idx, unnest(range(0, s.depth + (select max(level) from tops))) as level
    from placed p join subroots s using (tree)
), runs as (
    select a.tree, a.leaf_idx, a.level, n.idx, n.h, n.idx < a.leaf_idx // power(3, a.level)::bigint as before
    from path a join nodes n on n.tree = a.tree and n.level = a.level and n.idx // 3 = a.leaf_idx // power(3, a.level + 1)::bigint
        and n.idx <> a.leaf_idx // power(3, a.level)::bigint where a.level < a.depth
    union all
    select a.tree, a.leaf_idx, a.level, n.idx, n.h, n.idx < a.top_idx // power(3, a.level - a.depth)::bigint
    from path a join tops n on n.level = a.level - a.depth and n.idx // 3 = a.top_idx // power(3, a.level - a.depth + 1)::bigint
        and n.idx <> a.top_idx // power(3, a.level - a.depth)::bigint where a.level >= a.depth
), proofs as (
    select tree, leaf_idx, string_agg(h, '' order by level, idx) as proof from runs group by all
), sides as (
    select a.tree, a.leaf_idx, a.level, coalesce(string_agg(r.h, '' order by r.idx) filter (r.before), '') as b,
        coalesce(string_agg(r.h, '' order by r.idx) filter (not r.before), '') as e
    from path a left join runs r using (tree, leaf_idx, level) group by all
), folded as (
    select tree, idx as leaf_idx, 0 as level, found as h from placed
    union all
    select f.tree, f.leaf_idx, f.level + 1, sha256(s.b || f.h || s.e) from folded f join sides s using (tree, leaf_idx, level)
), ends as (
    select tree, leaf_idx, arg_max(h, level) as h from folded group by all
)
select p.doc_id, p.leaf, s.subroot, t.h as root, sha256(coalesce(r.proof, '')) as proof_sha256, e.h as folded_root, e.h = t.h as verified
from placed p join subroots s using (tree) join ends e on e.tree = p.tree and e.leaf_idx = p.idx
left join proofs r on r.tree = p.tree and r.leaf_idx = p.idx cross join (select h from tops where m = 1) t
"""


@_register("op11_merkle_manifest", _MANIFEST_SQL)
def _op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(*manifest.FIELDS)
    # What a careless copy of the dataset would hold.
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.leaf_digest(*[F.col(c) for c in manifest.FIELDS[:-1]], cut)
    made = manifest.manifest(docs.withColumn("found", found), carry=("found",))
    folded = made.withColumn("folded_root", manifest.folded_root(F.col("found"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_REPAIR_SQL = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations
), damaged as (
    select conv_id, turn, if(code = 4, 'user', role) as role,
        case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(if(code = 3, 2, 1))) as copy
    from keyed where code <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
        trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said from damaged
), judged as (
    select *, case when said = '' then 'blank'
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
            when right(said, 1) not in ('.', '!', '?') then 'truncated' end as fault,
        left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as last_initial
    from placed
), faults as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
        count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (last_initial || initial not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
), inserts(x, letters, said_roles, cost, y) as (
    values ('', '', [], 0, ''), ('', 'I', ['user'], 5, 'u'), ('', 'II', ['user', 'assistant'], 10, 'a'),
        ('s', '', [], 0, 's'), ('s', 'I', ['user'], 5, 'u'), ('s', 'II', ['user', 'assistant'], 10, 'a'),
        ('u', '', [], 0, 'u'), ('u', 'I', ['assistant'], 5, 'a'), ('a', '', [], 0, 'a'), ('a', 'I', ['user'], 5, 'u')
), follows(y, z, said_role) as (
    values ('', 's', null), ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')
), ops as (
    -- Every way to read a row: inserts before it, then keep, rerole or delete.
    select x, letters || 'K' as letters, said_roles, cost, z, z as initial, null as said_role, true as stays from inserts join follows using (y)
    union all
    select x, letters || 'R', said_roles, cost + 1, z, null, said_role, true from inserts join follows using (y) where said_role is not null
    union all
    select x, letters || 'D', said_roles, cost + 2, y, null, null, false from inserts
), walk as (
    select conv_id, 0::bigint as i, '' as state, 0 as cost, '' as audit, []::varchar[] as said from faults
    union all
    select w.conv_id, w.i + 1, o.z, w.cost + o.cost + if(o.stays and j.fault is not null, 5, 0) as cost, w.audit || o.letters as audit,
        w.said || list_transform(o.said_roles, lambda r: r || ':') || if(o.stays, [coalesce(o.said_role, j.role) || ':' || j.text], [])
    from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1 join ops o on o.x = w.state
    where (not o.stays or coalesce(j.fault, '') not in ('blank', 'duplicate')) and (o.initial is null or o.initial = j.initial)
    qualify row_number() over (partition by w.conv_id, o.z order by w.cost + o.cost + if(o.stays and j.fault is not null, 5, 0), w.audit || o.letters) = 1
), best as (
    select w.conv_id, w.cost + t.cost as cost, w.audit || t.letters as audit, w.said || list_transform(t.said_roles, lambda r: r || ':') as said
    from walk w join faults f on f.conv_id is not distinct from w.conv_id and f.n = w.i join inserts t on t.x = w.state and t.y in ('', 'a')
    qualify row_number() over (partition by w.conv_id order by w.cost + t.cost, w.audit || t.letters) = 1
)
select c.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate,
    coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal, coalesce(b.cost, 0)::bigint as cost,
    coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id
"""


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """The rows of conversations with a fifth or so of them spoiled, by a fixed rule."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    keyed = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), code.alias("code")).where("code <> 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))
    return keyed.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")
    ).drop("copy")


@_register("op12_conversation_repair", _REPAIR_SQL)
def _op12(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _table(spark, folder, "conversations")
    return repair.audited(damaged_conversations(conversations), conversations)


@_register(
    "op13_exact_dedup",
    r"""
    with plain as (
        select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents
    ), groups as (
        select text, min(doc_id) as keep_id, count(*) as group_size from plain group by text
    )
    select doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id is null) as kept, sha256(text) as text_sha256
    from plain join groups using (text)
    """,
)
def _op13(spark: SparkSession, folder: str) -> DataFrame:
    return copies.exact_duplicates(_table(spark, folder, "documents"))
