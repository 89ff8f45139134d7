"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, embed_dedup, exact_dedup, line_dedup, lm_score, manifest, mixing, packing, quality, simhash, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories() -> dict[str, Column]:
    """Toxicity categories of ``labels``: toxic, and both toxic and of low quality."""
    toxic = F.col("toxic") == 1
    return {"toxic": toxic, "toxic_junk": toxic & (F.col("quality") == 0)}


def domain() -> Column:
    """The domain of a source: its number modulo 4 (sources without a number form one of their own)."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4").cast("string"), F.lit("")))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), categories()))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, chat.TURN_SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_mix(table(spark, sf_dir, "documents"), mixing.Mix(), domain())


def op5_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("mean_log_score", 5).alias("log_score"), F.round("log_score", 4).alias("log_likelihood"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_toxicity_chain, op3_tool_call_linking, op4_hierarchical_mixing, op5_length_bucket_packing,
        op6_embedding_range_join, op7_quality_ftrl, op8_exact_dedup_tree, op9_line_window_dedup, op10_stupid_backoff,
        op11_phrase_collocations, op12_suffix_dedup, op13_merkle_manifest, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_tool_call_linking": r"""
with recursive t as (select conv_id, turn, role, text, length(text) as n, 'c' || conv_id || '.' || turn as own, 'c' || conv_id || '.' || (turn - 1) as before from conversations),
calls as (select conv_id, own as call_id, min(struct_pack(turn := turn, name := case role when 'user' then 'ask' when 'system' then 'configure' else role end, text := text, n := n)) as c, count(*) - 1 as more
  from t where role <> 'assistant' group by all),
results as (select conv_id, before as call_id, min(struct_pack(turn := turn, text := text)) as r, count(*) - 1 as more from t where role = 'assistant' group by all),
sizes as (select conv_id, count(*) as size from calls group by all),
edges as (select a.conv_id, a.call_id, b.call_id as needs from calls a join calls b on a.conv_id = b.conv_id
  and (b.c.turn = a.c.turn - 1 or (b.c.turn = a.c.turn - 2 and a.c.n % 3 <> 1) or (b.c.turn = a.c.turn + 2 and a.c.n % 3 = 0))),
walks(conv_id, call_id, place, level) as (select conv_id, call_id, c.turn, 0 from calls union
  select e.conv_id, e.call_id, w.place, w.level + 1 from walks w join edges e on e.conv_id = w.conv_id and e.needs = w.call_id join sizes s on s.conv_id = w.conv_id where w.level <= s.size),
placed as (select w.conv_id, w.call_id, max(level) > max(size) as cyclic, max(struct_pack(place := place, level := level)) as p from walks w join sizes s on s.conv_id = w.conv_id group by all),
b as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.c.turn, r.r.turn) as turn,
  case when c.c is null then 'orphan' when p.cyclic then 'cyclic' when r.r is null then 'pending' else 'linked' end as status, c.c.name as name, c.c.text as text, c.c.n as n, r.r.text as result,
  case when c.c is null then r.r.turn when p.cyclic then c.c.turn else p.p.place end as place, case when c.c is null or p.cyclic then 0 else p.p.level end as level,
  coalesce(c.more, 0) + coalesce(r.more, 0) as repeats
  from calls c join placed p on c.conv_id = p.conv_id and c.call_id = p.call_id full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id),
e as (select *, case when status = 'orphan' then 'no call' else concat_ws('; ', case when n = 0 then '$.text: shorter than 1' end, case when turn % 4 = 2 and n % 2 = 1 then '$.tone: not in enum' end,
  case when n % 5 = 0 then '$.words: not integer' end) end as errors, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::varchar as words from b)
select conv_id, call_id, turn, row_number() over (partition by conv_id order by place, level, turn, call_id) - 1 as position, status, errors = '' as valid, errors, repeats,
  case when status = 'orphan' then '{"call_id":' || to_json(call_id)::varchar || ',"result":' || to_json(result)::varchar || '}'
  else '{"arguments":{"text":' || to_json(text)::varchar || case when turn % 4 = 2 then ',"tone":"' || case when n % 2 = 0 then 'plain' else 'loud' end || '"' else '' end || ',"turn":' || turn
    || ',"words":' || case when n % 5 = 0 then '"' || words || '"' else words end || '},"call_id":' || to_json(call_id)::varchar || ',"name":' || to_json(name)::varchar
    || ',"result":' || coalesce(to_json(result)::varchar, 'null') || '}' end as json
from e""",
    "op4_hierarchical_mixing": r"""
with base as (select doc_id, 'd' || coalesce((try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4)::varchar, '') as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as t from base group by all),
root as (select floor(sum(t) * 500 / 1000)::hugeint as b from leaves),
d0 as (select domain, sum(t)::hugeint as t, sum(t)::hugeint * 4 as c from leaves group by all),
d1 as (select domain, c, b, b - coalesce(sum(c) over (order by c, domain rows between unbounded preceding and 1 preceding), 0) as l, count(*) over () - row_number() over (order by c, domain) + 1 as w from d0, root),
d2 as (select *, c * w <= l as f from d1),
d3 as (select *, b - sum(case when f then c else 0 end) over () as r, sum(case when f then 0 else 1 end) over () as k from d2),
d4 as (select *, sum(case when f then c else r // k end) over () as used, sum(case when f then 0 else 1 end) over (order by domain) as place, b as pb from d3),
d as (select domain, (case when f then c else r // k + case when place <= pb - used then 1 else 0 end end)::hugeint as b from d4),
l0 as (select domain, lang, sum(t)::hugeint as t, sum(t)::hugeint * 4 as c from leaves group by all),
l1 as (select domain, lang, c, b, b - coalesce(sum(c) over (partition by domain order by c, lang rows between unbounded preceding and 1 preceding), 0) as l,
  count(*) over (partition by domain) - row_number() over (partition by domain order by c, lang) + 1 as w from l0 join d using (domain)),
l2 as (select *, c * w <= l as f from l1),
l3 as (select *, b - sum(case when f then c else 0 end) over (partition by domain) as r, sum(case when f then 0 else 1 end) over (partition by domain) as k from l2),
l4 as (select *, sum(case when f then c else r // k end) over (partition by domain) as used, sum(case when f then 0 else 1 end) over (partition by domain order by lang) as place from l3),
l as (select domain, lang, (case when f then c else r // k + case when place <= b - used then 1 else 0 end end)::hugeint as b from l4),
s0 as (select domain, lang, source, t::hugeint as t, t::hugeint * 4 as c from leaves),
s1 as (select domain, lang, source, t, c, b, b - coalesce(sum(c) over (partition by domain, lang order by c, source rows between unbounded preceding and 1 preceding), 0) as l,
  count(*) over (partition by domain, lang) - row_number() over (partition by domain, lang order by c, source) + 1 as w from s0 join l using (domain, lang)),
s2 as (select *, c * w <= l as f from s1),
s3 as (select *, b - sum(case when f then c else 0 end) over (partition by domain, lang) as r, sum(case when f then 0 else 1 end) over (partition by domain, lang) as k from s2),
s4 as (select *, sum(case when f then c else r // k end) over (partition by domain, lang) as used, sum(case when f then 0 else 1 end) over (partition by domain, lang order by source) as place from s3),
s as (select domain, lang, source, t, (case when f then c else r // k + case when place <= b - used then 1 else 0 end end)::bigint as budget from s4),
e as (select base.*, budget, case when t > 0 then budget // t else 0 end as epochs, budget - case when t > 0 then (budget // t) * t else 0 end as rest from base join s using (domain, lang, source)),
o as (select *, md5('42:' || epochs::bigint || ':' || coalesce(doc_id::varchar, '')) as o from e),
x as (select *, sum(tokens) over (partition by domain, lang, source order by o range between unbounded preceding and current row) as run from o)
select doc_id, domain, lang, source, tokens, budget, least(epochs + case when run <= rest then 1 else 0 end, 4)::int as copies from x""",
    "op6_embedding_range_join": r"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v),
p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) >= 0.9),
r(vec_id, other) as (select vec_id, vec_id from n union select r.vec_id, p.b from r join p on r.other = p.a),
c as (select vec_id, min(other) as component_id from r group by vec_id)
select c.vec_id, (select count(*) from p where p.a = c.vec_id) as n_links, component_id, c.vec_id = component_id as kept from c""",
    "op8_exact_dedup_tree": r"""
with g as (select coalesce(text, '') as text, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(g.text) as text_sha256 from documents d join g on coalesce(d.text, '') = g.text""",
    "op9_line_window_dedup": r"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, unnest(range(0, len(l) - 2)) as pos, l from d where len(l) >= 3),
k as (select doc_id, pos, array_to_string(l[pos + 1 : pos + 3], chr(10)) as key from w),
f as (select key, min(struct_pack(doc_id := doc_id, pos := pos)) as first from k group by key having count(*) > 1),
c as (select k.doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) as gone from k join f using (key) where struct_pack(doc_id := k.doc_id, pos := k.pos) <> f.first group by all)
select d.doc_id, case when c.gone is null then text else coalesce(array_to_string(list_filter(l, lambda x, i: not list_contains(c.gone, i - 1)), chr(10)), '') end as text,
  len(l)::int as n_lines, coalesce(len(c.gone), 0)::int as n_removed from d left join c using (doc_id)""",
    "op10_stupid_backoff": r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
e as (select doc_id, unnest(l) as w, unnest(range(1, len(l) + 1)) as pos from d),
p as (select doc_id, pos, w, lag(w) over (partition by doc_id order by pos) as v from e),
u as (select w, count(*) as n from e group by w),
b as (select v, w, count(*) as n from p where v is not null group by all),
t as (select count(*) as n from e),
s as (select p.doc_id, case when p.v is null then ln(uw.n) - ln(t.n) when b.n >= 1 then ln(b.n) - ln(uv.n) else ln(0.4) + ln(uw.n) - ln(t.n) end as s
  from p join u uw on p.w = uw.w left join u uv on p.v = uv.w left join b on p.v = b.v and p.w = b.w cross join t)
select d.doc_id, len(l)::bigint as n_words, round(x.s / nullif(len(l), 0), 5) as log_score, round(coalesce(x.s, 0), 4) as log_likelihood from d left join (select doc_id, sum(s) as s from s group by doc_id) x using (doc_id)""",
    "op11_phrase_collocations": r"""
with t as (select coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as l from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(l) as piece from t)),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from p, (select unnest([1, 2, 3]) as k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as n from g group by all),
s as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10),
u as (select lang, phrase, a, unnest(range(1, k)) as cut, w from c),
x as (select u.lang, u.phrase, a, cut, l.n as l, r.n as r, (1000000::hugeint * a * a // (l.n::hugeint * r.n))::bigint as score from u
  join f l on u.lang = l.lang and l.phrase = array_to_string(w[1:cut], ' ') join f r on u.lang = r.lang and r.phrase = array_to_string(w[cut + 1 :], ' ')),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
d as (select distinct s.lang, s.phrase from c s join (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3) o
  on s.lang = o.lang and s.phrase = o.phrase and 100 * o.a >= 50 * s.a)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, s.n as n, score
from b join s on b.lang = s.lang anti join d on b.lang = d.lang and b.phrase = d.phrase qualify rank <= 2000""",
    "op12_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from d)),
f as (select k, min(doc_id) as first from w group by k having count(*) > 1),
g as (select distinct w.doc_id, p from w join f using (k) where w.doc_id > f.first),
o as (select *, sum(n) over (partition by doc_id order by p) as span from (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as n from g)),
s as (select doc_id, span, min(p) as b, max(p) + 50 as e from o group by all),
c as (select doc_id, count(*) as n_spans, sum(e - b)::bigint as n_removed, max(e) as rest, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' order by b) as head
  from (select s.*, h, coalesce(lag(e) over (partition by s.doc_id order by b), 0) as before from s join d using (doc_id)) group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when c.doc_id is null then h else head || substr(h, 2 * rest + 1) end)) as kept_sha256 from d left join c using (doc_id)""",
    "op13_merkle_manifest": r"""
with recursive c as (select *, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::ubigint[]), lambda x, _: xor(x // 2, case when x % 2 = 1 then 3988292384::ubigint else 0::ubigint end))) as crc from documents),
b as (select doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') as tail, case when xor(crc, 4294967295::ubigint) % 7 = 0 then 1 else 0 end as added from c),
m as (select doc_id, lang, sha256(head || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
  sha256(head || coalesce(length((n_chars + added)::varchar) || ':' || (n_chars + added), '-') || tail) as changed from b),
d as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by lang) as n from m),
t(lang, l, i, h, n) as (select lang, 0, r, leaf, n from d union all
  select lang, l + 1, i // 2, sha256(string_agg(h, '' order by i)), (max(n) + 1) // 2 from t where n > 1 group by lang, l, i // 2),
s as (select lang, h as subroot, l as height, row_number() over (order by encode(lang) nulls first) - 1 as place, count(*) over () as n from t where n = 1),
u(l, i, h, n) as (select 0, place, subroot, n from s union all select l + 1, i // 2, sha256(string_agg(h, '' order by i)), (max(n) + 1) // 2 from u where n > 1 group by l, i // 2),
w as (select h as root, l as height from u where n = 1),
k as (select d.*, subroot, s.height as low, place, root, w.height + s.height as high from d join s on d.lang is not distinct from s.lang cross join w),
x as (select k.doc_id, k.lang, k.r, t.l, t.h, t.i from k join t on k.lang is not distinct from t.lang and t.l < k.low and t.i = xor(k.r >> t.l, 1)
  union all select k.doc_id, k.lang, k.r, k.low + u.l, u.h, u.i from k join u on u.l < k.high - k.low and u.i = xor(k.place >> u.l, 1)),
p as (select lang, r, string_agg(h, '' order by l) as proof from x group by all),
f(lang, r, l, h) as (select lang, r, 0, changed from k union all
  select f.lang, f.r, f.l + 1, sha256(case when x.h is null then f.h when x.i % 2 = 1 then f.h || x.h else x.h || f.h end)
  from f join k on f.lang is not distinct from k.lang and f.r = k.r and f.l < k.high left join x on f.lang is not distinct from x.lang and f.r = x.r and f.l = x.l)
select k.doc_id, k.leaf, k.subroot, k.root, sha256(coalesce(p.proof, '')) as proof_sha256, f.h as folded_root, f.h = k.root as verified
from k left join p on k.lang is not distinct from p.lang and k.r = p.r join f on f.lang is not distinct from k.lang and f.r = k.r and f.l = k.high""",
}


def register() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return dict(QUERIES), dict(ORACLE_SQL)
