"""Queries of corpus-wide scans, charsets and tunnels; the SQL beside each reads the same tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codepage, folds, paths
from ..operators import dictionary, scan, tunnel
from ..sources import tables
from .queries import LINES, doc_lines, query, table

#: All documents as one long file, in the order of documents and lines.
_ORDER = ["doc_id", "line_no"]


@query(rf"""with {LINES}, v as (select *, nullif(regexp_extract(line, '^([A-Za-z]+)', 1), '') as variable, lead(line) over (order by doc_id, line_no) as ahead from lines),
t as (select *, case when variable is not null and regexp_matches(line, '^[A-M]') then ahead end as told from v)
select doc_id, line_no, variable, last_value(told ignore nulls) over (partition by variable order by doc_id, line_no rows between unbounded preceding and 1 preceding) as learned from t""")
def learned_names_corpus(spark, d):
    """The first word of a line is a variable; lines from A to M define it by the line after them. All documents are one file."""
    rows = doc_lines(spark, d).withColumn("variable", F.nullif(F.regexp_extract("line", "^([A-Za-z]+)", 1), F.lit("")))
    return scan.learned_names(rows, "variable", F.regexp_like("line", F.lit("^[A-M]")), F.col("line"), _ORDER, keep=[*_ORDER, "variable"])


@query(rf"""with {LINES}, e as (select *, case when regexp_matches(line, '^[A-C]') then 1 when regexp_matches(line, '^[T-Z]') then 0 end as ev from lines)
select doc_id, line_no, coalesce(last_value(ev ignore nulls) over (order by doc_id, line_no), 0) = 1 as inside from e""")
def interval_fill_corpus(spark, d):
    said = lambda pattern: F.regexp_like("line", F.lit(pattern))
    marked = doc_lines(spark, d).select(*_ORDER, said("^[A-C]").alias("starts"), said("^[T-Z]").alias("ends"))
    rows = scan.filled_interval(marked, F.col("starts"), F.col("ends"), _ORDER)
    return rows.select("doc_id", "line_no", "inside")


@query(rf"""with {LINES}, m as (select *, regexp_matches(line, '^(T|$)') as hit from lines),
s as (select *, last_value(case when not hit then line end ignore nulls) over (order by doc_id, line_no rows between unbounded preceding and 1 preceding) as source from m)
select doc_id, line_no, case when hit then coalesce(source, line) else line end as text from s""")
def preline_copy_corpus(spark, d):
    rows = scan.copied_previous(doc_lines(spark, d), F.col("line"), F.regexp_like("line", F.lit("^(T|$)")), _ORDER)
    return rows.select("doc_id", "line_no", "text")


@query(f"with {LINES} select doc_id, line_no, row_number() over (order by doc_id, line_no) - 1 as pos from lines")
def line_positions(spark, d):
    return scan.positions(doc_lines(spark, d).select(*_ORDER), _ORDER)


#: Texts with two-byte characters, made from the given ones: five vowels become kana. All other characters beyond ASCII
#: (accents, for which cp932 has no code) stay.
_KANA = {"a": "あ", "e": "え", "i": "い", "o": "お", "u": "う"}
_KANA_FROM, _KANA_TO = "".join(_KANA), "".join(_KANA.values())
_CP932 = "case c when 'あ' then '82A0' when 'え' then '82A6' when 'い' then '82A2' when 'お' then '82A8' when 'う' then '82A4' else printf('%02X', ascii(c)) end"


def _kana(text: Column) -> Column:
    return F.translate(text, _KANA_FROM, _KANA_TO)


@query(f"""with d as (select doc_id, string_split(translate(text, '{_KANA_FROM}', '{_KANA_TO}'), '') as l from documents),
c as (select doc_id, unnest(l) as c, unnest(range(len(l))) as n from d),
f as (select c, row_number() over (order by min(struct_pack(d := doc_id, n := n))) - 1 as code from c where ascii(c) > 127 and c not in ('あ', 'え', 'い', 'お', 'う') group by 1),
b as (select code, c, code // 58 as lead, code % 58 as trail from f),
h as (select c, printf('%02X', (case when lead < 31 then 129 + lead else 193 + lead end)::int) || printf('%02X',
  list_filter(range(1, 64), lambda x: x not in (9, 10, 13, 32, 44))[trail + 1]::int) as hex from b),
m as (select map(list(c), list(hex)) as m from h)
select doc_id, array_to_string(list_transform(l, lambda c: coalesce(m.m[c], {_CP932})), '') as data, array_to_string(l, '') as back from d, m""")
def tunnel_round_trip(spark, d):
    """Characters that cp932 lacks get codes by first place; every text is sent through and read back."""
    docs = table(spark, d, "documents").select("doc_id", _kana(F.col("text")).alias("text"))
    numbered = tunnel.code_map(tunnel.tunnel_codes(docs, "text", ["doc_id"]))
    sent = docs.select("doc_id", tunnel.tunnel_encoded(F.col("text"), numbered).alias("sent"))
    return sent.select("doc_id", F.hex("sent").alias("data"), tunnel.tunnel_decoded(F.col("sent"), numbered).alias("back"))


@query(f"""with d as (select doc_id, string_split(translate(text, '{_KANA_FROM}', '{_KANA_TO}'), '') as l from documents),
c as (select doc_id, unnest(l) as c, unnest(range(len(l))) as n from d)
select c as char, row_number() over (order by min(struct_pack(d := doc_id, n := n))) - 1 as code from c where ascii(c) > 127 and c not in ('あ', 'え', 'い', 'お', 'う') group by 1""")
def tunnel_table(spark, d):
    """The code table itself, first seen over all documents."""
    docs = table(spark, d, "documents").select("doc_id", _kana(F.col("text")).alias("text"))
    return tunnel.tunnel_codes(docs, "text", ["doc_id"])


@query(rf"""with {LINES}, k as (select doc_id, line_no, translate(line, '{_KANA_FROM}', '{_KANA_TO}') as t from lines),
c as (select doc_id, line_no, unnest(string_split(t, '')) as c, unnest(range(length(t))) as n from k where length(t) > 0 and not regexp_matches(t, '[^ -~あえいおう]')),
h as (select doc_id, line_no, n, {_CP932} as x from c), s as (select *, sum(length(x) // 2) over (partition by doc_id, line_no order by n) as used from h),
g as (select doc_id, line_no, coalesce(string_agg(x, '' order by n) filter (used <= 24), '') as head, max(used)::int as total from s group by all)
select k.doc_id, k.line_no, case when regexp_matches(t, '[^ -~あえいおう]') then null else coalesce(head, '') || repeat('8140', ((24 - length(coalesce(head, '')) // 2) // 2)::int) || repeat('20', ((24 - length(coalesce(head, '')) // 2) % 2)::int) end as data,
  case when regexp_matches(t, '[^ -~あえいおう]') then null else 24 - coalesce(total, 0) end::int as diff from k left join g using (doc_id, line_no)""")
def fit_bytes_cp932(spark, d):
    """Every line in exactly 24 bytes of cp932, wide spaces as padding; null where a character has no code."""
    rows = doc_lines(spark, d).select(*_ORDER, codepage.fitted(_kana(F.col("line")), F.lit(24), "cp932", "　".encode("cp932")).alias("f"))
    return rows.select(*_ORDER, F.hex("f.data").alias("data"), "f.diff")


# ---- layers, folds and sorts -----------------------------------------------------------------------------------------

_LAYERS = f"{LINES}, y as (select doc_id, line_no, doc_id % 4 as layer, line as text, doc_id || '/' || line_no as value from lines where line <> '')"


@query(f"""with {_LAYERS}, o as (select *, row_number() over (partition by text order by layer desc, doc_id desc, line_no desc) as newest, row_number() over (partition by text order by layer, doc_id, line_no) as oldest from y where layer < 3)
select n.text, n.value, n.layer, f.layer as first_layer, f.doc_id, f.line_no from o n join o f using (text) where n.newest = 1 and f.oldest = 1""")
def append_layers(spark, d):
    """Three layers that contradict each other: the newest value of each line, and where the line stands first."""
    rows = doc_lines(spark, d).where("line <> ''").select("doc_id", "line_no", (F.col("doc_id") % 4).alias("layer"), F.col("line").alias("text"))
    rows = rows.withColumn("value", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line_no").cast("string")))
    found = dictionary.overlay(rows.where("layer < 3"), "value", "layer", _ORDER)
    return found.select("text", "value", "layer", F.col("first.layer").alias("first_layer"), "first.doc_id", "first.line_no")


@query(f"with {_LAYERS} select doc_id, line_no, text from y where layer = 3 and text not in (select text from y where layer < 3)")
def next_layer(spark, d):
    """What no layer has yet."""
    rows = doc_lines(spark, d).where("line <> ''").select("doc_id", "line_no", F.col("line").alias("text"))
    layer = F.col("doc_id") % 4
    return dictionary.unlayered(rows.where(layer == 3), rows.where(layer < 3)).select("doc_id", "line_no", "text")


@query(f"""with recursive {LINES}, f(doc_id, line_no, line, rounds) as (select doc_id, line_no, line, 0 from lines
  union all select doc_id, line_no, new, rounds + 1 from (select *, regexp_replace(regexp_replace(line, 'th([a-z])', '\\1h', 'g'), 'an', 'n', 'g') as new from f) where new <> line)
select doc_id, line_no, max_by(line, rounds) as line, max(rounds)::int as rounds from f group by doc_id, line_no""")
def replace_to_fixed_point(spark, d):
    """A letter moves before its h until no th is left before one, and an becomes n, as often as that changes anything."""
    return folds.fixed_point(doc_lines(spark, d).select("doc_id", "line_no", "line"), "line", [("th([a-z])", r"\1h"), ("an", "n")])


@query("""with p as (select doc_id, string_split(replace(text, 'e', chr(34)), chr(34)) as l from documents)
select doc_id, array_to_string(list_transform(l, lambda x, i: x || case when i = len(l) then '' when i % 2 = 1 then '“' else '”' end), '') as text from p""")
def paired_quotes(spark, d):
    """Every e is a quote here."""
    quoted = F.replace("text", F.lit("e"), F.lit('"'))
    return table(spark, d, "documents").select("doc_id", folds.paired_quotes(quoted).alias("text"))


@query(r"select doc_id, regexp_replace(replace(replace(text, 'th', '{'), ' of', '/of}'), '\{([^/{}]*)/[^{}]*\}', '\1', 'g') as text from documents")
def without_ruby(spark, d):
    ruby = F.replace(F.replace("text", F.lit("th"), F.lit("{")), F.lit(" of"), F.lit("/of}"))
    return table(spark, d, "documents").select("doc_id", folds.without_ruby(ruby).alias("text"))


@query(rf"""with {LINES}, k as (select doc_id, line_no, replace(replace(regexp_replace(translate(line, 'aeio', 'あえいお'), '[^ -~あえいお]', '', 'g'), ',', '、'), '.', '。') as t from lines),
w as (select *, list_transform(string_split(t, ''), lambda c: case when ascii(c) > 127 then 2 else 1 end) as l, case when t = '' then 0 else length(t) end as n from k),
r as (select *, list_transform(range(1, least(n, 21) + 1), lambda i: list_sum(l[1:i])) as used from w),
a as (select *, coalesce(list_max(list_filter(range(1, least(n, 21) + 1), lambda i: used[i] <= 20)), 0) as fits, coalesce(list_max(list_filter(range(1, least(n, 21) + 1), lambda i: used[i] <= 20 and substr(t, i, 1) in ('、', '。'))), 0) as brk from r),
c as (select doc_id, line_no, t, case when n > fits and brk > 0 then brk else fits end as cut from a)
select doc_id, line_no, [left(t, cut::bigint), substr(t, cut::bigint + 1)] as parts from c""")
def parts_for_slots(spark, d):
    """Every line in a slot of 20 bytes of cp932 and one for the rest, cut behind punctuation where there is some."""
    kana = F.regexp_replace(F.translate("line", "aeio", "あえいお"), "[^ -~あえいお]", "")
    marked = F.replace(F.replace(kana, F.lit(","), F.lit("、")), F.lit("."), F.lit("。"))
    return doc_lines(spark, d).select(*_ORDER, folds.parts_for_slots(marked, [20, 20]).alias("parts"))


@query(f"with {LINES}, w as (select distinct regexp_extract(line, '^[A-Za-z]+') as word from lines) select word, row_number() over (order by lower(word), word) - 1 as pos from w")
def collated_positions(spark, d):
    """First words in an order that doesn't see case (a collation of Spark's), bytes decide between equal ones."""
    words = doc_lines(spark, d).select(F.regexp_extract("line", "^[A-Za-z]+", 0).alias("word")).distinct()
    return scan.positions(words.withColumn("folded", F.collate("word", "UTF8_LCASE")), ["folded", "word"]).select("word", "pos")


@query("""select 'P' || (page_id % 50) || '_' || page_id || '.txt' as name, row_number() over (order by page_id % 50, page_id) - 1 as pos from pages""")
def natural_positions(spark, d):
    """File names in an order in which numbers count by value."""
    name = F.concat(F.lit("P"), (F.col("page_id") % 50).cast("string"), F.lit("_"), F.col("page_id").cast("string"), F.lit(".txt"))
    names = table(spark, d, "pages").select(name.alias("name")).withColumn("key", paths.natural_key(F.col("name")))
    return scan.positions(names, ["key"]).select("name", "pos")


@query(r"""with t as (select conv_id, turn, min(struct_pack(text := text, role := role)) as x from conversations group by all),
u as (select conv_id, turn, x.role as role, regexp_replace(x.text, '[^A-Za-z0-9]+', ' ', 'g') as text from t where regexp_matches(x.text, '[A-Za-z0-9]')),
n as (select *, row_number() over (partition by conv_id order by turn) - 1 as seq from u), r as (select conv_id, role, min(turn) as first from u group by all)
select conv_id, seq::int as seq, 'n' || first as name_id, 'm' || turn as mess_id, role as name, text as message from n join r using (conv_id, role)""")
def xml_dialogue(spark, d):
    """Each conversation as a file of text resources and log entries; a repeated resource and a repeated entry don't count."""
    t = dictionary.dedupe_first(table(spark, d, "conversations").select("conv_id", "turn", "text", "role"), ["conv_id", "turn"], ["text"])
    t = t.withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9]+", " ")).where(F.regexp_like("text", F.lit("[A-Za-z0-9]")))
    first = t.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    rows = t.join(first, ["conv_id", "role"])
    one = lambda no, text: F.concat(F.lit('<TextRes NO="'), no, F.lit('">'), text, F.lit("</TextRes>"))
    name_id, mess_id = F.concat(F.lit("n"), F.col("first").cast("string")), F.concat(F.lit("m"), F.col("turn").cast("string"))
    log = F.concat(F.lit('<Log NAME="'), name_id, F.lit('" MESS="'), mess_id, F.lit('"/>'))
    said = F.array_sort(F.collect_list(F.struct("turn", one(name_id, F.col("role")).alias("who"), one(mess_id, F.col("text")).alias("what"), log.alias("log"))))
    files = rows.groupBy("conv_id").agg(said.alias("said"))
    joined = lambda f: F.array_join(F.transform("said", f), "")
    body = F.concat(F.lit("<all>"), joined(lambda x: x["who"]), joined(lambda x: x["what"]), F.lit('<TextRes NO="m0">again</TextRes>'), joined(lambda x: x["log"]), joined(lambda x: x["log"]), F.lit("</all>"))
    found = tables.xml_dialogue(files.select("conv_id", body.alias("xml")), "conv_id")
    return found.where("name is not null").select("conv_id", "seq", "name_id", "mess_id", "name", "message")
