"""Queries that run each operator over the given tables, and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleProgram
from ..functions import charset, layout
from ..functions import text as tx
from ..operators import dictionary, flags, items, lookups, rules, sequences, splice, tools, tree
from ..sources import formats, tables
from ..sources.text import lines as split_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The lines of documents, for the SQL side.
LINES = "lines as (select doc_id, unnest(range(len(l)))::int as line_no, unnest(l) as line from (select doc_id, string_split_regex(text, '\\r\\n|\\n') as l from documents))"
FIRST_RULES = "00_skip=^[A-Z][a-z]*\\.$\n10_search=^([A-Z][a-z]+ [a-z]+)\n20_search=([a-z]+)\\.$\n"


# ---- scans and rules -------------------------------------------------------------------------------------------------


@query(f"with {LINES} select doc_id, line_no, line from lines")
def scan_lines(spark, d):
    return doc_lines(spark, d)


@query(r"""select case when len(regexp_extract_all(text, '\r\n')) >= len(regexp_extract_all(text, '\n')) - len(regexp_extract_all(text, '\r\n')) then 'crlf' else 'lf' end as newline,
count(*) as n_docs, sum(len(regexp_extract_all(text, '\n')))::bigint as n_newlines from documents group by 1""")
def newline_vote(spark, d):
    docs = table(spark, d, "documents").withColumn("nl", F.when(tx.newline_vote(F.col("text")) == "\r\n", "crlf").otherwise("lf"))
    return docs.groupBy(F.col("nl").alias("newline")).agg(F.count("*").alias("n_docs"), F.sum(F.regexp_count("text", F.lit("\n"))).cast("long").alias("n_newlines"))


@query(rf"""with {LINES} select doc_id, line_no, case when regexp_matches(line, '^[A-Z][a-z]*\.$') then 0 when regexp_matches(line, '^[A-Z][a-z]+ [a-z]+') then 1
when regexp_matches(line, '[a-z]+\.$') then 2 end as rule, case when regexp_matches(line, '^[A-Z][a-z]*\.$') then '' when regexp_matches(line, '^[A-Z][a-z]+ [a-z]+')
then regexp_extract(line, '^([A-Z][a-z]+ [a-z]+)', 1) else regexp_extract(line, '([a-z]+)\.$', 1) end as text from lines where regexp_matches(line, '^[A-Z][a-z]*\.$|^[A-Z][a-z]+ [a-z]+|[a-z]+\.$')""")
def rule_skip_search(spark, d):
    found = rules.first_match(doc_lines(spark, d), RuleProgram.parse(FIRST_RULES)).where("rule is not null")
    return found.select("doc_id", "line_no", "rule", F.array_join("texts", "\t").alias("text"))


@query(rf"""with {LINES}, c as (select doc_id, line_no, regexp_extract(line, '^([A-Z][a-z]+)', 1) as a, regexp_extract(line, '([a-z]+)\.$', 1) as b from lines)
select doc_id, line_no, case when a <> '' and not regexp_matches(a, '^(The|A)') then 0 else 1 end as rule, case when a <> '' and not regexp_matches(a, '^(The|A)') then a else b end as text
from c where (a <> '' and not regexp_matches(a, '^(The|A)')) or (b <> '' and not regexp_matches(b, '^(The|A)'))""")
def rule_fallthrough_postskip(spark, d):
    program = RuleProgram.parse("10_search=^([A-Z][a-z]+)\n20_search=([a-z]+)\\.$\npostSkip=^(The|A)")
    found = rules.first_match(doc_lines(spark, d), program).where("rule is not null")
    return found.select("doc_id", "line_no", "rule", F.array_join("texts", "\t").alias("text"))


@query(rf"""with {LINES}, m as (select doc_id, line_no, regexp_extract_all(line, '\b[A-Z][a-z]+') as l from lines), e as (select doc_id, line_no, unnest(l) as text, unnest(range(len(l)))::int as cap_no from m)
select doc_id, line_no, cap_no, text from e""")
def rule_multi_capture(spark, d):
    """Every capitalised word with its position, by the general matcher; positions are checked against the line itself."""
    found = rules.events(doc_lines(spark, d).withColumn("copy", F.col("line")), RuleProgram.parse("10_search=(?a:\\b)([A-Z][a-z]+)"))
    rows = found.select("doc_id", "line_no", "copy", F.posexplode("captures").alias("cap_no", "c"))
    return rows.select("doc_id", "line_no", "cap_no", F.expr("substring(copy, c.start + 1, c.end - c.start)").alias("text"))


@query("select conv_id, turn, role in ('user', 'system') as is_name, role as text from conversations")
def forced_names(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn"), F.col("role").alias("line"))
    program = RuleProgram.parse("10_search=^(.+)$")
    program = RuleProgram(program.rules, program.config.__class__(name_list=("user", "system")))
    found = rules.events(rows, program).select("conv_id", "turn", F.explode("captures").alias("c"))
    return found.select("conv_id", "turn", F.array_contains("c.keys", "name").alias("is_name"), F.col("c.text").alias("text"))


@query(rf"with {LINES} select doc_id, line_no, regexp_extract(line, '^(\S+)', 1) as text from lines where line_no >= 2 and regexp_matches(line, '^\S')")
def startline_filter(spark, d):
    found = rules.first_match(doc_lines(spark, d), RuleProgram.parse("10_search=^(\\S+)\nstartline=2")).where("rule is not null")
    return found.select("doc_id", "line_no", F.array_join("texts", "\t").alias("text"))


@query(rf"""with {LINES}, e as (select *, case when regexp_matches(line, '^[A-M]') then 1 when regexp_matches(line, '^[N-Z]') then 0 end as ev from lines)
select doc_id, line_no, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by line_no), 0) = 1 as inside from e""")
def interval_fill(spark, d):
    line = F.col("line")
    rows = flags.fill_interval(doc_lines(spark, d), F.regexp_like(line, F.lit("^[A-M]")), F.regexp_like(line, F.lit("^[N-Z]")), ["doc_id"], ["line_no"])
    return rows.select("doc_id", "line_no", "inside")


FLAG_RULES = "10_skip=^[A-Z][a-z]*\\.$\n20_search=^(?P<pre_name>T.*)$\n30_search=^(?P<unfinish>[A-M].*)$\n40_search=^(.+)$\nstructure=paragraph\n"


@query(rf"""with {LINES}, e as (select doc_id, line_no, line, case when regexp_matches(line, '^[A-Z][a-z]*\.$') then 'skip' when regexp_matches(line, '^T.*$') then 'pre' when regexp_matches(line, '^[A-M].*$') then 'un'
when line <> '' then 'plain' end as k from lines), n as (select *, lead(k) over (partition by doc_id order by line_no) as nk from e where k is not null)
select doc_id, line_no, line as text, coalesce(nk = 'pre', false) as is_name, k = 'un' and coalesce(nk <> 'skip', true) as unfinish from n where k <> 'skip'""")
def pre_flag_lead(spark, d):
    program = RuleProgram.parse(FLAG_RULES)
    found = flags.captures(rules.events(doc_lines(spark, d), program), program.config, ["doc_id"])
    return found.select("doc_id", "line_no", "text", F.array_contains("keys", "name").alias("is_name"), F.array_contains("keys", "unfinish").alias("unfinish"))


@query(rf"""with {LINES}, f as (select doc_id, line_no, line, length(line) < 20 as nm, length(line) > 200 as un from lines where line <> ''),
s as (select *, coalesce(lag(nm) over w, false) as pn, coalesce(lag(un) over w, false) as pu, lag(line_no) over w is null as first from f window w as (partition by doc_id order by line_no)),
i as (select *, sum(case when nm or first or (not pn and not pu) then 1 else 0 end) over (partition by doc_id order by line_no) - 1 as item from s)
select doc_id, item::bigint as item, max(case when nm then line end) as name, coalesce(string_agg(case when not nm then line end, '|' order by line_no), '') as message from i group by all""")
def paragraph_items(spark, d):
    rows = doc_lines(spark, d).where("line <> ''")
    return items.items(rows, F.length("line") < 20, F.length("line") > 200, ["doc_id"], ["line_no"], sep="|", text_col="line")


@query(r"""with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id, turn order by text) as rn from conversations),
u as (select conv_id, turn, role, unnest(l) as line, unnest(range(len(l))) as n from (select conv_id, turn, role, string_split_regex(text, '\r\n|\n') as l from t where rn = 1))
select conv_id, (dense_rank() over (partition by conv_id order by turn) - 1)::bigint as item, role as name, string_agg(line, chr(10) order by n) as message from u group by conv_id, turn, role""")
def conversation_items(spark, d):
    turns = table(spark, d, "conversations")
    turns = dictionary.dedupe_first(turns.select("conv_id", "turn", "text", "role"), ["conv_id", "turn"], ["text"])
    names = turns.select("conv_id", "turn", F.lit(-1).alias("n"), F.col("role").alias("text"), F.lit(True).alias("is_name"))
    texts = split_lines(turns.select("conv_id", "turn", "text")).select("conv_id", "turn", F.col("line_no").alias("n"), F.col("line").alias("text"), F.lit(False).alias("is_name"))
    return items.items(names.unionByName(texts), F.col("is_name"), ~F.col("is_name"), ["conv_id"], ["turn", "n"], sep="\n")


@query(r"""with t as (select conv_id, turn, role, min(text) as text from conversations group by all), r as (select conv_id, turn, min(struct_pack(text := text, role := role)) as x from t group by all)
select conv_id, turn as item, lead(x.role) over (partition by conv_id order by turn) as name, x.text as message from r""")
def name_move_up(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("item"), "text", "role")
    rows = dictionary.dedupe_first(turns, ["conv_id", "item"], ["text"]).select("conv_id", "item", F.col("role").alias("name"), F.col("text").alias("message"))
    return items.move_names_up(rows, ["conv_id"])


# ---- dictionaries and joins ------------------------------------------------------------------------------------------


@query(f"with {LINES} select line as text, min(struct_pack(doc_id := doc_id, line_no := line_no)).doc_id as doc_id, min(struct_pack(doc_id := doc_id, line_no := line_no)).line_no as line_no from lines where line <> '' group by 1")
def dict_first_seen(spark, d):
    return dictionary.first_seen(doc_lines(spark, d).where("line <> ''"), "line", ["doc_id", "line_no"]).select("text", "first.*")


@query(r"""with p as (select conv_id, turn, 0 as part, role as text from conversations union all select conv_id, turn, 1, text from conversations where text <> '')
select text, min(struct_pack(conv_id := conv_id, turn := turn, part := part)).conv_id as conv_id, min(struct_pack(conv_id := conv_id, turn := turn, part := part)).turn as turn,
min(struct_pack(conv_id := conv_id, turn := turn, part := part)).part as part from p group by 1""")
def dict_rn(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("message"))
    return dictionary.names_and_messages(turns, ["conv_id", "turn"]).select("text", "first.*")


@query("select role, count(*) as n, count(distinct conv_id) as n_convs from conversations group by 1")
def dict_counts_distinct_names(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


def _line_dictionary(spark, d) -> DataFrame:
    first = dictionary.first_seen(doc_lines(spark, d).where("line <> ''"), "line", ["doc_id", "line_no"])
    return first.select("text", F.when(F.length("text") % 2 == 0, F.reverse(F.left("text", F.lit(5)))).otherwise("").alias("trans"))


_DICT = f"with {LINES}, t as (select distinct line as text, case when length(line) % 2 = 0 then reverse(left(line, 5)) else '' end as trans from lines where line <> '')"


@query(f"{_DICT} select text, to_json(text)::varchar || ': ' || to_json(trans)::varchar as member from t")
def format00(spark, d):
    return _line_dictionary(spark, d).select("text", formats.dictionary_member(0, F.col("text"), F.col("trans")).alias("member"))


@query(f"{_DICT} select text, to_json(text)::varchar || ': ' || to_json(case when trans = '' then text else trans end)::varchar as member from t")
def format01(spark, d):
    return _line_dictionary(spark, d).select("text", formats.dictionary_member(1, F.col("text"), F.col("trans")).alias("member"))


def _turn_items(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    first = dictionary.dedupe_first(t, ["conv_id", "turn"], ["text"])
    return first.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("name"), F.col("text").alias("message"))


_ITEMS = "with r as (select conv_id, turn, min(struct_pack(text := text, role := role)) as x from conversations group by all), i as (select conv_id, turn, case when x.role <> 'system' then x.role end as name, x.text as message from r)"


def _item_lines(fmt: int):
    def run(spark, d):
        made = formats.item_lines(fmt, F.col("name"), F.col("message"), F.col("turn") + 1)
        return _turn_items(spark, d).select("conv_id", "turn", F.array_join(made, "\n").alias("lines"))

    run.__name__ = f"format{fmt:02d}"
    return run


_J = lambda c: f"to_json({c})::varchar"
query(f"{_ITEMS} select conv_id, turn, '{{' || coalesce('\"name\":' || {_J('name')} || ',', '') || '\"message\":' || {_J('message')} || '}}' as lines from i")(_item_lines(2))
query(f"{_ITEMS} select conv_id, turn, coalesce(name || chr(10), '') || message as lines from i")(_item_lines(6))
query(f"{_ITEMS} select conv_id, turn, coalesce({_J('name')} || chr(10), '') || {_J('message')} as lines from i")(_item_lines(7))
query(f"{_ITEMS} select conv_id, turn, '☆' || lpad((turn + 1)::varchar, 6, '0') || '☆' || coalesce(name || '☆', '') || message || chr(10) || '★' || lpad((turn + 1)::varchar, 6, '0') || '★' || coalesce(name || '★', '') || message || chr(10) as lines from i")(_item_lines(9))
query(f"{_ITEMS} select conv_id, turn, '{{' || coalesce(case when name <> message then {_J('name')} || ':' || {_J('name')} || ',' end, '') || {_J('message')} || ':' || {_J('message')} || '}}' as lines from i")(_item_lines(10))
query(f"{_ITEMS} select conv_id, turn, coalesce('{{' || {_J('name')} || ':' || {_J('name')} || '}}' || chr(10), '') || '{{' || {_J('message')} || ':' || {_J('message')} || '}}' as lines from i")(_item_lines(11))


@query(f"{_ITEMS}, p as (select name as text from i where name is not null union select message from i where message <> '' or name is null) select text, {_J('text')} || ': \"\"' as member from p")
def format03(spark, d):
    made = dictionary.names_and_messages(_turn_items(spark, d), ["conv_id", "turn"])
    return made.select("text", formats.dictionary_member(3, F.col("text"), F.lit("")).alias("member"))


@query(f"{_ITEMS}, p as (select name as text from i where name is not null union select message from i where message <> '' or name is null) select text, {_J('text')} || ': ' || {_J('text')} as member from p")
def format04(spark, d):
    made = dictionary.names_and_messages(_turn_items(spark, d), ["conv_id", "turn"])
    return made.select("text", formats.dictionary_member(4, F.col("text"), F.lit("")).alias("member"))


@query(f"with {LINES}, f as (select line, min(struct_pack(d := doc_id, l := line_no)) as first from lines where line <> '' group by 1) select first.d as doc_id, string_agg(line, chr(10) order by first) || chr(10) as document from f group by 1")
def format05(spark, d):
    first = dictionary.first_seen(doc_lines(spark, d).where("line <> ''"), "line", ["doc_id", "line_no"]).select("text", "first.*")
    return formats.document(first, F.array("text"), ["line_no"], ["doc_id"], 5)


@query(r"select text as key, reverse(left(text, 20)) as value from benchmark union all select 'Key', 'Value'")
def format08_file(spark, d):
    """Format 8 as a workbook's bytes, read back; the header is its first row."""
    rows = table(spark, d, "benchmark").select("text", F.reverse(F.left("text", F.lit(20))).alias("trans"))
    book = tables.sheets(spark.createDataFrame([("a", bytearray(formats.workbook_of(formats.xlsx_rows(8, rows))))], "file string, data binary"))
    return book.select(F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("value"))


@query(f"""with {LINES}, o as (select doc_id, line_no, line as text, row_number() over (partition by line order by doc_id desc, line_no desc) as r from lines where line <> ''),
t as (select text, ['t1', 't2', ''] as trans from (select distinct line as text from lines where length(line) between 1 and 40))
select o.doc_id, o.line_no, o.text, case when trans[greatest(3 - r + 1, 1)] <> '' then trans[greatest(3 - r + 1, 1)] else o.text end as translated from o left join t using (text)""")
def trans_occurrence_join(spark, d):
    rows = doc_lines(spark, d).where("line <> ''").withColumnRenamed("line", "text")
    known = rows.where(F.length("text").between(1, 40)).select("text").distinct().withColumn("trans", F.array(F.lit("t1"), F.lit("t2"), F.lit("")))
    return dictionary.occurrence_join(rows, known, ["doc_id", "line_no"], most=3).select("doc_id", "line_no", "text", "translated")


@query("with a as (select row_number() over (order by item_id) - 1 as pos, text from benchmark) select pos, text as left, reverse(text) as right from a")
def positional_zip(spark, d):
    left = table(spark, d, "benchmark").select("item_id", "text")
    right = left.select((F.col("item_id") * 2).alias("k"), F.reverse("text").alias("text"))
    return dictionary.positional_zip(left, right, ["item_id"], ["k"], "text", "text")


@query(f"with {LINES} select distinct line as text from lines l where doc_id % 2 = 1 and line <> '' and not exists (select 1 from lines o where o.doc_id % 2 = 0 and o.line = l.line)")
def append_new_lines(spark, d):
    rows = doc_lines(spark, d).where("line <> ''").withColumnRenamed("line", "text")
    return dictionary.append_lines(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")).select("text").distinct()


@query("select distinct conv_id, turn, role as name, text as message from conversations c where conv_id % 2 = 1 and (role not in (select role from conversations where conv_id % 2 = 0) or text not in (select text from conversations where conv_id % 2 = 0))")
def append_items(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("message"))
    old = t.where("conv_id % 2 = 0").select(F.explode(F.array("name", "message")).alias("text"))
    return dictionary.append_items(t.where("conv_id % 2 = 1"), old, F.array("name", "message"))


@query("select conv_id, turn, case role when 'user' then 'U' when 'assistant' then 'A' else role end as role, count(*) as n from conversations group by all")
def name_replace(spark, d):
    names = spark.sql("select * from values ('user', 'U'), ('assistant', 'A') as t(old, new)")
    rows = dictionary.replace_names(table(spark, d, "conversations").select("conv_id", "turn", "role"), names, "role")
    return rows.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))


@query("select doc_id, translate(text, ' ' || list_aggregate(list_transform(range(33, 127), lambda x: chr(x::int)), 'string_agg', ''), chr(12288) || list_aggregate(list_transform(range(33, 127), lambda x: chr((x + 65248)::int)), 'string_agg', '')) as text from documents")
def full_width(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.to_full_width(F.col("text")).alias("text"))


@query("select event_id, list_sort(list_transform([10, 20, 40, 80], lambda v: struct_pack(d := abs(v - (event_id % 100)), v := v)))[1].v as nearest from events")
def nearest_key(spark, d):
    values = F.array(*[F.lit(v) for v in (10, 20, 40, 80)])
    return table(spark, d, "events").select("event_id", lookups.nearest_value((F.col("event_id") % 100).cast("int"), values).alias("nearest"))


@query("""with k as (select user_id, event_id, event_type from events where event_type = 'purchase')
select event_id, (select min(k.event_id) from k where k.user_id = e.user_id and k.event_id >= e.event_id) as found_key from events e""")
def asof_forward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    keys = e.where("event_type = 'purchase'")
    return lookups.asof_forward(e.select("event_id", "user_id"), keys, "event_id", "event_type", ["user_id"]).select("event_id", "found_key")


@query("select l_orderkey, l_linenumber, case when l_quantity::int between 1 and 10 then 'small' when l_quantity::int between 5 and 30 then 'middle' when l_quantity::int between 31 and 45 then 'large' end as band from lineitem")
def range_version_lookup(spark, d):
    bands = [(1, 10, "small"), (5, 30, "middle"), (31, 45, "large")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lookups.range_lookup(F.col("l_quantity").cast("int"), bands).alias("band"))


@query(f"""with {LINES}, o as (select doc_id, line_no, coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from lines)
select doc_id, line_no, "offset", lead("offset") over (partition by doc_id order by line_no) as next_offset from o""")
def next_offset_length(spark, d):
    return lookups.running_offsets(doc_lines(spark, d), F.octet_length("line") + 1, ["doc_id"], ["line_no"]).select("doc_id", "line_no", "offset", "next_offset")


@query("select o_custkey, o_orderkey as addr, o_orderkey + coalesce((select sum(p.o_orderkey % 7) from orders p where p.o_custkey = o.o_custkey and p.o_orderkey % 3 = 0 and p.o_orderkey + 1 < o.o_orderkey), 0)::bigint as shifted from orders o")
def address_shift(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("addr"))
    points = o.where("addr % 3 = 0").select("o_custkey", (F.col("addr") + F.lit(1)).alias("point"), (F.col("addr") % 7).alias("diff"))
    return lookups.shift_addresses(o, points, ["o_custkey"]).select("o_custkey", "addr", F.col("shifted").cast("long").alias("shifted"))


@query("with r as (select role, turn, max_by(text, struct_pack(c := conv_id, t := text)) as text from conversations group by all) select role, turn, text from r")
def merge_dict_last_wins(spark, d):
    t = table(spark, d, "conversations").withColumn("key", F.struct("role", "turn"))
    return tools.merge_dictionaries(t, "key", "text", ["conv_id", "text"]).select("key.role", "key.turn", "text")


@query("select row_number() over (order by conv_id, turn, role, text) - 1 as pos, conv_id, turn, role from conversations")
def merge_list(spark, d):
    return tools.merge_lists(table(spark, d, "conversations"), ["conv_id", "turn", "role", "text"]).select("pos", "conv_id", "turn", "role")


@query("with p as (select row_number() over (order by item_id) - 1 as pos, item_id from benchmark) select item_id, pos // 7 as part, least(pos // greatest((select count(*) from p) // 3, 1), 2) as equal_part from p")
def split_chunks_n(spark, d):
    rows = dictionary.with_position(table(spark, d, "benchmark").select("item_id"), ["item_id"])
    parts = tools.split_equal(rows, 3, rows.count()).withColumnRenamed("part", "equal_part")
    return tools.split_every(parts, 7).select("item_id", "part", "equal_part")


@query("""with s as (select conv_id, count(*) as entries from conversations group by 1), f as (select conv_id as file, coalesce(sum(entries) over (order by conv_id rows between unbounded preceding and 1 preceding), 0) as a, sum(entries) over (order by conv_id) as b from s),
p as (select row_number() over (order by conv_id, turn, role, text) - 1 as pos, conv_id, turn, role from conversations) select pos, conv_id, turn, role, file from p join f on pos >= a and pos < b""")
def split_by_manifest(spark, d):
    t = table(spark, d, "conversations")
    rows = dictionary.with_position(t, ["conv_id", "turn", "role", "text"]).select("pos", "conv_id", "turn", "role")
    sizes = tools.manifest(t, "conv_id").withColumnRenamed("conv_id", "file")
    return tools.split_by_manifest(rows, sizes, "file", "file")


@query("select text as key, max_by(item_id, item_id) as value from benchmark where not regexp_matches(text, '^T') group by 1")
def create_dictionary(spark, d):
    b = table(spark, d, "benchmark")
    return tools.make_dictionary(b, "text", "item_id", ["item_id"], skip="^T").select(F.col("text").alias("key"), F.col("item_id").alias("value"))


# ---- tables and trees ------------------------------------------------------------------------------------------------


@query("select p_partkey, 'p_name' as col, p_name as text from part union all select p_partkey, 'p_brand', p_brand from part union all select p_partkey, 'p_type', p_type from part")
def csv_unpivot(spark, d):
    part = table(spark, d, "part")
    chosen = [c for c, _ in tree.header_columns(part.columns, "^p_(name|brand|type)$")]
    return tree.unpivot(part, ["p_partkey"], chosen)


@query("select c_custkey, c_name, coalesce(case when c_mktsegment = 'BUILDING' then lower(c_name) end, c_name) as c_name_1 from customer")
def csv_write_offset(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name")
    value = F.when(F.col("c_mktsegment") == "BUILDING", F.lower("c_name"))
    return splice.write_shifted(c, ["c_name"], 1, {"c_name": value}).select("c_custkey", "c_name", "c_name_1")


@query("select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events")
def json_kv(spark, d):
    rows = table(spark, d, "events").select("event_id", F.explode(tree.json_entries(F.col("props"))).alias("e"))
    return rows.select("event_id", "e.key", "e.value")


@query("""with e as (select event_id, event_type, json_object('name', event_type, 'code', event_id % 3, 'parameters', [event_type || event_id, '', 'x']) as j from events)
select event_id, 0 as leaf_no, 'name' as path, (event_id % 3)::bigint as code, event_type as text from e union all select event_id, 1, 'parameters/0', event_id % 3, event_type || event_id from e
union all select event_id, 2, 'parameters/2', event_id % 3, 'x' from e""")
def json_tree_leaves(spark, d):
    e = table(spark, d, "events")
    js = F.to_json(F.struct(F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("code"), F.array(F.concat("event_type", F.col("event_id").cast("string")), F.lit(""), F.lit("x")).alias("parameters")))
    rows = tree.leaves(e.select("event_id", js.alias("j")), "j")
    return rows.select("event_id", "leaf_no", F.array_join("path", "/").alias("path"), "code", "text")


_CODES = "values (0, 'click', true, false), (1, 'view', true, true), (2, 'purchase', false, true), (3, 'signup', true, true)"


@query(f"""with c(code, label, extract, breaks) as ({_CODES}), e as (select event_id, user_id, c.* from events join c on event_type = label where extract)
select user_id, event_id, label, (sum(case when breaks then 1 else 0 end) over (partition by user_id order by event_id))::bigint as paragraph from e""")
def event_code_break(spark, d):
    codes = spark.sql(f"select * from {_CODES} as t(code, label, extract, breaks)")
    e = table(spark, d, "events").join(F.broadcast(codes.select(F.col("label").alias("event_type"), "code")), "event_type")
    rows = tree.with_codes(e.select("event_id", "user_id", "code"), codes)
    running = F.sum(F.col("breaks").cast("long")).over(flags.Window.partitionBy("user_id").orderBy("event_id"))
    return rows.select("user_id", "event_id", "label", running.alias("paragraph"))


@query("select page_id, '<' || rpad(left(url, 12), 7, ' ') || '>' || url as tagged, case when length(url) > 4 then substr(url, 5) else '' end as untagged from pages")
def tag_prefix(spark, d):
    """Keys longer than the tag are cut; untagging cuts as wide as tagging, whatever the text is."""
    made = tree.tag(F.left("url", F.lit(12)), F.col("url"))
    return table(spark, d, "pages").select("page_id", made.alias("tagged"), tree.untag(F.concat(F.lit("<key"), F.lit("    >"), F.substring("url", 5, 1 << 20))).alias("untagged"))


# ---- neighbourhoods --------------------------------------------------------------------------------------------------


@query(f"with {LINES} select doc_id, line_no, coalesce(regexp_matches(lag(line) over w, '\\.$'), false) and coalesce(regexp_matches(lead(line) over w, '^[A-Z]'), false) as valid from lines window w as (partition by doc_id order by line_no)")
def context_validate(spark, d):
    valid = lookups.context_valid(F.col("line"), {-1: "\\.$", 1: "^[A-Z]"}, ["doc_id"], ["line_no"])
    return doc_lines(spark, d).select("doc_id", "line_no", valid.alias("valid"))


@query(f"""with {LINES} select doc_id, line_no, case when length(line) < 30 then coalesce(last_value(case when length(line) >= 30 then line end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), line) else line end as line from lines""")
def preline_copy(spark, d):
    copied = lookups.copy_previous(F.col("line"), F.length("line") < 30, ["doc_id"], ["line_no"])
    return doc_lines(spark, d).select("doc_id", "line_no", copied.alias("line"))


@query(r"with p as (select page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') as l from pages) select page_id, unnest(range(len(l)))::int as n, unnest(l) as part from p")
def bracket_depth1(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(tx.bracket_parts(F.col("html"))).alias("n", "part"))


@query(r"""select doc_id, regexp_matches(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]') as japanese, (2 * len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')) + len(regexp_extract_all(text, '[\x{3000}-\x{303F}\x{FF01}-\x{FF60}]')))::int as score,
len(regexp_extract_all(text, 'tion'))::int as n_tion, (len(regexp_extract_all(text, '[「『]')) - len(regexp_extract_all(text, '[」』]')))::int as balance from documents""")
def text_predicate_score(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.has_japanese(t).alias("japanese"), tx.jp_score(t).alias("score"), tx.occurrences(t, "tion").alias("n_tion"), tx.bracket_balance(t).alias("balance"))


@query("select source, lang, count(*) as n, sum(length(text))::bigint as chars from documents group by all")
def group_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""with {LINES}, w as (select doc_id, line_no, unnest(l) as token, unnest(range(len(l))) as n from (select doc_id, line_no, string_split(line, ' ') as l from lines))
select token, count(*) as n from w where token <> '' group by 1 order by count(*) desc, min(struct_pack(d := doc_id, l := line_no, n := n)) limit 20""")
def topk_tokens(spark, d):
    words = doc_lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("n_", "token")).where("token <> ''")
    return tools.top_k(words, "token", 20, ["doc_id", "line_no", "n_"])


@query("select role, count(*) as n, count(*) filter (where length(text) > 500) as too_long, count(*) filter (where text = '') as empty, count(*) filter (where regexp_matches(text, '[^\\x00-\\x7F]')) as not_ascii from conversations group by 1")
def reason_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(F.length(t) > 500).alias("too_long"), F.count_if(t == "").alias("empty"), F.count_if(F.regexp_like(t, F.lit("[^\\x00-\\x7F]"))).alias("not_ascii")
    )


@query("""with e as (select user_id, event_id, value, event_type, case event_type when 'purchase' then 'page' when 'signup' then 'name' when 'view' then 'text' else 'call' end as k from events),
x as (select *, last_value(case when k = 'name' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as speaker,
first_value(case when k not in ('text', 'name') then k end ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as ends,
coalesce(sum(case when k = 'page' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as p from e)
select user_id, event_id, speaker, dense_rank() over (partition by user_id order by p) - 1 as page from x where k = 'text' and ends = 'page'""")
def carry_speaker_pages(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "purchase", "page").when(F.col("event_type") == "signup", "name").when(F.col("event_type") == "view", "text").otherwise("call")
    rows = lookups.carry_pages(e, kind, F.col("event_id"), ["user_id"], ["event_id"])
    return rows.select("user_id", "event_id", "speaker", F.col("page").cast("long").alias("page"))


@query("""with e as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as run from events)
select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id, run order by event_id rows between 19 preceding and 1 preceding) as found from e""")
def lookback_name(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return lookups.look_back(value, F.col("event_type") == "purchase", ["user_id"], ["event_id"], e).select("user_id", "event_id", "found")


@query("select l.doc_id, case when r.doc_id is null then 'missing' else 'diff' end as state from documents l left join (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as text from documents where doc_id % 3 > 0) r using (doc_id) where r.doc_id is null or r.text <> l.text")
def dir_compare(spark, d):
    left = table(spark, d, "documents").select("doc_id", "text")
    right = left.where("doc_id % 3 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return lookups.compare_sides(left, right, "doc_id", "text")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select conv_id from conversations)")
def unreferenced_ids(spark, d):
    return lookups.unreferenced(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), key="doc_id")


@query("with f as (select conv_id, min_by(role, struct_pack(t := turn, r := role)) as first_value from conversations group by 1) select c.conv_id, turn, role, first_value from conversations c join f using (conv_id) where role <> first_value")
def first_write_conflicts(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return dictionary.conflicts(t, ["conv_id"], "role", ["turn", "role"])


@query("with c as (select custkey as addr, custkey % 50 as chr_id from (select c_custkey as custkey from customer)), n as (select n_nationkey as chr_id, n_name as name from nation) select o_orderkey, o_custkey as addr, coalesce(n.name, 'chr_' || c.chr_id) as speaker from orders left join c on o_custkey = addr left join n using (chr_id)")
def speaker_two_hop(spark, d):
    functions = table(spark, d, "customer").select(F.col("c_custkey").alias("addr"), (F.col("c_custkey") % 50).alias("chr_id"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("chr_id"), F.col("n_name").alias("name"))
    calls = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("addr"))
    return lookups.two_hop(calls, functions, names).select("o_orderkey", "addr", "speaker")


@query("select doc_id, case when lang = 'en' then 0 when lang = 'de' then 1 else 999999 end as sort_key from documents")
def custom_order(spark, d):
    order = spark.sql("select * from values ('en', 0), ('de', 1) as t(lang, ord)")
    return lookups.custom_order(table(spark, d, "documents").select("doc_id", "lang"), order, "lang").select("doc_id", "sort_key")


@query("select d.doc_id, coalesce(case when toxic = 1 then '' end, text) as text from documents d left join labels l on d.doc_id = l.doc_id")
def update_by_id(spark, d):
    updates = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("").alias("text"))
    return lookups.update_by_id(table(spark, d, "documents").select("doc_id", "text"), updates, "doc_id", "text")


# ---- text functions --------------------------------------------------------------------------------------------------


@query(r"""with l as (select doc_id, case doc_id % 4 when 0 then '○' || doc_id || '|a\nb' when 1 then '◆s|' || doc_id || '|t' when 2 then '●i|s|' || doc_id || '|u|v' else 'x' end as line from documents)
select doc_id, case doc_id % 4 when 0 then 'plain' when 1 then 'shown' when 2 then 'named' end as kind, case when doc_id % 4 < 3 then doc_id::varchar end as idx, case doc_id % 4 when 0 then 'a' || chr(10) || 'b' when 1 then 't' when 2 then 'u|v' end as text from l""")
def tagged_line_parse(spark, d):
    i = F.col("doc_id")
    s = i.cast("string")
    line = F.when(i % 4 == 0, F.concat(F.lit("○"), s, F.lit("|a\\nb"))).when(i % 4 == 1, F.concat(F.lit("◆s|"), s, F.lit("|t"))).when(i % 4 == 2, F.concat(F.lit("●i|s|"), s, F.lit("|u|v"))).otherwise("x")
    return table(spark, d, "documents").select("doc_id", tx.tagged_line(line).alias("t")).select("doc_id", "t.kind", "t.idx", "t.text")


@query("select page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(url, ''), 'none') as text from pages")
def first_nonempty(spark, d):
    return table(spark, d, "pages").select("page_id", tx.first_nonempty(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url"), F.lit("none")).alias("text"))


@query("""with m as (select doc_id, unnest(l) as token, unnest(range(len(l))) as n from (select doc_id, regexp_extract_all(text, '[0-9]+') as l from documents)),
f as (select token, row_number() over (order by min(struct_pack(d := doc_id, n := n))) - 1 as number from m group by 1) select token, number, case when number < 9 then chr((10112 + number)::int) else token end as symbol from f""")
def placeholder_map(spark, d):
    """Distinct placeholders numbered as first seen; the first few get symbols. One number for each distinct token."""
    found = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("n", "token"))
    first = dictionary.first_seen(found, "token", ["doc_id", "n"]).select("text", F.col("first.doc_id").alias("doc_id"), F.col("first.n").alias("n"))
    ranked = dictionary.with_position(first, ["doc_id", "n"], "number")
    symbol = F.when(F.col("number") < 9, F.get(F.array(*[F.lit(chr(10112 + i)) for i in range(9)]), F.col("number").cast("int"))).otherwise(F.col("text"))
    return ranked.select(F.col("text").alias("token"), "number", symbol.alias("symbol"))


@query("select doc_id, regexp_replace(replace(replace(text, 'the ', 'THE '), 'of', '0F'), '([a-z])tion', '\\1T', 'g') as text, case when lang = 'en' then 'English' else lang end as lang from documents")
def replace_chain(spark, d):
    text = tx.regex_chain(tx.replace_chain(F.col("text"), {"the ": "THE ", "of": "0F"}), {"([a-z])tion": r"\1T"})
    return table(spark, d, "documents").select("doc_id", text.alias("text"), tx.replace_whole(F.col("lang"), {"en": "English"}).alias("lang"))


@query("""with p as (select d.doc_id, string_split(d.text, chr(10)) as o, string_split_regex(b.text, ' |\n') as t from documents d join benchmark b on d.doc_id % 40 = b.item_id)
select doc_id, len(o)::int as n_orig, list_aggregate(list_transform(o, lambda x, i: case when i > len(t) then '　' when i = len(o) and len(t) > len(o) then list_aggregate(t[i:], 'string_agg', '') else t[i] end), 'string_agg', '|') as lines from p""")
def split_zip_lines(spark, d):
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40)
    b = table(spark, d, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("trans"))
    made = tx.split_zip(F.col("text"), F.col("trans"), sep="\n")
    return docs.join(b, "item_id").select("doc_id", F.size(made).alias("n_orig"), F.array_join(made, "|").alias("lines"))


@query("select item_id, list_aggregate(list_transform(range(0, length(text), 20), lambda i: substr(text, (i + 1)::bigint, 20)), 'string_agg', '/') as text from benchmark")
def hard_wrap(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.hard_wrap(F.col("text"), 20, "/").alias("text"))


@query(r"select doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 300) as long_lines from documents")
def over_length(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.over_length(F.split("text", "\n", -1), 300).alias("long_lines"))


@query(rf"""with {LINES}, p as (select doc_id, line_no, list_transform(regexp_extract_all(line, '[A-Z][a-z]+|[^A-Z]+|[A-Z]'), lambda x: case when regexp_matches(x, '^[A-Z][a-z]+') then reverse(x) else x end) as l from lines)
select doc_id, string_agg(coalesce(array_to_string(l, ''), ''), chr(10) order by line_no) as text from p group by 1""")
def splice_changed(spark, d):
    """Every capitalised word turned round where it was found; spans move to their text, lines don't."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    found = rules.events(split_lines(docs), RuleProgram.parse("10_search=([A-Z][a-z]+)")).select("doc_id", "line_no", F.explode("captures").alias("c"))
    spans = found.select("doc_id", "line_no", "c.start", "c.end", F.reverse("c.text").alias("translated"))
    return splice.splice_texts(docs, spans, "doc_id")


@query(rf"""with {LINES}, p as (select doc_id, line_no, list_transform(regexp_extract_all(line, '[A-Z][a-z]+|[^A-Z]+|[A-Z]'), lambda x: case when regexp_matches(x, '^[A-Z][a-z]+') then reverse(x) else x end) as l from lines)
select doc_id, string_agg(coalesce(array_to_string(l, ''), ''), chr(10) order by line_no) as text from p group by 1""")
def splice_lines(spark, d):
    """The same over lines that stay relations: spans joined to lines, lines joined to files."""
    rows = doc_lines(spark, d)
    found = rules.events(rows, RuleProgram.parse("10_search=([A-Z][a-z]+)")).select("doc_id", "line_no", F.explode("captures").alias("c"))
    spans = found.select("doc_id", "line_no", "c.start", "c.end", F.reverse("c.text").alias("translated"))
    return splice.rebuild_files(splice.splice(rows, spans, ["doc_id", "line_no"]), "doc_id", "line_no", "line")


@query("with c as (select lang, unnest(string_split(text, '')) as ch from documents) select lang, ch, count(*) as n from c where ch <> '' group by all")
def char_repertoire(spark, d):
    """Counted inside each text first, so the shuffle sees one row for each distinct character of a task."""
    chars = table(spark, d, "documents").select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("lang", "ch").agg(F.count("*").alias("n"))


@query("select text, min(doc_id) as doc_id, count(*) - 1 as n_skipped from documents group by 1")
def dedupe_first(spark, d):
    return dictionary.dedupe_first(table(spark, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("select item_id, left(text, list_max(list_filter(range(0, 41), lambda i: strlen(left(text, i)) <= 40))) as cut, strlen(text)::int as n_bytes from benchmark")
def cutoff_utf8(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", tx.cut_utf8(t, 40).alias("cut"), F.octet_length(t).alias("n_bytes"))


# ---- order-dependent functions ---------------------------------------------------------------------------------------


@query(r"select item_id, case when not regexp_matches(text, '[^\x00-\xFF]') then list_transform(range(0, length(text), 32), lambda i: substr(text, (i + 1)::bigint, 32)) end as lines from benchmark")
def wrap_bytes(spark, d):
    return table(spark, d, "benchmark").select("item_id", layout.wrap_bytes(F.col("text"), 32, "latin-1").alias("lines"))


@query()
def redistribute(spark, d):
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40)
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("trans"))
    from ..config import ExtractConfig

    config = ExtractConfig(para_sep="\n", symbols="[.,]")
    return docs.join(b, "item_id").select("doc_id", layout.redistribute(F.col("text"), F.col("trans"), config).alias("lines"))


#: Lines of 40 characters for as many lines as the original has, the rest in the last; the whole translation for one line.
FIXED_LINES = """l as (select doc_id, case when n = 1 then [t] else list_transform(range(0, n), lambda i: coalesce(nullif(case when i < n - 1 then substr(t, (i * 40 + 1)::bigint, 40) else substr(t, (i * 40 + 1)::bigint) end, ''), '　')) end as lines
from (select d.doc_id, len(string_split(d.text, chr(10))) as n, replace(b.text, chr(10), '') as t from documents d join benchmark b on d.doc_id % 40 = b.item_id))"""


@query(f"with {FIXED_LINES} select doc_id, lines from l")
def redistribute_fixed(spark, d):
    """Pieces of a fixed width for the lines of the original, the rest in the last."""
    docs = table(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 40)
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("trans"))
    from ..config import ExtractConfig

    config = ExtractConfig(para_sep="\n", fixed_max_per_line=True, max_per_line=40)
    return docs.join(b, "item_id").select("doc_id", layout.redistribute(F.col("text"), F.col("trans"), config).alias("lines"))


@query("""with c as (select item_id, text, left(text, list_max(list_filter(range(0, 65), lambda i: strlen(left(text, i)) <= 64))) as cut from benchmark)
select item_id, hex(encode(cut)) || repeat('20', (64 - strlen(cut))::int) as data, (64 - strlen(text))::int as diff from c""")
def fit_bytes(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", charset.fitted(t, F.lit(64), "utf-8").alias("f")).select("item_id", F.hex("f.data").alias("data"), "f.diff")


@query("select item_id, array_to_string(list_transform(range(0, strlen(text)), lambda i: printf('%02X', xor(('0x' || substr(hex(encode(text)), (2 * i + 1)::bigint, 2))::int, [90, 165, 15][i % 3 + 1]))), '') as data from benchmark")
def xor_bytes(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.hex(charset.xor(F.encode("text", "utf-8"), b"\x5a\xa5\x0f")).alias("data"))


def _bracketed(spark, d) -> DataFrame:
    t = dictionary.dedupe_first(table(spark, d, "conversations").select("conv_id", "turn", "text", "role"), ["conv_id", "turn"], ["text"])
    return t.withColumn("text", F.concat(F.when(F.col("turn") % 3 == 0, "「").otherwise(""), "text", F.when(F.col("turn") % 3 == 2, "」").otherwise("")))


@query("""with recursive t as (select conv_id, turn, min(struct_pack(text := text, role := role)) as x from conversations group by all),
b as (select conv_id, turn, x.role as name, case when turn % 3 = 0 then '「' else '' end || x.text || case when turn % 3 = 2 then '」' else '' end as text, row_number() over (partition by conv_id order by turn) as rn from t),
c as (select *, len(regexp_extract_all(text, '[「『]')) - len(regexp_extract_all(text, '[」』]')) as bal from b),
s as (select a.conv_id, a.rn, z.rn as upto, sum(m.bal) as open from c a join c z on z.conv_id = a.conv_id and z.rn between a.rn and a.rn + 8 + 1 join c m on m.conv_id = a.conv_id and m.rn between a.rn and z.rn group by all),
e as (select conv_id, rn, least(coalesce(min(upto) filter (where open <= 0), 1000000), rn + 9, (select max(rn) from c where c.conv_id = s.conv_id)) as upto from s group by conv_id, rn),
g(conv_id, rn) as (select distinct conv_id, 1::bigint from c union all select g.conv_id, e.upto + 1 from g join e on e.conv_id = g.conv_id and e.rn = g.rn where exists (select 1 from c where c.conv_id = g.conv_id and c.rn = e.upto + 1))
select g.conv_id as file, f.turn as first, (e.upto - g.rn + 1)::int as n_parts, f.name, (select string_agg(text, '' order by rn) from c where c.conv_id = g.conv_id and c.rn between g.rn and e.upto) as message
from g join e on e.conv_id = g.conv_id and e.rn = g.rn join c f on f.conv_id = g.conv_id and f.rn = g.rn""")
def balance_merge(spark, d):
    return sequences.merge_unclosed(_bracketed(spark, d), "conv_id", "turn", "role", "text")


_MARKED = "case when line_no % 7 = 1 then '「' when line_no % 11 = 4 then '（' else '' end || line || case when line_no % 7 = 3 then '」' when line_no % 11 = 4 then '）' else '' end"


@query(f"""with recursive {LINES}, t as (select doc_id, line_no, case when (line_no // 5) % 2 = 0 then 'a' else 'b' end as speaker, {_MARKED} as line from lines),
n as (select *, regexp_matches(line, '[」）)]') as closes, left(line, 1) in ('「', '（', '(') as opens, case left(line, 1) when '「' then contains(line, '」') when '（' then contains(line, '）') when '(' then contains(line, ')') else false end as whole from t),
e as (select a.doc_id, a.line_no, case when a.whole then a.line_no
  when a.opens and not a.closes then least(coalesce((select min(z.line_no) from n z where z.doc_id = a.doc_id and z.line_no > a.line_no and z.closes), 1000000), coalesce((select min(z.line_no) - 1 from n z where z.doc_id = a.doc_id and z.line_no > a.line_no and z.speaker <> a.speaker), 1000000), (select max(z.line_no) from n z where z.doc_id = a.doc_id))
  else least(a.line_no + 2, coalesce((select min(z.line_no) - 1 from n z where z.doc_id = a.doc_id and z.line_no > a.line_no and (z.speaker <> a.speaker or z.opens)), 1000000), (select max(z.line_no) from n z where z.doc_id = a.doc_id)) end as upto from n a),
g(doc_id, line_no) as (select distinct doc_id, 0 from n union all select g.doc_id, (e.upto + 1)::int from g join e on e.doc_id = g.doc_id and e.line_no = g.line_no join n on n.doc_id = g.doc_id and n.line_no = e.upto + 1)
select g.doc_id as file, g.line_no as first, (e.upto - g.line_no + 1)::int as n_parts, f.speaker as name, (select string_agg(line, chr(13) || chr(10) order by line_no) from n where n.doc_id = g.doc_id and n.line_no between g.line_no and e.upto) as message
from g join e on e.doc_id = g.doc_id and e.line_no = g.line_no join n f on f.doc_id = g.doc_id and f.line_no = g.line_no""")
def speaker_merge3(spark, d):
    """Two speakers in turn, with brackets that close in their line, later, or never."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = F.col("line_no")
    opened = F.when(n % 7 == 1, "「").when(n % 11 == 4, "（").otherwise("")
    closed = F.when(n % 7 == 3, "」").when(n % 11 == 4, "）").otherwise("")
    rows = split_lines(docs).withColumn("line", F.concat(opened, "line", closed)).withColumn("speaker", F.when(F.floor(n / 5) % 2 == 0, "a").otherwise("b"))
    return sequences.merge_speaker_lines(rows, "doc_id", "line_no", "speaker", "line")


@query("""with t as (select conv_id, turn, min(struct_pack(text := text, role := role)) as x from conversations group by all)
select conv_id as file, turn as seq, case when turn % 4 = 1 or turn % 8 = 2 then x.role else upper(x.role) end as name, case when turn % 4 = 1 then x.text else lower(x.text) end as message,
case when turn % 4 = 1 then 'new_item' when turn % 8 = 2 then 'new_name' end as fix from t""")
def align_fix_missing(spark, d):
    """Old translations, without every fourth item and without some names, carried over."""
    t = dictionary.dedupe_first(table(spark, d, "conversations").select("conv_id", "turn", "text", "role"), ["conv_id", "turn"], ["text"])
    t = t.select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("message"))
    old = t.where("turn % 4 <> 1").withColumn("name", F.when(F.col("turn") % 8 != 2, F.col("name"))).withColumns({"trans_name": F.upper("name"), "trans": F.lower("message")})
    return sequences.align_inserts(t, old, "conv_id", "turn")


from . import scan_queries, script_queries  # noqa: E402, F401  (register their queries)
