"""The registered queries over the star schema, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, codec, coerce, formatting, numeric
from ..functions import text as T
from ..operators import cut as C
from ..operators import edit as E
from ..operators import fields, folds, lookups, ordered
from .program import run_program

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""select word, count(*) as n from (select unnest(string_split_regex(text, '\s+')) as word from documents) where word <> '' group by word order by n desc, word limit 10""")
def word_frequency(t):
    words = t("documents").select(F.explode(fields.split(F.col("text"))).alias("word"))
    return folds.top(folds.count(words, "word"), 10, F.desc("n"), F.asc("word"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.03 and not (l_returnflag = 'N')")
def filter_expr(t):
    return t("lineitem").where((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03) & ~(F.col("l_returnflag") == "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_name from part where regexp_matches(p_type, '(STEEL|BRASS)$') or p_size = 7")
def blockless_match(t):
    return t("part").where(F.col("p_type").rlike("(STEEL|BRASS)$") | (F.col("p_size") == 7)).select("p_partkey", "p_name")


@query("select p_partkey, case when p_size > 25 then 'large' when p_size > 10 then 'medium' else 'small' end as class, p_retailprice > 1000 as dear from part")
def ternary_project(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", F.when(size > 25, "large").when(size > 10, "medium").otherwise("small").alias("class"), (F.col("p_retailprice") > 1000).alias("dear"))


@query("""with e as (select *, row_number() over (order by event_id) as nr from events),
 a as (select *, max(case when event_type = 'click' then nr end) over (order by nr) as on_at, max(case when event_type = 'purchase' then nr end) over (order by nr rows between unbounded preceding and 1 preceding) as off_at from e)
 select event_id, event_type from a where on_at > coalesce(off_at, 0)""")
def range_pattern(t):
    kind = F.col("event_type")
    return ordered.range_pattern(t("events"), kind == "click", kind == "purchase", ["event_id"]).select("event_id", "event_type")


@query("select event_id from (select event_id, row_number() over (order by event_id) as nr from events) where (nr // 10) % 4 = 1")
def block_cyclic_filter(t):
    return ordered.shard_filter(ordered.numbered(t("events"), ["event_id"]), "nr", 10, 4, 1).select("event_id")


@query("select event_id, user_id from events where event_id <= (select min(event_id) from events where value > 99)")
def exit_cutoff(t):
    return ordered.until(t("events"), F.col("value") > 99, ["event_id"]).select("event_id", "user_id")


@query("""with s as (select user_id, min(event_id) as stop from events where event_type = 'purchase' group by user_id)
 select event_id, e.user_id from events e left join s on e.user_id = s.user_id where stop is null or event_id <= stop""")
def nextfile_cutoff(t):
    return ordered.until(t("events"), F.col("event_type") == "purchase", ["event_id"], ["user_id"]).select("event_id", "user_id")


@query("select l_returnflag, count(*) as n from lineitem group by all")
def keyed_count(t):
    return folds.count(t("lineitem"), "l_returnflag")


@query("select l_suppkey, round(sum(l_quantity), 2) as qty from lineitem group by all")
def keyed_sum(t):
    return folds.fold(t("lineitem"), ["l_suppkey"], qty=F.round(F.sum("l_quantity"), 2))


@query("select o_custkey, min(o_totalprice) as low, max(o_totalprice) as high, arg_min(o_orderkey, o_orderkey) as first_order, arg_max(o_orderstatus, o_orderkey) as last_status from orders group by all")
def keyed_minmax(t):
    o = t("orders")
    return folds.fold(o, ["o_custkey"], low=F.min("o_totalprice"), high=F.max("o_totalprice"), first_order=F.min_by("o_orderkey", "o_orderkey"), last_status=F.max_by("o_orderstatus", "o_orderkey"))


@query("select o_orderpriority, round(avg(o_totalprice), 2) as mean, round(var_samp(o_totalprice) / 1e6, 2) as variance from orders group by all")
def keyed_avg(t):
    return folds.fold(t("orders"), ["o_orderpriority"], mean=F.round(F.avg("o_totalprice"), 2), variance=F.round(F.var_samp("o_totalprice") / 1e6, 2))


@query("select concat_ws(chr(28), l_returnflag, l_linestatus) as key, round(sum(l_extendedprice), 1) as total from lineitem group by all")
def composite_key_sum(t):
    return t("lineitem").groupBy(folds.composite("l_returnflag", "l_linestatus").alias("key")).agg(F.round(F.sum("l_extendedprice"), 1).alias("total"))


@query("""with m as (select l_returnflag, l_linestatus, count(*) as n from lineitem group by all)
 select l_returnflag, string_agg(l_linestatus || '=' || n, ',' order by l_linestatus) as m from m group by 1""")
def nested_map(t):
    m = folds.nested(t("lineitem"), "l_returnflag", "l_linestatus", F.count(F.lit(1)))
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("l_returnflag", F.array_join(pairs, ",").alias("m"))


@query("select count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue, max(l_shipdate) as last_ship from lineitem")
def global_fold(t):
    return folds.fold(t("lineitem"), [], n=F.count(F.lit(1)), revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0), last_ship=F.max("l_shipdate"))


@query("select l_suppkey, string_agg(cast(l_linenumber as varchar), '-' order by l_orderkey, l_linenumber, l_partkey) as joined from lineitem group by all")
def keyed_concat(t):
    return folds.joined(t("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_linenumber", "-")


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1")
def distinct_first(t):
    return folds.distinct_first(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("select l_returnflag, count(distinct l_partkey) as parts from lineitem group by all")
def count_distinct(t):
    return folds.fold(t("lineitem"), ["l_returnflag"], parts=F.countDistinct("l_partkey"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty from lineitem group by rollup(l_returnflag, l_linestatus)")
def rollup_sum(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)")
def cube_count(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, l_shipdate_year, count(*) as n from (select l_returnflag, year(l_shipdate) as l_shipdate_year from lineitem) group by grouping sets ((l_returnflag), (l_shipdate_year))")
def grouping_sets(t):
    df = t("lineitem").select("l_returnflag", F.year("l_shipdate").alias("l_shipdate_year"))
    return df.groupingSets([[F.col("l_returnflag")], [F.col("l_shipdate_year")]], "l_returnflag", "l_shipdate_year").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def lookup_inner(t):
    c = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    return lookups.lookup(t("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], ["o_custkey"], ["c_name"]).select("o_orderkey", "c_name")


@query("select c_custkey, last_order from customer left join (select o_custkey, max(o_orderkey) as last_order from orders group by 1) on o_custkey = c_custkey")
def lookup_left(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"))
    return lookups.lookup(t("customer").select("c_custkey"), o, ["c_custkey"], ["last_order"], ["last_order"], "left")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_in(t):
    o = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.semi(t("customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def anti_in(t):
    o = t("orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.anti(t("customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey < n_nationkey and s_acctbal > n_nationkey * 300")
def theta_nested(t):
    on = (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > F.col("n_nationkey") * 300)
    return lookups.theta(t("supplier"), t("nation"), on).select("s_suppkey", "n_nationkey")


@query("""select coalesce(a.nr, b.nr) as nr, n_name, s_name from (select row_number() over (order by n_nationkey) as nr, n_name from nation) a
 full join (select row_number() over (order by s_suppkey) as nr, s_name from supplier) b on a.nr = b.nr""")
def zip_join(t):
    return lookups.zip_rows(t("nation").select("n_nationkey", "n_name"), t("supplier").select("s_suppkey", "s_name"), ["n_nationkey"], ["s_suppkey"]).select("nr", "n_name", "s_name")


@query("select event_id, row_number() over (order by event_id) as nr, row_number() over (partition by event_type order by event_id) as fnr from events")
def row_numbers(t):
    return ordered.numbered(ordered.numbered(t("events"), ["event_id"], "fnr", ["event_type"]), ["event_id"]).select("event_id", "nr", "fnr")


@query("select event_id, lag(value) over (partition by user_id order by event_id) as prev from events")
def lag_prev(t):
    return ordered.lag(t("events"), "value", ["event_id"], "prev", ["user_id"]).select("event_id", "prev")


@query("select event_id, round(sum(value) over (order by event_id), 2) as total, max(user_id) over (order by event_id) as high from events")
def running_total(t):
    got = ordered.running(t("events"), ["event_id"], {"total": ("sum", F.col("value")), "high": ("max", F.col("user_id"))})
    return got.select("event_id", F.round("total", 2).alias("total"), "high")


@query("select event_id, round(avg(value) over (partition by event_type order by event_id rows between 4 preceding and current row), 4) as mean from events")
def moving_avg(t):
    return ordered.moving(t("events"), "value", ["event_id"], 5, "mean", ["event_type"]).select("event_id", F.round("mean", 4).alias("mean"))


@query("""with g as (select *, case when epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) <= 3600 then 0 else 1 end as opens from events)
 select event_id, cast(sum(opens) over (partition by user_id order by ts, event_id) as bigint) as session from g""")
def gap_sessions(t):
    return ordered.sessions(t("events"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600, ["ts", "event_id"], ["user_id"]).select("event_id", "session")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as at from orders")
def asort_values(t):
    return folds.rank_values(t("orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", "at")


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ' ' order by cast(o_orderkey as varchar)) as keys from orders group by all")
def asorti_keys(t):
    keys = F.sort_array(F.collect_list(F.col("o_orderkey").cast("string")))
    return t("orders").groupBy("o_custkey").agg(F.array_join(keys, " ").alias("keys"))


@query("select distinct cast(o_custkey as varchar) as o_custkey from orders")
def forin_order(t):
    return lookups.keys_in_order(t("orders"), "o_custkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k(t):
    return folds.top(t("orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("select event_id, value from events order by event_id desc limit 15")
def tail_n(t):
    return folds.tail(t("events").select("event_id", "value"), 15, ["event_id"])


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 25")
def offset_limit(t):
    return t("orders").select("o_orderkey").orderBy("o_orderkey").offset(25).limit(10)


@query("select c_nationkey as nation from customer union all select s_nationkey from supplier")
def union_all(t):
    return lookups.union_all(t("customer").select(F.col("c_nationkey").alias("nation")), t("supplier").select(F.col("s_nationkey").alias("nation")))


@query("select c_nationkey as nation from customer union select s_nationkey from supplier")
def union_distinct(t):
    return lookups.union_distinct(t("customer").select(F.col("c_nationkey").alias("nation")), t("supplier").select(F.col("s_nationkey").alias("nation")))


@query("select c_nationkey as nation from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)")
def intersect_in(t):
    s = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return lookups.intersect_keeping(s, t("customer").select(F.col("c_nationkey").alias("nation")))


@query("select c_nationkey as nation from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
def except_in(t):
    s = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return lookups.except_keeping(s, t("customer").select(F.col("c_nationkey").alias("nation")))


@query(r"""select p_partkey, len(list_filter(string_split_regex(p_type, '\s+'), lambda x: x <> '')) as blank, len(string_split(p_type, 'E')) as one, len(p_type) as each_char,
 len(string_split_regex(p_type, '[AEIOU]+')) as regex, coalesce(string_split(p_type, ' ')[2], '') as field2 from part""")
def split_modes(t):
    s = F.col("p_type")
    return t("part").select("p_partkey", F.size(fields.split(s)).cast("bigint").alias("blank"), F.size(fields.split(s, "E")).cast("bigint").alias("one"), F.size(fields.split(s, "")).cast("bigint").alias("each_char"), F.size(fields.split(s, "[AEIOU]+")).cast("bigint").alias("regex"), fields.field(fields.split(s), 2).alias("field2"))


@query("""select p_partkey, string_split(p_type, ' ')[1] || ':X:' || coalesce(string_split(p_type, ' ')[3], '') || '::new' as rebuilt, string_split(p_type, ' ')[1] || ':' || coalesce(string_split(p_type, ' ')[2], '') as cut
 from part""")
def field_assign(t):
    f = fields.split(F.col("p_type"))
    return t("part").select("p_partkey", fields.join(fields.assign(fields.assign(f, 2, F.lit("X")), 5, F.lit("new")), ":").alias("rebuilt"), fields.join(fields.resize(f, 2), ":").alias("cut"))


@query("select p_partkey, p_name[1:3] as a, p_name[4:] as b, '' as c, p_name[1:2] as d from part")
def substr_clamp(t):
    s = F.col("p_name")
    return t("part").select("p_partkey", T.substr(s, -1, 3).alias("a"), T.substr(s, 4).alias("b"), T.substr(s, 2, -1).alias("c"), T.substr(s, 0, 2).alias("d"))


@query("""select p_partkey, cast(instr(p_name, 'a') as int) as first_a, case when contains(p_name, 'a') then cast(len(p_name) - instr(reverse(p_name), 'a') + 1 as int) else 0 end as last_a,
 case when len(p_name) >= 5 and instr(p_name[5:], 'a') > 0 then cast(instr(p_name[5:], 'a') + 4 as int) else 0 end as from_5 from part""")
def index_rindex(t):
    s = F.col("p_name")
    return t("part").select("p_partkey", T.index(s, "a").alias("first_a"), T.rindex(s, "a").alias("last_a"), T.index(s, "a", 5).alias("from_5"))


@query(r"""select doc_id, case when regexp_matches(text, '[0-9]+') then len(regexp_extract(text, '(?s)^(.*?)[0-9]+', 1)) + 1 else 0 end as start,
 case when regexp_matches(text, '[0-9]+') then len(regexp_extract(text, '[0-9]+')) else -1 end as length, regexp_extract(text, '([a-z]+) ([a-z]+)', 2) as second from documents""")
def match_groups(t):
    s = F.col("text")
    m, g = T.match(s, "[0-9]+"), T.match(s, "([a-z]+) ([a-z]+)", 2)
    return t("documents").select("doc_id", m["start"].cast("bigint").alias("start"), m["length"].cast("bigint").alias("length"), g["groups"][2].alias("second"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[aeiou]+')) as n, md5(regexp_replace(text, '([aeiou]+)', '<\1>', 'g')) as digest from documents""")
def gsub_count(t):
    text, n = T.gsub(F.col("text"), "[aeiou]+", "<&>")
    return t("documents").select("doc_id", n.cast("bigint").alias("n"), F.md5(text).alias("digest"))


@query(r"""select p_partkey, regexp_replace(p_name, '^([^aeiou]*[aeiou][^aeiou]*)[aeiou]', '\1_') as second, regexp_replace(p_name, '[aeiou]', '_') as first from part""")
def gensub_nth(t):
    s = F.col("p_name")
    return t("part").select("p_partkey", T.gensub(s, "[aeiou]", "_", 2).alias("second"), T.gensub(s, "[aeiou]", "_", 0).alias("first"))


@query("""select c_custkey, cast(regexp_full_match(c_mktsegment, '[A-Za-z]+') as int) as alpha, cast(regexp_full_match(c_mktsegment, '[A-Z]+') as int) as upper, cast(regexp_full_match(c_name, '[0-9]+') as int) as digit,
 cast(regexp_full_match(right(c_name, 4), '[0-9A-Fa-f]+') as int) as xdigit from customer""")
def char_classes(t):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return t("customer").select("c_custkey", T.is_class(seg, "isalpha").alias("alpha"), T.is_class(seg, "isupper").alias("upper"), T.is_class(name, "isdigit").alias("digit"), T.is_class(F.right(name, F.lit(4)), "isxdigit").alias("xdigit"))


@query("select c_custkey, base64(encode(c_name)) as b64, lower(hex(encode(c_name))) as hex, c_name as back from customer")
def base64_hex(t):
    s = F.col("c_name")
    b = T.to_bytes(s)
    return t("customer").select("c_custkey", T.to_base64(b).alias("b64"), T.to_hex(b).alias("hex"), T.from_bytes(T.from_hex(T.to_hex(T.from_base64(T.to_base64(b))))).alias("back"))


@query(r"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as norm, md5(regexp_replace(text, '^\s+', '')) as left_trim from documents""")
def trim_norm(t):
    s = F.col("text")
    return t("documents").select("doc_id", F.md5(T.normspace(s)).alias("norm"), F.md5(T.ltrim(s)).alias("left_trim"))


@query("select c_custkey, upper(c_name) as up, lower(c_name) as low, ascii(c_mktsegment[2:2]) as code, len(c_name) as n from customer")
def case_codes(t):
    s = F.col("c_name")
    return t("customer").select("c_custkey", F.upper(s).alias("up"), F.lower(s).alias("low"), T.char_code(F.col("c_mktsegment"), 2).cast("int").alias("code"), T.length(s).cast("bigint").alias("n"))


@query("""select l_orderkey, l_linenumber, round(sin(l_quantity), 6) as s, round(exp(l_discount), 6) as e, round(ln(l_quantity), 6) as l, round(sqrt(l_extendedprice), 4) as r, round(atan2(l_tax, l_discount + 1), 6) as a,
 floor(l_extendedprice) as f, ceil(l_extendedprice) as c from lineitem""")
def math_funcs(t):
    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.sin(q), 6).alias("s"), F.round(F.exp(d), 6).alias("e"), F.round(numeric.log(q), 6).alias("l"), F.round(numeric.sqrt(p), 4).alias("r"), F.round(F.atan2(F.col("l_tax"), d + 1), 6).alias("a"), numeric.floor(p).alias("f"), numeric.ceil(p).alias("c"))


@query("select l_orderkey, l_linenumber, cast(trunc((l_partkey - 500.0) / l_linenumber) as bigint) as q, (l_partkey - 500) % 7 as m from lineitem")
def int_div_mod(t):
    p = F.col("l_partkey") - 500
    return t("lineitem").select("l_orderkey", "l_linenumber", coerce.int_divide(p, F.col("l_linenumber")).alias("q"), (p % 7).alias("m"))


@query("select p_partkey, cast(pow(p_size, 3) as double) as cube, cast(round(pow(p_retailprice, 0.5), 6) as double) as root from part")
def power(t):
    return t("part").select("p_partkey", coerce.power(F.col("p_size"), F.lit(3)).alias("cube"), F.round(coerce.power(F.col("p_retailprice"), F.lit(0.5)), 6).alias("root"))


@query("select l_orderkey, l_linenumber, l_partkey & 12 as a, l_partkey | 3 as o, xor(l_partkey, l_suppkey) as x, ~l_partkey as n, l_partkey << 2 as l, l_partkey >> 1 as r from lineitem")
def bitwise(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", numeric.bit_and(p, F.lit(12)).alias("a"), numeric.bit_or(p, F.lit(3)).alias("o"), numeric.bit_xor(p, s).alias("x"), numeric.bit_not(p).alias("n"), numeric.shift_left(p, 2).alias("l"), numeric.shift_right(p, 1).alias("r"))


@query("""select c_custkey, cast(regexp_extract(c_name, '([0-9]+)$', 1) as double) as plain, 31.0::double as hex, cast(c_custkey as double) + 0.5 as half, 0.0::double as none from customer where c_custkey % 8 < 8""")
def text_to_number(t):
    c = t("customer")
    digits = F.regexp_replace(F.regexp_extract("c_name", "([0-9]+)$", 1), "^0+(?=.)", "")
    return c.select("c_custkey", coerce.to_number(digits).alias("plain"), coerce.to_number(F.concat(F.lit("0x1F "), F.col("c_name"))).alias("hex"), coerce.to_number(F.concat(F.lit("  --"), F.col("c_custkey").cast("string"), F.lit(".5kg"))).alias("half"), coerce.to_number(F.lit("abc")).alias("none"))


@query("select l_orderkey, l_linenumber, case when cast(l_partkey as varchar) < cast(l_suppkey as varchar) then -1 when cast(l_partkey as varchar) > cast(l_suppkey as varchar) then 1 else 0 end as as_text, cast(sign(l_partkey - l_suppkey) as int) as as_number from lineitem")
def compare_modes(t):
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return t("lineitem").select("l_orderkey", "l_linenumber", coerce.compare(a, b, False).alias("as_text"), coerce.compare(a, b, True).alias("as_number"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S|%a %b %d|%j|%y/%p %I') as s from orders")
def strftime_utc(t):
    return t("orders").select("o_orderkey", clock.strftime("%F %T|%a %b %d|%j|%y/%p %I", F.unix_timestamp("o_orderdate")).alias("s"))


@query("select o_orderkey, cast(epoch(date_trunc('second', o_orderdate)) as bigint) as t, cast(epoch(date_trunc('month', o_orderdate) + interval 13 month + interval 40 day) as bigint) as carried from orders")
def mktime_utc(t):
    d = F.col("o_orderdate")
    parts = F.date_format(d, "yyyy MM dd HH mm ss")
    over = F.concat_ws(" ", F.year(d).cast("string"), (F.month(d) + 13).cast("string"), F.lit("41 0 0 0"))
    return t("orders").select("o_orderkey", clock.mktime(parts).alias("t"), clock.mktime(over).alias("carried"))


@query("select o_orderkey, printf('%d|%s|%.2f', o_orderkey, o_orderstatus, o_totalprice) as s from orders")
def sprintf_fmt(t):
    return t("orders").select("o_orderkey", formatting.sprintf("%d|%s|%.2f", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice"), kinds=["bigint", "string", "double"]).alias("s"))


@query("select o_orderkey, printf('%08d|%-4s|%x|%+.1e', o_orderkey, o_orderstatus, o_orderkey, o_totalprice) as s from orders")
def sprintf_general(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", formatting.sprintf("%08d|%-4s|%x|%+.1e", k, F.col("o_orderstatus"), k, F.col("o_totalprice"), kinds=["bigint", "string", "bigint", "double"]).alias("s"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_parse(t):
    return t("events").select("event_id", codec.parse_json(F.col("props"), "k bigint")["k"].alias("k"))


@query("""select c_custkey, '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' as js from customer""")
def json_stringify(t):
    return t("customer").select("c_custkey", codec.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("js"))


@query("select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
def json_paths(t):
    return t("events").select("event_id", F.explode(codec.json_paths(F.col("props"))).alias("e")).select("event_id", "e.path", "e.value")


@query("select o_orderkey, lower(hex(encode(o_orderstatus))) as status, o_orderkey as back from orders")
def pack_unpack(t):
    packed = codec.pack("<qc", F.col("o_orderkey"), F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", packed.alias("p")).select("o_orderkey", T.to_hex(F.substring("p", 9, 1)).alias("status"), codec.unpack("<q", F.col("p"), "back bigint")["back"].alias("back"))


_LINES = "with d as (select doc_id, string_split(text, chr(10)) as a from documents), l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as nr from d)"


def _lines(t) -> DataFrame:
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("nr"), "line")


@query(_LINES + r" select doc_id, nr, md5(regexp_replace(line, '([aeiou])', '(\1)', 'g')) as line from l")
def edit_subst(t):
    return E.edit(_lines(t), "s/[aeiou]/(&)/g", by=["doc_id"]).select("doc_id", "nr", F.md5("line").alias("line"))


@query(_LINES + " select doc_id, nr, md5(line) as line from l where not (nr >= 2 and (nr - 2) % 3 = 0) and not regexp_matches(line, '^[A-D]')")
def edit_delete_step(t):
    return E.edit(_lines(t), "2~3d;/^[A-D]/d", by=["doc_id"]).select("doc_id", "nr", F.md5("line").alias("line"))


@query(_LINES + " select doc_id, nr, md5(translate(line, 'abc', 'xyz')) as line from l")
def edit_translate(t):
    return E.edit(_lines(t), "y/abc/xyz/", by=["doc_id"]).select("doc_id", "nr", F.md5("line").alias("line"))


@query(_LINES + """, p as (select doc_id, (nr - 1) // 2 as pair, max(nr) as nr, string_agg(line, '+' order by nr) as line from l group by 1, 2) select doc_id, cast(nr as bigint) as nr, md5(line) as line from p""")
def edit_join_pairs(t):
    return E.edit(_lines(t), r"N;s/\n/+/", by=["doc_id"]).select("doc_id", "nr", F.md5("line").alias("line"))


@query(_LINES + """ select doc_id, cast(nr as bigint) as nr, md5(line) as line from l where nr % 4 in (2, 3)""")
def edit_range(t):
    return E.edit(_lines(t), "2~4,+1!d", by=["doc_id"]).select("doc_id", "nr", F.md5("line").alias("line"))


@query("select page_id, string_split(url, '/')[3] || '/' || string_split(url, '/')[4] as part from pages where len(string_split(url, '/')) > 3")
def cut_fields(t):
    p = t("pages").where(F.size(F.split("url", "/")) > 3)
    return C.cut_lines(p, "url", "d/,f3-4").select("page_id", F.col("url").alias("part"))


@query("select p_partkey, p_name[2:4] || p_name[1:1] as part from part")
def cut_chars(t):
    return t("part").select("p_partkey", C.cut(F.col("p_name"), "c2-4,c1").alias("part"))


@query("select page_id, string_split(url, '/')[4] || '-' || string_split(url, '/')[3] || '-' || string_split(url, '/')[2] as part from pages where len(string_split(url, '/')) > 3")
def cut_reversed(t):
    p = t("pages").where(F.size(F.split("url", "/")) > 3)
    return p.select("page_id", C.cut(F.col("url"), "d/-,f4-2").alias("part"))


@query("select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, any_value(o_orderdate) as o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey order by revenue desc, l_orderkey limit 10")
def join_aggregate_top(t):
    c, o, i = t("customer").where("c_mktsegment = 'BUILDING'"), t("orders"), t("lineitem")
    j = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return j.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.first("o_orderdate").alias("o_orderdate")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("select o_orderkey, rank() over (partition by o_orderpriority order by o_totalprice desc) as r, round(percent_rank() over (partition by o_orderpriority order by o_totalprice desc), 9) as p, dense_rank() over (partition by o_orderpriority order by o_orderstatus) as d, ntile(4) over (partition by o_orderpriority order by o_orderkey) as q from orders")
def ranks(t):
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (-F.col("o_totalprice")).alias("down"))
    o = ordered.ranked(o, ["down"], ["o_orderpriority"], rank="r", share="p")
    o = ordered.ranked(o, ["o_orderstatus"], ["o_orderpriority"], dense="d")
    o = ordered.ranked(o, ["o_orderkey"], ["o_orderpriority"], tiles=("q", 4))
    return o.select("o_orderkey", "r", F.round("p", 9).alias("p"), "d", "q")


def _records(df: DataFrame, nr: str, *columns: str) -> DataFrame:
    return df.select(F.col(nr).alias("nr"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("record"))


@query("select l_orderkey * 10 + l_linenumber as nr, l_returnflag || ':' || upper(substr(l_linestatus, 1, 1)) || ':' || 3 as line from lineitem where l_returnflag = 'R' and l_linestatus ~ '^[FO]'")
def program_rules(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_returnflag", "l_linestatus", F.lit("x").alias("x"))
    text = 'BEGIN { OFS = ":" } $1 == "R" && $2 ~ /^[FO]/ { print $1, toupper(substr($2, 1, 1)), NF }'
    return run_program(text, _records(df, "k", *df.columns[1:])).select("nr", "line")


@query("select l_returnflag || ' ' || count(*) || ' ' || cast(sum(l_quantity) as bigint) as line from lineitem where l_linenumber > 1 group by l_returnflag")
def program_fold(t):
    df = t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    text = "$2 + 0 > 1 { n[$1]++; q[$1] += $3 } END { for (f in n) print f, n[f], q[f] }"
    return run_program(text, _records(df, "k", "l_returnflag", "l_linenumber", "l_quantity")).select("line")


@query("select count(*) || '/' || sum(l_linenumber) as line from lineitem")
def program_totals(t):
    df = t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return run_program('BEGIN { OFS = "/" } { n++; s += $1 } END { print n, s }', _records(df, "k", "l_linenumber")).select("line")


@query("""with e as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as prev from events)
 select user_id, event_id as nr, prev || '>' || event_type as line from e where prev <> event_type""")
def program_sequential(t):
    df = t("events").select("user_id", F.col("event_id").alias("nr"), F.col("event_type").alias("record"))
    text = 'seen && p != $2 { print $1 "\\t" p ">" $2 } { p = $2; seen = 1 }'
    rows = df.select("user_id", "nr", F.concat_ws(" ", F.col("nr").cast("string"), "record").alias("record"))
    out = run_program(text, rows, by=["user_id"]).select("user_id", F.split("line", "\t").alias("p"))
    return out.select("user_id", F.get("p", F.lit(0)).cast("bigint").alias("nr"), F.get("p", F.lit(1)).alias("line"))
