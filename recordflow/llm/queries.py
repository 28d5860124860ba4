"""One query for each operator of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, langid, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from .common import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.classes(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.withColumnRenamed("id", "doc_id")


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_ngram_join with the number of each document's links."""
    found = ngram_join.classes(_read(spark, sf_dir, "documents"), k=3, num=90, den=100, count=True)
    return found.withColumnRenamed("id", "doc_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_passage_words: words in passages of 50 words or more that repeat, of which some are shorter than 400 bytes."""
    return suffix_dedup.repeats(_read(spark, sf_dir, "documents"), length=400, words=50).drop("spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_read(spark, sf_dir, "documents"), shards=16)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    scored, name = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col(name).alias("score"), F.when(F.col(name) >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_read(spark, sf_dir, "documents"), keep="largest")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.by_document(_read(spark, sf_dir, "documents"), num=90, den=100)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found, (lang, score) = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "toxic")
    scored, name = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col(name).alias("score"), F.when(F.col(name) >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), size=1024, separator=0)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    marked, names = decontam.mark(docs, _read(spark, sf_dir, "benchmark"))
    out = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return marked.select("doc_id", *[F.col(n).alias(o) for n, o in zip(names, out, strict=True)])


QUERIES = {f.__name__: f for f in (op1_ngram_join, op1_ngram_links, op2_suffix_dedup, op3_sharding, op4_quality, op5_exact_dedup, op6_line_dedup, op7_langid, op8_toxicity, op9_packing, op10_decontam)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op5_exact_dedup": f"""
with d as (select doc_id, {_LOWERED} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d""",
    "op1_ngram_join": rf"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as a from documents),
 s as (select doc_id, case when len(a) = 0 then [] when len(a) < 3 then [array_to_string(a, ' ')]
   else list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) end as g from w),
 e as (select doc_id, len(g) as n, unnest(g) as g from s),
 p as (select a.doc_id as a, b.doc_id as b, a.n + b.n as total, count(*) as shared from e a join e b on a.g = b.g and a.doc_id < b.doc_id
   and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
 l as (select a, b from p where 100 * shared >= 90 * (total - shared)),
 both_ways as (select a, b from l union select b, a from l),
 r as (select doc_id as node, doc_id as seen from documents union select r.node, t.b from r join both_ways t on r.seen = t.a)
select s.doc_id, cast(len(g) as bigint) as n_shingles, min(r.seen) as component_id from s join r on s.doc_id = r.node group by s.doc_id, len(g)""",
    "op6_line_dedup": rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
 l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no from d),
 t as (select doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> ''))) as tok from l),
 s as (select tok, len(tok) as n, min((doc_id, line_no)) as place from t where len(tok) > 0 group by tok),
 e as (select place, n, unnest(tok) as x from s),
 f as (select x, count(*) as c from e group by x),
 p as (select place, x from (select place, n, e.x, row_number() over (partition by place order by c, e.x) as r from e join f on e.x = f.x) where r <= n - (9 * n + 9) // 10 + 1),
 q as (select distinct a.place as one, b.place as two from p a join p b on a.x = b.x and a.place < b.place),
 b as (select b.tok, min(a.place) as first from q join s a on q.one = a.place join s b on q.two = b.place where 190 * len(list_intersect(a.tok, b.tok)) >= 90 * (a.n + b.n) group by b.tok),
 r as (select t.doc_id, t.line_no, coalesce((t.doc_id, t.line_no) > s.place or (t.doc_id, t.line_no) > b.first, false) as removed from t left join s on t.tok = s.tok left join b on t.tok = b.tok)
select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed, coalesce(string_agg(cast(line_no as varchar), ',' order by line_no) filter (removed), '') as removed_lines from r group by doc_id""",
    "op10_decontam": rf"""
with d as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents), b as (select item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 k as (select item_id, least(len(w), 13) as m, unnest(case when len(w) = 0 then [] when len(w) < 13 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) end) as g from b),
 m as (select distinct m from k),
 g as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, w from d, m where len(w) >= m),
 h as (select doc_id, i, g.m, item_id from g join k on g.m = k.m and array_to_string(w[i:i + g.m - 1], ' ') = k.g),
 n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from h) group by doc_id),
 x as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join n on d.doc_id = n.doc_id left join x on d.doc_id = x.doc_id""",
}

# the same links, counted at both ends
ORACLE["op1_ngram_links"] = ORACLE["op1_ngram_join"].replace(
    "min(r.seen) as component_id from", "min(r.seen) as component_id, (select count(*) from both_ways t where t.a = s.doc_id) as n_links from"
)
