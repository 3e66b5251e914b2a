"""The registered queries of this subpackage, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquire.llm.common import table
from webquire.llm.covering_simhash import near_duplicates
from webquire.llm.dom_boosting import main_text
from webquire.llm.factorization import held_out, toxicity
from webquire.llm.impact_search import top_products
from webquire.llm.line_templates import drop_recurring_lines
from webquire.llm.mixing import mix
from webquire.llm.periodic_runs import periodic_runs, repeated_tail, strongest
from webquire.llm.quality_cascade import quality_cascade
from webquire.llm.source_divergence import source_divergence
from webquire.llm.template_decontam import contaminated
from webquire.llm.token_attribution import section_tokens
from webquire.llm.token_shards import write_shards
from webquire.llm.warc_chunks import record_table, warc_round_trip

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    return f


@query
def op1_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return quality_cascade(table(spark, sf, "documents")).drop("rejected_by", "n_rules_run")


LLM_ORACLES["op1_quality_cascade"] = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
u as (select doc_id, unnest(range(len(w))) as i, unnest(w) as x from w),
t as (select *, lead(x, 1) over (partition by doc_id order by i) as y, lead(x, 2) over (partition by doc_id order by i) as z from u),
c as (select doc_id, i, count(*) over (partition by doc_id, x, y, z) as n from t where z is not null),
r as (select doc_id, count(distinct i + k) as n_repeat_words from c, range(3) three(k) where n > 1 group by doc_id),
m as (select doc_id, max(n) as most from (select doc_id, x, count(*) as n from u group by all) group by doc_id),
l as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(most, 0) as most,
         len(regexp_extract_all(text, '\p{Lu}')) as upper_letters, len(regexp_extract_all(text, '\p{L}')) as letters, len(regexp_extract_all(text, '!')) as marks
  from w left join l on w.doc_id = l.doc_id left join r on w.doc_id = r.doc_id left join m on w.doc_id = m.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 2 * word_chars < 5 * n_words or 2 * word_chars > 24 * n_words
            or 2 * n_dup_lines > n_lines or 2 * upper_letters > word_chars or 2 * marks > n_words or 2 * letters < word_chars or 2 * most > n_words) as kept
from b
"""


@query
def op4_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The archives are read back; what is stored once is known from the records alone."""
    return record_table(warc_round_trip(table(spark, sf, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LLM_ORACLES["op4_warc_chunks"] = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


@query
def op9_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


LLM_ORACLES["op9_source_mix"] = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case when length(text) > 0 then greatest(0.05::double, 1::double / (1::double + 20::double * (length(text) - length(translate(text, '#*$%&|<>{}[]_=~^', ''))) / length(text))) else 0.05::double end as quality,
         (('0x' || md5('mix:' || coalesce(doc_id::varchar, ''))[1:13])::bigint::double + 0.5::double) / 4503599627370496::double as u
  from documents),
k as (select *, -ln(u) / quality as key from d),
s as (
  select source, sum(size)::bigint as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by source),
r as (select *, 3 * source_size as cap, 3 * source_size / weight as full_at, sum(source_size) over () as total from s),
l as (
  select *, (total - coalesce((select sum(b.cap) from r b where (b.full_at, coalesce(b.source, chr(1114111))) < (r.full_at, coalesce(r.source, chr(1114111)))), 0))::double
         / (select sum(b.weight) from r b where (b.full_at, coalesce(b.source, chr(1114111))) >= (r.full_at, coalesce(r.source, chr(1114111))))::double as level
  from r),
t as (
  select source, source_size, least(cap::double, coalesce((select arg_min(level, (full_at, coalesce(source, chr(1114111)))) from l where level < full_at) * weight, cap::double)) as target
  from r),
o as (
  select k.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
         sum(k.size) over (partition by k.source order by k.key, k.doc_id) as reach
  from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when epochs < 3 and size > 0 and reach - size / 2 <= target - epochs * source_size then 1 else 0 end))::bigint as taken
from o
"""


@query
def op5_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf, "labels")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op6_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op2_token_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return section_tokens(table(spark, sf, "documents"))


@query
def op3_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The index of the written shards: a row per slot."""
    return write_shards(table(spark, sf, "documents")).drop("file")


@query
def op8_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every length take part; only those without a word stay whatever happens."""
    return drop_recurring_lines(table(spark, sf, "documents").select("doc_id", "text"), min_words=1)


@query
def op10_dom_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))


LLM_ORACLES["op11_source_divergence"] = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
u as (select r, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) as term from d),
kept as (select lang, term, count(*) as n from u group by all having count(distinct r) >= 10),
c as (select u.lang, source, u.term, count(*) as n from u join kept on u.lang = kept.lang and u.term = kept.term group by all),
l as (select lang, count(*) as v, sum(n) as total from kept group by lang),
t as (select lang, source, sum(n) as total from c group by all),
g as (
  select g.lang, g.source, coalesce(t.total, 0)::hugeint as total, coalesce(v, 0) as v, coalesce(l.total, 0)::hugeint as lang_total
  from (select distinct lang, source from d) g left join t on g.lang = t.lang and g.source = t.source left join l on g.lang = l.lang),
s as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) as p,
         1 + 1000000000::hugeint * (k.n + 2) // (lang_total + 2 * v) as q
  from g join kept k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from s where n > 0 and p > q)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from all_pairs union all from terms))
where part = 'pair' or rank <= 10
"""


@query
def op12_impact_search(spark: SparkSession, sf: str) -> DataFrame:
    return top_products(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


LLM_ORACLES["op12_impact_search"] = """
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score
  from e q join e c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5
"""


@query
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs(table(spark, sf, "documents"), rewrite=repeated_tail)
    best = found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("best"))
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# The benchmark holds no digits, so words with digits match nothing here and units do not occur.
LLM_ORACLES["op6_template_decontamination"] = r"""
with words(doc, item, x, i) as (
  select doc_id, null, unnest(w), unnest(range(len(w))) from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents)
  union all select null, item_id, unnest(w), unnest(range(len(w))) from (select distinct item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from benchmark)),
bare as (
  select *, regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}]+([\p{L}\p{N}])', '\1'), '([\p{L}\p{N}])[^\p{L}\p{N}]+$', '\1') as b, lower(regexp_replace(x, '[^\p{L}\p{N}%]', '', 'g')) as v
  from words),
tok as (select *, lower(regexp_replace(b, '(^|[^\p{L}\p{N}])\p{Lu}[\p{L}\p{M}]*', '\1' || chr(57345), 'g')) as t from bare),
win as (
  select doc, item, i, string_agg(t, ' ') over eight as h, list(v) over eight as vs, list(contains(t, chr(57345))) over eight as slots, count(*) over eight as n
  from tok window eight as (partition by doc, item order by i rows between current row and 7 following)),
own as (
  select item, h, min(i) as k, arg_min(vs, i) as vs, any_value(slots) as slots from win
  where item is not null and n = 8 and len(list_filter(slots, lambda s: not s)) >= 3 group by item, h),
total as (select item, count(*) as n_windows from own group by item),
hit as (select w.doc, o.item, w.i - o.k as pos, o.k, o.slots, o.vs as item_vs, w.vs as doc_vs from win w join own o on w.h = o.h where w.doc is not null and w.n = 8),
pair as (select distinct doc, item, pos, a, b from (select *, unnest(item_vs) as a, unnest(doc_vs) as b, unnest(slots) as s from hit) where s),
fit as (select doc, item, pos, count(distinct a) = count(*) and count(distinct b) = count(*) as one_to_one, count(*) filter (a <> b) as n_changed from pair group by all),
place as (
  select h.doc, h.item, h.pos, count(distinct k) as n_matched, any_value(coalesce(one_to_one, true)) as one_to_one, any_value(coalesce(n_changed, 0)) as n_changed
  from hit h left join fit f on h.doc = f.doc and h.item = f.item and h.pos = f.pos group by all),
best as (
  select p.*, n_windows, row_number() over (partition by doc, p.item order by n_matched desc, n_changed, pos) as nth
  from place p join total t on p.item = t.item where one_to_one and (n_matched >= 0.5 * n_windows or n_matched >= 6))
select doc as doc_id, item as item_id, n_matched, n_windows, pos::int as "at", n_changed::int as n_changed from best where nth = 1
"""
