"""Queries over documents: harmonising, filtering, clean-up, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical as lex
from ..functions import lexicons as lx
from ..functions import text as tx
from ..functions.hashing import simhash64
from ..functions.lexicons import ABSOLUTIST, HEDGES
from ..operators import documents as dc
from ..operators import duplicates as dup
from ..operators import statistics as st
from ..operators.views import ANNOTATED_SQL, annotated, table
from .registry import ORACLE, query

#: Cue lists for made-up text: words it has.
CUES = {"absolutist": ("all", "the", "every", "be of"), "hedges": ("that", "with", "la de")}
CLASSES = ("conspiracy", "non", "cant_tell")


def _docs(spark, d):
    return table(spark, d, "documents")


def _raw(spark, d):
    """Records whose keys vary: id under three names, text under two, labels as annotators write them."""
    a = annotated(spark, d)
    raw = F.when(F.col("doc_label") == "conspiracy", " Yes ").when(F.col("doc_label") == "non", "NO").when(F.col("doc_id") % 2 == 0, "Can't tell").otherwise("unsure")
    third = F.col("doc_id") % 3
    return a.select(F.when(third == 0, F.col("doc_id").cast("string")).alias("doc_id"), F.when(third == 1, F.col("doc_id").cast("string")).alias("_id"), F.when(third == 2, F.col("doc_id").cast("string")).alias("id"),
                    F.col("source").alias("subreddit"), F.when(third == 1, F.lit("  ")).otherwise(F.col("text")).alias("text"), F.col("text").alias("body"), raw.alias("conspiracy"))


@query(f"""with {ANNOTATED_SQL}
select cast(doc_id as varchar) as doc_id, source as subreddit, text,
       case doc_label when 'conspiracy' then 'conspiracy' when 'non' then 'non' else case when doc_id % 2 = 0 then 'cant_tell' end end as doc_label
from annotated""")
def doc_harmonise(spark, d):
    return dc.harmonise(_raw(spark, d))


@query(f"""with {ANNOTATED_SQL}, raw as (select doc_id, case doc_label when 'conspiracy' then 'Yes' when 'non' then 'No' else case when doc_id % 2 = 0 then 'Can''t tell' else 'maybe.' end end as l from annotated)
select doc_id, case l when 'Yes' then 'conspiracy' when 'No' then 'non' when 'Can''t tell' then 'cant_tell' else 'DROP_ME' end as strict,
       case when l = 'Yes' then 'conspiracy' when l = 'No' then 'non' else 'ambiguous' end as verdict,
       lower(replace(l, '.', '')) as span_label from raw""")
def doc_label_normalise(spark, d):
    a = annotated(spark, d)
    raw = F.when(F.col("doc_label") == "conspiracy", "Yes").when(F.col("doc_label") == "non", "No").when(F.col("doc_id") % 2 == 0, "Can't tell").otherwise("maybe.")
    return a.select("doc_id", dc.strict_label(raw).alias("strict"), tx.verdict_label(raw).alias("verdict"), tx.span_label(F.concat(F.lit("S1Label. "), F.replace(raw, F.lit("."), F.lit("")))).alias("span_label"))


@query("""select doc_id, source, length(text) as n from (
  select *, row_number() over (partition by doc_id order by copy desc) as rn from (select *, 0 as copy from documents union all select *, 1 as copy from documents)) where rn = 1""")
def unique_by_id(spark, d):
    docs = _docs(spark, d)
    both = docs.withColumn("copy", F.lit(0)).unionByName(docs.withColumn("copy", F.lit(1)))
    return dc.unique_by_id(both.select("doc_id", "source", F.length("text").cast("long").alias("n"), "copy"), "doc_id", F.desc("copy")).drop("copy")


@query(f"""with {ANNOTATED_SQL} select doc_id, doc_label, case doc_label when 'conspiracy' then 'Yes' else 'No' end as verdict from annotated where doc_label <> 'cant_tell'""")
def docclf_view(spark, d):
    return dc.docclf_view(annotated(spark, d)).select("doc_id", "doc_label", "verdict")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, d):
    return dc.resume(_docs(spark, d), table(spark, d, "labels")).select("doc_id")


@query("""select d.doc_id from documents d left join (select doc_id, (doc_id * 37 % 100) / 100.0 as prob from labels) p using (doc_id) where coalesce(prob > 0.5, true)""")
def gate_by_probability(spark, d):
    probs = table(spark, d, "labels").select("doc_id", (F.col("doc_id") * 37 % 100 / F.lit(100.0)).alias("prob"))
    return dc.gate_by_probability(_docs(spark, d), probs, 0.5).select("doc_id")


@query("select doc_id from documents where not (contains(lower(text), 'worthless') or contains(lower(text), 'scum')) or contains(lower(text), 'theory')")
def safe_list_gate(spark, d):
    return dc.safe_list_gate(_docs(spark, d), ("worthless", "scum"), "theory").select("doc_id")


@query("select count(*) as n, round(avg(case when length(text) between 160 and 10000 then 1.0 else 0.0 end), 6) as share, round(avg(case when length(text) between 160 and 10000 then 1.0 else 0.0 end), 6) >= 0.98 as ok from documents")
def length_gate(spark, d):
    return dc.assert_lengths(_docs(spark, d), 160, 10_000, 0.98)


@query("""select count(*) as n, round(avg(length(text)), 6) as mean, cast(floor(quantile_cont(length(text), 0.1)) as bigint) as p10, cast(floor(quantile_cont(length(text), 0.25)) as bigint) as p25,
  cast(floor(quantile_cont(length(text), 0.5)) as bigint) as p50, cast(floor(quantile_cont(length(text), 0.75)) as bigint) as p75, cast(floor(quantile_cont(length(text), 0.9)) as bigint) as p90,
  round(avg(case when length(text) < 200 then 1.0 else 0 end), 6) as below, round(avg(case when length(text) > 5000 then 1.0 else 0 end), 6) as above from documents""")
def length_profile(spark, d):
    return st.length_profile(_docs(spark, d), 200, 5000)


@query(f"""with {ANNOTATED_SQL}, b as (select case when length(text) < 500 then 'short' when length(text) < 2000 then 'medium' else 'long' end as bucket, doc_label from annotated)
select bucket, round(count(*) filter (doc_label = 'conspiracy') / count(*), 6) as conspiracy, round(count(*) filter (doc_label = 'non') / count(*), 6) as non, round(count(*) filter (doc_label = 'cant_tell') / count(*), 6) as cant_tell from b group by bucket""")
def length_bucket_crosstab(spark, d):
    return st.bucket_crosstab(annotated(spark, d), CLASSES)


@query(f"""with {ANNOTATED_SQL} select source, count(*) filter (doc_label = 'conspiracy') as conspiracy, count(*) filter (doc_label = 'non') as non, count(*) filter (doc_label = 'cant_tell') as cant_tell, count(*) as n
from annotated group by source order by n desc, source limit 10""")
def source_crosstab(spark, d):
    return st.source_crosstab(annotated(spark, d), 10, CLASSES)


@query(f"""with {ANNOTATED_SQL} select doc_label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from annotated group by doc_label""")
def label_shares(spark, d):
    return st.label_shares(annotated(spark, d))


@query(f"""with {ANNOTATED_SQL}, kept as (select * from annotated qualify row_number() over (partition by md5(trim(text)) order by doc_id) = 1)
select doc_label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, 'before' as phase from annotated group by doc_label
union all select doc_label, count(*), round(count(*) / sum(count(*)) over (), 6), 'after' from kept group by doc_label""")
def drift_report(spark, d):
    a = annotated(spark, d)
    return st.drift(a, a.join(dup.first_by_text(a).select("doc_id"), "doc_id", "left_semi"))


@query("select page_id, replace(url, 'https://', '<URL>') as u from pages")
def url_token_parity(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_tokens(F.replace("url", F.lit("https://"), F.lit("[URL]"))).alias("u"))


@query(r"""with a as (select page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g') as x from pages),
b as (select page_id, regexp_replace(x, '<[^>]*>', ' ', 'g') as x from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as x from b)
select page_id, md5(trim(regexp_replace(x, '[ \t\r\n\f\x0B]+', ' ', 'g'))) as text_md5, length(trim(regexp_replace(x, '[ \t\r\n\f\x0B]+', ' ', 'g'))) as n from c""")
def html_text(spark, d):
    p = table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@query(r"""select doc_id, md5(trim(regexp_replace('** Submission Statement: ' || text, '(?i)^[^a-z0-9_]*(summary statement|submission statement|ss)[^a-zA-Z]*', ''))) as m from documents""")
def prefix_strip(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.strip_statement(F.concat(F.lit("** Submission Statement: "), F.col("text")))).alias("m"))


@query(r"select doc_id, md5(trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g'))) as m, case when length(text) > 1200 then length(substr(text, 1, 1200) || '...') else length(text) end as n from documents")
def normal_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normal_space(F.col("text"))).alias("m"), F.length(tx.truncate(F.col("text"), 1200)).cast("long").alias("n"))


@query(r"""select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as n_words, len(list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '[ \t\r\n\f\x0B]+'), lambda w: w <> ''))) as n_kinds,
  greatest(len(regexp_extract_all(lower(text), '[a-z0-9'']+|<url>')) - 1, 0) as n_bigrams from documents""")
def token_counts(spark, d):
    c = F.col("text")
    n = lambda x: F.size(x).cast("long")
    docs = _docs(spark, d).withColumn("cues", tx.cue_words(c))
    return docs.select("doc_id", n(tx.ascii_words(c)).alias("n_words"), n(tx.word_set(c)).alias("n_kinds"), n(tx.ngrams(F.col("cues"), 2)).alias("n_bigrams"))


NORMAL_SQL = r"sha1(trim(regexp_replace(lower(text), '[ \t\r\n\f\x0B]+', ' ', 'g')))"


@query(f"select {NORMAL_SQL} as text_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_clusters(spark, d):
    return dup.exact_clusters(_docs(spark, d))


@query(f"select doc_id, length(text) as n_text from documents qualify row_number() over (partition by {NORMAL_SQL} order by length(text) desc, doc_id) = 1")
def keep_longest(spark, d):
    return dup.keep_longest(_docs(spark, d)).withColumn("n_text", F.col("n_text").cast("long"))


@query("select min(doc_id) as doc_id, count(*) as n from documents group by md5(trim(text))")
def text_dedup_first(spark, d):
    return dup.first_by_text(_docs(spark, d))


SIMHASH_SQL = """words as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from documents),
counted as (select doc_id, w, count(*) as n from words group by 1, 2),
hashed as (select doc_id, n, ('0x' || substr(md5(w), 17, 16))::ubigint as h from counted),
votes as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) as v from hashed, (select unnest(range(64))::ubigint as b) group by 1, 2),
hashes as (select d.doc_id, sum(case when coalesce(v, 0) >= 0 then (1::ubigint << bb.b) else 0::ubigint end)::ubigint as h
  from documents d cross join (select unnest(range(64))::ubigint as b) bb left join votes on votes.doc_id = d.doc_id and votes.b = bb.b group by 1)"""


@query(f"with {SIMHASH_SQL} select doc_id, case when h > 9223372036854775807 then (h::hugeint - 18446744073709551616)::bigint else h::bigint end as simhash from hashes")
def simhash(spark, d):
    return simhash64(_docs(spark, d))


PAIRS_SQL = SIMHASH_SQL + """, pairs as (select a.doc_id as a, b.doc_id as b, bit_count(xor(a.h, b.h))::int as distance from hashes a join hashes b on a.doc_id < b.doc_id and bit_count(xor(a.h, b.h)) <= 4)"""


@query(f"with {PAIRS_SQL} select a, b, distance from pairs")
def lsh_pairs(spark, d):
    return dup.simhash_pairs(simhash64(_docs(spark, d)))


@query("with " + SIMHASH_SQL + """, p as (select xor(a.h, b.h) as x, bit_count(xor(a.h, b.h)) as n from hashes a join hashes b on a.doc_id < b.doc_id and bit_count(xor(a.h, b.h)) <= 6),
s as (select b as bands, n, list_bool_or(list_transform(range(b), lambda k: (x >> (k * (64 // b))) & ((1::ubigint << (64 // b)) - 1) = 0)) as near from p, (values (4), (8), (16)) v(b))
select bands::int as bands, d as distance, count(n) filter (near and n <= d) as pairs from s, (values (2), (4), (6)) w(d) group by 1, 2""")
def lsh_sweep_counts(spark, d):
    return dup.band_sweep(simhash64(_docs(spark, d)), (4, 8, 16), (2, 4, 6))


@query()
def lsh_precision(spark, d):
    """For each setting how many pairs there are, and how many of at most 4000 sampled ones are alike as texts."""
    docs = _docs(spark, d)
    return dup.sweep_precision(simhash64(docs), docs.select("doc_id", tx.normal_space(F.col("text")).alias("text")), (4, 8, 16), (2, 3, 4, 5, 6, 8))


COMPONENT_SQL = PAIRS_SQL + f""", texts as (select doc_id, {NORMAL_SQL} as t from documents),
links as (select a, b from pairs union select x.doc_id, y.doc_id from texts x join texts y on x.t = y.t and x.doc_id < y.doc_id),
sym as (select a, b from links union select b, a from links)"""
REACH_SQL = COMPONENT_SQL + """, reach as (select doc_id as node, doc_id as root from documents union select sym.b, reach.root from reach join sym on sym.a = reach.node),
comps as (select node as doc_id, min(root) as dup_comp from reach group by node)"""


@query(f"with recursive {REACH_SQL} select doc_id, dup_comp from comps")
def dup_components(spark, d):
    docs = _docs(spark, d)
    return dup.duplicate_components(docs, simhash64(docs))


def _members(spark, d):
    a = annotated(spark, d)
    comps = dup.duplicate_components(a, simhash64(a))
    return a.join(comps, "doc_id").select("doc_id", "dup_comp", F.when(F.col("doc_label") != "cant_tell", F.col("doc_label")).alias("doc_label"), (F.col("doc_id") % 4).alias("n_markers"), F.length("text").alias("text_len"))


@query(f"""with recursive {REACH_SQL}, {ANNOTATED_SQL},
m as (select doc_id, dup_comp, nullif(doc_label, 'cant_tell') as doc_label, doc_id % 4 as n_markers, length(text) as text_len from annotated join comps using (doc_id)),
major as (select dup_comp, coalesce(doc_label, 'non') as l from m group by 1, 2 qualify row_number() over (partition by dup_comp order by count(*) desc, l) = 1),
s as (select m.*, round(case when doc_label = l then 10 else 0 end + 2 * n_markers + 0.001 * text_len, 6)::double as score, count(*) over (partition by dup_comp) as size from m join major using (dup_comp))
select dup_comp, doc_id, size, score from s qualify row_number() over (partition by dup_comp order by score desc, doc_id) = 1""")
def component_representative(spark, d):
    return dup.representatives(_members(spark, d))


@query(f"""with recursive {REACH_SQL}, m as (select doc_id, dup_comp, case when doc_id % 5 = 0 then 'dev' else 'train' end as split from comps)
select doc_id, dup_comp from m where split = 'train' and dup_comp in (select dup_comp from m group by 1 having count(distinct split) > 1)""")
def leakage_report(spark, d):
    return dup.leakage(_members(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")))


@query(f"""with recursive {REACH_SQL}, m as (select doc_id, dup_comp, case when doc_id % 5 = 0 then 'dev' else 'train' end as split from comps),
bad as (select dup_comp from m group by 1 having count(distinct split) > 1),
kept as (select * from m where split = 'dev' or dup_comp not in (select dup_comp from bad))
select split, count(*) as n, count(distinct dup_comp) as comps, cast(sum(case when dup_comp in (select dup_comp from kept group by 1 having count(distinct split) > 1) then 1 else 0 end) as bigint) as leaking from kept group by split""")
def split_verify(spark, d):
    m = _members(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train"))
    kept = m.join(dup.leakage(m).select("doc_id"), "doc_id", "left_anti")
    still = kept.groupBy("dup_comp").agg(F.countDistinct("split").alias("splits"))
    return kept.join(still, "dup_comp").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("dup_comp").alias("comps"), F.sum((F.col("splits") > 1).cast("long")).alias("leaking"))


def _term_counts() -> str:
    """Matches of whole terms, with every other character doubled so that neighbours do not share one."""
    lists = CUES | {"english_absolutist": ABSOLUTIST, "english_hedges": HEDGES}
    one = lambda t: "|".join(x.replace(" ", "  ") for x in sorted(t, key=len, reverse=True))
    return ", ".join(f"{{'metric': '{k}', 'n': len(regexp_extract_all(t, '(?:^|[^a-z0-9_])(?:{one(t)})(?:[^a-z0-9_]|$)'))}}" for k, t in lists.items())


@query(f"""with {ANNOTATED_SQL}, t as (select doc_label, length(text) as n, regexp_replace(lower(text), '([^a-z0-9_])', '\\1\\1', 'g') as t from annotated), c as (select doc_label, n, unnest([{_term_counts()}]) as x from t),
r as (select x.metric as metric, doc_label, x.n * 1000.0 / greatest(n, 1) as rate from c)
select metric, doc_label, round(avg(rate), 4) as mean, round(quantile_cont(rate, 0.5), 4) as median, round(stddev_samp(rate), 4) as std, count(*) as n from r group by 1, 2""")
def lexicon_rates(spark, d):
    return st.lexicon_rates(annotated(spark, d), CUES | {"english_absolutist": ABSOLUTIST, "english_hedges": HEDGES})


@query(f"""with {ANNOTATED_SQL}, t as (select source, doc_label, doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from annotated),
r as (select source, doc_label, doc_id, len(list_filter(w, lambda x: x in ('all', 'the', 'every', 'be of'))) / greatest(len(w), 1) as v from t)
select source, doc_label, count(distinct doc_id) as docs, round(avg(v), 4) as mean from r group by 1, 2 having count(distinct doc_id) >= 20""")
def lexicon_by_source(spark, d):
    a = annotated(spark, d)
    return st.group_means(a, tx.lexicon_share(tx.ascii_words(F.col("text")), CUES["absolutist"]), ["source", "doc_label"], 20)


@query(f"""with {ANNOTATED_SQL} , c as (select source, doc_label, count(*) as n from annotated group by 1, 2), p as (select *, n / sum(n) over (partition by source) as p from c)
select source, cast(sum(n) as bigint) as n, round(-sum(p * log2(p)), 6) as entropy from p group by 1""")
def source_entropy(spark, d):
    return st.label_entropy(annotated(spark, d))


def _rates(spark, d):
    a = annotated(spark, d)
    return a.select("doc_id", "doc_label", F.lit("the").alias("metric"), F.round(tx.lexicon_share(tx.ascii_words(F.col("text")), ("the", "and")), 6).alias("v")).unionByName(
        a.select("doc_id", "doc_label", F.lit("length").alias("metric"), F.length("text").cast("double").alias("v")))


U_SQL = f"""{ANNOTATED_SQL}, t as (select doc_label, length(text) as n, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from annotated),
v as (select 'the' as metric, doc_label, round(len(list_filter(w, lambda x: x in ('the', 'and'))) / greatest(len(w), 1), 6) as v from t union all select 'length', doc_label, n::double from t),
k as (select metric, v, count(*) filter (doc_label = 'conspiracy') as na, count(*) filter (doc_label = 'non') as nb from v where doc_label <> 'cant_tell' group by 1, 2),
b as (select *, coalesce(sum(nb) over (partition by metric order by v rows between unbounded preceding and 1 preceding), 0) as below from k)"""


@query(f"""with {U_SQL} select metric, round(sum(na * (below + nb / 2)), 6)::double as u, round(2 * sum(na * (below + nb / 2)) / (sum(na) * sum(nb)) - 1, 6)::double as cliffs_delta, sum(na)::bigint as na, sum(nb)::bigint as nb from b group by 1""")
def cliffs_delta(spark, d):
    return st.mann_whitney(_rates(spark, d), "v", "doc_label", "conspiracy", "non")


@query(f"""with {U_SQL}, s as (select metric, sum(na * (below + nb / 2)) as u, sum(na) as na, sum(nb) as nb, sum((na + nb)::double * (na + nb) * (na + nb) - (na + nb)) as ties from b group by 1),
x as (select *, sqrt(na * nb / 12 * ((na + nb + 1) - ties / greatest((na + nb) * (na + nb - 1), 1))) as spread, greatest(abs(u - na * nb / 2) - 0.5, 0) as far from s),
y as (select *, far / spread / sqrt(2.0::double) as x, 1 / (1 + 0.3275911::double * (far / spread / sqrt(2.0::double))) as t from x),
p as (select *, round(least(((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-x * x), 1), 6) as p from y),
r as (select *, row_number() over (order by p, metric) as rk, count(*) over () as n from p)
select metric, round(u, 6)::double as u, round(2 * u / (na * nb) - 1, 6)::double as cliffs_delta, na::bigint as na, nb::bigint as nb, p, round(least(1.0, min(p * n / rk) over (order by rk desc rows between unbounded preceding and current row)), 6) as p_bh from r""")
def mannwhitney_p(spark, d):
    """Two-sided p, adjusted for the number of metrics."""
    return st.benjamini_hochberg(st.mann_whitney_p(_rates(spark, d), "v", "doc_label", "conspiracy", "non"))


@query("""with p as (select source, round(count(*) / (select count(*) from documents), 6) as p from documents group by 1),
r as (select *, row_number() over (order by p, source) as rk, count(*) over () as n from p)
select source, p, round(least(1.0, min(p * n / rk) over (order by rk desc rows between unbounded preceding and current row)), 6) as p_bh from r""")
def bh_adjust(spark, d):
    docs = _docs(spark, d)
    total = docs.agg(F.count("*").alias("t"))
    p = docs.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("source", F.round(F.col("n") / F.col("t"), 6).alias("p"))
    return st.benjamini_hochberg(p.orderBy("p", "source"))


@query(f"""with {ANNOTATED_SQL}, t as (select doc_label, regexp_extract_all(lower(text), '[a-z0-9'']+|<url>') as w from annotated where doc_label <> 'cant_tell'),
g as (select doc_label, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as gram from t),
c as (select gram, count(*) filter (doc_label = 'conspiracy') as na, count(*) filter (doc_label = 'non') as nb from g group by 1),
s as (select sum(na) as ta, sum(nb) as tb, count(*) as v from c),
o as (select gram, na, nb, round(ln((na + 0.01) / (ta + 0.01 * v - na - 0.01)) - ln((nb + 0.01) / (tb + 0.01 * v - nb - 0.01)), 6) as log_odds from c, s)
select * from (select *, 'conspiracy' as side from o order by log_odds desc, gram limit 100) union all select * from (select *, 'non' as side from o order by log_odds, gram limit 100)""")
def ngram_log_odds(spark, d):
    return st.ngram_log_odds(annotated(spark, d), 2, 100, "conspiracy", "non")


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+|<url>')) as term from documents),
tf as (select doc_id, term, count(*) as tf from w group by 1, 2), df as (select term, count(*) as df from tf group by 1 having count(*) >= 2), n as (select count(*) as n from documents),
r as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n)
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from r""")
def tfidf(spark, d):
    return st.tfidf(_docs(spark, d))


def _cue(cues):
    return f"regexp_matches(text, '(?i)(^|[^a-z0-9_])({'|'.join(cues)})([^a-z0-9_]|$)')"


SUBTYPE_SQL = f"""{ANNOTATED_SQL}, sub as (select *, case doc_label when 'non' then case when {_cue(lx.CUES_DEBUNK)} then 'non_debunking' when {_cue(lx.CUES_MUNDANE)} then 'non_mundane' else 'non_reporting' end
  when 'conspiracy' then case when {_cue(lx.CUES_EVANGELIST)} then 'con_evangelist' when {_cue(lx.CUES_INSIDER)} then 'con_insider' else 'con_general' end else 'ambiguous' end as subtype from annotated)"""


@query(f"with {SUBTYPE_SQL} select doc_id, doc_label, subtype from sub")
def subtype_class(spark, d):
    return annotated(spark, d).select("doc_id", "doc_label", lex.subtype(F.col("text"), F.col("doc_label")).alias("subtype"))


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


@query(f"""with {SUBTYPE_SQL}, t as (select *, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from sub),
r as (select doc_id, doc_label, subtype, length(text) as n, len(list_filter(w, lambda x: x in ({_in(ABSOLUTIST)}))) / greatest(len(w), 1) as a, len(list_filter(w, lambda x: x in ({_in(HEDGES)}))) / greatest(len(w), 1) as h from t),
k as (select *, (doc_label = 'non' and doc_id % 3 > 0) or subtype = 'non_debunking' as is_hard_negative from r)
select doc_id, round(case when n > 200 and n < 2000 then 1 else 0 end + 1 - case when doc_id % 7 = 0 then 5 else 0 end + case when (doc_label = 'conspiracy' and a > 0.015) or (doc_label = 'non' and h > 0.015) then 2 else 0 end + case when is_hard_negative then 3 else 0 end, 3)::double as score, is_hard_negative from k""")
def richness_score(spark, d):
    a = annotated(spark, d).withColumn("tokens", tx.ascii_words(F.col("text"))).withColumn("kind", lex.subtype(F.col("text"), F.col("doc_label")))
    score, hard = lex.richness(F.col("text"), F.col("doc_label"), F.col("kind"), F.col("tokens"), F.col("doc_id") % 3, F.col("doc_id") % 7 == 0)
    return a.select("doc_id", score.alias("score"), hard.alias("is_hard_negative"))


def _share(words):
    return f"len(list_filter(low, lambda x: x in ({_in(words)}))) / n"


@query(f"""with t as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') as low, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Za-z]+')) as words from documents),
m as (select *, greatest(len(words), 1) as n, (length(text) - length(replace(text, '?', ''))) / (len(regexp_extract_all(text, '[.!?]+')) + 1) as density from t)
select doc_id, round_even({_share(lx.ATTRIBUTION)} * 100, 2)::double as attribution_density, round_even({_share(lx.UNCERTAINTY)}, 3)::double as uncertainty_ratio, round_even({_share(lx.INTENSITY)}, 3)::double as epistemic_intensity, round_even({_share(lx.PASSIVE)}, 3)::double as agency_gap,
  round_even(density, 2)::double as question_density, round_even(len(list_filter(words, lambda x: length(x) > 1 and x = upper(x))) / n, 3)::double as shouting_score, density > 0.35 and {_share(lx.UNCERTAINTY)} > 0.05 as is_jaqing from m""")
def forensic_stats(spark, d):
    return _docs(spark, d).select("doc_id", *(c.alias(k) for k, c in lex.profile(F.col("text")).items()))


@query(f"""select warning, count(*) as n from (select unnest([case when attribution_density > 3.5 then 'attribution' end, case when is_jaqing then 'jaq' end, case when shouting_score > 0.10 then 'emotion' end, case when agency_gap > 0.06 then 'passive' end]) as warning from ({ORACLE['forensic_stats']})) where warning is not null group by 1""")
def profile_warnings(spark, d):
    p = forensic_stats(spark, d)
    w = lex.warnings(F.col("attribution_density"), F.col("is_jaqing"), F.col("shouting_score"), F.col("agency_gap"))
    return p.select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))
