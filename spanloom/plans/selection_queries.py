"""Queries that choose examples and profile documents and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bank as bk
from ..operators import profiles as pf
from ..operators import retrieval as rt
from ..operators import sampling as sm
from ..operators import selection as se
from ..operators import statistics as st
from ..operators.duplicates import exact_hash
from ..operators.staging import staged
from ..operators.views import ANNOTATED_SQL, SPAN_TEXTS_SQL, SPANS_SQL, TOKENS_SQL, annotated, marked, span_texts, spans, table, tokens
from .corpus_queries import mmr_sql
from .document_queries import NORMAL_SQL
from .registry import query

HAS = "list_contains(labels, 'Action') and list_contains(labels, 'Effect') as has_ae, list_contains(labels, 'Victim') as has_victim"
BANK = f"""with recursive {SPAN_TEXTS_SQL}, {ANNOTATED_SQL},
per as (select doc_id, count(*) as n_spans, list_sort(list(distinct label)) as labels from marked group by 1),
joined as (select a.*, coalesce(n_spans, 0) as n_spans, coalesce(labels, []::varchar[]) as labels from annotated a left join per using (doc_id)),
bank as (select *, {HAS} from joined)"""
H = "md5('42:' || doc_id)"
FILL = "md5('fill:' || doc_id)"


def _docs(spark, d):
    return table(spark, d, "documents")


def _bank(spark, d):
    return se.example_bank(annotated(spark, d), marked(_docs(spark, d)))


@query(f"{BANK} select doc_id, n_spans, array_to_string(labels, '/') as labels, has_ae, has_victim from bank")
def example_bank(spark, d):
    return _bank(spark, d).select("doc_id", "n_spans", F.array_join("labels", "/").alias("labels"), "has_ae", "has_victim")


@query(f"""{BANK}, s as (select *, case when n_spans = 0 then 'negative' when n_spans <= 2 then 'simple' else 'complex' end as stratum from bank),
t as (select *, row_number() over (partition by stratum, source order by {H}, doc_id) as turn from s),
p as (select *, row_number() over (partition by stratum order by turn, md5('42:' || source), source) as pick from t where turn <= 40),
picked as (select doc_id, stratum, 'stratum' as how from p where pick <= case stratum when 'negative' then 10 when 'simple' then 16 else 14 end),
rest as (select doc_id, stratum, 'fill' as how, row_number() over (order by case when n_spans = 0 then 1 else 0 end, {FILL}, doc_id) as nth from s where doc_id not in (select doc_id from picked))
select doc_id, stratum, how from picked union all select doc_id, stratum, how from rest where nth <= 40 - (select count(*) from picked)""")
def stratified_examples(spark, d):
    return se.stratified_examples(_bank(spark, d), 40).select("doc_id", "stratum", "how")


@query(f"""with {ANNOTATED_SQL}, s as (select *, case when doc_label = 'conspiracy' then 'conspiracy' else 'non' end as side from annotated),
t as (select *, row_number() over (partition by side, source order by {H}, doc_id) as turn from s),
p as (select *, row_number() over (partition by side order by turn, md5('42:' || source), source) as pick from t where turn <= 15),
picked as (select doc_id, side, 'half' as how from p where pick <= 15),
rest as (select doc_id, side, 'fill' as how, row_number() over (order by {FILL}, doc_id) as nth from s where doc_id not in (select doc_id from picked))
select doc_id, side, how from picked union all select doc_id, side, how from rest where nth <= 31 - (select count(*) from picked)""")
def halved_examples(spark, d):
    return se.halved_examples(annotated(spark, d), 31).select("doc_id", "side", "how")


@query(f"with {ANNOTATED_SQL} select doc_id, doc_label, source, (row_number() over (partition by doc_label order by source, {H}, doc_id))::int as rank from annotated where doc_label in ('conspiracy', 'non') qualify rank <= 6")
def balanced_pick(spark, d):
    return se.balanced_pick(annotated(spark, d), 6).select("doc_id", "doc_label", "source", "rank")


@query(f"""with r as (select doc_id, source, row_number() over (partition by source order by {H}, doc_id) - 1 as nth, count(*) over (partition by source) as n from documents),
k as (select *, cast(ceil(n / 60.0) as bigint) as parts from r), w as (select *, n // parts as small, n % parts as wide from k)
select doc_id, source || '#' || (case when nth < wide * (small + 1) then nth // (small + 1) else wide + (nth - wide * (small + 1)) // small end) as "group" from w""")
def pseudo_groups(spark, d):
    return se.pseudo_groups(_docs(spark, d).select("doc_id", "source")).select("doc_id", "group")


@query(f"""{BANK}, p as (select doc_id, case when length(text) between 60 and 220 and not regexp_matches(text, '(?i)http|www\\.|@[a-z0-9_]|%|[0-9]{{4}}|deep state|globalist|they|elite') then 'clean'
  when length(text) between 80 and 240 and regexp_matches(text, '(?i)they|elite|deep state|globalist|agenda|cover[- ]?up|manipulat|engineer|weaponiz') then 'hard' end as pool from bank where n_spans = 0)
select doc_id, pool from p where pool is not null""")
def negative_pools(spark, d):
    return se.negative_pools(_bank(spark, d)).select("doc_id", "pool")


CUE, MYTH = "(?i)tion|ment|ique", "(?i)shan|ouèr"
SIGNALS = f"""signals as (select doc_id, source, len(regexp_extract_all(text, '{CUE}'))::int as cues, regexp_matches(text, '{MYTH}') as debunk, (length(text) - length(replace(text, '?', '')))::int as qmarks, length(text)::int as length from documents),
scored as (select *, round(3.0 * cues + least(length / 400.0, 1.0) - case when debunk then 4.0 else 0.0 end - 0.5 * qmarks, 6)::double as score_yes,
  round(least(length / 400.0, 1.0) + case when debunk then 2.0 else 0.0 end + case when cues > 0 and not debunk then 1.0 else 0.0 end - 0.2 * qmarks, 6)::double as score_no from signals)"""


def _scored(spark, d):
    return se.class_scores(se.cue_signals(_docs(spark, d), CUE, MYTH))


@query(f"with {SIGNALS} select doc_id, cues, debunk, qmarks, length, score_yes, score_no from scored")
def class_scores(spark, d):
    return _scored(spark, d).select("doc_id", "cues", "debunk", "qmarks", "length", "score_yes", "score_no")


@query(f"""with {SIGNALS}, f as (select *, row_number() over (partition by lower(source) order by score_yes desc, doc_id) as nth from scored)
select doc_id, source, score_yes from f where nth = 1 order by score_yes desc, doc_id limit 10""")
def source_diverse_pick(spark, d):
    return se.diverse_pick(_scored(spark, d), 10, [F.desc("score_yes"), F.col("doc_id")]).select("doc_id", "source", "score_yes")


WORDS = ("tion", "ment", "the", "shan")
SALIENCE = " + ".join(f"contains(lower(text), '{w}')::int" for w in WORDS) + " + (length(lower(text)) <= 220)::int"
PLACE = "list_position(['Actor', 'Action', 'Effect', 'Victim', 'Evidence'], label)"


@query(f"""{BANK}, r as (select *, {SALIENCE} as salience from bank),
e as (select doc_id, unnest(labels) as label from bank), f as (select * from e qualify row_number() over (partition by label order by doc_id) <= 1),
c as (select doc_id, arg_min(label, {PLACE}) as label from f group by 1),
rest as (select doc_id, null as label, salience, 'fill' as how, row_number() over (order by salience desc, doc_id) as nth from r where doc_id not in (select doc_id from c))
select doc_id, c.label, salience, 'label' as how from r join c using (doc_id) union all select doc_id, label, salience, how from rest where nth <= 12 - (select count(*) from c)""")
def per_label_examples(spark, d):
    return se.per_label_examples(_bank(spark, d), 12, WORDS).select("doc_id", "label", "salience", "how")


REASON = "case when n_spans = 1 then 'prototype_clean' when n_spans >= 4 then 'ambiguous_pair_x' else 'per_label_top' end"


@query(f"""{BANK}, x as (select doc_id, labels, {REASON} as reason, row_number() over (order by {H}, doc_id) as position from bank qualify position <= 60),
e as (select doc_id, position, unnest(labels) as label, case when starts_with(reason, 'prototype_clean') then 0 when reason = 'per_label_top' then 1 end as good from x),
b as (select label, doc_id from e where good is not null qualify row_number() over (partition by label order by good, position, doc_id) = 1),
ranks as (select doc_id, {PLACE} as r from b union all (select doc_id, 0 from x where len(labels) = 0 order by position limit 1) union all (select doc_id, 6 from x where starts_with(reason, 'ambiguous_pair_') order by position limit 1)),
one as (select doc_id, min(r) as r from ranks group by 1)
select x.doc_id, reason, (row_number() over (order by coalesce(r, 7), position))::int as place from x left join one using (doc_id) qualify place <= 8""")
def prototype_order(spark, d):
    reason = F.when(F.col("n_spans") == 1, "prototype_clean").when(F.col("n_spans") >= 4, "ambiguous_pair_x").otherwise("per_label_top")
    first = _bank(spark, d).select("doc_id", "labels", reason.alias("reason"), sm.shuffled("doc_id").alias("h")).orderBy("h", "doc_id").limit(60)
    first = first.withColumn("position", F.row_number().over(se.Window.partitionBy(F.lit(0)).orderBy("h", "doc_id")))
    return se.prototype_order(first).select("doc_id", "reason", "place")


PRIORS = f"""with {SPAN_TEXTS_SQL}, g as (select m.*, length(text) as n_text from marked m join (select doc_id, text from documents) using (doc_id)),
pri as (select label, avg(ln("end" - start)) as mu, stddev_samp(ln("end" - start)) as sd, avg(start / n_text) as m, greatest(var_samp(start / n_text), 1e-6) as v, quantile_cont("end" - start, 0.9) as q90, count(*) as n, count(distinct doc_id) as docs from g group by 1),
priors as (select label, round(mu, 6) as mu, round(case when sd = 0 then 1 else sd end, 6) as sigma, round(greatest(0.5, m * (m * (1 - m) / v - 1)), 6) as alpha, round(greatest(0.5, (1 - m) * (m * (1 - m) / v - 1)), 6) as beta,
  cast(floor(q90 + 1e-9) as bigint) as q90, round(n / (select count(*) from documents), 6) as spans_per_doc, round(n / docs, 6) as spans_per_doc_with from pri)"""


@query(f"{PRIORS} select * from priors")
def priors_with_rates(spark, d):
    docs = _docs(spark, d)
    return pf.priors_with_rates(marked(docs), docs.select("doc_id", F.length("text").alias("n_text")))


@query(f"""{PRIORS}, z as (select g.*, round(abs((ln(greatest(1, "end" - start)) - mu) / sigma), 6) as z_len, abs((ln(greatest(1, "end" - start)) - mu) / sigma) as z, abs(start / greatest(1, n_text) - alpha / (alpha + beta)) as p, q90 from g join priors using (label)),
ae as (select doc_id from marked group by 1 having bool_or(label = 'Action') and bool_or(label = 'Effect'))
select doc_id, label, start, "end", z_len, round(p, 6) as pos_dist, round(1.5 * (1 - least(3.0, z) / 3) + 1.5 * (1 - least(1.0, p)) + case when doc_id in (select doc_id from ae) then 1.0 else 0.0 end + 0.25 * ("end" - start <= q90)::int, 6) as score from z""")
def prior_closeness(spark, d):
    """Spans by how near they are to their label's usual length and mean place; the bonus is for documents with an Action and an Effect."""
    docs = _docs(spark, d)
    lengths = docs.select("doc_id", F.length("text").alias("n_text"))
    m = marked(docs)
    priors = pf.priors_with_rates(m, lengths).select("label", "mu", "sigma", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mode"), "q90")
    pairs = _bank(spark, d).where("has_ae")
    return se.closeness(m.drop("span_text"), priors, lengths, pairs)


@query()
def fewshot_for_document(spark, d):
    return se.fewshot_for_document(_bank(spark, d), 8)


@query(f"{BANK} select doc_id, round(0.1 * n_spans + 2.0 * has_ae::int + has_victim::int, 6)::double as score from bank order by score desc, doc_id limit 60")
def document_score_top(spark, d):
    """The pool of the best documents, three times as many as are wanted."""
    return se.document_score(_bank(spark, d)).orderBy(F.desc("score"), "doc_id").limit(60).select("doc_id", "score")


@query(f"""{BANK}, k as (select doc_id, case when n_spans = 0 then 'negative' when list_has_any(labels, ['Evidence', 'Victim']) then 'rare' else 'common' end as how from bank),
r as (select *, row_number() over (partition by how order by {H}, doc_id) as nth from k), q as (select least(12, count(*)) as rare from r where how = 'rare' and nth <= 20)
select doc_id, how from r, q where nth <= case how when 'rare' then rare when 'negative' then 20 else 20 - rare end""")
def rare_quotas(spark, d):
    return se.rare_quotas(_bank(spark, d), 40).select("doc_id", "how")


@query(f"""with {ANNOTATED_SQL}, t as (select doc_id, doc_label, {NORMAL_SQL} as t from annotated), c as (select doc_label, min(doc_id) over (partition by t) as component from t),
m as (select component, doc_label, count(*) as n from c group by 1, 2 qualify row_number() over (partition by component order by n desc, doc_label) = 1)
select component, doc_label, ((row_number() over (partition by doc_label order by md5('42:' || component), component) - 1) % 5)::int as fold from m""")
def component_folds(spark, d):
    a = exact_hash(annotated(spark, d)).select("doc_id", "doc_label", "text_hash")
    first = a.groupBy("text_hash").agg(F.min("doc_id").alias("component"))
    return se.component_folds(a.join(first, "text_hash"), 5)


@query(f"""with recursive w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> ''))) as t from documents where trim(text) <> ''),
m as (select doc_id, count(*) as m from w group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as n from w a join w b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
p as materialized (select x, y from c join m a on a.doc_id = x join m b on b.doc_id = y where n >= 0.8 * (a.m + b.m - n)),
ord as materialized (select doc_id, row_number() over (order by doc_id) as n, coalesce(l, []::bigint[]) as l from m left join (select y as doc_id, list(x) as l from p group by 1) using (doc_id)),
go as (select 0::bigint as n, []::bigint[] as kept union all select go.n + 1, case when list_has_any(go.kept, ord.l) then go.kept else list_append(go.kept, ord.doc_id) end from go join ord on ord.n = go.n + 1)
select unnest(kept) as doc_id from go where n = (select max(n) from go)""")
def greedy_jaccard(spark, d):
    return se.greedy_jaccard(_docs(spark, d)).select("doc_id")


DOUBLED = "(select doc_id, source, text from documents union all select doc_id, source, text || ' ' from documents)"


@query(f"""with r as (select *, lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) as t from {DOUBLED}), a as (select * from r qualify row_number() over (partition by doc_id, t order by text) = 1),
b as (select * from a qualify row_number() over (partition by t order by doc_id, text) = 1) select doc_id, md5(text) as h from b""")
def dedup_id_then_text(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", "text")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" "))))
    norm = F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n\f\x0B]+", " ")))
    return pf.dedup_by_id_then_text(twice, norm, [F.col("doc_id"), F.col("text")]).select("doc_id", F.md5("text").alias("h"))


@query(f"with {ANNOTATED_SQL} select min(doc_id) as doc_id, doc_label as label, source, count(*) as n from annotated group by trim(text), doc_label, source")
def dedup_triples(spark, d):
    """Text, label and rationale (here the source) together; the first stays."""
    a = annotated(spark, d).withColumn("t", F.md5(F.trim("text")))
    return a.groupBy("t", F.lower(F.trim("doc_label")).alias("label"), "source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("t")


@query("""select source, count(n_chars) as count, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, round(quantile_cont(n_chars, 0.25), 6) as q25, round(quantile_cont(n_chars, 0.5), 6) as q50, round(quantile_cont(n_chars, 0.75), 6) as q75, max(n_chars) as max from documents group by 1""")
def describe_lengths(spark, d):
    return pf.describe(_docs(spark, d), "n_chars", ["source"])


@query(f"""{BANK}, u as (select doc_id, unnest(labels) as name from bank)
select 'label' as kind, l.name, count(doc_id) as docs from (values ('Actor'), ('Action'), ('Effect'), ('Victim'), ('Evidence')) l(name) left join u using (name) group by 2
union all select 'types', len(labels)::varchar, count(*) from bank group by 2 union all select 'all', 'five', count(*) filter (len(labels) = 5) from bank""")
def marker_presence(spark, d):
    docs = _docs(spark, d)
    return pf.marker_presence(docs, marked(docs))


@query(f"""with {ANNOTATED_SQL}, f as (select doc_label, (row_number() over (partition by doc_label order by {H}, doc_id) - 1) % 5 as fold from annotated)
select fold::int as fold, count(*) filter (doc_label = 'conspiracy') as conspiracy, count(*) filter (doc_label = 'non') as "non", count(*) filter (doc_label = 'cant_tell') as cant_tell from f group by 1""")
def fold_pivot(spark, d):
    return pf.fold_pivot(sm.folds(annotated(spark, d), 5), ("conspiracy", "non", "cant_tell"))


@query(f"""with {SPANS_SQL}, r as (select doc_id, j, ['Yes', 'No', 'DROP_ME'][cast((n_chars // (j + 1) + j * doc_id) % 3 + 1 as bigint)] as label from documents, (values (0), (1), (2)) v(j)),
v as (select doc_id, label, count(*) as n from r group by 1, 2), b as (select doc_id, max(n) as top from v group by 1),
won as (select doc_id, min(label) as label from v join b using (doc_id) where n = top group by 1 having count(*) = 1),
m as (select doc_id, label, start, "end", count(distinct role) + bool_or(role = 'gold')::int as votes from spans group by 1, 2, 3, 4), k as (select doc_id, count(*) as n from m where votes * 2 >= 3 group by 1), a as (select distinct doc_id from spans)
select w.doc_id, w.label, coalesce(k.n, 0)::int as n_spans, a.doc_id is not null and k.n is null as has_conflict from won w left join k using (doc_id) left join a using (doc_id) where w.label <> 'DROP_ME'""")
def document_groups(spark, d):
    """Three annotators: two mark the gold spans and one the predicted ones; their labels come from the text's length and id."""
    docs = _docs(spark, d)
    per = spans(docs).groupBy("doc_id", "role").agg(F.collect_list(F.struct("label", "start", "end")).alias("spans"))
    names = F.array(F.lit("Yes"), F.lit("No"), F.lit("DROP_ME"))
    rows = docs.select("doc_id", "text", "source", "n_chars", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("annotator"))
    rows = rows.withColumn("label", F.element_at(names, ((F.floor(F.col("n_chars") / (F.col("annotator") + 1)) + F.col("annotator") * F.col("doc_id")) % 3 + 1).cast("int")))
    role = F.when(F.col("annotator") < 2, "gold").otherwise("pred")
    rows = rows.withColumn("role", role).join(per, ["doc_id", "role"], "left").withColumn("spans", F.coalesce("spans", F.expr("array()").cast(per.schema["spans"].dataType)))
    return pf.document_groups(rows).select("doc_id", "label", F.size("spans").alias("n_spans"), "has_conflict")


@query(f"""with t as (select doc_id, source, row_number() over (partition by source order by {H}, doc_id) as turn from documents), p as (select *, (row_number() over (order by turn, md5('42:' || source), source))::int as pick from t where turn <= 50) select doc_id, source, pick from p where pick <= 50""")
def one_per_key(spark, d):
    return se.round_robin(_docs(spark, d).select("doc_id", "source"), "source", 50, [sm.shuffled("doc_id"), F.col("doc_id")])


@query(f"""with {TOKENS_SQL}, k as (select *, i - row_number() over (partition by doc_id order by i) as island from tokens where length(tok) >= 6)
select doc_id, min(s) as start, max(s + length(tok)) as "end", count(*)::int as n, round(avg(length(tok) / 10.0), 6) as score from k group by doc_id, island""")
def token_runs(spark, d):
    return pf.token_runs(tokens(_docs(spark, d)), F.length("tok") >= 6, F.length("tok") / 10.0)


@query(f"""with {SPANS_SQL}, g as (select doc_id, label, start, "end", (start + "end") / 2.0 as p from spans where role = 'gold' and label = 'Action'),
a as (select g.*, t.i from g asof join tokens t on g.doc_id = t.doc_id and g.p >= t.s), per as (select doc_id, list({{'label': label, 'start': start, 'end': "end", 'i': i}}) as l from a group by 1),
w as (select doc_id, unnest(list_transform(l, lambda x: {{'label': x.label, 'start': x.start, 'end': x.end, 'window': array_to_string(list_slice(string_split(text, ' '), greatest(0, x.i - 12) + 1, x.i + 13), ' ')}})) as x from per join documents using (doc_id))
select doc_id, x.label as label, x.start as start, x.end as "end", x.window as window from w""")
def context_windows(spark, d):
    docs = _docs(spark, d)
    return pf.context_windows(spans(docs).where("role = 'gold' and label = 'Action'").drop("role"), tokens(docs), docs)


@query("""select doc_id, case when lower(regexp_replace(source, '^r/', '')) in ('conspiracy', 'highstrangeness') then 'Conspiracy Hub' else 'Mainstream/Neutral' end as hub,
case when regexp_replace(source, '^r/', '') in ('conspiracy', 'HighStrangeness', 'Wuhan_Flu', 'LockdownSkepticism') then 'conspiracy' when regexp_replace(source, '^r/', '') in ('news', 'worldnews', 'science', 'skeptic') then 'reporting' else 'unknown' end as zone from documents""")
def source_prior(spark, d):
    return _docs(spark, d).select("doc_id", pf.source_prior(F.col("source")).alias("p")).select("doc_id", "p.*")


@query("select doc_id, contains(lower(text), 'shanre') or contains(lower(text), 'ique ') or length(text) <= 220 as keep from documents")
def on_domain(spark, d):
    return _docs(spark, d).select("doc_id", pf.on_domain(F.col("text"), ("shanre", "ique ")).alias("keep"))


LISTS = {"hedges": ("the", "sur"), "epistemic": ("and", "des"), "vague": ("that", "les"), "named": ("in", "de"), "leading": ("tion", "anin")}
WS = "[ \\t\\r\\n\\f\\v]+"


@query(f"""with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '') as r, list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda x: x <> '') as l from documents),
c as (select *, greatest(len(r), 1) as n, len(list_filter(l, lambda x: x in ('the', 'sur'))) as h, len(list_filter(l, lambda x: x in ('and', 'des'))) as e, len(list_filter(l, lambda x: x in ('that', 'les'))) as v, len(list_filter(l, lambda x: x in ('in', 'de'))) as m,
  len(list_filter(r, lambda x: length(x) > 1 and upper(x) = x and lower(x) <> x)) as caps, length(text) - length(replace(text, '?', '')) as q, length(text) - length(replace(text, '.', '')) as dots, length(text) - length(replace(text, '!', '')) as bangs from w)
select doc_id, round(h / greatest(1.0, n * 0.05), 2)::double as uncertainty_ratio, round(q / greatest(1, dots + bangs + q), 2)::double as question_density, contains(lower(text), 'tion') or contains(lower(text), 'anin') as is_jaqing,
round(v / (m + 1), 2)::double as agency_gap, round(e / n * 100, 2)::double as epistemic_intensity, round(caps / n * 100, 2)::double as shouting_score from c""")
def forensic_profile(spark, d):
    return pf.forensic_profile(_docs(spark, d), LISTS).select("doc_id", "uncertainty_ratio", "question_density", "is_jaqing", "agency_gap", "epistemic_intensity", "shouting_score")


@query(f"""{BANK} select doc_id, (10 * (has_ae::int + has_victim::int) + 15 * has_ae::int + case when doc_label in ('conspiracy', 'non') then 10 else 0 end + 2 * least(n_spans, 5) + 3 * len(labels)
+ case when length(text) > 200 and length(text) < 600 then 5 when length(text) < 160 or length(text) > 800 then -10 else 0 end)::int as score from bank""")
def hard_score(spark, d):
    """Reasons are an Action with an Effect and a Victim; the former counts as the kind of overlap."""
    b = _bank(spark, d)
    ae, v = F.col("has_ae").cast("int"), F.col("has_victim").cast("int")
    return pf.hard_score(b, ae + v, ae, F.col("n_spans"), F.size("labels")).select("doc_id", "score")


@query("select doc_id, length(text) as n, length(text) >= 50 as long_enough from documents where length(text) > 10")
def short_documents_out(spark, d):
    n = F.length("text")
    return _docs(spark, d).where(n > 10).select("doc_id", n.alias("n"), (n >= 50).alias("long_enough"))


@query("select doc_id, n_chars from documents order by doc_id limit 25")
def first_documents(spark, d):
    """A limit, with an order."""
    return _docs(spark, d).orderBy("doc_id").limit(25).select("doc_id", "n_chars")


def _nearest(spark, d, k):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0")
    return rt.knn(v, q, k).join(v.select("vec_id", "embedding"), "vec_id")


@query(mmr_sql(40, 8, 0.6, "list_dot_product(c.v, mean) / size", -1.0) + "select query, p[i].id as vec_id, i as place from picks, range(1, 9) r(i)")
def mmr_centroid(spark, d):
    return rt.mmr_centroid(_nearest(spark, d, 40), 8)


@query(mmr_sql(40, 8, 0.5, "(c.score - low) / (high - low)", 0.0, "vec_id % 17") + "select query, p[i].id as vec_id, i as place from picks, range(1, 9) r(i)")
def mmr_quality(spark, d):
    return rt.mmr_quality(_nearest(spark, d, 40).withColumn("score", F.col("vec_id") % 17), 8)


@query(f"""select doc_id, md5(trim(regexp_replace(lower(translate(nfc_normalize(text), '‘’“”', '''''""')), '{WS}', ' ', 'g'))) as h from documents""")
def nfkc_keys(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.nfkc_key(F.col("text"))).alias("h"))


def _full_bank(spark, d):
    """All gold spans; the invented texts have few of the real kinds, so letters stand for them. A sixth of the documents count as having no
    spans, half of these as hard negatives."""
    docs = annotated(spark, d)
    g = span_texts(_docs(spark, d)).where("role = 'gold' and doc_id % 6 <> 1").drop("role")
    kinds = {"url": "x|q", "named": "^[A-Z]", "quote_attr": "['\"’]", "numeric_source": "[0-9]"}
    actors = {"vague_collective": "(?i)^the|^la|^der", "named_org": "[A-Z]{2}", "named_person": "^[A-Z][a-z]+ [A-Z]"}
    rows = bk.bank_signals(docs, g, F.length("span_text") / 10.0, kinds, actors)
    return rows.withColumn("pool", F.when(F.col("doc_id") % 12 == 1, "hard").when(F.col("n_spans") == 0, "clean")), g


@query()
def diversified_bank(spark, d):
    """A bank of ten examples for each language."""
    return bk.diversified_bank(_full_bank(spark, d)[0], "lang")


@query()
def diversified_bank_spans(spark, d):
    """What the examples of each language's bank show."""
    rows, g = _full_bank(spark, d)
    return bk.bank_spans(staged(bk.diversified_bank(rows, "lang"), "bank"), g).select("doc_id", "label", "start", "end")


@query()
def rare_quotas_diverse(spark, d):
    """The documents that have a vector of the same number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return se.rare_quotas_diverse(_bank(spark, d).join(vectors, "doc_id"), 16)
