"""Queries on judges and appeals, token matches with known documents only or with all, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical as lex
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..operators import statistics as st
from ..operators import views
from ..operators import votes as vt
from ..operators.views import SPAN_TEXTS_SQL, table
from .corpus_queries import COUNCIL_SQL, _votes
from .registry import ORACLE, query
from .span_queries import OV

JUDGE_SQL = COUNCIL_SQL + """, judged as (select *, case when yes_confidence > no_confidence then 'yes' else 'no' end as verdict, case when yes >= no then 'yes' else 'no' end as majority from council)"""


def _judged(spark, d):
    """A judge that follows the surer side, whatever the majority says."""
    c = vt.council(_votes(spark, d))
    return c.withColumns({"verdict": F.when(F.col("yes_confidence") > F.col("no_confidence"), "yes").otherwise("no"), "majority": F.when(F.col("yes") >= F.col("no"), "yes").otherwise("no")})


@query(f"with {JUDGE_SQL} select doc_id, verdict, consensus in ('split', 'chaotic') as borderline, verdict <> majority and consensus <> 'split' as override from judged")
def judge_flags(spark, d):
    c = _judged(spark, d)
    borderline, override = vt.judge_flags(F.col("verdict"), F.col("majority"), F.col("consensus"))
    return c.select("doc_id", "verdict", borderline.alias("borderline"), override.alias("override"))


@query(f"""with p as ({ORACLE['forensic_stats']}), v as (select p.*, case doc_id % 3 when 0 then 'no' when 1 then 'yes' else 'unsure' end as verdict from p)
select doc_id, case verdict when 'no' then case when is_jaqing then 'asks_questions' when epistemic_intensity * 500 > 1.5 then 'truth_terms' else 'structural_claims' end
  when 'yes' then case when shouting_score * 100 > 3.0 then 'shouting' when agency_gap * 50 < 0.2 then 'named_targets' else 'plain_causes' end end as diagnosis from v""")
def appeal_diagnosis(spark, d):
    """Profiles scaled up, as these texts have few of the words that are counted."""
    p = lex.profile(F.col("text"))
    verdict = F.when(F.col("doc_id") % 3 == 0, "no").when(F.col("doc_id") % 3 == 1, "yes").otherwise("unsure")
    found = vt.appeal_diagnosis(verdict, p["is_jaqing"], p["epistemic_intensity"] * 500, p["shouting_score"] * 100, p["agency_gap"] * 50)
    return table(spark, d, "documents").select("doc_id", found.alias("diagnosis"))


def _token_sql(gold: str, pred: str) -> str:
    """Gold spans touch disjoint ranges of tokens, so that each takes its best prediction; one prediction counts once."""
    return f"""with {SPAN_TEXTS_SQL}, r as materialized (select doc_id, role, case (length(tok) + i) % 5 when 0 then 'Actor' when 1 then 'Action' when 2 then 'Effect' when 3 then 'Victim' else 'Evidence' end as label, i as a, i + case role when 'gold' then i % 3 else i % 2 end + 1 as b from bodies where span_text is not null),
g as materialized (select * from r where role = 'gold' {gold}), p as materialized (select * from r where role = 'pred' {pred}),
c as (select g.doc_id, g.label, g.a as ga, p.a as pa, (least(g.b, p.b) - greatest(g.a, p.a)) / (greatest(g.b, p.b) - least(g.a, p.a)) as iou from g, (select unnest(range(-3, 4)) as k) k, p where p.doc_id = g.doc_id and p.label = g.label and p.a = g.a + k.k and greatest(g.a, p.a) < least(g.b, p.b)),
best as (select * from c where iou >= 0.5 qualify row_number() over (partition by doc_id, label, ga order by iou desc, pa) = 1),
hit as (select label, count(distinct (doc_id, pa)) as tp from best group by 1),
n as (select l.label, coalesce(tp, 0)::bigint as tp, ((select count(*) from p where p.label = l.label) - coalesce(tp, 0))::bigint as fp, ((select count(*) from g where g.label = l.label) - coalesce(tp, 0))::bigint as fn from (values ('Actor'), ('Action'), ('Effect'), ('Victim'), ('Evidence')) l(label) left join hit using (label))
select label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n"""


ORACLE["span_prf_token"] = _token_sql("", "").strip()  # all documents are known there


def _token_prf(spark, d, strict):
    docs = table(spark, d, "documents")
    known = docs.where("doc_id % 3 <> 0").select("doc_id")
    return ev.prf(ev.token_match(views.spans(docs), docs, known, strict))


@query(_token_sql("and doc_id % 3 <> 0", "and doc_id % 3 <> 0"))
def span_prf_token_known(spark, d):
    """Two thirds of the documents are annotated; what is predicted for the others is left out."""
    return _token_prf(spark, d, False)


@query(_token_sql("and doc_id % 3 <> 0", ""))
def span_prf_token_strict(spark, d):
    """As before, but predictions for documents that are not annotated are false."""
    return _token_prf(spark, d, True)


@query(OV + """, stats as (select pair, count(*) as n, avg(iou) as mean_iou, avg(case when iou >= 0.5 then 1.0 else 0 end) as iou_50 from named group by 1), ranked as (select *, (row_number() over (order by round(mean_iou, 6) desc, pair))::int as nth from stats)
select 'conflicts' as section, nth, pair || ': mean overlap ' || printf('%.2f', round(mean_iou, 6)) || ', strong in ' || printf('%.0f', round(iou_50, 6) * 100) || '% of ' || n as line from ranked where nth <= 4""")
def conflict_report(spark, d):
    pairs = st.overlap_pair_stats(st.overlap_pairs(views.spans(table(spark, d, "documents")).drop("role")))
    return rp.conflict_lines(pairs).select(F.lit("conflicts").alias("section"), F.col("rank").alias("nth"), "line")


@query()
def policy_report(spark, d):
    """Everything that is known of the gold spans, as lines."""
    docs = table(spark, d, "documents")
    gold = views.spans(docs).where("role = 'gold'").drop("role")
    places = st.position_priors(gold, docs.select("doc_id", F.length("text").alias("n_text")))
    priors = st.length_priors(gold).join(places, "label").join(st.span_quantile(gold).withColumnRenamed("q", "q90"), "label")
    pairs = st.overlap_pair_stats(st.overlap_pairs(views.spans(docs).drop("role")))
    return rp.policy(priors, pairs, st.boundary_context(gold, docs))
