"""Queries over votes, predictions, vectors, conversations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import sampling as sm
from ..operators import statistics as st
from ..operators import votes as vt
from ..operators.views import ANNOTATED_SQL, annotated, table
from .registry import ORACLE, query

# ---------------------------------------------------------------- votes: events as jurors' verdicts on users

VOTES_SQL = """votes as (select user_id as doc_id, event_type as juror, case when cast(floor(value * 100) as bigint) % 2 = 0 then 'yes' else 'no' end as verdict, (event_id % 101) / 100.0::double as confidence, event_id from events)"""


def _votes(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("juror"), F.when(F.floor(F.col("value") * 100) % 2 == 0, "yes").otherwise("no").alias("verdict"), (F.col("event_id") % 101 / F.lit(100.0)).alias("confidence"), "event_id")


COUNCIL_SQL = VOTES_SQL + """, agg as (select doc_id, count(*) filter (verdict = 'yes') as yes, count(*) filter (verdict = 'no') as no, round(coalesce(avg(case when verdict = 'yes' then confidence end), 0), 6) as yes_confidence, round(coalesce(avg(case when verdict = 'no' then confidence end), 0), 6) as no_confidence,
  round(sum(case when verdict = 'yes' then confidence else -confidence end), 6) as signed from votes group by 1),
council as (select *, round(least(yes, no) / (yes + no), 6) as dissent, case when least(yes, no) = 0 then 'unanimous' when greatest(yes, no) >= 3 then 'strong' else 'split' end as consensus from agg)"""


@query(f"with {COUNCIL_SQL} select * from council")
def council_aggregate(spark, d):
    return vt.council(_votes(spark, d))


@query(f"""with {COUNCIL_SQL}, c as (select *, round(greatest(coalesce(yes_confidence, 0), coalesce(no_confidence, 0)), 6) as confidence, case when yes >= no then 'yes' else 'no' end as majority from council)
select doc_id, majority as verdict, case when consensus in ('split', 'chaotic') then least(confidence, 0.75) else confidence end as confidence, case when consensus = 'split' and confidence < 0.65 then 'no' else majority end as lite from c""")
def damped_verdict(spark, d):
    c = vt.council(_votes(spark, d))
    conf = F.round(F.greatest(F.coalesce("yes_confidence", F.lit(0.0)), F.coalesce("no_confidence", F.lit(0.0))), 6)
    c = c.withColumns({"c": conf, "verdict": F.when(F.col("yes") >= F.col("no"), "yes").otherwise("no")})
    return c.select("doc_id", "verdict", vt.damped(F.col("c"), F.col("consensus")).alias("confidence"), vt.lite_rule(F.col("verdict"), F.col("c"), F.col("consensus")).alias("lite"))


@query(f"""with {COUNCIL_SQL} select doc_id, coalesce(yes_confidence, 0) <= 0.8 and consensus <> 'unanimous' as appeal, case when yes >= no then coalesce(yes_confidence, 0) between 0.45 and 0.55 else coalesce(no_confidence, 0) between 0.45 and 0.55 end as borderline from council""")
def appeal_route(spark, d):
    c = vt.council(_votes(spark, d))
    y, n = F.coalesce("yes_confidence", F.lit(0.0)), F.coalesce("no_confidence", F.lit(0.0))
    win = F.when(F.col("yes") >= F.col("no"), y).otherwise(n)
    flags = vt.override_flags(F.lit("yes"), F.lit("yes"), win)
    return c.select("doc_id", vt.appeal(y, F.col("consensus"), F.lit(False)).alias("appeal"), F.array_contains(flags, "borderline").alias("borderline"))


@query(f"""with {VOTES_SQL}, n as (select doc_id, verdict, count(*) as n, max(event_id % 50) as longest from votes group by 1, 2)
select doc_id, verdict, n from n qualify row_number() over (partition by doc_id order by n desc, longest desc, case verdict when 'yes' then 1 else 2 end) = 1""")
def label_vote(spark, d):
    v = _votes(spark, d).withColumn("rationale", F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")))
    return vt.label_vote(v)


@query(f"""with {VOTES_SQL}, s as (select doc_id, case when event_id % 3 <> 0 then confidence end as y, case when event_id % 3 <> 1 then 0.9 end as n from votes),
f as (select doc_id, coalesce(y, 1 - n, 0.5) as y, coalesce(n, 1 - y, 0.5) as n from s), a as (select doc_id, round(avg(y / case when y + n > 0 then y + n else 1 end), 6) as p_yes, count(*) as n from f group by 1)
select doc_id, p_yes, n, case when p_yes >= 0.5 then 'yes' else 'no' end as verdict from a""")
def prob_average(spark, d):
    v = _votes(spark, d)
    s = v.select("doc_id", F.when(F.col("event_id") % 3 != 0, F.col("confidence")).alias("p_yes"), F.when(F.col("event_id") % 3 != 1, F.lit(0.9)).alias("p_no"))
    return vt.average_probability(s)


@query(f"""with {VOTES_SQL}, n as (select doc_id, count(*) filter (verdict = 'yes') as yes, count(*) as n, case when doc_id % 2 = 0 then 'yes' else 'no' end as gold from votes group by 1)
select doc_id, round(case when case when yes * 2 >= n then 'yes' else 'no' end = gold then 1.0 else case gold when 'yes' then yes else n - yes end / n end, 6)::double as score from n""")
def graded_scores(spark, d):
    v = _votes(spark, d)
    gold = v.select("doc_id").distinct().withColumn("gold", F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no"))
    return vt.graded_score(v, gold)


@query("""with f as (select user_id as doc_id, event_type as flag from events) select doc_id, flag, count(*) as n from f group by 1, 2 having count(*) >= 2""")
def repeated_flags(spark, d):
    v = _votes(spark, d).withColumn("flags", F.array("juror"))
    return vt.repeated_flags(v)


@query("""select cast(sum(length(text)) as bigint) as tokens_in, cast(sum(turn) as bigint) as tokens_out, count(*) as requests, round(sum(length(text)) / 1e6 * 1.75 + sum(turn) / 1e6 * 14.0, 6) as cost from conversations""")
def usage_cost(spark, d):
    c = table(spark, d, "conversations")
    return vt.usage(c.select(F.length("text").cast("long").alias("tokens_in"), F.col("turn").cast("long").alias("tokens_out")))


# ---------------------------------------------------------------- predictions: toxic against a score of the id

PRED_SQL = "pred as (select doc_id, toxic as y, round((doc_id * 7919) % 1000 / 1000.0::double * 0.7 + toxic * 0.3::double, 9) as score, doc_id % 5 as fold from labels)"


def _pred(spark, d):
    score = (F.col("doc_id") * 7919) % 1000 / F.lit(1000.0) * 0.7 + F.col("toxic") * 0.3
    return table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), F.round(score, 9).alias("score"), (F.col("doc_id") % 5).alias("fold"))


METRICS = """round(case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) else 0 end, 6) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
  round(f1, 6) as f1, round((f1 + f0) / 2, 6) as macro_f1, round((f1 * (tp + fn) + f0 * (tn + fp)) / (tp + fp + fn + tn), 6) as weighted_f1"""
CONF = """count(*) filter (y = 1 and score >= 0.5) as tp, count(*) filter (y = 0 and score >= 0.5) as fp, count(*) filter (y = 1 and score < 0.5) as fn, count(*) filter (y = 0 and score < 0.5) as tn"""
F1S = "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, case when 2 * tn + fn + fp > 0 then 2 * tn / (2 * tn + fn + fp) else 0 end as f0"


@query(f"with {PRED_SQL}, c as (select {CONF} from pred), f as (select *, {F1S} from c) select tp, fp, fn, tn, {METRICS} from f")
def binary_metrics(spark, d):
    return ev.binary_metrics(_pred(spark, d).withColumn("p_label", (F.col("score") >= 0.5).cast("int")))


@query(f"""with {PRED_SQL}, k as (select score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from pred group by 1), b as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from k)
select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6)::double as auc, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from b""")
def auc(spark, d):
    return ev.auc(_pred(spark, d))


@query(f"""with {PRED_SQL}, t as (select unnest(range(1, 20)) * 0.05 as t0), g as (select round(t0, 2)::double as threshold from t),
c as (select threshold, count(*) filter (y = 1 and score >= threshold) as tp, count(*) filter (y = 0 and score >= threshold) as fp, count(*) filter (y = 1 and score < threshold) as fn from pred, g group by 1)
select *, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def threshold_sweep(spark, d):
    return ev.threshold_sweep(_pred(spark, d), [round(0.05 * i, 2) for i in range(1, 20)])


@query(f"""with {PRED_SQL}, c as (select fold, {CONF} from pred group by 1), f as (select *, {F1S} from c), m as (select fold, {METRICS} from f),
l as (select 'accuracy' as metric, accuracy as v from m union all select 'f1', f1 from m union all select 'macro_f1', macro_f1 from m) select metric, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, count(v) as folds from l group by 1""")
def cv_summary(spark, d):
    per = ev.binary_metrics(_pred(spark, d).withColumn("p_label", (F.col("score") >= 0.5).cast("int")), ["fold"])
    return ev.fold_summary(per, ["accuracy", "f1", "macro_f1"])


@query(f"""with {PRED_SQL}, t as (select unnest([0.25, 0.5, 1.0, 2.0, 4.0])::double as temperature) select temperature, round(avg(ln(1 + exp(-(case when y = 1 then 1 else -1 end) * (score * 4 - 2) / temperature))), 6) as nll from pred, t group by 1""")
def temperature_grid(spark, d):
    return ev.temperature_grid(_pred(spark, d).withColumn("logit", F.col("score") * 4 - 2), [0.25, 0.5, 1.0, 2.0, 4.0])


@query(f"""with {ANNOTATED_SQL}, s as (select doc_id, score from (with {PRED_SQL} select * from pred)), r as (select a.doc_id, 'misclassified' as reason from annotated a join (with {PRED_SQL} select * from pred) p using (doc_id) where (p.score >= 0.8 and y = 0) or (p.score < 0.2 and y = 1)
union all select doc_id, 'long' from annotated where length(text) > 5000), g as (select doc_id, string_agg(reason, ',' order by reason) as reasons from r group by 1) select * from g""")
def hard_examples(spark, d):
    p = _pred(spark, d)
    wrong = p.where("(score >= 0.8 and y = 0) or (score < 0.2 and y = 1)").select("doc_id", F.lit("misclassified").alias("reason"))
    long = table(spark, d, "documents").where(F.length("text") > 5000).select("doc_id", F.lit("long").alias("reason"))
    return wrong.unionByName(long).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))


# ---------------------------------------------------------------- vectors


def _queries(vectors):
    """Every row whose id is divisible by 50 is a query, against all rows."""
    return vectors.where("vec_id % 50 = 0")


SIM_SQL = "q as (select vec_id as query, label as qlabel, embedding as qe from embeddings where vec_id % 50 = 0), s as (select query, qlabel, vec_id, label, round(list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(qe, lambda x: x::double * x::double)))), 6) as sim from embeddings, q)"


@query(f"with {SIM_SQL} select query, vec_id, sim, (row_number() over (partition by query order by sim desc, vec_id))::int as rank from s where label = qlabel qualify rank <= 10")
def knn_filtered(spark, d):
    v = table(spark, d, "embeddings")
    return rt.knn(v, _queries(v), 10, tag="label")


@query(f"with {SIM_SQL}, f as (select * from s qualify row_number() over (partition by query order by sim desc, vec_id) <= 40), g as (select query, vec_id, sim, round(sim + label / 20.0, 6)::double as second from f) select *, (row_number() over (partition by query order by second desc, vec_id))::int as rank from g qualify rank <= 8")
def two_stage_topk(spark, d):
    v = table(spark, d, "embeddings")
    return rt.two_stage(v, _queries(v), 8, 5, F.col("sim") + F.col("label") / 20.0)


@query(f"with {SIM_SQL}, t as (select query, vec_id, sim from s qualify row_number() over (partition by query order by sim desc, vec_id) <= 20) select query, vec_id, sim, round(case when count(*) over w = 1 then 1.0 when max(sim) over w = min(sim) over w then 0.5 else (sim - min(sim) over w) / (max(sim) over w - min(sim) over w) end, 6) as norm from t window w as (partition by query)")
def minmax_scores(spark, d):
    v = table(spark, d, "embeddings")
    return rt.minmax(rt.knn(v, _queries(v), 20).drop("rank"), "sim", "query")


def mmr_sql(n: int, k: int, weight: float, relevance: str, first: float, score: str = "0") -> str:
    """Of each query's n nearest rows k in turn: a list of picks, to which each step adds the best of the others. l has all, mean the mean of their directions."""
    value = f"round({weight} * {relevance} - {round(1 - weight, 9)} * case when len(acc) = 0 then {first} else list_max(list_transform(acc, lambda a: list_dot_product(a.v, c.v))) end, 9)"
    best = f"list_sort(list_transform(list_filter(l, lambda c: not list_contains(list_transform(acc, lambda a: a.id), c.id)), lambda c: {{m: -({value}), id: c.id, c: c}}))[1].c"
    return f"""with {SIM_SQL}, top as (select * from s qualify row_number() over (partition by query order by sim desc, vec_id) <= {n}),
units as (select query, vec_id, sim, {score} as score, list_transform(embedding, lambda x: x::double / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) + 1e-10)) as v from top join embeddings using (vec_id)),
means as (select query, list(m order by i) as mean from (select query, i, avg(v[i]) as m from units, range(1, 65) r(i) group by 1, 2) group by 1),
lists as (select query, any_value(mean) as mean, sqrt(list_dot_product(any_value(mean), any_value(mean))) as size, min(score)::double as low, max(score)::double as high, list({{id: vec_id, sim: sim, score: score::double, v: v}} order by vec_id) as l from units join means using (query) group by 1),
picks as (select query, list_reduce(list_transform(range(0, {k + 1}), lambda i: list_slice(l, 1, 0)), lambda acc, x: list_concat(acc, [{best}])) as p from lists)
"""


@query(mmr_sql(50, 10, 0.6, "c.sim", 0.0) + "select query, p[i].id as vec_id, i as place, p[i].sim as sim from picks, range(1, 11) r(i)")
def mmr_select(spark, d):
    v = table(spark, d, "embeddings")
    return rt.mmr(rt.knn(v, _queries(v), 50).join(v.select("vec_id", "embedding"), "vec_id"), 10)


@query(f"""with {SIM_SQL}, p as (select query, vec_id, sim, case when label < 3 then 'low' when label <= 6 then 'mid' else 'high' end as stratum from s), r as (select *, (row_number() over (partition by query, stratum order by sim desc, vec_id))::int as turn from p),
c as (select * from r where turn <= case stratum when 'low' then 4 when 'mid' then 4 else 2 end) select query, vec_id, sim, stratum, turn, (row_number() over (partition by query order by turn, case stratum when 'low' then 0 when 'mid' then 1 else 2 end))::int as place from c qualify place <= 9""")
def stratified_retrieve(spark, d):
    v = table(spark, d, "embeddings")
    return rt.stratified(v, _queries(v), {"low": (F.col("label") < 3, 4), "mid": (F.col("label").between(3, 6), 4), "high": (F.col("label") > 6, 2)}, 9)


BALANCED_SQL = f"""with {SIM_SQL}, cases as (select unnest(['both', 'second', 'none']) as case_),
named as (select case_, query, vec_id, sim, label, case when label < 4 then 'con' when label < 7 then 'non' when label = 7 and case_ = 'both' then 'cant_tell' when label = 8 and case_ <> 'none' then 'ambiguous' end as kind, vec_id % 7 = 0 as proof from s, cases),
strata as (select *, case kind when 'con' then 'positive' when 'non' then 'negative' when 'cant_tell' then 'unclear0' else 'unclear1' end as stratum from named where kind is not null union all select *, 'evidence' from named where proof),
near as (select *, row_number() over (partition by case_, query, stratum order by sim desc, vec_id) as rank, case stratum when 'positive' then 3 when 'negative' then 4 when 'evidence' then 1 else 1 end as share from strata),
cut as (select *, count(*) over (partition by case_, query, stratum) as n, round(sim - label / 50.0, 6) as second from near where rank <= case stratum when 'evidence' then 1 else share * 3 end),
turns as (select *, row_number() over (partition by case_, query, stratum order by case when n <= share then rank end, second desc, vec_id) as turn, min(case when starts_with(stratum, 'unclear') then stratum end) over (partition by case_, query) as first from cut),
room as (select * from turns where turn <= case when stratum = 'negative' then share + case when first is null then 1 else 0 end when starts_with(stratum, 'unclear') and stratum <> first then 0 else share end),
kept as (select *, case when starts_with(stratum, 'unclear') then 'unclear' when stratum = 'evidence' then case when kind = 'con' then 'positive' else 'negative' end else stratum end as side from room qualify stratum <> 'evidence' or count(*) over (partition by case_, query, vec_id) = 1),
sides as (select *, row_number() over (partition by case_, query, side order by stratum = 'evidence', turn) as i, count(*) filter (side = 'positive') over (partition by case_, query) as p, count(*) filter (side = 'negative') over (partition by case_, query) as m, count(*) filter (side = 'unclear') over (partition by case_, query) as u from kept),
turned as (select *, case when i > least(p, m) then least(p, m) + i else 2 * i - case when side = 'positive' then 1 else 0 end end as t, least(p + m, 2) as behind from sides),
placed as (select *, (case when side = 'unclear' then behind + i else t + case when t > behind then u else 0 end end)::int as place from turned)
select case_ as "case", query, vec_id, sim, side, place from placed where place <= 8"""


@query(BALANCED_SQL)
def balanced_retrieve(spark, d):
    """Three cases: with both kinds of unclear rows, with the second only, and with none, when their share goes to the negative ones."""
    v = table(spark, d, "embeddings")
    q = _queries(v)
    out = []
    for case in ("both", "second", "none"):
        label = F.when(F.col("label") < 4, "con").when(F.col("label") < 7, "non").when((F.col("label") == 7) & F.lit(case == "both"), "cant_tell").when((F.col("label") == 8) & F.lit(case != "none"), "ambiguous")
        rows = v.withColumn("kind", label)
        found = rt.balanced(rows, q, 8, "con", "non", ("cant_tell", "ambiguous"), F.col("vec_id") % 7 == 0, F.col("sim") - F.col("label") / 50.0, label="kind")
        out.append(found.withColumn("case", F.lit(case)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"with {SIM_SQL}, f as (select * from s where label in (2, 5) qualify row_number() over (partition by query order by sim desc, vec_id) <= 16), g as (select query, vec_id, sim, round(sim + label / 20.0, 6)::double as second from f) select *, (row_number() over (partition by query order by second desc, vec_id))::int as rank from g qualify rank <= 4")
def hard_negatives(spark, d):
    """Rows of two labels stand for those that are marked as hard negatives."""
    v = table(spark, d, "embeddings")
    return rt.hard_negatives(v, _queries(v), F.col("label").isin(2, 5), 4, 4, F.col("sim") + F.col("label") / 20.0)


# ---------------------------------------------------------------- samples and folds

HASH = "md5('42:' || doc_id)"


@query(f"with {ANNOTATED_SQL} select doc_id, doc_label, ((row_number() over (partition by doc_label order by {HASH}, doc_id) - 1) % 5)::int as fold from annotated")
def folds(spark, d):
    return sm.folds(annotated(spark, d), 5).select("doc_id", "doc_label", "fold")


@query(f"with {ANNOTATED_SQL} select doc_id from annotated where doc_label = 'conspiracy' or ('0x' || substr({HASH}, 1, 8))::bigint / 4294967296.0 < 0.15")
def hash_sample(spark, d):
    return sm.hash_sample(annotated(spark, d), 0.15, F.col("doc_label") == "conspiracy").select("doc_id")


@query("select doc_id, source, row_number() over (partition by source order by length(text) desc, doc_id)::int as rank from documents qualify rank <= 3")
def per_key_quota(spark, d):
    return sm.per_key_quota(table(spark, d, "documents"), "source", 3, [F.desc(F.length("text")), F.col("doc_id")]).select("doc_id", "source", "rank")


@query("select conv_id, turn, role, row_number() over (partition by role order by conv_id, turn) as n_turn from conversations where role in ('user', 'assistant')")
def role_turns(spark, d):
    c = table(spark, d, "conversations")
    return sm.per_key_quota(c.where(F.col("role").isin("user", "assistant")), "role", 1 << 30, [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "role", F.col("rank").cast("long").alias("n_turn"))


@query(f"""with {ANNOTATED_SQL}, t as (select doc_id, doc_label, row_number() over (partition by doc_label order by {HASH}, doc_id) as turn from annotated where doc_label in ('conspiracy', 'non'))
select doc_id, doc_label, turn::int as turn, row_number() over (order by turn, case doc_label when 'conspiracy' then 1 else 2 end) as position from t""")
def interleave(spark, d):
    return sm.interleave(annotated(spark, d), "doc_label", [sm.shuffled("doc_id"), F.col("doc_id")], ["conspiracy", "non"]).select("doc_id", "doc_label", F.col("turn").cast("int").alias("turn"), "position")


@query(f"""with {ANNOTATED_SQL}, r as (select doc_id, doc_label, length(text) as n, row_number() over (partition by doc_label order by length(text) desc, doc_id) as rk from annotated),
q as (select *, rk <= case doc_label when 'conspiracy' then 40 when 'non' then 60 else 0 end as inq from r),
f as (select * from q where not inq order by n desc, doc_id limit greatest(0, 150 - (select count(*) from q where inq))) select doc_id, doc_label, 'quota' as how from q where inq union all select doc_id, doc_label, 'fill' from f""")
def quota_sample(spark, d):
    return sm.quota_sample(annotated(spark, d), {"conspiracy": 40, "non": 60}, 150, "doc_label", [F.desc(F.length("text")), F.col("doc_id")]).select("doc_id", "doc_label", "how")


@query(f"""with {ANNOTATED_SQL}, g as (select source as grp, doc_label, count(*) as n from annotated group by 1, 2), t as (select seed, grp, doc_label, n, ('0x' || substr(md5(seed || ':' || grp), 1, 8))::bigint / 4294967296.0 < 0.8 as inside from g, (select unnest(range(200)) as seed)),
s as (select seed, doc_label, sum(case when inside then n else 0 end) as a, sum(case when inside then 0 else n end) as b from t group by 1, 2), tt as (select seed, sum(a) as ta, sum(b) as tb from s group by 1),
l as (select seed, ta, tb, sum(abs(a / greatest(ta, 1) - b / greatest(tb, 1))) as l1 from s join tt using (seed) group by 1, 2, 3)
select seed, ta::bigint as n_in, tb::bigint as n_out, round(l1 + 0.5 * abs(ta / (ta + tb) - 0.8), 6)::double as objective from l order by objective, seed limit 1""")
def split_search(spark, d):
    groups = annotated(spark, d).groupBy(F.col("source").alias("grp"), "doc_label").agg(F.count("*").alias("n"))
    return sm.split_search(groups, 200, 0.8)


@query("""with r as (select source, doc_id as id, length(text)::double as v, unnest(range(1, 101)) as rep from documents),
u as (select *, ('0x' || substr(md5('42:' || rep || ':' || id), 1, 8))::bigint / 4294967296.0 as u from r),
w as (select *, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int as w from u),
m as (select source, rep, sum(w * v) / sum(w) as m from w group by 1, 2), ci as (select source, round(quantile_cont(m, 0.025) + 1e-7, 4) as low, round(quantile_cont(m, 0.975) + 1e-7, 4) as high from m group by 1),
a as (select source, round(avg(length(text)), 6) as mean, count(*) as n from documents group by 1) select source, mean, n, low, high from a join ci using (source)""")
def bootstrap_ci(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.length("text").cast("double").alias("v"))
    return sm.bootstrap_mean(docs, "v", "source", 100)


@query(ORACLE["split_search"].replace("range(200)", "range(500)"))
def split_search_500(spark, d):
    """split_search over as many splits as the reference."""
    groups = annotated(spark, d).groupBy(F.col("source").alias("grp"), "doc_label").agg(F.count("*").alias("n"))
    return sm.split_search(groups, 500, 0.8)


@query(ORACLE["bootstrap_ci"].replace("range(1, 101)", "range(1, 1001)"))
def bootstrap_ci_1000(spark, d):
    """bootstrap_ci over as many replicates as the reference."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.length("text").cast("double").alias("v"))
    return sm.bootstrap_mean(docs, "v", "source", 1000)


# ---------------------------------------------------------------- set operations on ids and vocabularies


@query("""with a as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from documents), b as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from benchmark)
select (select count(*) from (select w from a union select w from b)) as in_either, (select count(*) from (select w from a intersect select w from b)) as in_both, (select count(*) from (select w from b except select w from a)) as only_benchmark""")
def vocabulary_sets(spark, d):
    from ..functions.text import ascii_words

    words = lambda t: table(spark, d, t).select(F.explode(ascii_words(F.col("text"))).alias("w")).distinct()
    both = words("documents").withColumn("side", F.lit(1)).unionByName(words("benchmark").withColumn("side", F.lit(2))).groupBy("w").agg(F.sum("side").alias("sides"))
    return both.agg(F.count("*").alias("in_either"), F.count_if(F.col("sides") == 3).alias("in_both"), F.count_if(F.col("sides") == 2).alias("only_benchmark"))


@query("select p.page_id, d.doc_id, d.source, coalesce(d.source, 'none') as filled from pages p full join (select doc_id, source from documents) d on p.page_id = d.doc_id")
def full_outer_ids(spark, d):
    p, docs = table(spark, d, "pages").select("page_id"), table(spark, d, "documents").select("doc_id", "source")
    j = p.join(docs, p["page_id"] == docs["doc_id"], "full")
    return j.select("page_id", "doc_id", "source", F.coalesce("source", F.lit("none")).alias("filled"))
