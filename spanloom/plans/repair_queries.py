"""Queries that gate, split, repair, locate and score predicted spans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import location as lc
from ..operators import profiles as pf
from ..operators import repair as rp
from ..operators import rules as rl
from ..operators import spans as sp
from ..operators import statistics as st
from ..operators.views import SPAN_TEXTS_SQL, marked, span_texts, spans, table, tokens
from .registry import query

W = f"with {SPAN_TEXTS_SQL}"
TRIM = "trim(span_text)"
KEYS = 'doc_id, label, start, "end"'


def _docs(spark, d):
    return table(spark, d, "documents")


def _texts(spark, d):
    return span_texts(_docs(spark, d))


@query(f"""{W} select {KEYS}, role from span_texts join (select doc_id, source from documents) using (doc_id) where not (label = 'Actor' and (lower(span_text) in ('the', 'and', 'sur') or ((contains(lower(span_text), 'tion') or contains(lower(span_text), 'ment')) and not contains(lower(source), 'e'))))""")
def guard_rails(spark, d):
    """With words that the invented texts have; a document's source stands for the reason given."""
    s = _texts(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return rp.guard_rails(s, F.col("source"), ("the", "and", "sur"), ("tion", "ment"), "e").select("doc_id", "label", "start", "end", "role")


VERB, SAID, COUNTS = "(?i)(tion|ment|the)", "(?i)(e|a)", "[0-9]"
EVIDENCE = f"""regexp_matches({TRIM}, '(?i)https?://|www[.]|[a-z0-9-]+[.](com|org|net|gov|edu)([^a-z0-9_]|$)') or ((contains({TRIM}, '"') or contains({TRIM}, '''') or contains({TRIM}, '“') or contains({TRIM}, '”') or regexp_matches({TRIM}, '{COUNTS}')) and regexp_matches({TRIM}, '{SAID}'))"""
GATE = f"""span_text is not null and length({TRIM}) >= 3 and not (len(list_filter(regexp_split_to_array({TRIM}, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')) = 1 and lower({TRIM}) in ('to', 'of', 'and', 'the', 'you', 'them', 'it', 'he', 'she', 'they', 'we', 'us'))
and case label when 'Evidence' then {EVIDENCE} when 'Action' then regexp_matches({TRIM}, '{VERB}') when 'Effect' then true else not regexp_matches({TRIM}, '(?i)^(is|are|was|were|be|do|did|does|to)([^a-z0-9_]|$)') end"""


def _gated(s, q=None):
    return rp.quality_gate(s, q, VERB, SAID, COUNTS)


@query(f"""{W}, q as (select label, floor(1.2 * greatest(8, floor(quantile_cont("end" - start, 0.9) + 1e-9))) as most from span_texts where role = 'gold' group by 1)
select {KEYS} from span_texts join q using (label) where role = 'pred' and {GATE} and (label = 'Evidence' or "end" - start <= most)""")
def quality_gate(spark, d):
    """Predicted spans, with patterns that the invented texts have, and lengths of the gold spans."""
    s = _texts(spark, d)
    gold = s.where("role = 'gold'")
    q90 = pf.priors_with_rates(gold, _docs(spark, d).select("doc_id", F.length("text").alias("n_text"))).select("label", "q90")
    return _gated(s.where("role = 'pred'"), q90).select("doc_id", "label", "start", "end")


PURPOSE = "(the|sur|and)"
SPLIT = f"""cut as (select *, case when label = 'Action' then regexp_extract(span_text, '(?is)^(.*?(?:^|[^a-z0-9_])){PURPOSE}(?:[^a-z0-9_].*)?$', ['head', 'marker']) end as m from span_texts where role = 'gold'),
parts as (select *, m is not null and m.marker <> '' as hit, length(m.head) as h, ltrim(substr(span_text, length(m.head) + length(m.marker) + 1)) as tail from cut),
split_spans as (select doc_id, label, start, case when hit and h >= 3 then start + h else "end" end as "end", case when hit and h >= 3 then m.head else span_text end as span_text from parts
  union all select doc_id, 'Effect', "end" - length(tail), "end", tail from parts where hit and h >= 3 and length(tail) >= 3)"""


@query(f"{W}, {SPLIT} select {KEYS}, span_text from split_spans")
def split_purposes(spark, d):
    return rp.split_purposes(_texts(spark, d).where("role = 'gold'").drop("role"), ("the", "sur", "and")).select("doc_id", "label", "start", "end", "span_text")


@query(f"{W}, {SPLIT} select {KEYS} from split_spans where \"end\" - start >= case label when 'Effect' then 7 when 'Evidence' then 5 else 3 end")
def role_lengths(spark, d):
    return rp.long_enough(rp.split_purposes(_texts(spark, d).where("role = 'gold'").drop("role"), ("the", "sur", "and"))).select("doc_id", "label", "start", "end")


# The first kept span that x may not overlap, by number: Actor and Victim never meet, Victim and Action only if the Victim is short and inside.
CLASH = """list_position(list_transform(acc, lambda k: greatest(k.s, x[1].s) < least(k.e, x[1].e) and ((k.l, x[1].l) in (('Actor', 'Victim'), ('Victim', 'Actor')) or ((k.l, x[1].l) in (('Action', 'Victim'), ('Victim', 'Action'))
  and not case when k.l = 'Victim' then x[1].s <= k.s and k.e <= x[1].e and k.e - k.s <= 24 else k.s <= x[1].s and x[1].e <= k.e and x[1].e - x[1].s <= 24 end))), true)"""
STAYS = "(acc[c].l = 'Actor' and x[1].l = 'Victim') or (not (acc[c].l = 'Victim' and x[1].l = 'Actor') and x[1].e - x[1].s <= acc[c].e - acc[c].s)"


@query(f"""{W}, lists as (select doc_id, list([{{l: label, s: start, e: "end"}}] order by start, "end" desc, label) as l from span_texts group by 1),
kept as (select doc_id, unnest(list_reduce(l, lambda acc, x: list_transform([coalesce({CLASH}, 0)], lambda c: case when c = 0 then list_concat(acc, x) when {STAYS} then acc else list_concat(list_filter(acc, lambda k, i: i <> c), x) end)[1])) as k from lists)
select doc_id, k.l as label, k.s as start, k.e as "end" from kept""")
def overlap_policy(spark, d):
    return rp.overlap_policy(spans(_docs(spark, d)).drop("role"))


def _priors(spark, d):
    """Lengths and places of the gold spans, by label."""
    docs = _docs(spark, d)
    gold = spans(docs).where("role = 'gold'")
    return rl.priors_of(st.length_priors(gold), st.position_priors(gold, docs.select("doc_id", F.length("text").alias("n_text"))))


@query()
def postprocess_spans(spark, d):
    """All predicted spans, their places one character off, through the whole chain."""
    docs = _docs(spark, d)
    off = spans(docs).drop("role").withColumn("end", F.col("end") + 1)
    return rl.postprocess(off, docs, _priors(spark, d), st.span_quantile(spans(docs).where("role = 'gold'")).withColumnRenamed("q", "q90"))


@query()
def pair_rule_spans(spark, d):
    docs = _docs(spark, d)
    return rl.apply_pair_rules(spans(docs).drop("role"), docs, _priors(spark, d)).drop("span_text")


@query()
def role_conflicts(spark, d):
    docs = _docs(spark, d)
    return rl.resolve_roles(spans(docs).drop("role"), docs, _priors(spark, d)).drop("span_text")


@query()
def permissive_policy(spark, d):
    docs = _docs(spark, d)
    return rl.permissive_policy(spans(docs).drop("role"), docs).drop("span_text")


@query(f"""{W}, p as (select doc_id, list({{'label': label, 'start': start, 'end': "end", 'said': span_text}}) as l from span_texts where role = 'pred' group by 1),
x as (select doc_id, length(text) as n, unnest(list_transform(l, lambda s: {{'label': s.label, 'start': s.start + 2, 'end': s.end + 2, 'said': s.said, 'lo': greatest(0, s.start + 2 - 40), 'at': instr(substr(text, greatest(0, s.start + 2 - 40) + 1, least(length(text), s.end + 2 + 40) - greatest(0, s.start + 2 - 40)), s.said)}})) as s from p join documents using (doc_id))
select doc_id, s.label as label, s.start as start, s.end as "end", 'ok' as status, s.lo + s.at - 1 as new_start, s.lo + s.at - 1 + length(s.said) as new_end, s.at - 1 + s.lo <> s.start as snapped, s.said as slice from x""")
def validate_and_repair(spark, d):
    """Offsets two too great, and what the span says: they move to the first such text nearby."""
    docs = _docs(spark, d)
    items = _texts(spark, d).where("role = 'pred'").select("doc_id", "label", (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"), F.col("span_text").alias("said"))
    return rp.validate_and_repair(items, docs).drop("said")


@query(f"""{W}, p as (select doc_id, label, start, "end", span_text, start % 4 as kind from span_texts where role = 'gold'),
m as (select doc_id, kind, case kind when 0 then 'Nobody' else label end as label, case kind when 2 then start + 1000000 when 3 then start + 2 else start end as start, case kind when 2 then "end" + 1000000 when 3 then "end" + 2 else "end" end as "end",
  start as s, "end" as e, span_text, case kind when 1 then '§§§' else span_text end as said, greatest(0, start + 2 - 40) as lo, text from p join documents using (doc_id)),
f as (select *, lo + instr(substr(text, cast(lo + 1 as bigint), cast(least(length(text), e + 2 + 40) - lo as bigint)), said) - 1 as pos from m)
select doc_id, label, start, "end", case kind when 0 then 'badkeys' when 1 then 'mismatch' when 2 then 'oob' else 'ok' end as status, case kind when 0 then null when 3 then pos else start end as new_start,
  case kind when 0 then null when 3 then pos + length(said) else "end" end as new_end, kind = 3 and pos <> start as snapped, case kind when 1 then span_text when 3 then said end as slice from f""")
def validate_every_status(spark, d):
    """A quarter of the spans have an unknown label, a quarter say what is not there, a quarter lie behind their text, and a quarter are two
    characters off."""
    docs = _docs(spark, d)
    kind = F.col("start") % 4
    g = _texts(spark, d).where("role = 'gold'")
    off = F.when(kind == 2, 1_000_000).when(kind == 3, 2).otherwise(0)
    items = g.select("doc_id", F.when(kind == 0, "Nobody").otherwise(F.col("label")).alias("label"), (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"), F.when(kind == 1, "§§§").otherwise(F.col("span_text")).alias("said"))
    return rp.validate_and_repair(items, docs).drop("said")


@query(f"""{W}, g as (select *, {TRIM} as t, len(list_filter(regexp_split_to_array({TRIM}, '[ \\t\\r\\n\\f\\v]+'), lambda w: w <> '')) as words from span_texts),
timed as (select *, words <= 6 and regexp_matches(t, '(?i)\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b|\\b(19|20)\\d{{2}}\\b|\\b\\d+ (seconds|minutes|hours|days|weeks|months|years)\\b|\\b(today|yesterday|tomorrow|recently|now|ago)\\b') as timed from g),
k as (select * from timed where words >= 2 and not (label in ('Victim', 'Effect') and timed) and not (label = 'Evidence' and words <= 2 and (regexp_matches(t, 'https?://|www\\.') or timed)))
select {KEYS} from k qualify row_number() over (partition by doc_id, t order by case label when 'Evidence' then 0 else 1 end, start, "end", label) = 1""")
def span_hygiene(spark, d):
    return rp.hygiene(_texts(spark, d).drop("role").distinct()).select("doc_id", "label", "start", "end")


@query(f"""{W} select doc_id, role, label, start, (case label when 'Evidence' then 2 * (regexp_matches({TRIM}, '(?i)https?://|<url>|www\\.')::int + regexp_matches({TRIM}, '["“”]')::int + regexp_matches({TRIM}, '[0-9]')::int + regexp_matches({TRIM}, '(^|[^A-Za-zÀ-ÿ0-9_])[A-Z][a-z]+ [A-Z][a-z]+([^A-Za-zÀ-ÿ0-9_]|$)')::int)
when 'Action' then 2 * regexp_matches({TRIM}, '{VERB}')::int + (len(regexp_split_to_array({TRIM}, '[ \\t\\r\\n\\f\\v]+')) >= 2)::int when 'Effect' then 2 * (starts_with(lower({TRIM}), 'to ') or starts_with(lower({TRIM}), 'in order to ') or starts_with(lower({TRIM}), 'so that ') or starts_with(lower({TRIM}), 'so as to ') or starts_with(lower({TRIM}), 'for the purpose of '))::int + (len(regexp_split_to_array({TRIM}, '[ \\t\\r\\n\\f\\v]+')) >= 3)::int
when 'Victim' then regexp_matches({TRIM}, '(?i)(^|[^a-z0-9_])(victim|people|citizens|children|us|we|them)([^a-z0-9_]|$)')::int else 0 end)::int as score from span_texts""")
def span_scores(spark, d):
    return rp.span_scores(_texts(spark, d), VERB).select("doc_id", "role", "label", "start", "score")


OVERLAPS = """o as (select doc_id, label, start, "end", row_number() over (partition by doc_id order by start, "end", label, role) as rn from span_texts),
near as (select a.doc_id, (a.start <= b.start and b."end" <= a."end") or (b.start <= a.start and a."end" <= b."end") as nested from o a, (select unnest(range(1, 13)) as k) k, o b where b.doc_id = a.doc_id and b.rn = a.rn + k.k and greatest(a.start, b.start) < least(a."end", b."end") and (a.start, a."end", a.label) < (b.start, b."end", b.label))"""


@query(f"""{W}, {OVERLAPS}, c as (select doc_id, count(*) as n_overlap, count(*) filter (nested) as n_nested from near group by 1),
s as (select doc_id, count(*) as n_spans, count(distinct label) as n_labels, (bool_or(label = 'Action') and bool_or(label = 'Effect'))::int as ae from span_texts group by 1)
select doc_id, coalesce(n_spans, 0) as n_spans, coalesce(n_overlap, 0) as n_overlap, coalesce(n_nested, 0) as n_nested, coalesce(n_labels, 0) as n_labels, coalesce(ae, 0) as ae from documents left join s using (doc_id) left join c using (doc_id)""")
def complexity(spark, d):
    """Spans, overlaps, nested pairs, labels, and whether an Action meets an Effect: what examples are ordered by."""
    docs = _docs(spark, d)
    s = spans(docs)
    has = lambda x: F.max((F.col("label") == x).cast("int"))
    labels = s.groupBy("doc_id").agg(F.countDistinct("label").alias("n_labels"), F.least(has("Action"), has("Effect")).alias("ae"))
    p = st.doc_overlap_profile(s, docs.select("doc_id")).select("doc_id", "n_spans", "n_overlap", "n_nested")
    return p.join(labels, "doc_id", "left").withColumns({"n_labels": F.coalesce("n_labels", F.lit(0)), "ae": F.coalesce("ae", F.lit(0))})


@query(f"""{W}, k as (select * from span_texts where role = 'gold' and not (length(span_text) < 3 or lower({TRIM}) = '' or regexp_extract(lower({TRIM}), '^([a-z0-9_]+|[^a-z0-9_ ])', 1) in ('the', 'and', 'sur') or (label = 'Victim' and regexp_matches(lower({TRIM}), '^\\$?[0-9][0-9,]*([.][0-9]+)?( *(k|m|b|million|billion))?$'))))
select {KEYS}, (row_number() over (partition by doc_id, label order by case when label in ('Action', 'Effect') then 3 when label in ('Actor', 'Victim') then 2 else 1 end + 1 / (1 + ("end" - start) / 10.0::double) desc, start, "end"))::int as rank from k qualify rank <= 3""")
def prune_markers(spark, d):
    return rp.prune(_texts(spark, d).where("role = 'gold'"), 3, ("the", "and", "sur")).select("doc_id", "label", "start", "end", "rank")


QUOTES = f"""{W}, q as (select doc_id, list({{'label': label, 'start': start, 'quote': case when label in ('Actor', 'Action') then 'zzzq ' || span_text else span_text end, 'plain': span_text}}) as l from marked group by 1),
x as (select doc_id, unnest(list_transform(l, lambda s: {{'label': s.label, 'at': s.start, 'quote': s.quote, 'start': instr(text, s.plain) - 1, 'n': length(s.plain)}})) as s from q join documents using (doc_id))"""


def _quotes(spark, d):
    extra = F.when(F.col("label").isin("Actor", "Action"), F.concat(F.lit("zzzq "), "span_text")).otherwise(F.col("span_text"))
    docs = _docs(spark, d)
    return marked(docs).select("doc_id", "label", F.col("start").alias("at"), extra.alias("quote")).join(docs.select("doc_id", "text"), "doc_id")


@query(f"""{QUOTES} select doc_id, s.label as label, s.at as at, s.start as start, s.start + s.n as "end", case when starts_with(s.quote, 'zzzq ') then 'leading' else 'whole' end as how from x""")
def recover_quotes(spark, d):
    """Quotes of which some begin with a word that the text has not."""
    return rp.recover(_quotes(spark, d)).select("doc_id", "label", "at", "start", "end", "how")


@query(f"""{QUOTES} select doc_id, s.label as label, s.quote as quote, case when starts_with(s.quote, 'zzzq ') then 'missing' else 'short' end as violation from x where starts_with(s.quote, 'zzzq ')""")
def quote_violations(spark, d):
    return rp.violations(_quotes(spark, d))


@query(f"""{W}, r as (select doc_id, label, span_text as quote, row_number() over (partition by doc_id, label, span_text order by start) as nth from marked), q as (select doc_id, list({{'label': label, 'quote': quote, 'nth': nth}}) as l from r group by 1),
p as (select doc_id, unnest(list_transform(l, lambda s: {{'label': s.label, 'quote': s.quote, 'parts': string_split(text, s.quote), 'nth': s.nth}})) as s from q join documents using (doc_id)),
k as (select doc_id, s.label as label, s.quote as quote, case when len(s.parts) > s.nth then s.nth else 1 end as n, s.parts as parts from p)
select distinct doc_id, label, quote, cast(list_sum(list_transform(list_slice(parts, 1, n), lambda x: length(x))) + (n - 1) * length(quote) as bigint) as start, cast(list_sum(list_transform(list_slice(parts, 1, n), lambda x: length(x))) + n * length(quote) as bigint) as "end" from k""")
def ordinal_positions(spark, d):
    """The first, second ... time that a label has a text is its first, second ... place."""
    docs = _docs(spark, d)
    nth = F.row_number().over(Window.partitionBy("doc_id", "label", "span_text").orderBy("start"))
    return rp.nth_positions(marked(docs).select("doc_id", "label", F.col("span_text").alias("quote"), nth.alias("nth")), docs)


@query(f"""{W}, v as materialized (select distinct doc_id, label, start, "end", span_text from span_texts), a as materialized (select doc_id, start, "end", unnest(range(start // 64, ("end" - 1) // 64 + 1)) as cell from v where label = 'Action' and "end" > start),
bad as materialized (select distinct x.doc_id, x.start, x."end" from (select *, start // 64 as cell from v where label = 'Victim' and regexp_matches({TRIM}, '^[A-Za-z]+$')) x join a on a.doc_id = x.doc_id and a.cell = x.cell and a.start <= x.start and x."end" <= a."end")
select {KEYS} from v where label <> 'Victim' union all select {KEYS} from v anti join bad using (doc_id, start, "end") where label = 'Victim'""")
def embedded_victims_out(spark, d):
    s = _texts(spark, d).drop("role").distinct()
    return rp.without_embedded_victims(s, "^[A-Za-z]+$").select("doc_id", "label", "start", "end")


@query()
def rich_scores(spark, d):
    s = marked(_docs(spark, d))
    t = _texts(spark, d).where("role = 'pred'").where(F.col("span_text").rlike("^[A-Z]")).drop("role")
    return rp.rich_scores(s, t)


@query("select doc_id, 'No' as conspiracy, 0 as n_markers from documents")
def baseline_submission(spark, d):
    """The commonest answer and no spans."""
    return _docs(spark, d).select("doc_id", F.lit("No").alias("conspiracy"), F.size(F.array().cast("array<string>")).alias("n_markers"))


# Gold spans here never overlap one another, nor do predicted ones of one document and label beyond their neighbours: the greedy match is
# that each takes its best candidate, and a prediction counts once.
PRF = f"""{W}, g as (select * from span_texts where role = 'gold'), p as (select * from span_texts where role = 'pred'),
u as (select doc_id, label, role, start, "end", row_number() over (partition by doc_id, label order by start, "end", role) as rn from span_texts),
c as (select g.doc_id, g.label, g.start as sg, p.start as sp, p."end" as ep, (least(g."end", p."end") - greatest(g.start, p.start)) / (greatest(g."end", p."end") - least(g.start, p.start)) as iou
  from u g, (select unnest(range(-6, 7)) as k) k, u p where g.role = 'gold' and p.role = 'pred' and p.doc_id = g.doc_id and p.label = g.label and p.rn = g.rn + k.k and greatest(g.start, p.start) < least(g."end", p."end")),
b as (select * from c where iou >= 0.5 qualify row_number() over (partition by doc_id, label, sg order by iou desc, sp, ep) = 1),
hit as (select label, count(distinct (doc_id, sp, ep)) as tp from b group by 1),
n as (select l.label, coalesce(tp, 0) as tp, (select count(*) from p where p.label = l.label) - coalesce(tp, 0) as fp, (select count(*) from g where g.label = l.label) - coalesce(tp, 0) as fn from (values ('Actor'), ('Action'), ('Effect'), ('Victim'), ('Evidence')) l(label) left join hit using (label)),
prf as (select label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n)"""
NAMES = ("Action", "Actor", "Effect", "Evidence", "Victim")
WIDE = ", ".join(f"max({c}) filter (label = '{x}') as {p}_{x}" for x in NAMES for p, c in (("F1", "f1"), ("Precision", "precision"), ("Recall", "recall")))


@query(f"""{PRF} select round(avg(f1), 6) as F1_Macro, round(sum(2 * tp) / sum(2 * tp + fp + fn), 6) as F1_Aggregate, round(sum(tp) / sum(tp + fp), 6) as Precision_Aggregate, round(sum(tp) / sum(tp + fn), 6) as Recall_Aggregate, {WIDE} from prf""")
def score_export(spark, d):
    """The nineteen named scores in one row."""
    s = spans(_docs(spark, d))
    per = ev.prf(sp.greedy_match(s.where("role = 'gold'"), s.where("role = 'pred'")))
    return ev.export_scores(per)


@query(f"{W} select doc_id, role, start, contains(lower(span_text), 'http') or contains(lower(span_text), 'www.') or contains(lower(span_text), 'according to') or regexp_matches(span_text, '[\"‘’“”]') as cited, starts_with(ltrim(lower(span_text)), 'the ') or starts_with(ltrim(lower(span_text)), 'sur ') as purpose, {EVIDENCE} as evidence from span_texts")
def span_gates(spark, d):
    t = F.col("span_text")
    return _texts(spark, d).select("doc_id", "role", "start", tx.looks_cited(t).alias("cited"), tx.starts_purpose(t, ("the ", "sur ")).alias("purpose"), tx.is_evidence(t, SAID, COUNTS).alias("evidence"))


CLIP = f"""{W}, p as (select doc_id, list({{'label': label, 'start': start, 'end': "end"}}) as l from span_texts where role = 'gold' group by 1),
x as (select doc_id, unnest(list_transform(l, lambda s: {{'label': s.label, 'start': least(length(text), greatest(0, 2 * s.start - 10)), 'end': least(length(text), greatest(0, 2 * s.start - 10 + 3 * (s.end - s.start))), 'text': text}})) as s from p join documents using (doc_id)),
k as (select doc_id, s.label as label, s.start as start, s.end as "end", substr(s.text, s.start + 1, s.end - s.start) as slice from x where s.end > s.start)"""


def _clipped(spark, d):
    """Gold spans with offsets that are wrong and often outside the text."""
    moved = spans(_docs(spark, d)).where("role = 'gold'").select("doc_id", "label", (2 * F.col("start") - 10).alias("start"), (2 * F.col("start") - 10 + 3 * (F.col("end") - F.col("start"))).alias("end"))
    return rp.clip(moved, _docs(spark, d))


@query(f"{CLIP} select {KEYS} from k")
def clip_and_validate(spark, d):
    return _clipped(spark, d).select("doc_id", "label", "start", "end")


@query(f"{CLIP} select {KEYS}, slice from k where \"end\" - start >= 3")
def clip_and_slice(spark, d):
    return _clipped(spark, d).where(F.col("end") - F.col("start") >= 3)


@query(f"""{W}, t as (select doc_id, i, tok from tokens), q as (select m.doc_id, m.label, m.start, m.span_text, b.tok as before from marked m join tokens k on k.doc_id = m.doc_id and k.s = m.start join t b on b.doc_id = m.doc_id and b.i = k.i - 1),
p as (select doc_id, list({{'label': label, 'at': start, 'q': span_text, 'b': before}}) as l from q where before <> '' and not regexp_matches(before || span_text, '[\\t\\r\\n\\f\\v]') group by 1),
x as (select doc_id, unnest(list_transform(l, lambda s: {{'label': s.label, 'at': s.at, 'start': length(regexp_extract(text, '(?s)^(.*?' || regexp_escape(s.b) || '\\s*)' || array_to_string(list_transform(string_split(s.q, ' '), lambda w: regexp_escape(w)), '\\s+'), 1)), 'n': length(s.q)}})) as s from p join documents using (doc_id))
select doc_id, s.label as label, s.at as at, s.start as start, s.start + s.n as "end" from x""")
def locate_by_context(spark, d):
    """Quotes with the word before them: where both stand together first."""
    docs = _docs(spark, d)
    t = tokens(docs)
    before = t.select("doc_id", (F.col("i") + 1).alias("i"), F.col("tok").alias("before"))
    at = t.select("doc_id", "i", F.col("s").alias("start")).join(before, ["doc_id", "i"])
    q = marked(docs).join(at, ["doc_id", "start"]).where("before <> ''").where(~F.concat("before", "span_text").rlike(r"[\t\r\n\f\x0B]"))
    rows = q.select("doc_id", "label", F.col("start").alias("at"), "before", F.col("span_text").alias("quote"), F.lit("").alias("after"))
    return lc.locate_in_context(rows, docs).select("doc_id", "label", "at", "start", "end")
