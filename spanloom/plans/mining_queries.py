"""Queries that fit: errors of a baseline classifier, hard examples, and the temperature of a calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as mn
from ..operators import views
from .corpus_queries import PRED_SQL, _pred
from .registry import query


def _split(spark, d):
    """Labelled documents: a fifth of them, by id, is held out."""
    docs = views.annotated(spark, d).where("doc_label in ('conspiracy', 'non')").select("doc_id", "text", "doc_label")
    return docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")


def _errors(spark, d):
    return mn.confident_errors(*_split(spark, d), "conspiracy", "non")


@query()
def error_mining(spark, d):
    """Every held-out document with what the baseline says of it, and how surely."""
    return _errors(spark, d).select("doc_id", "doc_label", "predicted", F.round("confidence", 4).alias("confidence"), "confident_error")


@query()
def hard_example_reasons(spark, d):
    docs = views.annotated(spark, d)
    return mn.hard_examples(docs, views.spans(docs), _errors(spark, d), overlap=0.4)


@query(f"""with recursive {PRED_SQL}, z as materialized (select case when y = 1 then score * 4 - 2 else 2 - score * 4 end as z from pred),
steps as (
  select 0 as n, 1 / 5.0::double as a, 1 / 0.05::double as b, 0.0::double as best, 0.0::double as nll
  union all
  select n + 1, a + (b - a) * greatest(i - 1, 0) / 10, a + (b - a) * least(i + 1, 10) / 10, a + (b - a) * i / 10, m
  from (select n, a, b, arg_min(i, (m, i)) as i, min(m) as m from (
    select n, a, b, i, (select avg(greatest(-z * (a + (b - a) * i / 10), 0) + ln(1 + exp(-abs(z * (a + (b - a) * i / 10))))) from z) as m from steps, range(0, 11) r(i) where 1 / a - 1 / b >= 1e-5) group by n, a, b))
select (select count(*) from pred) as n, round(1 / best, 3) as temperature, round(nll, 6) as nll from steps order by steps.n desc limit 1""")
def temperature_fit(spark, d):
    """One row, as a fit has: the temperature at which the scores of all labelled documents are least surprised by their labels."""
    scored = _pred(spark, d).select("y", (F.col("score") * 4 - 2).alias("logit"))
    temperature, nll = mn.fit_temperature(scored)
    return scored.agg(F.count("*").alias("n")).select("n", F.lit(round(temperature, 3)).alias("temperature"), F.lit(round(nll, 6)).alias("nll"))
