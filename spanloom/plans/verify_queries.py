"""Queries that verify quoted spans against their documents."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import verify as vf
from ..operators.spans import with_pieces
from ..operators.views import SPAN_TEXTS_SQL, span_texts, table
from .registry import query


def _quotes(spark, d):
    """What all spans say, in their documents' order, gold before predicted. Of thirteen, one is in capitals, one has wide blanks and curly
    quotes, one a letter too many."""
    s = span_texts(table(spark, d, "documents"))
    by = Window.partitionBy("doc_id").orderBy("role", "start", "end", "label")
    s = s.withColumn("nr", F.row_number().over(by))
    kind = F.col("nr") % 13
    wide = F.replace(F.replace("span_text", F.lit(" "), F.lit("  ")), F.lit("'"), F.lit("’"))
    quote = F.when(kind == 3, F.upper("span_text")).when(kind == 5, wide).when(kind == 7, F.concat("span_text", F.lit("x"))).otherwise(F.col("span_text"))
    return s.select("doc_id", "nr", "label", quote.alias("quote"))


@query()
def verify_ordinal(spark, d):
    return vf.verify_ordinal(_quotes(spark, d), table(spark, d, "documents"), bare=("the", "of", "de", "and")).drop("quote")


@query()
def verify_in_context(spark, d):
    """A fifth of the quotes lack the words before, a fifth those after, and a fifth have neither."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    from_ = lambda s: F.greatest(F.lit(0), s["start"] - 20)
    near = {"before": lambda t, s: t.cut(from_(s), s["start"] - from_(s)), "after": lambda t, s: t.cut(s["end"], F.lit(20))}
    s = with_pieces(span_texts(docs).where("role = 'gold'"), docs, near)
    s = s.withColumn("nr", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label")))
    kind = F.col("nr") % 5
    near = {"before": F.when(kind.isin(1, 3), "").otherwise(F.col("before")), "after": F.when(kind.isin(2, 3), "").otherwise(F.col("after"))}
    quote = F.when(kind == 4, F.upper("span_text")).otherwise(F.col("span_text"))
    return vf.verify_in_context(s.withColumns(near | {"quote": quote}).select("doc_id", "nr", "label", "quote", "before", "after"), docs).drop("quote", "before", "after")


@query(f"""with {SPAN_TEXTS_SQL}, q as (select doc_id, label, span_text, row_number() over (partition by doc_id order by role, start, "end", label) as nr from span_texts),
w as (select doc_id, label, nr, case when nr % 3 = 0 then span_text || 'x' when nr % 3 = 1 then translate(span_text, '{ascii_lowercase}', '{ascii_uppercase}') else span_text end as quote from q),
f as (select w.*, case when strpos(text, quote) > 0 then strpos(text, quote) when strpos(text, 'İ') = 0 and strpos(quote, 'İ') = 0 then strpos(lower(text), lower(quote)) else 0 end as pos, strpos(text, quote) > 0 as exact from w join documents using (doc_id) where quote <> '')
select doc_id, nr, label, case when pos > 0 then pos - 1 else -1 end as start, case when pos > 0 then pos - 1 + length(quote) else -1 end as "end", case when exact then 'exact' when pos > 0 then 'folded' else 'none' end as how,
  case when pos = 0 then 'missing' when row_number() over (partition by doc_id, label, pos, length(quote) order by nr) > 1 then 'repeated' else 'kept' end as status from f""")
def verify_first(spark, d):
    """A third of the spans in capitals (a to z: engines differ in others), a third with a letter too many; these texts have plain quotes
    and single blanks."""
    q = span_texts(table(spark, d, "documents"))
    by = Window.partitionBy("doc_id").orderBy("role", "start", "end", "label")
    q = q.withColumn("nr", F.row_number().over(by).cast("long"))
    quote = F.when(F.col("nr") % 3 == 0, F.concat("span_text", F.lit("x"))).when(F.col("nr") % 3 == 1, F.translate("span_text", ascii_lowercase, ascii_uppercase)).otherwise(F.col("span_text"))
    q = q.select("doc_id", "nr", "label", quote.alias("quote")).where("quote <> ''")
    return vf.verify_first(q, table(spark, d, "documents")).drop("quote")
