"""Queries on tokens, mark-up, addresses, merged banks and the texts of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import duplicates as dup
from ..operators import selection as se
from ..operators import spans as sp
from ..operators import statistics as st
from ..operators import views as vw
from ..operators.staging import scratch
from ..operators.views import ANNOTATED_SQL, SPAN_TEXTS_SQL, annotated, span_texts, table
from ..sources import readers as rd
from .registry import query

W = f"with {SPAN_TEXTS_SQL}"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _docs(spark, d):
    return table(spark, d, "documents")


@query(rf"""with t as (select doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) as tok, unnest(list_slice(regexp_split_to_array(text, '{TOKEN}'), 1, len(regexp_extract_all(text, '{TOKEN}')))) as gap, generate_subscripts(regexp_extract_all(text, '{TOKEN}'), 1) - 1 as i from documents)
select doc_id, i::int as i, (sum(length(gap) + length(tok)) over w - length(tok))::bigint as start, (sum(length(gap) + length(tok)) over w)::bigint as "end" from t window w as (partition by doc_id order by i)""")
def token_offsets(spark, d):
    """Words and marks of whole texts, where they stand."""
    return vw.token_offsets(_docs(spark, d))


MARKDOWN_SQL = "'# ' || source || chr(10) || chr(10) || '**Submission Statement:** see [the ' || lang || ' page](https://x.org/a) with `code here`, __strong__ and *soft* words' || chr(10) || '> quoted &amp; <b>bold</b>' || chr(10) || '- item ' || text"


def _markdown(spark, d):
    c = F.concat(F.lit("# "), "source", F.lit("\n\n**Submission Statement:** see [the "), "lang", F.lit(" page](https://x.org/a) with `code here`, __strong__ and *soft* words\n> quoted &amp; <b>bold</b>\n- item "), "text")
    return _docs(spark, d).select("doc_id", c.alias("md"))


def _markdown_sql(c: str) -> str:
    """The steps of markdown_text, with the other engine's marks for groups."""
    c = rf"regexp_replace({c}, '(?s)```.*?```', ' ', 'g')"
    for pattern, by in ((r"`[^`\n]*`", " "), (r"!\[[^\]\n]*\]\([^)\n]*\)", " "), (r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1"), (r"(?m)^ {0,3}(#{1,6} +|> ?|[-*+] +|[0-9]+[.] +)", ""), (r"\*\*([^*\n]+)\*\*", r"\1"), (r"\*([^*\n]+)\*", r"\1"), (r"__([^_\n]+)__", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    c = rf"regexp_replace({c}, '(?is)<(script|style|pre|code)\b[^>]*>.*?</(script|style|pre|code)>', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return rf"trim(regexp_replace({c}, '[ \t\r\n\f\x0B]+', ' ', 'g'))"


@query(f"select doc_id, md5({_markdown_sql(MARKDOWN_SQL)}) as text_md5 from documents")
def markdown_text(spark, d):
    """Every text as an item of a list below a heading, a link, code and emphasis."""
    return _markdown(spark, d).select("doc_id", F.md5(tx.markdown_text(F.col("md"))).alias("text_md5"))


@query(rf"""with m as (select doc_id, {_markdown_sql("'**Submission Statement:** ' || text || ' http://x.org/' || doc_id || ', the end'")} as t from documents)
select doc_id, md5(trim(regexp_replace(regexp_replace(t, 'http(.+)?(\W|$)', '<URL>', 'g'), '(?i)^[^\p{{L}}\p{{N}}_]*(summary statement|submission statement|ss)[^a-zA-Z]*', ''))) as text_md5 from m""")
def clean_comments(spark, d):
    """The whole clean-up: mark-up, addresses with what follows them, and the prefix."""
    raw = F.concat(F.lit("**Submission Statement:** "), "text", F.lit(" http://x.org/"), F.col("doc_id").cast("string"), F.lit(", the end"))
    return _docs(spark, d).select("doc_id", F.md5(tx.clean_comment(raw)).alias("text_md5"))


@query(r"select doc_id, md5(regexp_replace('see http://a.org/x?' || doc_id || ' and more, last' || chr(10) || 'next https' || chr(10) || text, 'http(.+)?(\W|$)', '<URL>', 'g')) as text_md5 from documents")
def url_tails(spark, d):
    """An address takes the rest of its line with it, and a bare http as well."""
    raw = F.concat(F.lit("see http://a.org/x?"), F.col("doc_id").cast("string"), F.lit(" and more, last\nnext https\n"), "text")
    return _docs(spark, d).select("doc_id", F.md5(tx.replace_urls(raw)).alias("text_md5"))


@query(f"""with {ANNOTATED_SQL}, a as (select text, min(doc_id) as pos, arg_min(n_chars, doc_id) as markers from annotated where doc_id % 3 <> 0 and text <> '' group by 1),
b as (select text, min(doc_id) as pos, arg_max(case when doc_label = 'cant_tell' then 'non' else doc_label end, doc_id) as doc_label, arg_max(case when doc_id % 4 = 0 then '' else source end, doc_id) as rationale from annotated where doc_id % 2 = 0 and text <> '' group by 1),
m as (select coalesce(a.text, b.text) as text, markers, doc_label, rationale, a.pos is null as late, coalesce(a.pos, b.pos) as pos from a full join b on a.text = b.text)
select md5(text) as text_md5, markers, doc_label, rationale, row_number() over (order by late, pos) as place from m""")
def merge_banks(spark, d):
    """Two thirds of the documents with a number for their spans, half of them with labels: equal texts are one example."""
    docs = annotated(spark, d)
    a = docs.where("doc_id % 3 <> 0").select("text", F.col("n_chars").alias("markers"), F.col("doc_id").alias("position"))
    label = F.when(F.col("doc_label") != "cant_tell", F.col("doc_label"))
    b = docs.where("doc_id % 2 = 0").select("text", label.alias("doc_label"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("rationale"), F.col("doc_id").alias("position"))
    return dc.merge_banks(a, b).select(F.md5("text").alias("text_md5"), "markers", "doc_label", "rationale", "place")


CUE, MYTH = "(?i)tion|ment|ique", "(?i)shan|ouèr"


@query(f"""with {ANNOTATED_SQL}, g as (select *, len(regexp_extract_all(text, '{CUE}')) as cues, regexp_matches(text, '{MYTH}') as debunk, length(text) - length(replace(text, '?', '')) as qmarks from annotated),
s as (select doc_id, doc_label, round(3.0 * cues + least(length(text) / 400.0, 1.0) - case when debunk then 4.0 else 0.0 end - 0.5 * qmarks, 6)::double as yes, round(least(length(text) / 400.0, 1.0) + case when debunk then 2.0 else 0.0 end + case when cues > 0 and not debunk then 1.0 else 0.0 end - 0.2 * qmarks, 6)::double as no from g),
picked as ((select doc_id, doc_label from s where doc_label = 'conspiracy' order by yes desc, doc_id limit 100) union all (select doc_id, doc_label from s where doc_label = 'non' order by no desc, doc_id limit 101)),
rest as (select doc_id, doc_label, row_number() over (order by md5('fill:' || doc_id), doc_id) as nth from s where doc_id not in (select doc_id from picked))
select doc_id, doc_label, 'score' as how from picked union all select doc_id, doc_label, 'fill' from rest where nth <= 201 - (select count(*) from picked)""")
def score_halves(spark, d):
    """More than there are conspiracies in the smallest table, so that some come from the rest."""
    scored = se.class_scores(se.cue_signals(annotated(spark, d), CUE, MYTH))
    return se.halves_by_score(scored, 201).select("doc_id", "doc_label", "how")


@query("""with f as (select string_agg(doc_id::varchar || ' ' || md5(coalesce(text, '')), chr(10) order by doc_id) || chr(10) as body from documents group by source, doc_id % 16)
select octet_length(encode(body))::bigint as bytes, sha256(body) as sha256, substr(body, 1, 200) as preview from f""")
def fingerprints(spark, d):
    """Sixteen files for each source with its documents' digests, in order; then each file's size, SHA-256 and first bytes."""
    at = scratch(spark, "files")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.md5(F.coalesce("text", F.lit(""))))
    rows = _docs(spark, d).select("source", (F.col("doc_id") % 16).alias("part"), "doc_id", line.alias("value"))
    rows.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").select("source", "part", "value").write.partitionBy("source", "part").text(at)
    return rd.fingerprints(spark, f"{at}/*/*/*.txt").select("bytes", "sha256", "preview")


@query("""with kept as (select * from documents qualify row_number() over (partition by md5(trim(text)) order by doc_id) = 1)
select source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, 'before' as phase from documents group by source
union all select source, count(*), round(count(*) / sum(count(*)) over (), 6), 'after' from kept group by source""")
def source_drift(spark, d):
    docs = _docs(spark, d)
    kept = docs.join(dup.first_by_text(docs).select("doc_id"), "doc_id", "left_semi")
    return st.drift(docs, kept, label="source")


@query(f"""{W}, x as (select doc_id, case when start % 5 = 0 then start + 1 when start % 5 = 1 then -1 - start else start end as s, case when start % 5 = 0 then "end" + 1 when start % 5 = 2 then "end" + 1000000 else "end" end as e, span_text from span_texts where role = 'gold'),
j as (select x.*, s >= 0 and s < e and e <= length(text) as ok, substr(text, cast(greatest(s, 0) + 1 as bigint), cast(greatest(e - s, 0) as bigint)) as there from x join documents using (doc_id)),
n as (select count(*) as total, count(*) filter (ok) as in_bounds, count(*) filter (ok and there = span_text) as exact from j)
select total, in_bounds, exact, round(in_bounds / total, 6) as in_bounds_rate, round(exact / total, 6) as exact_rate from n""")
def offset_rates(spark, d):
    """A fifth of the spans are one character off, a fifth begin before their text and a fifth end behind it."""
    docs = _docs(spark, d)
    fifth = F.col("start") % 5
    start = F.when(fifth == 0, F.col("start") + 1).when(fifth == 1, -1 - F.col("start")).otherwise(F.col("start"))
    end = F.when(fifth == 0, F.col("end") + 1).when(fifth == 2, F.col("end") + 1_000_000).otherwise(F.col("end"))
    g = span_texts(docs).where("role = 'gold'").select("doc_id", start.alias("s"), end.alias("e"), "span_text")
    return st.offset_rates(g.withColumnsRenamed({"s": "start", "e": "end"}), docs)


@query(f"""{W}, r as (select *, start - lag("end") over w as gap from span_texts where role = 'pred' window w as (partition by doc_id, label order by start, "end")),
i as (select *, sum(case when gap between 0 and 2 then 0 else 1 end) over (partition by doc_id, label order by start, "end") as island from r)
select doc_id, label, min(start) as start, arg_max("end", (start, "end")) as "end", string_agg(span_text, ' ' order by start, "end") as span_text, count(*) as n from i group by doc_id, label, island""")
def merge_adjacent_texts(spark, d):
    return sp.merge_adjacent_texts(span_texts(_docs(spark, d)).where("role = 'pred'"), ["doc_id", "label"])


@query(f"""{W}, x as (select doc_id, label, start, "end", case when start % 3 = 0 then lower(span_text) when start % 3 = 1 and role = 'gold' then null else span_text end as span_text from span_texts),
c as (select doc_id, label, start, "end", span_text, count(*) as n from x group by all),
v as (select doc_id, label, start, "end", sum(n)::bigint as votes, arg_min(span_text, (-n, span_text)) filter (coalesce(span_text, '') <> '') as span_text from c group by 1, 2, 3, 4)
select *, (row_number() over (partition by doc_id order by votes desc, "end" - start desc, start, list_position(['Actor', 'Action', 'Effect', 'Victim', 'Evidence'], label) desc))::int as rank from v qualify rank <= 4""")
def ranked_votes(spark, d):
    """The spans of all annotators; some say it in lower case, some say nothing."""
    said = F.when(F.col("start") % 3 == 0, F.lower("span_text")).when((F.col("start") % 3 == 1) & (F.col("role") == "gold"), F.lit(None)).otherwise(F.col("span_text"))
    return sp.ranked_votes(span_texts(_docs(spark, d)).withColumn("span_text", said))


@query(f"""with {ANNOTATED_SQL} select doc_id, case when doc_id % 5 = 4 then case when doc_label = 'cant_tell' then null else 'non' end when doc_id % 5 = 3 then null else case doc_label when 'cant_tell' then case when doc_id % 5 = 2 then 'non' end else doc_label end end as label from annotated""")
def label_values(spark, d):
    """Labels in structs: under label, under value, in both (label counts), in neither, and beside a plain key."""
    a = annotated(spark, d)
    said = F.when(F.col("doc_label") == "conspiracy", "Yes").when(F.col("doc_label") == "non", "No")
    fifth = F.col("doc_id") % 5
    label = F.when(fifth.isin(0, 2), said).when(fifth == 1, "").when((fifth == 4) & said.isNotNull(), "No")
    value = F.when(fifth.isin(1, 4), said).when(fifth == 2, "No")
    rows = a.select("doc_id", F.struct(label.alias("label"), value.alias("value")).alias("conspiracy_label"))
    return rows.select("doc_id", dc.label_value(rows).alias("label"))
