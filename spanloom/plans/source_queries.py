"""Round trips through files and streams, and the small functions that records pass through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import text as tx
from ..operators import documents as dc
from ..operators import retrieval as rt
from ..operators.staging import scratch, staged
from ..operators.views import ANNOTATED_SQL, SPANS_SQL, annotated, spans, table
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming import streams as sr
from .registry import query

RECORD = "doc_id long, text string, source string"
DOCS = "select doc_id, md5(text) as h, source from documents"


def _docs(spark, d):
    return table(spark, d, "documents")


def _at(spark, name):
    return scratch(spark, name)


def _hashed(df):
    return df.select("doc_id", F.md5("text").alias("h"), "source")


@query(DOCS)
def jsonl_round_trip(spark, d):
    at = _at(spark, "jsonl")
    wr.write_jsonl(_docs(spark, d).select("doc_id", "text", "source"), at)
    return _hashed(rd.read_jsonl(spark, at, RECORD))


@query(DOCS)
def jsonl_strict(spark, d):
    at = _at(spark, "strict")
    wr.write_jsonl(_docs(spark, d).select("doc_id", "text", "source"), at)
    return _hashed(rd.read_jsonl(spark, at, RECORD, strict=True))


@query(f"{DOCS} where doc_id % 7 <> 3")
def jsonl_damaged(spark, d):
    """Every seventh line is cut in two: it is left out."""
    at = _at(spark, "damaged")
    lines = _docs(spark, d).select("doc_id", F.to_json(F.struct("doc_id", "text", "source")).alias("j"))
    lines.select(F.when(F.col("doc_id") % 7 == 3, F.substring("j", 1, 9)).otherwise(F.col("j")).alias("value")).write.text(at)
    return _hashed(rd.read_jsonl(spark, at, RECORD))


@query(DOCS)
def jsonl_repaired(spark, d):
    """Lines with something around the braces."""
    at = _at(spark, "repair")
    _docs(spark, d).select(F.concat(F.lit("log: "), F.to_json(F.struct("doc_id", "text", "source")), F.lit(" ;")).alias("value")).write.text(at)
    return _hashed(rd.read_jsonl_repaired(spark, at, RECORD))


@query("select r_name as doc_id, md5(r_name || chr(10) || 'second line' || chr(10)) as h from region")
def whole_files(spark, d):
    """A file for each region."""
    at = _at(spark, "files")
    for r in table(spark, d, "region").orderBy("r_regionkey").limit(100).collect():  # a table of a few rows
        spark.createDataFrame([(f"{r['r_name']}\nsecond line",)], "value string").coalesce(1).write.text(f"{at}/{r['r_name']}")
    return rd.read_texts(spark, f"{at}/*", part=-2).select("doc_id", F.md5("text").alias("h"))


@query("select doc_id, source, n_chars from documents")
def csv_round_trip(spark, d):
    at = _at(spark, "csv")
    wr.write_csv(_docs(spark, d).select("doc_id", "source", "n_chars"), at)
    return rd.read_csv(spark, at, "doc_id long, source string, n_chars long")


@query("select source, count(*) as n from documents group by 1")
def summary_round_trip(spark, d):
    """Counts written as JSON and read back, through the pointer to the latest such folder."""
    at, pointer = _at(spark, "summary"), _at(spark, "pointer")
    wr.write_summary(_docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), at)
    spark.createDataFrame([(at,)], "value string").coalesce(1).write.text(pointer)
    return spark.read.schema("source string, n long").json(rd.latest(spark, pointer))


@query("select count(*) as n from region")
def json_with_default(spark, d):
    """A path that is not there gives the default."""
    return rd.read_json(spark, _at(spark, "missing"), table(spark, d, "region")).agg(F.count("*").alias("n"))


@query("select count(*) as n, sum(doc_id)::bigint as total from documents")
def json_with_default_found(spark, d):
    """Files that are there count, and not the default: one array for each sixteenth of a source."""
    at = _at(spark, "found")
    each = _docs(spark, d).groupBy("source", (F.col("doc_id") % 16).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id"))).alias("value"))
    each.write.partitionBy("source", "part").text(at)
    return rd.read_json(spark, at, table(spark, d, "region")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@query(DOCS)
def append_missing(spark, d):
    """Half of the documents are there already, and all are offered, twice."""
    at = _at(spark, "append")
    docs = _docs(spark, d).select("doc_id", "text", "source")
    wr.append_missing(docs.where("doc_id % 2 = 0"), at, "doc_id")
    for _ in range(2):
        wr.append_missing(docs, at, "doc_id")
    return _hashed(rd.read_jsonl(spark, at, RECORD))


@query("select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source, case when doc_id % 3 = 0 then doc_id else n_chars end as n_chars from documents union all select -1 - doc_id, 'new', -1 - doc_id from documents where doc_id % 5 = 0")
def upsert(spark, d):
    """A third of the rows change, and some are new."""
    docs = _docs(spark, d).select("doc_id", "source", "n_chars")
    changes = docs.where("doc_id % 3 = 0").select("doc_id").unionByName(docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id")))
    return wr.upsert(docs, changes.withColumns({"source": F.lit("new"), "n_chars": F.col("doc_id")}), "doc_id", ["source", "n_chars"])


@query("select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source from documents")
def metadata_update(spark, d):
    docs = _docs(spark, d).select("doc_id", "source")
    changes = docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id"))).withColumn("source", F.lit("new"))
    return wr.update_metadata(docs, changes, "doc_id", ["source"])


@query("select vec_id, label from embeddings where label = 3")
def vector_collection(spark, d):
    return rd.collection(table(spark, d, "embeddings"), label=3).select("vec_id", "label")


@query("select count(distinct text) as n, count(distinct text) filter (doc_id % 2 = 1) as other from documents where doc_id % 2 = 1 or true")
def response_cache(spark, d):
    """Answers to all texts, given twice: the cache has one for each."""
    docs = _docs(spark, d)
    answers = docs.select(F.col("text").alias("prompt"), F.lit("yes").alias("response"))
    cache = staged(wr.cache_add(spark.createDataFrame([], "key string, response string"), answers.where(F.lit(True))))
    cache = wr.cache_add(cache, answers)
    odd = docs.where("doc_id % 2 = 1").select(F.sha2("text", 256).alias("key")).distinct()
    return cache.agg(F.count("*").alias("n")).join(cache.join(odd, "key", "left_semi").agg(F.count("*").alias("other")))


@query("select doc_id, case when doc_id % 7 = 0 then 'not_found' when doc_id % 7 = 1 then 'invalid_body' when doc_id % 7 = 2 then 'empty_body' when doc_id % 7 = 3 then 'deleted' when doc_id % 7 = 4 then 'removed' else 'kept' end as reason from documents")
def rehydrate(spark, d):
    """What became of each id whose text was asked for."""
    docs = _docs(spark, d)
    k = F.col("doc_id") % 7
    fetched = docs.where(k != 0).select("doc_id", F.when(k == 1, F.lit(None)).when(k == 2, "  ").when(k == 3, "[deleted]").when(k == 4, " [removed] ").otherwise(F.concat(F.lit("t "), "text")).alias("body"))
    good, bad = rd.rehydrate(docs.select("doc_id"), fetched, "doc_id")
    return good.select("doc_id", F.lit("kept").alias("reason")).unionByName(bad.select("doc_id", "reason"))


@query("select exists(select 1 from labels where quality is not null) as labelled, false as none")
def label_sniffing(spark, d):
    labels = table(spark, d, "labels")
    return spark.createDataFrame([(rd.has_labels(labels, F.col("quality")), rd.has_labels(labels, F.lit(None)))], "labelled boolean, none boolean")


@query("select source, count(*) as bytes from documents group by 1 having count(*) > 0")
def package_round_trip(spark, d):
    """Rows in a zip file's JSON lines, read back by the driver: of a bounded report."""
    import os
    import tempfile
    import zipfile

    rows = _docs(spark, d).groupBy("source").agg(F.count("*").alias("bytes"))
    handle, path = tempfile.mkstemp(suffix=".zip")  # the driver's own, and gone at the end
    os.close(handle)
    try:
        wr.package(rows, path, "rows.jsonl")
        with zipfile.ZipFile(path) as z:
            lines = z.read("rows.jsonl").decode().splitlines()
    finally:
        os.remove(path)
    return spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", "source string, bytes long").alias("r")).select("r.*")


# ---------------------------------------------------------------- records


@query(f"""with {SPANS_SQL} select doc_id, label, start, "end" from spans where role = 'gold' and doc_id % 11 <> 5""")
def marker_normaliser(spark, d):
    """Markers as annotators write them: plural and small labels, offsets as text; every eleventh document's are unknown."""
    s = spans(_docs(spark, d)).where("role = 'gold'")
    kind = F.when(F.col("doc_id") % 11 == 5, "Place").when(F.col("start") % 2 == 0, F.concat(F.lower("label"), F.lit("s"))).otherwise(F.concat(F.lit(" "), F.lower("label")))
    raw = F.struct(F.col("start").cast("string").alias("startIndex"), F.col("end").cast("string").alias("endIndex"), kind.alias("type"), F.lit("").alias("text"))
    per = s.groupBy("doc_id").agg(F.collect_list(raw).alias("raw"))
    return per.select("doc_id", F.inline(dc.markers(F.col("raw")))).select("doc_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""with {SPANS_SQL} select doc_id, count(*) as n, count(*) filter (start % 3 <> 0) as placed from spans where role = 'gold' group by 1""")
def markers_with_nulls(spark, d):
    """Where bad offsets stay, as null."""
    s = spans(_docs(spark, d)).where("role = 'gold'")
    raw = F.struct(F.when(F.col("start") % 3 == 0, "?").otherwise(F.col("start").cast("string")).alias("startIndex"), F.col("end").cast("string").alias("endIndex"), F.col("label").alias("type"), F.lit("").alias("text"))
    per = s.groupBy("doc_id").agg(F.collect_list(raw).alias("raw")).withColumn("m", dc.markers(F.col("raw"), drop_bad=False))
    return per.select("doc_id", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x["start"].isNotNull())).cast("long").alias("placed"))


@query(f"""with {SPANS_SQL}, {ANNOTATED_SQL} select s.doc_id, s.label, s.start, s."end" from spans s join annotated a using (doc_id) where s.role = case doc_label when 'conspiracy' then 'gold' when 'non' then 'pred' else 'gold' end""")
def span_records(spark, d):
    """Records that keep their spans under one of three names, offsets under one of two."""
    docs = annotated(spark, d)
    empty = F.lit(None).cast("long")
    one = F.struct(F.when(F.col("start") % 2 == 0, F.col("label")).alias("label"), F.col("label").alias("type"), F.when(F.col("end") % 2 == 0, F.col("start")).alias("start"), F.col("start").alias("startIndex"), empty.alias("end"), F.col("end").alias("endIndex"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("score"))
    per = spans(docs).groupBy("doc_id").agg(F.collect_list(F.when(F.col("role") == "gold", one)).alias("gold"), F.collect_list(F.when(F.col("role") == "pred", one)).alias("pred"))
    j = docs.select("doc_id", "doc_label").join(per, "doc_id")
    got = dc.span_records(F.when(F.col("doc_label") == "conspiracy", F.col("gold")), F.when(F.col("doc_label") == "non", F.col("pred")), F.col("gold"))
    return j.select("doc_id", F.inline(got)).select("doc_id", "label", "start", "end")


@query(f"""with {SPANS_SQL}, {ANNOTATED_SQL}, n as (select doc_id, count(*) as n from spans where role = 'gold' and "end" - start >= 3 group by 1)
select doc_id, kind, coalesce(n, 0)::int as n_spans from annotated left join n using (doc_id), (values ('s1'), ('s2')) k(kind) where trim(text) <> '' and (kind = 's1' or doc_label <> 'cant_tell')""")
def few_shot_entries(spark, d):
    docs = annotated(spark, d)
    per = spans(docs).where("role = 'gold'").groupBy("doc_id").agg(F.collect_list(F.struct("label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))
    j = docs.join(per, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("array()").cast(per.schema["spans"].dataType)))
    return dc.few_shot_entries(j).select("doc_id", "kind", F.size("spans").alias("n_spans"))


@query("select case when doc_id % 4 = 0 then 'events_doc_' || lpad((row_number() over (order by doc_id) - 1)::varchar, 7, '0') else doc_id::varchar end as doc_id, n_chars from documents")
def synthetic_ids(spark, d):
    docs = _docs(spark, d).withColumn("at", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")))
    return dc.fill_ids(docs, "events", [F.col("at")]).select("doc_id", "n_chars")


@query("""with c as (select doc_id, text, regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) as cut from documents)
select doc_id, case when length(text) <= 200 then text when cut <> '' then cut else substr(text, 1, 200) end as clipped from c""")
def sentence_clip(spark, d):
    return _docs(spark, d).select("doc_id", tx.clip_to_sentence(F.col("text"), 200).alias("clipped"))


@query("select page_id, md5(regexp_replace(url, '^http.*', '<URL>')) as h from pages")
def url_replacement(spark, d):
    """An address alone on its line becomes <URL>."""
    return table(spark, d, "pages").select("page_id", F.md5(tx.replace_urls(F.regexp_replace("url", "[^A-Za-z0-9:]", "x"))).alias("h"))


@query("select doc_id, md5(translate(text || ' “a” ‘b’ – —', '‘’‚“”„–—', '''''''\"\"\"--')) as h from documents")
def quote_folding(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.fold_quotes(F.concat("text", F.lit(" “a” ‘b’ – —")))).alias("h"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as n from documents")
def word_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n"))


@query("select doc_id, 'Document ' || doc_id || ' of ' || source || ': ' || n_chars || ' characters' as prompt from documents")
def prompt_template(spark, d):
    return _docs(spark, d).select("doc_id", tx.template("Document {{id}} of {{source}}: {{n}} characters", id=F.col("doc_id"), source=F.col("source"), n=F.col("n_chars")).alias("prompt"))


@query("""select doc_id, '{"id": ' || doc_id || ', "tags": ["a"]}' as json from documents""")
def json_blocks(spark, d):
    """The object in a reply with a fence, words around it and trailing commas."""
    reply = F.concat(F.lit('Here:\n```json\n{"id": '), F.col("doc_id"), F.lit(', "tags": ["a",]}\n```\nDone.'))
    return _docs(spark, d).select("doc_id", tx.json_block(reply).alias("json"))


@query("""select doc_id, case doc_id % 6 when 0 then '[{"id": ' || doc_id || '}, {"of": "' || source || '"}]' when 1 then '{"id": ' || doc_id || ', "t": "it''s"}' when 2 then '{"id": ' || doc_id || '}' when 3 then '[1, ' || doc_id || ']' end as json,
case doc_id % 6 when 0 then 'array' when 1 then 'object' when 2 then 'object' when 3 then 'array' end as kind from documents""")
def json_values(spark, d):
    """Replies with an array and a trailing comma in fences, an object with curly quotes, one that parses, an array of numbers beside words,
    no JSON, and JSON that cannot be mended."""
    i = F.col("doc_id").cast("string")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    sixth = F.col("doc_id") % 6
    reply = (F.when(sixth == 0, say('Sure:\n```json\n[{"id": ', i, '}, {"of": "', F.col("source"), '"},]\n```')).when(sixth == 1, say("{“id”: ", i, ", “t”: “it’s”,}"))
             .when(sixth == 2, say('{"id": ', i, "}")).when(sixth == 3, say("so [1, ", i, "] it is")).when(sixth == 4, say("none ", i)).otherwise(say("{", i, ": }")))
    v = tx.json_value(reply)
    return _docs(spark, d).select("doc_id", v["text"].alias("json"), v["kind"].alias("kind"))


@query("select source, case when avg(n_chars % 100 / 100.0) < 0.33 then 'early' when avg(n_chars % 100 / 100.0) < 0.66 then 'middle' else 'late' end as place from documents group by 1")
def position_phrases(spark, d):
    return _docs(spark, d).groupBy("source").agg(tx.position_phrase(F.avg(F.col("n_chars") % 100 / F.lit(100.0))).alias("place"))


@query("select n as asked, list_min(list_transform([1, 2, 4, 8, 16, 32, 64], lambda d: {'gap': abs(d - n), 'd': d})).d as bands from range(1, 71) t(n)")
def band_numbers(spark, d):
    return spark.createDataFrame([(n, hs.nearest_band_count(n)) for n in range(1, 71)], "asked long, bands int")


@query("select d.doc_id, coalesce(l.quality, -1) as quality from (select doc_id, -1 as quality from documents) d left join labels l using (doc_id)")
def join_with_default(spark, d):
    base = _docs(spark, d).select("doc_id", F.lit(-1).alias("quality"))
    return dc.attach_fallback(base, table(spark, d, "labels"), "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("select count(*) as n from labels join documents using (doc_id)")
def join_many_to_one(spark, d):
    """The right side's ids are checked to be unique before the join."""
    return table(spark, d, "labels").join(dc.require_unique(_docs(spark, d).select("doc_id"), "doc_id"), "doc_id").agg(F.count("*").alias("n"))


@query("select doc_id, text, quality, toxic, rank from (select d.doc_id, md5(d.text) as text, l.quality, l.toxic, (row_number() over (partition by d.source order by d.doc_id))::int as rank from documents d join labels l using (doc_id)) where rank <= 4")
def attach_few(spark, d):
    """At most four labelled rows to each source, by id."""
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rt.attach_most(j, "source", 4, [F.col("doc_id")]).select("doc_id", F.md5("text").alias("text"), "quality", "toxic", "rank")


@query("select a.doc_id, b.doc_id as other from documents a join documents b on md5(trim(a.text)) = md5(trim(b.text)) and a.doc_id < b.doc_id and a.source <> b.source")
def merge_on_text(spark, d):
    """Pairs of rows of two banks that have the same text: here documents of different sources. merge_banks is the merge of two banks into one."""
    docs = _docs(spark, d).select("doc_id", "source", F.md5(F.trim("text")).alias("t"))
    a, b = docs.alias("a"), docs.alias("b")
    return a.join(b, "t").where((F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.source") != F.col("b.source"))).select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other"))


@query("select doc_id, n_chars::double as first, (n_chars * 2)::double as second from documents")
def batched_embedding(spark, d):
    """An embedder that fails on whole batches with a long text: these are tried one by one."""

    def embedder(texts):
        if len(texts) > 1 and any(len(t) > 3000 for t in texts):
            raise ValueError("batch too long")
        return [[float(len(t)), 2.0 * len(t)] for t in texts]

    got = rt.embed(_docs(spark, d), embedder, 2)
    return got.select("doc_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


# ---------------------------------------------------------------- streams


def _stream(spark, d):
    return sr.read_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    """Hourly counts in complete mode, so that every window counts, the last ones too."""
    at = _at(spark, "windows")
    counts = _stream(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    sr.complete_results(counts.select(F.col("w.start").alias("start"), "event_type", "n"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return sr.latest(spark, f"{at}/out")


@query("select distinct user_id from events")
def stream_first_seen(spark, d):
    """Each user once: all events are within the watermark."""
    at = _at(spark, "seen")
    first = sr.first_seen(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "100000 hours").select("user_id")
    sr.append_results(first, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("user_id")


@query("select (user_id % 2)::int as y, (event_id % 2)::int as p_label, count(*) as n from events group by 1, 2")
def stream_confusion(spark, d):
    at = _at(spark, "confusion")
    rows = _stream(spark, d).select((F.col("user_id") % 2).cast("int").alias("y"), (F.col("event_id") % 2).cast("int").alias("p_label"))
    sr.complete_results(sr.running_confusion(rows), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return sr.latest(spark, f"{at}/out")
