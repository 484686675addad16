"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import codes, decontam, exact, importance, media, mixing, neardup, quality, repeats, sharding, surrogates, urlrules, warc
from .common import table

#: Small enough that every table of the tests has several shards; a real run takes some hundred times as much.
SHARD_BYTES = 1 << 20
#: For these queries only; a real run takes its key from a secret store.
SURROGATE_KEY = b"key of the registered queries"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_media(spark, d):
    """The vectors are drawn in tasks of a few hundred, as a table with a media column."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    tasks = max(1, vectors.count() // 400)
    return media.picture_copies(media.render_vectors(vectors.repartition(tasks)), key="vec_id")


def op2_sharding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sharding.extendible_shards(docs, SHARD_BYTES).select("doc_id", "doc_bytes", "shard", "shard_bytes", "shard_rows")


def op3_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, d, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark, d):
    captures = warc.archive_pages(table(spark, d, "pages"))
    number = lambda c: F.col(c).cast("long").alias(c)
    return captures.select(number("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), number("refers_to"))


def op5_surrogates(spark, d):
    return surrogates.with_surrogates(table(spark, d, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op6_urlrules(spark, d):
    return urlrules.filter_urls(table(spark, d, "pages"), URL_RULES)


def op7_neardup(spark, d):
    return neardup.label_duplicates(table(spark, d, "documents"))


def op8_decontam(spark, d):
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_repeats(spark, d):
    out = repeats.remove_repeats(table(spark, d, "documents").select("doc_id", "text"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, d, "benchmark"), width=1).select("doc_id", "n_features", "weight", "score", "rank")


def op12_codes(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return codes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_exact(spark, d):
    """The digests of texts that are alone are asked for as the rows' contract has them; they decide nothing."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return exact.label_copies(docs, digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_media, op2_sharding, op3_quality, op4_warc, op5_surrogates, op6_urlrules, op7_neardup, op8_decontam, op9_mixing, op10_repeats, op11_importance, op12_codes, op13_exact)
}


def _codebook_rounds(n: int) -> str:
    """SQL of n rounds: a<r> are the parts' nearest entries, b<r> the entries after r rounds."""
    nearest = """a{r} as materialized (
  select vec_id, part, any_value(x) as x, min(d * 16 + e) % 16 as e, min(d * 16 + e) // 16 as d
  from (select vec_id, part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join b{r} using (part)) group by vec_id, part)"""
    moved = """b{s} as materialized (
  select part, e, coalesce(m.c, b{r}.c) as c
  from b{r} left join (
    select part, e, list((t - ((t % n) + n) % n) // n order by pos) as c
    from (select part, e, pos, sum(x[pos])::bigint as t, count(*) as n from a{r}, range(1, 9) r(pos) group by part, e, pos) group by part, e) m using (part, e))"""
    return ",\n".join(f"{nearest.format(r=r)},\n{moved.format(r=r, s=r + 1)}" for r in range(n)) + ",\n" + nearest.format(r=n)


ORACLE_SQL = {
    # A bucket is the shortest prefix of the hash's bits that fits, or has one row; no two documents here share 48 bits.
    "op2_sharding": f"""
with h as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as doc_bytes, md5(coalesce('1' || doc_id, '0') || '|' || coalesce('1' || text, '0')) as m from documents),
b as (select doc_id, doc_bytes, lpad(bin(('0x' || substr(m, 1, 15))::ubigint), 60, '0') as bits from h),
n as (select d, substr(bits, 1, d) as node, sum(doc_bytes)::bigint as bytes, count(*) as n from b, range(0, 49) t(d) group by 1, 2)
select doc_id, doc_bytes, arg_min(node, d) as shard, arg_min(bytes, d) as shard_bytes, arg_min(n, d) as shard_rows
from b join n on node = substr(bits, 1, d) where bytes <= {SHARD_BYTES} or n = 1 group by doc_id, doc_bytes""",
    # All pairs, by the shingles that they share.
    "op7_neardup": r"""
with recursive w as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') as w from documents),
s as materialized (select distinct doc_id, hash(x) as s from (select doc_id, unnest(case when len(w) < 5 then case when len(w) > 0 then [array_to_string(w, ' ')] else [] end else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as x from w)),
m as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as n from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as materialized (select x, y from c join m a on a.doc_id = x join m b on b.doc_id = y where c.n * 10 >= 8 * (a.n + b.n - c.n)
  union select a.doc_id, b.doc_id from w a join w b on a.text = b.text and a.doc_id < b.doc_id),
both_ as materialized (select x, y from links union all select y, x from links),
reach as (select doc_id as node, doc_id as root from documents union select y, root from reach join both_ on x = node),
classes as (select node as doc_id, min(root) as class_id from reach group by 1)
select doc_id, class_id, coalesce(n, 0) as n_links from classes left join (select x as doc_id, count(*) as n from both_ group by 1) using (doc_id)""",
    "op4_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as payload_digest from p),
g as (select payload_digest, max(page_id) as last from q where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when last is null or page_id is not distinct from last then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from last then last end as refers_to
from q left join g using (payload_digest)""",
    "op6_urlrules": r"""
with u as (
  select page_id, url, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as r from pages
), p as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
  from u
), rules(verdict, h, t) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best as (
  select n, arg_max(h || t, length(h || t)) as rule, arg_max(verdict, length(h || t)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, t) group by n
)
select p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') as verdict from p left join best using (n)""",
    # DuckDB has no CRC-32: a table of 256 remainders by eight steps each, and a fold over each distinct word's bytes. Logarithms are doubles in both.
    "op11_importance": r"""
with step as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
said as (select 0 as side, doc_id, text from documents union all select 1, item_id, text from benchmark),
w as materialized (select side, doc_id, row_number() over () as row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from said),
used as materialized (select side, row_id, word, count(*) as n from (select side, row_id, unnest(w) as word from w) group by all),
bytes as (select word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint) as b from (select distinct word from used)),
crcs as materialized (select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, step),
s as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from used join crcs using (word) group by bucket),
total as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from s),
gain as (select bucket, floor(1000 * ln(((coalesce(s.t, 0) + 1) * (total.s + 10000)) / ((coalesce(s.s, 0) + 1) * (total.t + 10000))))::bigint as g from s, total),
sums as (select row_id, sum(n)::bigint as n, sum(n * g)::bigint as g from used join crcs using (word) join gain using (bucket) where side = 0 group by row_id),
d as materialized (
  select row_id, doc_id, coalesce(n, 0) as n_features, floor(coalesce(g, 0)::double / coalesce(n, 1))::bigint as weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise
  from w left join sums using (row_id) where side = 0),
r as (select row_id, row_number() over (order by weight + noise desc, doc_id) as rank from d where n_features >= 20)
select doc_id, n_features, weight, weight + noise as score, case when rank <= (select count(*) from r) * 10 // 100 then rank end as rank from d left join r using (row_id)""",
    # The vectors here have 64 components, so parts have 8.
    "op12_codes": f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, part, list_slice(v, part * 8 + 1, part * 8 + 8) as x from kept, range(8) r(part)),
b0 as materialized (select part, e, x as c from (select part, x, row_number() over (partition by part order by vec_id) - 1 as e from parts) where e < 16),
{_codebook_rounds(6)},
coded as materialized (select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::bigint as error from a6 group by vec_id),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as codebooks_sha256 from b6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), books""",
    "op13_exact": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""",
}
