"""Tables that the annotation operators work on, derived from documents and labels."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: conspiracy or non by labels.toxic, cant_tell where there is none."""
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.when(F.col("toxic") == 1, "conspiracy").when(F.col("toxic") == 0, "non").otherwise("cant_tell")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").withColumn("doc_label", label).drop("toxic")


#: Texts are scanned in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def _slices(batch: pa.RecordBatch):
    """A batch (key, text, ...) in slices of rows of about SLICE_BYTES of text, one row at least."""
    size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).cumsum()
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _parts(batch: pa.RecordBatch):
    """Of the texts of a slice, one behind the other: their bytes, and for every part between single blanks its row, its number within the
    text, the bytes where it begins and ends, and the characters where it begins and ends, counted from the text's first; last, how many parts its text has."""
    text = batch.column(1).cast(pa.string())
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    blank = np.flatnonzero(data == 32)
    per = np.diff(np.searchsorted(blank, off)) + 1
    row = np.repeat(np.arange(len(text)), per)
    first = np.cumsum(per) - per
    begin = np.empty(len(row), np.int64)
    end = np.empty(len(row), np.int64)
    inner = np.ones(len(row), bool)
    inner[first] = False
    begin[first], begin[inner] = off[:-1], blank + 1
    inner[:] = True
    inner[first + per - 1] = False
    end[first + per - 1], end[inner] = off[1:], blank
    base = chars[off[:-1]][row]
    return data, row, np.arange(len(row)) - first[row], begin, end, chars[begin] - base, chars[end] - base, per[row]


def token_places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a slice (key, text), for every part between single blanks that is not empty, in order: its row, its number within the
    text, and the characters where it begins and ends."""
    _, row, i, _, _, s, e, _ = _parts(batch)
    full = e > s
    return row[full], i[full], s[full], e[full]


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts of these stretches of bytes."""
    n = end - begin
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(begin - off[:-1], n)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def _scanned(docs: DataFrame, made, schema: str) -> DataFrame:
    """What ``made`` (a function of a slice that yields record batches) makes of the texts that there are; no part is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for rows in _slices(batch):
                yield made(rows)

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, i, tok, s: the parts of text between single blanks, and where they start."""
    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, row, i, begin, end, s, _, _ = _parts(rows)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(i, pa.int32()), _strings(data, begin, end), pa.array(s)], names=["doc_id", "i", "tok", "s"])

    return _scanned(docs, made, "i int, tok string, s long")


_WORDS = re.compile(r"\w+|[^\w\s]")


def token_offsets(docs: DataFrame) -> DataFrame:
    """doc_id, i, start, end of every word (a run of letters, digits and underscores) and every other mark that is not white space, in order,
    by one scan of each text: rows leave a slice at a time, no text's words are an array."""
    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = [np.fromiter(itertools.chain.from_iterable(m.span() for m in _WORDS.finditer(t)), np.int64) for t in rows.column(1).to_pylist()]
        n = np.array([len(x) // 2 for x in at], np.int64)
        both = np.concatenate(at)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids = rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([ids, pa.array(i, pa.int32()), pa.array(both[::2]), pa.array(both[1::2])], names=["doc_id", "i", "start", "end"])

    return _scanned(docs, made, "i int, start long, end long")


_LABELS = pa.array(["Actor", "Action", "Effect", "Victim", "Evidence"])


def _spans(docs: DataFrame, said: bool) -> DataFrame:
    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, row, i, begin, end, s, e, n = _parts(rows)
        three = i % 7 == 3
        both = [np.flatnonzero(three), np.flatnonzero(three | (i % 7 == 4))]
        at = np.concatenate(both)
        gold = np.arange(len(at)) < len(both[0])
        last = np.where(gold, i[at] % 3, i[at] % 2)  # how many parts follow the first
        there = i[at] + last < n[at]
        at, gold, last = at[there], gold[there], last[there]
        label = _LABELS.take(pa.array((e[at] - s[at] + i[at]) % 5))
        role = pa.array(["pred", "gold"]).take(pa.array(gold.astype(np.int64)))
        cols = [rows.column(0).take(pa.array(row[at])), role, label, pa.array(s[at]), pa.array(e[at + last])]
        names = ["doc_id", "role", "label", "start", "end"]
        if said:
            cols, names = [*cols, _strings(data, begin[at], end[at + last])], [*names, "span_text"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return _scanned(docs, made, "role string, label string, start long, end long" + (", span_text string" if said else ""))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, role (gold or pred), label, start, end: runs of one to three tokens at fixed places of every text."""
    return _spans(docs, False)


def score(start: str = "start", end: str = "end"):
    """A score in [0, 1] that depends on a span's place only."""
    return ((F.col(start) * 31 + F.col(end)) % 101) / F.lit(101.0)


TOKENS_SQL = """tokens as (
  select doc_id, i, tok, cast(sum(length(tok) + 1) over (partition by doc_id order by i) - length(tok) - 1 as bigint) as s
  from (select doc_id, unnest(string_split(text, ' ')) as tok, generate_subscripts(string_split(text, ' '), 1) - 1 as i from documents))"""
SPAN_TEXTS_SQL = TOKENS_SQL + """, leads as (
  select *, lead(tok, 1) over w as t1, lead(tok, 2) over w as t2 from tokens window w as (partition by doc_id order by i)
), bodies as (
  select 'gold' as role, *, case i % 3 when 0 then tok when 1 then tok || ' ' || t1 else tok || ' ' || t1 || ' ' || t2 end as span_text from leads where i % 7 = 3
  union all select 'pred' as role, *, case i % 2 when 0 then tok else tok || ' ' || t1 end as span_text from leads where i % 7 in (3, 4)
), span_texts as (
  select doc_id, role, case (length(tok) + i) % 5 when 0 then 'Actor' when 1 then 'Action' when 2 then 'Effect' when 3 then 'Victim' else 'Evidence' end as label,
         s as start, cast(s + length(span_text) as bigint) as "end", span_text
  from bodies where span_text is not null
), marked as (select doc_id, label, start, "end", span_text from span_texts where role = 'gold' and regexp_matches(span_text, '^[A-Z]'))"""
SPANS_SQL = SPAN_TEXTS_SQL + """, spans as (select doc_id, role, label, start, "end" from span_texts)"""
ANNOTATED_SQL = """annotated as (
  select d.*, case l.toxic when 1 then 'conspiracy' when 0 then 'non' else 'cant_tell' end as doc_label
  from documents d left join labels l using (doc_id))"""


def span_texts(docs: DataFrame) -> DataFrame:
    """spans() with span_text, what stands there."""
    return _spans(docs, True)


def marked(docs: DataFrame) -> DataFrame:
    """The gold spans that begin with a capital A to Z: doc_id, label, start, end, span_text. Many documents have none."""
    return span_texts(docs).where("role = 'gold'").where(F.col("span_text").rlike("^[A-Z]")).drop("role")
