"""Tokens and spans by whole slices of texts, against plain loops."""

import pyarrow as pa

from spanloom.operators import views

TEXTS = [None, "", " ", "a b  c d è ñ ü 日本 x y z w ", "  lead ü d e f g h", "one", "a b c d", "a b c d e f", "word " * 3000]
LABELS = ("Actor", "Action", "Effect", "Victim", "Evidence")


def plain(k, text):
    parts, at = text.split(" "), 0
    toks, spans = [], []
    for i, t in enumerate(parts):
        toks.append((k, i, t, at))
        for role, fits, more in (("gold", i % 7 == 3, i % 3), ("pred", i % 7 in (3, 4), i % 2)):
            if fits and i + more < len(parts):
                said = " ".join(parts[i : i + more + 1])
                spans.append((k, role, LABELS[(len(t) + i) % 5], at, at + len(said), said))
        at += len(t) + 1
    return toks, spans


def test_tokens_and_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    want = [plain(k, t) for k, t in enumerate(TEXTS) if t is not None]
    toks, spans = (sorted(x for w in want for x in w[n]) for n in (0, 1))
    assert sorted(map(tuple, views.tokens(docs).collect())) == toks
    assert sorted(map(tuple, views.span_texts(docs).collect())) == spans
    assert sorted(map(tuple, views.spans(docs).collect())) == sorted(s[:5] for s in spans)


def test_a_batch_is_scanned_in_slices_by_bytes():
    texts = ["x " * 200_000] * 5 + [None, "", "y"] + ["z" * 3_000_000, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [r.column(0).to_pylist() for r in views._slices(batch.filter(batch.column(1).is_valid()))]
    assert [x for g in got for x in g] == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert all(len(g) == 1 or sum(len(texts[i]) for i in g) <= views.SLICE_BYTES for g in got)
