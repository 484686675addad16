"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then a hash of the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lookup, staged, unstage

#: Characters of the second test.
PREFIX_CHARS = 64


def label_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: its columns without the text, and keep_id, group_size, kept and text_sha256.

    Of the rows with equal texts (after ``normalise``, where given) the one with the largest key is kept; keep_id is its key.

    Texts of a length that no other has are alone without further reading; so are those whose first characters no other text of that
    length has. Only the rest have their whole texts hashed (SHA-256, which stands for the text from then on). text_sha256 is
    null for texts that were not hashed, unless ``digests`` asks for all.

    Every test counts with partial sums, so a text that a third of all rows have is a few rows to shuffle. What a row needs to
    know of its group comes by ``lookup``, which broadcasts only measured tables and groups that are hot by their counts.

    Null texts count as empty. Null keys are less than any other. Of several rows with the kept key and text just one is kept:
    that whose other columns have the largest hash. Columns of docs that have the name of a result are replaced; an empty
    table gives no rows.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c == text or c == key or c.lower() not in results))
    body, size, lead, same_size, same_lead, full, tie, row, best, n = fresh(docs, "body", "size", "lead", "same_size", "same_lead", "full", "tie", "row", "best", "n")
    others = [f.name for f in docs.schema.fields if f.name not in (key, text)]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in others and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    whole = F.coalesce((normalise or (lambda c: c))(F.col(f"`{text}`")), F.lit(""))
    rows = docs.withColumn(body, whole).withColumn(size, F.octet_length(body))

    sizes = staged(rows.groupBy(size).agg(F.count("*").alias(same_size)).where(F.col(same_size) > 1), "sizes")
    # The length is known to repeat before the first characters are looked at, and these before the text is read as a whole.
    rows = lookup(rows, sizes, [size], same_size).withColumn(lead, F.when(F.col(same_size).isNotNull(), F.xxhash64(F.substring(body, 1, PREFIX_CHARS))))
    leads = rows.where(F.col(lead).isNotNull()).groupBy(size, lead).agg(F.count("*").alias(same_lead)).where(F.col(same_lead) > 1)
    leads = staged(leads, "leads")
    digest = F.sha2(F.encode(F.col(body), "UTF-8"), 256)
    rows = lookup(rows, leads, [size, lead], same_lead).withColumn(full, F.when(F.col(same_lead).isNotNull(), digest))
    told = digest if digests else F.col(full)
    rows = rows.select(F.col(f"`{key}`").alias(key), *(F.col(f"`{c}`") for c in others), full, told.alias("text_sha256"), (F.xxhash64(*plain) if plain else F.lit(0).cast("long")).alias(tie), F.monotonically_increasing_id().alias(row))
    rows = staged(rows, "digests")
    unstage(sizes, leads)

    groups = rows.where(F.col(full).isNotNull()).groupBy(full).agg(F.count("*").alias(n), F.max(F.struct(F.col(f"`{key}`").alias("k"), tie, row)).alias(best)).where(F.col(n) > 1)
    out = lookup(rows, staged(groups, "copies"), [full], n)
    alone = F.col(n).isNull()
    return out.select(
        F.col(f"`{key}`").alias(key), *(F.col(f"`{c}`") for c in others), F.when(alone, F.col(f"`{key}`")).otherwise(F.col(best)["k"]).alias("keep_id"), F.coalesce(n, F.lit(1)).alias("group_size"),
        (alone | (F.col(best)[row] == F.col(row))).alias("kept"), "text_sha256",
    )
