"""A name under two titles is one entity with one surrogate."""

from spanloom.llm import surrogates


def test_name_under_two_titles(spark):
    texts = ["Dr Robin Kim came.", "Ms Robin Kim left.", "Dr Robin Kim met Ms Robin Kim.", "Mr Adam Weber"]
    got = [r["text"] for r in surrogates.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").orderBy("doc_id").collect()]
    name = got[0].removeprefix("Dr ").removesuffix(" came.")
    assert "Robin" not in name and name.split(" ")[0] in surrogates.GIVEN["latin", "f"]
    assert got[1] == f"Ms {name} left." and got[2] == f"Dr {name} met Ms {name}."
