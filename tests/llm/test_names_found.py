"""Which words are found as names and numbers, on a labelled set; and how often."""

from spanloom.llm import surrogates

#: Text and the personal data in it.
LABELLED = [
    ("Ms Anna van der Berg came; later Berg left.", {"Anna", "Berg"}),
    ("Mr JOHN SMITH signed. JOHN SMITH left, and so did Smith.", {"JOHN", "SMITH", "Smith"}),
    ("My name is Juan Carlos de la Cruz and I live here.", {"Juan", "Carlos", "Cruz"}),
    ("Yesterday Juan Carlos de la Cruz met Maria Lopez in Lima.", {"Juan", "Carlos", "Cruz", "Maria", "Lopez"}),
    ("Mr Smith and Mrs Jones met Dr Karl Otto Meyer.", {"Smith", "Jones", "Karl", "Otto", "Meyer"}),
    ("Name: Miller, James", {"Miller", "James"}),
    ("Herr von Stein und Frau Weber", {"Stein", "Weber"}),
    ("Dear JOHN SMITH", set()),  # capitals behind a mere cue are no name
    ("Contact Sales now, or Contact Maria Anna Bauer.", {"Maria", "Anna", "Bauer"}),
    ("Mr Brown CEO spoke", {"Brown"}),
    ("from 2001:db8:85a3::8a2e:370:7334 and 2001:0DB8:0:0:0:0:0:1", {"2001:db8:85a3::8a2e:370:7334", "2001:0DB8:0:0:0:0:0:1"}),
    ("std::vector a::b at 12:30:45, ratio 3:4", set()),
    ("call 030 1234567 or 0171/2345678 or 089 123 45 67", {"030 1234567", "0171/2345678", "089 123 45 67"}),
    ("in 2020 007 agents, 0.123 456, 00:30 and 0123", set()),
    ("the van drove to La Paz, and de Gaulle spoke", set()),
    ("James Brown Album Review", {"James", "Brown"}),
]


def test_labelled_set():
    hit = missed = wrong = 0
    for text, want in LABELLED:
        got = {text[a:b] for a, b, *_ in surrogates.find_entities(text)}
        hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
        assert got == want, (text, got)
    assert hit / (hit + missed) == 1.0 and hit / (hit + wrong) == 1.0


def test_persons_keep_kind_and_form(spark):
    rows = [(1, "Ms Anna van der Berg left. ANNA VAN DER BERG is Berg."), (2, "Mr Robin Kim"), (3, "Ms Robin Kim"), (4, "Ms Robin Kim again"), (5, "host fe80:12::1aB and FE80:12::1AB")]
    out = {r.doc_id: r.text for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    first, last = out[1].split(" left")[0].removeprefix("Ms ").split(" van der ")
    assert out[1] == f"Ms {first} van der {last} left. {first.upper()} VAN DER {last.upper()} is {last}." and "Anna" not in out[1]
    robins = {out[i].split(" ")[1] for i in (2, 3, 4)}
    assert len(robins) == 1 and robins <= set(surrogates.GIVEN["latin", "f"])  # two texts of three say so
    a, b = out[5].removeprefix("host ").split(" and ")
    assert b == a.upper() or a.lower() == b.lower()
    assert "fe80" not in out[5].lower() and a.count(":") == 3
