"""State of a case and the answers that follow from it."""

import pytest
from pyspark.sql import functions as F

from sparkdossier.operators import case_answers as A

DOC = "sak long, filnavn string, tittel string, type string, dato string, behandlingsdato string, fnr string, ytelse string, mangler array<string>"


def doc(case, name, kind, date, seen=None, fnr="01", benefit="syk", lacks=()):
    return (case, name, None, kind, date, seen, fnr, benefit, list(lacks))


APPEALED = [doc(1, "1.pdf", "soknad", None, "2026-01-10"), doc(1, "2.pdf", "vedtak", "2026-07-01", lacks=["dato", "sum"]), doc(1, "3.pdf", "klage", "2026-02-15"), doc(1, "4.pdf", "klagevedtak", "2026-06-12")]


@pytest.fixture(scope="module")
def cased(spark):
    rows = APPEALED + [
        doc(2, "a", "vedtak", "2026-01-01"), doc(2, "b", "purring", "2026-02-01", fnr="0 2"), doc(3, "a", "purring", "2026-01-01"), doc(3, "b", "vedtak", "2026-01-01", benefit="aap"),
        doc(4, "", "soknad", "2026-01-01", fnr=None, benefit=None), doc(5, "x", "klagevedtak", None, fnr=" "), doc(6, "x", None, "2026-01-01", benefit=""), doc(6, "y", "brev", None, fnr="0 1"),
        doc(7, "m", "vedtak", "2026-01-01"), doc(7, "n", "vedtak", "2026-01-01"),
    ]
    return spark.createDataFrame(rows, DOC).select(*[F.col(c).cast("date") if c.startswith(("dato", "beh")) else F.col(c) for c in "sak filnavn tittel type dato behandlingsdato fnr ytelse mangler".split()])


def test_states(cased):
    got = {r.sak: r for r in A.case_states(cased).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "avgjort_etter_klage", 2: "venter_paa_dokumentasjon", 3: "avgjort", 4: "under_behandling", 5: "ukjent", 6: "ukjent", 7: "avgjort"}
    assert (got[1].avgjort_i, got[1].part, got[1].ytelse, got[1].ufullstendige, got[1].klaget) == ("4.pdf", "01", "syk", 1, True)
    assert (got[2].part, got[2].antall_personer) == (None, 2) and (got[6].part, got[6].antall_personer) == ("01", 1)
    assert got[3].ytelse is None and got[4].ytelse is None and got[7].avgjort_i == "n"
    assert (got[5].antall_personer, got[5].avgjorelse) == (0, None)
    assert A.case_states(cased.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("Hva ble det til slutt i saken?", "utfall"), ("HVEM GJELDER saken?", "part"), ("Ble det klaget?", "klage"), ("Hva mangler?", "mangler"), ("Stemmer alt?", "motsigelse"),
        ("Hvor STÅR saken?", "status"), ("Er det klagevedtak?", None), ("Hva er dagsatsen?", None), ("", None), (None, None),
    ],
)
def test_question_kinds(spark, question, kind):
    assert spark.createDataFrame([(question,)], "q string").select(A.question_kind(F.col("q"))).first()[0] == kind


def test_answers_and_sources(spark, cased):
    asked = [("u", 1, "Hva ble det til slutt?"), ("p", 1, "Hvem gjelder saken?"), ("p2", 2, "Hvem gjelder saken?"), ("k", 1, "Ble det klaget?"), ("k2", 2, "Ble det klaget?"), ("m", 1, "Hva mangler?"), ("s", 3, "Hva er status?"), ("?", 1, "Hva er dagsatsen?"), ("borte", 99, "Hva er status?"), ("x", 2, "Er det noe feil?")]
    questions = spark.createDataFrame(asked, "sporsmal_id string, sak long, sporsmal string")
    states = A.case_states(cased, spark.createDataFrame([(2,), (2,)], "sak long"))
    answered = A.answers(questions, states)
    got = {r.sporsmal_id: r.svar for r in answered.collect()}
    assert len(got) == len(asked)
    assert got["u"] == "Klagevedtak datert 2026-06-12 er den som gjelder. Status: Avgjort etter klage — Klageinstansen har avgjort saken (2026-06-12)."
    assert got["p"].startswith("Saken gjelder personen med fødselsnummer 01. Fastslått av 4") and got["p2"].startswith("Hvem saken gjelder kan ikke fastslås. Saken bærer 2")
    assert got["k"] == "Ja, det er klaget i saken (2026-02-15)." and got["k2"].startswith("Nei")
    assert got["s"] == "Avgjort — Vedtak datert 2026-01-01, og ingen klage er avgjort etter det." and got["x"].startswith("Ja — 2 ")
    assert got["?"] is None and got["borte"] is None
    assert {tuple(r) for r in A.sources(answered, states, cased).collect()} == {("u", "4.pdf", None), ("k", "3.pdf", None), ("m", "2.pdf", "dato, sum")}
