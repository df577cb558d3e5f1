"""The guards on answers and the owner of a document, on cases of their own."""

import pytest

from sparkdossier.functions import identifiers as I
from sparkdossier.operators import guards, owners

TEXT = "\n".join([
    "[Side 1 av 2]", "Vedtak om sykepenger", "Sykepengegrunnlaget er fastsatt til kr 512 400 per aar", "Frilansoppdrag", "kr 18 250,00", "[Side 2 av 2]", "Faktura", "Beloep aa betale",
    "kr 4 812,00", "Forfallsdato: 24.06.2026", "Storgata 14 B", "3044 DRAMMEN",
])

FIELD = [
    # question, answer, whether the guard applies, and what is absent
    ("Hvor stort gebyr skal dekkes?", "kr 4 812,00", True, ["gebyr", "dekkes"]),
    ("Hvor mye skylder han i renter?", "kr 4 812,00", True, ["skylder", "renter"]),
    ("Hva er pensjonsgrunnlaget til Ola?", "kr 512 400", True, ["pensjonsgrunnlaget"]),
    ("Hvor mye skal betales?", "kr 4 812,00", False, []), ("Hva er sykepengegrunnlaget?", "kr 512 400", False, []), ("Hva er forfallsdatoen?", "24.06.2026", False, []),
    ("Hvor mye hadde han i frilansinntekt?", "kr 18 250,00", False, []), ("Oppsummer bunken", "Vedtak og faktura", False, []), ("Hvor stort gebyr?", "Ikke oppgitt, men 4 812,00", False, []),
    ("Hvor stort gebyr skal dekkes?", "kr 99 999,00", False, []), ("Hvilken gateadresse har mottakeren?", "Storgata 14 B, 3044 DRAMMEN", False, []), ("", "kr 4 812,00", False, []),
    ("Hvor stort gebyr skal dekkes?", "", False, []), ("Hvor stort gebyr skal dekkes?", None, False, []), (None, "kr 4 812,00", False, []),
    ("Hvor stort gebyr skal dekkes?", "kr 4 812,00 og kr 512 400", True, ["gebyr", "dekkes"]), ("Hvor stort gebyr skal betales?", "kr 4 812,00 og kr 512 400", False, []),
    ("Hvor stort gebyr skal dekkes?", "812,00", False, []),
]


def test_field_guard(spark):
    cases = FIELD
    answers = spark.createDataFrame([(i, 1 if i % 2 else 2, q, a) for i, (q, a, _, _) in enumerate(cases)], "id long, doc_id long, sporsmal string, svar string")
    sources = spark.createDataFrame([(1, TEXT), (2, TEXT.replace("\n", "\r\n")), (3, None), (4, "")], "doc_id long, tekst string")
    got = {r.id: r for r in guards.field_guard(answers, sources).collect()}
    assert {i: (r.gjelder, r.fravaerende) for i, r in got.items()} == {i: (g, f) for i, (_, _, g, f) in enumerate(cases)}
    empty = spark.createDataFrame([(1, 3, "Hvor stort gebyr?", "kr 1 000"), (2, 4, "Gebyr?", "kr 1 000"), (3, None, "Gebyr?", "kr 1 000")], answers.schema)
    assert [r.gjelder for r in guards.field_guard(empty, sources).collect()] == [False] * 3
    assert guards.field_guard(answers.limit(0), sources).count() == 0


@pytest.mark.parametrize(("answer", "values"), [("kr 4 812,00", ["4 812,00"]), ("512 400", ["512 400"]), ("24.06.2026", ["24.06.2026"]), ("2026-06-24", ["2026-06-24"]), ("3044 DRAMMEN", [])])
def test_what_counts_as_a_value(spark, answer, values):
    a = spark.createDataFrame([(1, 1, "Gebyr", answer)], "id long, doc_id long, sporsmal string, svar string")
    assert guards.field_guard(a, spark.createDataFrame([(1, "x")], "doc_id long, tekst string")).first().verdier == values


def test_field_guard_against_all_words(spark):
    """Kin words by keys are the same as by comparing each with each."""
    import itertools

    from pyspark.sql import functions as F

    words = ["dag", "dagsats", "dager", "sak", "saken", "åre", "årene", "aarsak", "øre", "oere", "æra", "aera", "legeerklæringen", "legeerklaering", "lege", "leg", "klage", "klager", "123", "1234"]
    spelled = lambda w: w.replace("æ", "ae").replace("ø", "oe").replace("å", "aa")

    def kin(a, b):
        a, b = spelled(a), spelled(b)
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a.startswith(b) or b.startswith(a) or same >= 4

    pairs = spark.createDataFrame(list(itertools.product(words, repeat=2)), "a string, b string")
    got = pairs.select("a", "b", F.arrays_overlap(guards.asked_keys(F.col("a")), guards.kin_keys(F.array("b"))).alias("k")).collect()
    assert [r for r in got if r.k != kin(r.a, r.b)] == []


PAGES = {
    1: "NAV Arbeid og ytelser\nOLA NORDMANN\nVedtak om sykepenger\nGrunnlag: kr 512 400 per aar\nSaksnummer: 4417820", 2: "Utbetalingsplan for 512 400 kroner", 3: "Faktura til Ola Nordmann\nBeloep kr 4 812,00",
    4: "Kontakt: ola.testperson@eksempel.no", 5: "Diagnose (ICPC-2):\nL\n8\n6 R\ny\ngg\nsyndrom", 6: "Inntektsmelding\nArbeidsgiver: Nordbygg Entreprenoer AS", 9: "Legeerklaering for Marit Testperson\nFoedt 02.09.1991", 10: None,
}
PERSON = [
    ("Hva er e-postadressen til Marit Testperson?", "ola.testperson@eksempel.no", "feil_person", "Marit Testperson", [9], [4]), ("Hvor mye blir neste utbetaling til Marit?", "Beloep: 512 400 NOK", "feil_person", "Marit", [9], [1, 2]),
    ("Hva er grunnlaget til Ola Nordmann?", "kr 512 400", "samme_person", "Ola Nordmann", [1, 3], [1, 2]), ("Hva er saksnummeret til Ola Nordmann?", "4417820", "samme_person", "Ola Nordmann", [1, 3], [1]),
    ("Hva er saksnummeret?", "Saksnummer: 4417820", "ikke_vurdert", None, [], []), ("Oppsummer dokumentet for Marit Testperson", "Dette er en legeerklaering av uviss art som sier en hel del om mangt", "ikke_vurdert", None, [], []),
    ("Hvem er arbeidsgiveren til Marit Testperson?", "Nordbygg Entreprenoer AS", "feil_person", "Marit Testperson", [9], [6]), ("Hvilken diagnose har Marit Testperson?", "L86 Ryggsyndrom", "feil_person", "Marit Testperson", [9], [5]),
    ("Har Marit Testperson klaget?", "Ja", "ikke_vurdert", "Marit Testperson", [9], []), ("Hva er diagnosen til Marit Testperson?", "Ikke oppgitt i dokumentet", "ikke_vurdert", "Marit Testperson", [9], []),
    ("Hvilken diagnose har Marit Testperson?", "L86 Ryggsmerter med utstraaling", "ikke_vurdert", "Marit Testperson", [9], []), ("Har Ola Nordmann og Marit Testperson samme adresse?", "512 400", "ikke_vurdert", None, [], []),
    ("Hva er e-posten til Kari Hansen?", "ola.testperson@eksempel.no", "ikke_vurdert", None, [], []), (None, "512 400", "ikke_vurdert", None, [], []), ("Hva er grunnlaget til Ola Nordmann?", None, "ikke_vurdert", "Ola Nordmann", [1, 3], []),
]


def test_person_guard(spark):
    # "Oppsummer" begins a question in a capital, so it is a name where the pages hold it, and none here.
    answers = spark.createDataFrame([(i, 7, q, a) for i, (q, a, *_) in enumerate(PERSON)] + [(99, 8, "Hva er e-posten til Marit?", "ola@x.no")], "id long, doc_id long, sporsmal string, svar string")
    pages = spark.createDataFrame([(7, s, t) for s, t in PAGES.items()] + [(8, 1, "Marit")], "doc_id long, side int, tekst string")
    got = {r.id: r for r in guards.person_guard(answers, pages).collect()}
    assert got[99].dom == "ikke_vurdert" and len(got) == len(PERSON) + 1
    for i, (_, _, verdict, name, of_person, found) in enumerate(PERSON):
        if i == 5:
            assert got[i].dom == verdict
        else:
            assert (got[i].dom, got[i].navn, got[i].personsider, got[i].funnet_paa) == (verdict, name, of_person, found), PERSON[i]
    assert guards.person_guard(answers.limit(0), pages).count() == 0


def person(nine):
    one = (11 - sum(w * int(c) for w, c in zip(I.PERSON_FIRST, nine)) % 11) % 11
    if one == 10:
        return None
    two = (11 - sum(w * int(c) for w, c in zip(I.PERSON_SECOND, f"{nine}{one}")) % 11) % 11
    return None if two == 10 else f"{nine}{one}{two}"


def test_owner_of_a_document(spark):
    a, b = [n for n in (person(f"0101{y}{s}") for y in (80, 81) for s in range(100, 120)) if n][:2]
    cases = {
        1: (f"Opplysninger om: Ola Nordmann\nFodselsnummer: {a}\nLege: {b}", "merket", a, "Ola Nordmann", [(b, "annen", None)]),
        2: (f"Et brev.\nLegens navn:\nKari Hansen\nFnr: {a}", "bare_andre_roller", None, None, [(a, "annen", "Kari Hansen")]),
        3: (f"Referanse {a} og {b} i saken.", "umerket", None, None, [(a, "umerket", None), (b, "umerket", None)]),
        4: (f"Bruker: {a}\nSaken gjelder: {b}", "flertydig", None, None, [(a, "eier", None), (b, "eier", None)]),
        5: ("Ingen numre her, bare 12345678901", "ingen", None, None, []),
        6: (f"Etternavn, fornavn\nNOR-ETTERNAVN, OLA\nSøker {a[:6]} {a[6:]}", "merket", a, None, []),
        7: (f"Søker\nEtternavn, fornavn\nNOR-ETTERNAVN, OLA\nFnr {a[:6]} {a[6:]}", "merket", a, "NOR-ETTERNAVN, OLA", []),
        8: (f"Per Olsen\n{a}\nKari Berg-Hansen\n{b}", "umerket", None, None, [(a, "umerket", "Per Olsen"), (b, "umerket", "Kari Berg-Hansen")]),
        9: (f"Opplysninger om {a}\n" + "x " * 200 + f"\nBruker: Ola Nordmann {a}", "merket", a, "Ola Nordmann", []),
        10: ("Saken gjelder Ola Nordmann.\n" + "y y y y y y y\n" * 30 + a, "umerket", None, None, [(a, "umerket", None)]),
        11: (None, "ingen", None, None, []), 12: ("", "ingen", None, None, []),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in cases.items()], "doc_id long, tekst string")
    got = {r.doc_id: r for r in owners.document_owners(docs.repartition(3)).collect()}
    for i, (_, sure, number, name, others) in cases.items():
        assert (got[i].sikkerhet, got[i].fnr, got[i].navn, [(x.fnr, x.rolle, x.navn) for x in got[i].andre]) == (sure, number, name, others), i
    assert owners.document_owners(docs.limit(0)).count() == 0


def test_rows_that_repeat_are_documents_of_their_own_and_no_text_is_shuffled(spark):
    a = next(n for n in (person(f"010180{s}") for s in range(100, 120)) if n)
    docs = spark.createDataFrame([(1, f"Per Olsen\n{a}")] * 2, "doc_id long, tekst string")
    found = owners.numbers_with_labels(docs)
    assert [r.navn for r in found.collect()] == ["Per Olsen"] * 2
    assert "Exchange" not in str(found._jdf.queryExecution().executedPlan())
    assert "Join" not in str(owners.document_owners(docs)._jdf.queryExecution().executedPlan())
