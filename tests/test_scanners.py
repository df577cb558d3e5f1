import datetime
import time

import pytest
from pyspark.sql import functions as F

from sparkdossier.functions import identifiers as I
from sparkdossier.functions import scanners
from sparkdossier.functions import text as T
from sparkdossier.operators import contact, labelled, redaction
from sparkdossier.operators import dates as D


def control(digits, weights):
    k = (11 - sum(int(a) * w for a, w in zip(digits, weights)) % 11) % 11
    return str(k) if k < 10 else None


def person(start):
    """A number that passes both checks, made from its first digits."""
    for serial in range(1000):
        n = f"{start}{serial:03d}"
        first = control(n, I.PERSON_FIRST)
        second = first and control(n + first, I.PERSON_SECOND)
        if second:
            return n + first + second


def account(start):
    return next(start + f"{i:02d}" + control(start + f"{i:02d}", I.ACCOUNT) for i in range(100) if control(start + f"{i:02d}", I.ACCOUNT))


FNR, KONTO = person("010190"), account("12345678")


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, tekst string")


def test_date_grammars():
    day = datetime.date
    found = lambda t: [(t[s:e], d, short) for s, e, d, short in scanners.date_hits(t, 2026)]
    assert found("12.06.2026kr DATO12.06.2026 kl") == [("12.06.2026", day(2026, 6, 12), False)] * 2
    assert found("21.04 . 1994, 8.juni.2026, 08.juni 2026, 12 March 2021, March 12, 2021, 2024-03-12") == [
        ("21.04 . 1994", day(1994, 4, 21), False), ("8.juni.2026", day(2026, 6, 8), False), ("08.juni 2026", day(2026, 6, 8), False),
        ("12 March 2021", day(2021, 3, 12), False), ("March 12, 2021", day(2021, 3, 12), False), ("2024-03-12", day(2024, 3, 12), False),
    ]
    assert found("01.06.94 og 01.06.26") == [("01.06.94", day(1994, 6, 1), True), ("01.06.26", day(2026, 6, 1), True)]
    assert found("31.02.2001 1.1.1700 1.1.2028 20261234 2024-13-01") == []


@pytest.mark.parametrize(
    "written", [FNR, f"{FNR[:6]} {FNR[6:]}", f"{FNR[:6]}-{FNR[6:]}", f"{FNR[:6]}\n{FNR[6:]}", f"{FNR[:6]}.{FNR[6:]}", f"{FNR[:2]} {FNR[2:4]} {FNR[4:6]} {FNR[6:]}", f"01.01.2024\n{FNR}"]
)
def test_a_number_is_found_however_it_is_grouped(spark, written):
    r = redaction.redact(frame(spark, f"Fødselsnummer {written} er oppgitt")).first()
    assert "[SLADDET fodselsnummer]" in r.sladdet and FNR not in r.sladdet and FNR[6:] not in r.sladdet and r.antall["fodselsnummer"] == 1


def test_dates_and_amounts_are_no_identifiers():
    taken = lambda t: [(s, e) for s, e, *_ in (*scanners.date_hits(t, 2026), *scanners.amount_hits(t))]
    for text, n in (("Vedtak datert 01.01.2024 114 kroner", 11), ("kr 103 456 789", 9), ("15 000 kr 12", 7)):
        assert scanners.number_hits(text, n, taken(text)) == []


def test_the_label_decides_between_a_person_and_an_account(spark):
    both = next(n for i in range(100000) for n in (person(f"{i % 28 + 1:02d}{i // 28 % 12 + 1:02d}{i % 100:02d}"),) if n and control(n[:10], I.ACCOUNT) == n[10])
    c = redaction.candidates(frame(spark, f"Kontonummer: {both}", f"fnr {both}", both, f"Konto {KONTO}"), ("fodselsnummer", "kontonummer"))
    assert {r.doc_id: r.type for r in c.collect()} == {0: "kontonummer", 1: "fodselsnummer", 2: "fodselsnummer", 3: "kontonummer"}


def test_redaction_of_all_kinds_and_of_nothing(spark):
    text = f"bjørn.å@post.no, +47 22 33 44 55, KID-nummer 1002345678911, konto {KONTO[:4]}.{KONTO[4:6]}.{KONTO[6:]}; faktura 22334455, kr 500,-"
    rows = {r.doc_id: r for r in redaction.redaction_report(frame(spark, text, None, "", f"fnr {FNR[:10]}{(int(FNR[10]) + 1) % 10}")).collect()}
    assert rows[0].sladdet == "[SLADDET epost], [SLADDET telefon], KID-nummer [SLADDET kid], konto [SLADDET kontonummer]; faktura 22334455, kr 500,-"
    assert rows[0].antall == {"epost": 1, "telefon": 1, "kid": 1, "kontonummer": 1} and rows[0].fullstendig
    assert rows[1].sladdet is None and rows[2].sladdet == "" and rows[1].antall == rows[2].antall == {}
    assert not rows[3].fullstendig and [(m.type, m.grunn) for m in rows[3].mistenkt] == [("fodselsnummer", "kontrollsiffer_feilet")]


def test_kinds_of_dates(spark):
    long = "fyll " * 200
    text = f"[Side 1 av 2]\nOslo, 12.06.2026\nDagpenger for perioden 01.01.2023 til og med 31.12.2023\nSøknad datert 12.03.2024\n{long}\n{FNR}\n[Side 2 av 2]\n{long}\n{long}\nMed vennlig hilsen\n03.02.2020\nfødt 1.2.1980 – 5.5.1990"
    got = {(r.dato.isoformat(), r.type, r.side) for r in D.classify(frame(spark, text, None, ""), 2026, [("fyllord", "x")]).collect()}
    assert got == {
        ("2026-06-12", "brevdato_sannsynlig", 1), ("2023-01-01", "periode_start", 1), ("2023-12-31", "periode_slutt", 1), ("2024-03-12", "soknadsdato", 1),
        ("2020-02-03", "signaturdato_sannsynlig", 2), ("1980-02-01", "periode_start", 2), ("1990-05-05", "periode_slutt", 2), ("1990-01-01", "fodselsdato_fra_fnr", None),
    }


def test_own_labels_come_first_and_equal_ranks_warn(spark):
    docs = frame(spark, "Utstedt: 01.02.2020\nVedtaksdato: 03.02.2020", "Sist sett 4.4.2020")
    d = D.classify(docs, 2026, [("sett", "observert")])
    assert {r.type for r in d.where("doc_id = 1").collect()} == {"observert"} and d.where("doc_id = 1").first().rolle == "innhold"
    r = D.document_date(d, "2020-02-02").first()
    assert r.dato.isoformat() == "2020-02-01" and r.advarsler == ["ulike_kandidater"] and len(r.alternativer) == 1


def test_amounts_and_words(spark):
    say = lambda c: spark.range(1).select(c.alias("x")).first().x
    for raw, want in (("500,-", 500.0), ("1 240,-", 1240.0), ("12.345,-", 12345.0), ("46.300", 46300.0), ("6380.00", 6380.0), ("15 OOO", 15000.0), ("x", None)):
        assert say(T.amount(F.lit(raw))) == want
    for a, b, want in (("beregningen", "beregnet", True), ("dagsats", "dagsatsen", True), ("undertegnet", "under", False), ("legeerklæringen", "legeerklaering", True), ("sak", "saken", False), ("vedtaket", "vedlegget", False)):
        assert say(contact.same_word(F.lit(a), F.lit(b))) == want, (a, b)
    assert say(T.emails(F.lit("skriv til bjørn@x.no eller a@b"))) == ["bjørn@x.no"]
    got = labelled.totals(frame(spark, "Pris kr 463,00\nTotal Km 15\nTotal Kr:\n486,00", "SUM 128 100 8 550\nkr 47 400", "å betale 12,50 kr", None)).collect()
    assert {r.doc_id: r.total for r in got} == {0: 486.0, 2: 12.5}
    assert say(labelled.labelled_amount(F.lit("Månedlig utbetaling: 80 %, månedsbeløp kr 1 234,00"), labelled.AMOUNTS["manedsbelop"])) == 1234.0


@pytest.mark.parametrize("unit", ["12-34.", "123 456 ", "a.b-c+", "kr 1 000 ", "01.02.1990 ", "1" * 30 + " "])
def test_time_grows_with_length(unit):
    """Doubling a hostile line does not quadruple the time of any scanner."""
    took = []
    for n in (20_000, 40_000, 80_000):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        taken = [(s, e) for s, e, *_ in (*scanners.date_hits(text, 2026), *scanners.amount_hits(text))]
        scanners.number_hits(text, 11, taken)
        list(scanners.phone_hits(text))
        scanners._spans(scanners._EMAIL, text)
        scanners._codes(text)
        took.append(time.perf_counter() - began)
    assert took[2] < 3.2 * took[1] + 0.05 and took[2] < 3


def test_scanners_in_sql(spark):
    scanners.register(spark)
    r = spark.sql("SELECT scan_dates('den 1.2.2020', 2026)[0].dato AS d, size(scan_numbers('12 34', 4, true)) AS n, size(scan_phones(null)) AS p").first()
    assert r.d == datetime.date(2020, 2, 1) and r.n == 1 and r.p == 0


def test_percentages_behind_a_label_are_no_amounts(spark):
    from sparkdossier.operators import labelled

    cases = {
        "Utbetalt 62,40 prosent": None, "Utbetalt: 1 000 %": None, "Utbetalt 100 prosent": None, "utbetalt 50%": None, "Utbetalt kr 62,40": 62.40, "Utbetalt 1 000 kr": 1000.0,
        "Utbetalt 80 % av dagsatsen.\nUtbetalt kr 1 234,50": 1234.50, "Utbetalt: 12 500,-": 12500.0,
    }
    rows = spark.createDataFrame(list(cases.items()), "tekst string, vil double")
    from pyspark.sql import functions as F

    for r in rows.withColumn("fikk", labelled.labelled_amount(F.col("tekst"), labelled.AMOUNTS["utbetalt_belop"])).collect():
        assert r.fikk == r.vil or (r.fikk is not None and r.vil is not None and abs(float(r.fikk) - r.vil) < 1e-9), r
