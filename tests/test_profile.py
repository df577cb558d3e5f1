import random
import re

import pytest
from pyspark.sql import functions as F

from sparkdossier.functions import automaton as A
from sparkdossier.operators import provenance as P
from sparkdossier.operators import subjects as S

PROFILE = (
    "doc_id long, tekst string, part struct<fnr:string,navn:string,fodselsdato:date,grunnlag:string,begrunnelse:string,posisjon:int>,"
    "dokument struct<dato_kilde:string,dato_sikkerhet:string,dato_begrunnelse:string,dato_side:int,type:struct<kode:string>>, gjeldende_lov struct<lov:string,begrunnelse:string>,"
    "okonomi struct<kontonummer:array<string>,dagsats:double>, kontakt struct<eposter:array<string>,adresser:array<struct<gate:string,sted:string>>>, koder struct<qr:array<struct<side:int>>>,"
    "ytelse struct<ord:string>, peker string"
)
TEXT = "Omslag 999888777\n[Side 1 av 3]\nKonto 1234.56.78903\nkr 1 234,00\n[Side 2 av 3]\nKonto 12345678903 Storgata 1\n[Side 3 av 3]\na@b.no Ola a@b.no"


def row(i, text, **sections):
    return (i, text, *(sections.get(k) for k in ("part", "dokument", "lov", "okonomi", "kontakt", "koder", "ytelse")), "x")


def pointers(spark, rows, level="alle"):
    got = P.provenance(spark.createDataFrame(rows, PROFILE), level).collect()
    return {(r.doc_id, r.peker.removeprefix("/dokumentprofil/")): (r.metode, r.konfidens, r.side, r.side_entydig) for r in got}


def test_pages_of_values(spark):
    got = pointers(spark, [row(
        1, TEXT, part=("01017012345", "Ola", None, "etikett", "under X", TEXT.index("Storgata")), dokument=("pdf_metadata", "lav", "", None, ("vedtak",)), lov=("ftl", "b"),
        okonomi=(["12345678903", "999888777", "55555", ""], 1234.0), kontakt=(["a@b.no"], [("Storgata 1", "Bø")]), koder=([(3,), (None,)],), ytelse=("kontopenger",),
    )])
    assert got == {
        (1, "part/fnr"): ("etikett", "hoy", 2, True), (1, "part/navn"): ("etikett", "hoy", 2, True), (1, "dokument/dato"): ("metadata", "lav", None, None),
        (1, "gjeldende_lov/lov"): ("avledet", "lav", None, None), (1, "dokument/type"): ("regel", "middels", 1, True),
        (1, "okonomi/kontonummer/0"): ("sjekksum", "hoy", 2, False),  # verbatim on page 2, grouped on page 1: the verbatim place counts
        (1, "okonomi/kontonummer/1"): ("sjekksum", "hoy", None, True),  # before the first marker
        (1, "okonomi/kontonummer/2"): ("sjekksum", "hoy", None, True), (1, "okonomi/kontonummer/3"): ("sjekksum", "hoy", None, None),
        (1, "okonomi/dagsats"): ("etikett", "hoy", 1, True), (1, "kontakt/eposter/0"): ("regel", "hoy", 3, False), (1, "kontakt/adresser/0"): ("etikett", "middels", 2, True),
        (1, "koder/qr/0"): ("strekkode", "hoy", 3, None), (1, "koder/qr/1"): ("strekkode", "hoy", None, None), (1, "ytelse/navn"): ("regel", "middels", None, True),
    }


def test_levels_and_missing_sections(spark):
    rows = [row(1, None), row(2, "", part=("1", None, None, "flertydig", None, 5)), row(2, "", part=("1", None, None, "flertydig", None, 5)), row(3, "uten merker Ola", part=(None, "Ola", None, "umerket", None, None))]
    assert pointers(spark, rows, "ingen") == {}
    assert set(k for _, k in pointers(spark, rows, "viktige")) == {"part/fnr", "dokument/dato"}
    got = pointers(spark, rows)
    assert got[1, "part/fnr"] == ("ingen", "ingen", None, None) and got[2, "part/fnr"] == ("ingen", "lav", 1, True) and got[3, "part/navn"] == ("ingen", "lav", 1, True)
    assert P.provenance(spark.createDataFrame(rows, PROFILE), "viktige").count() == 8
    assert P.provenance(spark.createDataFrame([(1, "t")], "doc_id long, tekst string"), "alle").count() == 2
    assert P.provenance(spark.createDataFrame([], PROFILE), "alle").count() == 0
    with pytest.raises(ValueError):
        P.provenance(spark.createDataFrame([], PROFILE), "noen")


def test_omitted_sections_and_forms(spark):
    kept = P.provenance(spark.createDataFrame([row(1, TEXT, koder=([(1,)],)), row(2, TEXT, koder=([(1,)],))], PROFILE), "alle")
    left = P.without_omitted(kept, spark.createDataFrame([(1, ["part", "kod"]), (1, ["koder"])], "doc_id long, utelatt array<string>"))
    assert sorted((r.doc_id, r.peker.split("/")[2]) for r in left.collect()) == [(1, "dokument"), (2, "dokument"), (2, "koder"), (2, "part")]
    assert [(r.peker, r.metode, r.konfidens) for r in P.form_provenance(spark.createDataFrame([(1, "a", "modell"), (1, "b", "deterministisk"), (1, "c", None)], "doc_id int, felt string, kilde string")).collect()] == [
        ("/skjema/skjema/a", "modell", "lav"), ("/skjema/skjema/b", "regel", "hoy"), ("/skjema/skjema/c", "regel", "hoy"),
    ]


def test_value_places_against_search():
    rng = random.Random(5)
    strip = lambda t: re.sub(r"[\W_]", "", t).lower()
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "1", ".", " ", "B", "[Side 4 av 9]"]) for _ in range(rng.randrange(1, 60)))
        values = [("".join(rng.choice("ab1. B") for _ in range(rng.randrange(1, 5))), None, None) for _ in range(6)]
        for (v, *_), got in zip(values, A.value_places(text, values), strict=True):
            if not v.strip():
                assert got["start"] is None and got["antall"] == 0
                continue
            n, flat, at = strip(v), strip(text), [i for i, c in enumerate(text) if c.isalnum()]
            where = text.find(v)
            if where < 0:
                where = at[flat.find(n)] if n and n in flat else None
            times = 2 if text.count(v) >= 2 else min(2, flat.count(n)) if n else text.count(v)
            assert (got["start"], got["antall"]) == (where, times), (text, v)
            marks = [m.start() for m in re.finditer(r"\[Side", text)]
            assert got["side"] == (None if where is None else 1 if not marks else 4 if where >= marks[0] else None)


def test_word_hits_against_all_pairs():
    rng, words = random.Random(6), ["ab", "abc", "bc", "bcd", "d", "abcd", "cc"]
    built = A.automaton(words)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(30))
        every = [(m, m + len(w), w) for w in words for m in range(len(text)) if text.startswith(w, m)]
        want = sorted(h for h in every if not any(o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in every))
        assert A.word_hits(text, built) == want


def test_types_of_documents(spark):
    cases = {
        "Klage på vedtak om dagpenger\nvedtak vedtak vedtak": ("klage", "tittel"), "[Side 1 av 2]\nForfallsdato: 24.06.2026\nVedtak om sykepenger": ("vedtak", "tittel"),
        "Klagevedtak\nx": ("klagevedtak", "tittel"), "SØKNAD om noe": ("soknad", "tittel"), "Soeknad": ("soknad", "tittel"), "Hei\nhei\nEn faktura og en attest, attest": ("attest", "tekst"),
        "Hei\nhei\nen faktura, en attest": ("faktura", "tekst"), "Hei\nhei\nAvtalen. Kjære deg": ("kontrakt", "tekst"), "Hei": ("", None), "": ("", None), None: ("", None),
        "Retur-slipp\r\nDokumenttype: Egenerklæring": ("returslipp", "tittel"), "Beklager\nbeklagelse\nklager": ("klage", "tekst"),
    }
    rows = list(cases)
    got = {rows[r.doc_id]: (r.type, r.kilde) for r in S.document_types(spark.createDataFrame(list(enumerate(rows)), "doc_id int, tekst string")).collect()}
    assert got == cases


BROAD = "Er du sykmeldt, søk sykepenger. Med nedsatt arbeidsevne arbeidsavklaringspenger, over 62 alderspensjon. Se også uføretrygd."


def test_the_benefit_a_document_concerns(spark, tmp_path):
    rules = tmp_path / "skjema.txt"
    rules.write_text("﻿# numre\nNAV 04-01.03 = Sykepenger\nNAV 04-01.03 = dagpenger # siste\nNAV 99-99.99 = ukjent\n\nuten likhet\n", encoding="utf-8")
    forms = S.read_form_benefits(spark, str(rules))
    assert [tuple(r) for r in forms.collect()] == [("NAV 04-01.03", "dagpenger")]
    texts = [
        f"NAV 04-01.03\nSøknad om foreldrepenger\n{BROAD}", f"NAV 99-99.99\nSøknad om foreldrepengar ved fødsel\n{BROAD}", f"Brev\nhei\n{BROAD}", f"Legeerklæring\nved arbeidsuførhet\n{BROAD}",
        "Brev\nhei\nDu får sjukepengar, altså sykepenger", "Legeerklæring\nved noe\nKun sykepenger", "Vedtak\nx\ny", "", None, "Vedtak\nom noe\nuførepensjon og kontantstøtte, KONTANTSTOETTE",
    ]
    wide = ["sykepenger", "arbeidsavklaringspenger", "alderspensjon", "uforetrygd"]
    want = [
        ("dagpenger", "skjemanummer", None, []), ("foreldrepenger", "tittel", None, []), (None, None, "flere_i_teksten", wide), (None, None, "generisk_blankett", wide),
        ("sykepenger", "tekst", None, []), (None, None, "generisk_blankett", ["sykepenger"]), (None, None, None, []), (None, None, None, []), (None, None, None, []),
        (None, None, "flere_i_teksten", ["uforepensjon", "kontantstotte"]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, tekst string")
    assert [(r.navn, r.kilde, r.grunn, r.kandidater) for r in S.document_benefits(docs, forms).orderBy("doc_id").collect()] == want
    assert S.document_benefits(docs).where("doc_id = 0").first().navn == "foreldrepenger"
    assert docs.select(S.benefits(F.col("tekst")).alias("b")).first().b == ["foreldrepenger", *wide]
    assert S.spellings("sykepenger") == {"sykepenger", "sykepengar", "sjukepenger", "sjukepengar"}
