"""Where each value of a profile comes from: a table of pointers with method, confidence, reason, page, and whether the page is sure.

The table is a projection of what a profile holds already; nothing is judged anew. Pages of values are found by one search of the
row's text for all its values together, in the row's own task: a document's values are never more than its profile holds, so
nothing is grouped or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from sparkdossier.functions import automaton

LEVELS = ("ingen", "viktige", "alle")
# Methods of a date by its source; methods and confidence of a party by its evidence; reasons; form sources.
DATE_METHODS = {"etikett": "etikett", "posisjon": "posisjon", "pdf_metadata": "metadata"}
PARTY_METHODS = {"etikett": "etikett"}
PARTY_CONFIDENCE = {"etikett": "hoy", "flertydig": "lav", "bare_andre_roller": "ingen", "umerket": "lav", "ingen": "ingen"}
NAME_BESIDE = "Navnet står ved siden av det beviste fødselsnummeret"
BIRTH_DERIVED = "Regnet ut av fødselsnummerets seks første siffer — står ikke nødvendigvis skrevet i dokumentet"
ACCOUNT, REFERENCE, COMPANY = "Elleve siffer som består mod11", "KID-nummer som består mod10/mod11", "Ni siffer som består mod11"
LABELLED = "Hentet fordi etiketten står i dokumentet (R71)"
BY_FORM, ADDRESS = "Formvalidert (lengde/mønster)", "Gate + postnummer + poststed sto sammen"
DECODED, BENEFIT, TYPE = "Dekodet av pyzbar, ikke lest som tekst", "Kjent ytelsesnavn funnet i teksten", "Klassifisert av tittel- og ordmønstre"
BY_MODEL, BY_RULE = "Fylt av språkmodellen — ikke bevist i dokumentet", "Bevist deterministisk av uttrekket"
LABELLED_FIELDS = (
    "sak.saksnummer", "sak.journalnummer", "sak.vedtaksnummer", "sak.dokumentnummer", "okonomi.dagsats", "okonomi.manedsbelop", "okonomi.utbetalt_belop", "arbeid.arbeidsgiver",
    "arbeid.stilling", "arbeid.stillingsprosent",
)

_ENTRY = "struct<peker:string,metode:string,konfidens:string,begrunnelse:string,verdi:string,annen:string,sted:int,side:int,entydig:boolean>"


def _type_at(schema: StructType, path: str) -> DataType | None:
    """Type of a nested field; None where the schema has none of that name."""
    kind: DataType = schema
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def _mapped(c: Column, values: dict[str, str]) -> Column:
    out = F.lit("ingen")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _filled(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.when(c != "", c)


def _number(c: Column) -> tuple[Column, Column]:
    """A number as it is printed (``1234.0``), and as amounts are written (two decimals)."""
    c = c.cast("double")
    exact = F.regexp_replace(c.cast("decimal(30,10)").cast("string"), r"0+$", "")
    return F.when(exact.endswith("."), F.concat(exact, F.lit("0"))).otherwise(exact), c.cast("decimal(30,2)").cast("string")


def _spelled(c: Column, kind: DataType) -> tuple[Column, Column]:
    """A value as text, and its second spelling (of fractions only)."""
    if kind.simpleString() in ("double", "float") or kind.simpleString().startswith("decimal"):
        return _number(c)
    return c.cast("string"), F.lit(None).cast("string")


def _entry(pointer: Column | str, method: Column | str, sure: Column | str, reason: Column | str | None, value: Column | None = None, second: Column | None = None, place: Column | None = None,
           side: Column | None = None, unique: Column | None = None) -> Column:
    given = [F.lit(x) if x is None or isinstance(x, str) else x for x in (pointer, method, sure, reason, value, second, place, side, unique)]
    return F.struct(*given).cast(_ENTRY)


def _entries(profile: DataFrame, level: str) -> Column:
    """The row's entries as an array, those of fields without a value left out but for the two that always stand."""
    schema = profile.schema

    def at(path: str, kind: str = "string") -> Column:
        return F.col(path).cast(kind) if _type_at(schema, path) is not None else F.lit(None).cast(kind)

    def listed(path: str, method: str, sure: str, reason: str, value: str | None = "") -> Column | None:
        kind = _type_at(schema, path)
        if not isinstance(kind, ArrayType):
            return None
        root = F.lit(f"/dokumentprofil/{path.replace('.', '/')}/")

        def one(x: Column, i: Column) -> Column:
            pointer = F.concat(root, i.cast("string"))
            if value is None:
                return _entry(pointer, method, sure, reason, side=x["side"] if isinstance(kind.elementType, StructType) else None)
            return _entry(pointer, method, sure, reason, x[value] if value else x.cast("string"))

        return F.coalesce(F.transform(F.col(path), one), F.array().cast(f"array<{_ENTRY}>"))

    ground, number, place = at("part.grunnlag"), at("part.fnr"), at("part.posisjon", "int")
    party, sure = _mapped(ground, PARTY_METHODS), _mapped(ground, PARTY_CONFIDENCE)
    known = F.when(place.isNotNull(), True)
    date_sure, date_side = F.coalesce(_filled(at("dokument.dato_sikkerhet")), F.lit("ingen")), at("dokument.dato_side", "int")
    single = [
        _entry("/dokumentprofil/part/fnr", party, sure, at("part.begrunnelse"), number, place=place, unique=known),
        _entry("/dokumentprofil/dokument/dato", _mapped(at("dokument.dato_kilde"), DATE_METHODS), date_sure, at("dokument.dato_begrunnelse"), side=date_side, unique=F.when(date_side.isNotNull(), True)),
    ]
    lists: list[Column | None] = []
    if level == "alle":
        name, word = at("part.navn"), at("ytelse.ord")
        text = _filled(F.col("tekst"))
        single += [
            F.when(name != "", _entry("/dokumentprofil/part/navn", party, sure, NAME_BESIDE, name, place=place, unique=known)),
            F.when(at("part.fodselsdato").isNotNull(), _entry("/dokumentprofil/part/fodselsdato", "avledet", sure, BIRTH_DERIVED)),
            F.when(at("gjeldende_lov.lov") != "", _entry("/dokumentprofil/gjeldende_lov/lov", "avledet", date_sure, at("gjeldende_lov.begrunnelse"))),
        ]
        for path in LABELLED_FIELDS:
            kind = _type_at(schema, path)
            if kind is not None:
                single.append(F.when(F.col(path).isNotNull(), _entry(f"/dokumentprofil/{path.replace('.', '/')}", "etikett", "hoy", LABELLED, *_spelled(F.col(path), kind))))
        single += [
            F.when(word != "", _entry("/dokumentprofil/ytelse/navn", "regel", "middels", BENEFIT, word)),
            F.when(at("dokument.type.kode") != "", _entry("/dokumentprofil/dokument/type", "regel", "middels", TYPE, side=F.when(text.isNotNull(), 1), unique=F.when(text.isNotNull(), True))),
        ]
        lists = [
            listed("okonomi.kontonummer", "sjekksum", "hoy", ACCOUNT), listed("okonomi.kid", "sjekksum", "hoy", REFERENCE),
            listed("arbeid.organisasjonsnummer", "sjekksum", "hoy", COMPANY), listed("kontakt.telefoner", "regel", "hoy", BY_FORM), listed("kontakt.eposter", "regel", "hoy", BY_FORM),
            listed("kontakt.adresser", "etikett", "middels", ADDRESS, "gate"), listed("koder.qr", "strekkode", "hoy", DECODED, None), listed("koder.strekkode", "strekkode", "hoy", DECODED, None),
        ]
    return F.concat(F.array_compact(F.array(*single)), *(x for x in lists if x is not None))


def provenance(profile: DataFrame, level: str = "viktige") -> DataFrame:
    """``doc_id, peker, metode, konfidens, begrunnelse, side, side_entydig``: a row for each value of each profile.

    ``profile`` has ``doc_id, tekst`` and whatever it knows of the sections ``part`` (``fnr, navn, fodselsdato, grunnlag, begrunnelse,
    posisjon``), ``dokument`` (``dato_kilde, dato_sikkerhet, dato_begrunnelse, dato_side, type.kode``), ``gjeldende_lov``, ``okonomi``,
    ``arbeid``, ``sak``, ``kontakt``, ``koder`` and ``ytelse`` (``ord``, as the text has it); other columns are not looked at, and a
    section that the table lacks has no values. Level ``ingen`` gives no row, ``viktige`` the party's number and the document's
    date, which stand even where there is nothing to tell, ``alle`` every value.

    The page is that of the first place of the value, verbatim or by letters and digits alone, or that of the place the profile
    states; null before the first marker, 1 without any. ``side_entydig`` is whether the value stands there alone. Both are null
    without a text (unless the profile states the page) and for values that are derived. Each of rows that repeat a doc_id gives
    its rows.
    """
    if level not in LEVELS:
        raise ValueError(f"level is one of {LEVELS}, not {level!r}")
    rows = profile.select("doc_id", "tekst", _entries(profile, level).alias("o"))
    if level == "ingen":
        rows = rows.where(F.lit(False))
    rows = rows.withColumn("f", automaton.scan_values(F.col("tekst"), F.col("o.verdi"), F.col("o.annen"), F.col("o.sted")))
    out = rows.select("doc_id", F.explode(F.arrays_zip("o", "f")).alias("x")).select("doc_id", "x.o.*", F.col("x.f.side").alias("funnet"), F.col("x.f.antall").alias("antall"))
    alone = F.coalesce("entydig", F.when(F.col("verdi") != "", F.col("antall") <= 1))
    return out.select("doc_id", "peker", "metode", "konfidens", _filled(F.col("begrunnelse")).alias("begrunnelse"), F.coalesce("side", "funnet").alias("side"), alone.alias("side_entydig"))


def without_omitted(pointers: DataFrame, omitted: DataFrame) -> DataFrame:
    """Pointers but for those into sections (``doc_id, utelatt`` as an array) that a document's answer leaves out; all of a document without any."""
    left_out = omitted.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("utelatt"))).alias("utelatt"))
    joined = pointers.join(left_out, "doc_id", "left")
    closed = F.exists(F.coalesce("utelatt", F.array().cast("array<string>")), lambda s: F.col("peker").startswith(F.concat(F.lit("/dokumentprofil/"), s, F.lit("/"))))
    return joined.where(~F.coalesce(closed, F.lit(False))).drop("utelatt")


def form_provenance(filled: DataFrame) -> DataFrame:
    """The same table for filled fields (``doc_id, felt, kilde``): what a model filled is weakly, all else strongly supported."""
    model = F.coalesce(F.col("kilde") == "modell", F.lit(False))
    return filled.select(
        "doc_id", F.concat(F.lit("/skjema/skjema/"), "felt").alias("peker"), F.when(model, "modell").otherwise("regel").alias("metode"), F.when(model, "lav").otherwise("hoy").alias("konfidens"),
        F.when(model, BY_MODEL).otherwise(BY_RULE).alias("begrunnelse"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("boolean").alias("side_entydig"),
    )
