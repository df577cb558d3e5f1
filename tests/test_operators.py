import pytest
from pyspark.sql import functions as F

from sparkdossier.functions import identifiers as I
from sparkdossier.functions import text as T
from sparkdossier.operators import evaluation, logs, spans
from sparkdossier.operators.graph import connected_components
from sparkdossier.streaming import events


def test_components_of_chain_star_and_empty(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def one(spark, **columns):
    df = spark.createDataFrame([("x",)], "x string").select(*[c.alias(k) for k, c in columns.items()])
    return df.first()


def test_identifiers(spark):
    def company(n):
        k = (11 - sum(int(a) * w for a, w in zip(n, I.COMPANY)) % 11) % 11
        return n + str(k) if k < 10 else None

    good = next(company(str(n)) for n in range(81000001, 81000100) if company(str(n)))
    r = one(spark, a=I.valid_company(F.lit(good)), b=I.valid_company(F.lit("12345678x")), c=I.valid_company(F.lit(None).cast("string")), d=I.birth_date(F.lit("29020150000")), e=I.birth_date(F.lit("15037595000")))
    assert (r.a, r.b, r.c, r.d) == (True, False, False, None)
    assert str(r.e) == "1975-03-15"


def test_text_scalars(spark):
    r = one(
        spark, a=T.amount(F.lit("1 240,00")), b=T.amount(F.lit("1.240.50")), c=T.amount(F.lit("12.345")), d=T.route(F.lit("/api/v1/dokument/operasjoner/3?x=1")),
        e=T.route(F.lit("/sak")), f=T.fold(F.lit("Sjøålaae")), g=T.guess_language(F.lit("det er en sak som er av og til")), h=T.plausibility(F.lit("ãã ab")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (1240.0, 1240.5, 12345.0, "/dokument/operasjoner", "annet", "sjoalaa".replace("aa", "a"))
    assert r.g == "norsk" and r.h == 0.0


def test_job_moves(spark):
    r = one(spark, a=logs.legal_move(F.lit("kø"), F.lit("Ferdig")), b=logs.legal_move(F.lit("ferdig"), F.lit("feil")), c=logs.legal_move(F.lit("pågår"), F.lit("avbrytes")))
    assert (r.a, r.b, r.c) == (False, False, True)


def test_greedy_and_pages(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 5, 6), (1, 5, 8)], "doc_id long, start long, slutt long")
    assert sorted((r.start, r.slutt) for r in spans.greedy(s).collect()) == [(0, 5), (5, 8)]
    d = spark.createDataFrame([(1, "x[Side 1 av 2]\nab[Side 2 av 2]"), (2, "ingen"), (3, None)], "doc_id long, tekst string")
    assert [(r.doc_id, r.side, r.start, r.tekst) for r in spans.pages(d).orderBy("side").collect()] == [(1, 1, 1, "ab"), (1, 2, 17, "")]


def test_callers_of_unknown_path(spark):
    log = spark.createDataFrame([("a", "/x", 200)], "klient_id string, sti string, kode int")
    with pytest.raises(ValueError):
        logs.callers(log, "/y")


def test_calibration_edges(spark):
    p = spark.createDataFrame([(-1.0, True), (1.5, False), (0.5, True)], "konfidens double, riktig boolean")
    assert sorted((r.botte, r.antall) for r in evaluation.calibration(p).collect()) == [(1, 1), (4, 2)]
    assert evaluation.expected_calibration_error(p.limit(0)).first().ece == 0.0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2026-01-01 00:0{i % 3}:0{i % 7}", f"k{i % 2}", "/dokument", 200) for i in range(20)]
    log = spark.createDataFrame(rows, "t string, klient_id string, sti string, kode int").withColumn("t", F.to_timestamp("t"))
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = events.route_counts(stream).writeStream.format("memory").queryName("ruter").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("ruter").collect() == logs.routes(log).collect()
    out = str(tmp_path / "out")
    for i in range(2):
        events.append_new(stream.select("klient_id", "sti"), out, str(tmp_path / f"c{i}"), ["klient_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_components_of_large_ids(spark):
    near = 1 << 62
    edges = [(near + i, near + i + 1) for i in range(0, 20, 2)] + [(near + 1, near + 2), ((1 << 63) - 1, near)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[(1 << 63) - 1] == got[near + 3] == near and got[near + 9] == near + 8
