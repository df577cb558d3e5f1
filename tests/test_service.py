import json

from pyspark.sql import functions as F

from sparkdossier.operators import evaluation
from sparkdossier.operators import service as V
from sparkdossier.sources import files


def test_access_log_with_bad_lines_and_archives(spark, tmp_path):
    line = lambda t, k: json.dumps({"t": t, "klient_id": k, "sti": "/x", "kode": 200})
    (tmp_path / "a.jsonl").write_text(line("2026-01-02T00:00:00", "b") + "\nnot json\n{}\n")
    (tmp_path / "a.jsonl.1").write_text(line("2026-01-01T00:00:00", "a") + "\n")
    paths = [str(tmp_path / n) for n in ("a.jsonl", "a.jsonl.1")]
    assert sorted(r.klient_id for r in files.read_access_log(spark, paths).collect()) == ["a", "b"]
    assert [r.klient_id for r in files.read_access_log(spark, paths, "2026-01-02").collect()] == ["b"]


def test_separators_and_encodings(spark, tmp_path):
    for i, (sep, code) in enumerate(((";", "cp1252"), (",", "utf-8-sig"), ("\t", "utf-8"))):
        p = tmp_path / f"{i}.csv"
        p.write_bytes(f"navn{sep}sted\nKåre{sep}Bodø\nÅse{sep}Ås – €\n".encode(code))
        rows = files.read_separated(spark, str(p)).collect()
        assert [tuple(r) for r in rows] == [("Kåre", "Bodø"), ("Åse", "Ås – €")], code
        assert files.read_separated(spark, str(p), 1).count() == 1


def test_case_folders_and_exports(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "sak string, oppgave_id long")
    path = str(tmp_path / "saker")
    files.save_cases(rows(("a", 1), ("b", 2)), path)
    files.save_cases(rows(("a", 3)), path)
    assert sorted((r.sak, r.oppgave_id) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]
    assert [r.oppgave_id for r in files.load_case(spark, path, "b").collect()] == [2] and files.load_case(spark, path, "c").count() == 0
    out = str(tmp_path / "eksport")
    assert files.append_export(rows(("a", 1), ("b", 2)), out) == 2 and files.append_export(rows(("a", 3)), out) == 1


def test_page_texts_and_templates(spark):
    html = "<html><!-- x --><script>a<b</script><h2>Kapittel 8&nbsp;A</h2><p>En <b>to</b></p><ul><li>tre</li></ul>&lt;fire&gt;</html>"
    templates = [('{"a": "{x}", "b": ["{x} og {y}", null, 3]}', '{"x": null}'), ("no json", "{}"), (None, None)]
    r = spark.createDataFrame([(html,)], "h string").select(V.plain_text(F.col("h")).alias("t")).first()
    assert r.t == "## Kapittel 8 A\nEn to\n- tre\n<fire>"
    got = [r.j for r in spark.createDataFrame(templates, "m string, f string").select(V.merge_template(F.col("m"), F.col("f")).alias("j")).collect()]
    assert json.loads(got[0]) == {"ukjente": ["y"], "utfylt": {"a": None, "b": [" og {y}", None, 3]}} and got[1:] == [None, None]


def test_erasure_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "kilde_dokument string")
    gone = spark.createDataFrame([("a",)], "kilde_dokument string")
    assert sorted(str(r.kilde_dokument) for r in V.erase(rows, gone).collect()) == ["", "None", "b"]


def test_bootstrap_is_near_the_normal_interval_and_repeats(spark):
    rows = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("int").alias("e"), F.lit(1).alias("c"))
    a, b = (evaluation.bootstrap_interval(rows.repartition(n), "e", "c", 500).first() for n in (1, 7))
    share = rows.agg(F.avg("e")).first()[0]
    half = 1.96 * (share * (1 - share) / 4000) ** 0.5
    assert a == b and abs(a.lav - (share - half)) < 0.003 and abs(a.hoy - (share + half)) < 0.003


def test_amount_conflicts_of_labelled_cases(spark):
    """Eight cases: an amount that differs on the same date is a contradiction, any other difference is not."""
    from sparkdossier.operators import cases

    day = ("2026-01-10", "2026-02-10")
    legit = [[("d", 0, 500.0), ("d", 1, 600.0)], [("d", 0, 500.0), ("m", 0, 900.0)], [("d", 0, 500.0), ("d", 0, 500.004)], [("d", None, 500.0), ("d", 0, 600.0)], [("m", 0, 1.0), ("m", 1, 2.0)], [("d", 0, 500.0)]]
    clash = [[("d", 0, 500.0), ("d", 0, 600.0)], [("m", 1, 10.0), ("m", 1, 20.0)]]
    rows, n = [], 0
    for sak, docs in enumerate(legit + clash):
        for kind, at, value in docs:
            n += 1
            rows.append((sak, n, None if at is None else day[at], value if kind == "d" else None, value if kind == "m" else None, None, None))
    docs = spark.createDataFrame(rows, "sak long, doc_id long, dato string, dagsats double, manedsbelop double, utbetalt_belop double, tilbakebetalingsbelop double").withColumn("dato", F.col("dato").cast("date")).withColumn("behandlingsdato", F.lit(None).cast("date"))
    assert sorted({r.sak for r in cases.unequal_amounts(docs).collect()}) == [6, 7]
