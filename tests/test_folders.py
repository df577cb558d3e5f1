"""Trees and runs held against each other; folders that grow by calls, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from sparkdossier.functions import trees
from sparkdossier.operators import folders, runs, service
from sparkdossier.streaming import folders as stream

POST = "mappe string, kall long, plass int, doc_id long, filnavn string, tittel string, dato string, behandlingsdato string, saksnummer string, journalnummer string, fnr string"


def diff(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(trees.differences(F.col("a"), F.col("b")).alias("d")).first()
    return [tuple(x) for x in row.d]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ({"a": 1, "b": [1, {"c": "x"}]}, {"b": [1, {"c": "x"}], "a": 1.0}, []),
        ({"a": {"tid_sekunder": 1, "x": 2}}, {"a": {"x": 2, "tid_sekunder": None}}, []),
        ({"a": {"b": 1}}, {"a": {"c": 1}}, [(".a.b", "finnes", "MANGLER"), (".a.c", "MANGLER", "finnes")]),
        ({"a": [1, 2]}, {"a": [1]}, [(".a[]", "2 elementer", "1 elementer")]),
        ({"a": [1, {"b": None}]}, {"a": [2, {"b": False}]}, [(".a[0]", "1", "2"), (".a[1].b", "null", "false")]),
        ({"a": True}, {"a": 1}, [(".a", "true", "1")]),
        ({"a": []}, {"a": {}}, [(".a", "liste", "objekt")]),
        (None, None, []),
        ("æ", "ø", [("(rot)", '"æ"', '"ø"')]),
    ],
)
def test_differences(spark, a, b, want):
    assert diff(spark, json.dumps(a), json.dumps(b)) == want


def test_unreadable_trees(spark):
    deep = "[" * 200_000
    assert diff(spark, None, "{}") == [("(rot)", "MANGLER", "finnes")]
    assert diff(spark, "{", deep) == [] and diff(spark, "NaN", "NaN ") == []
    texts = [(None,), ("{",), (deep,), ('{"b":1, "a":{"tid_sekunder":3,"s":"\\"tid_sekunder\\":1,"}}',), ('"\\ud800"',)]
    got = [r[0] for r in spark.createDataFrame(texts, "j string").select(trees.canonical(F.col("j"))).collect()]
    assert got == [None, None, None, '{"a":{"s":"\\"tid_sekunder\\":1,"},"b":1}', '"?"']
    same = spark.createDataFrame([('{"a":1,"b":null,"tid_sekunder":null}',), ('{"b":null,"a":1}',)], "j string").select(service.stable_hash(F.col("j")).alias("h"))
    assert same.distinct().count() == 1


@pytest.mark.parametrize("n", [1, 4, 200])
def test_runs_do_not_depend_on_partitions(spark, n):
    rows = [(k, r, json.dumps({"x": k, "y": 1 if (k, r) == (3, 2) else 0, "tid_sekunder": r})) for k in range(5) for r in range(1, 4)] + [(9, 1, None)]
    t = spark.createDataFrame(rows, "doc_id long, kjoring int, json string").repartition(n)
    got = {tuple(r) for r in runs.determinism(t, ["doc_id"], "kjoring").collect()}
    assert got == {(k, 3, int(k == 3), 1 + int(k == 3)) for k in range(5)} | {(9, 1, 0, 1)}
    one, two = (t.where(F.col("kjoring") == i).drop("kjoring") for i in (1, 2))
    assert {tuple(r) for r in runs.tree_differences(one, two, ["doc_id"]).collect()} == {(3, ".y", "0", "1")}


def post(folder, call, place, doc, name="a.pdf", case=None, journal=None):
    return (folder, call, place, doc, name, None, "2024-01-01", None, case, journal, None)


def test_posts_are_added_once(spark):
    stored = spark.createDataFrame([post("f", 0, 0, 1)], POST)
    sent = [post("f", 1, 0, 2), post("f", 1, 1, 3, "b.pdf"), post("f", 1, 2, 4, "b.pdf"), post("f", 2, 0, 5, "b.pdf"), post("g", 1, 0, 6), post(None, 1, 0, 7), post("g", 2, 0, 8, None), post("g", 2, 1, 9, "")]
    incoming = spark.createDataFrame(sent, POST)
    new = folders.new_posts(stored, incoming)
    assert sorted(r.doc_id for r in new.collect()) == [3, 6, 8]
    reports = folders.calls(incoming, new)
    assert {tuple(r) for r in reports.collect()} == {("f", 1, 1, 2), ("f", 2, 0, 1), ("g", 1, 1, 0), ("g", 2, 1, 1)}
    assert {tuple(r) for r in folders.versions(reports).collect()} == {("f", 1, 1, 3), ("g", 2, 2, 1)}
    assert folders.new_posts(stored, incoming.limit(0)).count() == 0


def test_cases_stay_within_folders(spark):
    posts = [post("f", 1, 0, 1, case="1 2"), post("f", 1, 1, 2, case="12", journal="J"), post("f", 1, 2, 3, journal="J"), post("g", 1, 0, 4, case="12"), post("g", 1, 1, 5), post("h", 1, 0, 6, journal=" ")]
    t = spark.createDataFrame(posts, POST)
    got = {tuple(r) for r in folders.case_grounds(folders.folder_cases(t)).collect()}
    alone = (None, None, 0, 1, folders.NO_KEY)
    assert got == {("f", 1, "saksnummer", "12", 2, 3, None), ("g", 4, "saksnummer", "12", 1, 1, None), ("g", 5, *alone), ("h", 6, *alone)}
    touched = folders.folder_cases(t, spark.createDataFrame([("g",), ("g",)], "mappe string"))
    assert {(r.doc_id, r.sak) for r in touched.collect()} == {(4, 4), (5, 5)}


def test_stream_of_posts(spark, tmp_path):
    inbox, path = str(tmp_path / "inn"), str(tmp_path / "ut")
    feed = lambda: spark.readStream.schema(POST).parquet(inbox)

    def send(rows, checkpoint):
        spark.createDataFrame(rows, POST).coalesce(1).write.mode("append").parquet(inbox)
        stream.keep_posts(feed(), path, str(tmp_path / checkpoint), parts=4).awaitTermination()

    send([post("f", 1, 0, 1, case="1"), post("f", 1, 1, 2, "b", journal="J"), post("g", 1, 0, 3)], "c")
    assert {tuple(r) for r in stream.folder_versions(spark, path).collect()} == {("f", 1, 2, 0), ("g", 1, 1, 0)}
    send([post("f", 2, 0, 4, case="1"), post("f", 3, 0, 5, "c", case="1", journal="J")], "c")
    assert {tuple(r) for r in stream.folder_versions(spark, path).collect()} == {("f", 2, 3, 1), ("g", 1, 1, 0)}
    kept = stream.folder_posts(spark, path)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    # The last batch again, as after a loss before it was marked as done.
    for mark in (tmp_path / "c" / "commits").glob("*1*"):
        mark.unlink()
    stream.keep_posts(feed(), path, str(tmp_path / "c"), parts=4).awaitTermination()
    assert (tmp_path / "c" / "commits" / "1").exists()
    assert {tuple(r) for r in stream.folder_versions(spark, path).collect()} == {("f", 2, 3, 1), ("g", 1, 1, 0)}
    kept = stream.folder_posts(spark, path)  # a table listed before a batch is run again names files that are gone
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    # A post that ties two cases together: they are one at the next reading.
    assert {(r.doc_id, r.sak) for r in folders.folder_cases(kept).collect()} == {(1, 1), (2, 1), (3, 3), (5, 1)}
