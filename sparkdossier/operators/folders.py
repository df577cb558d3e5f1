"""Folders of documents that grow by calls: a document sent again is counted, not kept, and cases are found at each reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdossier.operators.cases import KEYS, group_cases, key_value

# The fields that make two posts the same document, and why a document stands alone.
SAME = ("filnavn", "tittel", "dato", "behandlingsdato", "saksnummer", "journalnummer", "fnr")
NO_KEY = "ingen_bevist_saksnokkel"


def post_key() -> Column:
    """The fields that make a post, null as empty, in one text from which each can be told."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SAME]))


def new_posts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The posts of ``incoming`` that their folder (``mappe``) lacks, each once, as the first call sends it.

    ``incoming`` holds ``mappe, kall, plass`` beside the fields: calls are in order of ``kall``, posts of a call in order of
    ``plass``. The first of each post is found by a minimum, so a post sent a great many times is never gathered.
    """
    rows = incoming.where("mappe is not null").select("mappe", post_key().alias("_key"), F.struct("kall", "plass", F.struct(*incoming.columns).alias("post")).alias("_row"))
    first = rows.groupBy("mappe", "_key").agg(F.min_by("_row", F.struct("_row.kall", "_row.plass")).alias("_row"))
    known = stored.select("mappe", post_key().alias("_key")).distinct()
    return first.join(known, ["mappe", "_key"], "left_anti").select("_row.post.*")


def calls(incoming: DataFrame, added: DataFrame) -> DataFrame:
    """``mappe, kall, lagt_til, duplikater`` of each call, ``added`` being its ``new_posts``."""
    sent = incoming.where("mappe is not null").groupBy("mappe", "kall").agg(F.count(F.lit(1)).alias("_sent"))
    kept = added.groupBy("mappe", "kall").agg(F.count(F.lit(1)).alias("_kept"))
    n = F.coalesce("_kept", F.lit(0))
    return sent.join(kept, ["mappe", "kall"], "left").select("mappe", "kall", n.alias("lagt_til"), (F.col("_sent") - n).alias("duplikater"))


def versions(reports: DataFrame) -> DataFrame:
    """``mappe, versjon, dokumenter, duplikater`` over all calls of a folder: a version for each call that added something."""
    return reports.groupBy("mappe").agg(
        F.count_if(F.col("lagt_til") > 0).alias("versjon"), F.sum("lagt_til").alias("dokumenter"), F.sum("duplikater").alias("duplikater")
    )


def folder_cases(posts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``mappe, doc_id, sak``: cases within each folder, or within ``folders`` only (a table of ``mappe``), found anew.

    Nothing of a case is kept between readings, so a post that ties two cases together needs no repair. ``doc_id`` is unique
    over all folders.
    """
    if folders is not None:
        posts = posts.join(folders.select("mappe").distinct(), "mappe", "left_semi")
    return group_cases(posts.select("mappe", "doc_id", *KEYS), within=["mappe"])


def case_grounds(cased: DataFrame) -> DataFrame:
    """``mappe, sak, felt, verdi, baerer, dokumenter, grunn``: the key that names a case and how many documents carry it.

    The strongest key with a value names the case, by its least value. A case without one has ``grunn`` instead.
    """
    marks = F.array(*[F.struct(F.lit(i).alias("nr"), F.lit(k).alias("felt"), key_value(k).alias("verdi")) for i, k in enumerate(KEYS)])
    carried = cased.select("sak", F.explode(marks).alias("m")).where("m.verdi is not null").groupBy("sak", "m").agg(F.count(F.lit(1)).alias("baerer"))
    name = carried.groupBy("sak").agg(F.min(F.struct("m", "baerer")).alias("x"))
    size = cased.groupBy("mappe", "sak").agg(F.count(F.lit(1)).alias("dokumenter"))
    return size.join(name, "sak", "left").select(
        "mappe", "sak", "x.m.felt", "x.m.verdi", F.coalesce("x.baerer", F.lit(0)).alias("baerer"), "dokumenter", F.when(F.col("x").isNull(), NO_KEY).alias("grunn")
    )
