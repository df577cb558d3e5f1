"""Tables of a scale folder, and case tables derived from them by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to two tasks a core where its files give less than one: a short row may stand for a long text.

    Rows of large tables stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def derived(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """Runs ``sql``, in which tables stand in braces, over the tables of a folder; with ``deal``, over orders dealt to all cores."""
    import re

    given = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    if deal:
        given["orders"] = dealt(given["orders"], "o_orderkey")
    return spark.sql(sql, **given)


def bare(sql: str) -> str:
    """The same SQL with plain table names."""
    return sql.replace("{", "").replace("}", "")


#: Case documents, one per order: keys, dates, types, persons and labelled amounts, with gaps.
CASE_DOCS = """
SELECT o_orderkey AS doc_id, 'fil' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '.pdf' AS filnavn,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' 7' ELSE '7' END END AS saksnummer,
  CASE WHEN o_orderkey % 40 = 0 THEN 'J' || CAST(o_orderkey % 997 AS STRING) END AS journalnummer,
  CASE o_orderkey % 8 WHEN 0 THEN 'soknad' WHEN 1 THEN 'vedtak' WHEN 2 THEN 'klage' WHEN 3 THEN 'klagevedtak'
    WHEN 4 THEN 'dokumentasjonskrav' WHEN 5 THEN 'purring' WHEN 6 THEN 'notat' ELSE 'brev' END AS type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dato,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS behandlingsdato,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN lpad(CAST(o_custkey + 1 AS STRING), 11, '0') ELSE lpad(CAST(o_custkey AS STRING), 11, '0') END AS fnr,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS DOUBLE) * 100 END AS dagsats,
  CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 5 AS DOUBLE) * 1000 END AS manedsbelop,
  CASE WHEN o_orderkey % 6 = 2 THEN CAST(o_orderkey % 3 AS DOUBLE) * 50 END AS utbetalt_belop,
  CAST(NULL AS DOUBLE) AS tilbakebetalingsbelop
FROM {orders}
"""

#: Texts of two pages with a labelled case number, decision date, day rate and company id made from an order's keys.
CASE_TEXTS = """
SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS vedtaksdato, o_custkey AS kunde, o_orderkey % 90000 AS sats,
  '[Side 1 av 2]' || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN 'Vedtak om dagpenger' WHEN 1 THEN 'Klage på vedtak' ELSE 'Søknad om sykepenger' END || chr(10)
  || 'Saksnummer: ' || lpad(CAST(o_orderkey AS STRING), 7, '0') || chr(10)
  || 'Vedtaksdato: ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.' || CAST(year(o_orderdate) AS STRING) || chr(10)
  || 'Dagsats: kr ' || CAST(o_orderkey % 90000 AS STRING) || ',50 og 12,5 prosent' || chr(10)
  || '[Side 2 av 2]' || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Kundenummer ' || CAST(o_custkey AS STRING) || ' viser til § 8-' || CAST(o_orderkey % 30 + 1 AS STRING) || ' i loven.' END AS tekst
FROM {orders}
"""

#: Identifiers made from keys, some with a right last digit.
NUMBERS = """
SELECT o_orderkey AS doc_id, lpad(CAST((o_orderkey * 7919 + 810000007) % 1000000000 AS STRING), 9, '0') AS orgnr,
  lpad(CAST((o_orderkey * 104729 + 12345678901) % 100000000000 AS STRING), 11, '0') AS konto,
  CAST(o_orderkey * 31 + o_custkey AS STRING) AS kid,
  lpad(CAST(o_orderkey % 31 + 1 + CASE WHEN o_orderkey % 13 = 0 THEN 40 ELSE 0 END AS STRING), 2, '0')
    || lpad(CAST(o_orderkey % 12 + 1 + CASE WHEN o_orderkey % 17 = 0 THEN 40 WHEN o_orderkey % 19 = 0 THEN 80 ELSE 0 END AS STRING), 2, '0')
    || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || lpad(CAST(o_custkey % 89 AS STRING), 2, '0') AS fnr
FROM {orders}
"""

#: Stated confidence and whether it was right, one row per order line.
CONFIDENCES = "SELECT CAST(l_discount * 10 + l_tax AS DOUBLE) AS konfidens, l_quantity % 3 <> 0 AS riktig FROM {lineitem}"

#: Outcomes of fields.
OUTCOMES = """
SELECT l_returnflag || l_linestatus AS felt, CASE WHEN l_orderkey % 5 = 0 THEN 'mangler' WHEN l_partkey % 7 = 0 THEN 'galt' ELSE 'riktig' END AS utfall FROM {lineitem}
"""

#: Access log rows.
ACCESS = """
SELECT ts AS t, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'k' || CAST(user_id % 50 AS STRING) END AS klient_id,
  CASE event_id % 6 WHEN 0 THEN '/dokument/operasjoner/7?x=1' WHEN 1 THEN '/dokument' WHEN 2 THEN '/api/v1/sladd/3' WHEN 3 THEN '/jobb/9f3c' WHEN 4 THEN '/sak' ELSE '/dokumentasjon' END AS sti,
  CASE WHEN event_id % 10 = 0 THEN 500 WHEN event_id % 4 = 0 THEN 404 ELSE 200 END AS kode, CAST(event_id % 700 AS DOUBLE) / 5 AS sekunder, event_id
FROM {events}
"""
