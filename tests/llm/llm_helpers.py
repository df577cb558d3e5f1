SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cluster string, key string, t string, label string, words string, mix_part long, mix_times long, mix_i int, mix_id string, key_id string, key_hash long, key_row string, q_row string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with ones the operators use inside."""
    return spark.createDataFrame([(i, x, lang, src, len(x or ""), "c", "k", "t", "l", "w", 1, 2, 3, "m", "k", 4, "r", "q") for i, x, lang, src in rows], SCHEMA)
