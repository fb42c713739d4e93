"""Fixture rows for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, text_a string, rep long, node long, key long, tk long"


def docs_frame(spark, rows):
    """Rows (doc_id, text[, lang]) with further columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None, 1, "a", "b", 2, 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, DOCS)
