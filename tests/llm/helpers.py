"""Small tables for the operators' tests."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, langs=None):
    """A documents table; ids default to 0, 1, ..."""
    rows = [(i, t, None if langs is None else langs[k], None, None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(df):
    """df with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = [c for c in ("id", "fp", "range", "sent", "root", "least", "row", "sha", "top", "found", "node", "parent", "score", "key", "table", "a", "b", "place", "length", "payload", "revisit") if c not in df.columns]
    return df.withColumns({c: F.lit("clash") for c in names})
