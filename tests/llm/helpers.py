"""Small tables with nulls, empty and very long texts, repeated rows and clashing column names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or return, in an unhelpful type.
CLASHING = ("_text", "_words", "_lines", "_d", "_t", "_row", "n_words", "kept", "node", "component", "digest",
            "n_tokens", "start", "length", "spans", "labels", "score", "ids", "host", "path", "verdict")

PASSAGE = "\n".join(f"shared line number {i} of a long passage" for i in range(12))


def edge_rows() -> list[tuple]:
    long_word, long_text = "x" * 30_000, "word " * 20_000
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4),
        (4, "one two three four five six", "en", None, 27), (4, "one two three four five six", "en", None, 27),
        (None, "one two three four five six", "xx", "b", 27), (None, None, None, None, None),
        (5, long_word, "de", "b", 30_000), (6, long_text, "fr", "b", 100_000), (7, "9" * 5000 + "@" * 50, "es", "b", 5050),
        (8, f"own start\n{PASSAGE}\nown end", "en", "c", 1), (9, f"other start\n{PASSAGE}\nother end", "en", "c", 1),
        (10, PASSAGE, "en", "c", 1), (11, PASSAGE, "en", "c", 1),
        (12, "<|endoftext|> hello  <|endoftext|>\u0000 \u2581 \ud7ff \U0001f600", "en", "c", 1),
    ]
    return rows


def edge_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit(7) for c in CLASHING})


def empty_docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(7) for c in CLASHING})
