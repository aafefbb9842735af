"""Documents with the cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, measures string, score string, ids string, row string"


def docs_table(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "w", "v") for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "one two three", "b"), (5, "Same text here, twice.", "b"), (5, "Same text here, twice.", "b"), (6, LONG, None), (7, "élan Ünder <|endoftext|> 'S it's ſ İ x́\x1c\x85 3.14", "c")]
