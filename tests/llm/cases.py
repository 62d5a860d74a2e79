"""Awkward documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, rank int, size long, blob string, TOTAL long"


def documents(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 97} and{i}" for i in range(6000))
    texts = [(1, "The quick brown fox, jumps over ÉÈ the lazy dog."), (2, None), (3, ""), (4, "  \n\t "), (5, long), (6, long + " tail"),
             (7, "a"), (7, "a"), (8, "a b"), (9, "a b c"), (9, "other text of nine"), (None, "no id here"), (10, "ὠ0 😀 emoji 😀 text"), *extra]
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 8) else f"s{(i or 0) % 3}", len(t or ""), "w", 1, 2, "b", 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def benchmark(spark, extra=()):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "lazy DOG"), (3, None), (4, "..."), (None, "quick brown"), *extra]
    return spark.createDataFrame(items, "item_id long, text string")
