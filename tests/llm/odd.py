"""Odd rows that every operator must take, and tables with extra columns of clashing names."""

LONG = "lorem ipsum dolor " * 20_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, __id string, __text string, th string, score double"


def rows():
    base = [
        (1, "One fine day the quick brown fox went over to see the lazy dog, as it does.", "en", "s", 10),
        (1, "One fine day the quick brown fox went over to see the lazy dog, as it does.", "en", "s", 10),
        (2, "", "fr", None, 0),
        (3, None, None, "s", None),
        (None, "Ein kleiner Text ohne Nummer, der trotzdem gelesen werden will.", "de", "s", 5),
        (4, " \n\t ", "es", "s", 4),
        (5, LONG, "en", "s", len(LONG)),
        (6, "!!! ??? ...", "en", "s", 11),
        (7, "один два три 四五六 😀", "en", "s", 3),
    ]
    return [r + ("x", "y", "z", "t", 0.5) for r in base]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
