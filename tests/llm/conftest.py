import pytest

#: Columns that operators use themselves, all of them strings here.
CLASHES = ["id", "t", "h", "k", "b", "n", "src", "row", "digest", "body", "shard", "position", "toxicity", "is_toxic", "n_lines", "n_dropped", "n_tokens", "ids", "keeper", "root", "node", "c0", "c1", "copy", "size", "path", "w"]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "a fairly long line of plain words number {}\n"


def nasty_rows():
    long = "".join(LONG.format(i) for i in range(4000))
    texts = [
        (1, "one plain text of some words that stands here alone"), (1, "one plain text of some words that stands here alone"), (2, "one plain text of some words that stands here alone"), (3, None), (4, ""), (5, "   \n \t "), (None, "a text without an id but with words"),
        (None, None), (6, long), (7, long + "and an end"), (8, "🙂" * 50 + " ümläut ñ \u0000 zero"), (9, "x" * 100_000), (10, "!!! ??? ..."), (11, "y"), (-5, "a negative id has this text"), (9223372036854775807, "a very large id has this text"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else ("web" if k % 2 else "books"), None if k % 4 == 0 else len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def nasty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows(), COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (6, 1, 0), (None, 1, 1), (77, None, None), (3, 0, 1), (2, 1, 1), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
