import pytest


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 97} and{i % 13}" for i in range(40_000))
    rows = [
        (1, None, None, "a"),
        (2, "", "en", None),
        (3, "the cat sat on the mat.  It's  fine", "en", "b"),
        (3, "the cat sat on the mat.  It's  fine", "en", "b"),
        (4, long, "en", "c"),
        (None, "le chat est là, l'été", "fr", "d"),
        (None, None, None, None),
        (6, "  ÉTÉ İstanbul   x <|endoftext|> 日本語 😀\n\n \tend ", "fr", "e"),
        (7, "   ", "en", "e"),
        (8, "12 34 !!", None, "f"),
    ]
    ddl = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(rows, ddl)
    for name in ("key", "fp", "part", "component", "score", "slot", "ids", "home", "root", "stats"):
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame
