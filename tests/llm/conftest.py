import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Ties, repeated rows, nulls, blank and long texts, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 700} and{i % 13}" for i in range(9_000))
    shared = "this passage of plain words is found in several documents of the table and is longer than a hundred bytes by far. "
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 5),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b", 6),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b", 6),
        (3, "", None, None, None), (4, None, "en", "a", 1), (None, None, None, None, None),
        (None, "text without an id", "en", "a", 1), (5, " \t\n\x0b ", "fr", "b", 2),
        (6, long, "en", "c", 3), (7, long + " ending", "en", "c", 4), (8, long, None, "c", 3),
        (9, shared + "Alpha ending of the ninth one.", "en", "d", 1), (10, "Beta start of ten. " + shared, "en", "d", 1),
        (11, shared + shared, "en", "d", 1), (12, "één überraschung ß naïve coöperation", "de", "e", 1),
        (12, "another text under a repeated id", "de", "e", 1), (13, "12345 !!! ###", "en", "e", 1), (14, "a", "en", "e", 1),
        (15, "a b", "en", "e", 1), (16, "A  B", "en", "e", 1), (17, "nul \x00 byte \x00\x00", "en", "e", 1),
    ]
    rows = [(*row, f"x{k}", k, "tie") for k, row in enumerate(rows)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, part int, owner string")


@pytest.fixture
def nothing(documents):
    return documents.where("false")
