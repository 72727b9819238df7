import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    same = "the quick brown fox jumps over the lazy dog and then runs away from all of the other animals in the big dark wood at night"
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 2), (2, same, "en", "a", 2), (3, same + " again", "en", None, 3), (4, None, None, None, None),
        (5, "", "en", "b", 0), (None, "no id at all here", "en", "b", 1), (None, None, None, None, None), (6, LONG, "en", "c", 9), (7, "   \n\t ", "de", "c", 1),
        (8, "12345 !!! ???", None, "d", 1), (9, "Grüße aus dem schönen Wald wo die Füchse wohnen", "de", "d", 5), (10, "x", "en", "d", 1),
    ]
    clash = "score double, id int, n_words string, spans array<int>, key string, positive string, t1 string, places int, slot string, number int, class_id int, media int"
    df = spark.createDataFrame([(*r, 0.5, 7, "z", [1], "k", "p", "t", 3, "s", 1, 2, 5) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
