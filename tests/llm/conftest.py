import pytest

#: id, text, source, lang: NULLs, repeated rows, empty and long texts, copies, and words that no one splits.
ROWS = [
    (1, "one two three four five six seven eight", "s1", "en"),
    (2, "One TWO three four five six seven eight", "s2", "en"),
    (3, None, None, None),
    (4, "", "s1", "de"),
    (5, " \t\r\n \n\n", "s2", None),
    (None, "one two three four five six seven eight", "s3", "en"),
    (7, "one two", "s1", "fr"),
    (7, "one two", "s1", "fr"),
    (8, "word\n" * 3000 + "end", "s4", "en"),
    (9, "x" * 200_000, "s5", "en"),
    (10, "été naïve 日本語 😀 ÄÖ\x1c\x85 it's we'll 123 4567", "s6", "es"),
    (11, " ".join(f"w{i}" for i in range(5000)), "s1", "en"),
    (12, "the same line here\n  the same line here \r\nmine", "s1", "en"),
    (13, "the same line here\nother", "s2", "en"),
    (14, "zzz\nthe same line here", "s3", "en"),
    (15, "<|endoftext|> a special string <|endoftext|>", "s4", "en"),
]
#: Columns whose names the operators use themselves.
CLASHES = "'x' as score, 1 as kept, 2 as n_tokens, 'f' as fingerprint, true as held_out, 'k' as __key, 3 as n_words, 'r' as rank, 0 as component_id, 'p' as position"


@pytest.fixture(scope="session")
def odd(spark):
    """The documents, with clashing columns in between."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return frame.selectExpr("doc_id", *CLASHES.split(", "), "text", "lang", "source", "cast(length(text) as bigint) as n_chars").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def rows():
    return ROWS
