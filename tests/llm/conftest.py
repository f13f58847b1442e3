import pytest

SF = "/root/testdata/sf0.001"

#: Null and empty texts, ties, repeated rows, white space of all kinds, a very long text, very long runs of digits, letters beyond ASCII.
ODD = [
    (None, "a text without an id, of a few words", "en", "s0"),
    (1, None, "en", "s0"),
    (2, "", None, None),
    (3, "  \n\t ", "fr", "s1"),
    (4, "One two three four five six seven eight nine ten eleven twelve", "en", "s0"),
    (5, "One two three four five six seven eight nine ten eleven twelve", "en", "s0"),
    (5, "One two three four five six seven eight nine ten eleven twelve", "en", "s0"),
    (6, "x  y z  w\r\n\n\nÉté déjà, naïve. ÉTÉ", "fr", "s1"),
    (7, "a b c " * 30 + "\n" + "line\nline\nother\nline", "en", "s1"),
    (8, "### $$$ %%% word *** &&& || <b>", "en", "s0"),
    (9, "mail bob@x.example.com, +1 (555) 555-0100 then 10.0.0.1 then 4111 1111 1111 1111 end", "en", "s0"),
    (10, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "s0"),
    (12, "0" * 5000 + ".1.1.1 and 1.1.1." + "9" * 5000 + " " + " ".join(f"v{i}" for i in range(60)), "en", "s0"),
    (11, "日本語 テキスト 😀 tab\tand\x0bfeed", None, "s2"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those that operators add."""
    rows = [(a, b, c, d, None if b is None else len(b), 7, "x", True, 0.5) for a, b, c, d in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, kept boolean, score double")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
