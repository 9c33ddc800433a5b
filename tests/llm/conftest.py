"""Small documents with every awkward case, beside the smallest given tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    None, "", " ", "\n\n\n", "a", "The same line\nThe same line\nThe same line\nThe same line\nThe same line",
    "tab\tand\x0bvertical\x0cfeed\r\nend ", "Ünïcödé ﬁ é 漢字 emoji 😀 ▁ marker ▁▁ x", "<|endoftext|> </s> <s> [MASK]", "  two  spaces   three ",
    "mail a.b+c@x-y.example.com@z.de and q@r. and 1.2.3.4.5.6.7.8 or 300.1.1.1 999",
    "card 4539578763621486 or 4539 5787 6362 1486-12 and +1 (555) 010-9999 5 +49 30", "+1 (017) 555-7713 4845168114407329 97.51.17.173", "x" * 900,
    "word " * 300, "ab" * 5000, "\x00nul\x1f \x85   sep nbsp",
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(AWKWARD)]
    rows += [(5, AWKWARD[5], "en", "s", 5), (None, "no id here", None, None, None), (100, AWKWARD[13], "en", "s", 900)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
