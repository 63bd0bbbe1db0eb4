import pytest

from clonelens.llm import ship_worker_code

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies string, fp int, `__row` string, key int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_worker_code()


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text[, source, lang]) rows as a documents table with clashing extra columns."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), "s", "c", 1, "r", 2))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_documents():
    """Missing and empty values, repeated rows, ties, copies, a long text, non-ASCII letters."""
    shared = "This Line Is Shared by several"
    return [
        (1, f"first line of one\n{shared}\nÉtat été ÉTÉ", "b", "en"),
        (2, None, "a", "en"),
        (3, "", None, None),
        (4, f"  {shared.upper()}\t\nshort\nshort\n", "a", "en"),
        (4, f"  {shared.upper()}\t\nshort\nshort\n", "a", "en"),
        (None, f"{shared}\nwithout an id\n\n", "b", None),
        (None, None, None, None),
        (5, "same words here and there\n" * 3, "c", "en"),
        (6, "same words here and there\n" * 3, "c", "fr"),
        (7, "*** 123 ---", "c", "en"),
        (8, "\n".join(f"word{i} and word{i % 97} go on" for i in range(20_000)), "b", "en"),
        (9, " \t\x0b\x0c\r ", "", "en"),
        (10, "état été ÉTÉ\nfirst line of one", "b", "fr"),
        (-3, "a negative id keeps\nshort", "a", "en"),
    ]
