import pytest

PROSE = ("the river of the north was wide and the people of the town did not know how to cross it when the rain came "
         "and so they built a bridge with stones from the hill and ropes that the sailors had left behind in spring")


def prose(seed: int, n: int) -> str:
    """n words, different for every seed."""
    words = PROSE.split()
    return " ".join(f"{words[(seed * 7 + i * (seed % 5 + 1)) % len(words)]}{(seed * 31 + i * i) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def make_documents(spark):
    """documents with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), 1, "x", 2, 3, "y", 4, 5, 6)
                for i, t, lang, src in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, key int, node string, size int, "
            "label int, row string, h int, _spans int, copy int")
    return make


@pytest.fixture(scope="session")
def messy(make_documents):
    """Nulls, empty and long texts, repeated rows, near copies, shared passages, periodic texts."""
    passage = prose(99, 70)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"),
            (5, "One two", "en", "b"), (6, "one TWO", "fr", None), (None, "no id " + prose(50, 50), "fr", "c"),
            (7, prose(7, 60), "en", "a"), (7, prose(7, 60), "en", "a"), (8, prose(7, 60), "en", "a"),
            (9, prose(9, 300), "de", "b"), (10, prose(9, 300).replace("the", "THE"), "de", "b"),
            (11, prose(9, 300) + " tail end", "de", "b"), (12, "ab " * 400, "en", "c"), (13, "x y z\n" * 90, "es", "c"),
            (14, prose(14, 40) + " " + passage + " " + prose(15, 40), "en", "a"),
            (15, prose(16, 10) + "\n" + passage + " " + prose(17, 80), "fr", "a"),
            (16, passage, "en", "d"), (17, prose(18, 6000), "en", "d"), (18, "ñandú Straße ΑΣ İx \x1c é " * 20, "es", "d"),
            (19, "q" * 3000, "en", "e"), (20, "!!! ### 12 34", "en", "e")]
    return make_documents(rows)
