"""Documents with everything that may go wrong, for the training-data operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog and runs through fields of gold until night falls on all of us".split()


def prose(k: int, n: int = 60) -> str:
    return " ".join(WORDS[(i * 7 + k * (1 + i // 9)) % len(WORDS)] + ("x" * ((i + k) % 3)) + str(k % 5 if i % 11 == 0 else "").replace("0", "") for i in range(n))


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters (a power of two) that a polynomial modulo a power of two cannot tell apart, whatever its base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, copies, near copies, ties, repeated rows, a very long text, odd characters."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n\t ", 3), "en", None), (4, base.replace("quick", "slow", 1), "en", "b"),
        (5, None, None, None), (6, "", "en", "a"), (7, " \n\t ", "en", "a"), (8, "12 34 !!", None, "a"), (9, "Hi.", "en", "a"), (10, "word", "en", "a"), (11, "WORD", "en", "a"),
        (12, prose(3, 40000), "en", "a"), (13, "\x00 \x1f é ñ 漢字 \U0001f600 <|endoftext|>   x", "fr", "a"), (14, "mail me at a.b@c-d.example.com or +1 (555) 123-4567 from 10.0.0.255 pay 4111 1111 1111 1111 now", "en", "a"),
        (15, "x" * 9000, "en", "a"), (16, prose(2), "en", "a"), (16, prose(2), "en", "a"), (17, prose(4), None, "a"), (None, prose(5), "en", "a"), (None, None, None, None), (18, prose(2) + " more", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("kept", "keep_id", "group_size", "text_sha256", "component_id", "content", "score", "lang_pred", "spans", "more", "id", "bucket", "hashes")
    return odd_docs.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def write(tmp_path_factory):
    """Write a DataFrame as a table of a new folder of tables and give the folder."""

    def put(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return put
