"""Tables with every awkward row: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

import pytest

CLASHING = "k1 k2 n token tokens digest keep_id node label start length piece block score x y held_out spans words bucket copies component_id _gone_id _key_1 _key_2 _copy_id _copy_digest _copy_kept kept".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice("abcdefgho") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    rnd = random.Random(5)
    base = words(rnd, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [w if i % 3 else "other" for i, w in enumerate(base)]
    long = " ".join(words(rnd, 30_000))
    texts = [
        None, "", "   \n\t ", "a", "two words", "Two Words", " ".join(base), " ".join(base), " ".join(near), " ".join(far), long, long + " end", "!!! ... ???",
        "x" * 50_000, "é ü ñ 日本語 \U0001f600 ́", "tab\tand\r\nline\n\nend  ", "<|endoftext|> <|startoftext|> 's 't", "1 22 333", "\0 zero \x0b\x0c", " ".join(base[:40]),
    ]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t), *["z"] * len(CLASHING)) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, " ".join(near), None, None, None, *[None] * len(CLASHING)))
    rows.append((3, "another text under an id that is taken", "de", "s", 1, *[None] * len(CLASHING)))
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()
