"""Odd rows that every operator must take: nulls, empty and long texts, repeats."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

_rng = random.Random(4)
_PARTS = ["the", "ing", "ion", "re", "an", "st", "er", "ed", "é", "ß", "ou"]


def sentence(n: int, rng: random.Random = _rng) -> str:
    return " ".join("".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Rows of ``documents``: plain ones, copies, near copies, passages, odd ones."""
    rng = random.Random(11)
    plain = [sentence(rng.randint(20, 120), rng) for _ in range(30)]
    passage = sentence(60, rng)
    texts = list(plain)
    texts += [plain[0], plain[0].upper(), plain[1] + " more", "x " + plain[2], plain[3].replace(" ", "\n")]
    texts += [f"{sentence(15, rng)} {passage} {sentence(15, rng)}" for _ in range(4)]
    texts += [None, "", " ", "\n\t", "one", "one two", "one two", "Одно слово", "中文 字", "12 34 !!", "é" * 60]
    texts += ["z" * 5000, "ab " * 3000, "\x1c\x85 ", "same line\nsame line\n\nsame line"]
    texts += [(passage + "\n") * 3, "a\x00b", "the " * 9 + "end"]
    rows = [
        (i, t, ("en", "fr", None)[i % 3] if t else None, f"src{i % 2}" if i % 7 else None, len(t or ""))
        for i, t in enumerate(texts)
    ]
    rows += [rows[0], rows[0], (1, "another text with the id of an earlier one", "en", "src0", 0)]
    rows += [(None, plain[4], "en", None, 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark) -> DataFrame:
    """The rows above, with columns whose names the operators use inside."""
    rows = spark.createDataFrame(documents(), DOCS).repartition(3, "n_chars")
    extra = {c: _extra(c) for c in ("tag", "_key", "component", "rep", "weight", "kept", "a", "ids")}
    return rows.withColumns(extra)


def _extra(name: str):
    from pyspark.sql import functions as F

    return F.lit(name)


@pytest.fixture(scope="session")
def no_docs(spark) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))
