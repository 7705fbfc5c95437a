from __future__ import annotations

import random
import re

import pytest

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    """A-Z only."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls in each column, empty and long texts, ties and repeated rows, and columns whose names clash."""
    r = random.Random(5)
    words = [f"w{r.randrange(400)}" for _ in range(6000)]
    long = " ".join(words) + "\n" + "x" * 3000
    rows = [
        (1, "", "en", "s1", 0), (2, None, "en", "s1", None), (3, long, "en", None, 9), (4, long, None, "s2", 9), (4, long, None, "s2", 9), (5, " \n\t \n", "fr", "s2", 3), (6, "One line é 😀 日本", "fr", "s3", 1),
        (7, "password = hunter2hunter\nAKIA" + "A1" * 9 + " under the MIT License", "en", "s1", 5), (8, " ".join(words[:300]) + " tail", "de", "s1", 5), (9, " ".join(words[:300]) + " other end", "de", "s3", 5), (10, "a b", "en", "s1", 3), (11, "A B", "en", "s1", 3),
        (None, "no id here at all but words enough to count", "en", "s1", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: "1" for c in ("id", "h", "own", "pos", "len", "words", "line", "site", "path", "n", "keys", "sketch", "value", "ids", "part", "sequence", "offset", "n_words", "spans", "start", "shard", "kept", "quality", "w", "l", "t", "host", "gone", "items", "__id", "__hash", "__host", "__gone", "__kept", "a", "b", "text_hash", "component", "class", "z", "d", "x", "hash")}
    return df.selectExpr("*", *(f"{v} AS `{k}`" for k, v in clash.items()))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
