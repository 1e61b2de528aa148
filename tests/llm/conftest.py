import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("h", "row", "kept", "size", "label", "k1", "words", "pos", "win", "len", "bucket", "key", "stats", "raw", "node", "spans", "score", "target", "copy2", "n_hit")


def prose(seed: int, n: int, stock: str = "the river runs past old stone houses where people of many trades once lived and worked") -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(stock.split()) + (str(draw.randrange(999)) if draw.random() < 0.5 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    long_text = prose(1, 60_000)
    same = "one text that a dozen rows share word for word in full"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 6), (4, "?!... --- ***", "en", None, 13),
        (5, long_text, "en", "a", len(long_text)), (6, "a", "en", "b", 1), (7, "Zwölf Äpfel und Öl für Übung", "de", "b", 28),
        (None, same, "en", "a", 1), (None, None, "en", "a", 1), (None, "a text without an id", None, "a", 1),
        (8, "日本語のテキスト 𝒳𝒴 ١٢٣", None, "c", 1), (9, "x" * 300_000, "en", "c", 1), (10, "\x00\x1f nul and control", "en", "c", 1),
    ]
    rows += [(20 + k, same, "en", "a", 1) for k in range(12)]
    rows += [(40, "a repeated row is here twice", "en", "b", 1)] * 2
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    frame = spark.createDataFrame(edge_rows(), SCHEMA)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark):
    folder = "/root/testdata/sf0.001"
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark", "labels")}
