"""Tables with nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, mark bigint, row string, "
    "name bigint, words string, text_2 string, toxic string, n bigint"
)


def rows(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    return [(i, t, None if i and i % 5 == 0 else "en", None, None if t is None else len(t), "k", 1, "r", 2, "w", None, "x", 3) for i, t in texts]


def odd_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(f"word{k % 977} other{k % 31}" for k in range(20_000))
    plain = "One two three four five six seven eight nine ten eleven twelve thirteen."
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, plain), (5, plain), (5, plain), (6, plain + " Fourteen."), (7, long),
        (None, "A text without a name, é 世界 😀 and <|endoftext|> inside."), (8, "x" * 3000), (9, "\n".join(["same line here"] * 50)),
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(odd_texts()), SCHEMA).repartition(3)


def docs_of(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
