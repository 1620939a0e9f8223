"""Functions and table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kinspark.functions.similarity import weighted_ratio_udf
from kinspark.operators.extract_metals import find_metals


@udtf(returnType="query string, start int, stop int, hint string, category string")
class ExtractMetals:
    """Mentions of metals in a text: ``SELECT * FROM docs, LATERAL extract_metals(text)``."""

    def eval(self, text: str) -> Iterator[tuple]:
        for start, stop, query, hint, category in find_metals(text):
            yield query, start, stop, hint, category


def register_all(spark: SparkSession) -> None:
    """Makes ``weighted_ratio(a, b)`` and ``extract_metals(text)`` callable from SQL."""
    spark.udf.register("weighted_ratio", weighted_ratio_udf)
    spark.udtf.register("extract_metals", ExtractMetals)
