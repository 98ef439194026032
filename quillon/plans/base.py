"""What query modules share: reading the driver's tables, and SQL fragments that say the same as the functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.text import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def squeeze_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    return squeeze_sql(f"lower(translate({c}, 'Iİ', 'ıi'))")


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({fold_sql(c)}, '[0-9a-zçğıöşü]+')"


def search_tokens_sql(c: str) -> str:
    return f"list_filter({tokens_sql(c)}, lambda t: length(t) > 1 AND t NOT IN ({quoted(STOP_WORDS)}))"


class Registry:
    """Queries by name with their SQL; a query without SQL has a plain version in the tests."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
