"""Tenant views. They are a convention: who can read the base path can read all rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLE = "cairn_user_id"


def declare(spark: SparkSession) -> None:
    """The session's tenant; null until set, and then every view is empty."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} BIGINT DEFAULT NULL")


def tenant_rows(df: DataFrame, owner: str, user_id: int | None = None) -> DataFrame:
    """Rows of ``user_id``, or of the session's tenant where it is not given."""
    return df.where(F.col(owner) == (F.expr(VARIABLE) if user_id is None else F.lit(user_id)))


def tenant_children(children: DataFrame, parents: DataFrame, key: str, parent_key: str, owner: str, user_id: int | None = None) -> DataFrame:
    own = tenant_rows(parents, owner, user_id).select(F.col(parent_key).alias(key))
    return children.join(own, key, "left_semi")


@contextmanager
def tenant(spark: SparkSession, user_id: int) -> Iterator[None]:
    """Run queries as one tenant; the former one comes back whatever happens."""
    was = spark.sql(f"SELECT {VARIABLE}").first()[0]
    spark.sql(f"SET VARIABLE {VARIABLE} = {int(user_id)}")
    try:
        yield
    finally:
        spark.sql(f"SET VARIABLE {VARIABLE} = {'NULL' if was is None else was}")
