"""Exports, table copies and append-only sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail import schemas


def export_rows(state: DataFrame, monthly_only: bool = False) -> DataFrame:
    """Active listings by province and price, without tracking columns.

    The slug comes last in the order so that a province of equal prices can
    still be cut into ranges.
    """
    rows = state.filter(F.col("status") == "active")
    if monthly_only:
        rows = rows.filter(F.col("has_monthly_contract") == "true")
    return rows.drop(*schemas.EXPORT_DROPPED_COLUMNS).orderBy(
        F.col("province").asc_nulls_first(), F.col("price_monthly_min").asc_nulls_first(), F.col("slug"))


def flat_columns(df: DataFrame) -> DataFrame:
    """Text-file form: string lists joined, structures as JSON, instants in ISO."""
    def flat(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StringType):
                return F.coalesce(F.array_join(c, "; "), F.lit(""))
            return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("[]"))
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
        return c

    return df.select(*[flat(f).alias(f.name) for f in df.schema.fields])


def write_csv(state: DataFrame, path: str, monthly_only: bool = False) -> None:
    """Range-partitioned by the export order: part files read in order are sorted."""
    flat_columns(export_rows(state, monthly_only)).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(state: DataFrame, path: str, monthly_only: bool = False) -> None:
    export_rows(state, monthly_only).write.mode("overwrite").json(path, ignoreNullFields=False)


def copy_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Full replacement of each table, in the given order (parents first)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def copy_tables_jdbc(tables: Mapping[str, DataFrame], url: str, **options: str) -> None:
    for name, df in tables.items():
        df.write.format("jdbc").options(
            url=url, dbtable=name, truncate="true", batchsize="1000", **options).mode("overwrite").save()


def with_change_date(history: DataFrame) -> DataFrame:
    return history.withColumn("change_date", F.to_date("changed_at"))


def append_history(history: DataFrame, path: str) -> None:
    """Appends events under their change date; a scan writes few dates."""
    dated = with_change_date(history)
    dated.write.mode("append").partitionBy("change_date").parquet(path)


def preference_rows(answers: DataFrame) -> DataFrame:
    """Questionnaire answers; the user falls back to the session's."""
    return answers.withColumn("user_id", F.coalesce("user_id", "session_user_id")).drop("session_user_id")


def append_preferences(answers: DataFrame, path: str) -> None:
    preference_rows(answers).write.mode("append").parquet(path)
