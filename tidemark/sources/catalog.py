"""Names, DDL and options of tables in a catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql.types import StructType

from .schema import ddl


def quoted(name: str) -> str:
    """Each part of a dotted name as an identifier."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def option_list(options: Mapping[str, object]) -> str:
    return ", ".join(f"{text(k)} = {text(v)}" for k, v in options.items())


def table_name(fmt: str, catalog: str, database: str, experiment: str) -> str:
    """<catalog>.<database>.<format>_<experiment>; hudi's dashes become underscores; delta tables are folders of their own name."""
    if fmt == "delta":
        return f"delta-{experiment}"
    if fmt == "hudi":
        return f"{catalog}.{database}.hudi_{experiment.replace('-', '_')}"
    if fmt == "iceberg":
        return f"{catalog}.{database}.iceberg_{experiment}"
    return f"{fmt}-{experiment}" if fmt != "parquet" else "parquet"


def table_path(output: str, name: str) -> str:
    """The table's folder, the same for loading and compaction: dots of the name become slashes."""
    return f"{output.rstrip('/')}/{name.replace('.', '/')}"


def create_table(name: str, schema: StructType, fmt: str, location: str, *, partition_by: str | None, properties: Mapping[str, object]) -> str:
    parts = f" PARTITIONED BY ({quoted(partition_by)})" if partition_by else ""
    props = f" TBLPROPERTIES ({option_list(properties)})" if properties else ""
    return f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({ddl(schema)}) USING {fmt}{parts} LOCATION {text(location)}{props}"


def drop_table(name: str, purge: bool = False) -> str:
    return f"DROP TABLE IF EXISTS {quoted(name)}{' PURGE' if purge else ''}"


def set_properties(name: str, properties: Mapping[str, object]) -> str:
    return f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({option_list(properties)})"


def insert_from(name: str, view: str) -> str:
    return f"INSERT INTO {quoted(name)} SELECT * FROM {quoted(view)}"


def merge_from(name: str, view: str, on: tuple[str, ...], delete_insert: bool, update_columns: tuple[str, ...]) -> str:
    condition = " AND ".join(f"t.{quoted(c)} = s.{quoted(c)}" for c in on)
    if delete_insert:
        matched = "DELETE"
    elif update_columns:
        matched = "UPDATE SET " + ", ".join(f"t.{quoted(c)} = s.{quoted(c)}" for c in update_columns)
    else:
        matched = "UPDATE SET *"
    return f"MERGE INTO {quoted(name)} t USING {quoted(view)} s ON {condition} WHEN MATCHED THEN {matched} WHEN NOT MATCHED THEN INSERT *"
