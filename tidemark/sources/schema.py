"""Schema of change records: four fixed columns, then payload fields in a repeating pattern."""

from __future__ import annotations

from pyspark.sql.types import DataType, FloatType, IntegerType, LongType, StringType, StructField, StructType

FIXED = [("key", StringType()), ("partition", StringType()), ("round", IntegerType()), ("ts", LongType())]
#: Name stem and type of payload field i, by i modulo 10.
PATTERN: list[tuple[str, DataType]] = [
    ("textField1", StringType()), ("textField2", StringType()), ("textField3", StringType()), ("textField4", StringType()), ("textField5", StringType()),
    ("longField1", LongType()), ("decimalField", FloatType()), ("longField2", LongType()), ("longField3", LongType()), ("intField1", IntegerType()),
]


def change_schema(columns: int) -> StructType:
    """`columns` wide, five at least. Field i of the payload has i after its stem."""
    if columns < 5:
        raise ValueError("a change record has five columns at least")
    payload = [StructField(f"{stem}{i}", kind) for i in range(columns - 4) for stem, kind in [PATTERN[i % 10]]]
    return StructType([StructField(n, t, False) for n, t in FIXED] + payload)


def ddl(schema: StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in schema)
