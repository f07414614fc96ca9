"""Keyed merge of a change batch into a table, as joins.

Equality is SQL's: a NULL in a key never matches, and rows on both sides with one survive.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MergeMode(Enum):
    UPDATE_INSERT = "update-insert"
    DELETE_INSERT = "delete-insert"


@dataclass(frozen=True)
class MergeSpec:
    #: columns that must be equal for a match
    on: tuple[str, ...]
    mode: MergeMode = MergeMode.UPDATE_INSERT
    #: columns that a match takes from the source; all if empty
    update_columns: tuple[str, ...] = ()
    #: what to do with several source rows of one key: "raise" or "latest"
    duplicates: str = "raise"
    #: orders source rows of a key for "latest", last one wins
    order: tuple[str, ...] = field(default=("round", "ts"))

    def __post_init__(self) -> None:
        if not self.on:
            raise ValueError("a merge needs condition columns")
        if self.duplicates not in ("raise", "latest"):
            raise ValueError("duplicates must be raise or latest")


def condition_columns(partitioned: bool, extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """key, with partition if the table has partitions, then the extra ones; each once."""
    return tuple(dict.fromkeys(("key", *(("partition",) if partitioned else ()), *extra)))


def _complete(on: tuple[str, ...], side: DataFrame) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & side[c].isNotNull()
    return out


#: Rows whose key has a NULL are dealt over so many groups; they never match, so it doesn't matter which.
SPREAD = 1024
_PART = "__part"


def _parted(on: tuple[str, ...], side: DataFrame) -> DataFrame:
    """With a column that is 0 where the key is complete and spreads the others, so that no task gets all rows without a key."""
    return side.withColumn(_PART, F.when(_complete(on, side), 0).otherwise(F.pmod(F.xxhash64(*side.columns), F.lit(SPREAD)).cast("int")))


def unique_source(source: DataFrame, spec: MergeSpec) -> DataFrame:
    """The source with one row per complete key."""
    return _unique(source, spec).drop(_PART)


def _unique(source: DataFrame, spec: MergeSpec) -> DataFrame:
    """unique_source with its column of parts: it is dealt by key and part already, as the join of _partial wants it."""
    source = _parted(spec.on, source)
    window = Window.partitionBy(*spec.on, _PART)
    complete = _complete(spec.on, source)
    if spec.duplicates == "raise":
        n = F.count(F.lit(1)).over(window)
        message = F.concat(F.lit("several source rows match on "), F.lit(", ".join(spec.on)))
        return source.withColumn("__n", n).where(F.when(complete & (F.col("__n") > 1), F.raise_error(message).cast("boolean")).otherwise(True)).drop("__n")
    order = [F.desc_nulls_last(c) for c in spec.order if c in source.columns] + [F.asc(F.to_json(F.struct(*(c for c in source.columns if c != _PART))))]
    return source.withColumn("__n", F.row_number().over(window.orderBy(*order))).where((F.col("__n") == 1) | ~complete).drop("__n")


def merge(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """The target after the merge; columns in the target's order. The source is matched by name and must have all of them."""
    missing = set(target.columns) - set(source.columns)
    if missing:
        raise ValueError(f"the source lacks {sorted(missing)}")
    unknown = set(spec.update_columns) - set(target.columns)
    if unknown:
        raise ValueError(f"no such columns to update: {sorted(unknown)}")
    source = source.select(*target.columns)
    # a target row goes if any source row has its key, so the keys need no check; each source row is checked once, where it is inserted
    if spec.mode is MergeMode.DELETE_INSERT:
        return _without(target, source, spec.on).unionByName(_without(unique_source(source, spec), target, spec.on))
    if not spec.update_columns:
        return _without(target, source, spec.on).unionByName(unique_source(source, spec))
    return _partial(target, source, spec)


def _without(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Rows of left that no row of right matches. Only key columns of right travel."""
    keys = right.select(*(F.col(c).alias(f"__r_{c}") for c in on))
    condition = F.lit(True)
    for c in on:
        condition = condition & (left[c] == keys[f"__r_{c}"])
    return left.join(keys, condition, "left_anti")


def _partial(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """Markers tell on which sides a row stands; a NULL test of a column could not, since columns may be NULL."""
    t = _parted(spec.on, target).select(*(F.col(c).alias(f"t_{c}") for c in target.columns), F.col(_PART).alias("t_part"), F.lit(True).alias("t_is"))
    s = _unique(source, spec).select(*(F.col(c).alias(f"s_{c}") for c in target.columns), F.col(_PART).alias("s_part"), F.lit(True).alias("s_is"))
    condition = t["t_part"] == s["s_part"]
    for c in spec.on:
        condition = condition & (t[f"t_{c}"] == s[f"s_{c}"])
    inserted = F.col("t_is").isNull()
    pick = lambda c: F.when(F.col("s_is") & (inserted | F.lit(c in spec.update_columns)), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
    return t.join(s, condition, "full_outer").select(*(pick(c).alias(c) for c in target.columns))


def replay(target: DataFrame, batches: list[DataFrame], spec: MergeSpec) -> DataFrame:
    """Update-insert merges of batches in order, as one pass: per key the last batch that has it wins."""
    tagged = [unique_source(b.select(*target.columns), spec).withColumn("__v", F.lit(i)) for i, b in enumerate(batches)]
    changes = tagged[0]
    for b in tagged[1:]:
        changes = changes.unionByName(b)
    changes = _parted(spec.on, changes)
    last = F.max("__v").over(Window.partitionBy(*spec.on, _PART))
    complete = _complete(spec.on, changes)
    kept = changes.withColumn("__last", last).where((F.col("__v") == F.col("__last")) | ~complete).drop("__v", "__last", _PART)
    return _without(target, kept, spec.on).unionByName(kept)
