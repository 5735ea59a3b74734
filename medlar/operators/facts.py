"""Facts: as-of joins, key resolution, and what happens to an entity in the next or previous period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlar.operators.dims import covers


class UnresolvedKeyError(ValueError):
    """A fact has keys that no dimension knows."""


def as_of_join(facts: DataFrame, history: DataFrame, entity: str, ordinal: str) -> DataFrame:
    """Facts with the columns of the spell that covers their ordinal; facts outside all spells go. The join hashes on the
    entity and tests the range on what meets."""
    names = [c for c in history.columns if c not in {entity, "valid_from", "valid_to", "is_current"}]
    spell = history.select(F.col(entity).alias("__entity"), "valid_from", "valid_to", *names)
    inside = (F.col(entity) == F.col("__entity")) & covers(F.col(ordinal), F.col("valid_from"), F.col("valid_to"))
    return facts.join(spell, inside).drop("__entity", "valid_from", "valid_to")


def outside_history(facts: DataFrame, history: DataFrame, entity: str, ordinal: str) -> DataFrame:
    """The facts that ``as_of_join`` lets go."""
    spell = history.select(F.col(entity).alias("__entity"), "valid_from", "valid_to")
    inside = (F.col(entity) == F.col("__entity")) & covers(F.col(ordinal), F.col("valid_from"), F.col("valid_to"))
    return facts.join(spell, inside, "left_anti")


def resolve(facts: DataFrame, dimension: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Adds the surrogate key of the natural one, null if the dimension doesn't have it."""
    return facts.join(dimension.select(*natural, key), list(natural), "left")


def unresolved(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, missing) of each key column, from one pass."""
    sums = [F.struct(F.lit(k).alias("key"), F.count(F.when(F.col(k).isNull(), 1)).alias("missing")) for k in keys]
    return facts.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def require_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = unresolved(facts, keys).where("missing > 0").collect()
    if bad:
        raise UnresolvedKeyError(", ".join(f"{r['key']}: {r['missing']}" for r in bad))
    return facts


def _sequence(entity: str | Sequence[str], ordinal: str):
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(ordinal)


def next_in_sequence(entity: str | Sequence[str], ordinal: str, value: Column) -> Column:
    """The value of the entity's row at the next ordinal, null if there is none. One row per entity and ordinal is assumed."""
    order = _sequence(entity, ordinal)
    return F.when(F.lead(ordinal).over(order) == F.col(ordinal) + 1, F.lead(value).over(order))


def previous_in_sequence(entity: str | Sequence[str], ordinal: str, value: Column) -> Column:
    order = _sequence(entity, ordinal)
    return F.when(F.lag(ordinal).over(order) == F.col(ordinal) - 1, F.lag(value).over(order))


def retention(enrollment: DataFrame, entity: str | Sequence[str], ordinal: str, status: str, last_ordinal: int | Column) -> DataFrame:
    """Adds is_retained, 1 if the entity is enrolled or has graduated in the next period; rows that have graduated and rows
    of the last period are left out."""
    following = next_in_sequence(entity, ordinal, F.col(status))
    kept = enrollment.withColumn("is_retained", F.when(following.isin("ENROLLED", "GRADUATED"), 1).otherwise(0))
    last = F.lit(last_ordinal) if isinstance(last_ordinal, int) else last_ordinal
    return kept.where((F.col(status) != "GRADUATED") & (F.col(ordinal) < last))


def illegal_transitions(rows: DataFrame, entity: str | Sequence[str], ordinal: str, level: str) -> DataFrame:
    """Adds is_illegal: the level fell or rose by more than one since the period before; gaps aren't judged."""
    before = previous_in_sequence(entity, ordinal, F.col(level))
    return rows.withColumn("is_illegal", F.coalesce((F.col(level) < before) | (F.col(level) > before + 1), F.lit(False)))
