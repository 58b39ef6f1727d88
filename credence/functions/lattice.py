"""The trust lattice as column expressions: eight states by rank, two folds, severity modulation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states, from most to least trusted; a state's rank is its place.
STATES = ("INTEGRAL", "ASSURED", "GUARDED", "UNKNOWN_ASSURED", "UNKNOWN_GUARDED", "EXTERNAL_RAW", "UNKNOWN_RAW", "MIXED_RAW")
RANK = {name: rank for rank, name in enumerate(STATES)}
#: Ranks from which data is raw (untrusted), and the severities from least to most severe.
RAW_FROM = 5
SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL")


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), rank.cast("int") + 1)


def state_rank(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, STATES)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def least_trusted(rank: Column) -> Column:
    """Aggregate: the weakest link."""
    return F.max(rank)


def rank_mask(rank: Column) -> Column:
    """Aggregate: the set of ranks in a group as bits; any order of partial aggregation gives the same."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), rank.cast("int")))


def clash(mask: Column) -> Column:
    """The provenance join of the ranks in ``mask``: alike stays, unknown kinds meet in the weaker, all
    else is mixed."""
    single = F.bit_count(mask) == 1
    unknown = mask.bitwiseAND(~(8 | 16 | 64) & 0xFF) == 0
    alone = F.log2(mask.cast("double")).cast("int")
    weaker = F.when(mask.bitwiseAND(F.lit(64)) != 0, 6).when(mask.bitwiseAND(F.lit(16)) != 0, 4).otherwise(3)
    return F.when(single, alone).when(unknown, weaker).otherwise(7)


def provenance_clash(rank: Column) -> Column:
    """Aggregate form of ``clash``."""
    return clash(rank_mask(rank))


def modulate(base: Column, rank: Column) -> Column:
    """Severity of a rule in a tier: as it is for trusted code, one step down for partly trusted code,
    NONE elsewhere."""
    down = F.when(base == "CRITICAL", "ERROR").when(base == "ERROR", "WARN").when(base.isin("WARN", "INFO"), "INFO").otherwise("NONE")
    return F.when(rank <= 1, base).when(rank <= 4, down).otherwise("NONE")


def severity_rank(severity: Column) -> Column:
    """INFO 0 to CRITICAL 3; null for NONE and for what is no severity."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(at > 0, (at - 1).cast("int"))
