"""Node flags: bits, letters and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE, MUTATION_OVERLAP, REVERSION_PUSH, RECOMBINANT = 1, 1 << 21, 1 << 22, 1 << 23
EXACT_MATCH, REVERSION_MARKER, REFERENCE, INCLUDED = 1 << 24, 1 << 25, 1 << 26, 1 << 27

#: The letter and name of each flag, in the order of summaries.
FLAGS = [
    (SAMPLE, "S", "Sample"),
    (MUTATION_OVERLAP, "O", "MutationOverlap"),
    (REVERSION_PUSH, "P", "ReversionPush"),
    (RECOMBINANT, "R", "Recombinant"),
    (EXACT_MATCH, "E", "ExactMatch"),
    (REVERSION_MARKER, "I", "ImmediateReversionMarker"),
    (REFERENCE, "F", "Reference"),
    (INCLUDED, "U", "UnconditionallyIncluded"),
]


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) > 0


def summary(flags: Column) -> Column:
    """One letter for each flag that is set, else _."""
    return F.concat(*[F.when(has(flags, bit), letter).otherwise("_") for bit, letter, _ in FLAGS])


def names(flags: Column) -> Column:
    """Names of the flags that are set, as an array."""
    return F.array_compact(F.array(*[F.when(has(flags, bit), name) for bit, _, name in FLAGS]))
