"""The residue alphabet as column expressions.

Residues are held in an internal alphabet A-Y in which neighbouring letters stand for similar residues,
so that sorting suffixes brings similar ones together. One character outside the alphabet, whatever its
width in bytes, becomes one unknown residue. Nulls stay null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residues in order of similarity, their internal letters, and the order of matrix rows.
SIMILARITY_ORDER = "ACMLJIVTSKRQZEDBNHYFWXP*G"
INTERNAL = "ABCDEFGHIJKLMNOPQRSTUVWXY"
MATRIX_ORDER = "ARNDCQEGHILKMFPSTWYVBJZX*"
STANDARD = "ACDEFGHIKLMNPQRSTVWY"

UNKNOWN = "X"
UNKNOWN_INTERNAL = INTERNAL[SIMILARITY_ORDER.index(UNKNOWN)]
#: Standard residues in internal letters.
STANDARD_INTERNAL = "".join(sorted(INTERNAL[SIMILARITY_ORDER.index(c)] for c in STANDARD))


def clean_residues(c: Column) -> Column:
    """Upper-case A-Y and `*`; line feeds are dropped and everything else, Z too, becomes X."""
    ascii_upper = F.translate(F.replace(c, F.lit("\n"), F.lit("")), "abcdefghijklmnopqrstuvwxy", "ABCDEFGHIJKLMNOPQRSTUVWXY")
    return F.regexp_replace(ascii_upper, "[^A-Y*]", UNKNOWN)


def to_internal(c: Column) -> Column:
    """Cleaned residues in internal letters; those without a letter (O, U) are unknown."""
    return F.translate(F.translate(c, "OU", "XX"), SIMILARITY_ORDER, INTERNAL)


def to_residues(c: Column) -> Column:
    """Internal letters as residues."""
    return F.translate(c, INTERNAL, SIMILARITY_ORDER)


def guard_internal(c: Column) -> Column:
    """Anything but internal letters, `*` and line feeds becomes unknown."""
    return F.regexp_replace(c, "[^A-Y*\\n]", UNKNOWN_INTERNAL)


def matrix_code(c: Column) -> Column:
    """The row of the substitution matrix of one internal letter; unknown for any other character."""
    order = "".join(INTERNAL[SIMILARITY_ORDER.index(x)] for x in MATRIX_ORDER)
    at = F.instr(F.lit(order), c)
    return F.when(c.isNull(), None).when((at > 0) & (F.length(c) == 1), at - 1).otherwise(MATRIX_ORDER.index(UNKNOWN))


def header_id(c: Column) -> Column:
    """The id of a FASTA header: one leading `>` dropped, up to the first space or tab (a CR stays)."""
    return F.regexp_extract(c, "^>?([^ \\t]*)", 1)


def letter_count(c: Column, letter: str) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(letter), F.lit("")))


def window_entropy(window: Column, width: int) -> Column:
    """Shannon entropy in bits of the standard residues (internal letters) of a window of `width`."""
    counts = [letter_count(window, x) for x in STANDARD_INTERNAL]
    total = sum(counts[1:], counts[0])
    spread = sum((F.when(n > 0, n * F.log2(n)).otherwise(0.0) for n in counts[1:]), F.when(counts[0] > 0, counts[0] * F.log2(counts[0])).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - spread / total).otherwise(0.0)
