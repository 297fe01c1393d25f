"""Morphology as packed tag bits: look-up keys, agreement by case cells, numerals that a noun governs.

Bits 0-5 are the singular cases and 6-11 the plural ones in the order of ``numerals.CASES``; 12 is
feminine, 13 neuter, 14 animate, 16 noun, 17 adjective, 18 verb. Readings of one form are OR-ed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions.regexmap import let

FEMININE, NEUTER, ANIMATE, NOUN, ADJECTIVE, VERB = 1 << 12, 1 << 13, 1 << 14, 1 << 16, 1 << 17, 1 << 18


def cell_bit(number: str, case: str) -> int:
    return 1 << (N.CASES.index(case) + (6 if number == "pl" else 0))


def tag_table(readings: DataFrame) -> DataFrame:
    """``form, tags`` rows, one per reading, OR-ed into one row per form (key in lower case, ё as е)."""
    return readings.groupBy(F.translate(F.lower("form"), "ё", "е").alias("form")).agg(F.bit_or("tags").alias("tags"))


def has(tags: Column, bits: int) -> Column:
    return tags.bitwiseAND(F.lit(bits)) != 0


def agreeing_cells(adjective: Column, noun: Column) -> Column:
    """The case cells that an adjective and a noun share, as bits."""
    return adjective.bitwiseAND(noun).bitwiseAND(F.lit((1 << 12) - 1))


def sole_case(cells: Column) -> Column:
    """The one case that the cells leave (of either number), else null."""
    both = cells.bitwiseOR(F.shiftright(cells, 6)).bitwiseAND(F.lit(63))
    return F.when(F.bit_count(both) == 1, F.get(F.array(*[F.lit(c) for c in N.CASES]), F.round(F.log2(both)).cast("int")))


def governed_numeral(n: Column, tags: Column) -> Column:
    """The number in the form that the counted noun's cells allow: one takes the singular in its
    own case; two to four take a genitive singular beside a nominative numeral; more take a genitive
    plural; the other plural cases decline both. Accepted only if all cells give one form."""

    def forms(x: Column) -> Column:
        bucket = N.plural_form(x)
        out = []
        for gender, mask in (("f", FEMININE), ("n", NEUTER), ("m", 0)):
            mine = has(tags, mask) if mask else ~has(tags, FEMININE | NEUTER)
            for case in N.CASES:
                animate = has(tags, ANIMATE) & F.lit(gender == "m")
                own = F.when(animate & F.lit(case == "acc"), N.cardinal(x, "gen", gender)).otherwise(N.cardinal(x, case, gender))
                out.append(F.when(mine & (bucket == 0) & has(tags, cell_bit("sg", case)), own))
                if case in ("dat", "ins", "pre"):
                    out.append(F.when(mine & (bucket > 0) & has(tags, cell_bit("pl", case)), N.cardinal(x, case, gender)))
            out.append(F.when(mine & (bucket == 1) & has(tags, cell_bit("sg", "gen")), N.cardinal(x, "nom", gender)))
            out.append(F.when(mine & (bucket == 2) & has(tags, cell_bit("pl", "gen")), N.cardinal(x, "nom", gender)))
        return let(F.array_distinct(F.filter(F.array(*out), lambda w: w.isNotNull())), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))

    return F.when(has(tags, NOUN), let(n.cast("long"), forms))
