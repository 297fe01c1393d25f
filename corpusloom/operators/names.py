"""Personal names in running text: gender and case from endings, carried along a chain of names; ordinals
after them; surnames that are homographs.

``endings`` (ending, kind, genders, cells) says what an ending tells: genders as bits (1 masculine, 2 feminine),
cells as case bits (1 nominative, 2 genitive, and so on in the order of ``numerals.CASES``). A name has the row of its
longest listed ending; names are turned round and their beginnings joined by equality, as in a trie of
reversed endings, so the work follows a name's letters. Neighbours in a chain (``Иван Петрович Орлов``) narrow
one another down: genders and cells that all of them allow stay; where one has nothing in common with those
before it, they keep what they had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions.regexmap import let
from .lexicon import with_dimension

_NAME = r"(?u)(?<![\p{L}\p{N}-])\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?: \p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?)*(?: [IVXLC]+(?![\p{L}\p{N}]))?"
ALL_CASES = 63


def readings(names: DataFrame, endings: DataFrame, name: str = "name", shortest: int = 1) -> DataFrame:
    """``name``, kind, genders and cells of the distinct names, by their longest listed ending."""
    turned = F.reverse(F.lower(name))
    heads = F.transform(F.sequence(F.lit(shortest), F.greatest(F.length(name), F.lit(shortest))), lambda i: F.substring(turned, F.lit(1), i))
    own = names.select(name).where(F.col(name).isNotNull() & (F.length(name) > 0)).distinct().select(name, F.explode(F.array_distinct(heads)).alias("_end"))
    listed = endings.select(F.reverse(F.lower("ending")).alias("_end"), "kind", "genders", "cells")
    found = with_dimension(own, listed, "_end", "inner")
    best = found.groupBy(name).agg(F.max_by(F.struct("kind", "genders", "cells"), F.length("_end")).alias("r"))
    return best.select(name, "r.*")


def narrowed(chain: Column) -> Column:
    """(genders, cells) of an array of (genders, cells); null entries say nothing."""

    def step(a: Column, x: Column) -> Column:
        g, c = a["genders"].bitwiseAND(x["genders"]), a["cells"].bitwiseAND(x["cells"])
        fits = (g != 0) & (c != 0)
        both = F.struct(F.when(fits, g).otherwise(a["genders"]).alias("genders"), F.when(fits, c).otherwise(a["cells"]).alias("cells"))
        return F.when(x.isNull(), a).otherwise(both)

    start = F.struct(F.lit(3).alias("genders"), F.lit(ALL_CASES).alias("cells"))
    return F.aggregate(chain, start, step)


def chains(texts: DataFrame, endings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, chain_no, chain (as written), names, genders, cells and roman (the numeral behind it, or null)
    of every chain of names of which at least one has a listed ending."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_NAME), F.lit(0))).alias("chain_no", "chain"))
    parts = F.split("chain", " ")
    last = F.element_at(parts, -1)
    numeral = (F.size(parts) > 1) & last.rlike("^[IVXLC]+$")
    rows = found.select(key, "chain_no", "chain", F.when(numeral, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts).alias("names"), F.when(numeral, last).alias("roman"))
    each = rows.select(key, "chain_no", F.posexplode("names").alias("i", "name"))
    known = readings(each.select("name"), endings)
    joined = each.join(known, "name", "left").groupBy(key, "chain_no").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("kind").isNotNull(), F.struct("genders", "cells")).alias("r")))).alias("r"), F.count("kind").alias("_known"))
    out = rows.join(joined.where("_known > 0"), [key, "chain_no"]).withColumn("_all", narrowed(F.transform("r", lambda x: x["r"])))
    return out.select(key, "chain_no", "chain", "names", F.col("_all.genders").alias("genders"), F.col("_all.cells").alias("cells"), "roman")


def said_ordinal(roman: Column, genders: Column, cells: Column) -> Column:
    """The numeral behind a name as an ordinal in the name's gender and first possible case."""
    case = F.array_position(F.transform(F.array(*[F.lit(1 << i) for i in range(6)]), lambda b: cells.bitwiseAND(b) != 0), True)

    def say(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, c in enumerate(N.CASES, 1):
            for bit, gender in ((2, "f"), (1, "m")):
                # a man in the accusative is said as in the genitive
                own = "gen" if c == "acc" and gender == "m" else c
                out = F.when((case == i) & (genders.bitwiseAND(F.lit(bit)) != 0), N.ordinal(n, own, gender)).otherwise(out)
        return out

    return F.when(roman.isNotNull(), let(N.from_roman(roman), say))


def surnames(texts: DataFrame, table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, tok_no, token and variant of the words of ``table`` (word, variant) that stand there as surnames:
    with a capital and not at the beginning of a sentence or of someone's words."""
    pattern = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
    t = F.col(text)
    parts = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("words"), F.split(t, pattern, -1).alias("gaps"))
    # bound once: in the lambda a text would be split again for each of its words
    each = let(parts, lambda p: F.transform(p["words"], lambda w, i: F.struct(w.alias("token"), F.get(p["gaps"], i).alias("gap"))))
    rows = texts.select(key, F.posexplode(each).alias("tok_no", "w")).select(key, "tok_no", "w.*")
    inside = rows.where((F.col("tok_no") > 0) & F.col("token").rlike(r"^\p{Lu}\p{Ll}") & ~F.col("gap").rlike(r"[.!?…:\n«\"“—–]"))
    return with_dimension(inside.withColumn("word", F.lower("token")), table.select(F.lower("word").alias("word"), "variant"), "word", "inner").select(key, "tok_no", "token", "variant")


#: What common Russian endings tell. Cells: 1 nominative, 2 genitive, 4 dative, 8 accusative, 16 instrumental, 32 prepositional.
RUSSIAN = [
    ("ович", "patronymic", 1, 1), ("овича", "patronymic", 1, 2 | 8), ("овичу", "patronymic", 1, 4), ("овичем", "patronymic", 1, 16), ("овиче", "patronymic", 1, 32),
    ("евич", "patronymic", 1, 1), ("евича", "patronymic", 1, 2 | 8), ("евичу", "patronymic", 1, 4), ("евичем", "patronymic", 1, 16), ("евиче", "patronymic", 1, 32),
    ("овна", "patronymic", 2, 1), ("овны", "patronymic", 2, 2), ("овне", "patronymic", 2, 4 | 32), ("овну", "patronymic", 2, 8), ("овной", "patronymic", 2, 16),
    ("евна", "patronymic", 2, 1), ("евны", "patronymic", 2, 2), ("евне", "patronymic", 2, 4 | 32), ("евну", "patronymic", 2, 8), ("евной", "patronymic", 2, 16),
    ("ов", "surname", 1, 1), ("ова", "surname", 3, 1 | 2 | 8), ("ову", "surname", 3, 4 | 8), ("овым", "surname", 1, 16), ("ове", "surname", 1, 32), ("овой", "surname", 2, 2 | 4 | 16 | 32),
    ("ин", "surname", 1, 1), ("ина", "surname", 3, 1 | 2 | 8), ("ину", "surname", 3, 4 | 8), ("иным", "surname", 1, 16), ("ине", "surname", 1, 32), ("иной", "surname", 2, 2 | 4 | 16 | 32),
    ("ский", "surname", 1, 1), ("ского", "surname", 1, 2 | 8), ("скому", "surname", 1, 4), ("ским", "surname", 1, 16), ("ском", "surname", 1, 32), ("ская", "surname", 2, 1), ("скую", "surname", 2, 8), ("ской", "surname", 2, 2 | 4 | 16 | 32),
    ("ия", "first", 2, 1), ("ии", "first", 2, 2 | 4 | 32), ("ию", "first", 2, 8), ("ией", "first", 2, 16), ("ий", "first", 1, 1), ("ей", "first", 1, 1), ("ея", "first", 1, 2 | 8), ("ею", "first", 1, 4), ("еем", "first", 1, 16),
    ("ай", "first", 1, 1), ("ая", "first", 1, 2 | 8), ("аю", "first", 1, 4), ("аем", "first", 1, 16), ("ае", "first", 1, 32),
    ("ерина", "first", 2, 1), ("ерины", "first", 2, 2), ("ерине", "first", 2, 4 | 32), ("ерину", "first", 2, 8), ("ериной", "first", 2, 16),
    ("ета", "first", 2, 1), ("еты", "first", 2, 2), ("ете", "first", 2, 4 | 32), ("ету", "first", 2, 8), ("етой", "first", 2, 16), ("анна", "first", 2, 1), ("анны", "first", 2, 2), ("анне", "first", 2, 4 | 32), ("анну", "first", 2, 8), ("анной", "first", 2, 16),
    ("р", "first", 1, 1), ("ра", "first", 1, 2 | 8), ("ру", "first", 1, 4), ("ром", "first", 1, 16), ("ре", "first", 1, 32), ("ан", "first", 1, 1), ("ана", "first", 1, 2 | 8), ("ану", "first", 1, 4), ("аном", "first", 1, 16), ("ане", "first", 1, 32),
]
