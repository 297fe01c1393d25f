"""The segment plan of a text: paragraphs, pause markers, sentences, pieces of bounded length, pauses.

A plan is an array of (text, pause_ms) per row, so planning never shuffles; ``segments`` gives one
row each. Null and empty texts have an empty plan. A pause is the silence after a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.regexmap import let
from . import segment as S

PAUSE = r"\{pause:(\d+)\}"
#: A marker that splits: at the start or end of the text, after a sentence's end or another marker,
#: or before another marker. Elsewhere it stays in the text and becomes a long comma.
_AT_BOUNDARY = r"(?<=^|[.!?…]|[.!?…]\s|\d\})\s*\{pause:\d+\}|\s*\{pause:\d+\}(?=\s*(?:$|\{pause:\d+\}))"
_SEAM = r"[.,:;!?…—–-]"


def _piece(text: Column, pause: Column) -> Column:
    return F.struct(text.alias("text"), pause.cast("int").alias("pause_ms"))


def _none() -> Column:
    return F.array().cast("array<struct<text:string,pause_ms:int>>")


def pause_pieces(text: Column) -> Column:
    """Cuts a text at the pause markers that stand at a sentence boundary. Every piece carries the
    pause of the markers after it; a text that begins with a marker begins with an empty piece."""

    def cut(s: Column) -> Column:
        pauses = F.transform(s["found"], lambda m: F.regexp_extract(m, PAUSE, 1).cast("int"))
        parts = let(pauses, lambda ms: F.transform(s["between"], lambda p, i: _piece(F.trim(p), F.coalesce(F.get(ms, i), F.lit(0)))))
        # an empty piece between two markers gives its pause to the one before
        return F.aggregate(parts, _none(), lambda done, p: F.when((p["text"] == "") & (F.size(done) > 0), _lengthened(done, p["pause_ms"])).otherwise(F.concat(done, F.array(p))))

    pieces = let(F.struct(F.split(text, _AT_BOUNDARY, -1).alias("between"), F.regexp_extract_all(text, F.lit(_AT_BOUNDARY), F.lit(0)).alias("found")), cut)
    kept = F.filter(pieces, lambda p: (p["text"] != "") | (p["pause_ms"] > 0))
    return F.when(text.isNull(), _none()).otherwise(kept)


def _lengthened(done: Column, by: Column) -> Column:
    """The pieces with a longer pause after the last."""
    last = F.element_at(done, -1)
    return F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_piece(last["text"], last["pause_ms"] + by)))


def joined_pauses(pieces: Column, at_mark: int, plain: int) -> Column:
    """Pauses between pieces of text: ``at_mark`` where the seam has a punctuation mark, else
    ``plain``, none after the last. Pieces without a letter or digit go, and their marks count for
    the seam; a single piece stays as it is."""

    def after(s: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            here = p.rlike(rf"{_SEAM}[^\p{{L}}\p{{N}}]*$") | F.coalesce(F.get(s["p"], i + 1), F.lit("")).rlike(rf"^[^\p{{L}}\p{{N}}]*{_SEAM}")
            return F.struct(F.trim(p).alias("text"), M.is_noise(p).alias("noise"), here.alias("mark"))

        marked = F.transform(s["p"], one)
        kept = F.filter(marked, lambda x: ~x["noise"])
        timed = let(kept, lambda k: F.transform(k, lambda x, i: _piece(x["text"], F.when(i == F.size(k) - 1, 0).when(x["mark"], at_mark).otherwise(plain))))
        return F.when(F.size(s["p"]) <= 1, F.transform(s["p"], lambda p: _piece(p, F.lit(0)))).otherwise(timed)

    return F.coalesce(let(F.struct(pieces.alias("p")), after), _none())


def cut_measured(text: Column, limit: int, measure: Column | None = None) -> Column:
    """Where to cut a text whose spoken length ``measure`` (default: its own) passes ``limit``: after
    the last comma, else after the last space of the longest beginning that stays within the limit
    at the text's own rate of growth. The text's length where nothing has to be or can be cut."""

    def at(s: Column) -> Column:
        own = F.length(s["t"])
        room = F.greatest(F.lit(1), F.floor(limit * own / F.greatest(s["m"], F.lit(1))).cast("int"))
        head = s["t"].substr(F.lit(1), F.least(room, own))
        comma, space = (F.length(F.regexp_extract(head, rf"(?s)^(.*{c})", 1)) for c in (r",(?!\d)", r"\s"))
        return F.when((s["m"] <= limit) | (own <= room), own).when(comma > 0, comma).when(space > 0, space).otherwise(own)

    return let(F.struct(text.alias("t"), (F.length(text) if measure is None else measure).alias("m")), at)


def fast_start(pieces: Column, limit: int = 100) -> Column:
    """The first piece with a text is cut once at ``limit`` characters, so that speaking begins soon;
    the pause stays behind its second half."""

    def start(s: Column) -> Column:
        texts = F.transform(s["p"], lambda p: F.trim(p["text"]) != "")
        i = F.array_position(texts, F.lit(True)).cast("int")
        first = F.get(s["p"], i - 1)
        at = cut_measured(first["text"], limit)
        halves = F.array(_piece(F.trim(first["text"].substr(F.lit(1), at)), F.lit(0)), _piece(F.trim(F.substr(first["text"], at + 1)), first["pause_ms"]))
        out = F.concat(F.slice(s["p"], F.lit(1), F.greatest(i - 1, F.lit(0))), halves, F.slice(s["p"], i + 1, F.size(s["p"])))
        return F.when((i > 0) & (at < F.length(first["text"])), out).otherwise(s["p"])

    return let(F.struct(pieces.alias("p")), start)


def plan(text: Column, limit: int = 400, paragraph_ms: int = 400, sentence_ms: int = 0, first: int | None = 100, abbreviations: tuple[str, ...] = ()) -> Column:
    """The whole plan: lines, pause markers at sentence boundaries, sentences, pieces of at most
    ``limit`` characters, noise left out, the first piece cut short. The last piece of a sentence,
    of a stretch before a marker and of a paragraph carries the longest pause due there."""

    def sentences(piece: Column) -> Column:
        parts = F.flatten(F.transform(S.sentence_array(piece["text"], abbreviations), lambda s: _ended(S.bounded_pieces(s, limit), F.lit(sentence_ms))))
        spoken = F.filter(parts, lambda p: ~M.is_noise(p["text"]))
        silent = F.array(_piece(F.lit(""), piece["pause_ms"]))
        return let(spoken, lambda m: F.when(F.size(m) > 0, _longest(m, piece["pause_ms"])).when(piece["pause_ms"] > 0, silent).otherwise(_none()))

    def paragraph(line: Column) -> Column:
        made = F.flatten(F.transform(pause_pieces(line), sentences))
        return let(made, lambda m: F.when(F.size(m) > 0, _longest(m, F.lit(paragraph_ms))).otherwise(_none()))

    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n+"), lambda p: F.trim(p) != "")
    whole = F.flatten(F.transform(lines, paragraph))
    return F.coalesce(fast_start(whole, first) if first else whole, _none())


def _ended(texts: Column, pause: Column) -> Column:
    """Pieces of one sentence: the pause is due after the last."""
    return let(texts, lambda t: F.transform(t, lambda p, i: _piece(F.trim(p), F.when(i == F.size(t) - 1, pause).otherwise(0))))


def _longest(pieces: Column, pause: Column) -> Column:
    """The pause after the last piece, at least ``pause``."""
    return let(pieces, lambda t: F.transform(t, lambda p, i: _piece(p["text"], F.when(i == F.size(t) - 1, F.greatest(p["pause_ms"], pause)).otherwise(p["pause_ms"]))))


def segments(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per piece of the plan: seg_no from 0, segment, pause_ms."""
    rows = df.select("*", F.posexplode(plan(F.col(text), **options)).alias("seg_no", "_piece"))
    return rows.select("*", F.col("_piece.text").alias("segment"), F.col("_piece.pause_ms").alias("pause_ms")).drop(text, "_piece")
