"""Text for people: citations, one-line symbols, diagram labels, plurals, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LABEL = 42
MARKER = "\n… [truncated]"


def citation(path: Column, start: Column, end: Column | None = None) -> Column:
    """``path:line`` or ``path:first-last``."""
    one = F.concat(path, F.lit(":"), start.cast("string"))
    return one if end is None else F.when(end.isNull() | (end == start), one).otherwise(F.concat(one, F.lit("-"), end.cast("string")))


def symbol_line() -> Column:
    """One line for a row of ``symbols``: kind, name, place, and what is special about it."""
    flags = F.array_compact(F.array(*[F.when(F.col(f"is_{f}"), F.lit(f)) for f in ("exported", "async", "deprecated")], F.when(F.col("role") != "unknown", F.col("role"))))
    tail = F.when(F.size(flags) > 0, F.concat(F.lit(" ["), F.array_join(flags, ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat("kind", F.lit(" "), "qualified_name", F.lit(" — "), citation(F.col("rel_path"), F.col("start_line"), F.col("end_line")), tail)


def sanitize_id(value: Column) -> Column:
    """A diagram's node id: letters, digits and single underscores, no digit first."""
    clean = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("n"), clean)).otherwise(clean)


def label(value: Column) -> Column:
    """At most 42 characters, the end kept; what breaks labels becomes a space."""
    cut = F.when(F.length(value) > MAX_LABEL, F.concat(F.lit("…"), F.right(value, F.lit(MAX_LABEL - 1)))).otherwise(value)
    return F.regexp_replace(cut, r'["\[\]{}()|]', " ")


def pluralize(noun: Column, count: Column) -> Column:
    return F.when(count == 1, noun).when(noun.rlike("(?i)(ch|s|sh|x|z)$"), F.concat(noun, F.lit("es"))).when(noun.rlike("(?i)[^aeiou]y$"), F.concat(F.left(noun, F.length(noun) - 1), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))


def estimate_tokens(text: Column) -> Column:
    """About 3.2 bytes a token."""
    return F.ceil(F.octet_length(text) / 3.2).cast("long")


def clamp_text(text: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` bytes of UTF-8, cut between characters, with a marker where it is cut."""
    allow = max(0, max_bytes - len(MARKER.encode()))
    head = F.substring(F.encode(text, "UTF-8"), 1, allow + 1)
    # a byte over: if it goes on a character, that whole character goes
    whole = F.regexp_replace(F.decode(head, "ISO-8859-1"), r"(?s)(?:[À-ÿ][\u0080-¿]*|[\u0000-\u007f])\z", "")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.concat(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), F.lit(MARKER)))


def clamp_lines(text: Column, most: int, focus: Column | None = None) -> Column:
    """struct<text, start_line, end_line, truncated>: at most ``most`` lines, about the focus."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    centre = F.greatest(F.lit(1), F.least(focus if focus is not None else F.lit(1), n))
    start = F.greatest(F.lit(1), F.least(centre - (most - 1) // 2, n - most + 1)).cast("int")
    cut = n > most
    return F.struct(
        F.when(cut, F.array_join(F.slice(lines, start, F.lit(most)), "\n")).otherwise(text).alias("text"),
        F.when(cut, start).otherwise(F.lit(1)).alias("start_line"),
        F.when(cut, start + most - 1).otherwise(n).alias("end_line"),
        cut.alias("truncated"),
    )
