"""Scalar building blocks as Column expressions: paths, text search, tokens, maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Null-safe string: a missing value reads as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def non_empty(c: Column) -> Column:
    """Empty strings become null, so that ``coalesce`` skips them."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def str_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def windows_basename(path: Column) -> Column:
    return F.element_at(F.split(text(path), r"[\\/]"), -1)


def file_extension(path: Column) -> Column:
    name = windows_basename(path)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def last_backslash_segment(path: Column) -> Column:
    return F.substring_index(text(path), "\\", -1)


def user_domain(value: Column) -> Column:
    v = text(value)
    return F.when(F.contains(v, F.lit("\\")), F.substring_index(v, "\\", 1)).otherwise(F.lit(""))


def user_name(value: Column) -> Column:
    v = text(value)
    return F.substr(v, F.instr(v, "\\") + F.lit(1))


# Quote-aware tokens: a quoted run, or a word that does not start with a quote.
_TOKEN = r"""("[^"]*"|'[^']*'|[^ \t\r\n"'][^ \t\r\n]*)"""


def split_command_line(command_line: Column) -> Column:
    """Tokens with their quotes kept; text with an unclosed quote stays one token."""
    c = text(command_line)
    leftover = F.regexp_replace(c, _TOKEN, "")
    return (
        F.when(c == "", F.array().cast("array<string>"))
        .when(leftover.rlike("[\"']"), F.array(c))
        .otherwise(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1)))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, also where a lambda repeats it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_wins_map(entries: Column) -> Column:
    """``array<struct<key,value>>`` to a map; of equal keys the last entry stays."""
    bound = let(
        F.reverse(entries),
        lambda r: F.struct(r.alias("entries"), F.transform(r, lambda e: e["key"]).alias("keys")),
    )
    return let(
        bound,
        lambda b: F.map_from_entries(
            F.filter(b["entries"], lambda e, i: F.array_position(b["keys"], e["key"]) == (i + 1))
        ),
    )


def parse_hashes(value: Column) -> Column:
    """``K=V,K=V`` to a map with lower-case keys."""
    pairs = F.filter(F.split(text(value), ","), lambda p: F.contains(p, F.lit("=")))
    return last_wins_map(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.lower(strip(F.substring_index(p, "=", 1))).alias("key"),
                strip(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("value"),
            ),
        )
    )


def network_direction(initiated: Column) -> Column:
    v = F.lower(strip(text(initiated)))
    return F.when(v == "true", "outbound").when(v == "false", "inbound")


def parse_long(value: Column) -> Column:
    """Integer text to long, else null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("bigint"))


def map_text(m: Column) -> Column:
    """A string map as JSON text with sorted keys; null reads as empty text."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.coalesce(F.to_json(ordered), F.lit(""))


def array_text(a: Column) -> Column:
    return F.coalesce(F.to_json(a), F.lit(""))


def contains_any(value: Column, markers: Sequence[str]) -> Column:
    """Case-insensitive substring test against any of the markers."""
    return lower_contains_any(F.lower(text(value)), markers)


def lower_contains_any(lowered: Column, markers: Sequence[str]) -> Column:
    distinct = list(dict.fromkeys(m.lower() for m in markers))
    return any_of(F.contains(lowered, F.lit(m)) for m in distinct)


def category_contains(category: Column, expected: str) -> Column:
    return F.coalesce(F.exists(category, lambda x: F.lower(x) == expected.lower()), F.lit(False))


def present_markers(lowered: Column, markers: Sequence[str]) -> Column:
    """The distinct lower-cased markers found in the text, in marker order."""
    distinct = list(dict.fromkeys(m.lower() for m in markers))
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(m)), F.lit(m)) for m in distinct]))


def contains_keyword(lowered: Column, keyword: str, whole_words: Sequence[str] = ()) -> Column:
    """Substring test; the short keywords in ``whole_words`` must stand alone."""
    if keyword in whole_words:
        return lowered.rlike(rf"(?<![a-z0-9_-]){keyword}(?![a-z0-9_-])")
    return F.contains(lowered, F.lit(keyword))


def directory_depth(executable: Column) -> Column:
    """Number of directory parts of a path, the drive letter not counted."""
    parts = F.split(F.replace(text(executable), F.lit("/"), F.lit("\\")), r"\\")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.size(F.filter(directories, lambda p: (p != "") & ~p.endswith(":")))


def has_flag(command_line: Column, flags: Sequence[str]) -> Column:
    """True if a whitespace token, stripped of quotes and lower-cased, is one of the flags."""
    tokens = F.split(F.lower(text(command_line)), r"\s+")
    return F.exists(tokens, lambda t: F.regexp_replace(t, "^[\"']+|[\"']+$", "").isin(*flags))


def split_event_codes(label: Column, keep: Sequence[str] | None = None) -> Column:
    """``"1/3, 11"`` to its distinct codes, without empty, unknown and none parts."""
    parts = F.transform(F.split(text(label), "[/,]"), strip)
    parts = F.array_distinct(F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin("unknown", "none")))
    return parts if keep is None else F.filter(parts, lambda p: p.isin(*keep))


def ordered_by(values: Column, preferred: Sequence[str]) -> Column:
    """Preferred values first in their given order, the rest after them alphabetically."""
    known = F.filter(str_array(preferred), lambda p: F.array_contains(values, p))
    rest = F.array_sort(F.filter(values, lambda v: ~v.isin(*preferred)))
    return F.concat(known, rest)


def ordered_event_ids(values: Column) -> Column:
    """Numeric codes in number order, other texts as if numbered 999."""
    keyed = F.transform(
        values,
        lambda v: F.struct(
            F.when(v.rlike(r"^\d+$"), v.try_cast("bigint")).otherwise(F.lit(999)).alias("rank"), v.alias("code")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["code"])


def join_human(values: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; an empty list reads ``no``."""
    n = F.size(values)
    head = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(1)))
    return (
        F.when(n == 0, F.lit("no"))
        .when(n == 1, values[0])
        .when(n == 2, F.array_join(values, " and "))
        .otherwise(F.concat(F.array_join(head, ", "), F.lit(", and "), F.element_at(values, -1)))
    )


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly computed columns without their being computed twice.

    A plain filter would be pushed below the projection that computes its inputs, with the whole
    expressions copied into it for every use. A generator is not pushed.
    """
    once = F.when(condition, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return df.withColumn("_kept", F.explode(once)).drop("_kept")
