"""Prompt templates: blocks between markers, slots, front matter, digests, counts in output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the ``end`` after it; null without both."""
    after = F.substring(text, F.instr(text, start) + len(start), F.length(text))
    return F.when((F.instr(text, start) > 0) & (F.instr(after, end) > 0), F.substring(after, F.lit(1), F.instr(after, end) - 1))


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """The template with each {name} replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def version(text: Column) -> Column:
    """The value of a front matter line ``version:``."""
    return F.nullif(F.regexp_extract(text, r"(?m)^version:\s*(\S+)", 1), F.lit(""))


def digest(text: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("bigint")


def milliseconds(start: Column, end: Column) -> Column:
    """Between two ISO-8601 times."""
    return ((F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / 1000).cast("double")


def short_name(name: Column, cuts: tuple[str, ...]) -> Column:
    """A display name without the given parts."""
    for c in cuts:
        name = F.replace(name, F.lit(c), F.lit(""))
    return name


def opaque_id(key: Column, salt: str) -> Column:
    """q and ten hex digits, from a salted hash in place of a generator."""
    return F.concat(F.lit("q"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), key), 256), 1, 10))
