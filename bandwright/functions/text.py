"""Text expressions with Python's Unicode behaviour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: the Unicode property and the four separators Python counts as blank.
BLANK = r"[\s\x{1C}-\x{1F}]"


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once: an expression inside a lambda is otherwise computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end (Spark's trim removes spaces only)."""
    return F.regexp_replace(c, f"(?U)^{BLANK}+|{BLANK}+$", "")


def fold(c: Column) -> Column:
    """Stripped and lower case; null for blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def words(c: Column) -> Column:
    """Lower-case words between blanks; an empty array for blank text."""
    return F.filter(F.split(F.lower(c), f"(?U){BLANK}+"), lambda x: x != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def normalise_answer(c: Column) -> Column:
    """Non-word characters as one space each, blanks collapsed, stripped, lower case."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), f"(?U){BLANK}+", " "))


def number_slots(c: Column) -> Column:
    """The set of numbers in a text, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(\d+(?:[.,/]\d+)*)"), F.lit(1))))


def acronym_slots(c: Column) -> Column:
    """The set of runs of two or more capitals in a text, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b([A-ZĐ]{2,})\b"), F.lit(1))))


def slots_equal(a: Column, b: Column) -> Column:
    """Whether two texts name the same numbers and the same acronyms."""
    return (number_slots(a) == number_slots(b)) & (acronym_slots(a) == acronym_slots(b))


def length_gap(a: Column, b: Column) -> Column:
    """Relative difference of lengths in code points; 0 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.abs(F.length(a) - F.length(b)) / longer)


def shingles(c: Column, n: int = 3) -> Column:
    """The set of character n-grams of the lower-case text; a shorter text is its own single shingle."""
    grams = lambda low: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    return F.array_distinct(bind(F.lower(c), grams))


def padded_trigrams(c: Column) -> Column:
    """Trigrams of the stripped lower-case text with two blanks at either end, repeats kept."""
    padded = F.concat(F.lit("  "), strip(F.lower(c)), F.lit("  "))
    return bind(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
