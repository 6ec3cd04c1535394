"""Text expressions: slugs, escapes, word-prefix exclusions, preference tokens, notes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, key: Column) -> Column:
    """Lower-case words and digits joined by hyphens, ending in the key."""
    words = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(words, "^-+|-+$", ""), F.lit("-"), key.cast("string"))


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(-[a-z0-9]+)*-[0-9]+$")


def escape_markdown(text: Column) -> Column:
    """A backslash before each character that markup would interpret."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!$~<>|-])", r"\\$1")


def split_list(text: Column) -> Column:
    """Trimmed elements of a comma list without the empty ones."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def preference_tokens(items: Column, cuisines: Column) -> Column:
    """Document terms of liked items (spaces to underscores) and cuisines (spaces to hyphens)."""
    def clean(xs: Column, mark: str) -> Column:
        return F.filter(F.transform(xs, lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit(mark))), lambda x: x != "")

    return F.concat(clean(items, "_"), clean(cuisines, "-"))


def first_category(tokens: Column, ranked: list[tuple[str, str]], default: str) -> Column:
    """Mark of the first category, in order, whose tag is among the tokens."""
    return F.coalesce(*(F.when(F.array_contains(tokens, tag), F.lit(mark)) for tag, mark in ranked), F.lit(default))


def exclusion_stem(term: str) -> str:
    """Lower-case term with collapsed spaces, its last word without a plural ending.

    An ending is dropped only if the word stays at least three letters longer than it.
    """
    words = term.lower().split()
    if not words:
        return ""
    last = words[-1]
    for ending in ("es", "s"):
        if last.endswith(ending) and len(last) > len(ending) + 2:
            last = last[: -len(ending)]
            break
    return " ".join([*words[:-1], last])


def exclusion_pattern(term: str) -> str | None:
    r"""Regular expression of a word that starts with the stem; none for an empty term."""
    words = exclusion_stem(term).split(" ")
    return r"\b" + r"\s+".join(map(re.escape, words)) + r"\w*" if words != [""] else None


def excluded(text: Column, term: str) -> Column:
    """Whether a lower-case text holds a word that starts with the term's stem."""
    pattern = exclusion_pattern(term)
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False)) if pattern else F.lit(False)


def safe_note(text: Column, forbidden: tuple[str, ...], most: int = 320) -> Column:
    """Whether a note is not empty, short enough and free of forbidden substrings."""
    low = F.lower(F.trim(text))
    bad = F.lit(False)
    for word in forbidden:
        bad = bad | low.contains(word)
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(F.trim(text)) <= most) & ~bad, F.lit(False))


def energy_split(protein: Column, fat: Column, carbs: Column) -> dict[str, Column]:
    """Shares of energy by macronutrient at 4, 9 and 4 kcal a gram; null without any."""
    total = protein * 4.0 + fat * 9.0 + carbs * 4.0
    return {"protein_share": F.try_divide(protein * 4.0, total), "fat_share": F.try_divide(fat * 9.0, total), "carbs_share": F.try_divide(carbs * 4.0, total)}


def meter(fraction: Column, most: float = 1.4) -> Column:
    """Width in percent of a bar that ends at ``most``."""
    return F.least(F.greatest(fraction, F.lit(0.0)), F.lit(most)) / most * 100.0
