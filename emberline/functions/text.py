"""Text cleaning as native column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_INFORMED = "NAO INFORMADO"

# All characters that Unicode counts as white space.
WHITESPACE = "".join(
    chr(cp) for cp in range(0x3001) if chr(cp).isspace()
)


@dataclass(frozen=True)
class TextRule:
    """What a cleaning variant does with null, empty and blank input."""

    null_as: str
    empty_as: str
    blank_as: str
    fold_newlines: bool


HOTSPOT = TextRule(NOT_INFORMED, NOT_INFORMED, NOT_INFORMED, True)
LAND_COVER = TextRule("", "", "", False)
INFRASTRUCTURE = TextRule(NOT_INFORMED, "", "", False)
MUNICIPALITY = TextRule("", "", "", True)
TERRITORY = TextRule(NOT_INFORMED, NOT_INFORMED, "", True)


@functools.cache
def _unaccent_table() -> tuple[str, str]:
    """(source, target) for ``translate``: each accented letter to its base letter.

    Combining marks have no partner in the target, so ``translate`` deletes them. Characters that
    decompose into several base characters (Hangul, a few Indic vowel signs) keep their composed form.
    """
    source, target, deleted = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        char = chr(cp)
        if unicodedata.category(char) == "Mn":
            deleted.append(char)
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if bare != char and len(bare) == 1:
            source.append(char)
            target.append(bare)
    return "".join(source + deleted), "".join(target)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_accents(c: Column) -> Column:
    source, target = _unaccent_table()
    return F.translate(c, source, target)


def normalize_text(c: Column, rule: TextRule = HOTSPOT) -> Column:
    """Upper-case, unaccented, trimmed text; null, empty and blank input follow ``rule``."""
    text = c.cast("string")
    folded = F.translate(text, "\n\r", "  ") if rule.fold_newlines else text
    bare = strip(folded)
    clean = strip_accents(F.upper(bare))
    if rule.empty_as == rule.blank_as:
        return F.when(text.isNull(), rule.null_as).when(bare == "", rule.blank_as).otherwise(clean)
    return (
        F.when(text.isNull(), rule.null_as)
        .when(text == "", rule.empty_as)
        .when(bare == "", rule.blank_as)
        .otherwise(clean)
    )


def strip_code(c: Column, rule: TextRule = LAND_COVER) -> Column:
    """Name without the code in parentheses: ``'Alto Rio (12)'`` -> ``'ALTO RIO'``."""
    return normalize_text(F.substring_index(c, "(", 1), rule)


def html_field(html: Column, label: str, default: str | None = None) -> Column:
    """Text after the bold ``label`` of a popup, up to the next line break or the end."""
    pattern = rf"(?iu)<b>\Q{label}\E:\s*</b>(.*?)(?:<br/>|$)"
    found = F.regexp_extract(html, pattern, 1)
    return F.when(html.rlike(pattern), strip(found)).otherwise(F.lit(default))


def without_unit(c: Column, unit: str) -> Column:
    """Drop the unit suffix, e.g. ``' Km'``, and the blanks around the number."""
    return strip(F.replace(c, F.lit(unit), F.lit("")))


def state_suffix(c: Column) -> Column:
    """Upper-case text after the last hyphen (``'Afuá - pa'`` -> ``'PA'``), else ``'NA'``."""
    return F.when(F.instr(c, "-") > 0, F.upper(strip(F.substring_index(c, "-", -1)))).otherwise("NA")


def display_name(c: Column, tag: str) -> Column:
    """Readable query name: the scenario ``tag`` removed, underscores as blanks."""
    return F.replace(F.replace(c, F.lit(tag), F.lit("")), F.lit("_"), F.lit(" "))
