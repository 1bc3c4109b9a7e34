"""Name normalisers and string keys. Five families; each maps NULL to NULL."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Club words without meaning for identity.
CLUB_WORDS = ("fc", "afc", "cf", "sc", "ac", "cd", "club")
SHORT_CLUB_WORDS = ("fc", "afc", "cf", "the")


@functools.cache
def _plain() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, those characters, and the Latin letters and
    ligatures that have several."""
    made = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in (*range(0x80, 0x3000), *range(0xFB00, 0xFB07))}
    one = {c: p for c, p in made.items() if len(p) == 1}
    several = {c: p for c, p in made.items() if len(p) > 1 and unicodedata.category(c)[0] == "L" and p.isalpha()}
    return "".join(one), "".join(one.values()), several


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition to ASCII: letters lose their marks, what has no ASCII in it is dropped."""
    letters, plain, several = _plain()
    for c, p in several.items():
        x = F.replace(x, F.lit(c), F.lit(p))
    return F.regexp_replace(F.translate(x, letters, plain), r"[^\x00-\x7F]+", "")


def _words(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(x)), "&", " and "), "[^a-z0-9]+", " "))


def _without(x: Column, words: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, rf"\b(?:{'|'.join(words)})\b", " "), " +", " "))


def name_spaced(x: Column) -> Column:
    """A: plain letters, '&' spelt out, club words dropped, single spaces."""
    return _without(_words(x), CLUB_WORDS)


def name_compact(x: Column) -> Column:
    """B: a-z and 0-9 only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def name_exchange(x: Column) -> Column:
    """C: as A, other club words."""
    return _without(_words(x), SHORT_CLUB_WORDS)


def name_slug(x: Column) -> Column:
    """D: underscores between words."""
    return F.regexp_replace(_words(x), " ", "_")


def name_player(x: Column) -> Column:
    """E: plain letters and single spaces, nothing dropped."""
    return _words(x)


def token_sort(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name_player(x), " ")), " ")


def paper_id(prefix: str, *cols: Column) -> Column:
    """Deterministic id: a prefix and 24 hex digits of the SHA-256 of the joined fields."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 24))


def hashed_id(*cols: Column) -> Column:
    """60 bits of the SHA-256 of the joined fields as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 15), 16, 10).cast("bigint")


def clean_header(name: str) -> str:
    """A column name without byte order marks, in either reading, or outer space."""
    return name.replace("﻿", "").replace("ï»¿", "").strip()
