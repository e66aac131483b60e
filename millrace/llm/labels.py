"""Canonical spellings of labels that come in variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(name: str) -> Column:
    """Lower case, without outer white space; null where nothing is left."""
    return F.nullif(F.lower(F.btrim(F.col(name), F.lit(" \t\r\n"))), F.lit(""))


def repo(name: str) -> Column:
    """As `label`, without slashes at the end."""
    return F.nullif(F.regexp_replace(label(name), r"/+$", ""), F.lit(""))


def filetype(name: str) -> Column:
    """As `label`, also without one leading dot."""
    return F.nullif(F.regexp_replace(label(name), r"^\.", ""), F.lit(""))


def source(name: str) -> Column:
    """As `label`, with `-` and blanks as `_`."""
    return F.regexp_replace(label(name), r"[- ]+", "_")


#: Two-letter codes of language tags that are written in another way.
LANGUAGES = {"eng": "en", "jp": "ja", "cn": "zh", "ger": "de", "deu": "de", "fra": "fr", "spa": "es", "rus": "ru", "hin": "hi", "tha": "th", "ara": "ar", "jpn": "ja", "zho": "zh"}


def language(name: str) -> Column:
    """The language part of a tag in lower case, three-letter and country codes as two-letter language codes."""
    first = F.regexp_extract(label(name), r"^([a-z]+)", 1)
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(pairs, first), first), F.lit(""))
