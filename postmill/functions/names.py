"""Guesses made from an employer's name: web domains and job-board slugs; and name agreement tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import brand, core_phrase, has_phrase, is_common_word, normalise_text, tokens
from .urls import first_label


def joined_words(phrase: Column, n: int | None = None, sep: str = "") -> Column:
    words = tokens(phrase) if n is None else F.slice(tokens(phrase), 1, n)
    return F.array_join(words, sep)


def domain_candidates(phrase: Column, limit: int | None = None) -> Column:
    """Likely domains for a distinctive phrase, endings tried in order across all name forms; the first ``limit``, or all."""
    n = F.size(tokens(phrase))
    first = brand(phrase)
    forms = F.array(
        F.when(n <= 3, joined_words(phrase)),
        F.when(n >= 2, joined_words(phrase, 2)),
        F.when((F.length(first) >= 4) | (n == 1), first),
        F.when(n.between(2, 3), joined_words(phrase, sep="-")),
    )
    usable = F.array_distinct(F.filter(F.array_compact(forms), lambda v: F.length(v).between(3, 40)))
    endings = F.array(*map(F.lit, rules.DOMAIN_ENDINGS))
    every = F.flatten(F.transform(endings, lambda t: F.transform(usable, lambda v: F.concat(v, F.lit("."), t))))
    return every if limit is None else F.slice(every, 1, limit)


def slug_candidates(phrase: Column, website: Column, limit: int | None = None) -> Column:
    """Likely job-board slugs, the website's own label first; the first ``limit``, or all."""
    n = F.size(tokens(phrase))
    first = brand(phrase)
    forms = F.array(
        F.when(website.isNotNull(), first_label(website)),
        joined_words(phrase),
        joined_words(phrase, sep="-"),
        F.when(F.length(first) >= 4, first),
        F.when(n >= 2, joined_words(phrase, 2)),
    )
    ok = F.filter(F.array_compact(forms), lambda s: s.rlike("^[a-z0-9][a-z0-9-]{2,40}$"))
    found = F.array_distinct(ok)
    return found if limit is None else F.slice(found, 1, limit)


def _trusted_label(website: Column, confidence: Column) -> Column:
    """First label of the website's host, if the website itself is trusted."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= rules.STRONG_WEBSITE, first_label(website))


def board_name_matches(board: Column, phrase: Column, website: Column, confidence: Column) -> Column:
    """Does a board's own company name name this employer?

    The same phrase is enough unless it is made of common words; a phrase that
    only begins alike needs a trusted website whose domain agrees.
    """
    theirs = core_phrase(board)
    same = theirs == phrase
    begins = F.startswith(phrase, F.concat(theirs, F.lit(" "))) | F.startswith(theirs, F.concat(phrase, F.lit(" ")))
    shared = F.when(F.size(tokens(theirs)) <= F.size(tokens(phrase)), theirs).otherwise(phrase)
    label = _trusted_label(website, confidence)
    agrees = F.coalesce((label == joined_words(shared)) | (label == joined_words(shared, sep="-")), F.lit(False))
    common = F.forall(tokens(shared), is_common_word)
    named = (F.coalesce(theirs, F.lit("")) != "") & (phrase != "")
    return named & ((same & ~common) | ((same | begins) & agrees))


def text_names_employer(text: Column, phrase: Column, website: Column, confidence: Column) -> Column:
    """Does posting text name the employer, in full or by a distinctive, domain-backed brand?"""
    body = normalise_text(text)
    first = brand(phrase)
    distinctive = (F.length(first) >= 5) & ~is_common_word(first)
    backed = F.coalesce(_trusted_label(website, confidence) == first, F.lit(False))
    return (phrase != "") & (has_phrase(body, phrase) | (distinctive & has_phrase(body, first) & backed))
