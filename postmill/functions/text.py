"""Text columns: cleaning, keys, names, HTML to text. All native expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .patterns import SPACES, java, needed, words


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(java(pattern, ignore_case))


def may_match(lower: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds what every match of ``pattern`` holds."""
    groups = [reduce(or_, [F.contains(lower, F.lit(t)) for t in group]) for group in needed(pattern)]
    return reduce(and_, groups) if groups else F.lit(True)


def matches_in(lower: Column, pattern: str) -> Column:
    """``matches`` of a lower-case text, with plain searches first: for patterns that most texts do not hold."""
    return may_match(lower, pattern) & matches(lower, pattern, False)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Expressions are trees: naming a long one five times makes five copies, and
    nesting such functions multiplies them. A one-element transform binds it instead.
    """
    return F.get(F.transform(F.array(value), use), 0)


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of ``key`` in a small literal mapping, as a CASE expression."""
    out = reduce(
        lambda acc, kv: acc.when(key == F.lit(kv[0]), F.lit(kv[1])),
        list(mapping.items())[1:],
        F.when(key == F.lit(next(iter(mapping))), F.lit(next(iter(mapping.values())))),
    )
    return out if default is None else out.otherwise(default)


def first_rule(col: Column, table, then=F.lit) -> Column:
    """Label of the first pattern in ``table`` (label, pattern) found in ``col``."""
    head, *rest = table
    chain = F.when(matches(col, head[1]), then(head[0]))
    for label, pattern in rest:
        chain = chain.when(matches(col, pattern), then(label))
    return chain


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


# A run of spaces that is not one plain space already.
_RUN_OF_SPACES = java(r"[[^ -~]&&\s]\s*| \s+", False)


def squeeze(col: Column) -> Column:
    return F.regexp_replace(col, _RUN_OF_SPACES, " ")


def clean(col: Column) -> Column:
    """Collapse whitespace of any kind to single spaces; null becomes ''."""
    return F.trim(squeeze(F.coalesce(col, F.lit(""))))


def key(col: Column) -> Column:
    """Identity key: blind to case, whitespace and quote style, nothing else."""
    return F.translate(F.lower(clean(col)), "‘’“”\"", "''")


def title_case(col: Column) -> Column:
    """Capitals after a space, hyphen, apostrophe or bracket; small words stay lower inside a name."""
    mark = "\u0001"
    lower = F.lower(clean(col))
    marked = F.regexp_replace(lower, r"(^|[-'( ])([a-z])", "$1" + mark + "$2")
    small = "|".join(rules.SMALL_WORDS)
    unmarked = F.regexp_replace(marked, f"(?<= ){mark}({small})(?= |\\z)", "$1")
    parts = F.split(unmarked, mark)
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
            ),
        ),
        "",
    )


def normalise_text(col: Column) -> Column:
    """Lower-case ASCII words separated by single spaces."""
    out = F.regexp_replace(F.lower(col), "&", " and ")
    out = F.regexp_replace(out, "['’`]", "")
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def trading_name(col: Column) -> Column:
    """What follows 't/a' or 'trading as', else the whole name."""
    return F.regexp_replace(col, java(r"^.*?\<(?:t/a|trading as)\>\s*(.+)\z"), "$1")


def core_phrase(name: Column) -> Column:
    """The distinctive words of a company name, joined by spaces.

    A chain of single replacements: nothing is evaluated twice, so the generated
    code stays small enough to compile. A name made of legal words alone is
    marked first and then left as it is.
    """
    legal, trailing = "|".join(rules.LEGAL_WORDS), "|".join(rules.TRAILING_WORDS)
    plain = normalise_text(F.regexp_replace(trading_name(name), r"\(.*?\)", " "))
    marked = F.regexp_replace(plain, rf"^((?:(?:{legal})(?: |\z))+)\z", "\u0001$1")
    kept = F.trim(F.regexp_replace(marked, rf"^\u0001(.*)\z|\b(?:{legal})\b ?", "$1"))
    return F.regexp_replace(kept, rf"^(\S+ \S+(?: \S+)*?)(?: (?:{trailing}))+\z", "$1")


def tokens(phrase: Column) -> Column:
    return F.filter(F.split(phrase, " "), lambda t: t != "")


def brand(phrase: Column) -> Column:
    return F.split_part(phrase, F.lit(" "), F.lit(1))


def is_common_word(word: Column) -> Column:
    return word.isin(*rules.COMMON_WORDS) | (F.length(word) < 4)


def has_phrase(haystack: Column, phrase: Column) -> Column:
    """Whole-word containment; both sides already normalised."""
    return F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def _code_point(code: Column) -> Column:
    ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(ok, code).otherwise(F.lit(32))
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))


def _named_or_numbered(body: Column) -> Column:
    """The character an entity's body (what is between '&' and ';') stands for, or null."""
    low = F.lower(body)
    hexed = F.regexp_extract(low, r"^#x0*([0-9a-f]{1,6})\z", 1)
    decimal = F.regexp_extract(low, r"^#0*([0-9]{1,7})\z", 1)
    number = F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("bigint")).when(
        decimal != "", decimal.try_cast("bigint")
    )
    names = F.create_map(*[F.lit(x) for pair in rules.ENTITIES.items() for x in pair])
    return F.when(F.startswith(body, F.lit("#")), let(number, _code_point)).otherwise(F.try_element_at(names, low))


def _decoded(text: Column) -> Column:
    """Each piece after a '&' begins with an entity or does not; no entity holds another '&'."""

    def piece(p: Column) -> Column:
        body = F.substring_index(p, ";", 1)
        known = F.when(F.contains(p, F.lit(";")), let(body, _named_or_numbered))
        tail = F.substr(p, F.length(body) + 2)
        return F.coalesce(F.concat(known, tail), F.concat(F.lit("&"), p))

    return F.array_join(F.transform(F.split(text, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")


#: Names that markup is full of, replaced by themselves.
_COMMON = ("lt", "gt", "quot", "nbsp")
#: What is left to decode then, '&amp;' in lower case aside.
_LEFT_OVER = r"(?i)&(?!(?-i:amp;))(?:#x?[0-9a-f]+|[a-z]+);"


def decode_entities(col: Column) -> Column:
    """Decode named, decimal and hex entities in one pass; unknown ones stay as they are.

    The common names are plain replacements: the characters they stand for cannot be
    part of another entity, but for '&', which comes last. Only a text with other
    entities is taken apart.
    """

    def replaced(c: Column) -> Column:
        plain = reduce(lambda t, e: F.replace(t, F.lit(f"&{e};"), F.lit(rules.ENTITIES[e])), _COMMON, c)
        return let(plain, lambda t: F.when(t.rlike(_LEFT_OVER), _decoded(t)).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&"))))

    return let(col, lambda c: F.when(F.contains(c, F.lit("&")), replaced(c)).otherwise(c))


_BLOCK_END = r"(?i)<\s*(?:br|/p|/div|/li|/h\d|/tr)\s*/?>"
_ESCAPED_MARKUP = r"(?i)&lt;\s*(?:p|div|ul|li|br|h\d|strong|span)\b"


# One space or tab more than a single space; a space of any kind.
_GAP = r"[ \t\u00a0]{2,}|[\t\u00a0]"
_ANY_SPACE = java(r"\s", False)


def html_to_text(col: Column) -> Column:
    """Markup, even if escaped twice, to plain text with one line per block."""

    def bare(c: Column) -> Column:
        out = F.regexp_replace(c, r"(?i)<(script|style)[\s\S]*?</\1>", " ")
        out = F.regexp_replace(out, _BLOCK_END, "\n")
        return F.regexp_replace(out, "<[^>]+>", " ")

    raw = let(col, lambda c: F.when(F.contains(c, F.lit("&")) & c.rlike(_ESCAPED_MARKUP), decode_entities(c)).otherwise(c))
    marked = let(raw, lambda c: F.when(F.contains(c, F.lit("<")), bare(c)).otherwise(c))
    text = F.regexp_replace(decode_entities(marked), _GAP, " ")
    return trim(F.regexp_replace(text, rf"{_ANY_SPACE}*\n{_ANY_SPACE}*", "\n"))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def join_present(sep: str, *cols: Column) -> Column:
    """Join the values that are neither null nor empty."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])
