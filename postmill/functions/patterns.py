"""One pattern notation, two regex dialects.

Rules are written once, in a neutral notation, and rendered for the engine that
evaluates them. Three tokens are special:

``\\<`` / ``\\>``  an ASCII word starts / ends here
``\\b``           an ASCII word boundary, either way round
``\\s``           one whitespace character, Unicode spaces included

Java's own ``\\b`` and ``\\s`` cannot be used: the first looks at Unicode letters
on some JVMs, the second ignores no-break spaces. ``java`` spells the tokens out
with lookarounds; ``re2`` (used only to check results on another engine) has no
lookaround, but its ``\\b`` is ASCII already.
"""

from __future__ import annotations

import functools
from re import _parser as _re

# Java's name for [A-Za-z0-9_], which it tests at once and not range by range.
_WORD = r"\w"

# The whitespace characters of ECMAScript's \s.
_SPACE_CLASS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Printable ASCII is told from all of them at once.
_JAVA_SPACE = f"[[^!-~]&&[{_SPACE_CLASS}]]"
#: The same characters one by one.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_RE2_SPACE = (
    r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


def words(*alternatives: str) -> str:
    """A pattern for any of ``alternatives`` standing as whole ASCII words."""
    return r"\<(?:" + "|".join(alternatives) + r")\>"


def any_of(*patterns: str) -> str:
    return "|".join(patterns)


def java(pattern: str, ignore_case: bool = True) -> str:
    body = (
        pattern.replace(r"\<", f"(?<!{_WORD})")
        .replace(r"\>", f"(?!{_WORD})")
        .replace(r"\b", f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
        .replace(r"\s", _JAVA_SPACE)
    )
    return ("(?i)" if ignore_case else "") + body


def re2(pattern: str, ignore_case: bool = True) -> str:
    body = pattern.replace(r"\<", r"\b").replace(r"\>", r"\b").replace(r"\s", _RE2_SPACE)
    return ("(?i)" if ignore_case else "") + body


# ---------------------------------------------------------------- texts that a match cannot do without
@functools.cache
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case texts: every match, whatever its case, holds at least one text of each group.

    A text that lacks a whole group has no match, which plain searches tell sooner than the pattern.
    """
    groups = {g for g in _groups(_parsed(pattern)) if min(map(len, g)) > 1}
    return tuple(sorted(groups, key=_strength, reverse=True))


def _parsed(pattern: str):
    return _re.parse(pattern.replace(r"\<", r"\b").replace(r"\>", r"\b"))


def _strength(group: tuple[str, ...]) -> tuple:
    return min(map(len, group)), -len(group), group


def _groups(items) -> list[tuple[str, ...]]:
    found, run = [], ""

    def ended() -> str:
        if run:
            found.append((run,))
        return ""

    for op, value in _flat(items):
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # these take up no room
            run = ended()
            if name == "BRANCH":
                arms = [max(_groups(arm), key=_strength, default=()) for arm in value[1]]
                if all(arms):
                    found.append(tuple(sorted({text for arm in arms for text in arm})))
            elif name.endswith("_REPEAT") and value[0]:
                found += _groups(value[2])
    ended()
    return found


def _flat(items):
    """The parts of a sequence, groups opened."""
    for op, value in items:
        if str(op) == "SUBPATTERN":
            yield from _flat(value[3])
        else:
            yield op, value


def begins_with(pattern: str) -> str:
    """The characters a match can begin with, lower case; '' if they are not a few known ones."""
    return "".join(sorted(_first(_parsed(pattern)) or ()))


def _first(items) -> set[str] | None:
    """First characters of a sequence; None if not known, or if it may be empty."""
    found: set[str] = set()
    for op, value in _flat(items):
        name = str(op)
        if name == "LITERAL":
            return found | {chr(value).lower()}
        if name == "BRANCH":
            arms = [_first(arm) for arm in value[1]]
            return None if None in arms else found.union(*arms)
        if name == "IN":
            return found | {chr(v).lower() for _, v in value} if all(str(o) == "LITERAL" for o, _ in value) else None
        if name.endswith("_REPEAT"):
            inner = _first(value[2])
            if inner is None:
                return None
            found |= inner
            if value[0]:
                return found
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            return None
    return None
