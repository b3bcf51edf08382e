"""Patterns in Python's syntax as patterns in Java's, which is what Spark's functions take.

A pattern is parsed by Python itself, and its parse tree is written out again in Java's syntax. What both know by one name but read
in two ways is spelled out: word characters, spaces, line ends and boundaries become explicit sets and look-arounds, flags that
change them are worked in, and groups get names of their own. What Java cannot say (see ``UNSAYABLE``) raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from re import _constants as K
from re import _parser

#: Look-behinds may hold no reference to a group: Java does not bound its length.
UNSAYABLE = "a group reference inside a look-behind"

_WORD = {False: r"\p{L}\p{N}_", True: "a-zA-Z0-9_"}
_DIGIT = {False: r"\p{Nd}", True: "0-9"}
_SPACE = {False: r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", True: r"\x09-\x0D\x20"}
_ANY = "(?s:.)"
#: Java counts a look-behind in 16-bit units unless it holds a character of two: none of this one, then.
_WIDE = "(?:\U00010400){0}"


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else rf"\x{{{code:X}}}"


class _Writer:
    """Writes parse trees; ``asked`` are the groups that some condition asks about."""

    def __init__(self, asked: set[int]) -> None:
        self.asked = asked

    def tree(self, items: Iterable, flags: int, behind: bool = False) -> str:
        return "".join(self.item(op, av, flags, behind) for op, av in items)

    def item(self, op, av, flags: int, behind: bool) -> str:
        ascii_only = bool(flags & re.ASCII)
        match op:
            case K.LITERAL:
                return _literal(av)
            case K.NOT_LITERAL:
                return f"(?:(?!{_literal(av)}){_ANY})"
            case K.ANY:
                return _ANY if flags & re.DOTALL else r"[^\x0A]"
            case K.IN:
                return self.set(av, ascii_only)
            case K.BRANCH:
                return "(?:" + "|".join(self.tree(x, flags, behind) for x in av[1]) + ")"
            case K.SUBPATTERN:
                return self.group(*av, flags, behind)
            case K.ATOMIC_GROUP:
                return f"(?>{self.tree(av, flags, behind)})"
            case K.MAX_REPEAT | K.MIN_REPEAT | K.POSSESSIVE_REPEAT:
                low, high, body = av
                times = f"{{{low},}}" if high is K.MAXREPEAT else f"{{{low},{high}}}"
                return f"(?:{self.tree(body, flags, behind)}){times}" + {K.MAX_REPEAT: "", K.MIN_REPEAT: "?", K.POSSESSIVE_REPEAT: "+"}[op]
            case K.ASSERT | K.ASSERT_NOT:
                way, body = av
                return f"(?{'<' if way < 0 else ''}{'=' if op is K.ASSERT else '!'}{_WIDE if way < 0 else ''}{self.tree(body, flags, behind or way < 0)})"
            case K.FAILURE:
                return "(?!)"
            case K.GROUPREF | K.GROUPREF_EXISTS if behind:
                raise ValueError(UNSAYABLE)
            case K.GROUPREF:
                return rf"\k<g{av}>"
            case K.GROUPREF_EXISTS:
                group, yes, no = av
                return rf"(?:\k<m{group}>{self.tree(yes, flags)}|(?!\k<m{group}>){self.tree(no or (), flags)})"
            case K.AT:
                return self.place(av, flags, ascii_only)
        raise ValueError(f"a pattern may not hold {op}")

    def group(self, number: int | None, added: int, removed: int, body, flags: int, behind: bool) -> str:
        inner = (flags | added) & ~removed
        if added & (re.ASCII | re.UNICODE):
            inner = (inner & ~(re.ASCII | re.UNICODE)) | (added & (re.ASCII | re.UNICODE))
        text = self.tree(body, inner, behind)
        if (inner ^ flags) & (re.IGNORECASE | re.ASCII):
            text = f"(?{self.case(inner)}:{text})"
        if number is None:
            return f"(?:{text})"
        # an empty group beside it has taken part if this one has, and matches nothing
        return f"(?<g{number}>{text})(?<m{number}>)" if number in self.asked else f"(?<g{number}>{text})"

    @staticmethod
    def case(flags: int) -> str:
        if not flags & re.IGNORECASE:
            return "-iu"
        return "i-u" if flags & re.ASCII else "iu"

    def set(self, items, ascii_only: bool) -> str:
        negated, parts = False, []
        for op, av in items:
            match op:
                case K.NEGATE:
                    negated = True
                case K.LITERAL:
                    parts.append(_literal(av))
                case K.RANGE:
                    parts.append(f"{_literal(av[0])}-{_literal(av[1])}")
                case K.CATEGORY:
                    named = {K.CATEGORY_WORD: _WORD, K.CATEGORY_DIGIT: _DIGIT, K.CATEGORY_SPACE: _SPACE}
                    other = {K.CATEGORY_NOT_WORD: _WORD, K.CATEGORY_NOT_DIGIT: _DIGIT, K.CATEGORY_NOT_SPACE: _SPACE}
                    parts.append(named[av][ascii_only] if av in named else f"[^{other[av][ascii_only]}]")
                case _:
                    raise ValueError(f"a set may not hold {op}")
        inside = f"[{''.join(parts)}]"
        return f"(?:(?!{inside}){_ANY})" if negated else inside

    @staticmethod
    def place(at, flags: int, ascii_only: bool) -> str:
        word = f"[{_WORD[ascii_only]}]"
        match at:
            case K.AT_BEGINNING:
                return r"(?:\A|(?<=\x0A))" if flags & re.MULTILINE else r"\A"
            case K.AT_BEGINNING_STRING:
                return r"\A"
            case K.AT_END:
                return r"(?=\x0A|\z)" if flags & re.MULTILINE else r"(?=\x0A?\z)"
            case K.AT_END_STRING:
                return r"\z"
            case K.AT_BOUNDARY:
                return f"(?:(?<={_WIDE}{word})(?!{word})|(?<!{_WIDE}{word})(?={word}))"
            case K.AT_NON_BOUNDARY:
                return rf"(?:(?!\A\z)(?:(?<={_WIDE}{word})(?={word})|(?<!{_WIDE}{word})(?!{word})))"
        raise ValueError(f"a pattern may not hold {at}")


def _asked(items) -> set[int]:
    """Groups that conditions anywhere in a tree ask about."""
    found: set[int] = set()
    for op, av in items:
        if op is K.GROUPREF_EXISTS:
            found |= {av[0]} | _asked(av[1]) | _asked(av[2] or ())
        elif op is K.BRANCH:
            found |= set().union(*map(_asked, av[1]))
        elif op in (K.SUBPATTERN, K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT, K.ASSERT, K.ASSERT_NOT):
            found |= _asked(av[-1])
        elif op is K.ATOMIC_GROUP:
            found |= _asked(av)
    return found


def to_java(pattern: str, flags: int = 0) -> str:
    """The pattern in Java's syntax, with its flags worked in; ``re.error`` if it is none, ValueError if Java cannot say it."""
    re.compile(pattern, flags)
    tree = _parser.parse(pattern, flags)
    found = tree.state.flags
    return f"(?{_Writer.case(found)}:{_Writer(_asked(tree)).tree(tree, found)})"


def literal(text: str, flags: int = 0) -> str:
    """A pattern for the text itself."""
    return f"(?{_Writer.case(flags)}:{''.join(_literal(ord(c)) for c in text)})"


@lru_cache(maxsize=10_000)
def java_or_literal(pattern: str, flags: int = 0, else_as: str | None = None) -> str:
    """The pattern in Java's syntax; of one that cannot be had, ``else_as`` (case ignored) if given, else its text taken literally."""
    try:
        return to_java(pattern, flags)
    except (re.error, ValueError, OverflowError, RecursionError):
        if else_as is not None:
            try:
                return to_java(else_as, flags | re.IGNORECASE)
            except (re.error, ValueError, OverflowError, RecursionError):
                pass
        return literal(pattern, flags)
