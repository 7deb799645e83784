"""Text to tokens."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from quernel.errors import SqlParseError

# The reserved words.
KEYWORDS = frozenset(
    "SELECT FROM WHERE JOIN ON GROUP BY HAVING ORDER ASC DESC LIMIT AS AND OR NOT BETWEEN IN IS NULL TRUE FALSE CREATE INDEX USING".split()
)


@dataclass(frozen=True)
class Token:
    """``kind`` is the keyword or sign itself, or IDENT, NUMBER, STRING, EOF."""

    kind: str
    text: str
    position: int


_TOKEN = regex.compile(
    r"""(?P<SPACE>\s+)
      | (?P<NUMBER>-?[0-9]+(?:\.[0-9]+)?)
      | (?P<IDENT>[\p{L}_][\p{L}\p{Nd}_]*)
      | (?P<STRING>'(?:[^']|'')*')
      | (?P<SIGN><>|!=|<=|>=|[=<>(),.*;])""",
    regex.VERBOSE,
)


def tokenize(sql: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise SqlParseError("unterminated string" if sql[at] == "'" else f"unexpected character {sql[at]!r}", at)
        kind, text = m.lastgroup, m.group()
        if kind == "IDENT" and text.upper() in KEYWORDS:
            kind = text.upper()
        elif kind == "STRING":
            text = text[1:-1].replace("''", "'")
        elif kind == "SIGN":
            kind = text = "!=" if text == "<>" else text
        if kind != "SPACE":
            tokens.append(Token(kind, text, at))
        at = m.end()
    tokens.append(Token("EOF", "", at))
    return tokens
