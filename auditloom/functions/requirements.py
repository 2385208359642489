"""Grammar of requirement lines: PEP 508 requirements and the options of pip's files.

A line is cut into tokens; small parsers, one for each rule of the grammar, consume them.
Anything that no rule takes is an error with the place where it stands.
"""

from __future__ import annotations

import re
from enum import Enum
from typing import NamedTuple

#: The environment's names in markers (PEP 508, PEP 751).
ENVIRONMENT = frozenset("python_version python_full_version os_name sys_platform platform_release platform_system platform_version platform_machine platform_python_implementation implementation_name implementation_version extra extras dependency_groups".split())
#: Digests that pip accepts, and schemes of addresses.
DIGESTS = ("sha256", "sha384", "sha512")
SCHEMES = ("https", "http", "ssh", "git", "file")


class Takes(Enum):
    NOTHING = 0
    VALUE = 1
    FILE = 2
    PROJECT = 3


#: pip's options, by what they take.
OPTIONS = {
    "-r": Takes.FILE, "--requirement": Takes.FILE, "-c": Takes.FILE, "--constraint": Takes.FILE,
    "-e": Takes.PROJECT, "--editable": Takes.PROJECT,
    "-i": Takes.VALUE, "--index-url": Takes.VALUE, "--extra-index-url": Takes.VALUE, "-f": Takes.VALUE, "--find-links": Takes.VALUE,
    "--trusted-host": Takes.VALUE, "--no-binary": Takes.VALUE, "--only-binary": Takes.VALUE, "--use-feature": Takes.VALUE,
    "--no-index": Takes.NOTHING, "--pre": Takes.NOTHING, "--prefer-binary": Takes.NOTHING, "--require-hashes": Takes.NOTHING,
}

_TOKENS = re.compile(r"""(?P<space>\s+)|(?P<string>"[^"]*"|'[^']*')|(?P<op>===|[~=!<>]=|[<>])|(?P<mark>[\[\](),;@])|(?P<word>[^\s"'=!<>~\[\](),;@]+)""")
_ADDRESS = re.compile(rf"(?:[A-Za-z][A-Za-z0-9+.-]*\+)?(?:{'|'.join(SCHEMES)})://\S+")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
_VERSION = re.compile(r"[A-Za-z0-9*_.+!-]+")


class Token(NamedTuple):
    kind: str
    text: str
    at: int


class Malformed(ValueError):
    pass


class Reference(NamedTuple):
    """A place in the project that a line needs: a file, or for an editable one a folder too."""

    path: str
    folder: bool


class Cursor:
    """Tokens of a text, taken one by one."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise Malformed(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        self.place = 0

    def peek(self) -> Token:
        return self.tokens[self.place] if self.place < len(self.tokens) else Token("end", "", len(self.text))

    def take(self, *texts: str) -> str | None:
        """The next token's text if it is one of texts."""
        if self.peek().kind != "string" and self.peek().text in texts:
            self.place += 1
            return self.tokens[self.place - 1].text
        return None

    def need(self, kind: str, form: re.Pattern | None = None) -> str:
        token = self.peek()
        if token.kind != kind or form is not None and not form.fullmatch(token.text):
            raise Malformed(f"expected a {kind} at {token.at} of {self.text!r}")
        self.place += 1
        return token.text

    def expect(self, text: str) -> None:
        if not self.take(text):
            raise Malformed(f"expected {text!r} at {self.peek().at} of {self.text!r}")


def _term(c: Cursor) -> None:
    if c.peek().kind == "string":
        c.need("string")
    elif c.need("word") not in ENVIRONMENT:
        raise Malformed(f"unknown name in the marker of {c.text!r}")


def marker(c: Cursor) -> None:
    """marker = comparison (("and" | "or") comparison)*; parentheses stand for a marker."""
    open_ = 0
    while True:
        while c.take("("):
            open_ += 1
        _term(c)
        if c.peek().kind == "op":
            if c.need("op") in ("===", "~="):
                raise Malformed(f"unsupported comparison in {c.text!r}")
        elif c.take("not"):
            c.expect("in")
        else:
            c.expect("in")
        _term(c)
        while open_ and c.take(")"):
            open_ -= 1
        if not c.take("and", "or"):
            break
    if open_:
        raise Malformed(f"open parenthesis in {c.text!r}")


def _versions(c: Cursor) -> None:
    while True:
        c.need("op")
        c.need("word", _VERSION)
        if not c.take(","):
            return


def requirement(text: str) -> None:
    """requirement = name extras? (versions | "(" versions ")" | "@" address)? (";" marker)?"""
    head, semicolon, condition = text.strip().partition(";")
    before, at, address = head.partition("@")
    c = Cursor(before if at else head)
    c.need("word", _NAME)
    if c.take("["):
        c.need("word", _NAME)
        while c.take(","):
            c.need("word", _NAME)
        c.expect("]")
    if at:
        if len(address.split()) != 1:
            raise Malformed(f"one address is needed in {text!r}")
    elif c.take("("):
        _versions(c)
        c.expect(")")
    elif c.peek().kind == "op":
        _versions(c)
    c.need("end")
    if semicolon:
        c = Cursor(condition)
        marker(c)
        c.need("end")


def _inside(path: str) -> str:
    if not path.strip() or path.startswith("/") or ".." in path.split("/"):
        raise Malformed(f"{path!r} is not inside the project")
    return path


def _option(line: str) -> Reference | None:
    name, rest = re.match(r"(--[^\s=]+|-[^\s]*)(?:=|\s+|\Z)(.*)", line, re.S).groups()
    value, takes = rest.strip(), OPTIONS.get(name)
    if takes is None:
        raise Malformed(f"unsupported option {name}")
    if takes is Takes.NOTHING:
        if value:
            raise Malformed(f"{name} takes no value")
        return None
    if takes is Takes.PROJECT:
        return None if _ADDRESS.fullmatch(value) else Reference(_inside(value.partition("[")[0]), True)
    if takes is Takes.FILE:
        return Reference(_inside(value), False)
    if len(value.split()) != 1:
        raise Malformed(f"{name} takes one value")
    return None


def content(line: str) -> str:
    """A line without its comment and the sign that it goes on."""
    hash_ = re.search(r"(?:\A|\s)#", line)
    return line[: hash_.start() if hash_ else None].rstrip("\\").strip()


def line(text: str) -> Reference | None:
    """Raises Malformed for a line of no valid form; returns what it refers to in the project."""
    text = content(text)
    if not text:
        return None
    if text.startswith("-"):
        return _option(text)
    what, *digests = re.split(r" --hash=", text)
    for d in digests:
        kind, _, value = d.strip().partition(":")
        if kind not in DIGESTS or not re.fullmatch("[0-9a-fA-F]+", value):
            raise Malformed(f"malformed digest {d!r}")
    if not _ADDRESS.fullmatch(what.strip()):
        requirement(what)
    return None
