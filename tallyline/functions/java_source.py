"""Lexical reading of one Java source text: a small helper used inside tasks.

It cuts a text into declarations and statements, with their owners and shapes.
What kinds they are, and everything that compares, filters, weighs or counts them,
is a Spark job (``operators/changes.py``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Without groups, so that one call lists all tokens; a token's first characters tell its kind.
TOKEN = re.compile(
    r"""[\w$]+(?:\.\d+\w*)? | [{}();,.]
      | /\*\*(?!/).*?\*/ | /\*.*?\*/ | //[^\n]*
      | /\*|\"{3}(?!.*?\"{3})
      | \"{3}.*?\"{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'
      | \+\+|--|->|::|&&|\|\||[-+*/%&|^!=<>]=|[^\s\w]""",
    re.X | re.S,
)
UNTERMINATED = ("/*", '"""')  # these alone are tokens only where nothing ends them
END = ""  # stands behind the last token
TIGHT = re.compile(r" ?(\.|::) ?| (?=[,;)\]\[(])|(?<=[(\[@!]) ")
TIGHT_TYPE = re.compile(r" ?([<>,?]) ?")
KEYWORD_CALL = re.compile(r"\b(return|throw)\(")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
COMMENTS = {"javadoc", "block", "line"}
TYPE_WORDS = {"class", "interface", "enum", "record"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
# Words that lead a statement with a statement inside.
COMPOUND = {"for", "while", "switch", "catch", "synchronized", "try", "do", "finally"}
# Words that lead a statement in which two names in a row declare nothing.
LEADING = {"return", "throw", "break", "continue", "assert", "new"}
PAIRS = {"(": ")", "{": "}", "[": "]"}
CLOSERS = frozenset(PAIRS.values())
BRACKETS = CLOSERS.union(PAIRS)
MODIFIERS = {"public", "private", "protected", "static", "final", "transient", "volatile"}


class SourceError(ValueError):
    """The text is not balanced."""


def tokenise(text: str) -> list[str]:
    tokens = TOKEN.findall(text)
    if any(token in tokens for token in UNTERMINATED):
        raise SourceError("unterminated comment or text block")
    return tokens


def comment(token: str) -> str | None:
    """The kind of a comment, or None for another token."""
    start = token[:2]
    if start == "//":
        return "line"
    if start == "/*":
        return "javadoc" if token[2] == "*" and token[3] != "/" else "block"
    return None


def is_word(token: str) -> bool:
    return token[:1].isalnum() or token[:1] in ("_", "$")


def render(words: list[str]) -> str:
    """Tokens with canonical spacing, so that layout never shows up as a change."""
    if len(words) == 1 and words[0].isidentifier():
        return words[0]
    out = TIGHT.sub(r"\1", " ".join(words))
    return KEYWORD_CALL.sub(r"\1 (", out) if "return(" in out or "throw(" in out else out


def render_type(words: list[str]) -> str:
    if len(words) == 1 and words[0].isidentifier():
        return words[0]
    return TIGHT_TYPE.sub(r"\1", render(words))


def top_level(words: list[str]) -> list[int]:
    """Positions outside any bracket; angle brackets count where they enclose types."""
    if BRACKETS.isdisjoint(words):
        return list(range(len(words)))
    depth, out = 0, []
    for at, word in enumerate(words):
        if word in PAIRS:
            depth += 1
        elif word in CLOSERS:
            depth -= 1
        elif depth == 0:
            out.append(at)
    return out


def split_commas(words: list[str]) -> list[list[str]]:
    if "," not in words:
        return [words] if words else []
    parts, depth = [[]], 0
    for word in words:
        depth += (word in "([{<") - (word in ")]}>")
        if word == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(word)
    return [part for part in parts if part]


class Shape(NamedTuple):
    """What a kind is told by: the form, first and last word, and whether it assigns or declares."""

    form: str
    lead: str | None = None
    tail: str | None = None
    assigns: bool = False
    declares: bool = False


def fixed(form: str) -> Shape:
    return FIXED[form]


# Shapes that say no more than their form.
FIXED = {
    form: Shape(form)
    for form in (*sorted(COMMENTS), "annotation", "field", "class", "method", "then", "else", "if", "case")
}


class Scope:
    """What is known of a method once its end is reached. Its entities refer to it, so none has to wait."""

    __slots__ = ("signature", "statements", "first")

    def __init__(self, signature: str):
        self.signature, self.statements, self.first = signature, 0, None


class Body:
    """A type's own body: whether a constructor was met in it."""

    def __init__(self, name: str):
        self.name, self.constructor = name, False


Row = tuple[Shape, str, str, "Scope | None", bool]  # shape, unique name, owner, scope, lacks a constructor
Pending = list[tuple[Shape, str]]
Step = Iterator["Step"]
MEMBER_STOPS = frozenset("{;=(")
BODY_STOPS = frozenset("{;")
ENUM_STOPS = frozenset(";}")
CASE_STOPS = frozenset((":", "->"))
OPENING, ENDING = frozenset("{"), frozenset(";")
MARKS = frozenset((*"(){}[];=:", "->", END))  # all that ends or nests what ``until`` reads
CLOSING = {opens: frozenset(closes) for opens, closes in PAIRS.items()}


class Reader:
    """Walks the tokens once and lists their rows. What nests is a step, which yields the steps it leads into.

    ``rows`` keeps the open steps on a stack of its own, so how deep a text nests
    costs memory and nothing else. What cannot nest is read in place.
    """

    def __init__(self, text: str):
        self.words = [*tokenise(text), END, END]
        self.at = 0
        self.out: list[Row] = []

    def rows(self) -> list[Row]:
        stack = [self.members("", None, None)]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
            else:
                stack.append(step)
        return self.out

    def row(self, shape: Shape, unique_name: str, owner: str, scope: Scope | None, inner: Scope | None = None, lacks: bool = False) -> None:
        """Adds a row, which counts in ``scope``; a method and what stands before it belong to their ``inner`` scope."""
        if scope is not None and shape.form not in COMMENTS:
            scope.statements += 1
            scope.first = scope.first or shape
        self.out.append((shape, unique_name, owner, inner or scope, lacks))

    def until(self, stops: frozenset[str]) -> list[str]:
        """Words up to a stop sign outside brackets; the stop itself is not read."""
        words, found, closing, at = self.words, [], [], self.at
        while True:
            word = words[at]
            at += 1
            if word not in MARKS:
                if word[0] != "/" or not comment(word):
                    found.append(word)
                continue
            if not closing and word in stops:
                self.at = at - 1
                return found
            if word in PAIRS:
                closing.append(PAIRS[word])
            elif word in CLOSERS:
                if not closing or closing.pop() != word:
                    raise SourceError("brackets do not match")
            elif word == END:
                raise SourceError("text ends inside a declaration or statement")
            found.append(word)

    def group(self) -> list[str]:
        """What a bracketed group holds; its brackets are read too."""
        stops = CLOSING.get(self.words[self.at])
        if stops is None:
            raise SourceError("a bracket is missing")
        self.at += 1
        words = self.until(stops)
        self.at += 1
        return words

    def annotation(self) -> str:
        words = ["@"]
        self.at += 1
        while is_word(self.words[self.at]) or self.words[self.at] == ".":
            words.append(self.words[self.at])
            self.at += 1
            if self.words[self.at] != "." and words[-1] != ".":
                break
        if self.words[self.at] == "(":
            words += ["(", *self.group(), ")"]
        return render(words)

    def members(self, owner: str, body: Body | None, scope: Scope | None) -> Step:
        """Members of a type body, or the top level of a file when ``owner`` is empty.

        Comments and annotations wait for the member they stand before.
        """
        words, pending = self.words, []
        while True:
            word = words[self.at]
            if word == END or word == "}":
                if (word == END) != (owner == ""):
                    raise SourceError("braces do not match")
                self.waiting(pending, owner, scope)
                return
            if word[0] == "/" and (kind := comment(word)):
                self.at += 1
                pending.append((fixed(kind), " ".join(word.split())))
            elif word == ";":
                self.at += 1
            elif word == "@" and words[self.at + 1] != "interface":
                pending.append((fixed("annotation"), self.annotation()))
            elif word == "{":
                self.at += 1
                yield self.block(owner, scope)
            elif not owner and word in ("import", "package"):
                self.until(ENDING)
            else:
                step = self.member(owner, body, pending, scope)
                pending = []
                if step is not None:
                    yield step

    def waiting(self, pending: Pending, owner: str, scope: Scope | None) -> None:
        for shape, text in pending:
            self.row(shape, text, owner, scope)

    def member(self, owner: str, body: Body | None, pending: Pending, scope: Scope | None) -> Step | None:
        head = self.until(MEMBER_STOPS)
        stop = self.words[self.at]
        if stop == "(":
            while head and head[-1] == "@":
                head.pop()
        at = next((at for at, word in enumerate(head) if word in TYPE_WORDS), len(head))
        if at + 1 < len(head) and not (head[at] == "record" and stop in "=;"):
            return self.type_body(owner, head, at, pending, scope)
        if not owner and stop == "{" and "module" in head:  # directives declare nothing that counts
            self.waiting(pending, owner, scope)
            self.group()
        elif stop == "(":
            if not head:
                raise SourceError("a name is missing")
            return self.method(owner, head[-1], body, pending, scope)
        elif stop == "{":  # static initialiser
            self.waiting(pending, owner, scope)
            self.at += 1
            return self.block(owner, scope)
        else:
            words = head if stop == ";" else head + self.until(ENDING)
            self.at += 1
            self.waiting(pending, owner, scope)
            self.fields(owner, words, scope)
        return None

    def fields(self, owner: str, words: list[str], scope: Scope | None) -> None:
        shown = None
        for part in split_commas(words):
            left = part[: part.index("=")] if "=" in part else part
            names = [at for at, word in enumerate(left) if word[0] in LETTERS]
            if not names:
                raise SourceError("a name is missing")
            if shown is None:
                shown = render_type([word for word in left[: names[-1]] if word not in MODIFIERS])
            self.row(fixed("field"), f"{owner}.{left[names[-1]]} : {shown}", owner, scope)

    def type_body(self, owner: str, head: list[str], at: int, pending: Pending, scope: Scope | None) -> Step:
        name = head[at + 1]
        full = f"{owner}.{name}" if owner else name
        if self.words[self.at] == "(":  # record header
            self.group()
        self.until(OPENING)
        self.at += 1
        if head[at] == "enum":
            self.enum_constants()
        body = Body(name)
        self.waiting(pending, owner, scope)
        yield self.members(full, body, scope)
        self.at += 1
        lacks = bool(owner) and head[at] == "class" and not body.constructor
        self.row(fixed("class"), full, owner, scope, lacks=lacks)

    def enum_constants(self) -> None:
        self.until(ENUM_STOPS)
        if self.words[self.at] == ";":
            self.at += 1

    def method(self, owner: str, name: str, body: Body | None, pending: Pending, scope: Scope | None) -> Step | None:
        signature = f"{name}({','.join(map(parameter_type, split_commas(self.group())))})"
        full = f"{owner}.{signature}"
        if body is not None and name == body.name:
            body.constructor = True
        inner = scope or Scope(signature)  # a method of a local class belongs to the method around it
        for shape, text in pending:
            self.row(shape, text, full, scope, inner)
        self.until(BODY_STOPS)
        opens = self.words[self.at] == "{"
        self.at += 1
        last = (fixed("method"), full, owner, scope, inner)
        if opens:
            return self.block(full, inner, last)
        self.row(*last)
        return None

    def block(self, owner: str, scope: Scope | None, last: tuple | None = None) -> Step:
        """The statements up to the closing brace; ``last`` is the row that follows it."""
        words = self.words
        while True:
            word = words[self.at]
            if word == "}":
                self.at += 1
                if last is not None:
                    self.row(*last)
                return
            step = self.statement(owner, scope, in_block=True)
            if step is not None:
                yield step

    def statement(self, owner: str, scope: Scope | None, in_block: bool = False) -> Step | None:
        words = self.words
        word = words[self.at]
        while word[:1] == "/" and (kind := comment(word)):
            self.row(fixed(kind), " ".join(word.split()), owner, scope)
            self.at += 1
            word = words[self.at]
            if in_block and word == "}":  # the comment was the last of its block
                return None
        if word == END:
            raise SourceError("text ends inside a block")
        if word == "{":
            self.at += 1
            return self.block(owner, scope)
        if word == ";":
            self.at += 1
        elif word == "@":
            self.row(fixed("annotation"), self.annotation(), owner, scope)
        elif word in ("class", "interface", "enum"):
            return self.member(owner, None, [], scope)
        elif word == "if":
            return self.condition(owner, scope)
        elif word in COMPOUND:
            return self.compound(word, owner, scope)
        elif word in ("case", "default"):
            shown = self.until(CASE_STOPS)
            self.at += 1
            self.row(fixed("case"), render(shown), owner, scope)
        elif words[self.at + 1] == ":" and is_word(word):  # label
            self.at += 2
        else:
            found = self.until(ENDING)
            self.at += 1
            if found:
                for shape, shown in simple(found):
                    self.row(shape, shown, owner, scope)
        return None

    def condition(self, owner: str, scope: Scope | None) -> Step:
        self.at += 1
        condition = render(self.group())
        step = self.statement(owner, scope)
        if step is not None:
            yield step
        self.row(fixed("then"), condition, owner, scope)
        if self.words[self.at] == "else":
            self.at += 1
            step = self.statement(owner, scope)
            if step is not None:
                yield step
            self.row(fixed("else"), condition, owner, scope)
        self.row(fixed("if"), condition, owner, scope)

    def compound(self, word: str, owner: str, scope: Scope | None) -> Step:
        self.at += 1
        head = render(self.group()) if self.words[self.at] == "(" else ""
        shape = Shape("compound", word, declares=word == "for" and ":" in head and ";" not in head)
        step = self.statement(owner, scope)
        if step is not None:
            yield step
        if word == "do":
            head = render(self.until(ENDING))
            self.at += 1
        self.row(shape, head, owner, scope)


def parameter_type(words: list[str]) -> str:
    """The type of one parameter: no annotations, no ``final``, brackets behind the name count."""
    out, at = [], 0
    while at < len(words):
        if words[at] != "@":
            out.append(words[at])
            at += 1
            continue
        at += 2
        while at + 1 < len(words) and words[at] == ".":
            at += 2
        if at < len(words) and words[at] == "(":
            depth = 0
            while at < len(words):
                depth += (words[at] == "(") - (words[at] == ")")
                at += 1
                if depth == 0:
                    break
    out = [word for word in out if word != "final"]
    behind = []
    while out and out[-1] in ("[", "]"):
        behind.insert(0, out.pop())
    return render_type(out[:-1] + behind)


def simple(words: list[str]) -> list[tuple[Shape, str]]:
    """Shape and text of a statement without a body, after the call that its declaration starts with, if it does."""
    outside = top_level(words)
    assign = next((at for at in outside if words[at] in ASSIGN), None)
    left = words[:assign] if assign is not None else words
    declares = False
    if words[0] not in LEADING:
        before = None
        for at in outside:
            if at >= len(left):
                break
            if words[at][0] in LETTERS:
                if before is not None and (at == before + 1 or words[at - 1] in ("]", ">")):
                    declares = True
                    break
                before = at
    lead = words[0] + "(" if words[0] in ("this", "super") and words[1:2] == ["("] else words[0]
    plain = Shape("plain", lead, words[-1], assign is not None, declares), render(words) + ";"
    value = words[assign + 1 :] if declares and assign is not None else []
    if value and value[-1] == ")" and value[0] not in ("new", "("):
        called = top_level(value)
        if called and all(is_word(value[at]) or value[at][0] == "." for at in called):
            return [(Shape("initialiser", lead), render(value) + ";"), plain]
    return [plain]


class Entity(NamedTuple):
    """A declaration or statement, and what its method looks like as a whole."""

    ordinal: int
    shape: Shape
    unique_name: str
    owner: str
    method: str | None
    method_statements: int | None
    method_first: Shape | None
    lacks_constructor: bool


def listed(text: str) -> list[tuple]:
    """The declarations and statements of one text, inner ones first, as plain tuples of what ``Entity`` names."""
    out, none = [], (None, None, None)
    for at, (shape, unique_name, owner, scope, lacks) in enumerate(Reader(text).rows()):
        method = none if scope is None else (scope.signature, scope.statements, scope.first)
        out.append((at, shape, unique_name, owner, *method, lacks))
    return out


def entities(text: str) -> list[Entity]:
    """The declarations and statements of one text, inner ones first."""
    return [Entity._make(entity) for entity in listed(text)]


def unreadable(text: str) -> list[Entity]:
    """Reads a text for its errors only; gives no entities."""
    Reader(text).rows()
    return []
