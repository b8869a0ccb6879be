"""A lexer for the assignments of source, shell, JSON, YAML, ini, env and XML texts: names, the literals that reach them, scopes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

#: A string: prefix letters, then triple quotes over any lines, or quotes within a line, or a template in backticks. A quote
#: within a word is none.
_STRING = r"(?<![\w])[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|(?!\"\"\")[\s\S])*\"\"\"|'''(?:\\.|(?!''')[\s\S])*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?<![\w])`(?:[^`\\]|\\.)*`"
_REF = r"\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*"
_NAME = r"[A-Za-z_$][\w$]*(?:(?:[.-]|->)[A-Za-z_$][\w$]*)*"
TOKEN = re.compile(
    rf"(?P<string>{_STRING})|(?P<ref>{_REF})|(?P<name>{_NAME})|(?P<number>\d[\w.]*)|(?P<join>\\\r?\n)|(?P<line>\r?\n)"
    r"|(?P<op>\+=|:=|=>|==|!=|<=|>=|=~|::|=|:)|(?P<plus>\+|\.\.?)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<other>[^\s\w])",
    re.A,
)
_XML = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>[ \t\r\n]*([^<>\s]+)[ \t\r\n]*</\1>", re.A)
#: A value: terms that +, . or .. joins, or strings one after another. Bare words may hold + and = of base64.
_TERM = rf"{_STRING}|{_REF}|[A-Za-z0-9_/.=-]+"
_VALUE = re.compile(rf"[ \t]*(?:[(\[{{][ \t]*)*(\+*(?:{_TERM})(?:(?:[ \t]*\++[ \t]*|[ \t]*\.\.?[ \t]*(?=[\"'$`])|(?<=[\"'])[ \t]+(?=[rRbBuUfF]{{0,2}}[\"']))(?:{_TERM}))*\+*)", re.A)
_RUN = re.compile(rf"{_STRING}|{_REF}|[A-Za-z0-9_+/.=-]+", re.A)
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*\r?\n")
_INNER = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)(?:![rsa])?(?::[^{}]*)?\}", re.A)
#: A bare run that is one base64 literal, whose + are its own digits.
_BASE64 = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])(?=.{16})[A-Za-z0-9+/]+={0,2}\Z")
_IDENT = re.compile(r"[A-Za-z_$][\w$.-]*\Z", re.A)
#: Names as code writes them: an unbound one is a reference to something else, no literal.
_NAME_ONLY = re.compile(r"[A-Za-z_$][A-Za-z_$]*(?:\.[A-Za-z_$][A-Za-z_$]*)*\Z")
_KEY = re.compile(r"[A-Za-z_$][\w$. -]*\Z", re.A)
ASSIGNS = ("=", ":=", "+=", "=>", ":")
#: Words before a parenthesis and a brace that open no function, and words that begin one.
BLOCKS = frozenset(("if", "for", "while", "switch", "catch", "foreach", "elif", "elsif", "with", "until", "using", "lock", "synchronized", "match"))
FUNCTIONS = frozenset(("def", "function", "func", "fn", "sub", "fun"))


class Literal:
    """What reaches a name: the number of each of its characters, and parts, which are spans of literals and other Literals.

    Literals refer to those that they are made of, so all spans are carried and nothing is copied.
    """

    __slots__ = ("counts", "parts")

    def __init__(self):
        self.counts, self.parts = Counter(), []

    def add(self, other: Literal) -> None:
        for c, n in other.counts.items():
            self.counts[c] += n
        self.parts.append(other)

    def spans(self, told: set) -> Iterator[tuple[int, int]]:
        """The spans of all parts; Literals in ``told`` are passed over, those met are put there."""
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                if x[1] > x[0]:
                    yield x
            elif id(x) not in told:
                told.add(id(x))
                todo.extend(x.parts)


class Scopes:
    """Bindings by scope: of functions in braces or by indentation. Inner ones hide outer ones, parameters are unknown."""

    def __init__(self):
        self.stack: list[tuple[str, int, dict]] = [("top", -1, {})]

    def get(self, name: str) -> Literal | None:
        for _, _, names in reversed(self.stack):
            if name in names:
                return names[name]
        return None

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def bind(self, name: str, value: Literal | None) -> None:
        self.stack[-1][2][name] = value

    def push(self, kind: str, level: int, parameters=()) -> None:
        self.stack.append((kind, level, dict.fromkeys(parameters)))

    def pop(self, kind: str, level: int) -> None:
        """Leave the scopes of a kind that lie deeper than ``level``, and those within them."""
        for k in range(1, len(self.stack)):
            if self.stack[k][0] == kind and self.stack[k][1] >= level:
                del self.stack[k:]
                return


def _open_quote(term: str) -> tuple[int, int]:
    """Lengths of a string's prefix and of its quotes."""
    prefix = len(term) - len(term.lstrip("rRbBuUfF"))
    return prefix, 3 if term[prefix : prefix + 3] in ('"""', "'''") else 1


class Lexer:
    """Assignments of one text in order: (name, Literal)."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.starts = [t[1] for t in self.tokens]
        self.scopes = Scopes()
        self._pair()
        self.flat = self._flat()

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def _pair(self) -> None:
        """Matching brackets, and whether a token stands within parentheses or square ones."""
        self.match, self.inside, stack = {}, [], []
        for i, (kind, a, _) in enumerate(self.tokens):
            self.inside.append(bool(stack) and self.text[self.tokens[stack[-1]][1]] in "([")
            if kind == "open":
                stack.append(i)
            elif kind == "close" and stack and self.text[self.tokens[stack[-1]][1]] + self.text[a] in ("()", "[]", "{}"):
                self.match[i] = stack.pop()
        for i in stack:  # never closed: not taken for a bracket that joins lines
            for k in range(i + 1, len(self.inside)):
                if not self.inside[k] or k in self.match:
                    break
                self.inside[k] = False

    def _flat(self) -> str:
        """The text with a blank for each line break within an expression: places stay as they are."""
        cuts = []
        for i, (kind, a, b) in enumerate(self.tokens):
            if kind == "join":
                cuts.append((a, b))
            elif kind == "line":
                before, after = self.word(i - 1), self.word(i + 1)
                goes_on = before in ASSIGNS and self.kind(i + 1) == "string" or self.kind(i - 1) == "plus" or self.kind(i + 1) == "plus" and after[0] in "+." and self.kind(i + 2) in ("string", "ref")
                if self.inside[i] or goes_on:
                    cuts.append((a, b))
        out, at = [], 0
        for a, b in cuts:
            out += [self.text[at:a], " " * (b - a)]
            at = b
        return "".join([*out, self.text[at:]])

    def indent(self, at: int) -> int:
        """The blanks before the first character of the line at a place."""
        line = self.text.rfind("\n", 0, at) + 1
        rest = self.text[line:at]
        return len(rest) - len(rest.lstrip(" \t")) if rest.strip(" \t-") else len(rest)

    def target(self, i: int) -> str | None:
        """The name that the operator at token i assigns to: a name, a quoted key, or one with subscripts."""
        k = i - 1
        if self.kind(k) == "other" and self.word(k) in "\"'":  # a quote that was never opened
            k -= 1
        if self.word(i) == "=" and self.kind(k) == "name" and self.word(k - 1) == ":" and self.kind(k - 2) == "name":
            k -= 2  # with its type
        if self.kind(k) in ("name", "ref"):
            return self.word(k)
        if self.kind(k) == "string":
            prefix, quotes = _open_quote(self.word(k))
            key = self.word(k)[prefix + quotes : -quotes]
            return key if _KEY.match(key) else None
        keys = []
        while self.word(k) == "]" and k in self.match and k - self.match[k] == 2:
            inner = self.word(k - 1)
            keys.append(inner.strip("\"'`"))
            k = self.match[k] - 1
        if keys and self.kind(k) in ("name", "ref"):
            return ".".join([self.word(k), *reversed(keys)])
        return None

    def value(self, at: int) -> tuple[Literal, int]:
        """The Literal of the value at a place, and where it ends."""
        out = Literal()
        if self.text[at : at + 1] and (m := _BLOCK.match(self.text, at)):
            return self._block(m.end(), self.indent(at), out)
        m = _VALUE.match(self.flat, at)
        if not m:
            return out, at
        terms = self._terms(m[1], m.start(1))
        for term, a, b in terms:
            bound = self.scopes.get(term.strip("${}")) if term[0] == "$" else None
            if term[0] == "$":
                if bound is not None:
                    out.add(bound)
            elif term[-1] in "\"'`":
                self._quoted(term, a, b, out)
            elif _IDENT.match(term) and (bound := self.scopes.get(term)) is not None:
                out.add(bound)
            elif len(terms) == 1 and self.flat[m.end() : m.end() + 1] not in ("(", "[") and not _NAME_ONLY.match(term):
                out.counts.update(term)
                out.parts.append((a, b))
        return out, m.end()

    def _quoted(self, term: str, a: int, b: int, out: Literal) -> None:
        """A string's own characters, and what the names within it refer to."""
        prefix, quotes = _open_quote(term)
        body, first = term[prefix + quotes : -quotes], a + prefix + quotes
        formats, shell = "f" in term[:prefix].lower(), term[prefix] in "\"`"
        at, own = 0, []
        for m in _INNER.finditer(body) if formats or shell and "$" in body else ():
            name = m[1] or m[2] or m[3]
            if (formats if m[3] else shell) and name in self.scopes:
                own.append((at, m.start()))
                out.add(self.scopes.get(name))
                at = m.end()
        for s, e in [*own, (at, len(body))]:
            if e > s or not own:
                out.counts.update(body[s:e])
                out.parts.append((first + s, first + e))

    def _block(self, at: int, indent: int, out: Literal) -> tuple[Literal, int]:
        """The lines of a YAML block that are indented more than its key."""
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end]
            bare = line.strip()
            if bare:
                if len(line) - len(line.lstrip(" ")) <= indent:
                    break
                first = at + line.index(bare)
                out.counts.update(bare)
                out.parts.append((first, first + len(bare)))
            at = end + 1
        return out, at

    def _terms(self, body: str, base: int) -> list[tuple[str, int, int]]:
        """(term, start, end) of joined terms: + joins, but within a base64 literal it is a digit. A run of bare
        words is such a literal if it looks like one and holds no bound name of three characters (or only bound names)."""
        out = []
        for t in _RUN.finditer(body):
            run, at = t[0], t.start()
            if run[0] == "$" or run[-1] in "\"'`":
                out.append((run, base + at, base + t.end()))
                continue
            if at:
                run = run.lstrip("+")
                at = t.end() - len(run)
            if t.end() < len(body):
                run = run.rstrip("+")
            if not run.strip("."):
                continue
            parts = run.split("+")
            names = [x in self.scopes for x in parts]
            if _BASE64.match(run) and not all(names) and not any(k and len(x) > 2 for k, x in zip(names, parts, strict=True)):
                out.append((run, base + at, base + at + len(run)))
                continue
            for x in parts:
                if x:
                    out.append((x, base + at, base + at + len(x)))
                at += len(x) + 1
        return out

    def _parameters(self, opened: int, closed: int) -> list[str]:
        """Names between two parentheses that stand before a comma, an equals sign, a colon, the end or a type."""
        out = []
        for k in range(opened + 1, closed):
            if self.kind(k) == "name" and (self.word(k + 1) in (",", "=", ":", ")") or self.kind(k + 1) == "name") and self.word(k - 1) not in ("=", ":"):
                out.append(self.word(k))
            elif self.kind(k) == "ref":
                out += [self.word(k), self.word(k).strip("${}")]
        return out

    def _function(self, i: int) -> list[str] | None:
        """The parameters of the function whose body the brace or colon at token i opens, None if it opens none."""
        k = i - 1
        for _ in range(4):  # a result type may stand between
            if self.word(k) == ")" or k < 0:
                break
            k -= 1
        if self.word(k) != ")" or k not in self.match:
            return None
        opened = self.match[k]
        before, earlier = self.word(opened - 1), self.word(opened - 2)
        if self.word(i) == ":":
            return self._parameters(opened, k) if earlier in FUNCTIONS else None
        if self.word(i - 1) == "=>" or self.kind(opened - 1) == "name" and before not in BLOCKS:
            return self._parameters(opened, k)
        return None

    def assignments(self) -> Iterator[tuple[str, Literal]]:
        depth, fresh = 0, True
        for i, (kind, a, b) in enumerate(self.tokens):
            if kind == "line":
                fresh = True
                continue
            if fresh and not self.inside[i]:
                self.scopes.pop("indent", self.indent(a) if a else 0)
            fresh = False
            if kind == "open" and self.text[a] == "{":
                depth += 1
                if (names := self._function(i)) is not None:
                    self.scopes.push("brace", depth, names)
            elif kind == "close" and self.text[a] == "}":
                self.scopes.pop("brace", depth)
                depth = max(0, depth - 1)
            elif kind == "op" and self.text[a:b] in ASSIGNS:
                if self.text[a:b] == ":" and (names := self._function(i)) is not None:
                    first = bisect_left(self.starts, self.text.rfind("\n", 0, self.tokens[self.match[self._closing(i)]][1]) + 1)
                    self.scopes.push("indent", self.indent(self.tokens[first][1]) + 1, names)
                    continue
                yield from self._assigned(i)
        for m in _XML.finditer(self.text):
            value = Literal()
            value.counts.update(m[2])
            value.parts.append((m.start(2), m.end(2)))
            yield m[1], value

    def _closing(self, i: int) -> int:
        k = i - 1
        while self.word(k) != ")":
            k -= 1
        return k

    def _assigned(self, i: int) -> Iterator[tuple[str, Literal]]:
        """What the operator at token i assigns; several names on the left take the values on the right in turn."""
        name = self.target(i)
        if name is None:
            return
        op, names, k = self.word(i), [name], i - 1
        while op in ("=", ":=") and self.kind(k) == "name" and self.word(k - 1) == "," and self.kind(k - 2) == "name" and not self.inside[k]:
            k -= 2
            names.insert(0, self.word(k))
        at, found = self.tokens[i][2], []
        for _ in names:
            value, at = self.value(at)
            found.append(value)
            gap = re.compile(r"[ \t]*,").match(self.flat, at)
            if not gap:
                break
            at = gap.end()
        if len(found) < len(names):  # one value for all
            found, names = found[:1], names[-1:]
        for n, value in zip(names, found, strict=True):
            if op == "+=" and (before := self.scopes.get(n)) is not None:
                whole = Literal()
                whole.add(before)
                whole.add(value)
                value = whole
            self.scopes.bind(n, value)
            if n[0] == "$":
                self.scopes.bind(n[1:], value)
            yield n, value
