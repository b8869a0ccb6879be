"""Literals that reach sensitive names: formats, lines, scopes; spans against an interpreter of a small grammar."""

import random

import pytest
from spindrift.llm import secrets

S = "q9Zx7Lk2Wm4R"
FOUND = [
    'cfg["password"] = "%s"', "cfg['db']['password'] = '%s'", "A=%s ; export DB_PASSWORD=$A", 'A=%s\nexport DB_PASSWORD="${A}"', 'A=%s\nexport DB_PASSWORD="$A"', 'a = "%s"\npassword = f"{a}"', 'a = "%s"\npassword = f"x{a!r:>5}"',
    'secret = ("%s"\n   "tail")', 'secret = (\n    "%s")', 'secret = ("head"\n\n   "%s"\n)', 'token = \\\n  "%s"', 'token = "ab" + \\\n  "%s"', 'token = "ab" +\n  "%s"', 'token = "ab"\n  + "%s"', '{"password":\n   "%s"}', '"password": "%s"',
    "password: |\n  %s\nnext: 1", "a:\n  password: >-\n    %s\n  next: 1", "- password: %s", "<config><password>%s</password></config>", '<password type="x">\n  %s\n</password>', '<db password="%s"/>', 'password = """%s"""', "password = '''\n%s'''",
    'user, password = "bob", "%s"', 'a, b = "%s", "x"\npassword = a', '$password = "ab" . "%s";', '$a = "%s";\n$password = $a . "x";', 'password: str = "%s"', 'const password: string = "%s";', 'x = "%s"\ndef g():\n    password = x\n',
    "it's a password = '%s' isn't it", "password = r'%s'", "let t = `%s`; const token = `${t}`;", "db:\n  auth:\n    password: %s\n", "[db]\npassword=%s", 'def g(password="%s"):\n  pass', 'args.password = "%s"', "config = {'db': {'password': '%s'}}",
    'password => "%s"', 'password := "%s"', 'self.api_key="%s"', 'if x:\n    a = "%s"\n    password = a', 'for (;;) { a = "%s"; password = a; }', 'function f() { var x = "%s"; password = x; }', 'x = "%s"\nfunction f() { y = 1; }\npassword = x',
    'password = secret = "%s"', 'local password = "a" .. "%s"',
]
NOT_FOUND = [
    'def f():\n    x = "%s"\n\ndef g(x):\n    password = x\n', 'def f():\n    x = "%s"\n\ndef g():\n    password = x\n', 'function f() { var x = "%s"; }\nfunction g(x) { password = x; }', 'x = "%s"\ndef g(x):\n    password = x\n',
    'x = "%s"\nfunction g(x) { password = x; }', 'x = "%s"\nconst g = (x) => { password = x; }', 'x = "%s"\nint g(int x) { password = x; }', 'x = "%s"\nfunc g(x string) string { password = x }', 'title = "%s"', 'password = getenv("%s")', "password: |\n  short\ntitle: %s",
    "<title>%s</title>", 'user, password = "%s", other', 'a = "%s"\npassword = "{a}"', "a = '%s'\npassword = '$a'", 'x = "%s"\nx = other\npassword = x', 'password == "%s"', 'password != "%s"',
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    text = text % S
    assert S in "".join(text[a:b] for a, b in secrets.flow_spans(text))


@pytest.mark.parametrize("text", NOT_FOUND)
def test_not_found(text):
    text = text % S
    assert S not in "".join(text[a:b] for a, b in secrets.flow_spans(text))


def program(rnd):
    """A random program of assignments and functions, and the spans that an interpreter of its grammar reports."""
    names, out, size, spans, scopes = ["a", "b", "c", "password", "api_key", "colour"], [], 0, set(), [{}]

    def emit(s):
        nonlocal size
        out.append(s)
        size += len(s)

    def literal():
        value = "".join(rnd.choice("abXY12qZ9k") for _ in range(rnd.randint(1, 9)))
        emit('"')
        at = size
        emit(value)
        emit('"')
        return value, frozenset([(at, at + len(value))])

    def lookup(name):
        for s in reversed(scopes):
            if name in s:
                return s[name]
        return None

    def statement(indent):
        name, op = rnd.choice(names), rnd.choice(["=", "=", "+="])
        emit(" " * indent + name + rnd.choice([" ", ""]) + op + " ")
        value, found = "", frozenset()
        if op == "+=" and (before := lookup(name)):
            value, found = before
        wrapped = rnd.random() < 0.3
        if wrapped:
            emit("(")
        for k in range(rnd.randint(1, 3)):
            if k:
                emit(rnd.choice([" + ", "+", " +\n  "]) if wrapped else rnd.choice([" + ", "+"]))
            if rnd.random() < 0.5:
                v, f = literal()
            else:
                ref = rnd.choice(names[:5])
                emit(ref)
                v, f = lookup(ref) or ("", frozenset())
            value, found = value + v, found | f
        if wrapped:
            emit(")")
        emit("\n")
        scopes[-1][name] = (value, found)
        score = secrets.name_score(name)
        if score >= 0.5 and score * secrets.literal_score(value) >= 0.75**2:
            spans.update(found)

    for _ in range(rnd.randint(1, 5)):
        if rnd.random() < 0.4:
            given = rnd.sample(names[:3], rnd.randint(0, 2))
            emit(f"def f({', '.join(given)}):\n")
            scopes.append(dict.fromkeys(given))
            for _ in range(rnd.randint(1, 4)):
                statement(4)
            scopes.pop()
        else:
            for _ in range(rnd.randint(1, 4)):
                statement(0)
    return "".join(out), spans


def test_against_an_interpreter():
    rnd, found = random.Random(11), 0
    for _ in range(1500):
        text, want = program(rnd)
        assert secrets.flow_spans(text) == sorted(want), text
        found += len(want)
    assert found > 500


def test_texts_without_hints_have_no_targets():
    rnd = random.Random(2)
    parts = [*secrets.SENSITIVE, "user", "name", "x"]
    for _ in range(3000):
        name = "_".join(rnd.sample(parts, rnd.randint(1, 3)))
        if secrets.name_score(name) >= 0.5:
            assert secrets.may_assign(f"{name} = 1") and secrets.may_assign(f"<{name.upper()}>x</{name.upper()}>")


@pytest.mark.parametrize("text", ["password = (" * 2000, '"' * 5001 + "password=1", "password[" * 3000 + "=", "}" * 3000 + "{" * 3000 + "password: " + S, "a = b + " * 4000 + "\npassword = a", "password: |\n" + "  x\n" * 5000, "password = '''" + "x\n" * 20_000])
def test_odd_texts_end_soon(text):
    import time

    t = time.perf_counter()
    secrets.flow_spans(text)
    assert time.perf_counter() - t < 5


def test_spans_of_texts_with_other_characters():
    text = f'é = "ü"\npässword = 1\npassword = "{S}é"'
    assert [text[a:b] for a, b in secrets.flow_spans(text)] == [f"{S}é"]
