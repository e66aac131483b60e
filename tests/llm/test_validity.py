import ast
import json
import time

import pytest

from millrace.llm import languages
from millrace.llm.gll import Grammar, Kinds
from millrace.llm.languages import cryptol, dialects, json_value, python_module, sawscript
from millrace.llm.validity import checked, rates


def test_gll_takes_any_context_free_grammar():
    k = Kinds()
    g = Grammar("s: s s s | s s | 'b'\np: 'a' p 'a' | 'b' p 'b' | e\ne:\nl: l ',' 'a' | 'a'\nw: <x> 'a' u | <y> 'b' u\nu: 'c'+ 'd'?", ("x", "y"), k)
    kinds = lambda t: "".join(k[c] for c in t)
    both = {"x", "y"}
    assert g.accepts("s", kinds("b" * 20)) == both and not g.accepts("s", "")
    assert g.accepts("p", kinds("abba")) == both and not g.accepts("p", kinds("aba")) and g.accepts("p", "") == both
    assert g.accepts("l", kinds("a,a,a")) == both and not g.accepts("l", kinds("a,"))
    assert g.accepts("w", kinds("acc")) == {"x"} and g.accepts("w", kinds("bcd")) == {"y"} and not g.accepts("w", kinds("b"))


PYTHON = [
    "", "\n\n", "# only\n", "x = 1", "x: int = 3\n", "a, *b = c = d\n", "x += yield\n", "f(a, *b, c=1, **d)\n", "f(x for x in y if x)\n", "f(a=1, b)\n", "f(**a, b)\n", "print 'x'\n", "def f(a, /, b, *, c=1, **k) -> int: return a\n",
    "def f(a=1, b): pass\n", "lambda a, *b, c=1: a\n", "if x:\n  y\nelif z:\n  pass\nelse: w\n", "if x:\ny\n", "if x:\n    y\n  z\n", "try:\n pass\nexcept (A, B) as e:\n pass\nelse:\n pass\nfinally:\n pass\n", "try:\n pass\n",
    "with a as b, c: pass\n", "with (a as b, c as d,):\n pass\n", "@a.b(c)\n@d\nclass X(Y, z=1):\n  '''doc'''\n  x = 1\n\n  def f(self):\n    return self.x[1:2, ...]\n", "@a\nx = 1\n", "async def f():\n  async with a: await b\n  async for x in y: pass\n",
    "x = [i for i in range(3) for j in i if j]\n", "x = {**a, 'b': 1}\n", "x = {a: b for a, b in c}\n", "x = {1, 2, *c}\n", "x = (yield)\n", "from . import (a, b as c,)\n", "from a import *\n", "import a.b as c, d\n", "global x, y\n", "del a, (b, c[1]), d.e\n",
    "del f()\n", "f() = 1\n", "1 = x\n", "a + b = c\n", "(a) = 1\n", "[a, b.c] = d\n", "x = y := 3\n", "if (y := 3): pass\n", "match x:\n  case [1, *_] if y: pass\n  case {'a': B(c=1)}:\n    z\n  case _: pass\n", "match = case = type = 1\nmatch(x)\nprint(type)\n",
    "type X[T: int] = list[T]\n", "def f[T](x: T): pass\n", "x = f'{a!r:>{w}} {{b}} {c=}'\n", "x = f'{a b}'\n", "x = f'{}'\n", "x = 'a' b'c'\n", "x = 0x1f + 0b1 + 1_000 + 1e5j + .5\n", "x = 012\n", "x = 1a\n", "x = 'open\n", 'x = """a\nb"""\n', 'x = """a\n', "x = (1,\n  2\n)\n", "x = (1,\n",
    "x = 1)\n", "x = a if b else c\n", "x = not a in b is not c\n", "x = a == not b\n", "x ==\n", "x = \\\n  1\n", "x = 1 \\ 2\n", "x = a ? b : c\n", "\tx = 1\n", "if x:\n\ty\n        z\n", "for x, in y: pass\nelse: pass\n", "while True: break; continue;\n", "x = *a, b\n", "x = *a\n", "print(*a, sep='')\n",
    "raise A from b\n", "assert a, 'b'\n", "return\n", "nonlocal x\n", "class A: x: int; y = 2\n", "x = a[b, c:d:e, ::]\n", "x = “y”\n", "<<<<<<< HEAD\nx = 1\n", "x = 1;\ny = 2\n", "x = 1;; y\n", "lambda: (yield)\n", "except*: pass\n", "try:\n pass\nexcept* A:\n pass\n", "a = b'é'\n", "x = r'\\'\n", "def f(*): pass\n", "def f(*, a): pass\n", "def f(a, a2=1, /, b=2, *c, d, e=3): pass\n",
    "if x: pass\nelse:\n", "class X:\n  def f(self):\n    pass\n x = 1\n", "x = {'a': 1, **b, 'c'}\n", "x = [*a for a in b]\n", "f(a for a in b, c)\n", "f(a for a in b)\n", "import a.b.\n", "from . import\n",
]


#: Formatted strings, escapes and what only some versions know.
PYTHON += [
    'x = f"{d["a"]} {f"{e!r:>{w}}"}"\n', "f\"{x:{'a'}}\"\n", 'f"{x!}"\n', 'f"{x!r}"\n', 'f"{x=!s:5}"\n', "f'{a:=5}'\n", "f'{lambda x: 1}'\n", "f'{(lambda x: 1)}'\n", "f'{*a, b}'\n", 'f"{a}}"\n', 'f"{a"\n',
    'rf"\\{a}\\""\n', "f'''{\n a # b\n}'''\n", "f'\\N{DIGIT ONE}{a}'\n", "f'\\N{foo}'\n", "'\\N{foo}'\n", "'\\xZZ'\n", "b'\\x1'\n", "b'\\u12'\n", "'\\U00110000'\n", "r'\\xZZ'\n",
    "def f class class(): pass\n", "class A class class: pass\n", "def f(*a: *T): pass\n", "match x:\n  case {-0-0j: y}: pass\n", "हिन्दी = 1\n", "a\u2019b = 1\n", "class A:\n  @d\n  def f(self): pass\n  @e\n  class B: pass\n", "x = [\n# open\n1,\n]\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_against_the_language_itself(text):
    try:
        ast.parse(text)
        want = True
    except SyntaxError:
        want = False
    assert bool(python_module(text)) == want


JSON = ["1", "-0.5e+3", "01", "1.", "\"a\\u00e9\\n\"", "\"a\nb\"", "\"\\x\"", "[]", "[1, 2, 3, 4, 5]", "[1, 2,]", "{\"a\": [{}, {\"b\": null}]}", "{\"a\" 1}", "{1: 2}", "{\"a\": 1, \"b\": 2, \"c\": 3, \"d\"}", "true false", "[1] ", "\n{}\n", "tru", "[[1], [2]", "]", "// c\n1", "'a'", "{\"a\": 1, \"a\": 2}", "[1 2]"]


@pytest.mark.parametrize("text", JSON)
def test_json_against_the_library(text):
    try:
        json.loads(text)
        want = True
    except ValueError:
        want = False
    assert bool(json_value(text)) == want


CRYPTOL_GOOD = [
    "x : [8]\nx = 3\n", "module A::B where\n\nimport C (f, g)\nimport D as E hiding (h)\n\ntype T n = [n][8]\nf : {n, a} (fin n, n >= 1) => [n]a -> a\nf xs = xs ! 0\n", "f x = y where\n  y = x + 1\n  z = y\n", "f x = if x == 1 then 2 | x == 2 then 3 else 4\n",
    "xs = [ x + y | x <- [0 .. 9] | y <- xs' ]\n  where xs' = [1, 3 ...]\n", "g = \\(a, b) -> { p = a, q = b }.p\n", "h r = { r | p = 1 }\n", "n = `(2 ^^ 8) + `{a = 3} : Integer\n", "(+++) : [8] -> [8] -> [8]\n(+++) a b = a # b\ninfixl 5 +++\na ** b = a\n",
    "property p x = x == x\n", "newtype N a = { v : a }\n", "enum E a = A a | B\nf e = case e of\n  A x -> x\n  B -> zero\n", "/* a /* nested */ ( */ x = '\\'' // ] \n", "x = [ '[', '\"', '{', 'b' ]\n", "x = <| x^^4 + x + 1 |>\n", "private\n  x = 1\n  y = 2\nz = 3\n", "x = 0x1f_ff + 0b10.1 - -3\n", "primitive type fin : # -> Prop\nprimitive random : {a} [256] -> a\n",
    "parameter\n  type n : #\n  type constraint (fin n)\n  k : [n]\n", "submodule M where\n  x = 1\ny = 2\n", "f (x : [8]) [a, b] _ = a\n", "x = (f, g).0 @ 3\n", "f x | x > 1 => 3\n    | x <= 1 => 4\n", "interface module I where\n  type n : #\n", "module X = Y { Z }\n", "", "// only a note\n",
]
CRYPTOL_BAD = [
    "x = case case case\n", "x = 1\n y = 2\nz = (\n", "module A where\n  x = 1\n y = 2\n", "f x = y where\n  y = x\n  z = ]\n",
    "x = [1, 2\n", "x = (1]\n", "f x =\n", "type = [16]\n", "f x = x where where\n", "f : [8] -> -> [8]\n", "f x = if x then 1\n", "<<<<<<< HEAD\nx = 1\n", "x = 1\n=======\ny = 2\n", "x = “a”\n", "/* open\nx = 1\n", "x = \"open\n", "import \"a.cry\";\n", "def f(x):\n    return x\n", "module A where\nx = 1 2 =\n", "f x (x + 1)\n", "let x = 1\n", "x = 1;\n", "  x = 1\ny = 2\n",
]


@pytest.mark.parametrize("text", CRYPTOL_GOOD)
def test_cryptol_files(text):
    assert cryptol(text)


@pytest.mark.parametrize("text", CRYPTOL_BAD)
def test_not_cryptol(text):
    assert not cryptol(text)


SAW_GOOD = [
    "let f =\ng x;\n", "x <-\n  f a\n    b\n  (do {\n  c;\n});\n", "print (f\na\nb);\n", "let f x =\n  if x\n  then y\n  else z;\n", "let f x = y\nand g = z;\n",
    "import \"a.cry\";\ninclude \"b.saw\";\n", "let f x y = unfold_term [\"a\", \"b\"] x;\n", "m <- llvm_load_module \"a.bc\";\nlet s = do { x <- fresh \"x\" (llvm_int 8); llvm_return (llvm_term {{ f x }}); };\n", "let {{ f x = x + 1 }};\n", "(a, b) <- f (do { abc; });\n", "let t = {{ g [ '}', '\\\\', ')' ] }}; // it's (\n", "rec f x = if x then f y else z;\n", "print (show (f 1).a);\n", "let f (x : Int) : Term = x;\n", "typedef T = [Int];\n", "let f = \\x -> x;\n", "/* ; */",
]
SAW_BAD = [
    "let x = {{ f }}\nprint \"a\";\n", "x <- f a b\ny <- g;\n", "let f = do {\n  a b\n  c d;\n};\n", "let = x;\n", "x <- ;\n", "print \"a\"\n", "x <- f \"a\"\nlet y = 1;\n", "let f = do { a };\n", "print “a”;\n", "let x = {{ f ( }};\n", "let x = {{ f };\n", "f : [8] -> [8]\nf x = x\n", "let x = (1;\n", "=======\n", "print \"a;\n"]


@pytest.mark.parametrize("text", SAW_GOOD)
def test_sawscript_files(text):
    assert sawscript(text)


@pytest.mark.parametrize("text", SAW_BAD)
def test_not_sawscript(text):
    assert not sawscript(text)


def seconds(check, text):
    start = time.thread_time()
    check(text)
    return time.thread_time() - start


@pytest.mark.parametrize(
    "check, line",
    [
        (python_module, "x{} = f(a, [1, {}], b=c.d) if y else f'{{z}}'\n"),
        (cryptol, "f{} x = if x == {} then [ y + 1 | y <- x ] else (x, 2)\n"),
        (sawscript, 'let f{} x = g (h "a") [{}, 2] {{{{ x + 1 }}}};\n'),
    ],
)
def test_time_is_linear(check, line):
    small, large = ("".join(line.format(k, k) for k in range(n)) for n in (400, 3200))
    assert check(small)
    few, many = (min(seconds(check, t) for _ in range(3)) for t in (small, large))
    assert many < 24 * few + 0.2


def forget():
    for g in (languages.PYTHON, languages.CRYPTOL, languages.SAWSCRIPT, languages.JSON):
        g.known.clear()
        for single in g.single.values():
            single.clear()


def test_what_is_kept_decides_nothing(monkeypatch):
    cases = [(python_module, t) for t in PYTHON] + [(cryptol, t) for t in CRYPTOL_GOOD + CRYPTOL_BAD] + [(sawscript, t) for t in SAW_GOOD + SAW_BAD] + [(json_value, t) for t in JSON]
    want = [bool(f(t)) for f, t in cases]
    monkeypatch.setattr("millrace.llm.gll._LONGEST", 0)
    monkeypatch.setattr(Grammar, "_is_single", lambda self, entry, pair, single: False)
    forget()
    assert [bool(f(t)) for f, t in cases] == want
    forget()


def test_deep_nesting():
    assert json_value("[" * 500 + "]" * 500) and not json_value("[" * 5000) and json_value("[" * 5000 + "]" * 5000)
    assert python_module("x = " + "(" * 150 + "1" + ")" * 150 + "\n") and not cryptol("x = (" * 3000)


def test_memory_is_bounded():
    g = Grammar("s: t*\nt: 'a' 'b'* 'c'", ("d",), Kinds(), kept={"t": 0}, memory=5000)
    a, b, c = (g.kinds[x] for x in "abc")
    for n in range(1, 60):
        chunk = a + b * n + c
        assert g.accepts("s", chunk * 2, [len(chunk)] + [0] * (len(chunk) - 1) + [2 * len(chunk)] + [0] * len(chunk))
        assert 0 < g.used < 6000


def test_rows_and_rates(spark):
    rows = [(1, ".PY ", "x = 1", "a"), (2, "Py", "x =", "a"), (2, "py", "x =", "a"), (3, "json", None, "a"), (4, "json", " \n\t", "b"), (5, "txt", "x =", "b"), (6, None, "x", "b"), (7, "saw", "\ufeffprint \"a\";", None), (8, " cry", "x = (" * 3000, None)]
    df = spark.createDataFrame([(i, f, t, r, "z") for i, f, t, r in rows], "id bigint, filetype string, content string, repo string, accepted_by string")
    out = {r["id"]: r["accepted_by"] for r in checked(df).collect()}
    assert set(out) == {1, 2, 7, 8} and out[1] == ["3.13", "3.8"] and out[2] == [] and out[7] and not out[8]
    shares = {r["repo"]: r["invalid_share"] for r in rates(checked(df).join(df.select("id", "repo").distinct(), "id"), ["repo"]).collect()}
    assert shares == {"a": 0.5, None: 0.5}
    assert checked(df.limit(0)).count() == 0 and dialects("json", "\ufeff{}")
