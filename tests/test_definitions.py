"""Block structure and definitions of brace languages, notebooks."""

import json
import random

import numpy as np

from groundwork.functions import braces
from groundwork.operators import codejobs


def plain_depths(text):
    """Brace depth before every character, one character after the other."""
    depth, i, mode, out = 0, 0, None, []
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        out.append(depth)
        if mode == "//":
            mode = None if c == "\n" else mode
        elif mode == "/*":
            if two == "*/":
                out.append(depth)
                i += 1
                mode = None
        elif mode:
            if c == "\\" and i + 1 < len(text) and (mode == "`" or text[i + 1] != "\n"):
                out.append(depth)
                i += 1
            elif c == mode or (c == "\n" and mode != "`"):
                mode = None
        elif two in ("//", "/*"):
            mode = two
            out.append(depth)
            i += 1
        elif c in "\"'`":
            mode = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
        i += 1
    return out


def test_depths_equal_a_walk_over_characters():
    rng = random.Random(3)
    texts = ["".join(rng.choice("{}{}\"'`/*\\\n\n a/;é") for _ in range(rng.randint(0, 400))) for _ in range(400)] + ["", "\n", "}}}{", "/" * 200, "/*" + "{" * 100 + "*/{"]
    for text, b in zip(texts, braces.blocks(texts), strict=True):
        at = plain_depths(text)
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        assert b.depth == [(at[s] if s < len(at) else None) for s in starts[: len(b.lines)]], text
    data = np.frombuffer("\0".join(t.replace("é", "e") for t in texts).encode(), np.uint8)
    slow, state = [], braces.CODE
    for c in data.tolist():
        slow.append(state)
        state = braces.NEXT[state, braces._CLASS[c]]
    assert braces.states(data).tolist() == slow  # composed pieces and one step after the other


def test_block_ends():
    text = "f() {\n  if (x) { y(\"}\") }\n}\ng()\n{\n  // }\n}\nh();\nclass A { }\n}\nopen {\n"
    b = braces.blocks([text])[0]
    assert (b.end(0), b.end(1), b.end(3), b.end(7), b.end(8), b.end(10)) == (2, 1, 6, 7, 8, 10)
    assert braces.blocks(["a\r\n{\r\n}\r\n"])[0].end(0) == 2


def symbols(spark, files):
    df = spark.createDataFrame([("acme/x", p, t) for p, t in files], "repo string, path string, text string")
    return {(r.path, r.qualified, r.start_line): r for r in codejobs.extract_symbols(df).collect()}


def test_every_language_of_the_list(spark):
    js = "export default class Cart extends Base {\n  #secret = 1;\n  constructor(a) {\n    super(a);\n  }\n  static async load(id) { return get(id); }\n  if (x) { }\n}\n\n// doubles\nconst twice = x => {\n  return mul(x, 2);\n};\nfunction* walk(t) {\n  yield t;\n}\n"
    java = "import a.B;\nclass Out {\n  interface In { void go(); }\n  Out() { start(); }\n  private <T> List<T> all(Map<String, T> m) throws E\n  {\n    return new ArrayList<>(m.values());\n  }\n  int x = f(1);\n}\nenum Color { RED }\n"
    cs = "namespace A.B;\npublic class P\n{\n    public P(int a) : base(a) { }\n    [Fact]\n    public int Sum(int a) => Add(a, 1);\n    public struct S { }\n}\n"
    go = 'package main\nimport "fmt"\ntype I interface {\n\tM()\n}\nfunc main() {\n\tfmt.Println("}")\n}\n'
    got = symbols(spark, [("a/x.jsx", js), ("a/X.java", java), ("a/P.cs", cs), ("cmd/m.go", go), ("b/y.mjs", "export function f() {}\n"), ("b/z.cjs", "module.exports = 1\n"), ("n.txt", "x"), ("b/e.ts", ""), ("b/none.java", None)])
    lines = lambda p: {q: (s, r.end_line, r.kind) for (path, q, s), r in got.items() if path == p}
    assert lines("a/x.jsx") == {"a.x": (1, 16, "module"), "a.x.Cart": (1, 1, "class"), "a.x.Cart.constructor": (3, 5, "method"), "a.x.Cart.load": (6, 6, "method"), "a.x.twice": (11, 13, "function"), "a.x.walk": (14, 16, "function")}
    assert got["a/x.jsx", "a.x.twice", 11].docstring == "doubles" and got["a/x.jsx", "a.x.twice", 11].calls == ["mul"] and got["a/x.jsx", "a.x.Cart.load", 6].decorators == ["static", "async"]
    assert lines("a/X.java") == {"a.X": (1, 11, "module"), "a.X.Out": (2, 2, "class"), "a.X.Out.In": (3, 3, "class"), "a.X.Out.Out": (4, 4, "method"), "a.X.Out.all": (5, 8, "method"), "a.X.Color": (11, 11, "class")}
    assert got["a/X.java", "a.X", 1].imports == ["a.B"]
    assert lines("a/P.cs") == {"a.P": (1, 8, "module"), "A.B.P": (2, 2, "class"), "A.B.P.P": (4, 4, "method"), "A.B.P.Sum": (6, 6, "method"), "A.B.P.S": (7, 7, "class")}
    assert got["a/P.cs", "A.B.P.Sum", 6].decorators == ["[Fact]", "public"]
    assert lines("cmd/m.go") == {"cmd.m": (1, 8, "module"), "main.I": (3, 5, "class"), "main.main": (6, 8, "function")}
    assert lines("b/y.mjs")["b.y.f"] == (1, 1, "function") and lines("b/e.ts") == {"b.e": (1, 1, "module")} and lines("b/none.java") == {"b.none": (1, 1, "module")} and not lines("n.txt")


def test_notebooks_and_python_decorators(spark):
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": "# T"}, {"cell_type": "code", "source": ["import os\n", "!ls\n", "run(1)"]}, {"cell_type": "code", "source": "def ("}]})
    got = symbols(spark, [("n/a.ipynb", nb), ("n/bad.ipynb", "{"), ("p.py", "@cache\ndef f():\n    return g()\n")])
    one = got["n/a.ipynb", "n.a.cell-2", 3]
    assert (one.kind, one.end_line, one.docstring, one.calls, one.imports, one.signature) == ("cell", 5, "# T", ["run"], ["os"], "code cell 2")
    assert ("n/a.ipynb", "n.a.cell-3", 7) in got and not [k for k in got if k[0] == "n/bad.ipynb"]
    assert got["p.py", "p.f", 2].decorators == ["cache"]
