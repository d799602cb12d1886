"""Definitions in brace languages and notebooks, from block structure and one pattern per kind of line."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.braces import Blocks

# What a definition line looks like, words that are no names, comment and import forms.
_JS_MODS = r"(?P<mods>(?:(?:export|default|abstract|declare|async)\s+)*)"
_JAVA_MODS = r"(?P<mods>(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*)"
_CS_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|unsafe|new|partial|readonly|volatile)\s+)*)"
_ARGS = r"\((?P<params>[^)]*)\)"
KEYWORDS = frozenset(
    (
        "if for while switch catch return function new typeof throw else do try await yield delete void instanceof super case with synchronized sizeof lock using fixed foreach select go "
        "defer range chan func import package class interface struct enum namespace export default const let var async"
    ).split()
)
CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")


@dataclass(frozen=True)
class Grammar:
    """Patterns of one language. ``types`` hold members, ``members`` are looked for inside of types, ``free`` outside."""

    types: re.Pattern
    members: tuple[re.Pattern, ...] = ()
    free: tuple[re.Pattern, ...] = ()
    annotation: re.Pattern = re.compile(r"^@\w")
    nested: bool = False  # types inside types
    whole: tuple[str, ...] = ()  # kinds of type whose record covers their block, not only the header
    package: re.Pattern | None = None
    imports: tuple[re.Pattern, ...] = ()


_JS = Grammar(
    types=re.compile(rf"^{_JS_MODS}(?P<word>class|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^{{]*)"),
    members=(re.compile(r"^(?P<mods>(?:(?:static|async|public|private|protected|readonly|get|set|override|abstract)\s+)*)\*?\s*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\s*" + _ARGS + r"\s*(?::\s*[^{;]+)?\s*[{;]"),),
    free=(
        re.compile(rf"^{_JS_MODS}function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*{_ARGS}"),
        re.compile(rf"^{_JS_MODS}(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+?)?=\s*(?:async\s+)?(?:function\b\s*\*?\s*{_ARGS}|(?:\((?P<params2>[^)]*)\)|(?P<params3>[A-Za-z_$][\w$]*))\s*(?::\s*[^=]+?)?\s*=>)"),
    ),
    whole=("interface", "enum"), imports=(re.compile(r"""^\s*import\s+(?:[^'"]*\s+from\s+)?['"]([^'"]+)['"]"""), re.compile(r"""require\(\s*['"]([^'"]+)['"]\s*\)""")),
)
GRAMMARS = {
    "javascript": _JS, "typescript": _JS,
    "java": Grammar(
        types=re.compile(rf"^{_JAVA_MODS}(?P<word>class|interface|enum|record|@interface)\s+(?P<name>\w+)"),
        members=(
            re.compile(rf"^{_JAVA_MODS}(?P<ctor>[A-Z]\w*)\s*{_ARGS}\s*(?:throws\s+[\w., ]+)?\s*(?:\{{.*)?\s*$"),
            re.compile(rf"^{_JAVA_MODS}(?:<[^>]+>\s+)?(?P<ret>[\w$][\w$<>\[\],.?\s]*?)\s+(?P<name>\w+)\s*{_ARGS}\s*(?:throws\s+[\w., ]+)?\s*(?:\{{.*|;)?\s*$"),
        ),
        nested=True, package=re.compile(r"^\s*package\s+([\w.]+)\s*;"), imports=(re.compile(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),),
    ),
    "csharp": Grammar(
        types=re.compile(rf"^{_CS_MODS}(?P<word>class|struct|interface|enum|record(?:\s+(?:struct|class))?)\s+(?P<name>\w+)"),
        members=(
            re.compile(rf"^{_CS_MODS}(?P<ctor>[A-Z]\w*)\s*{_ARGS}\s*(?::\s*(?:base|this)\([^)]*\)\s*)?(?:\{{.*)?\s*$"),
            re.compile(rf"^{_CS_MODS}(?P<ret>[\w$][\w$<>\[\],.?()\s]*?)\s+(?P<name>\w+)\s*(?:<[^>]+>)?\s*{_ARGS}\s*(?:where\s+[^{{;=]+)?\s*(?:\{{.*|=>.*|;)?\s*$"),
        ),
        annotation=re.compile(r"^\[\w"), nested=True, package=re.compile(r"^\s*namespace\s+([\w.]+)"), imports=(re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),),
    ),
    "go": Grammar(
        types=re.compile(r"^(?P<mods>)type\s+(?P<name>\w+)\s+(?P<word>struct|interface)\b"),
        free=(re.compile(rf"^(?P<mods>)func\s+(?:\((?P<recv>[^)]*)\)\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\])?{_ARGS}(?P<ret>[^{{]*)"),),
        whole=("struct", "interface"), package=re.compile(r"^\s*package\s+(\w+)"), imports=(re.compile(r'^(?:import\s+(?:\w+\s+)?|\s+(?:[\w.]+\s+)?)"([^"]+)"\s*$'),),
    ),
}


def calls_in(text: str, own: str) -> list[str]:
    """Called names in order of first use, without keywords and the definition's own name."""
    found = dict.fromkeys(c for c in CALL.findall(text) if c != own and c.rsplit(".", 1)[-1] not in KEYWORDS and c not in KEYWORDS)
    return sorted(found)


def plain_comment(lines: list[str]) -> str:
    """Text of comment lines without their marks."""
    out = []
    for s in map(str.strip, lines):
        s = re.sub(r"\s*\*+/\s*$", "", re.sub(r"^/\*+\s?", "", s))
        s = re.sub(r"^(?:///?|--|#|\*+)\s?", "", s)
        out.append(re.sub(r"^<summary>|</summary>$", "", s).strip())
    return "\n".join(out).strip()


def above(lines: list[str], at: int, annotation: re.Pattern | None) -> tuple[str, list[str]]:
    """Comment and annotations right above a line."""
    i = at
    while i > 0 and annotation and annotation.match(lines[i - 1].strip()):
        i -= 1
    notes, top = [s.strip() for s in lines[i:at]], i
    if i and lines[i - 1].rstrip().endswith("*/"):
        top = i - 1
        while top > 0 and "/*" not in lines[top]:
            top -= 1
    elif i and lines[i - 1].lstrip().startswith("//"):
        while top and lines[top - 1].lstrip().startswith("//"):
            top -= 1
    return plain_comment(lines[top:i]), notes


def definitions(path: str, module: str, b: Blocks, language: str) -> Iterator[tuple]:
    """Symbol rows of one file: kind, symbol, qualified, cls, module, start, end, signature, docstring, calls, imports, decorators."""
    g, lines = GRAMMARS[language], b.lines
    package = next((m[1] for s in lines if g.package and (m := g.package.match(s))), module)
    imports = sorted({x for s in lines for p in g.imports for x in p.findall(s)})
    lead = above(lines, next((i for i, s in enumerate(lines) if s.strip() and not s.lstrip().startswith(("/*", "*", "//"))), len(lines)), None)[0]
    yield "module", path.rsplit("/", 1)[-1], module, None, module, 1, max(1, len(lines)), "", lead if lines and lines[0].lstrip().startswith("/*") else "", [], imports, []
    # a namespace block adds a level around everything
    ground = 1 if language == "csharp" and any(re.match(r"^\s*namespace\s+[\w.]+\s*\{?\s*$", s) for s in lines) and not any(re.match(r"^\s*namespace\s+[\w.]+\s*;", s) for s in lines) else 0
    within: list[tuple[int, int, str]] = []  # types around this line: last line, depth of members, qualified name
    i = 0
    while i < len(lines):
        while within and i > within[-1][0]:
            within.pop()
        s = lines[i].strip()
        inner = within[-1][1] if within else ground
        if b.depth[i] != inner or not s or s.startswith(("//", "*", "/*", "}")) or (s[0] in "@[" and not g.types.match(s)):
            i += 1
            continue
        owner = within[-1][2] if within else package

        def row(kind: str, name: str, qualified: str, end: int, signature: str, mods: str, at: int = i) -> tuple:
            doc, notes = above(lines, at, g.annotation)
            body = "\n".join(lines[at : end + 1])
            cls = within[-1][2].rsplit(".", 1)[-1] if within and kind == "method" else None
            return kind, name, qualified, cls, module, at + 1, end + 1, signature, doc, [] if kind == "class" else calls_in(body, name), [], [*notes, *mods.split()]

        m = g.types.match(s) if g.nested or not within else None
        if m:
            end, word, name = b.end(i), m["word"], m["name"]
            rest = (m.groupdict().get("rest") or "").strip()
            label = f"type {name} {word}" if language == "go" else f"{word} {name}{' ' + rest if rest else ''}"
            yield row("class", name, f"{owner}.{name}", end if word in g.whole else i, label, m["mods"])
            if word not in g.whole and end > i:
                within.append((end, inner + 1, f"{owner}.{name}"))
                i += 1
            else:
                i = end + 1
            continue
        found = None
        for p in g.members if within else g.free:
            m = p.match(s)
            if not m:
                continue
            d = m.groupdict()
            name = d.get("ctor") or d["name"]
            params = next((d[k] for k in ("params", "params2", "params3") if d.get(k) is not None), "").strip()
            if d.get("ctor"):
                if name != owner.rsplit(".", 1)[-1]:
                    continue
                found = "method", name, f"{owner}.{name}", f"{name}({params})", m["mods"]
            elif name not in KEYWORDS and not (within and d.get("ret") is not None and (set(d["ret"].split()) & {"new", "return", "else", "throw", "await"})):
                ret = (d.get("ret") or "").strip()
                if language == "go":
                    recv = (d.get("recv") or "").strip()
                    kind, q = ("method", f"{owner}.{recv.split()[-1].lstrip('*')}.{name}") if recv else ("function", f"{owner}.{name}")
                    found = kind, name, q, f"func {f'({recv}) ' if recv else ''}{name}({params}){f' {ret}' if ret else ''}", ""
                else:
                    found = "method" if within else "function", name, f"{owner}.{name}", f"{ret + ' ' if ret else ''}{name}({params})", m["mods"]
            if found:
                break
        if not found:
            i += 1
            continue
        end = b.end(i)
        kind, name, qualified, signature, mods = found
        yield row(kind, name, qualified, end, signature, mods)
        i = end + 1


def notebook(path: str, module: str, text: str, called, imported) -> Iterator[tuple]:  # noqa: ANN001  functions from a syntax tree
    """One row per cell of a notebook; lines are counted over the sources, one blank line between cells."""
    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return
    line, before = 1, ""
    for i, cell in enumerate(cells if isinstance(cells, list) else [], 1):
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else str(source)
        kind, n = cell.get("cell_type", "code"), max(1, len(source.splitlines()))
        calls, imports = [], []
        if kind == "code":
            try:
                tree = ast.parse("\n".join(s for s in source.splitlines() if not s.lstrip().startswith(("%", "!", "?"))))
                calls, imports = called(tree), imported(tree)
            except SyntaxError:
                pass
        doc = (before if kind == "code" else source.strip())
        yield "cell", f"cell-{i}", f"{module}.cell-{i}", None, module, line, line + n - 1, f"{kind} cell {i}", doc, calls, imports, []
        before = source.strip() if kind == "markdown" else ""
        line += n + 1
