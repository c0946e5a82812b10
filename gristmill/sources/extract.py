"""Python sources to fact rows: the one place where files are lexed and parsed.

``facts`` gives tagged rows. ``error``: a file that cannot be analysed, alone. ``comment``: what a comment
grammar may read. ``binding``: a place that binds a name that something in the file looks up. ``call``,
``decorator``, ``patch``, ``guard``: candidates, with the names to be looked up for them (``refs``). ``host``:
the token text of a statement or logical line, once, however many candidates it holds.

What the names mean, which comments count and what is found is not decided here: that is relational. Files
never fail a task, and the work on a file is linear in its size but for sorting.
"""

from __future__ import annotations

import ast
import heapq
import io
import re
import tokenize
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .reading import decode

REF = "struct<slot:string,dotted:array<string>,scope:int,chain:array<int>,deferred:boolean,line:int,col:int,visit:int>"
SCHEMA = (
    f"path string, fact string, id int, scope int, scope_path string, line int, col int, end_line int, end_col int, low int, high int, norm string, host int, "
    f"text string, name string, module string, symbol string, level int, value_name string, value_node int, flags array<string>, refs array<{REF}>"
)
#: Keywords that decide what a patch stands in for, and patch methods that are no patch calls.
FIDELITY = {"autospec", "spec", "spec_set", "new", "new_callable", "wraps"}
NOT_PATCH = {"dict", "multiple", "stopall"}
TYPING = ("typing", "typing_extensions")
_MOCKS = ("mock", "unittest", "unittest.mock")
_SILENT = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENCODING, tokenize.ENDMARKER}
_WORDS = {t: f"{tokenize.tok_name[t]}:" for t in (tokenize.NAME, tokenize.NUMBER, tokenize.OP)}
#: Without any of these there is no fact; without any of the names only comments are.
_NAMES = ("typing", "mock", "unittest")
_TELLING = (*_NAMES, "SAFETY", "type:", "pyright:", "mypy:")
_OPENS = {t for n in ("FSTRING_START", "TSTRING_START") if (t := getattr(tokenize, n, None)) is not None}
_CLOSES = {t for n in ("FSTRING_END", "TSTRING_END") if (t := getattr(tokenize, n, None)) is not None}


try:
    from _tokenize import TokenizerIter  # what generate_tokens wraps a tuple at a time, from Python 3.12 on
except ImportError:
    _tokens = tokenize.generate_tokens
else:
    def _tokens(readline: Callable[[], str]) -> Iterator[tuple]:
        return TokenizerIter(readline, extra_tokens=True)


def normalize(text: str) -> str:
    """Line ends to newlines, without a leading byte order mark."""
    return text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")


class Lexed:
    """Lines, tokens, comments and logical lines of a normalized text; a text that cannot be tokenized has lines only."""

    def __init__(self, text: str) -> None:
        self.text, self.lines = text, text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        try:
            tokens = list(_tokens(io.StringIO(text).readline))
        except (tokenize.TokenError, SyntaxError):
            tokens = []
        self.comments = [t for t in tokens if t[0] == tokenize.COMMENT]
        self._index_tokens(tokens)
        self._index_logical(tokens)
        #: first line of the run of comment-only lines that ends above a line, by line
        self.run_start, first = [0, 1], 1
        for n, line in enumerate(self.lines, 1):
            first = first if line.lstrip().startswith("#") else n + 1
            self.run_start.append(first)
        self._columns: dict[int, list[int]] = {}

    def offset(self, place: tuple[int, int]) -> int:
        return self.starts[place[0] - 1] + place[1]

    def _index_tokens(self, tokens: list[tokenize.TokenInfo]) -> None:
        """Buckets of tokens and where they begin and end; a formatted string is one, however many tokens it has."""
        self.begin: list[int] = []
        self.end: list[int] = []
        self.buckets: list[str] = []
        depth, opened, starts = 0, 0, self.starts
        for kind, string, (line, col), (end_line, end_col), _ in tokens:
            if kind in _OPENS:
                opened = opened if depth else starts[line - 1] + col
                depth += 1
                continue
            if kind in _CLOSES:
                depth -= 1
            if depth or kind in _SILENT:
                continue
            begin, end = starts[line - 1] + col, starts[end_line - 1] + end_col
            if kind in _WORDS:
                bucket = _WORDS[kind] + string
            elif kind in _CLOSES:
                begin, bucket = opened, f"STRING:{self.text[opened:end]!r}"
            elif kind == tokenize.STRING:
                bucket = f"STRING:{string!r}"
            else:
                continue
            self.begin.append(begin)
            self.end.append(end)
            self.buckets.append(bucket)

    def _index_logical(self, tokens: list[tokenize.TokenInfo]) -> None:
        self.logical: dict[int, tuple[int, int]] = {}
        first = None
        for t in tokens:
            kind = t[0]
            if kind == tokenize.NEWLINE:
                last = t[2][0]
                first = first or last
                self.logical.update(dict.fromkeys(range(first, last + 1), (first, last)))
                first = None
            elif first is None and kind not in _SILENT:
                first = t[2][0]

    def bounds(self, line: int) -> tuple[int, int]:
        """First and last line of the logical line a line is in."""
        return self.logical.get(line, (line, line))

    def norm(self, a: int, b: int) -> str:
        """Buckets of the tokens between two offsets."""
        return " ".join(self.buckets[bisect_right(self.end, a) : bisect_left(self.begin, b)])

    def column(self, line: int, byte: int) -> int:
        """Characters before a byte of a line."""
        if not 0 < line <= len(self.lines):
            return byte
        text = self.lines[line - 1]
        if text.isascii():
            return min(byte, len(text))
        if line not in self._columns:
            ends, at = [], 0
            for c in text:
                at += len(c.encode("utf-8", "surrogatepass"))
                ends.append(at)
            self._columns[line] = ends
        return bisect_right(self._columns[line], byte)

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        return node.lineno, self.column(node.lineno, node.col_offset), node.end_lineno, self.column(node.end_lineno, node.end_col_offset)

    def line_text(self, line: int) -> str:
        """Token text of the logical line a line is in."""
        a, b = self.bounds(line)
        return self.norm(self.starts[a - 1], self.starts[b] - 1)


#: Children in the order in which they are looked through: "x=" is bound, "x:" are statements that may not run.
_ORDER = {
    ast.Assign: "targets= value", ast.AnnAssign: "target= annotation value", ast.AugAssign: "target= value", ast.Delete: "targets=",
    ast.For: "iter target= body: orelse:", ast.AsyncFor: "iter target= body: orelse:", ast.With: "items body:", ast.AsyncWith: "items body:",
    ast.withitem: "context_expr optional_vars=", ast.Try: "body: handlers orelse: finalbody:", ast.TryStar: "body: handlers orelse: finalbody:",
    ast.Match: "subject cases", ast.match_case: "pattern guard body:", ast.If: "test body: orelse:", ast.While: "test body: orelse:",
}
_FORMS = {
    ast.Assign: "assign", ast.AnnAssign: "ann_assign", ast.AugAssign: "aug_assign", ast.Delete: "delete", ast.For: "for", ast.AsyncFor: "for", ast.withitem: "with",
}
_ORDER = {k: tuple((step.rstrip("=:"), step.endswith("="), step.endswith(":")) for step in steps.split()) for k, steps in _ORDER.items()}
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LEAVES = (ast.Name, ast.Constant)
#: Node types that are more than their children, in the walk that takes scopes and bindings.
_SPECIAL = {
    ast.Import, ast.ImportFrom, *_DEFS, ast.ClassDef, ast.Lambda, *_COMPREHENSIONS, ast.NamedExpr, ast.Global, ast.Nonlocal, ast.ExceptHandler, getattr(ast, "TypeAlias", ast.Lambda),
    ast.MatchMapping, ast.MatchStar, ast.MatchAs,
}
#: Fields that hold no nodes, or nodes without a place.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "type_ignores", "conversion", "level", "module", "is_async", "simple", "asname", "kwd_attrs", "rest"}
_fields: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in order, but for those that say how a name is used or which operator stands there."""
    kind = node.__class__
    if kind not in _fields:
        _fields[kind] = tuple(f for f in kind._fields if f not in _PLAIN)
    found = []
    for name in _fields[kind]:
        value = getattr(node, name, None)
        if value.__class__ is list:
            found += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            found.append(value)
    return found


def dotted(node: ast.AST | None) -> list[str] | None:
    """a.b.c as a list; null for any other expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None


def simple(node: ast.AST | None) -> list[str] | None:
    """a or a.b."""
    names = dotted(node)
    return names if names and len(names) < 3 else None


class Census:
    """Scopes, which scope each node is in, and all places that bind names, in the order of a reader."""

    def __init__(self, tree: ast.Module) -> None:
        self.kinds, self.names, self.parents, self.lines = ["module"], ["<module>"], [-1], [None]
        self.own: dict[int, int] = {}
        self.scope_of: dict[int, int] = {}
        self.sites: list[dict] = []
        self.bound: list[set[str]] = [set()]
        self.nonlocals: dict[int, set[str]] = {}
        #: bases of classes, by scope
        self.classes: dict[int, list[tuple[list[str], int, int]]] = {}
        self.top = {id(s) for s in tree.body}
        self._chains: dict[tuple[int, bool], list[int]] = {}
        self._paths: dict[int, str] = {0: "module"}
        for statement in tree.body:
            self.visit(statement, 0, False)
        self._written_from_inside()

    # scopes

    def _scope(self, kind: str, name: str, parent: int, node: ast.AST, lines: tuple[int, int] | None) -> int:
        self.kinds.append(kind)
        self.names.append(name)
        self.parents.append(parent)
        self.lines.append(lines)
        self.bound.append(set())
        self.scope_of[id(node)] = len(self.kinds) - 1
        return len(self.kinds) - 1

    def chain(self, scope: int, every: bool = False) -> list[int]:
        """Where a name used in a scope is looked for, nearest first: not in classes around functions (unless every)."""
        if (scope, every) not in self._chains:
            inner, found, at = self.kinds[scope] not in ("module", "class"), [], scope
            while at >= 0:
                if every or at == scope or not (inner and self.kinds[at] == "class"):
                    found.append(at)
                at = self.parents[at]
            self._chains[scope, every] = found
        return self._chains[scope, every]

    def deferred(self, scope: int) -> bool:
        """Is a scope inside a function, so that it may run when the module is complete?"""
        while scope > 0 and self.kinds[scope] != "function":
            scope = self.parents[scope]
        return scope > 0

    def path(self, scope: int) -> str:
        if scope not in self._paths:
            own = {"class": f"class:{self.names[scope]}", "comprehension": "comp:<comp>"}.get(self.kinds[scope], f"fn:{self.names[scope]}")
            outer = self.path(self.parents[scope])
            self._paths[scope] = own if outer == "module" else f"{outer}@{own}"
        return self._paths[scope]

    def of_lines(self, wanted: list[int]) -> dict[int, int]:
        """The innermost scope whose lines a line is among."""
        spans = sorted((s[0], s[1], k) for k, s in enumerate(self.lines) if s)
        depth = [0]
        for parent in self.parents[1:]:
            depth.append(depth[parent] + 1)
        found, open_, at = {}, [], 0
        for line in sorted(set(wanted)):
            while at < len(spans) and spans[at][0] <= line:
                heapq.heappush(open_, (-depth[spans[at][2]], spans[at][1], spans[at][2]))
                at += 1
            while open_ and open_[0][1] < line:
                heapq.heappop(open_)
            found[line] = open_[0][2] if open_ else 0
        return found

    # bindings

    def site(self, scope: int, name: str, form: str, line: int, col: int, *, unconditional: bool = True, direct: bool = False, value: ast.AST | None = None, **more: object) -> None:
        self.sites.append({"id": len(self.sites), "scope": scope, "name": name, "form": form, "line": line, "col": col, "unconditional": unconditional, "direct": direct, "value": value, **more})
        self.bound[scope].add(name)

    def _direct(self, scope: int, maybe: bool) -> bool:
        return self.kinds[scope] == "function" and not maybe

    def _written_from_inside(self) -> None:
        """A name written where it is declared nonlocal is bound once more in the function that has it."""
        before = list(self.sites)
        for scope, names in self.nonlocals.items():
            for s in before:
                if s["scope"] == scope and s["name"] in names and s["form"] not in ("nonlocal", "global", "import", "def", "class"):
                    at = self.parents[scope]
                    while at >= 0 and not (self.kinds[at] == "function" and s["name"] in self.bound[at]):
                        at = self.parents[at]
                    if at >= 0:
                        self.site(at, s["name"], "nonlocal_write", s["line"], s["col"])

    def store(self, target: ast.AST, form: str, scope: int, maybe: bool, value: ast.AST | None = None, **more: object) -> None:
        self.own[id(target)] = scope
        if isinstance(target, ast.Name):
            self.site(scope, target.id, form, target.lineno, target.col_offset, direct=self._direct(scope, maybe), value=value, **more)
        elif isinstance(target, (ast.Tuple, ast.List, ast.Starred)):
            for part in [target.value] if isinstance(target, ast.Starred) else target.elts:
                self.store(part, form, scope, maybe, value, **more | {"top": False})
        else:
            for child in children(target):
                self.visit(child, scope, maybe)

    # the walk

    def visit(self, node: ast.AST, scope: int, maybe: bool) -> None:
        self.own[id(node)] = scope
        kind = node.__class__
        if kind in _LEAVES:
            return
        if kind in _ORDER:
            for field, binds, may_not_run in _ORDER[kind]:
                parts = getattr(node, field)
                for child in parts if isinstance(parts, list) else [parts]:
                    if child is None:
                        continue
                    if binds:
                        self._bind(node, child, scope, maybe)
                    else:
                        self.visit(child, scope, maybe or may_not_run)
        elif kind not in _SPECIAL:
            for child in children(node):
                self.visit(child, scope, maybe)
        elif kind in (ast.Import, ast.ImportFrom):
            self._import(node, scope, maybe)
        elif kind in _DEFS or kind is ast.ClassDef:
            self._definition(node, scope, maybe)
        elif kind is ast.Lambda:
            self._parameters(node, scope)
            inner = self._scope("lambda", "<lambda>", scope, node, (node.lineno, node.end_lineno))
            self._bind_parameters(node, inner)
            self.visit(node.body, inner, False)
        elif kind in _COMPREHENSIONS:
            self._comprehension(node, scope)
        elif kind is ast.NamedExpr:
            owner = scope
            while self.kinds[owner] == "comprehension":
                owner = self.parents[owner]
            self.own[id(node.target)] = owner
            self.site(owner, node.target.id, "walrus", node.target.lineno, node.target.col_offset, value=node.value)
            self.visit(node.value, scope, maybe)
        elif kind in (ast.Global, ast.Nonlocal):
            form = kind.__name__.lower()
            if kind is ast.Nonlocal:
                self.nonlocals.setdefault(scope, set()).update(node.names)
            for name in node.names:
                self.site(scope, name, form, node.lineno, node.col_offset, direct=self._direct(scope, maybe))
        elif kind is ast.ExceptHandler:
            if node.type is not None:
                self.visit(node.type, scope, maybe)
            if node.name is not None:
                self.site(scope, node.name, "except", node.lineno, node.col_offset)
            for child in node.body:
                self.visit(child, scope, True)
        elif kind.__name__ == "TypeAlias":
            self.site(scope, node.name.id, "assign", node.name.lineno, node.name.col_offset, direct=self._direct(scope, maybe))
            self._type_parameters(node, scope)
            self.visit(node.value, scope, maybe)
        else:
            captured = getattr(node, "rest" if kind is ast.MatchMapping else "name", None) if isinstance(node, ast.pattern) else None
            if captured is not None:
                self.site(scope, captured, "match", node.lineno, node.col_offset)
            for child in children(node):
                self.visit(child, scope, maybe)

    def _bind(self, node: ast.AST, target: ast.AST, scope: int, maybe: bool) -> None:
        more: dict = {}
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            more["value"] = node.value
        if isinstance(node, ast.Assign):
            more["top"] = id(node) in self.top and target.lineno == node.lineno
        if isinstance(node, ast.AnnAssign):
            # an annotation means what its names stood for when the reader came by
            more |= {"annotation": node.annotation, "seen": len(self.sites)}
        self.store(target, _FORMS[type(node)], scope, maybe, **more)

    def _import(self, node: ast.Import | ast.ImportFrom, scope: int, maybe: bool) -> None:
        for a in node.names:
            if isinstance(node, ast.Import):
                more = {"module": a.name, "aliased": a.asname is not None}
                name = a.asname or a.name.split(".")[0]
            else:
                more = {"module": node.module or "", "symbol": a.name, "level": node.level}
                name = a.asname or a.name
            self.site(scope, name, "import", node.lineno, node.col_offset, unconditional=not maybe, **more)

    def _parameters(self, node: ast.AST, scope: int) -> None:
        """Defaults and annotations belong to the scope outside."""
        for default in [*node.args.defaults, *node.args.kw_defaults]:
            if default is not None:
                self.visit(default, scope, False)
        for arg in _arguments(node.args):
            if arg.annotation is not None:
                self.visit(arg.annotation, scope, False)

    def _bind_parameters(self, node: ast.AST, inner: int) -> None:
        for arg in _arguments(node.args):
            self.site(inner, arg.arg, "param", node.lineno, arg.col_offset, direct=True)

    def _type_parameters(self, node: ast.AST, scope: int) -> None:
        for p in getattr(node, "type_params", ()):
            self.site(scope, p.name, "param", p.lineno, p.col_offset, direct=True)
            for part in (getattr(p, "bound", None), getattr(p, "default_value", None)):
                if part is not None:
                    self.visit(part, scope, False)

    def _definition(self, node: ast.AST, scope: int, maybe: bool) -> None:
        a_class = isinstance(node, ast.ClassDef)
        self.site(scope, node.name, "class" if a_class else "def", node.lineno, node.col_offset, direct=self._direct(scope, maybe))
        for d in node.decorator_list:
            self.visit(d, scope, maybe)
        if a_class:
            for part in [*node.bases, *node.keywords]:
                self.visit(part, scope, maybe)
        else:
            self._parameters(node, scope)
            if node.returns is not None:
                self.visit(node.returns, scope, maybe)
        inner = self._scope("class" if a_class else "function", node.name, scope, node, (node.body[0].lineno, node.end_lineno))
        self._type_parameters(node, inner)
        if a_class:
            self.classes[inner] = [(names, node.lineno, node.col_offset) for names in map(simple, node.bases) if names]
        else:
            self._bind_parameters(node, inner)
        for statement in node.body:
            self.visit(statement, inner, False)

    def _comprehension(self, node: ast.AST, scope: int) -> None:
        self.visit(node.generators[0].iter, scope, False)
        inner = self._scope("comprehension", "<comp>", scope, node.generators[0], None)
        for k, g in enumerate(node.generators):
            if k:
                self.visit(g.iter, inner, False)
            self.store(g.target, "for", inner, True)
            for condition in g.ifs:
                self.visit(condition, inner, False)
        for part in ("key", "value", "elt"):
            if (child := getattr(node, part, None)) is not None:
                self.visit(child, inner, False)


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs, *(a for a in (args.vararg, args.kwarg) if a is not None)]


def is_literal(node: ast.AST) -> bool:
    """Constants, signs before literals, and displays of literals."""
    if isinstance(node, ast.UnaryOp):
        return isinstance(node.op, (ast.UAdd, ast.USub)) and is_literal(node.operand)
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return all(map(is_literal, node.elts))
    if isinstance(node, ast.Dict):
        return all(k is not None and is_literal(k) and is_literal(v) for k, v in zip(node.keys, node.values, strict=True))
    return isinstance(node, ast.Constant)


def _returns_constant(body: list[ast.stmt]) -> bool:
    """Is a body, after its docstring, a single return of True or False?"""
    first = body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        body = body[1:]
    return len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, bool)


class _File:
    """Fact rows of one file."""

    def __init__(self, text: str, tree: ast.Module) -> None:
        # a short text that can hold neither names of interest nor scopes needs no walk
        plain = _short(text) and not any(word in text for word in (*_NAMES, "def", "class", "lambda"))
        self.lex, self.census, self.rows = Lexed(text), Census(ast.Module([], []) if plain else tree), []
        self.hosts: dict[str, int] = {}
        self._line_hosts: dict[tuple[int, int], int] = {}
        self._stmt_hosts: dict[int, int] = {}
        imports = [s for s in self.census.sites if s["form"] == "import"] if self.census.sites else []
        star = any(s.get("symbol") == "*" and s["module"] in TYPING for s in imports)
        self.typing = {s["name"] for s in imports if s["module"] in TYPING}
        #: names that may stand for cast, for the typing modules, and for anything of mock; nothing else can be a candidate
        self.casts = {s["name"] for s in imports if s["module"] in TYPING and s.get("symbol") == "cast"} | ({"cast"} if star else set())
        self.modules = {s["name"] for s in imports if s["module"] in TYPING and "symbol" not in s}
        self.mocks = {s["name"] for s in imports if s["module"] in _MOCKS}
        self.any_typing = star
        self.wanted: set[str] = set()

    def host(self, text: str) -> int:
        return self.hosts.setdefault(text, len(self.hosts))

    def line_host(self, line: int) -> int:
        key = self.lex.bounds(line)
        if key not in self._line_hosts:
            self._line_hosts[key] = self.host(self.lex.line_text(line))
        return self._line_hosts[key]

    def ref(self, slot: str, names: list[str], scope: int, line: int, col: int, visit: int | None = None) -> dict:
        self.wanted.add(names[0])
        chain = self.census.chain(scope, visit is not None)
        return {"slot": slot, "dotted": names, "scope": scope, "chain": chain, "deferred": self.census.deferred(scope), "line": line, "col": col, "visit": visit}

    def add(self, fact: str, number: int, scope: int, span: tuple[int, int, int, int], **more: object) -> None:
        low, high = self.lex.run_start[span[0]], self.lex.bounds(span[2])[1]
        line, col, end_line, end_col = span
        self.rows.append({"fact": fact, "id": number, "scope": scope, "scope_path": self.census.path(scope), "line": line, "col": col, "end_line": end_line, "end_col": end_col, "low": low, "high": high, **more})

    def run(self, tree: ast.Module) -> list[dict]:
        self.comments()
        number, numbers, calls, marks = 0, {}, [], 0
        stack: list[tuple[ast.AST, ast.stmt | None]] = [(tree, None)] if self.typing or self.mocks or self.any_typing else []
        while stack:  # in source tree order, which numbers candidates
            node, statement = stack.pop()
            if node.__class__ in _LEAVES:
                continue
            number += 1
            statement = node if isinstance(node, ast.stmt) else statement
            if isinstance(node, ast.Call):
                numbers[id(node)] = number
                calls.append((node, statement, number))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                for d in node.decorator_list:
                    marks += 1
                    self.decorator(d, node, marks)
                if not isinstance(node, ast.ClassDef):
                    self.guard(node, number)
            stack += [(c, statement) for c in reversed(children(node))]
        for node, statement, k in calls:
            self.cast(node, statement, k, numbers)
            self.patch(node, k)
        self.bindings()
        self.rows += [{"fact": "host", "id": k, "text": text} for text, k in self.hosts.items()]
        return self.rows

    def comments(self) -> None:
        if not self.lex.comments:
            return
        kept = [t for t in self.lex.comments if any(word in t[1] for word in ("SAFETY", "type:", "pyright:", "mypy:"))]
        scopes = self.census.of_lines([t[2][0] for t in kept])
        for k, (_, text, start, end, _) in enumerate(kept):
            line = start[0]
            host = self.line_host(line) if ":" in text.partition("SAFETY")[0] else None  # pure evidence needs none
            flags = ["only"] if self.lex.run_start[line + 1] <= line else []
            self.add("comment", k, scopes[line], (*start, *end), text=text, host=host, flags=flags)

    def cast(self, node: ast.Call, statement: ast.stmt, number: int, numbers: dict[int, int]) -> None:
        func = simple(node.func)
        if not func or not (func[0] in self.casts if len(func) == 1 else func[0] in self.modules and func[1] == "cast"):
            return
        if len(node.args) + len(node.keywords) != 2:
            return
        given = [*zip(("typ", "val"), node.args, strict=False), *((k.arg, k.value) for k in node.keywords)]
        if {k for k, _ in given} != {"typ", "val"} or any(isinstance(a, ast.Starred) for a in node.args):
            return
        typ, val = dict(given)["typ"], dict(given)["val"]
        scope, span = self.census.own.get(id(node), 0), self.lex.span(node)
        refs = [self.ref("callee", func, scope, node.lineno, node.col_offset)]
        if simple(typ):
            refs.append(self.ref("type", simple(typ), scope, *span[:2]))
        if isinstance(typ, ast.Name):
            refs.append(self.ref("typevar", [typ.id], scope, *span[:2]))
        root = val
        while isinstance(root, (ast.Attribute, ast.Subscript)):
            root = root.value
        if isinstance(root, ast.Call) and simple(root.func):
            refs.append(self.ref("parser", simple(root.func), scope, *span[:2]))
        if isinstance(val, ast.Name):
            self.wanted.add(val.id)
        if id(statement) not in self._stmt_hosts:
            a = self.lex.span(statement)
            self._stmt_hosts[id(statement)] = self.host(self.lex.norm(self.lex.offset(a[:2]), self.lex.offset(a[2:])))
        self.add(
            "call", number, scope, span, norm=self.lex.norm(self.lex.offset(span[:2]), self.lex.offset(span[2:])), host=self._stmt_hosts[id(statement)],
            refs=refs, value_name=val.id if isinstance(val, ast.Name) else None, value_node=numbers.get(id(val)),
            flags=["discarded"] if isinstance(statement, ast.Expr) and statement.value is node else [],
        )

    def patch(self, node: ast.Call, number: int) -> None:
        func = dotted(node.func)
        if not func or func[0] not in self.mocks or (len(func) > 1 and func[-1] in NOT_PATCH):
            return
        create = next((k.value.value is True for k in node.keywords if k.arg == "create" and isinstance(k.value, ast.Constant)), False)
        flags = [name for name, so in (("create", create), ("fidelity", any(k.arg in FIDELITY for k in node.keywords)), ("splat", any(k.arg is None for k in node.keywords))) if so]
        scope = self.census.own.get(id(node), 0)
        ref = self.ref("callee", func, scope, node.lineno, node.col_offset)
        self.add("patch", number, scope, self.lex.span(node), host=self.line_host(node.lineno), refs=[ref], flags=flags, level=len(node.args))

    def decorator(self, node: ast.expr, of: ast.AST, number: int) -> None:
        names = simple(node)
        if not names or not (self.any_typing or names[0] in self.typing):
            return
        scope = self.census.own.get(id(node), 0)
        written = "no_type_check" if len(names) == 1 else ".".join(names) if names[1] == "no_type_check" else "no_type_check:unknown"
        norm = f"{written}|{'class' if isinstance(of, ast.ClassDef) else 'function'}|{of.name}"
        self.add("decorator", number, scope, self.lex.span(node), norm=norm, host=self.line_host(node.lineno), refs=[self.ref("mark", names, scope, node.lineno, node.col_offset)])

    def guard(self, node: ast.FunctionDef | ast.AsyncFunctionDef, number: int) -> None:
        """Functions that may narrow a type, by what they say to return."""
        base = node.returns.value if isinstance(node.returns, ast.Subscript) else node.returns
        names = simple(base)
        if not names or not (self.any_typing or names[0] in self.typing):
            return
        inner = self.census.scope_of[id(node)]
        refs = [self.ref("returns", names, self.census.own.get(id(node.returns), 0), node.returns.lineno, node.returns.col_offset)]
        refs += [self.ref("mark", simple(d), inner, d.lineno, d.col_offset) for d in node.decorator_list if simple(d)]
        around = self.census.parents[inner]
        while around > 0 and self.census.kinds[around] != "class":
            around = self.census.parents[around]
        bases = self.census.classes.get(around, ()) if around > 0 else ()
        refs += [self.ref("base", names, around, line, col) for names, line, col in bases]
        last = max(node.lineno, node.body[0].lineno - 1)
        self.add(
            "guard", number, inner, (node.lineno, node.col_offset, last, len(self.lex.lines[last - 1])), norm=f"{'async' if isinstance(node, ast.AsyncFunctionDef) else 'function'}|{node.name}",
            host=self.line_host(node.lineno), refs=refs, flags=["constant"] if _returns_constant(node.body) else [],
        )

    def bindings(self) -> None:
        """Places that bind a name that is looked up, or one that such a place takes its value from."""
        sites, by_name = self.census.sites, {}
        for s in sites:
            if s["form"] == "import" and s.get("symbol") == "*":
                continue
            by_name.setdefault(s["name"], []).append(s)
        todo, wanted = list(self.wanted), set()
        kept = [s for s in sites if s["form"] == "import" and s.get("symbol") == "*" and s["module"] in TYPING]
        while todo:
            name = todo.pop()
            if name in wanted:
                continue
            wanted.add(name)
            for s in by_name.get(name, ()):
                kept.append(s)
                value = s["value"]
                s["refs"] = []
                if s["form"] == "ann_assign" and s["direct"] and (names := simple(s["annotation"])) and (len(names) == 1 or names[1] == "Any"):
                    s["refs"].append(self.ref("annotation", names, s["scope"], s["line"], s["col"], s["seen"]))
                if s["form"] == "assign" and isinstance(value, ast.Call) and (names := simple(value.func)):
                    s["refs"].append(self.ref("made", names, s["scope"], s["line"], s["col"]))
                todo += [r["dotted"][0] for r in s["refs"]]
                if s["form"] in ("assign", "ann_assign") and isinstance(value, ast.Name):
                    s["value_name"] = value.id
                    todo.append(value.id)
        for s in kept:
            flags = [f for f in ("unconditional", "direct", "aliased") if s.get(f)]
            flags += ["literal"] if s["form"] in ("assign", "ann_assign") and s["value"] is not None and is_literal(s["value"]) else []
            flags += ["top"] if s.get("top") and s["scope"] == 0 else []
            flags.append(self.census.kinds[s["scope"]])
            self.rows.append({
                "fact": "binding", "id": s["id"], "scope": s["scope"], "line": s["line"], "col": s["col"], "name": s["name"], "text": s["form"], "flags": flags,
                **{k: s[k] for k in ("module", "symbol", "level", "value_name", "refs") if s.get(k) is not None},
            })


_SURROGATE = re.compile("[\ud800-\udfff]")


def file_facts(source: str | None) -> list[dict]:
    """Fact rows (all but the path) of one text."""
    text = normalize(source or "")
    if "\0" in text:
        return [_error("encode", "source contains null bytes")]
    if not text.isascii() and (lone := _SURROGATE.search(text)):
        return [_error("encode", f"source contains lone surrogate at index {lone.start()}")]
    try:
        tree = ast.parse(text)
    except RecursionError:
        return [_error("limit", "source is nested too deeply")]
    except (SyntaxError, ValueError) as e:
        return [_error("parse", str(e))]
    if _short(text) and not any(word in text for word in _TELLING):
        return []
    try:
        return _File(text, tree).run(tree)
    except RecursionError:
        return [_error("limit", "source is nested too deeply")]
    except Exception as e:  # noqa: BLE001 - a file must not fail the task of many others
        return [_error("internal", f"{type(e).__name__}: {e}")]


def _short(text: str) -> bool:
    """Is a text too short to nest too deeply, with all names written as they are (in ASCII none has a compatibility form)?"""
    return len(text) <= 400 and text.isascii()


def _error(kind: str, message: str) -> dict:
    return {"fact": "error", "name": kind, "text": message}


_INT, _STR = pa.int32(), pa.string()
_REF = pa.struct([
    ("slot", _STR), ("dotted", pa.list_(_STR)), ("scope", _INT), ("chain", pa.list_(_INT)), ("deferred", pa.bool_()), ("line", _INT), ("col", _INT), ("visit", _INT),
])
_KINDS = {"string": _STR, "int": _INT, "array<string>": pa.list_(_STR), f"array<{REF}>": pa.list_(_REF)}
NAMES = [c.split(" ", 1)[0] for c in SCHEMA.split(", ")]
TYPES = [_KINDS[c.split(" ", 1)[1]] for c in SCHEMA.split(", ")]


#: Files of a task. Files are dealt out by their paths, so that a task does not grow with the number of files.
FILES = 20_000


def dealt(sources: DataFrame) -> DataFrame:
    """Sources in parts of some FILES each, four a core at least: parsing costs far more than moving texts."""
    cores = sources.sparkSession.sparkContext.defaultParallelism
    return sources.repartition(max(4 * cores, -(-sources.count() // FILES)), "path")


def reader(raw: bool, max_bytes: int | None) -> Callable[[str, str | bytes | None], list[dict]]:
    """Fact rows of a path and its text, or its bytes (raw), which are decoded first."""
    def of(path: str, value: str | bytes | None) -> list[dict]:
        if raw:
            value, error = decode(path, value or b"", *([max_bytes] if max_bytes else []))
            if error:
                return [_error(*error)]
        return file_facts(value)

    return of


def facts(sources: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Fact rows (SCHEMA) of sources(path, text), or of files(path, content) that are decoded on the way."""
    raw = "text" not in sources.columns
    of = reader(raw, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, value in zip(*batch.columns, strict=True):
                path = path.as_py()
                rows += [{"path": path, **r} for r in of(path, value.as_py())]
                if len(rows) > 20_000:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return dealt(sources.select("path", "content" if raw else "text")).mapInArrow(run, SCHEMA)


def _packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(NAMES, TYPES, strict=True)], names=NAMES)
