"""Small Python modules and what the audit must find in them: (text, [(code, line, column)]).

{k} stands for a number that differs from module to module. The SQL twins of the queries know these lists
only as tables of expectations.
"""

from __future__ import annotations

_C = "from typing import cast\n"
_A = "from typing import Any, cast\n"

#: One or more for each rule; all rules run.
RULES = [
    (_C + "x = cast(int, cast(str, {k}))\n", [("TW001", 2, 4), ("TW002", 2, 4)]),
    (_C + "x = cast(int, cast(str, cast(int, {k})))\n", [("TW001", 2, 4), ("TW002", 2, 4)]),
    (_C + "# SAFETY: two words\nx = cast(int, {k})\n", []),
    (_C + "x = cast(val={k}, typ=int)\n", [("TW002", 2, 4)]),
    (_C + "x = cast(int, {k}, 1)\ny = cast(*x)\nz = cast(int, value={k})\n", []),
    ("x = 1  # type: ignore\ny = {k}\n", [("TW003", 1, 7)]),
    ("x = {k}  # type: ignore[a] SAFETY: two words\ny = 1  # type: ignore[a]\n", [("TW003", 2, 7)]),
    (_A + "def f():\n    w: Any = [{k}, -1]\n    return cast(list, w)\n", [("TW002", 4, 11), ("TW004", 4, 11)]),
    (_A + "def f():\n    a = {k}\n    b = a\n    w: object = b\n    # SAFETY[TW002]: two words\n    return cast(int, w)\n", [("TW004", 7, 11)]),
    (_A + "def f(p):\n    w: Any = p\n    v: Any = {k}\n    v = 2\n    return cast(int, w), cast(int, v)\n", [("TW002", 6, 11), ("TW002", 6, 25)]),
    (_A + "x = cast(Any, {k})\n", [("TW002", 2, 4), ("TW005", 2, 4)]),
    ("import typing as t\n# SAFETY: two words\nx = t.cast(t.Any, {k})\n", [("TW005", 3, 4)]),
    ("import typing as t\n# SAFETY[TW005, TW002]: two words\nx = t.cast(t.Any, {k})\n", []),
    (_C + "cast(int, {k})\n", [("TW002", 2, 0), ("TW006", 2, 0)]),
    ("# mypy: ignore-errors\nx = {k}\n", [("TW007", 1, 0)]),
    ("# SAFETY: two words\n# pyright: basic\nx = {k}\n", []),
    ("# SAFETY: two words\n\n# pyright: reportFoo=False\nx = {k}\n", [("TW007", 3, 0)]),
    ("def f():\n    return {k}\n# pyright: basic\n", [("TW007", 3, 0)]),
    ("def f():\n    a = 1\n# pyright: basic\n    return {k}\n", []),
    ("import typing\n@typing.no_type_check\nclass A{k}: pass\n", [("TW008", 2, 1)]),
    ("from typing import no_type_check as n\n@n\n@n()\ndef f{k}(): pass\n", [("TW008", 2, 1)]),
    ("from mock import patch\npatch('a{k}', create=True)\npatch('b', create=1, new=2)\n", [("TW009", 2, 0), ("TW012", 2, 0)]),
    ("import unittest.mock\nunittest.mock.patch.object(a, 'b', {k})\nunittest.mock.patch.object(a, {k})\nunittest.mock.patch.multiple({k})\n", [("TW012", 3, 0)]),
    ("from unittest import mock as m\nm.patch('a{k}', **{})\nm.patch('a', autospec=True)\n", []),
    ("from typing import TypeGuard\ndef f{k}(x) -> TypeGuard[int]:\n    'doc'\n    return True\n", [("TW010", 2, 0)]),
    ("import typing_extensions as t\nasync def f{k}(x) -> t.TypeIs[int]:\n    return False\n", [("TW010", 2, 0)]),
    ("from typing import TypeGuard, overload\n@overload\ndef f{k}(x) -> TypeGuard[int]: return True\ndef g(x) -> 'TypeGuard[int]': return True\ndef h(x) -> TypeGuard[int]: return x\n", []),
    ("from typing import *\nclass P(Protocol):\n    def f{k}(self) -> TypeGuard[int]: return True\n", []),
    ("import json\n" + _C + "x = cast(int, json.loads('{k}')['a'].b)\n", [("TW002", 3, 4), ("TW011", 3, 4)]),
    ("from ast import literal_eval as e\n" + _A + "x = cast(Any, e('{k}'))\n# SAFETY[TW011, TW002]: two words\ny = cast(int, e(''))\n", [("TW002", 3, 4), ("TW005", 3, 4)]),
    ("from typing import TypeVar, cast\nT = TypeVar('T')\nx = cast(T, {k})\n", [("TW002", 3, 4), ("TW013", 3, 4)]),
    ("import typing\ndef f(v):\n    T = typing.TypeVar('T')\n    return typing.cast(T, {k})\n", [("TW002", 4, 11), ("TW013", 4, 11)]),
    ("from typing import TypeVar, cast\nif {k}:\n    T = TypeVar('T')\nx = cast(T, 1)\n", [("TW002", 4, 4)]),
    ("from typing import TypeVar, cast\nT = TypeVar('T')\ndef f():\n    x = cast(T, {k})\n    T = 1\n", [("TW002", 4, 8), ("TW013", 4, 8)]),
    ("from typing import TypeVar, cast\nT = TypeVar('T')\nT = TypeVar('T')\nx = cast(T, {k})\n", [("TW002", 4, 4)]),
    ("from typing import TypeVar as V, cast\nclass A:\n    T = V('T')\n    def f(self):\n        return cast(T, {k})\nT = V('T')\n", [("TW002", 5, 15), ("TW013", 5, 15)]),
    ("from typing import Any as A, cast as c\nx = c(A, {k})\n", [("TW002", 2, 4), ("TW005", 2, 4)]),
    ("import json\n" + _C + "x = cast(object, json.loads('{k}'))\n", [("TW002", 3, 4)]),
    ("import json\nfrom .typing import Any, cast\nx = cast(Any, json.loads('{k}'))\n", [("TW002", 3, 4)]),
    ("from json import loads\nfrom pickle import loads\n" + _C + "x = cast(int, loads('{k}'))\n", [("TW002", 4, 4)]),
    ("import json\nimport json\n" + _C + "x = cast(int, json.load('{k}'))\n", [("TW002", 4, 4), ("TW011", 4, 4)]),
    ("import os\nimport json as os\n" + _C + "x = cast(int, os.loads('{k}'))\n", [("TW002", 4, 4), ("TW011", 4, 4)]),
    ("json = 1\nimport json\n" + _C + "x = cast(int, json.loads('{k}'))\n", [("TW002", 4, 4)]),
    ("from unittest.mock import patch\n@patch('a{k}')\n@patch.object(a, 'b', new_callable=c)\n@patch.dict('d')\ndef f(): pass\n", [("TW012", 2, 1)]),
    ("from unittest import mock\nwith mock.patch('a', spec=True) as p, mock.patch('b{k}') as q: pass\n", [("TW012", 2, 38)]),
    (_C + "class A:\n    def f(self):\n        x = cast(int, cast(str, {k}))  # SAFETY: two words\n", [("TW001", 4, 12)]),
    (_C + "x = (cast(int, 1) if {k} else cast(int, 2))  # SAFETY[TW002]: two words\n", []),
    ("text = 'cast(int, {k})  # type: ignore'\n", []),
]


def _use(setup: str, line: int, found: bool, body: str = "x = cast(int, {k})\n") -> tuple:
    return (setup + body, [("TW002", line, 4)] if found else [])


#: Ways to bind a name, and what a later use of it then means; the default rules but TW006.
SCOPES = [
    _use(_C, 2, True),
    _use(_C + "cast = 1\n", 3, False),
    _use(_C + "cast: int = 1\n", 3, False),
    _use(_C + "cast += 1\n", 3, False),
    _use(_C + "del cast\n", 3, False),
    _use(_C + "for cast in []: pass\n", 3, False),
    _use(_C + "with a as (b, [*cast]): pass\n", 3, False),
    _use(_C + "try: pass\nexcept E as cast: pass\n", 4, False),
    _use(_C + "match a:\n    case [*cast]: pass\n", 4, False),
    _use(_C + "match a:\n    case {'x': 1, **cast}: pass\n", 4, False),
    _use(_C + "match a:\n    case B(c=d) as cast: pass\n", 4, False),
    _use(_C + "(cast := 1)\n", 3, False),
    _use(_C + "def cast(): pass\n", 3, False),
    _use(_C + "class cast: pass\n", 3, False),
    _use(_C + "import os as cast\n", 3, False),
    _use(_C + "type cast = int\n", 3, False),
    _use(_C + "[cast for cast in a]\n", 3, True),
    _use(_C + "[(cast := b) for b in a]\n", 3, False),
    _use(_C + "lambda cast: cast(int, {k})\n", 3, True),
    _use("if {k}:\n    from typing import cast\n", 3, True),
    _use("if {k}:\n    from typing import cast\nelse:\n    from os import cast\n", 5, False),
    _use(_C + "if {k}:\n    from os import cast\n", 4, True),
    _use("from .typing import cast\n", 2, True),
    _use("from typing import *\n", 2, True),
    _use("from os import *\n" + _C, 3, True),
    _use("", 1, False, "x = cast(int, {k})\nfrom typing import cast\n"),
    (_C + "def f(a=cast(int, {k})):\n    return 1\n", [("TW002", 2, 8)]),
    (_C + "def f(cast):\n    return cast(int, {k})\n", []),
    (_C + "def f[cast](a):\n    return cast(int, {k})\n", []),
    (_C + "def f():\n    y = cast(int, {k})\n    cast = 1\n", []),
    ("def f():\n    return cast(int, {k})\n" + _C, [("TW002", 2, 11)]),
    ("g = lambda: cast(int, {k})\n" + _C, []),
    (_C + "class A:\n    cast = None\n    x = cast(int, {k})\n    def f(self):\n        return cast(int, {k})\n", [("TW002", 6, 15)]),
    (_C + "class A:\n    cast = None\n    y = [cast(int, b) for b in [{k}]]\n", [("TW002", 4, 9)]),
    (_C + "def f():\n    global cast\n    cast = 1\ncast(int, {k}).a\n", [("TW002", 5, 0)]),
    (_C + "def f():\n    def g():\n        nonlocal cast\n        cast = 2\n    from typing import cast\n    x = cast(int, {k})\n", []),
    ("import typing\ntyping = 1\nx = typing.cast(int, {k})\n", []),
    ("import typing, typing_extensions as typing\nx = typing.cast(int, {k})\n", []),
    ("import typing.io\nx = typing.cast(int, {k})\n", []),
    (_C + "é = 'é'; x = cast(int, {k})\n", [("TW002", 2, 13)]),
    (_C + "@cast(int, {k})\nclass A(B, m=cast(int, {k})): pass\n", [("TW002", 2, 1), ("TW002", 3, 13)]),
]
#: Type-ignore comments without evidence: text, [(scope path, norm of the comment, tokens of its line, mark of a duplicate)].
IGNORES = [
    ("x = {k}  # type: ignore[b, a]\n", [("module", "type:ignore[a,b]", "NAME:x OP:= NUMBER:{k}", "")]),
    ("x = {k}  # type: ignore[a,]\n", [("module", "type:ignore:invalid-codes", "NAME:x OP:= NUMBER:{k}", "")]),
    ("def f():\n    x = {k}  # type: ignore\n", [("fn:f", "type:ignore:uncoded", "NAME:x OP:= NUMBER:{k}", "")]),
    ("class A:\n    def f(self, x=1):  # type: ignore[a]\n        return {k}\n", [("class:A", "type:ignore[a]", "NAME:def NAME:f OP:( NAME:self OP:, NAME:x OP:= NUMBER:1 OP:) OP::", "")]),
    ("class A:\n    def f(self):\n        return (  # type: ignore[a]\n            {k})\n", [("class:A@fn:f", "type:ignore[a]", "NAME:return OP:( NUMBER:{k} OP:)", "")]),
    ("# type: ignore[a]\nx = {k}\n", [("module", "type:ignore[a]", "", "")]),
    ("x = f'{{{k}}}'  # type: ignore[a] SAFETY: one\n", [("module", "type:ignore[a]", "NAME:x OP:= STRING:\"f'{{{k}}}'\"", "")]),
    ("if {k}:\n    x = 1  # type: ignore[a]\n    x = 1  # type: ignore[a]\n", [("module", "type:ignore[a]", "NAME:x OP:= NUMBER:1", "dup:2:0"), ("module", "type:ignore[a]", "NAME:x OP:= NUMBER:1", "dup:2:1")]),
    ("# SAFETY: two words\nx = {k}  # type: ignore[a]\n", []),
    ("x = [  # SAFETY: two words\n  {k},  # type: ignore[a]\n]\n", []),
]

#: Comments: text, codes of a SAFETY comment (comma-joined; null for none), does it name valid ignore codes, norm of a type-ignore comment, norm of a disable comment.
DIRECTIVES = [
    ("# SAFETY: two words", "", False, None, None),
    ("# SAFETY[TW002,\tTW003]: two words", "TW002,TW003", False, None, None),
    ("# SAFETY [ TW013 ] : two  words ", "TW013", False, None, None),
    ("# SAFETY[TW001]: two words", None, False, None, None),
    ("# SAFETY[]: two words", None, False, None, None),
    ("# SAFETY[TW002: two words", None, False, None, None),
    ("## SAFETY: two words", None, False, None, None),
    ("# SAFETY: one", None, False, None, None),
    ("# SAFETY: one-two", "", False, None, None),
    ("#SAFETY:a b", "", False, None, None),
    ("# safety: two words", None, False, None, None),
    ("# type: ignore", None, False, "type:ignore:uncoded", None),
    ("# type:ignore[b,a]", None, True, "type:ignore[a,b]", None),
    ("# type: ignore[a, b-c]  # more", None, True, "type:ignore[a,b-c]", None),
    ("# type: ignore[]", None, False, "type:ignore:invalid-codes", None),
    ("# type: ignore[a,]", None, True, "type:ignore:invalid-codes", None),
    ("# type: ignore[a b]", None, False, "type:ignore:invalid-codes", None),
    ("# type: ignored", None, False, None, None),
    ("# type: ignore[a] SAFETY: two words", None, True, "type:ignore[a]", None),
    ("# type: ignore SAFETY: two words", None, False, "type:ignore:uncoded", None),
    ("# type: ignore[a] SAFETY: one", None, False, "type:ignore[a]", None),
    ("# mypy: ignore-errors", None, False, None, "mypy:ignore-errors"),
    ("# mypy: ignore_errors = false", None, False, None, None),
    ("# mypy: Ignore-Errors=YES, strict", None, False, None, "mypy:ignore-errors"),
    ("# mypy: disable-error-code=\"b, a\"", None, False, None, "mypy:disable-error-code[a,b]"),
    ("# mypy: disable-error-code=a, ignore-errors", None, False, None, "mypy:disable-error-code[a]|mypy:ignore-errors"),
    ("# mypy: disable-error-code=\"a,\", ignore-errors", None, False, None, None),
    ("# mypy: ignore-errors,", None, False, None, "mypy:ignore-errors"),
    ("# mypy: ,ignore-errors", None, False, None, None),
    ("#mypy: ignore-errors", None, False, None, None),
    ("# mypy: strict", None, False, None, None),
    ("# pyright: basic", None, False, None, "pyright:basic"),
    ("#pyright:BASIC, standard", None, False, None, "pyright:basic|pyright:standard"),
    ("# pyright: reportFoo1 = None, strict", None, False, None, "pyright:reportFoo1=none"),
    ("# pyright: REPORTfoo=FALSE", None, False, None, "pyright:reportfoo=false"),
    ("# pyright: basic,", None, False, None, None),
    ("# pyright: strict", None, False, None, None),
    ("# nothing of the kind", None, False, None, None),
]

#: Files that cannot be analysed, and the kind of the error; null for those that can.
BROKEN = [("def (:{k}\n", "parse"), ("x = '\0{k}'\n", "encode"), ("x = {k}\n", None), ("if 1:\nx = {k}\n", "parse"), ("(" * 3000 + "{k}" + ")" * 3000, "parse"), ("", None)]

#: Contents of files: bytes, kind of the error (null: none), characters of the text.
CONTENTS = [
    (b"x = 1\n", None, 6), ("x = 'é'\n".encode(), None, 8), ("# coding: latin-1\nx = 'é'\n".encode("latin-1"), None, 26), (b"\xef\xbb\xbfx = 1\r\n", None, 7),
    (b"x = '\xff'\n", "encode", None), (b"# coding: nonsense\n", "encode", None), (b"\xef\xbb\xbf# coding: latin-1\n", "encode", None), (b"#" * 2000, "limit", None), (b"x\n" * 600, "limit", None), (b"", None, 0),
]
#: Names, and how a report shows them.
NAMES = [("plain.py", "plain.py"), ("a\tb\n.py", "a\\x09b\\x0a.py"), ("\x1b[31m\x7f\x85", "\\x1b[31m\\x7f\\x85"), ("a\u202eb\u200d\ufeff", "a\\u202eb\\u200d\\ufeff"), ("\u2028é日😀\xad", "\\u2028é日😀\\u00ad")]
