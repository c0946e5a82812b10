"""Work on a file grows as the file does: the budgets are 3.25 times the time for twice the size, 24 times for eight times the formatted strings."""

import time
from statistics import median

import pytest

from gristmill.sources.extract import file_facts

FILES = {
    "casts and ignores": lambda n: "from typing import cast\n" + "".join(f"def f{i}(x):\n    return cast(int, cast(str, x))  # type: ignore[a]\n" for i in range(n)),
    "repeated imports": lambda n: "".join(f"from typing import cast\nx{i} = cast(int, {i})\n" for i in range(n)),
    "one host of casts": lambda n: "from typing import cast\nx = [" + "".join(f"cast(int, {i}),\n" for i in range(n)) + "]\n",
    "one host of ignores": lambda n: "x = [" + "".join(f"{i},  # type: ignore[a]\n" for i in range(n)) + "]\n",
    "guards": lambda n: "from typing import TypeGuard\n" + "".join(f"def f{i}(x) -> TypeGuard[int]: return True\n" for i in range(n)),
    "type variables": lambda n: "from typing import TypeVar, cast\n" + "".join(f"T{i} = TypeVar('T{i}')\nx{i} = cast(T{i}, {i})\n" for i in range(n)),
    "comment run": lambda n: "from typing import cast\n" + "# a comment\n" * n + "x = cast(int, 1)\n" * (n // 10),
    "formatted strings": lambda n: "".join(f"x{i} = f'{{a{i}!r:>{{w}}}} and {{b}}'  # type: ignore[a]\n" for i in range(n)),
    "one long line": lambda n: "from typing import cast\nx = ['é', " + ", ".join(f"cast(int, {i})" for i in range(n)) + "]\n",
    "nested scopes": lambda n: "from typing import cast\n" + "".join(f"class A{i}:\n    def f(self):\n        return [cast(int, y) for y in self.z]\n" for i in range(n)),
}


def seconds(text):
    def once():
        began = time.process_time()
        assert all(r["fact"] != "error" for r in file_facts(text))
        return time.process_time() - began

    return median(once() for _ in range(3))


@pytest.mark.parametrize("name", sorted(FILES))
def test_time_follows_size(name):
    took = [seconds(FILES[name](n)) for n in (500, 1000, 2000)]
    print(name, [round(b / a, 2) for a, b in zip(took, took[1:], strict=False)], [round(t, 3) for t in took])
    assert all(b <= 3.25 * a + 0.02 for a, b in zip(took, took[1:], strict=False)), took


def test_eight_times_the_formatted_strings():
    assert seconds(FILES["formatted strings"](2000)) <= 24 * seconds(FILES["formatted strings"](250))
