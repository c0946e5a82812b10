"""The audit as a linter's plugin: one file, given as a tree and its lines, to (line, column, text, type).

A host that knows plugins of this form makes one for each file and reads ``run``. Findings come by line, column
and code; a setting or path that is wrong comes as one of its own at the start of the file; a file that cannot be
analysed gives nothing, for the host says so itself. It starts a local Spark session for a process, so it is for
the file at hand; collections go through ``analyze``.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence
from pathlib import Path

from . import analyze
from .operators.reports import TOOL, linter_rows
from .sources import project as P
from .sources.reading import is_excluded

#: Fixed value: the code of a problem with the settings.
PROBLEM = "TW000"
_SETTINGS: dict[tuple[int, int], P.Settings] = {}


def _settings(project: P.Project) -> P.Settings:
    """Settings of a project, read once as long as its file is the same."""
    stat = project.settings_path.stat()
    key = (stat.st_dev, stat.st_ino)
    if key not in _SETTINGS:
        _SETTINGS[key] = P.overlaid(P.load_settings(project))
    return _SETTINGS[key]


class Plugin:
    name, version = TOOL.name, TOOL.version

    def __init__(self, tree: ast.AST | None, filename: str, lines: Sequence[str]) -> None:
        self.tree, self.filename, self.lines = tree, filename, lines

    def _place(self) -> tuple[str, P.Settings]:
        """The file's path in its project, and the settings there; a name alone outside of one."""
        path = Path(self.filename)
        if self.filename == "-":
            return "stdin", P.DEFAULTS
        if path.is_symlink():
            raise P.ProjectError(f"symlink inputs are not supported: {self.filename}")
        try:
            project = P.discover_project(path if path.is_absolute() else Path.cwd())
        except P.ProjectError:
            return path.name if path.is_absolute() else path.as_posix(), P.DEFAULTS
        return project.canonical(path), _settings(project)

    def run(self) -> Iterator[tuple[int, int, str, type]]:
        if self.tree is None or not self.lines:
            return
        try:
            path, settings = self._place()
        except (ValueError, OSError) as e:
            yield 1, 0, f"{PROBLEM} {e}", Plugin
            return
        if is_excluded(path, settings.exclude) and settings.exclude:
            return
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        source = spark.createDataFrame([(path, "".join(self.lines))], "path string, text string")
        for r in linter_rows(analyze(source, settings.select, settings.ignore)[0]).collect():
            yield r.line, r.column, r.text, Plugin
