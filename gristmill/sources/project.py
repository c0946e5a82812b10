"""Where a project begins, its paths, and its settings."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from ..plans.catalog import CODES, DEFAULT

#: The table of pyproject.toml that holds the settings.
TABLE = "gristmill"
#: Output formats, settings by their names in the file, limits.
FORMATS = ("text", "json", "sarif", "pretty", "github")
DEFAULT_BYTES, MOST_BYTES = 1_048_576, 4_194_304
MOST_SETTINGS_BYTES, MOST_PARENTS = 1_048_576, 25


class ProjectError(ValueError):
    """What a user can mend: a path, a setting, an argument."""


@dataclass(frozen=True)
class Project:
    root: Path
    settings_path: Path

    def canonical(self, path: str | Path) -> str:
        """A path from the root, with slashes."""
        try:
            return (Path.cwd() / path).resolve().relative_to(self.root).as_posix()
        except ValueError as e:
            raise ProjectError(f"path is outside the project root: {path}") from e

    def resolve(self, canonical: str) -> Path:
        if Path(canonical).is_absolute():
            raise ProjectError(f"path is outside the project root: {canonical}")
        return self.root / self.canonical(self.root / canonical)


def discover_project(start: str | Path) -> Project:
    """The nearest folder at or above start with a pyproject.toml: inside a git work tree up to its top, else 25 levels up."""
    start = Path(start).resolve()
    folders = [start.parent, *start.parent.parents] if start.is_file() else [start, *start.parents]
    top = next((k for k, f in enumerate(folders) if (f / ".git").exists()), None)
    for folder in folders[: top + 1 if top is not None else MOST_PARENTS + 1]:
        if (folder / "pyproject.toml").is_file():
            return Project(folder, folder / "pyproject.toml")
    where = "at or below the git root for" if top is not None else "in any ancestor of"
    raise ProjectError(f"no pyproject.toml found {where} {start}")


def resolve_project(cwd: Path, config: str | Path | None, inputs: list[str]) -> Project:
    """The project of a command line: that of --config, else of the working folder, else the one all inputs are in."""
    if config is not None:
        path = Path(config)
        if path.is_file() and path.name != "pyproject.toml":
            raise ProjectError("--config must point to pyproject.toml")
        return Project(path.resolve().parent, path.resolve()) if path.is_file() else discover_project(path)
    try:
        return discover_project(cwd)
    except ProjectError:
        if not inputs:
            raise
    found = {p.root: p for p in (discover_project(cwd / i) for i in inputs)}
    if len(found) > 1:
        raise ProjectError("input paths span multiple project roots")
    return next(iter(found.values()))


@dataclass(frozen=True)
class Settings:
    """Null fields are not said; ``overlaid`` fills them from what was said before."""

    select: frozenset[str] | None = None
    ignore: frozenset[str] | None = None
    exclude: tuple[str, ...] | None = None
    output_format: str | None = None
    baseline: str | None = None
    max_file_bytes: int | None = None


DEFAULTS = Settings(frozenset(DEFAULT), frozenset(), (), "text", None, DEFAULT_BYTES)


def rule_codes(value: object, name: str) -> frozenset[str]:
    if not isinstance(value, (list, tuple, set, frozenset)) or not all(isinstance(c, str) for c in value):
        raise ProjectError(f"{name} must be a list of rule codes")
    for code in value:
        if code not in CODES:
            raise ProjectError(f"unknown rule code in {name}: {code!r}")
    return frozenset(value)


def rule_list(values: list[str] | None) -> frozenset[str] | None:
    """Codes of a repeated option whose values may hold several, with commas between them."""
    return None if values is None else frozenset(part.strip() for v in values for part in v.split(",") if part.strip())


def file_bytes(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ProjectError("max-file-bytes must be a positive integer")
    if value > MOST_BYTES:
        raise ProjectError(f"max-file-bytes exceeds maximum ({MOST_BYTES})")
    return value


def _patterns(value: object, name: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(p, str) for p in value):
        raise ProjectError(f"{name} must be a list of path patterns")
    return tuple(value)


def _string(value: object, name: str) -> str:
    if not isinstance(value, str):
        raise ProjectError(f"{name} must be a string")
    return value


def output_format(value: object, name: str = "output-format") -> str:
    if _string(value, name) not in FORMATS:
        raise ProjectError(f"unknown output format: {value!r}")
    return value


_READ = {
    "select": rule_codes, "ignore": rule_codes, "exclude": _patterns, "output-format": output_format, "baseline": _string,
    "max-file-bytes": lambda value, _: file_bytes(value),
}


def parse_settings(text: str, table: str = TABLE) -> Settings:
    """Settings of the text of a pyproject.toml."""
    try:
        tool = tomllib.loads(text).get("tool")
    except RecursionError as e:
        raise ProjectError("malformed pyproject.toml: excessive nesting") from e
    except tomllib.TOMLDecodeError as e:
        raise ProjectError(f"malformed pyproject.toml: {e}") from e
    if tool is not None and not isinstance(tool, dict):
        raise ProjectError("[tool] must be a table")
    for key in tool or ():
        if key.startswith(f"{table}."):
            raise ProjectError(f"unknown configuration table: tool.{key}")
    said = (tool or {}).get(table)
    if said is None:
        return Settings()
    if not isinstance(said, dict):
        raise ProjectError(f"[tool.{table}] must be a table")
    for key in said:
        if key not in _READ:
            raise ProjectError(f"unknown configuration key: {key!r}")
    return Settings(**{key.replace("-", "_"): _READ[key](value, key) for key, value in said.items()})


def bounded_text(path: Path, most: int, label: str) -> str:
    """A small UTF-8 file; links are refused."""
    try:
        if path.is_symlink():
            raise ProjectError(f"{label} must not be a symlink: {path}")
        with open(path, "rb") as f:
            content = f.read(most + 1)
    except OSError as e:
        raise ProjectError(f"cannot read {label}: {path}") from e
    if len(content) > most:
        raise ProjectError(f"{label} exceeds maximum size ({most} bytes): {path}")
    try:
        return content.decode()
    except UnicodeDecodeError as e:
        raise ProjectError(f"{label} is not valid UTF-8: {path}") from e


def load_settings(project: Project, table: str = TABLE) -> Settings:
    return parse_settings(bounded_text(project.settings_path, MOST_SETTINGS_BYTES, "pyproject.toml"), table)


def overlaid(*layers: Settings) -> Settings:
    """Field by field the last layer that says something; lists replace each other."""
    out = DEFAULTS
    for layer in layers:
        said = {f.name: v for f in fields(layer) if (v := getattr(layer, f.name)) is not None}
        for name in ("select", "ignore"):
            if name in said:
                said[name] = rule_codes(said[name], name)
        if "max_file_bytes" in said:
            said["max_file_bytes"] = file_bytes(said["max_file_bytes"])
        out = replace(out, **said)
    return out


def effective_format(settings: Settings, *said: Settings, terminal: bool) -> str:
    """The pretty format on a terminal, if no layer names one."""
    return "pretty" if terminal and all(s.output_format is None for s in said) else settings.output_format


def exit_code(*, findings: bool, errors: bool, usage: bool = False) -> int:
    """3 for a wrong use, else 2 for files that could not be analysed, else 1 for findings, else 0."""
    return 3 if usage else 2 if errors else 1 if findings else 0


def anchor(heading: str) -> str:
    """A heading as the target of a link: lower case, blanks to dashes, other signs left out."""
    return re.sub(r"[^\w-]", "", heading.lower().replace(" ", "-"))
