"""Findings and errors as text: lines, JSON, SARIF, a terminal's page, a pull request's comment, a linter's tuples.

Lines are DataFrames. A document is one file by nature, so its rows come to the driver, in order, one partition
at a time. ``tool`` is the name that stands in documents and ``home`` the address of the manual.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans import catalog as C
from ..sources.project import anchor
from .findings import ordered
from .lines import CAP, escape, escaped

#: Names and versions of the formats.
SARIF, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"


@dataclass(frozen=True)
class Tool:
    name: str = "gristmill"
    title: str = "Gristmill"
    version: str = "0.2.0"
    home: str = "https://example.org/gristmill"

    def manual(self, code: str) -> str:
        return f"{self.home}#{anchor(C.heading(code))}"

    @property
    def marker(self) -> str:
        return f"<!-- {self.name}-report -->"


TOOL = Tool()
_KEYS = {"code": "code", "path": "path", "line": "line", "column": "col", "end_line": "end_line", "end_column": "end_col", "message": "message", "fingerprint": "fingerprint"}


def _place(path: Column | str = "path") -> Column:
    return F.concat(escaped(F.col("path")), F.lit(":"), F.col("line"), F.lit(":"), F.col("col") + 1)


def text_lines(rows: DataFrame) -> DataFrame:
    """value: path:line:column: CODE message (columns from 1), in order."""
    return ordered(rows).select(F.concat(_place(), F.lit(": "), F.col("code"), F.lit(" "), escaped(F.col("message"))).alias("value"))


def error_lines(errors: DataFrame) -> DataFrame:
    """value: path: kind: message, a dash for no path."""
    path = F.when(F.col("path").isNull(), "-").otherwise(escaped(F.col("path")))
    return ordered_errors(errors).select(F.concat(path, F.lit(": "), escaped(F.col("kind")), F.lit(": "), escaped(F.col("message"))).alias("value"))


def ordered_errors(errors: DataFrame) -> DataFrame:
    return errors.orderBy(F.coalesce("path", F.lit("")), "kind", "message")


def json_lines(rows: DataFrame) -> DataFrame:
    """value: one object a finding, keys sorted."""
    return ordered(rows).select(F.to_json(F.struct(*[F.col(_KEYS[k]).alias(k) for k in sorted(_KEYS)])).alias("value"))


def linter_rows(rows: DataFrame) -> DataFrame:
    """line, column (from 0), text by line, column and code, as linters take them."""
    return rows.orderBy("line", "col", "code").select("line", F.col("col").alias("column"), F.concat_ws(" ", "code", "message").alias("text"))


def sarif_results(rows: DataFrame) -> DataFrame:
    """value: one SARIF result a finding."""
    level = F.when(F.col("code").isin(C.EXPERIMENTAL), "note").otherwise("warning")
    region = F.struct((F.col("end_col") + 1).alias("endColumn"), F.col("end_line").alias("endLine"), (F.col("col") + 1).alias("startColumn"), F.col("line").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri"), F.lit("SRCROOT").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        level.alias("level"), F.array(place).alias("locations"), F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias("value")).alias("partialFingerprints"), F.col("code").alias("ruleId"),
    )
    return ordered(rows).select(F.to_json(result).alias("value"))


def _dumped(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True) + "\n"


def json_document(rows: DataFrame, errors: DataFrame, tool: Tool = TOOL) -> str:
    return _dumped({
        "schema": f"{tool.name}-json-1", "tool": tool.name, "version": tool.version,
        "findings": [{k: r[v] for k, v in _KEYS.items()} for r in ordered(rows).toLocalIterator()],
        "errors": [{k: e[k] for k in ("kind", "path", "message")} for e in ordered_errors(errors).toLocalIterator()],
    })


def sarif_document(rows: DataFrame, errors: DataFrame, tool: Tool = TOOL) -> str:
    def artifact(path: str) -> dict:
        return {"artifactLocation": {"uri": path, "uriBaseId": "SRCROOT"}}

    def rule(r: tuple) -> dict:
        code, name, default, summary = r[0], r[1], r[2], r[6]
        return {
            "id": code, "name": name, "shortDescription": {"text": summary}, "helpUri": tool.manual(code), "defaultConfiguration": {"level": C.level(code)},
            "properties": {"tags": ["experimental"] if code in C.EXPERIMENTAL else [], "defaultEnabled": default},
        }

    results = []
    for r in sarif_results(rows).toLocalIterator():
        result = json.loads(r.value)
        result["partialFingerprints"] = {f"{tool.name}/v1": result["partialFingerprints"]["value"]}
        results.append(result)
    notes = [
        {"level": "error", "descriptor": {"id": e.kind}, "message": {"text": e.message}, **({"locations": [{"physicalLocation": artifact(e.path)}]} if e.path is not None else {})}
        for e in ordered_errors(errors).toLocalIterator()
    ]
    driver = {"name": tool.name, "version": tool.version, "semanticVersion": tool.version, "informationUri": tool.home, "rules": [rule(r) for r in C.RULES]}
    run = {
        "columnKind": "unicodeCodePoints", "originalUriBaseIds": {"SRCROOT": {"uri": "file:///src/"}}, "tool": {"driver": driver}, "results": results,
        "invocations": [{"executionSuccessful": not notes, "toolExecutionNotifications": notes}],
    }
    return _dumped({"$schema": SARIF_SCHEMA, "version": SARIF, "runs": [run]})


def _headline(found: list[Row], tool: Tool) -> str:
    files = len({r.path for r in found})
    return f"{tool.title} found {len(found)} finding{'s' * (len(found) != 1)} in {files} file{'s' * (files != 1)}"


def _by_rule(found: Iterable[Row]) -> dict[str, list[Row]]:
    groups: dict[str, list[Row]] = {}
    for r in found:
        groups.setdefault(r.code, []).append(r)
    return {c: groups[c] for c in C.CODES if c in groups}


def _snippet(s: Row) -> Iterator[tuple[str, str, bool]]:
    """Number (aligned), escaped line, and is it the one, of each line."""
    width = len(str(s.start + len(s.lines) - 1))
    for k, line in enumerate(s.lines):
        yield f"{s.start + k:>{width}}", escape(line), k + 1 == s.at


def _summary(code: str) -> str:
    return C.RULES[C.CODES.index(code)][6]


def _at(r: Row) -> str:
    return f"{escape(r.path)}:{r.line}:{r.col + 1}"


def pretty_page(rows: DataFrame, tool: Tool = TOOL) -> str:
    """For a terminal: findings by rule, with the lines around them (rows with snippet; see ``lines.snippets``)."""
    found = list(ordered(rows).toLocalIterator())
    if not found:
        return ""
    out = [_headline(found, tool)]
    for code, group in _by_rule(found).items():
        out += [f"{code}  {len(group)}" + "  (experimental)" * (code in C.EXPERIMENTAL), f"  {tool.manual(code)}", ""]
        for r in group:
            out += [f"{_at(r)}  {code}  {escape(r.message)}", f"  {_summary(code)}"]
            for number, line, here in _snippet(r.snippet) if r.snippet else ():
                out.append(f"    {number} | {line}")
                if here:
                    before = len(escape(r.snippet.lines[r.snippet.at - 1][: r.snippet.column]))
                    out.append(" " * (7 + len(number) + min(before, len(line))) + "^")
            out += [f"  {C.hint(code)}"] * (C.hint(code) is not None) + [""]
    return "\n".join(out).rstrip("\n") + "\n"


def pull_request_page(rows: DataFrame, errors: DataFrame, tool: Tool = TOOL, compare: str | None = None, cap: int = CAP) -> str:
    """Markdown for a comment: a table of counts, the first findings in full, the rest in a line each, then the errors."""
    found, failed = list(ordered(rows).toLocalIterator()), list(ordered_errors(errors).toLocalIterator())
    if not found and not failed:
        return f"{tool.marker}\n\n{tool.title} found 0 findings.\n"
    out = [tool.marker, ""]

    def place(r: Row) -> str:
        return _at(r) if compare is None else f"[{_at(r)}]({compare}/{r.path}#L{r.line})"

    if found:
        out += [f"{_headline(found, tool)}.", "", "| Rule | Count |", "| --- | ---: |"]
        out += [f"| [{c}]({tool.manual(c)}) | {len(g)} |" for c, g in _by_rule(found).items()] + [""]
        for code, group in _by_rule(found[:cap]).items():
            new = " (experimental)" * (code in C.EXPERIMENTAL)
            out += ["<details>", f"<summary>{code}{new}</summary>", ""]
            for r in group:
                out += [f"**{place(r)}** `{code}` {escape(r.message)}{new}", "", escape(_summary(code)), ""]
                if r.snippet:
                    out += ["```", *(f"{'>' if here else ' '}{number} | {line}" for number, line, here in _snippet(r.snippet)), "```", ""]
                out += [f"`{C.hint(code)}`", ""] if C.hint(code) else []
            out += ["</details>", ""]
        if found[cap:]:
            out += [f"And {len(found) - cap} more:", ""]
            for r in found[cap:]:
                said = f"`{r.code}` {escape(r.message)}"
                out.append(f"- `{_at(r)}: {r.code} {escape(r.message)}`" if compare is None else f"- {place(r)}: {said}")
            out.append("")
    if failed:
        out += ["## Analysis errors", "", *(f"- `{escape(e.path) if e.path is not None else '-'}`: **{e.kind}**: {escape(e.message)}" for e in failed)]
    return "\n".join(out).rstrip("\n") + "\n"
