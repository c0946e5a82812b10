"""The audit from a command line: ``python -m gristmill [paths]``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import analyze
from .operators import findings as O
from .operators import lines, reports
from .sources import baseline, git, reading
from .sources import project as P


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill", description="Where a person overrode the type checker without a written reason")
    p.add_argument("paths", nargs="*", help="files or folders; the whole project by default")
    p.add_argument("--config", help="path to pyproject.toml")
    p.add_argument("--format", choices=P.FORMATS, dest="output_format")
    p.add_argument("--select", action="append", help="rules to run, with commas between them")
    p.add_argument("--ignore", action="append", help="rules not to run")
    p.add_argument("--exclude", action="append", help="path patterns to leave out")
    p.add_argument("--baseline", help="findings that are known already")
    p.add_argument("--write-baseline", action="store_true")
    p.add_argument("--max-file-bytes", type=int)
    one = p.add_mutually_exclusive_group()
    one.add_argument("--staged", action="store_true")
    one.add_argument("--worktree", action="store_true")
    one.add_argument("--diff-ref")
    return p


def said(args: argparse.Namespace) -> P.Settings:
    """What the command line says."""
    return P.Settings(
        P.rule_list(args.select), P.rule_list(args.ignore), tuple(args.exclude) if args.exclude else None, args.output_format, args.baseline,
        None if args.max_file_bytes is None else P.file_bytes(args.max_file_bytes),
    )


def audit(spark: SparkSession, project: P.Project, settings: P.Settings, inputs: list[str], selection: git.Selection | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, errors and sources(path, text) of a project's files, of changed lines alone with a selection."""
    changed, failed = git.changed_lines(project, selection, settings.max_file_bytes) if selection else (None, [])
    paths = git.changed_files(project, changed, inputs, settings.exclude) if selection else reading.discover(project, inputs, settings.exclude)
    files, large = reading.read_files(spark, project, paths, settings.max_file_bytes)
    found, wrong = analyze(files, settings.select, settings.ignore, settings.max_file_bytes)
    errors = spark.createDataFrame(failed, "path string, kind string, message string").unionByName(large).unionByName(wrong)
    if selection:
        found = O.on_changed_lines(found, git.line_table(spark, changed))
    return found, errors, reading.texts(files, settings.max_file_bytes)


def _compare() -> str | None:
    """Where files can be looked at, in a build of a hosting service."""
    repository, commit = os.environ.get("GITHUB_REPOSITORY"), os.environ.get("GITHUB_PR_SHA") or os.environ.get("GITHUB_SHA")
    return f"https://github.com/{repository}/blob/{commit}" if repository and commit else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 3
    try:
        project = P.resolve_project(Path.cwd(), args.config, args.paths)
        layers = (P.load_settings(project), said(args))
        settings = P.overlaid(*layers)
        form = P.effective_format(settings, *layers, terminal=sys.stdout.isatty())
        if args.write_baseline and settings.baseline is None:
            raise P.ProjectError("--write-baseline requires --baseline or a baseline setting")
        mode = "staged" if args.staged else "worktree" if args.worktree else "diff-ref" if args.diff_ref is not None else None
        spark = spark or SparkSession.builder.appName("gristmill").getOrCreate()
        found, errors, sources = audit(spark, project, settings, args.paths, git.Selection(mode, args.diff_ref) if mode else None)
        errors = errors.cache()
        failed = not errors.isEmpty()
        if args.write_baseline:
            if not failed:
                baseline.write_baseline(project, project.resolve(settings.baseline), baseline.render_baseline(O.baseline_of(found)))
                found = found.limit(0)
        elif settings.baseline is not None:
            found = O.minus_baseline(found, baseline.load_baseline(spark, project.resolve(settings.baseline)))
        found = found.cache()
        if form in ("json", "sarif"):
            sys.stdout.write((reports.json_document if form == "json" else reports.sarif_document)(found, errors))
        elif form in ("pretty", "github") and not args.write_baseline:
            shown = lines.snippets(found, sources)
            sys.stdout.write(reports.pretty_page(shown) if form == "pretty" else reports.pull_request_page(shown, errors, compare=_compare()))
        elif not args.write_baseline:
            sys.stdout.writelines(f"{r.value}\n" for r in reports.text_lines(found).toLocalIterator())
        if failed and form not in ("json", "sarif"):
            sys.stderr.writelines(f"{r.value}\n" for r in reports.error_lines(errors).toLocalIterator())
        return P.exit_code(findings=not args.write_baseline and not found.isEmpty(), errors=failed)
    except (ValueError, OSError) as e:
        sys.stderr.write(f"{lines.escape(str(e))}\n")
        return 3


if __name__ == "__main__":
    sys.exit(main())
