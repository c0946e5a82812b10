import json
import subprocess

import pytest

from gristmill.__main__ import main
from gristmill.operators import lines as L
from gristmill.operators import reports as R
from gristmill.sources import baseline as B
from gristmill.sources import git as G
from gristmill.sources import project as P
from gristmill.sources import reading

CAST = "from typing import cast\n\nvalue = cast(int, 1)\n"


def project(folder, settings="", **files):
    (folder / "pyproject.toml").write_text(settings)
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_py", ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return P.discover_project(folder)


DIFFS = [
    ("", {}),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n", {"x": {1, 2}}),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@ def f\n a\n+b\n a\n a\n@@ -9 +10,0 @@\n-z\n", {"x": {2}}),
    ("diff --git a/x b/x\ndeleted file mode 100644\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n", {}),
    ("diff --git a/x b/x\nnew file mode 100644\n--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+a\n\\ No newline at end of file\n", {"x": {1}}),
    ("diff --git a/x b/y\nsimilarity index 90%\nrename from x\nrename to y\n--- a/x\n+++ b/y\n@@ -2 +2 @@\n-a\n+b\n", {"y": {2}}),
    ("diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n", {"y": set()}),
    ("diff --git a/x b/x\nold mode 100644\nnew mode 100755\n", {"x": set()}),
    ("diff --git a/x b/x\nBinary files a/x and b/x differ\n", {"x": set()}),
    ("diff --git a/a b.py b/a b.py\n--- a/a b.py\t\n+++ b/a b.py\t\n@@ -0,0 +3 @@\n+x\n", {"a b.py": {3}}),
    ('diff --git "a/\\303\\251\\t.py" "b/\\303\\251\\t.py"\n--- "a/\\303\\251\\t.py"\n+++ "b/\\303\\251\\t.py"\n@@ -0,0 +1 @@\n+x\n', {"é\t.py": {1}}),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n--- a/y\n-b\n+++ b/y\n+@@ -1 +1 @@\n", {"x": {1, 2}}),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n", None),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+c\n", None),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\ndiff --git a/y b/y\n", None),
    ("@@ -1 +1 @@\n-a\n+b\n", None),
    ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ bad @@\n", None),
]


@pytest.mark.parametrize("text, want", DIFFS)
def test_diffs(text, want):
    if want is None:
        with pytest.raises(G.DiffError):
            G.parse_diff(text)
    else:
        assert G.parse_diff(text) == want


def git(folder, *args):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=folder, check=True, capture_output=True)


def test_changed_lines_of_a_repository(tmp_path):
    p = project(tmp_path, a_py="x = 1\ny = 2\n", build__b_py="x\n", c_txt="x\n")
    git(tmp_path, "init", "-q")
    assert G.changed_lines(p, G.Selection("worktree"))[0] == {"a.py": {1, 2}, "build/b.py": {1}}
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "first")
    (tmp_path / "a.py").write_text("x = 1\nz = 3\ny = 2\nw = 4\n")
    (tmp_path / "é new.py").write_text("one\ntwo\r\nthree\x0c\n")
    (tmp_path / "bad.py").write_bytes(b"# coding: nonsense\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    changed, errors = G.changed_lines(p, G.Selection("worktree"))
    assert changed == {"a.py": {2, 4}, "é new.py": {1, 2, 3}} and [e[:2] for e in errors] == [("bad.py", "encode")]
    assert G.changed_lines(p, G.Selection("staged"))[0] == {}
    git(tmp_path, "add", "a.py")
    assert G.changed_lines(p, G.Selection("staged"))[0] == {"a.py": {2, 4}} == G.changed_lines(p, G.Selection("diff-ref", "HEAD"))[0]
    assert G.changed_files(p, changed) == ["a.py", "é new.py"] and G.changed_files(p, changed, [str(tmp_path / "a.py"), str(tmp_path)]) == ["a.py", "é new.py"]
    assert G.changed_files(p, changed, excludes=("a.py",)) == ["é new.py"]
    for bad in (("diff-ref", "-x"), ("diff-ref", None), ("staged", "HEAD"), ("other", None)):
        with pytest.raises(P.ProjectError):
            G.Selection(*bad)
    with pytest.raises(G.DiffError):
        G.changed_lines(p, G.Selection("diff-ref", "nothing"))


def test_discovery(tmp_path, monkeypatch):
    p = project(tmp_path, b_py="", a__z_py="", a__m_pyi="", build__x_py="", a__dist__y_py="", t__test_x_py="", note_txt="")
    (tmp_path / "a" / "link.py").symlink_to(tmp_path / "b.py")
    monkeypatch.chdir(tmp_path)
    assert reading.discover(p) == ["a/m.pyi", "a/z.py", "b.py", "t/test_x.py"]
    assert reading.discover(p, ["b.py", "a", "b.py"]) == ["b.py", "a/m.pyi", "a/z.py"]
    assert reading.discover(p, [], ["./t/", " *.pyi "]) == ["a/z.py", "b.py"] and reading.discover(p, [], ["?/z*", "b.py"]) == ["a/m.pyi", "t/test_x.py"]
    for bad in ("none", "/tmp", "a/link.py"):
        with pytest.raises(P.ProjectError):
            reading.discover(p, [bad])


def test_exclusion_is_one_for_columns_and_paths(spark):
    paths = ["a.py", "a/b.py", "x/.git/a.py", "build", "src/test_a.py", "src/a[1].py", "src/é.py", "docs/a/b/c.py", "a/b", "xa/b"]
    patterns = ["a", "src/test_*", "*[[]1]*", "d?cs", "./x/", "é.py", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for k in range(len(patterns) + 1):
        got = {r[0] for r in df.where(reading.excluded(df.p, patterns[:k])).collect()}
        assert got == {p for p in paths if reading.is_excluded(p, patterns[:k])}, patterns[:k]


def test_reading(spark, tmp_path):
    p = project(tmp_path, a_py="x = 1\n", latin_py="# coding: latin-1\nx = 'é'\n".encode("latin-1"), bom_py=b"\xef\xbb\xbfx = 1\n", bad_py=b"\xff", big_py="#" * 100, empty_py="")
    paths = [*reading.discover(p), "sp ace+%.py"]
    (tmp_path / "sp ace+%.py").write_text("y = 2\n")
    files, large = reading.read_files(spark, p, paths, 60)
    assert [(r.path, r.kind) for r in large.collect()] == [("big.py", "limit")]
    got = {r.path: r.text for r in reading.texts(files, 60).collect()}
    assert got == {"a.py": "x = 1\n", "latin.py": "# coding: latin-1\nx = 'é'\n", "bom.py": "x = 1\n", "sp ace+%.py": "y = 2\n"}  # Spark leaves out files without a byte, in which there is nothing to find
    assert reading.decode("a", b"\xff")[1][0] == "encode" and reading.decode("a", b"x\n" * 5, max_lines=4)[1][0] == "limit"
    assert [reading.line_count(t) for t in ("", "a", "a\n", "a\r\nb", "a\rb\r", "\n\r", "a\x0cb\x0b\x85 ")] == [0, 1, 1, 2, 2, 2, 1]
    assert reading.declared_encoding(b"# coding: latin-1\n") == "iso8859-1" and reading.read_files(spark, p, [])[0].count() == 0


def test_projects(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    with pytest.raises(P.ProjectError):
        P.discover_project(inner)
    (tmp_path / "pyproject.toml").write_text("")
    assert P.discover_project(inner).root == tmp_path
    (tmp_path / "a" / ".git").mkdir()
    with pytest.raises(P.ProjectError):
        P.discover_project(inner)  # not above the top of a work tree
    p = P.resolve_project(inner, tmp_path / "pyproject.toml", [])
    assert p.root == tmp_path and p.canonical(inner) == "a/b" and p.resolve("a/../c") == tmp_path / "c"
    for bad in ("../x", "/etc"):
        with pytest.raises(P.ProjectError):
            p.resolve(bad)
    with pytest.raises(P.ProjectError):
        P.resolve_project(inner, None, [])


def test_settings():
    said = P.parse_settings('[tool.gristmill]\nselect = ["TW001", "TW005"]\nignore = []\nexclude = ["a", "b"]\noutput-format = "json"\nbaseline = "b.json"\nmax-file-bytes = 10\n')
    assert said == P.Settings(frozenset({"TW001", "TW005"}), frozenset(), ("a", "b"), "json", "b.json", 10)
    assert P.overlaid(said, P.Settings(exclude=("c",), ignore=frozenset({"TW002"}))).exclude == ("c",) and P.overlaid() == P.DEFAULTS
    assert P.parse_settings("") == P.Settings() == P.parse_settings("[tool.other]\n")
    assert P.rule_list(["TW001, TW002,", " "]) == {"TW001", "TW002"} and P.rule_list(None) is None
    for bad in ('[tool]\ngristmill = 1\n', "tool = 1\n", "x", '[tool.gristmill]\nother = 1\n', '[tool.gristmill]\nselect = ["TW1"]\n', '[tool.gristmill]\nselect = "TW001"\n', "[tool.gristmill]\nmax-file-bytes = true\n",
                "[tool.gristmill]\nmax-file-bytes = 99999999\n", '[tool.gristmill]\noutput-format = "xml"\n', "[tool.gristmill]\nbaseline = 1\n", '[tool."gristmill.x"]\na = 1\n', "[tool.gristmill]\nexclude = [1]\n"):
        with pytest.raises(P.ProjectError):
            P.parse_settings(bad)
    assert [P.exit_code(findings=f, errors=e, usage=u) for f, e, u in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1))] == [0, 1, 2, 3]
    assert P.effective_format(P.DEFAULTS, P.Settings(), terminal=True) == "pretty" and P.effective_format(P.DEFAULTS, P.Settings(output_format="text"), terminal=True) == "text"


def test_baseline_documents(spark, tmp_path):
    entries = [{"fingerprint": "0" * 16, "code": "TW002", "path": "a.py", "count": 2}, {"fingerprint": "f" * 16, "code": "TW003", "path": "b.py", "count": 1}]
    text = B.render_baseline(B.entry_table(spark, reversed(entries)))
    assert B.parse_baseline(text) == entries and text.endswith("}\n")
    good = json.loads(text)
    for change in ({"entries": 1}, {"schema": "x"}, {"fingerprint_schema": 1}, {"more": 1}, {"entries": [*entries, entries[0]]}, *({"entries": [entries[0] | c]} for c in ({"count": 0}, {"count": True}, {"count": 1.0}, {"count": 10**7}, {"path": "../a"}, {"path": 1}, {"code": "x"}, {"fingerprint": "0"}, {"x": 1}))):
        with pytest.raises(P.ProjectError):
            B.parse_baseline(json.dumps(good | change))
    for bad in ("[", "[]", '{"schema": "gristmill-baseline-1"}', "[" * 100_000):
        with pytest.raises(P.ProjectError):
            B.parse_baseline(bad)
    p = project(tmp_path)
    B.write_baseline(p, tmp_path / "b.json", text)
    (tmp_path / "b.json").chmod(0o640)
    B.write_baseline(p, tmp_path / "b.json", text)
    assert (tmp_path / "b.json").read_text() == text and (tmp_path / "b.json").stat().st_mode & 0o777 == 0o640 and len(list(tmp_path.iterdir())) == 2
    assert B.load_baseline(spark, tmp_path / "b.json").count() == 2
    (tmp_path / "l.json").symlink_to(tmp_path / "b.json")
    for bad in (tmp_path / "l.json", tmp_path.parent / "x.json", tmp_path / "no" / "b.json"):
        with pytest.raises(P.ProjectError):
            B.write_baseline(p, bad, text)


@pytest.fixture(scope="module")
def report(spark):
    found = [("TW002", "b.py", 3, 8, 3, 20, "cast call missing SAFETY evidence", "a" * 16), ("TW001", "b.py", 3, 8, 3, 20, "nested typing.cast call", "b" * 16), ("TW012", "a\n.py", 1, 0, 1, 1, "mock patch call missing explicit fidelity decision", "c" * 16)]
    rows = spark.createDataFrame(found, "code string, path string, line int, col int, end_line int, end_col int, message string, fingerprint string")
    errors = spark.createDataFrame([("z.py", "parse", "bad\x1b"), (None, "limit", "x")], "path string, kind string, message string")
    sources = spark.createDataFrame([("b.py", "1\r\n2\n3​       " + "x" * 200 + "\n4\n5\n6")], "path string, text string")
    return L.snippets(rows, sources), errors


def test_lines_of_a_report(report):
    rows, errors = report
    assert [r.value for r in R.text_lines(rows).collect()] == [
        "a\\x0a.py:1:1: TW012 mock patch call missing explicit fidelity decision", "b.py:3:9: TW001 nested typing.cast call", "b.py:3:9: TW002 cast call missing SAFETY evidence",
    ]
    assert [r.value for r in R.error_lines(errors).collect()] == ["-: limit: x", "z.py: parse: bad\\x1b"]
    assert [tuple(r) for r in R.linter_rows(rows).collect()][0] == (1, 0, "TW012 mock patch call missing explicit fidelity decision")
    assert L.escape("a\x7f\x85 ‮﻿é") == "a\\x7f\\x85\\u2028\\u202e\\ufeffé"


def test_documents(report):
    rows, errors = report
    data = json.loads(R.json_document(rows, errors))
    assert [f["code"] for f in data["findings"]] == ["TW012", "TW001", "TW002"] and data["findings"][1] == {"code": "TW001", "path": "b.py", "line": 3, "column": 8, "end_line": 3, "end_column": 20, "message": "nested typing.cast call", "fingerprint": "b" * 16}
    assert data["errors"][0] == {"kind": "limit", "path": None, "message": "x"} and data["schema"] == "gristmill-json-1"
    run = json.loads(R.sarif_document(rows, errors))["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == 13 and [r["level"] for r in run["results"]] == ["note", "warning", "warning"]
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "startColumn": 9, "endLine": 3, "endColumn": 21}
    assert run["results"][1]["partialFingerprints"] == {"gristmill/v1": "b" * 16} and not run["invocations"][0]["executionSuccessful"]
    assert "locations" not in run["invocations"][0]["toolExecutionNotifications"][0] and run["tool"]["driver"]["rules"][3]["properties"] == {"tags": ["experimental"], "defaultEnabled": False}


def test_pages(report):
    rows, errors = report
    page = R.pretty_page(rows).split("\n")
    assert page[0] == "Gristmill found 3 findings in 2 files" and page[1:3] == ["TW001  1", "  https://example.org/gristmill#tw001--no-chained-cast"]
    at = page.index("    3 | 3\\u200b       " + "x" * 108 + "...")
    assert page[at + 1] == " " * (8 + 8 + 5) + "^" and page[at + 3] == "    5 | 5" and "TW012  1  (experimental)" in page
    assert R.pretty_page(rows.limit(0)) == "" and R.pull_request_page(rows.limit(0), errors.limit(0)) == "<!-- gristmill-report -->\n\nGristmill found 0 findings.\n"
    page = R.pull_request_page(rows, errors, compare="https://h/blob/1", cap=2)
    assert "| [TW001](https://example.org/gristmill#tw001--no-chained-cast) | 1 |" in page and "And 1 more:\n\n- [b.py:3:9](https://h/blob/1/b.py#L3): `TW002` cast call missing SAFETY evidence" in page
    assert "**[b.py:3:9](https://h/blob/1/b.py#L3)** `TW001` nested typing.cast call" in page and ">3 | 3\\u200b" in page and page.endswith("- `-`: **limit**: x\n- `z.py`: **parse**: bad\\x1b\n")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    project(tmp_path, '[tool.gristmill]\nexclude = ["old"]\n', pkg__mod_py=CAST, old__x_py=CAST, clean_py="x = 1\n")
    monkeypatch.chdir(tmp_path)
    run = lambda *args: (main(list(args), spark), capsys.readouterr())
    code, out = run("--format", "text")
    assert (code, out.out) == (1, "pkg/mod.py:3:9: TW002 cast call missing SAFETY evidence\n")
    assert run("clean.py")[0] == 0 and run("--select", "TW001,TW003", "--ignore", "TW001")[0] == 0
    code, out = run("--format", "json")
    assert code == 1 and json.loads(out.out)["findings"][0]["fingerprint"] == "45fd0a4b3c314030"
    assert run("--write-baseline", "--baseline", "b.json")[0] == 0
    (tmp_path / "pkg" / "mod.py").write_text(CAST + "other = cast(str, 2)\n")
    code, out = run("--baseline", "b.json", "--format", "text")
    assert (code, out.out) == (1, "pkg/mod.py:4:9: TW002 cast call missing SAFETY evidence\n")
    assert "TW002  2" in run("--format", "pretty")[1].out
    (tmp_path / "broken.py").write_text("def (:\n")
    code, out = run("--format", "text")
    assert code == 2 and out.err.startswith("broken.py: parse: ")
    for bad in (["--format", "xml"], ["--select", "TW099"], ["nowhere"], ["--write-baseline"], ["--max-file-bytes", "0"], ["--diff-ref", "-x"], ["--config", "clean.py"]):
        assert run(*bad)[0] == 3
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "pkg")
    git(tmp_path, "commit", "-qm", "first")
    (tmp_path / "pkg" / "mod.py").write_text(CAST + "other = cast(str, 3)\n")
    code, out = run("--diff-ref", "HEAD", "--format", "text")
    assert (code, out.out) == (1, "pkg/mod.py:4:9: TW002 cast call missing SAFETY evidence\n")


def test_linter(spark, tmp_path, monkeypatch):
    import ast

    from gristmill.linter import Plugin

    project(tmp_path, '[tool.gristmill]\nexclude = ["old"]\nignore = ["TW006"]\n')
    monkeypatch.chdir(tmp_path)
    text = CAST + "cast(int, 2)\n"
    run = lambda name, t=text: [r[:3] for r in Plugin(ast.parse(t), name, t.splitlines(True)).run()]
    assert run("a.py") == [(3, 8, "TW002 cast call missing SAFETY evidence"), (4, 0, "TW002 cast call missing SAFETY evidence")]
    assert run("old/a.py") == [] and run("a.py", "") == [] and list(Plugin(None, "a.py", ["def (\n"]).run()) == []
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    assert run("link.py") == [(1, 0, "TW000 symlink inputs are not supported: link.py")]
    (tmp_path / "pyproject.toml").unlink()
    (tmp_path / "pyproject.toml").write_text("[tool.gristmill]\nother = 1\n")
    monkeypatch.setattr("gristmill.linter._SETTINGS", {})
    assert run("a.py") == [(1, 0, "TW000 unknown configuration key: 'other'")]
