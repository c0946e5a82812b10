import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import gristmill
from gristmill.functions import comments
from gristmill.functions import directives as D
from gristmill.operators import findings as O
from gristmill.operators import local
from gristmill.operators import names as N
from gristmill.plans import cases, catalog, queries
from gristmill.sources.extract import Lexed, facts, file_facts

SF = "/root/testdata/sf0.001"


def audit(spark, files, **options):
    rows = gristmill.analyze(spark.createDataFrame(list(files.items()), "path string, text string"), **options)[0].collect()
    return sorted((r.code, r.line, r.col, r.fingerprint) for r in rows)


def test_known_fingerprints(spark):
    texts = {
        "from typing import cast\n\nvalue = cast(int, 1)\n": [("TW002", 3, 8, "45fd0a4b3c314030")],
        "from typing import cast\n\nvalue = cast(int, cast(str, 1))\n": [("TW001", 3, 8, "b29eb0e0892bb5a9"), ("TW002", 3, 8, "58b5d4fb724951dd")],
        "\ufeffx = 1  # type: ignore[assignment]\r\n": [("TW003", 1, 7, "a09e3fd61e518b78")],
    }
    for text, want in texts.items():
        assert audit(spark, {"pkg/mod.py": text}) == want


def test_selection_changes_no_fingerprint_and_nothing_selected_finds_nothing(spark):
    text = "from typing import Any, cast\nx = cast(Any, 1)\nx = cast(Any, 1)\n"
    every = audit(spark, {"a.py": text})
    assert [r[0] for r in every] == ["TW002", "TW002", "TW005", "TW005"] and len({r[3] for r in every}) == 4
    assert audit(spark, {"a.py": text}, select={"TW005"}) == [r for r in every if r[0] == "TW005"]
    assert audit(spark, {"a.py": text}, select=set()) == []


def test_findings_and_errors_of_a_facade(spark):
    rows = spark.createDataFrame([("a.py", "def (:\n"), ("b.py", "x\0"), ("c.py", None), ("d.py", ""), ("e.py", "x = 1 # type: ignore\n")], "path string, text string")
    found, errors = gristmill.analyze(rows)
    assert [r.path for r in found.collect()] == ["e.py"] and sorted((r.path, r.kind) for r in errors.collect()) == [("a.py", "parse"), ("b.py", "encode")]


def test_metamorphic(spark):
    """Lines before, other statements and blanks leave what is hashed alone; another scope, name or number of equals does not."""
    text = "from typing import cast\ndef f():\n    return cast(int, [1, 2])\n"
    same = [text, "\n\n" + text, "import os\n" + text, text.replace("[1, 2]", "[ 1,\n  2 ]"), text + "y = 1\n", text.replace("    return", "    # note\n    return")]
    other = [text.replace("f()", "g()"), text.replace("2]", "3]"), text.replace("return", "x ="), text.replace("return cast(int, [1, 2])", "return cast(int, [1, 2]), cast(int, [1, 2])")]
    df = facts(spark.createDataFrame([(f"{k}", t) for k, t in enumerate(same + other)], "path string, text string")).cache()
    hosts = {(r.path, r.id): r.text for r in df.where("fact = 'host'").collect()}
    hashed = {}
    for r in O.candidates(df).collect():
        hashed.setdefault(int(r.path), set()).add((r.kind, r.scope_path, r.norm, hosts[r.path, r.host], r.dup))
    assert all(hashed[k] == hashed[0] for k in range(len(same))) and not any(hashed[k] & hashed[0] for k in range(len(same), len(same + other)))


def test_literals_come_through_eight_names(spark):
    def text(n):
        names = "".join(f"    a{i} = {f'a{i - 1}' if i else '[1, -2, {3: (4,)}]'}\n" for i in range(n))
        return f"from typing import Any, cast\ndef f():\n{names}    w: Any = a{n - 1}\n    return cast(list, w)\n"

    got = audit(spark, {f"{n}.py": text(n) for n in (1, 8, 9)}, select={"TW004"})
    assert [r[1] for r in got] == [5, 12]


def test_masks_against_plain_loops(spark):
    """Windows over bindings and uses against a walk of the chain for each use, on random tables."""
    rng = random.Random(4)
    kinds, forms = ["typing.cast", "typing.Any", "os.cast", None], ["import", "assign", "global"]
    sites, uses = [], []
    for path in range(40):
        for k in range(rng.randrange(12)):
            module, symbol = (rng.choice(kinds) or ".").split(".")
            imported = module != "" and rng.random() < 0.7
            sites.append((f"p{path}", k, rng.randrange(3), rng.choice("ab"), rng.randrange(6), rng.randrange(3), "import" if imported else rng.choice(forms[1:]),
                          module if imported else None, symbol if imported else None, rng.random() < 0.6))
        for k in range(8):
            chain = rng.choice([[0], [1, 0], [2, 1, 0], [2, 0]])
            uses.append((f"p{path}", k, rng.choice("ab"), chain, rng.random() < 0.4, rng.randrange(7), rng.randrange(4)))
    none = dict.fromkeys(("text", "name", "module", "symbol"))
    rows = [{**none, "path": p, "fact": "binding", "id": i, "scope": s, "name": n, "line": a, "col": b, "text": f, "module": m, "symbol": y, "level": 0, "flags": ["unconditional"] if u else [], "refs": []} for p, i, s, n, a, b, f, m, y, u in sites]
    rows += [{**none, "path": p, "fact": "call", "id": i, "refs": [{"slot": "callee", "dotted": [n], "scope": c[0], "chain": c, "deferred": d, "line": a, "col": b, "visit": None}]} for p, i, n, c, d, a, b in uses]
    from gristmill.sources.extract import SCHEMA

    fields = [f.split(" ", 1)[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMA)
    got = {(r.path, r.id): r.kind for r in N.lookup(df, N.bindings(df)).collect()}
    for p, i, n, chain, deferred, line, col in uses:
        want = None
        for s in chain:
            own = [x for x in sites if x[0] == p and x[2] == s and x[3] == n]
            if own:
                seen = own if deferred and s == 0 else [x for x in own if (x[4], x[5]) < (line, col)]
                of = lambda x: {"typing.cast": "cast", "typing.Any": "any"}.get(f"{x[7]}.{x[8]}", "other")
                always, maybe = {of(x) for x in seen if x[9]}, {of(x) for x in seen if not x[9]}
                meaning = always or maybe
                want = meaning.pop() if len(meaning) == 1 else None
                break
        assert got[p, i] == want


def test_relative_imports_are_kinds_but_not_identities(spark):
    text = "from .typing import Any, cast\nx = cast(Any, 1)\n"
    assert [r[0] for r in audit(spark, {"a.py": text}, select={"TW002", "TW005"})] == ["TW002"]


def test_formatted_strings_are_one_token():
    lex = Lexed("x = f'{a!r:>{w}} {{b}}' + f'''\n{f'{c}'}''' 'd'\n")
    assert lex.buckets[2] == "STRING:\"f'{a!r:>{w}} {{b}}'\"" and lex.buckets[4].startswith("STRING:\"f'''") and lex.buckets[-1] == "STRING:\"'d'\""


def test_evidence_above_a_statement_does_not_reach_its_later_lines(spark):
    head = "from typing import cast\n"
    texts = {
        "above.py": head + "# SAFETY: two words\nx = [\n    cast(int, 1),\n]\n", "inside.py": head + "x = [\n    # SAFETY: two words\n    cast(int, 1),\n]\n",
        "run.py": head + "# SAFETY: two words\n# more\nx = cast(int, 1)\n", "gap.py": head + "# SAFETY: two words\n\nx = cast(int, 1)\n",
        "string.py": head + "y = 1 # SAFETY: two words\nx = cast(int, 1)\n", "same.py": head + "x = cast(int, 1) # SAFETY[TW002]: two words\n",
    }
    rows = O.findings(facts(spark.createDataFrame(list(texts.items()), "path string, text string"))).collect()
    assert sorted(r.path for r in rows) == ["above.py", "gap.py", "string.py"]


def test_facts_grow_as_files_do(monkeypatch):
    """Tokens looked at for a span, and rows and their texts, follow the size of the file."""
    visited = [0]
    norm = Lexed.norm

    def counted(self, a, b):
        found = norm(self, a, b)
        visited[0] += found.count(" ") + 1
        return found

    monkeypatch.setattr(Lexed, "norm", counted)
    many = {
        "casts": lambda n: "from typing import cast\n" + "".join(f"def f{i}(x):\n    return cast(int, x)  # type: ignore[a]\n" for i in range(n)),
        "host": lambda n: "from typing import cast\nx = [" + "".join(f"cast(int, {i}),\n" for i in range(n)) + "]\n",
        "ignores": lambda n: "x = [" + "".join(f"{i},  # type: ignore[a]\n" for i in range(n)) + "]\n",
        "run": lambda n: "from typing import cast\n" + "# SAFETY: two words\n" * n + "x = cast(int, 1)\n" * 10,
        "guards": lambda n: "from typing import TypeGuard\n" + "".join(f"def f{i}(x) -> TypeGuard[int]: return True\n" for i in range(n)),
    }
    for name, text in many.items():
        size, work = [], []
        for n in (250, 500, 1000):
            visited[0] = 0
            rows = file_facts(text(n))
            work.append(visited[0])
            size.append(sum(len(str(r.get("norm"))) + len(str(r.get("text"))) + len(str(r.get("refs"))) for r in rows))
        assert all(b <= 2.35 * a for a, b in zip(work, work[1:], strict=False)), (name, work)
        assert all(b <= 2.35 * a for a, b in zip(size, size[1:], strict=False)), (name, size)


def test_events_grow_as_names_do(spark):
    """A use and a binding meet in a sort, never each with each."""
    counts = []
    for n in (50, 100):
        text = "".join(f"from typing import cast\nx{i} = cast(int, {i})\n" for i in range(n))
        df = facts(spark.createDataFrame([("a.py", text)], "path string, text string")).cache()
        bound = N.bindings(df)
        counts.append((N.masks(bound, N.uses(df)).count(), bound.count(), N.lookup(df, bound).where("kind = 'cast'").count()))
    assert counts[1][0] <= 2.35 * counts[0][0] and counts[1][1] <= 2.35 * counts[0][1] and [c[2] for c in counts] == [50, 100]


def test_grammars(spark):
    df = spark.createDataFrame([(c[0],) for c in cases.DIRECTIVES], "c string")
    got = df.select("c", D.safety_codes(df.c), D.ignore_codes_valid(df.c), D.is_type_ignore(df.c), D.ignore_norm(df.c), D.disable_norm(df.c), D.inline_reason(df.c), D.checker(df.c)).collect()
    for (text, codes, valid, norm, disable), r in zip(cases.DIRECTIVES, got, strict=True):
        assert tuple(r)[:4] == (text, None if codes is None else sorted(filter(None, codes.split(","))), valid, norm is not None) and r[5] == disable, text
        assert norm is None or r[4] == norm, text
        assert r[7] == (None if disable is None else disable.split(":")[0]), text
    by = {r[0]: r for r in got}
    assert by["# type: ignore[a] SAFETY: two words"][6] == "two words" and by["# type: ignore[a] SAFETY: one"][6] is None


def test_rule_selection():
    assert catalog.active(set()) == []
    assert catalog.active(None, {"TW002"}) == [c for c in catalog.DEFAULT if c != "TW002"]
    with pytest.raises(ValueError):
        catalog.active({"TW999"})


def test_baseline_is_a_multiset(spark):
    rows = spark.createDataFrame([("f", "p", i, 0, "TW002") for i in range(3)], "fingerprint string, path string, line int, col int, code string")
    known = spark.createDataFrame([("f", 2), ("stale", 5)], "fingerprint string, count int")
    assert [r.line for r in O.minus_baseline(rows, known).collect()] == [2]
    assert [r["count"] for r in O.baseline_of(rows).collect()] == [3]


def test_changed_lines_compose_paths_and_keep_repeated_findings(spark):
    rows = [("é.py", 3, 5, "a"), ("é.py", 3, 5, "a"), ("é.py", 7, 7, "b"), ("x.py", 1, 9, "c"), ("é.py", 6, 6, "d")]
    rows = spark.createDataFrame(rows, "path string, line int, end_line int, fingerprint string")
    changed = spark.createDataFrame([("é.py", 5), ("é.py", 7), ("é.py", 5), ("x.py", 10), ("x.py", 5), ("y.py", 1)], "path string, line int")
    assert sorted(r.fingerprint for r in O.on_changed_lines(rows, changed).collect()) == ["a", "a", "b", "c"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for table in ("orders", "lineitem", "events", "documents", "customer", "supplier", "part"):
        path = f"{SF}/{table}.parquet"
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{_glob(path)}'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    kinds = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean"}
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {c: kinds[str(t)] for c, t in zip(want.columns, want.types, strict=True)}
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(map(tuple, got.select(*[f"`{c}`" for c in want.columns]).collect())) == order(want.fetchall())


def _glob(path):
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def test_standard_library_is_read_without_failing():
    import pathlib
    import sysconfig

    files = sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:150]
    rows = [file_facts(p.read_text(encoding="utf-8")) for p in files]
    assert len(files) == 150 and not [r for f in rows for r in f if r["fact"] == "error"]
    assert file_facts("() = x\n[] = y\n(a, *b) = z\n") == [] and file_facts("x = '\ud800'")[0]["name"] == "encode"


def _mutated(rng, text):
    at, to = sorted(rng.randrange(len(text) + 1) for _ in range(2))
    return text[:at] + rng.choice(["", text[at:to] * 2, ",", " ", "[a]", "SAFETY: a b", "=", "'", "\x1c", "#", "pyright:basic", "\u00a0"]) + text[rng.choice([at, to]):]


def test_comment_grammars_of_the_worker_are_those_of_the_plans(spark):
    rng = random.Random(7)
    texts = [c[0] for c in cases.DIRECTIVES]
    texts += [_mutated(rng, rng.choice(texts)) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    ignore = F.when(D.is_type_ignore(c), F.struct(D.ignore_norm(c).alias("a"), D.ignore_codes_valid(c).alias("b"), D.inline_reason(c).isNotNull().alias("c")))
    said = D.safety_codes(c)
    for r in df.select("c", F.when(said.isNotNull(), D.accepted_codes(said)).alias("s"), ignore.alias("i"), D.disable_norm(c).alias("d")).collect():
        assert comments.evidence(r.c) == (None if r.s is None else set(r.s)), r.c
        assert comments.type_ignore(r.c) == (None if r.i is None else tuple(r.i)), r.c
        assert comments.disable_norm(r.c) == r.d, r.c


def test_one_pass_finds_what_the_plans_find(spark):
    """The worker's findings against the plans over fact rows: all cases, statements of cases put together, and bodies in functions."""
    rng = random.Random(11)
    texts = [t.replace("{k}", "7") for t, *_ in cases.RULES + cases.SCOPES + cases.IGNORES + cases.BROKEN] + [*queries.TEMPLATES, *queries.TEST_TEMPLATES]
    sound = [t for t in texts if not [r for r in file_facts(t) if r["fact"] == "error"]]
    for _ in range(400):
        parts = [rng.choice(sound) for _ in range(rng.randrange(2, 5))]
        parts = [p if rng.random() < 0.7 else rng.choice(["def g():\n", "class G:\n", "if y:\n", "async def h(cast, T=1):\n"]) + "".join(f"    {line}\n" for line in p.splitlines()) + "    pass\n" for p in parts]
        texts.append("".join(parts))
    df = spark.createDataFrame([(f"{k}.py", t) for k, t in enumerate(texts)], "path string, text string").cache()
    made = facts(df).cache()
    rows = lambda d: sorted(map(tuple, d.collect()))
    for rules in ({"select": set(catalog.CODES)}, {}, {"select": {"TW001", "TW003"}, "ignore": {"TW001"}}):
        got = local.audited(df, **rules).cache()
        assert rows(local.found(got)) == rows(O.findings(made, **rules)) and local.found(got).columns == O.FINDING
    assert rows(local.failed(got)) == rows(O.errors(made)) and len(rows(O.findings(made))) > 500


def test_one_pass_has_no_shuffle_but_that_of_the_sources_and_small_tasks(spark, monkeypatch):
    """No intermediate row is shuffled, and a task has so many files however large the table is."""
    from gristmill.sources import extract

    plan = queries.audit_selection(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    monkeypatch.setattr(extract, "FILES", 10)
    assert queries.audit_selection(spark, SF).rdd.getNumPartitions() == 150


def _steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_reports_parse_once_and_plain_text_stays_in_the_jvm(spark):
    """A sort over the parsing pass would run it twice; the worker that escapes gets nulls for plain ASCII."""
    assert "MapInArrow" not in _steps(queries.audit_report(spark, SF))
    from gristmill.operators import lines

    texts = ["plain.py", "a\n", "\n", "é", "\x7f", "", None, "‮"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lines.escaped(F.col("t"))).collect()] == [None if t is None else lines.escape(t) for t in texts]
    assert "CASE WHEN NOT RLIKE" in df.select(lines.escaped(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_the_first_of_each_rule_are_cut_before_the_shuffle(spark):
    """No task sorts all findings of a rule: each part gives its first ones."""
    steps = _steps(queries.audit_top(spark, SF))
    assert steps.count("WindowGroupLimit") == 2 and steps.count("Exchange") == 2 and "Join" not in steps


def test_changed_lines_shuffle_findings_once(spark):
    steps = _steps(queries.audit_changed_lines(spark, SF))
    assert steps.count("Window") == 1 and steps.count("MapInArrow") == 1 and steps.count("Exchange") == 3  # sources, distinct lines, events


def test_snippets_never_send_all_texts_to_everyone(spark):
    steps = _steps(queries.audit_snippets(spark, SF))
    assert "SortMergeJoin" in steps and "Broadcast" not in steps and steps.count("MapInArrow") == 1


def test_counts_shuffle_a_rule_and_path_a_finding(spark):
    steps = _steps(queries.audit_counts(spark, SF))
    assert steps.count("Exchange") == 3 and "Join" not in steps and "Window" not in steps  # sources, rules and paths, counts


def test_baseline_shuffles_findings_once(spark):
    steps = _steps(queries.audit_baseline(spark, SF))
    assert steps.count("Exchange") == 2 and "Join" not in steps and "Window" not in steps


def test_all_rules_need_no_shuffle_of_facts(spark):
    steps = _steps(queries.audit_rules(spark, SF))
    assert steps.count("Exchange") == 1 and "Join" not in steps and "Window" not in steps
