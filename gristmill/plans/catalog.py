"""The rules as a dimension table, and what names of the standard library stand for."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, names, texts and properties of the rules, kinds of candidates, and the names that are known.
#: code, name, on by default, suppressible, needs an explicit scope, message, summary
RULES = [
    ("TW001", "no-chained-cast", True, False, False, "nested typing.cast call", "A typing.cast call whose value argument is directly another cast."),
    ("TW002", "cast-needs-evidence", True, True, False, "cast call missing SAFETY evidence", "A resolved typing.cast call with no SAFETY evidence on its statement."),
    ("TW003", "typed-ignore-needs-evidence", True, True, False, "type: ignore comment missing codes or SAFETY evidence",
     "A type: ignore comment missing error codes, SAFETY evidence, or both."),
    ("TW004", "no-widen-then-cast", False, True, True, "cast follows explicit Any/object widen of a literal binding",
     "A cast of a local name that was widened to Any or object from a literal."),
    ("TW005", "cast-to-any", True, True, True, "cast target is typing.Any", "A resolved typing.cast whose type argument resolves to typing.Any."),
    ("TW006", "discarded-cast", True, True, True, "cast result is discarded", "A resolved cast whose result is the entire value of an expression statement."),
    ("TW007", "checker-disable-needs-evidence", True, True, False, "checker disable comment missing SAFETY evidence",
     "A scope-wide mypy or pyright disable comment at column 0 anywhere in the module with no immediately preceding SAFETY evidence."),
    ("TW008", "no-type-check-needs-evidence", True, True, False, "no_type_check decorator missing SAFETY evidence",
     "A resolved @no_type_check decorator on a function or class with no SAFETY evidence."),
    ("TW009", "mock-patch-create-needs-evidence", True, True, False, "mock patch call with create=True missing SAFETY evidence",
     "A resolved unittest.mock.patch or patch.object call with literal create=True and no SAFETY evidence."),
    ("TW010", "constant-type-guard", True, True, True, "narrowing function body is only return True or return False",
     "A narrowing function whose body is only return True or return False after an optional docstring."),
    ("TW011", "unvalidated-boundary-cast", False, True, True, "cast of unvalidated boundary parse", "A cast of an allowlisted stdlib boundary parse without validation."),
    ("TW012", "mock-patch-needs-spec", False, True, False, "mock patch call missing explicit fidelity decision",
     "A resolved patch or patch.object call with no explicit autospec, spec, spec_set, new, new_callable, or wraps keyword."),
    ("TW013", "cast-to-typevar", False, True, True, "cast target is local TypeVar",
     "A resolved cast whose bare Name target is a locally bound TypeVar from a single unconditional TypeVar(...) assignment."),
]
KIND_NAMES = {
    "call": "cast-call", "ignore": "type-ignore-comment", "disable": "checker-disable-comment", "decorator": "no-type-check-decorator",
    "patch": "mock-patch-call", "guard": "narrowing-function",
}
TYPING_STAR = [
    "Annotated", "Any", "Callable", "ClassVar", "Concatenate", "Final", "ForwardRef", "Generic", "Literal", "Optional", "ParamSpec", "Protocol",
    "Type", "TypeAlias", "TypeGuard", "TypeVar", "TypeVarTuple", "Union", "cast", "no_type_check", "overload", "runtime_checkable",
]
TYPING_NAMES = ["no_type_check", "TypeGuard", "TypeIs", "TypeVar", "overload", "Protocol", "Any"]
PARSERS = [*map(".".join, product(("json", "pickle", "marshal", "tomllib", "plistlib"), ("load", "loads"))), "ast.literal_eval"]
MOCKS = ["mock.patch", "mock.patch.object"]

CODES = [r[0] for r in RULES]
DEFAULT = [r[0] for r in RULES if r[2]]
SUPPRESSIBLE = [r[0] for r in RULES if r[3]]
#: Rules that an unscoped comment counts for.
UNSCOPED = [r[0] for r in RULES if r[3] and not r[4]]
EXPERIMENTAL = [c for c in CODES if c not in DEFAULT]
MESSAGES = {r[0]: r[5] for r in RULES}

PARSER_MODULES = sorted({p.split(".")[0] for p in PARSERS})
#: What an imported module stands for by its whole name, and what a name imported from one does.
MODULE_IDENTITY = {m: m for m in [*PARSER_MODULES, "mock", "unittest"]}
FROM_IDENTITY = {
    **{f"{m}.{n}": f"typing.{n}" for m in ("typing", "typing_extensions") for n in TYPING_NAMES}, **{p: p for p in PARSERS},
    "mock.patch": "mock.patch", "unittest.mock.patch": "mock.patch", "unittest.mock": "mock",
}
#: What an attribute of something known is.
ATTRIBUTE_IDENTITY = {**{p: p for p in PARSERS}, "unittest.mock": "mock", **{m: m for m in MOCKS}}
IDENTITIES = sorted({*MODULE_IDENTITY.values(), *FROM_IDENTITY.values(), *ATTRIBUTE_IDENTITY.values()})


def heading(code: str) -> str:
    """The rule's heading in a manual."""
    name = RULES[CODES.index(code)][1]
    return f"{code} — {name}{' (experimental)' if code in EXPERIMENTAL else ''}"


def hint(code: str) -> str | None:
    """The comment that would cover a finding; null for a rule that none covers."""
    rule = RULES[CODES.index(code)]
    return None if not rule[3] else f"# SAFETY[{code}]: <reason>" if rule[4] else "# SAFETY: <reason>"


def level(code: str) -> str:
    return "note" if code in EXPERIMENTAL else "warning"


def rules(spark: SparkSession) -> DataFrame:
    """The catalog: a row a rule, in order."""
    from ..sources.project import anchor

    rows = [
        (k, r[0], r[1], r[5], r[6], r[2], not r[2], r[3], r[4], r[0] == "TW004", r[0] == "TW013", hint(r[0]), anchor(heading(r[0])), level(r[0]))
        for k, r in enumerate(RULES)
    ]
    flags = ", ".join(f"{c} boolean" for c in ("on_by_default", "experimental", "suppressible", "scoped_only", "needs_effects", "needs_typevars"))
    return spark.createDataFrame(rows, f"position int, code string, name string, message string, summary string, {flags}, hint string, anchor string, level string")


def mismatch(spark: SparkSession, built: list[str]) -> DataFrame:
    """Rules that the catalog has and the package doesn't build, or the other way round."""
    own = spark.createDataFrame([(c,) for c in built] or [], "built string")
    both = rules(spark).join(own, F.col("code") == F.col("built"), "full_outer")
    return both.where("code IS NULL OR built IS NULL").select(F.coalesce("code", "built").alias("code"), F.when(F.col("built").isNull(), "missing").otherwise("unknown").alias("problem"))


def active(select: set[str] | frozenset[str] | None = None, ignore: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """Codes that run: what is selected (else the defaults) without what is ignored."""
    unknown = {*(select or ()), *ignore}.difference(CODES)
    if unknown:
        raise ValueError(f"unknown rule codes: {', '.join(sorted(unknown))}")
    return [c for c in CODES if c in (DEFAULT if select is None else select) and c not in ignore]
