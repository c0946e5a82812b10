"""What names stand for, as of the place where they are used.

A name is looked for in a chain of scopes, nearest first. Places that bind it and places that use it are laid
in one order for each (file, scope, name), and running unions of bit masks say at every use what the name may
be by then. So a lookup costs a sort, never a pair of use and binding. The nearest scope decides:

* as of a place (``callee`` and most others): the scope that binds the name at all, even later;
* as the reader saw it (``annotation``): the scope with a binding seen by then, in the order of reading;
* of one binding (``typevar``): the scope with a binding visible by then, and which that is.

A use inside a function sees a module complete. Bindings that always run win over imports that may not.
More than one meaning is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import catalog as C

#: Bits of what a name may be; the last is anything else.
KINDS = {"cast": 1, "any": 2, "typing": 4, "typing_extensions": 8, "other": 16}
_BITS = {name: 1 << k for k, name in enumerate(C.IDENTITIES)}
_CONFLICT = 1 << len(C.IDENTITIES)
ALIASES = 8
TYPING = ("typing", "typing_extensions")


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _look(pairs: dict, key: Column) -> Column:
    return F.try_element_at(_table(pairs), key)


def bindings(facts: DataFrame) -> DataFrame:
    """path, scope, name, id, form, line, col, flags, value_name, kind (bits), identity, ambiguous of every binding.

    An import from a typing module with a star binds each of its names.
    """
    b = facts.where("fact = 'binding'").withColumn("form", F.col("text"))
    names = F.when(F.col("symbol") == "*", F.array(*map(F.lit, C.TYPING_STAR))).otherwise(F.array("name"))
    b = b.withColumn("name", F.explode(names)).withColumn("symbol", F.when(F.col("symbol") == "*", F.col("name")).otherwise(F.col("symbol")))
    of_typing, whole = F.col("module").isin(*TYPING), F.col("symbol").isNull()
    kind = (
        F.when((F.col("form") == "import") & whole & of_typing, _look(KINDS, F.col("module")))
        .when(of_typing & (F.col("symbol") == "cast"), KINDS["cast"]).when(of_typing & (F.col("symbol") == "Any"), KINDS["any"]).otherwise(KINDS["other"])
    )
    module = F.when((F.col("module") == "unittest.mock") & F.array_contains("flags", "aliased"), "mock").when(F.col("module") == "unittest.mock", "unittest").otherwise(
        _look(C.MODULE_IDENTITY, F.col("module"))
    )
    drawn = F.when(F.coalesce("level", F.lit(0)) == 0, _look(C.FROM_IDENTITY, F.concat_ws(".", "module", "symbol")))
    known = F.when(F.col("form") == "import", F.when(whole, module).otherwise(drawn))
    b = b.select("path", "scope", "name", "id", "form", "line", "col", "flags", "value_name", kind.alias("kind"), known.alias("known"))
    # the first known meaning stands if only imports come before it; others then must agree
    own = Window.partitionBy("path", "scope", "name")
    b = b.withColumn("at", F.min(F.when(F.col("known").isNotNull(), F.col("id"))).over(own))
    b = b.withColumn("first", F.min(F.when(F.col("id") == F.col("at"), F.col("known"))).over(own))
    b = b.withColumn("sound", F.min((F.col("id") >= F.col("at")) | (F.col("form") == "import")).over(own))
    agrees = F.col("sound") & (F.col("known") == F.col("first"))
    clash = F.col("sound") & (F.col("id") > F.col("at")) & ~F.col("form").isin("global", "nonlocal", "nonlocal_write")
    ambiguous = F.when(F.col("known").isNotNull(), ~agrees).otherwise(F.coalesce(clash, F.lit(False)))
    return b.select(
        "path", "scope", "name", "id", "form", "line", "col", "flags", "value_name", "kind",
        F.when(agrees, F.col("known")).alias("identity"), ambiguous.alias("ambiguous"),
    )


def uses(facts: DataFrame) -> DataFrame:
    """path, fact, id, ref (number), slot, dotted, chain, deferred, line, col, visit of every name to be looked up."""
    return facts.where(F.size("refs") > 0).select("path", "fact", "id", F.posexplode("refs").alias("ref", "r")).select("path", "fact", "id", "ref", "r.*")


def masks(bound: DataFrame, looked: DataFrame) -> DataFrame:
    """For each use and scope of its chain: dist, masks before it (ku, kc, iu, ic) and of the whole scope (upper case), counts, last binding."""
    always = F.array_contains("flags", "unconditional")
    bit, none = _look(_BITS, F.col("identity")), F.lit(0).cast("long")
    own = F.when(F.col("ambiguous"), _CONFLICT).otherwise(F.coalesce(bit, none)).cast("long")
    site = bound.select(
        "path", "scope", "name", F.explode(F.array(F.lit(False), F.lit(True))).alias("reading"), F.col("id").alias("site"), "line", "col",
        F.when(always, F.col("kind")).otherwise(0).cast("long").alias("ku"), F.when(always, 0).otherwise(F.col("kind")).cast("long").alias("kc"),
        F.when(always | F.col("ambiguous"), own).otherwise(none).alias("iu"), F.when(~always | F.col("ambiguous"), own).otherwise(none).alias("ic"),
    )
    site = site.withColumn("place", F.when(F.col("reading"), F.struct(F.col("site").alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"))).otherwise(F.struct(F.col("line").alias("a"), F.col("col").alias("b"), F.lit(1).alias("c"))))
    use = looked.select("path", "fact", "id", "ref", "slot", "deferred", "line", "col", "visit", F.element_at("dotted", 1).alias("name"), F.posexplode("chain").alias("dist", "scope"))
    use = use.withColumn("reading", F.col("visit").isNotNull())
    use = use.withColumn("place", F.when(F.col("reading"), F.struct(F.col("visit").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))).otherwise(F.struct(F.col("line").alias("a"), F.col("col").alias("b"), F.lit(0).alias("c"))))
    use = use.drop("line", "col", "visit")
    events = site.drop("line", "col").unionByName(use, allowMissingColumns=True)
    whole = Window.partitionBy("path", "reading", "scope", "name")
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ("ku", "kc", "iu", "ic")
    events = events.select(
        "path", "fact", "id", "ref", "slot", "reading", "deferred", "dist", "scope",
        *[F.coalesce(F.bit_or(c).over(before), none).alias(c) for c in parts], *[F.coalesce(F.bit_or(c).over(whole), none).alias(f"all_{c}") for c in parts],
        F.count("site").over(before).alias("seen"), F.count("site").over(whole).alias("bindings"), F.max("site").over(whole).alias("any_site"),
        F.last("site", ignorenulls=True).over(before).alias("last_site"),
    )
    return events.where("fact IS NOT NULL")


def lookup(facts: DataFrame, bound: DataFrame) -> DataFrame:
    """path, fact, id, ref, slot, kind, identity, site (typevar: the one binding it sees) of every use."""
    looked = uses(facts)
    found = masks(bound, looked)
    complete = F.col("deferred") & (F.col("scope") == 0) & ~F.col("reading")
    pick = lambda c: F.when(complete, F.col(f"all_{c}")).otherwise(F.col(c))
    first = lambda u, c: F.when(u != 0, u).otherwise(c)
    kind = F.when(F.col("reading"), pick("ku").bitwiseOR(pick("kc"))).otherwise(first(pick("ku"), pick("kc")))
    visible = F.when(complete, F.col("bindings")).otherwise(F.col("seen"))
    one = F.when(visible == 1, F.when(complete, F.col("any_site")).otherwise(F.col("last_site")))
    decides = F.when(F.col("reading") | (F.col("slot") == "typevar"), visible > 0).otherwise(F.col("bindings") > 0)
    state = F.struct(kind.alias("kind"), first(pick("iu"), pick("ic")).alias("identity"), F.struct("scope", one.alias("id")).alias("site"))
    near = found.where(decides).groupBy("path", "fact", "id", "ref").agg(F.min_by(state, "dist").alias("n"))
    rows = looked.select("path", "fact", "id", "ref", "slot", "dotted").join(near, ["path", "fact", "id", "ref"], "left")
    head, attr, plain = F.element_at("dotted", 1), F.get("dotted", F.lit(1)), F.size("dotted") == 1
    of = F.when(F.bit_count("n.kind") == 1, _look({v: k for k, v in KINDS.items()}, F.col("n.kind").cast("int")))
    of = F.when(F.col("n").isNull() & (head == "object"), "object").otherwise(of)
    named = F.when((F.bit_count("n.identity") == 1), _look({v: k for k, v in _BITS.items()}, F.col("n.identity")))
    rows = rows.withColumn("of", of).withColumn("named", named)
    from_typing = F.col("of").isin(*TYPING) & (F.size("dotted") == 2)
    kind = F.when(plain, F.col("of")).when(from_typing & attr.isin("cast", "Any"), F.lower(attr))
    steps = F.aggregate(F.slice("dotted", F.lit(2), F.greatest(F.size("dotted") - 1, F.lit(0))), F.col("named"), lambda acc, a: _look(C.ATTRIBUTE_IDENTITY, F.concat(acc, F.lit("."), a)))
    identity = F.coalesce(steps, F.when(from_typing & attr.isin(C.TYPING_NAMES), F.concat(F.lit("typing."), attr)))
    return rows.select("path", "fact", "id", "ref", "slot", kind.alias("kind"), identity.alias("identity"), F.when(F.col("slot") == "typevar", F.col("n.site")).alias("site"))


def by_fact(found: DataFrame) -> DataFrame:
    """One row a fact (path, fact, id): what its slots stand for."""
    of = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    is_ = lambda slot, name: F.coalesce(F.max((F.col("slot") == slot) & (F.col("identity") == name)), F.lit(False))
    return found.groupBy("path", "fact", "id").agg(
        of("callee", "kind").alias("callee_kind"), of("callee", "identity").alias("callee"), of("type", "kind").alias("type_kind"), of("type", "identity").alias("type"),
        of("parser", "identity").alias("parser"), of("returns", "identity").alias("returns"), of("annotation", "kind").alias("annotation"), of("made", "identity").alias("made"),
        is_("mark", "typing.no_type_check").alias("unchecked"), is_("mark", "typing.overload").alias("overload"), is_("base", "typing.Protocol").alias("protocol"),
        of("typevar", "site").alias("typevar"),
    )


def _single(bound: DataFrame, known: DataFrame) -> DataFrame:
    """Bindings that are the only one of their name in their scope, with what they are made of."""
    own = Window.partitionBy("path", "scope", "name")
    one = bound.withColumn("n", F.count(F.lit(1)).over(own)).where("n = 1")
    made = known.where("fact = 'binding'").select("path", "id", "annotation", "made")
    return one.join(made, ["path", "id"], "left")


def type_variables(bound: DataFrame, known: DataFrame) -> DataFrame:
    """path, scope, id of names bound once, to a TypeVar call, directly in a module or a function."""
    has = lambda f: F.array_contains("flags", f)
    placed = (has("function") & has("direct") & has("unconditional")) | (has("module") & has("top"))
    return _single(bound, known).where((F.col("form") == "assign") & (F.col("made") == "typing.TypeVar") & placed).select("path", "scope", "id")


def widened(bound: DataFrame, known: DataFrame) -> DataFrame:
    """path, scope, name, line, col of names of functions that are bound once, said to be Any or object, to a literal.

    The literal may come through up to ALIASES names of the same function that are bound once and before.
    """
    has = lambda f: F.array_contains("flags", f)
    local = _single(bound, known).where(has("function") & has("direct"))
    wide = local.where((F.col("form") == "ann_assign") & F.col("annotation").isin("any", "object"))
    alias = F.struct("name", F.struct(has("literal").alias("literal"), F.col("value_name").alias("next"), F.struct("line", "col").alias("at")))
    aliases = local.where("form = 'assign'").groupBy("path", "scope").agg(F.map_from_entries(F.collect_list(alias)).alias("aliases"))  # of one function
    rows = wide.join(aliases, ["path", "scope"], "left")
    here = F.struct("line", "col")

    def hop(state: Column, _: Column) -> Column:
        to = F.try_element_at(F.col("aliases"), state["next"])
        good = ~state["literal"] & to.isNotNull() & (to["at"] < here)
        return F.when(good, F.struct(to["literal"].alias("literal"), to["next"].alias("next"))).otherwise(F.struct(state["literal"].alias("literal"), F.lit(None).cast("string").alias("next")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ALIASES)), F.struct(has("literal").alias("literal"), F.col("value_name").alias("next")), hop)
    return rows.where(end["literal"]).select("path", "scope", "name", "line", "col")
