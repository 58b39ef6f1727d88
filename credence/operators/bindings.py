"""What names mean across modules: aliases by pointer jumping, star imports, class hierarchies, injected parameters."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.identity import ancestors
from credence.operators.graphs import _cut, _dealt, _drop

#: The classes that models derive from, and the budget of the search for models.
MODEL_BASES = ("pydantic.BaseModel", "pydantic.main.BaseModel", "pydantic.v1.BaseModel")
LEAST_WORK, WORK_PER_UNIT, MOST_WORK = 4_096, 64, 5_000_000
#: What more names than this are bound to is not dealt to one task.
HOT = 100_000


def own_bindings(facts: DataFrame) -> DataFrame:
    """(name, target) of the names that modules bind to other names."""
    return facts.select(F.explode("bindings").alias("b")).select("b.name", "b.target")


def star_closure(stars: DataFrame) -> DataFrame:
    """(module, source, at): all modules whose names a module imports by stars, through other stars as well; ``at`` is
    the place of its own import.  Paths double each round."""
    now = _cut(stars.groupBy("module", "source").agg(F.max("at").alias("at")))
    while True:
        longer = now.join(now.select(F.col("module").alias("source"), F.col("source").alias("__to")), "source").select("module", F.col("__to").alias("source"), "at")
        wider = _cut(now.unionByName(longer).filter("module <> source").groupBy("module", "source").agg(F.max("at").alias("at")))
        same = wider.count() == now.count()
        _drop(now)
        now = wider
        if same:
            return now


def star_bindings(facts: DataFrame) -> DataFrame | None:
    """(name, target) of the names that star imports bind: the public ones of the other module, or those in its
    ``__all__``; a module's own names come first, then those of its last star import."""
    stars = facts.select("module", F.posexplode("stars").alias("at", "source"))
    if not stars.limit(1).count():
        return None
    top = facts.select("module", F.explode("entities.qualname").alias("q")).unionByName(facts.select("module", F.explode("classes.qualname").alias("q"))).unionByName(facts.select("module", F.explode("bindings.name").alias("q")))
    named = top.filter(F.col("q").startswith(F.concat("module", F.lit(".")))).select("module", F.expr("substring(q, length(module) + 2)").alias("name")).filter("instr(name, '.') = 0").distinct()
    listed = facts.filter("exports IS NOT NULL").select(F.col("module").alias("source"), "exports")
    # A name in __all__ may itself come from a star import, so it needn't be one of the module's own.
    public = named.join(listed.select(F.col("source").alias("module")), "module", "left_anti").filter(~F.col("name").startswith("_"))
    public = public.unionByName(listed.select(F.col("source").alias("module"), F.explode("exports").alias("name"))).select(F.col("module").alias("source"), "name").distinct()
    hit = star_closure(stars).join(public, "source").join(named, ["module", "name"], "left_anti")
    last = hit.groupBy("module", "name").agg(F.max_by("source", F.struct("at", "source")).alias("source"))
    return last.select(F.concat_ws(".", "module", "name").alias("name"), F.concat_ws(".", "source", "name").alias("target"))


class Aliases(NamedTuple):
    """``canonical`` (name, target): what each name that is bound to a name means in the end; ``rounds`` it took."""

    canonical: DataFrame
    rounds: int


def canonical(bindings: DataFrame) -> Aliases:
    """Follow chains of bindings by pointer jumping: every round each target is replaced by its own target, so that a
    chain of n bindings takes log2(n) + 1 rounds.  Names in rings of bindings mean nothing."""
    now = _cut(bindings.groupBy("name").agg(F.min("target").alias("target")).filter("name <> target"))
    most, rounds = math.ceil(math.log2(max(2, now.count()))) + 1, 0
    while rounds < most:
        hop = now.select(F.col("name").alias("target"), F.col("target").alias("__to"))
        # Very many names may be bound to the same: distinct targets are folded before they are dealt.
        if not now.select("target").distinct().join(_dealt(hop), "target", "left_semi").limit(1).count():
            return Aliases(now, rounds)
        after = _cut(now.join(hop, "target", "left").select("name", F.coalesce("__to", "target").alias("target")))
        _drop(now)
        now, rounds = after, rounds + 1
    # What still points into the table goes round in a ring, or into one.
    return Aliases(now.join(now.select(F.col("name").alias("target")), "target", "left_anti").select("name", "target"), rounds)


def meanings(names: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """(name, qualname): of the ``names`` that aren't ``known`` (qualname), those that mean a known one once their
    longest aliased beginning is replaced."""
    k = _dealt(known.select(F.col("qualname").alias("__known")).distinct())
    lost = names.select("name").distinct().join(k, F.col("name") == F.col("__known"), "left_anti")
    tried = lost.select("name", F.explode(ancestors(F.col("name"))).alias("head")).join(_dealt(aliases.select(F.col("name").alias("head"), "target")), "head")
    best = tried.groupBy("name").agg(F.max(F.struct(F.length("head").alias("n"), "head", "target")).alias("b"))
    full = best.select("name", F.concat(F.col("b.target"), F.expr("substring(name, b.n + 1)")).alias("qualname"))
    return full.join(k, F.col("qualname") == F.col("__known"), "left_semi")


def bound_to(rows: DataFrame, targets: DataFrame, counts: DataFrame) -> DataFrame:
    """The ``rows`` (name, target) whose target is among ``targets`` (target); ``counts`` (target, n) of the rows.  Targets
    that very many names are bound to are few, and go to their rows; all others are dealt."""
    hot = _cut(counts.filter(F.col("n") > HOT).select("target"))
    if not hot.limit(1).count():
        _drop(hot)
        return rows.join(targets, "target", "left_semi")
    rest = rows.join(F.broadcast(hot), "target", "left_anti").join(_dealt(targets), "target", "left_semi")
    return rest.unionByName(rows.join(F.broadcast(_cut(targets.join(F.broadcast(hot), "target", "left_semi"))), "target", "left_semi"))


def project_aliases(facts: DataFrame) -> DataFrame | None:
    """The ``canonical`` bindings that lead to functions and classes of the project; None if there are none."""
    every, stars = own_bindings(facts), star_bindings(facts)
    if stars is not None:
        every = _cut(every.unionByName(stars))
    goals = facts.select(F.explode("entities.qualname").alias("q")).unionByName(facts.select(F.explode("classes.qualname").alias("q")))
    # Most names are bound to what is outside, and many to the same: of the distinct targets only those that lead to
    # a project's name are followed.
    targets = _cut(every.groupBy("target").agg(F.count(F.lit(1)).alias("n")))
    names = goals.unionByName(every.select(F.col("name").alias("q"))).select(F.col("q").alias("target"))
    lead = _cut(names.join(_dealt(targets), "target", "left_semi").distinct())
    live = bound_to(every, lead, targets)
    if not live.limit(1).count():
        return None
    found = canonical(live).canonical
    return _cut(bound_to(found, goals.select(F.col("q").alias("target")).distinct(), found.groupBy("target").agg(F.count(F.lit(1)).alias("n"))).select("name", "target"))


class Models(NamedTuple):
    """``models`` (qualname): classes that derive from a model base, or all classes where the work went past its
    budget; ``degraded``: None, or what the finding on it says."""

    models: DataFrame
    degraded: dict | None


def model_closure(facts: DataFrame, aliases: DataFrame | None = None, most: int | None = None) -> Models:
    """Classes that derive from a model base, through classes of other modules: each round follows the edges between
    modules once and those inside modules to their end.  A round's work is the statements of the project, and its files
    once for each known model; past the budget (by the project's size, or ``most``) every class counts as a model."""
    classes = facts.select("module", F.explode("classes").alias("c")).select("module", "c.qualname", F.explode("c.bases").alias("base"))
    if aliases is not None:
        said = meanings(classes.select(F.col("base").alias("name")), aliases, classes.select("qualname"))
        classes = classes.join(said.select(F.col("name").alias("base"), F.col("qualname").alias("__to")), "base", "left").select("module", "qualname", F.coalesce("__to", "base").alias("base"))
    of = classes.select(F.col("qualname").alias("base"), F.col("module").alias("__of")).distinct()
    edges = _cut(classes.join(of, "base", "left").select("qualname", "base", F.coalesce(F.col("module") == F.col("__of"), F.lit(False)).alias("inside")))
    files, statements = facts.filter("status = 'ok'").agg(F.count(F.lit(1)), F.coalesce(F.sum("statements"), F.lit(0))).first()
    budget = min(MOST_WORK, max(LEAST_WORK, (files + statements) * WORK_PER_UNIT)) if most is None else most
    known, size, work, rounds = facts.sparkSession.createDataFrame([], "qualname string"), 0, 0, 0
    while True:
        need = work + statements + files * (size + 1)
        if need > budget:
            detail = {"reason": "work_budget_exceeded", "round": rounds + 1, "work": work, "budget": budget, "required_total": need, "file_count": files, "statement_count": statements, "known_model_count": size}
            return Models(facts.select(F.explode("classes.qualname").alias("qualname")).distinct(), detail)
        work, rounds = need, rounds + 1
        step = edges.filter(F.col("base").isin(*MODEL_BASES) if not size else ~F.col("inside"))
        step = step if not size else step.join(known.select(F.col("qualname").alias("base")), "base", "left_semi")
        fresh = _cut(step.select("qualname").distinct().join(known, "qualname", "left_anti"))
        found = fresh.count()
        if not found:
            return Models(known, None)
        while found:
            wider = _cut(known.unionByName(fresh).distinct())
            _drop(known)
            _drop(fresh)
            known = wider
            size += found
            fresh = _cut(edges.filter("inside").join(known.select(F.col("qualname").alias("base")), "base", "left_semi").select("qualname").distinct().join(known, "qualname", "left_anti"))
            found = fresh.count()


def injected(entities: DataFrame, seeds: DataFrame, aliases: DataFrame | None = None) -> DataFrame | None:
    """(callee, param, provider) of the parameters that a framework fills with what a function of the project
    returns; None if there are none."""
    rows = entities.select(F.col("qualname").alias("callee"), F.explode("depends").alias("d")).select("callee", "d.param", F.col("d.provider").alias("name")).filter("name IS NOT NULL").distinct()
    if not rows.limit(1).count():
        return None
    known = seeds.select("qualname").distinct()
    out = rows.join(known.select(F.col("qualname").alias("name")), "name", "left_semi").select("callee", "param", F.col("name").alias("provider"))
    if aliases is not None:
        out = out.unionByName(rows.join(meanings(rows.select("name"), aliases, known), "name").select("callee", "param", F.col("qualname").alias("provider")))
    return _cut(out)


def request_bodies(entities: DataFrame, models: DataFrame, aliases: DataFrame | None, unreadable: str, rank: int) -> DataFrame:
    """(callee, param, rank) of the parameters of routes that hold what a request sent: those whose types may be a
    model, and those whose types can't be read."""
    typed = entities.select(F.col("qualname").alias("callee"), F.explode("typed").alias("t")).select("callee", "t.param", F.explode("t.types").alias("name"))
    hit = typed.join(models.select(F.col("qualname").alias("name")), "name", "left_semi").unionByName(typed.filter(F.col("name") == unreadable))
    if aliases is not None:
        hit = hit.unionByName(typed.join(meanings(typed.select("name"), aliases, models), "name").select(*typed.columns))
    return hit.select("callee", "param", F.lit(rank).alias("rank")).distinct()


