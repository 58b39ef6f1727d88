"""The scan: files -> facts -> seeds -> flow -> rules -> findings, as one DataFrame pipeline.

Source is parsed by Arrow workers, one partition of files at a time.  Names that a file's calls may mean are
joined with the project's seeds, so a worker gets the few seeds its file refers to, never the project's.
Arguments that reach parameters are folded per (callee, parameter) and fed back until nothing changes;
a round runs only the files whose functions got a weaker parameter, class attribute or name of the module,
and writes only what those files give.

A scan leaves its tables in the shared folder, because its frames read them; ``finish`` removes them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.identity import fingerprint, glob_pattern, module_name
from credence.functions.lattice import RANK, provenance_clash
from credence.operators.bindings import injected as injected_params
from credence.operators.bindings import meanings, model_closure, project_aliases, request_bodies
from credence.operators.delta import delta_report, file_edges, files_to_scan, match_scope
from credence.operators.graphs import _cut, _dealt, _drop, semi_naive
from credence.operators.findings import ENGINE_PATH, delta_relabel, display_filter, duplicate_names, fingerprint_collisions, low_resolution, unused_directives
from credence.operators.rules import EXTRA, RULES, apply_rules, reads, selected
from credence.sources import memo
from credence.sources.cache import cache_key, policy_hash, signed, verified
from credence.sources.discovery import in_project, missing_roots
from credence.sources.python_code import MARKER_MODULES, UNREADABLE, module_of

#: How often a parameter's rank can rise.
RISES = 7
#: How many rounds are joined by what later ones ran; more are by numbers.
FEW = 4

ENTITY = (
    "path string, module string, qualname string, owner string, line_start int, line_end int, params array<string>, "
    "markers array<struct<marker:string,ordinal:int,level:string,readable:boolean,allowed:boolean>>, real_rejection boolean, any_rejection boolean, assert_only boolean, degenerate boolean, "
    "fails_open boolean, leaks_none boolean, handlers array<struct<line:int,broad:boolean,silent:boolean,span:string>>, helpers array<string>, depends array<struct<param:string,provider:string>>, typed array<struct<param:string,types:array<string>>>, body_sha string"
)
FACTS = f"path string, status string, message string, module string, statements int, stars array<string>, exports array<string>, bindings array<struct<name:string,target:string>>, classes array<struct<qualname:string,bases:array<string>>>, references array<string>, imports array<string>, entities array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in ENTITY.split(', '))}>>"
SLOT = "struct<key:string,rank:int,guarded:boolean,constant_text:boolean>"
CALL = f"struct<line:int,span:string,fqn:string,dotted:string,attr:string,receiver:string,receiver_type:string,callee:string,slots:array<{SLOT}>,built:array<{SLOT}>,star:boolean,literal:array<string>,stored:boolean>"
FLOW = f"path string, qualname string, status string, ret int, ret_callee string, calls array<{CALL}>, meets array<struct<callee:string,param:string,rank:int>>, stored_returns array<struct<line:int,span:string>>"


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def extract(files: DataFrame, marker_modules: tuple[str, ...] = MARKER_MODULES) -> DataFrame:
    """One row of facts per file of ``files`` (path, source: string or binary)."""

    schema = _arrow(FACTS)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from memo.fact_batches(batch, marker_modules, schema)

    return spread(files.select("path", "source")).mapInArrow(run, FACTS)


def members(facts: DataFrame, *columns: str) -> DataFrame:
    """(path, module, ...) of every function, of its columns only those that are named: no others are read."""
    each = F.explode(F.arrays_zip(*[F.col(f"entities.{c}").alias(c) for c in columns])).alias("e")
    return facts.select("path", "module", each).select("path", "module", *[F.col(f"e.{c}") for c in columns])


def seed(entities: DataFrame, untrusted: tuple[str, ...] = ()) -> DataFrame:
    """qualname, body, ret, source, params, path, owner, module: the declared ranks, the weakest of several markers."""
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    good = F.filter("markers", lambda m: m["readable"] & m["allowed"])
    body = F.array_max(F.transform(good, lambda m: F.when(m["marker"] == "trusted", rank[m["level"]]).otherwise(F.lit(RANK["EXTERNAL_RAW"]))))
    ret = F.array_max(F.transform(good, lambda m: F.when(m["marker"] == "external_boundary", F.lit(RANK["EXTERNAL_RAW"])).otherwise(rank[m["level"]])))
    folded = entities.select("qualname", "path", body.alias("body"), ret.alias("ret"), "params", "owner", "module")
    config = F.col("qualname").isin(*untrusted) if untrusted else F.lit(False)
    source = F.when(config, "config").when(F.col("body").isNotNull(), "anchored").otherwise("fallback")
    own = lambda c: F.when(config, F.lit(RANK["EXTERNAL_RAW"])).otherwise(F.coalesce(c, F.lit(RANK["UNKNOWN_RAW"]))).cast("int")
    return folded.select("qualname", "path", own("body").alias("body"), own("ret").alias("ret"), source.alias("source"), "params", "owner", "module")


def _joined(rank, clash: bool):
    """Aggregate: what a value is that is made of all of these ranks."""
    return (provenance_clash(rank) if clash else F.max(rank)).cast("int")


def merged(seeds: DataFrame, clash: bool = False) -> DataFrame:
    """One set of ranks for each name: functions of the same name in several files meet, and count as
    undeclared where they are declared in different ways."""
    seeds = seeds.repartition("qualname")  # dealt once, for the fold and for the join
    whole = seeds.groupBy("qualname").agg(_joined(F.col("body"), clash).alias("body"), _joined(F.col("ret"), clash).alias("ret"), F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("fallback").alias("source"), F.min_by("params", "path").alias("params"))
    return seeds.select("path", "qualname", "owner", "module").distinct().join(_dealt(whole), "qualname").select("qualname", "path", "body", "ret", "source", "params", "owner", "module", F.lit(None).cast("string").alias("via"))


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, name: str = "path") -> DataFrame:
    """Deal files over all cores by name: a few bytes of source are much work, so neither the sizes of the stored files
    nor those after a join say how many tasks there should be.  By a hash of the name: dealt by the name itself, the
    rows of a join on it would stay where they are."""
    return df.repartition(_tasks(df), F.xxhash64(name))


def environment(facts: DataFrame, seeds: DataFrame, means: DataFrame | None = None, digest: bool = True) -> DataFrame:
    """(path, seeds, env) of each file: the seeds of its own functions and of those that its calls may mean, as JSON, and
    a ``digest`` of them.  ``means`` (name, qualname): names that are bound to functions of other modules."""
    own = seeds.select("path", "qualname", "body", "ret", "params", F.lit(None).cast("string").alias("real"))
    # A file's own functions are among its seeds in any case, and their names needn't be looked up.
    refs = facts.select("path", F.explode(F.array_except("references", F.coalesce("entities.qualname", F.array().cast("array<string>")))).alias("qualname"))
    rows = own.unionByName(refs.join(_dealt(own.drop("path")), "qualname").select(own.columns))
    if means is not None:
        bound = means.join(_dealt(seeds.select("qualname", "body", "ret", "params")), "qualname").select(F.col("name").alias("__name"), "body", "ret", "params", F.col("qualname").alias("real"))
        rows = rows.unionByName(refs.join(_dealt(bound), F.col("qualname") == F.col("__name")).select(own.columns))
    rows = rows.repartition("path").groupBy("path", "qualname").agg(F.max(F.struct("body", "ret", "params", "real")).alias("s"))
    env = rows.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("qualname", "s.body", "s.ret", "s.params", "s.real")))).alias("seeds"))
    return env.withColumn("env", F.sha2("seeds", 256) if digest else F.lit(None).cast("string"))


class Flows(NamedTuple):
    """``rows``: a row per function; ``settled``: whether the rounds reached the fixed point; ``seeds``: the seeds
    that held at the end; ``met`` (path, met): a digest of what each file was told, ``env`` (path, env) of what
    its calls mean; ``ran`` (path, round): which files were run, and when."""

    rows: DataFrame
    settled: bool
    seeds: DataFrame
    met: DataFrame
    env: DataFrame
    ran: DataFrame
    scratch: list[DataFrame]


def flow(
    files: DataFrame, facts: DataFrame, seeds: DataFrame, marker_modules: tuple[str, ...] = MARKER_MODULES, rounds: int | None = None, configured: Mapping[str, int] | None = None, clash: bool = False, held: DataFrame | None = None, keep: bool = False,
    means: DataFrame | None = None, inputs: DataFrame | None = None, injected: DataFrame | None = None, scoped: bool = True, once: bool = False,
) -> Flows:
    """Return ranks and argument ranks of every function of ``files``.

    Known ranks only rise, so the default bound - as often as all parameters can rise, and one more - is
    enough.  Past a bound, what any function returns is UNKNOWN_RAW at least, of no known callee.

    ``held`` (path, env, met, flows): what an earlier scan found in files that haven't changed.  A row counts if
    the file's calls still mean the same, and if the rows that count tell it the same: rows that don't are left
    out until that holds.  Only the other files are run, and those that they tell more.

    ``means``: as in ``environment``.  ``inputs`` (callee, param, rank): what parameters are given from outside.
    ``injected`` (callee, param, provider): parameters that are given what another function returns; they take
    part in the rounds like arguments.

    ``scoped``: whether ``seeds`` may be of further files than ``facts``.

    ``keep``: whether what a later scan needs is wanted; ``met`` is null without.

    ``once``: whether the rows will be read about once; then the rounds' tables are not written again as one.

    ``clash``: values of different provenance are mixed, and so is a function without a declaration whose
    callees differ: their ranks are found on the call graph, and the files that they matter to run again.
    """
    if rounds is None:
        cells = seeds.agg(F.sum(F.greatest(F.size("params"), F.lit(0)))).first()[0]
        rounds = RISES * max(1, cells or 0) + 1
    env = _cut(environment(facts, seeds, means, clash or keep or held is not None))
    read = facts.filter("status = 'ok'").select("path")
    # Where a fact counts, and from which rank on: functions; attributes of a class and names of a module
    # from the strongest function that can read them.
    here = seeds.join(facts.select("path").distinct(), "path", "left_semi") if scoped else seeds
    named = F.explode(F.array("qualname", F.concat("owner", F.lit("#")), F.concat("module", F.lit("#")))).alias("callee")
    targets = _cut(here.select(named, "path", "body").filter("callee IS NOT NULL").groupBy("callee", "path").agg(F.min("body").alias("body")))

    schema = _arrow(FLOW)
    library = dict(configured or {})

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from memo.flow_batches(batch, marker_modules, library, clash, schema)

    def told_by(rows: DataFrame) -> DataFrame:
        told = rows.select(F.explode("meets").alias("m")).select("m.*")
        if injected is None:
            return told
        given = rows.filter("ret IS NOT NULL").select(F.col("qualname").alias("provider"), F.col("ret").alias("rank"))
        return told.unionByName(_dealt(injected).join(given, "provider").select("callee", "param", "rank"))

    def with_inputs(told: DataFrame) -> DataFrame:
        return told if inputs is None else told.unionByName(inputs)

    def folded(told: DataFrame) -> DataFrame:
        return told.groupBy("callee", "param").agg(_joined(F.col("rank"), clash).alias("rank"))

    def by_path(told: DataFrame) -> DataFrame:
        """(path, meets, met): what each file is told, as JSON, and its digest."""
        at = told.join(_dealt(targets.select("callee", "path")), "callee").groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(F.struct("callee", "param", "rank")))).alias("meets"))
        return at.withColumn("met", F.sha2("meets", 256))

    def ran(paths: DataFrame | None, known: DataFrame | None) -> DataFrame:
        """The flow of some files, told what is known."""
        # Files without a row there have no functions.  The texts are dealt once, and all else comes to them.
        todo = env.select("path", "seeds") if paths is None else env.select("path", "seeds").join(_dealt(paths), "path", "left_semi")
        todo = todo.withColumn("meets", F.lit(None).cast("string")) if known is None else todo.join(_dealt(by_path(known).select("path", "meets")), "path", "left")
        texts = files.select("path", "source").repartition(_tasks(files), "path")
        return _cut(_dealt(texts).join(todo, "path").select("path", "source", "seeds", "meets").mapInArrow(run, FLOW))

    known, good = None, None
    if held is not None:
        good = _cut(held.join(_dealt(read), "path", "left_semi").join(_dealt(env.select("path", "env")), ["path", "env"], "left_semi"))
        while True:
            known = _cut(folded(with_inputs(told_by(good.select(F.explode("flows").alias("f")).select("f.*")))))
            now = by_path(known).select("path", F.col("met").alias("now"))
            still = _cut(good.join(_dealt(now), "path", "left").filter(F.col("met").eqNullSafe(F.col("now"))).drop("now"))
            same = still.count() == good.count()
            _drop(good)
            good = still
            if same:
                break
            _drop(known)
    # What each round gave, for the files that it ran.
    todo = None if good is None else read.join(_dealt(good.select("path")), "path", "left_anti")
    given = [ran(todo, known)]
    if clash:
        every = given[0] if good is None else given[0].unionByName(good.select(F.explode("flows").alias("f")).select("f.*"))
        edges = every.select(F.col("qualname").alias("caller"), F.explode("calls.callee").alias("callee")).filter("callee IS NOT NULL")
        nodes = seeds.select(F.col("qualname").alias("node"), F.col("body").alias("rank"), F.col("source").isin("anchored", "config").alias("anchored"), F.col("ret").alias("returned")).distinct()
        rose = semi_naive(nodes, edges, clashing=True).changes.select(F.col("node").alias("qualname"), F.col("rank").alias("to"), F.col("via").alias("by"))
        to = lambda c, new: F.coalesce(F.col(new), F.col(c)).alias(c)
        seeds = _cut(seeds.join(rose, "qualname", "left").select("qualname", "path", to("body", "to"), to("ret", "to"), F.when(F.col("to").isNotNull(), "callgraph").otherwise(F.col("source")).alias("source"), "params", "owner", "module", to("via", "by")))
        before, env = env, _cut(environment(facts, seeds, means))
        given.append(ran(env.join(before.select("path", "env"), ["path", "env"], "left_anti").select("path"), known))
        _drop(before)
    settled, first, again = False, True, []
    for done in range(rounds + 1):
        told = told_by(reduce(DataFrame.unionByName, given if first else given[-1:]))
        told = _cut(folded(with_inputs(told) if known is None else told.unionByName(known)))
        fresh = told if known is None else told.join(_dealt(known), ["callee", "param", "rank"], "left_anti")
        weaker = F.col("rank") != F.col("body") if clash else F.col("rank") > F.col("body")
        aim = fresh.join(_dealt(targets), "callee")
        if injected is not None:  # nothing was known of these parameters before
            aim = aim.join(_dealt(injected.select("callee", "param", F.lit(True).alias("__in")).distinct()), ["callee", "param"], "left")
            weaker = weaker | F.col("__in").isNotNull()
        dirty = _cut(aim.filter(weaker).select("path").distinct())
        if known is not None:
            _drop(known)
        known, first = told, False
        if not dirty.limit(1).count():
            settled = True
        if settled or done == rounds:
            _drop(dirty)
            break
        given.append(ran(dirty, known))
        again.append(dirty)
    met = _cut(by_path(known).select("path", "met")) if keep else env.select("path", F.lit(None).cast("string").alias("met"))
    _drop(known)
    _drop(targets)
    if good is None and not clash and len(given) <= FEW:
        # A file that is run again gives all its rows again: of a round, the files of later ones go.
        parts = [g.join(_dealt(reduce(DataFrame.unionByName, again[k:])), "path", "left_anti") for k, g in enumerate(given[:-1])]
        out = reduce(DataFrame.unionByName, [*parts, given[-1]])
        if not once and len(given) > 1:
            out = _cut(out)
            for g in given:
                _drop(g)
        told_when = reduce(DataFrame.unionByName, [a.select("path", F.lit(k).alias("round")) for k, a in enumerate([out.select("path").distinct(), *again])])
        scratch = [out, met, env, *given, *again]
    else:
        every = reduce(DataFrame.unionByName, [g.withColumn("round", F.lit(k)) for k, g in enumerate(given)])
        told_when, out = every.select("path", "round").distinct(), given[0]
        if len(given) > 1 or good is not None:
            told_when = _cut(told_when)
        if len(given) > 1:  # of each file, the last round that ran it
            last = told_when.groupBy("path").agg(F.max("round").alias("round"))
            out = _cut(every.join(_dealt(last), ["path", "round"]).drop("round"))
            for g in (*given, *again):
                _drop(g)
        scratch = [out, met, env, told_when]
    if good is not None:
        out = good.join(_dealt(told_when.select("path")), "path", "left_anti").select(F.explode("flows").alias("f")).select("f.*").unionByName(out)
        scratch.append(good)
    if not settled:
        ret = F.when(F.col("ret").isNotNull(), F.greatest("ret", F.lit(RANK["UNKNOWN_RAW"]))).cast("int")
        out = out.withColumn("ret", ret).withColumn("ret_callee", F.lit(None).cast("string"))
    return Flows(out, settled, seeds, met, env.select("path", "env"), told_when, scratch)


def policy(settings: Mapping) -> tuple[tuple[str, ...] | None, dict[str, str], list[tuple[str, str, str]]]:
    """(rule patterns, severities by rule, problems: message, reason and what tells them apart) of the settings'
    ``rules``.  What is wrong there is a finding, and isn't honoured."""
    given = settings.get("rules") or {}
    patterns, severities, wrong = given.get("enable"), {}, []
    if patterns is not None:
        patterns = tuple(patterns)
        if not patterns:
            wrong.append(("rules.enable selects no policy rules", "empty_enable_patterns", "rules.enable:empty"))
        for p in patterns:
            if not selected((p,)):
                wrong.append((f"rules.enable pattern {p!r} matches no known policy rules", "unknown_rule_pattern", f"rules.enable:{p}"))
        if patterns and not selected(patterns):
            wrong.append(("rules.enable selects no known policy rules", "empty_effective_ruleset", f"rules.enable:empty-effective:{','.join(patterns)}"))
    for rule, severity in (given.get("severity") or {}).items():
        if rule not in (*RULES, *EXTRA):
            wrong.append((f"rules.severity override {rule!r} is not a known policy rule", "unknown_severity_rule", f"rules.severity:{rule}:unknown"))
        elif severity not in ("CRITICAL", "ERROR", "WARN", "INFO", "NONE"):
            wrong.append((f"rules.severity override for {rule!r} is not a valid severity", "invalid_severity", f"rules.severity:{rule}:invalid:{severity}"))
        elif severity == "NONE":
            wrong.append((f"rules.severity override for {rule!r} cannot be NONE", "none_severity_override", f"rules.severity:{rule}:NONE"))
        else:
            severities[rule] = severity
    return patterns, severities, wrong


def scan(
    files: DataFrame, untrusted: tuple[str, ...] = (), marker_modules: tuple[str, ...] = MARKER_MODULES, rules: tuple[str, ...] | None = None, settings: Mapping | None = None, diagnose: bool = True,
    cached: DataFrame | None = None, secret: bytes | None = None, scope: DataFrame | None = None, seis: DataFrame | None = None, changed: DataFrame | None = None, since: str = "",
) -> dict[str, DataFrame]:
    """findings, functions, calls and facts of a project given as (path, source).

    ``rules``: patterns of rule ids.  ``settings``: what ``credence.sources.stores.config`` reads; its roots,
    excluded paths, sources, sanitisers, provenance join, rule patterns and severities are applied.  ``diagnose``:
    whether the findings about the project and the settings are wanted beside those of rules, files and functions.

    With a ``secret`` the result has ``cache``, a table to keep, each row with a MAC.  Given back as ``cached``, its
    rows stand for the files that haven't changed; only the others, and those that they bear on, are parsed.

    ``scope`` (locator, sei; ``seis`` as in ``match_scope``): only the named entities are wanted.  Then the files
    that hold them and all that lead there are run, findings are those on the entities, and ``report`` has a row on how
    far they go; a scope that names nothing known means a full scan.  ``changed`` (path) with a scope: active defects of
    the scope outside these files and entities are relabelled as of ``since``.

    ``work`` (path, step) lists the files that were parsed for facts (step -1) and run in each round.
    """
    settings = settings or {}
    scratch: list[DataFrame] = []
    try:
        return _scan(files, untrusted, marker_modules, rules, settings, diagnose, cached, secret, scope, seis, changed, since, scratch)
    except BaseException:
        for df in scratch:
            _drop(df)
        raise


def _scan(files, untrusted, marker_modules, rules, settings, diagnose, cached, secret, scope, seis, changed, since, scratch) -> dict[str, DataFrame]:
    keep = lambda df: scratch.append(df) or df
    whole, roots = files, tuple(settings.get("source_roots", ())) or (".",)
    files = in_project(files, roots, tuple(settings.get("exclude", ())))
    # Markers mean the installed package: a project that has a module of that name defines none of them.
    tops = [m.partition(".")[0] for m in marker_modules]
    maybe = reduce(lambda a, b: a | b, [F.col("path").contains(t) for t in tops], F.lit(False))  # few have their names taken apart
    own = {r["root"] for r in in_project(whole.filter(maybe), roots, tuple(settings.get("exclude", ()))).select(F.substring_index(module_name(F.col("path")), ".", 1).alias("root")).filter(F.col("root").isin(*tops)).distinct().collect()}
    marker_modules = tuple(m for m in marker_modules if m.partition(".")[0] not in own)
    patterns, severities, wrong = policy(settings)
    clash = bool(settings.get("provenance_clash", False))
    sources, sanitisers = (tuple(settings.get(k, ())) for k in ("untrusted_sources", "sanitisers"))
    configured = {**dict.fromkeys(sanitisers, RANK["ASSURED"]), **dict.fromkeys(sources, RANK["EXTERNAL_RAW"])}
    held, todo = None, files
    if secret is not None:
        rule = policy_hash({"untrusted": sorted((*untrusted, *sources)), "sanitisers": sorted(sanitisers), "markers": sorted(marker_modules), "clash": clash})
        files = files.withColumn("cache_key", cache_key(F.col("path"), F.col("source"), rule))
        todo = files
        if cached is not None:
            keys = keep(_cut(verified(cached, secret).select("cache_key", "path").join(_dealt(files.select("cache_key", "path")), ["cache_key", "path"], "left_semi")))
            held = cached.join(_dealt(keys), ["cache_key", "path"], "left_semi")
            todo = files.join(_dealt(keys.select("path")), "path", "left_anti")
    facts = keep(_cut(extract(todo, marker_modules)))
    work = facts.select("path", F.lit(-1).alias("step"))
    if held is not None:
        facts = facts.unionByName(held.select("facts.*"))
    entities = facts.select(F.explode("entities").alias("e")).select("e.*")
    seeds = keep(_cut(merged(seed(members(facts, "qualname", "owner", "params", "markers"), (*untrusted, *sources)), clash)))
    aliases = project_aliases(facts)
    means = None
    if aliases is not None:
        keep(aliases)
        means = keep(_cut(meanings(facts.select(F.explode("references").alias("name")), aliases, seeds)))
    given = injected_params(members(facts, "qualname", "depends"), seeds, aliases)
    if given is not None:
        keep(given)
    bodies, degraded = None, None
    typed = members(facts, "qualname", "typed")
    if typed.filter(F.size("typed") > 0).limit(1).count():
        found_models = model_closure(facts, aliases)
        degraded = found_models.degraded
        bodies = keep(_cut(request_bodies(typed, found_models.models, aliases, UNREADABLE, RANK["EXTERNAL_RAW"])))
    rules = rules if rules is not None else patterns
    # What the rules read once is not written to be read.
    once = not diagnose and secret is None and scope is None and reads(rules) <= 1
    matched, mode = None, None
    if scope is not None:
        matched = keep(_cut(match_scope(scope, entities, seis)))
        mode = matched.filter("path IS NOT NULL").limit(1).count() > 0
    # Where the facts are of the project's files alone, its filters needn't be applied to each round's texts again.
    part, some, texts = files, facts, whole
    if mode:
        paths = keep(_cut(files_to_scan(matched, file_edges(facts, seeds, means), callees=clash or given is not None)))
        part, some = files.join(paths, "path", "left_semi"), facts.join(paths, "path", "left_semi")
        texts = part
        entities = entities.join(paths, "path", "left_semi")
    done = flow(texts, some, seeds, marker_modules, configured=configured, clash=clash, held=None if held is None else held.filter("flows IS NOT NULL").select("path", "env", "met", "flows"), keep=secret is not None, means=means, inputs=bodies, injected=given, scoped=bool(mode), once=once)
    flows, settled = done.rows, done.settled
    scratch += [*done.scratch, done.seeds]
    seeds = done.seeds
    functions = entities.join(_dealt(seeds.select("qualname", "path", "body", "ret", "source", "via")), ["qualname", "path"]).join(
        _dealt(flows.select("qualname", "path", "status", F.col("ret").alias("actual"), "ret_callee", "stored_returns")), ["qualname", "path"], "left"
    )
    if not once:
        functions = keep(_cut(functions))
    calls = flows.select("path", "qualname", F.explode("calls").alias("c")).select("path", "qualname", "c.*")
    found, failed = apply_rules(functions, calls, seeds, rules, severities)
    about = diagnostics(some, flows, settled)
    out = {"functions": functions, "calls": calls, "facts": facts, "work": work.unionByName(done.ran.select("path", F.col("round").alias("step"))), "scratch": scratch}
    if secret is not None:
        rows = flows.groupBy("path").agg(F.collect_list(F.struct(*[f.name for f in flows.schema.fields])).alias("flows"))
        # Files without functions have no flows, and files out of scope none that could be kept.
        ok = facts.join(_dealt(files.select("path", "cache_key")), "path").select("cache_key", "path", F.struct(*facts.columns).alias("facts"))
        ok = ok.join(_dealt(done.env), "path", "left").join(_dealt(done.met), "path", "left").join(_dealt(rows), "path", "left")
        covered = F.lit(settled) & (F.col("facts.status") == "ok") & (F.col("env").isNotNull())
        out["cache"] = signed(ok.withColumn("flows", F.when(covered, F.coalesce("flows", F.array().cast(flows_type(flows))))), secret)
    if not diagnose:
        return _scoped(out, about if found is None else found.unionByName(about), matched, mode, whole, part, changed, since)
    about = about.unionByName(project_diagnostics(some, members(some, "qualname", "line_start"), functions, calls, marker_modules))
    told = [("WLN-ENGINE-POLICY-CONFIG", text, "ERROR", "defect", ENGINE_PATH, key, {"reason": reason}) for text, reason, key in wrong]
    if degraded:
        told.append(("WLN-ENGINE-PYDANTIC-DISCOVERY-LIMIT", f"the search for models went past its budget; every class counts as one ({degraded['reason']})", "ERROR", "defect", ENGINE_PATH, degraded["reason"], {k: str(v) for k, v in degraded.items()}))
    told += [("WLN-ENGINE-RULE-FAILED", f"rule {r} aborted ({why})", "ERROR", "defect", ENGINE_PATH, r, {"rule": r}) for r, why in failed.items()]
    about = about.unionByName(_told(facts, told))
    if "source_roots" in settings:
        about = about.unionByName(lost_roots(whole, roots))
    if configured:
        about = about.unionByName(unused_settings(facts, sources, sanitisers))
    every = keep(_cut(about if found is None else found.unionByName(about)))
    twice = fingerprint_collisions(every.withColumn("properties", F.to_json("properties"))).select("fingerprint", "members")
    rule = F.lit("WLN-ENGINE-FINGERPRINT-COLLISION")
    clashes = twice.select(
        *_columns(rule, F.concat(F.col("members").cast("string"), F.lit(" findings share a fingerprint")), "ERROR", "defect", F.lit(ENGINE_PATH), F.lit(None), F.lit(None).cast("string"), F.col("fingerprint"), F.create_map(F.lit("fingerprint"), F.col("fingerprint")))
    )
    return _scoped(out, every.unionByName(clashes), matched, mode, whole, part, changed, since)


def flows_type(flows: DataFrame) -> str:
    return f"array<{flows.schema.simpleString()}>"


def _scoped(out: dict, findings: DataFrame, matched: DataFrame | None, mode: bool | None, files: DataFrame, part: DataFrame, changed: DataFrame | None, since: str) -> dict:
    """The result of a scan: all its findings, or those of its scope with a report."""
    if matched is not None:
        named = matched.filter("path IS NOT NULL")
        if mode:
            findings = display_filter(findings, named.select("qualname"), named.select("path"))
        if changed is not None:
            findings = delta_relabel(findings, changed, named.select("qualname"), since)
        out |= {"scope": matched, "report": delta_report(matched, files.select("path"), part.select("path"), findings)}
    return {"findings": findings, **out}


def finish(out: Mapping) -> None:
    """Remove the tables of a scan whose frames nobody reads any more."""
    for df in out["scratch"]:
        _drop(df)


def _columns(rule, message, severity: str, kind: str, path, line, qualname, key, properties) -> list:
    """The columns of an engine finding; ``key`` tells it from others of its rule."""
    return [
        rule.alias("rule_id"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), path.alias("path"), line.cast("int").alias("line_start"), qualname.alias("qualname"),
        fingerprint(rule, path, qualname, key).alias("fingerprint"), properties.cast("map<string,string>").alias("properties"), F.lit("active").alias("suppression_state"), F.lit(None).cast("string").alias("suppression_reason"), F.lit("stable").alias("maturity"),
    ]


def _told(facts: DataFrame, rows: list[tuple]) -> DataFrame:
    """Findings that the driver knows: a few about settings and rules."""
    t = facts.sparkSession.createDataFrame(rows, "rule string, text string, severity string, kind string, at string, key string, more map<string,string>")
    out = t.select(*_columns(F.col("rule"), F.col("text"), "", "", F.col("at"), F.lit(None), F.lit(None).cast("string"), F.col("key"), F.col("more")), F.col("severity").alias("__severity"), F.col("kind").alias("__kind"))
    return out.withColumn("severity", F.col("__severity")).withColumn("kind", F.col("__kind")).drop("__severity", "__kind")


def lost_roots(files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """A fact for each configured root below which there is nothing."""
    root = F.col("root")
    return missing_roots(files, roots).select(*_columns(F.lit("WLN-ENGINE-SOURCE-ROOT-MISSING"), F.concat(F.lit("source root "), root, F.lit(" holds no file")), "NONE", "fact", root, F.lit(None), F.lit(None).cast("string"), root, F.create_map(F.lit("root"), root)))


def unused_settings(facts: DataFrame, sources: tuple[str, ...], sanitisers: tuple[str, ...]) -> DataFrame:
    """A fact for each configured name that no call of the project may mean."""
    rows = [("WLN-CONFIG-UNUSED-SOURCE", "source", s) for s in sources] + [("WLN-CONFIG-UNUSED-SANITISER", "sanitiser", s) for s in sanitisers]
    named = facts.sparkSession.createDataFrame(rows, "rule string, what string, name string")
    used = facts.select(F.explode("references").alias("name")).unionByName(facts.select(F.explode("entities.qualname").alias("name"))).distinct()
    left = unused_directives(named, used)
    text = F.concat(F.lit("configured "), F.col("what"), F.lit(" "), F.col("name"), F.lit(" matches no call"))
    return left.select(*_columns(F.col("rule"), text, "NONE", "fact", F.lit("<config>"), F.lit(None), F.lit(None).cast("string"), F.col("name"), F.create_map("what", "name")))


def project_diagnostics(facts: DataFrame, entities: DataFrame, functions: DataFrame, calls: DataFrame, marker_modules: tuple[str, ...]) -> DataFrame:
    """Findings about the project as a whole: repeated names, unknown imports, functions most of whose calls
    lead nowhere known, and the run's counts."""
    none = F.lit(None).cast("string")
    twice = duplicate_names(entities)
    first = F.element_at("places", 1)
    places = F.to_json("places")
    out = twice.select(*_columns(F.lit("WLN-ENGINE-DUPLICATE-FQN"), F.concat(F.col("qualname"), F.lit(" is defined "), F.col("definitions").cast("string"), F.lit(" times")), "ERROR", "defect", first["path"], first["line_start"], F.col("qualname"), none, F.create_map(F.lit("places"), places)))
    # A module is known by its own name and by those of the packages around it.
    own = facts.select(module_name(F.col("path")).alias("m")).filter("m IS NOT NULL").distinct()
    parts = F.split("m", r"\.")
    known = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("package")).distinct()
    taken = facts.select("path", F.explode("imports").alias("package")).filter(~F.substring_index("package", ".", 1).isin(*sorted(sys.stdlib_module_names), "__future__") & ~F.col("package").isin(*marker_modules))
    lost = taken.join(known, "package", "left_anti").distinct()
    out = out.unionByName(lost.select(*_columns(F.lit("WLN-ENGINE-UNKNOWN-IMPORT"), F.concat(F.col("package"), F.lit(" is no module of the project or the standard library")), "NONE", "fact", F.col("path"), F.lit(None), none, F.col("package"), F.create_map(F.lit("package"), F.col("package")))))
    low = low_resolution(calls.select(F.struct("path", "qualname").alias("caller"), F.col("callee").isNotNull().alias("resolved")))
    text = F.concat(F.col("caller.qualname"), F.lit(": "), F.col("percent").cast("string"), F.lit("% of its calls are unresolved"))
    out = out.unionByName(low.select(*_columns(F.lit("WLN-L3-LOW-RESOLUTION"), text, "INFO", "metric", F.col("caller.path"), F.lit(None), F.col("caller.qualname"), none, F.create_map(F.lit("percent"), F.col("percent").cast("string")))))
    # Counts by source of the ranks: three at most.
    counts = functions.groupBy("source").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.col("count").cast("string"))))).alias("counts"))
    return out.unionByName(counts.select(*_columns(F.lit("WLN-ENGINE-METRICS"), F.lit("run metrics"), "NONE", "metric", F.lit(ENGINE_PATH), F.lit(None), none, none, F.col("counts"))))


def diagnostics(facts: DataFrame, flows: DataFrame, settled: bool) -> DataFrame:
    """Findings about the scan itself: files and functions that were not analysed."""
    rule = F.create_map(F.lit("parse-error"), F.lit("WLN-ENGINE-PARSE-ERROR"), F.lit("decode-error"), F.lit("WLN-ENGINE-FILE-FAILED"), F.lit("skipped"), F.lit("WLN-ENGINE-FILE-SKIPPED"), F.lit("no-module"), F.lit("WLN-ENGINE-NO-MODULE"))
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    files = facts.filter("status <> 'ok'").select(
        rule[F.col("status")].alias("rule_id"), "message", F.when(F.col("status") == "no-module", "NONE").otherwise("ERROR").alias("severity"), F.when(F.col("status") == "no-module", "fact").otherwise("defect").alias("kind"),
        "path", F.lit(1).alias("line_start"), none.alias("qualname"), fingerprint(rule[F.col("status")], F.col("path"), none, none).alias("fingerprint"), empty.alias("properties"),
    )
    skipped = F.lit("WLN-ENGINE-FUNCTION-SKIPPED")
    functions = flows.filter("status = 'skipped'").select(
        skipped.alias("rule_id"), F.lit("step budget exceeded").alias("message"), F.lit("ERROR").alias("severity"), F.lit("defect").alias("kind"), "path", F.lit(1).alias("line_start"), "qualname",
        fingerprint(skipped, F.col("path"), F.col("qualname"), none).alias("fingerprint"), empty.alias("properties"),
    )
    out = files.unionByName(functions)
    if not settled:
        bound = F.lit("WLN-ENGINE-L2-CONVERGENCE-BOUND")
        row = facts.limit(1).select(bound.alias("rule_id"), F.lit("argument ranks still rise at the bound").alias("message"), F.lit("NONE").alias("severity"), F.lit("fact").alias("kind"), F.lit("<engine>").alias("path"), F.lit(None).cast("int").alias("line_start"), none.alias("qualname"), fingerprint(bound, F.lit("<engine>"), none, none).alias("fingerprint"), empty.alias("properties"))
        out = out.unionByName(row)
    return out.withColumn("suppression_state", F.lit("active")).withColumn("suppression_reason", none).withColumn("maturity", F.lit("stable"))


def read_sources(spark, root: str, glob: str = "*.py", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, source) of the files below ``root`` in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    path = F.element_at(F.split("path", base[base.find("/") :] if "://" in base else base, 2), -1)
    out = files.select(path.alias("path"), F.col("content").alias("source"))
    for pattern in excluded:
        out = out.filter(~F.col("path").rlike(glob_pattern(pattern)))
    return out


__all__ = ["extract", "finish", "flow", "merged", "module_of", "policy", "read_sources", "scan", "seed"]
