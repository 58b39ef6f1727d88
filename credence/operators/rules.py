"""The rules as predicates on frames of functions and calls.

Sink rules share one plan: calls joined with a broadcast table of sinks, the ranks of the slots that matter
folded by max, and kept if raw; the tier of the innermost declared scope modulates the severity.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.identity import fingerprint
from credence.functions.lattice import RAW_FROM, modulate, state_name
from credence.operators.graphs import _cut, enclosing_tier

#: Parts of the sinks' names.
_PATHS = "read_text read_bytes write_text write_bytes open unlink rmdir mkdir".split()
_VERBS = "get post put patch delete head options".split()
_LOG = "debug info warning error critical exception".split()
_ARCHIVES = "tarfile.open tarfile.TarFile zipfile.ZipFile".split()


def _all(names: str) -> dict:
    return {n: (None, None) for n in names.split()}


def _slots(names: str, positions: tuple[int, ...], *keywords: str) -> dict:
    return {n: (positions, keywords) for n in names.split()}


#: Rule -> (base severity, label, {sink: (positions, keywords)}); None: every slot counts.
SINKS: dict[str, tuple[str, str, dict]] = {
    "PY-WL-106": ("WARN", "deserialization", {
        **_all("pickle.loads pickle.load marshal.loads marshal.load yaml.load yaml.load_all yaml.unsafe_load yaml.full_load"),
        **_slots("shelve.open joblib.load", (0,), "filename"), **_slots("dill.load numpy.load pickle.Unpickler.load", (0,), "file"), **_slots("dill.loads", (0,), "str"),
        **_slots("jsonpickle.decode", (0,), "string"), **_slots("torch.load", (0,), "f"),
    }),
    "PY-WL-107": ("WARN", "dynamic-code", _all("eval exec compile builtins.eval builtins.exec builtins.compile __builtins__.eval __builtins__.exec __builtins__.compile")),
    "PY-WL-108": ("ERROR", "OS-command", _all(
        "os.system os.popen subprocess.getoutput subprocess.getstatusoutput os.execl os.execle os.execlp os.execlpe os.execv os.execve os.execvp os.execvpe "
        "os.spawnl os.spawnle os.spawnlp os.spawnlpe os.spawnv os.spawnve os.spawnvp os.spawnvpe os.posix_spawn os.posix_spawnp pty.spawn")),
    "PY-WL-112": ("ERROR", "shell subprocess", _all("subprocess.run subprocess.call subprocess.check_call subprocess.check_output subprocess.Popen")),
    "PY-WL-115": ("WARN", "dynamic-import", _all("importlib.import_module __import__ runpy.run_path runpy.run_module importlib.util.spec_from_file_location")),
    "PY-WL-116": ("WARN", "path", {
        **_all("open builtins.open os.open os.path.join pathlib.Path os.remove os.unlink os.rmdir os.makedirs os.mkdir os.rename os.renames os.replace "
               "shutil.rmtree shutil.copy shutil.copy2 shutil.copyfile shutil.copytree shutil.move"),
        **_all(" ".join(f"pathlib.Path.{m}" for m in _PATHS)), **_all(" ".join(f"{a}.{m}" for a in _ARCHIVES for m in ("extractall", "extract"))),
    }),
    "PY-WL-117": ("WARN", "HTTP-client", {
        **_slots(" ".join(f"{p}.{v}" for p in ("requests", "httpx", "httpx.Client", "httpx.AsyncClient", "requests.Session", "aiohttp.ClientSession") for v in _VERBS), (0,), "url"),
        **_slots("urllib.request.urlopen urllib.request.Request", (0,), "url"), **_slots("requests.request httpx.request httpx.stream httpx.Client.request httpx.AsyncClient.request httpx.Client.stream httpx.AsyncClient.stream requests.Session.request aiohttp.ClientSession.request", (1,), "url"),
        **_slots("httpx.Client httpx.AsyncClient", (), "base_url"), **_slots("aiohttp.ClientSession", (0,), "base_url"),
    }),
    "PY-WL-121": ("ERROR", "XML", {
        **_slots("xml.etree.ElementTree.fromstring xml.etree.ElementTree.XML lxml.etree.fromstring lxml.etree.XML", (0,), "text"),
        **_slots("xml.etree.ElementTree.parse xml.etree.ElementTree.iterparse xml.sax.parse lxml.etree.parse", (0,), "source"),
        **_slots("xml.dom.minidom.parse", (0,), "file"), **_slots("xml.dom.minidom.parseString xml.sax.parseString", (0,), "string"),
    }),
    "PY-WL-122": ("ERROR", "template", {**_slots("jinja2.Template jinja2.Environment.from_string", (0,), "source"), **_slots("mako.template.Template", (0,), "text")}),
    "PY-WL-123": ("WARN", "reflection", _slots("setattr getattr builtins.setattr builtins.getattr", (1,))),
    "PY-WL-124": ("ERROR", "native-load", {**_slots("ctypes.CDLL ctypes.WinDLL ctypes.OleDLL ctypes.PyDLL", (0,), "name"), **_slots("ctypes.cdll.LoadLibrary", (0,))}),
    "PY-WL-125": ("INFO", "log", _slots(" ".join(f"{p}.{m}" for p in ("logging", "logging.getLogger", "logging.Logger") for m in _LOG), (0,), "msg")),
    "PY-WL-126": ("WARN", "mail", _slots("smtplib.SMTP.sendmail smtplib.SMTP_SSL.sendmail", (1, 2), "to_addrs", "msg")),
}
#: Sinks judged by what their receiver was built from, strings for a shell, and previews.
ANCHORED = frozenset(["pickle.Unpickler.load", *(f"pathlib.Path.{m}" for m in _PATHS), *(f"{a}.{m}" for a in _ARCHIVES for m in ("extractall", "extract"))])
SHELL_STRINGS = ("os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput")
PREVIEW = frozenset(f"PY-WL-{n}" for n in (116, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126))
#: Where a statement is given, and words that speak for and against a database.
SQL_SLOTS = ("0", "=operation", "=sql", "=query", "=statement", "=sql_script")
DB_TOKENS = "cursor cur conn connection db database session engine sql sqlite postgres psql mysql oracle tx txn transaction".split()
NON_DB_TOKENS = "pool executor thread threads scheduler worker workers dispatcher queue task tasks job jobs".split()
DB_MODULES = "sqlite3 aiosqlite apsw duckdb psycopg2 psycopg asyncpg pg8000 pymysql MySQLdb mysql mariadb cx_Oracle oracledb pyodbc sqlalchemy".split()
NON_DB_MODULES = "concurrent multiprocessing threading asyncio".split()


#: Every rule's own severity, before it is modulated.
BASE = {
    **{f"PY-WL-{n}": "ERROR" for n in (101, 102, 105, 110, 111, 113, 114, 118, 119, 120)}, "PY-WL-110": "WARN", "PY-WL-109": "WARN", "PY-WL-103": "WARN", "PY-WL-104": "WARN", **{rule: base for rule, (base, _, _) in SINKS.items()},
}
Severities = Mapping[str, str]


def sink_table(spark: SparkSession, severities: Severities = BASE) -> DataFrame:
    """A fixed table of a few hundred rows."""
    rows = []
    for rule, (base, label, sinks) in SINKS.items():
        for fqn, (positions, keywords) in sinks.items():
            own = severities[rule] if severities[rule] != base else "WARN" if rule == "PY-WL-121" and fqn.startswith("xml.") else base
            rows.append((rule, fqn, own, label, positions is None, [str(p) for p in positions or ()], [f"={k}" for k in keywords or ()], fqn in ANCHORED))
    return spark.createDataFrame(rows, "rule_id string, fqn string, base string, label string, every boolean, positions array<string>, keywords array<string>, anchored boolean")


def _finding(df: DataFrame, rule: Column, severity: Column, message: Column, line: Column, discriminator: Column, properties: Column) -> DataFrame:
    return df.select(
        rule.alias("rule_id"), message.alias("message"), severity.alias("severity"), F.lit("defect").alias("kind"), "path", line.cast("int").alias("line_start"), "qualname",
        fingerprint(rule, F.col("path"), F.col("qualname"), discriminator).alias("fingerprint"), properties.alias("properties"), F.lit("active").alias("suppression_state"),
        F.lit(None).cast("string").alias("suppression_reason"), F.when(rule.isin(*PREVIEW), "preview").otherwise("stable").alias("maturity"),
    )


def _map(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c)])


def _per_function(df: DataFrame, rule: str, severity: str, text: str, properties: Column | None = None) -> DataFrame:
    body = F.concat(F.lit("entity:"), F.col("body_sha"))
    return _finding(df, F.lit(rule), F.lit(severity), F.concat(F.col("qualname"), F.lit(f": {text}")), F.col("line_start"), body, _map(declared_return=state_name(F.col("ret"))) if properties is None else properties)


BOUNDARY_RULES = tuple(f"PY-WL-{n}" for n in (101, 102, 109, 110, 111, 113, 114, 119))


def boundary_rules(functions: DataFrame, severities: Severities = BASE) -> dict[str, DataFrame]:
    """Rules on what a function declares and on the shape of its body."""
    f = functions.filter("source = 'anchored'")
    raising = f.filter("body > ret")
    # One-hop helpers in the same module: their rejections count for the boundary.
    calls = raising.select("qualname", "path", F.explode("helpers").alias("h"))
    helper = functions.select(F.col("qualname").alias("h"), "path", F.col("real_rejection").alias("hr"), F.col("assert_only").alias("ha"))
    helped = calls.join(helper, ["path", "h"]).groupBy(F.col("qualname").alias("q"), F.col("path").alias("p")).agg(F.max("hr").alias("help_real"), F.max("ha").alias("help_assert"))
    raising = raising.join(helped, (F.col("qualname") == F.col("q")) & (F.col("path") == F.col("p")), "left").withColumns({"help_real": F.coalesce("help_real", F.lit(False)), "help_assert": F.coalesce("help_assert", F.lit(False))})
    ranks = _map(body_taint=state_name(F.col("body")), return_taint=state_name(F.col("ret")))
    leak = f.filter(f"ret < {RAW_FROM} AND body <= ret AND actual > ret")
    none = f.filter(f"ret < {RAW_FROM} AND body <= ret AND leaks_none")
    marks = functions.filter(F.size(F.array_distinct("markers.marker")) >= 2).filter("source = 'anchored'")
    level = functions.select("*", F.explode("markers").alias("m")).filter("m.readable AND NOT m.allowed")
    own = severities.__getitem__
    found = [
        _per_function(leak, "PY-WL-101", own("PY-WL-101"), "returns data less trusted than it declares", _map(declared_return=state_name(F.col("ret")), actual_return=state_name(F.col("actual")))),
        _per_function(raising.filter("NOT any_rejection AND NOT degenerate AND NOT help_real AND NOT help_assert"), "PY-WL-102", own("PY-WL-102"), "declares a trust boundary but can't reject", ranks),
        _per_function(none, "PY-WL-109", own("PY-WL-109"), "declares a trusted value but may return None"),
        _per_function(marks, "PY-WL-110", own("PY-WL-110"), "carries contradictory trust markers"),
        _per_function(raising.filter("(assert_only AND NOT help_real) OR (NOT any_rejection AND NOT degenerate AND help_assert AND NOT help_real)"), "PY-WL-111", own("PY-WL-111"), "rejects only by assert", ranks),
        _per_function(raising.filter("real_rejection AND fails_open"), "PY-WL-113", own("PY-WL-113"), "substitutes a value where its check fails", ranks),
        _finding(level, F.lit("PY-WL-114"), F.lit(own("PY-WL-114")), F.concat(F.col("qualname"), F.lit(": level "), F.col("m.level"), F.lit(" is not allowed")), F.col("line_start"), F.concat_ws("", F.col("m.marker"), F.lit(":"), F.col("m.level"), F.lit("#"), F.col("m.ordinal").cast("string")), _map(level=F.col("m.level"))),
        _per_function(raising.filter("degenerate"), "PY-WL-119", own("PY-WL-119"), "returns its parameter unchecked", ranks),
    ]
    return dict(zip(BOUNDARY_RULES, found))


def handler_rules(tiered: DataFrame, severities: Severities = BASE) -> dict[str, DataFrame]:
    h = tiered.select("*", F.explode("handlers").alias("h"))
    out = {}
    for rule, flag, text in (("PY-WL-103", "broad", "broad except"), ("PY-WL-104", "silent", "silent except")):
        severity = modulate(F.lit(severities[rule]), F.col("tier"))
        hit = h.filter(f"h.{flag}").filter(severity != "NONE")
        out[rule] = _finding(hit, F.lit(rule), severity, F.concat(F.col("qualname"), F.lit(f": {text}")), F.col("h.line"), F.col("h.span"), _map(tier=state_name(F.col("tier"))))
    return out


def sink_rules(calls: DataFrame, tiers: DataFrame, severities: Severities = BASE, wanted: tuple[str, ...] = tuple(SINKS)) -> DataFrame:
    table = F.broadcast(sink_table(calls.sparkSession, severities).filter(F.col("rule_id").isin(*wanted)))
    c = calls.join(table, "fqn")
    lit = lambda s: F.array_contains("literal", s)
    accept = ~((F.col("fqn") == "numpy.load") & ~lit("allow_pickle=True")) & ~((F.col("fqn") == "torch.load") & lit("weights_only=True"))
    accept = accept & ~((F.col("rule_id") == "PY-WL-112") & ~lit("shell=True")) & ~(F.col("fqn").rlike(r"\.extract(all)?$") & lit("filter='data'"))
    slots = F.when(F.col("anchored"), F.col("built")).otherwise(F.col("slots"))
    quoted = F.col("fqn").isin(*SHELL_STRINGS)

    def counts(s: Column) -> Column:
        key = s["key"]
        named = F.array_contains("positions", key) | F.array_contains("keywords", key)
        star = F.col("star") & (F.size("positions") > 0) & key.rlike(r"^\*?[0-9]+$")
        double = (key == "**") & (F.size("keywords") > 0)
        return (F.col("every") | named | star | double) & ~(quoted & s["guarded"])

    worst = F.array_max(F.transform(F.filter(slots, counts), lambda s: s["rank"]))
    c = c.filter(accept).withColumn("worst", worst).filter(F.col("worst") >= RAW_FROM).join(tiers, ["qualname", "path"])
    severity = modulate(F.col("base"), F.col("tier"))
    c = c.filter(severity != "NONE")
    text = F.concat(F.col("qualname"), F.lit(": "), state_name(F.col("worst")), F.lit(" (untrusted) data reaches the "), F.col("label"), F.lit(" sink "), F.col("fqn"), F.lit("() at line "), F.col("line").cast("string"))
    return _finding(c, F.col("rule_id"), severity, text, F.col("line"), F.concat_ws(":", "span", "fqn"), _map(tier=state_name(F.col("tier")), sink=F.col("fqn"), arg_taint=state_name(F.col("worst"))))


def callee_rule(calls: DataFrame, seeds: DataFrame, severities: Severities = BASE) -> DataFrame:
    """PY-WL-105: provably untrusted data handed to a callee that declares a trusted body."""
    callee = seeds.filter(f"source = 'anchored' AND body < {RAW_FROM}").select(F.col("qualname").alias("callee"), F.col("body").alias("callee_body")).distinct()
    worst = F.array_max(F.transform(F.filter("slots", lambda s: s["rank"].isin(5, 7)), lambda s: s["rank"]))
    c = calls.withColumn("worst", worst).filter("worst IS NOT NULL").join(callee, "callee")
    text = F.concat(F.col("qualname"), F.lit(": passes untrusted data to "), F.col("callee"))
    return _finding(c, F.lit("PY-WL-105"), F.lit(severities["PY-WL-105"]), text, F.col("line"), F.concat_ws(":", "span", "callee"), _map(callee=F.col("callee"), arg_taint=state_name(F.col("worst")), tier=state_name(F.col("callee_body"))))


def sql_rule(calls: DataFrame, tiers: DataFrame, severities: Severities = BASE) -> DataFrame:
    """PY-WL-118: the statement slot of execute() on what looks like a database."""
    words = F.split(F.lower(F.regexp_replace("receiver", "(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z]+")
    head = F.substring_index("receiver_type", ".", 1)
    typed, not_db_type = head.isin(*DB_MODULES), head.isin(*NON_DB_MODULES)
    db = F.arrays_overlap(words, F.array(*map(F.lit, DB_TOKENS)))
    other = F.arrays_overlap(words, F.array(*map(F.lit, NON_DB_TOKENS)))
    evidence = F.coalesce(typed, F.lit(False)) | (~F.coalesce(not_db_type, F.lit(False)) & (db | ~other))
    worst = F.array_max(F.transform(F.filter("slots", lambda s: (s["key"].isin(*SQL_SLOTS) | (s["key"] == "**") | (F.col("star") & s["key"].rlike(r"^\*"))) & ~s["constant_text"]), lambda s: s["rank"]))
    c = calls.filter(F.col("attr").isin("execute", "executemany", "executescript")).filter(evidence).withColumn("worst", worst).filter(F.col("worst") >= RAW_FROM).join(tiers, ["qualname", "path"])
    severity = modulate(F.lit(severities["PY-WL-118"]), F.col("tier"))
    c = c.filter(severity != "NONE")
    return _finding(c, F.lit("PY-WL-118"), severity, F.concat(F.col("qualname"), F.lit(": untrusted data reaches a SQL statement")), F.col("line"), F.concat_ws(":", "span", "attr"), _map(tier=state_name(F.col("tier")), sink=F.col("attr"), arg_taint=state_name(F.col("worst"))))


def stored_rule(functions: DataFrame, calls: DataFrame, seeds: DataFrame, with_101: bool, severities: Severities = BASE) -> DataFrame:
    """PY-WL-120: what is read from storage is returned by a trusted function, or handed by one to a callee
    whose body is not raw."""
    severity = modulate(F.lit(severities["PY-WL-120"]), F.col("body"))
    f = functions.filter(f"body < {RAW_FROM}").filter(severity != "NONE")
    back = f.filter(f"actual >= {RAW_FROM}")
    if with_101:  # an external return is reported by the rule on declared returns
        back = back.filter(f"NOT (source = 'anchored' AND ret < {RAW_FROM} AND body <= ret AND actual <> 5)")
    back = back.select("*", F.explode("stored_returns").alias("r"))
    returned = _finding(back, F.lit("PY-WL-120"), severity, F.concat(F.col("qualname"), F.lit(": returns data read from storage")), F.col("r.line"), F.concat(F.col("r.span"), F.lit(":return")), _map(tier=state_name(F.col("body")), return_taint=state_name(F.col("actual"))))
    callee = seeds.filter(f"body < {RAW_FROM}").select(F.col("qualname").alias("callee")).distinct()
    worst = F.array_max(F.transform("slots", lambda s: s["rank"]))
    given = calls.filter("stored").withColumn("worst", worst).filter(F.col("worst") >= RAW_FROM).join(callee, "callee", "left_semi").join(f.select("qualname", "path", "body"), ["qualname", "path"])
    text = F.concat(F.col("qualname"), F.lit(": passes data read from storage to "), F.col("callee"))
    handed = _finding(given, F.lit("PY-WL-120"), severity, text, F.col("line"), F.concat_ws(":", "span", "dotted"), _map(callee=F.col("callee"), arg_taint=state_name(F.col("worst"))))
    return returned.unionByName(handed)


#: Rules added by callers: functions of (functions, calls, seeds) that return findings.
EXTRA: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {}


def register_rule(name: str, rule: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """Add a rule; a name can be added once and never replaces a built-in one."""
    if name in EXTRA or name in SINKS:
        raise ValueError(f"rule {name} exists")
    EXTRA[name] = rule


#: Rules that read the functions once, and those that never do.
ONE_READ, NO_READ = frozenset(f"PY-WL-{n}" for n in (101, 103, 104, 109, 110, 114)), frozenset(["PY-WL-105", "PY-WL-118", *SINKS])


def reads(patterns: tuple[str, ...] | None) -> int:
    """How often the selected rules read the functions, 2 for any number above one; the calls are read by as many plans
    at most."""
    wanted = selected(patterns)
    plans = {"sinks" if r in SINKS else r for r in wanted}
    return min(2, max(len(plans), sum(0 if r in NO_READ else 1 if r in ONE_READ else 2 for r in wanted)))


def tiers_of(seeds: DataFrame) -> DataFrame:
    """(qualname, path, tier) of every function: the rank of the innermost declared scope around it, else its own.
    Around most functions there is no other, and their own rank is the tier in either case."""
    nested = F.col("qualname").contains(".<locals>.")
    own = seeds.select("qualname", "path", F.col("body").alias("tier"))
    inner = seeds.filter(nested)
    if not inner.limit(1).count():
        return own
    declared = seeds.filter("source IN ('anchored', 'config')").select("qualname", F.col("body").alias("rank")).distinct()
    near = enclosing_tier(inner.select("qualname", F.col("body").alias("rank")).distinct(), declared)
    return own.filter(~nested).unionByName(inner.select("qualname", "path").join(near.withColumnRenamed("rank", "tier"), "qualname"))


#: The rules that are built in.
RULES = tuple(sorted(BASE))


def selected(patterns: tuple[str, ...] | None) -> tuple[str, ...]:
    """The known rules that some pattern names (``*`` for any run of characters); all without patterns."""
    known = (*RULES, *EXTRA)
    return known if patterns is None else tuple(r for r in known if any(fnmatch.fnmatchcase(r, p) for p in patterns))


def apply_rules(functions: DataFrame, calls: DataFrame, seeds: DataFrame, rules: tuple[str, ...] | None = None, severities: Severities | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Findings of the selected rules (None if there are none), and the rules that could not be planned or, of those
    added by callers, run, with why; only what is selected is planned, and the rules after a failed one still run."""
    wanted = selected(rules)
    own = {**BASE, **(severities or {})}
    sinks = tuple(r for r in wanted if r in SINKS)
    tiers = tiers_of(seeds) if {*sinks, "PY-WL-103", "PY-WL-104", "PY-WL-118"} & set(wanted) else None
    plans: dict[str, Callable[[], DataFrame]] = {r: lambda r=r: boundary_rules(functions, own)[r] for r in BOUNDARY_RULES if r in wanted}
    plans |= {r: lambda r=r: handler_rules(functions.join(tiers, ["qualname", "path"]), own)[r] for r in ("PY-WL-103", "PY-WL-104") if r in wanted}
    if sinks:
        plans[",".join(sinks)] = lambda: sink_rules(calls, tiers, own, sinks)
    one = {"PY-WL-105": lambda: callee_rule(calls, seeds, own), "PY-WL-118": lambda: sql_rule(calls, tiers, own), "PY-WL-120": lambda: stored_rule(functions, calls, seeds, "PY-WL-101" in wanted, own)}
    plans |= {r: plan for r, plan in one.items() if r in wanted}
    # A caller's rule is run by itself, so that one that fails in a task fails alone.
    plans |= {r: lambda rule=rule: _cut(rule(functions, calls, seeds)) for r, rule in EXTRA.items() if r in wanted}
    frames, failed, columns = [], {}, None
    for name, plan in plans.items():
        try:
            frame = plan()
            columns = columns or frame.columns
            frames.append(frame.select(*columns))
        except Exception as e:  # noqa: BLE001  a rule of a caller's may fail in any way
            failed[name] = f"{type(e).__name__}: {e}"[:300]
    return (reduce(DataFrame.unionByName, frames) if frames else None), failed
