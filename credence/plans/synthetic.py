"""Queries that run the whole scan on source text made from table rows; the SQL predicts the findings from
the columns that chose the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators import findings as fo
from credence.plans.scan import scan, spread

HEAD = "from credence.markers import trusted, external_boundary, trust_boundary\nimport os, subprocess, shlex, pickle, pathlib, requests, importlib, logging, ctypes, jinja2, smtplib, io\nimport xml.etree.ElementTree as ET\n@external_boundary\ndef raw(p):\n    return p\n"

#: rule -> (body with {v} for the value, base severity): a trusted function that holds the sink.
SINK_BODIES = {
    106: ("pickle.loads({v})", "WARN"), 107: ("eval({v})", "WARN"), 108: ("os.system({v})", "ERROR"), 112: ("subprocess.run({v}, shell=True)", "ERROR"), 115: ("importlib.import_module({v})", "WARN"),
    116: ("open({v})", "WARN"), 117: ("requests.get({v})", "WARN"), 118: ("cursor.execute({v})", "ERROR"), 121: ("ET.fromstring({v})", "WARN"), 122: ("jinja2.Template({v})", "ERROR"),
    123: ("getattr(p, {v})", "WARN"), 124: ("ctypes.CDLL({v})", "ERROR"), 125: ("logging.info({v})", "INFO"), 126: ("smtplib.SMTP('h').sendmail('a', {v}, 'm')", "WARN"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _files(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    # The table is small, and its texts aren't: they are made on all cores.
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    return part.select(F.concat(F.lit("src/m"), F.col("p_partkey"), F.lit(".py")).alias("path"), F.concat(F.lit(HEAD), text).alias("source"))


def _key(findings: DataFrame) -> DataFrame:
    return findings.select(F.regexp_extract("path", r"m(\d+)\.py", 1).cast("long").alias("p_partkey"), "rule_id", "severity")


def _choice(*options: str):
    """One of the texts, by the part's size."""
    out = F.lit(options[-1])
    for i, o in enumerate(options[:-1]):
        out = F.when(F.col("p_size") % len(options) == i, o).otherwise(out)
    return out


def _sink_query(rule: int) -> Callable[[SparkSession, str], DataFrame]:
    body, _ = SINK_BODIES[rule]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = _choice("raw(p)", "'safe'", "p", "str(raw(p))", "(1 if p else raw(p))")
        level = F.when(F.col("p_partkey") % 3 == 0, "@trusted(level='ASSURED')\n").when(F.col("p_partkey") % 3 == 1, "@trust_boundary(to_level='GUARDED')\n").otherwise("")
        before, after = body.split("{v}")
        text = F.concat(level, F.lit(f"def f(p):\n    if not p:\n        raise ValueError\n    {before}"), value, F.lit(f"{after}\n"))
        return _key(scan(_files(spark, sf_dir, text), rules=(f"PY-WL-{rule}",), diagnose=False)["findings"].filter(F.col("rule_id") == f"PY-WL-{rule}"))

    return run


for _rule, (_, _base) in SINK_BODIES.items():
    QUERIES[f"rule_{_rule}"] = _sink_query(_rule)
    # A boundary's own body is external, so sinks in it are outside the trusted tiers.
    ORACLES[f"rule_{_rule}"] = f"SELECT p_partkey, 'PY-WL-{_rule}' AS rule_id, '{_base}' AS severity FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 IN (0, 3, 4)"


def _shape_query(rule: int, *options: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _key(scan(_files(spark, sf_dir, _choice(*options)), rules=(f"PY-WL-{rule}",), diagnose=False)["findings"].filter(F.col("rule_id") == f"PY-WL-{rule}"))

    return run


#: rule -> (severity, options, which of them fire).
SHAPES: dict[int, tuple[str, tuple[str, ...], tuple[int, ...]]] = {
    101: ("ERROR", ("@trusted(level='ASSURED')\ndef f(p):\n    x = raw(p)\n    return x\n", "@trusted\ndef f(p):\n    return 1\n", "def f(p):\n    return raw(p)\n", "@trusted\ndef f(p):\n    y = 'a'\n    for i in p:\n        y = y + raw(i)\n    return y\n", "@trusted\ndef f(p):\n    return len(raw(p))\n"), (0, 3)),
    102: ("ERROR", ("@trust_boundary(to_level='GUARDED')\ndef f(p):\n    y = p + 1\n    return y\n", "@trust_boundary(to_level='GUARDED')\ndef f(p):\n    return int(p)\n", "@trust_boundary(to_level='GUARDED')\ndef f(p):\n    check(p)\n    return (p, 1)\ndef check(p):\n    raise ValueError\n", "@trusted\ndef f(p):\n    return p + 1\n"), (0,)),
    103: ("WARN", ("@trusted\ndef ship(order):\n    try:\n        return order.total()\n    except Exception as problem:\n        note(problem)\n    return 0\n", "@trusted\ndef ship(order):\n    try:\n        return order.total()\n    except (KeyError, LookupError) as problem:\n        note(problem)\n    return 0\n", "def ship(order):\n    try:\n        return order.total()\n    except:\n        return 0\n", "@trusted\ndef ship(order):\n    for line in order:\n        try:\n            line.pack()\n        except (KeyError, BaseException):\n            note(line)\n    return 0\n"), (0, 3)),
    104: ("WARN", ("@trusted\ndef close(ledger):\n    for page in ledger:\n        try:\n            page.seal()\n        except PermissionError:\n            continue\n", "@trusted\ndef close(ledger):\n    for page in ledger:\n        try:\n            page.seal()\n        except PermissionError:\n            note(page)\n", "def close(ledger):\n    try:\n        ledger.seal()\n    except PermissionError:\n        ...\n"), (0,)),
    105: ("ERROR", ("@trusted\ndef t(a):\n    return 1\ndef f(p):\n    t(raw(p))\n", "@trusted\ndef t(a):\n    return 1\ndef f(p):\n    t(unknown(p))\n", "def t(a):\n    return 1\ndef f(p):\n    t(raw(p))\n"), (0,)),
    109: ("WARN", ("@trusted\ndef f(p) -> int:\n    if p:\n        return 1\n", "@trusted\ndef f(p) -> int:\n    if p:\n        return 1\n    raise ValueError\n", "@trusted\ndef f(p):\n    if p:\n        return 1\n", "@trusted\ndef f(p) -> 'int | None':\n    if p:\n        return 1\n"), (0,)),
    110: ("WARN", ("@trusted\n@external_boundary\ndef f(p):\n    return 1\n", "@trusted\ndef f(p):\n    return 1\n"), (0,)),
    111: ("ERROR", ("@trust_boundary(to_level='ASSURED')\ndef parse_weight(field):\n    grams = field.strip()\n    assert grams.isdigit(), 'weight'\n    return (grams, 'g')\n", "@trust_boundary(to_level='ASSURED')\ndef parse_weight(field):\n    grams = field.strip()\n    assert grams\n    if not grams.isdigit():\n        raise LookupError(grams)\n    return (grams, 'g')\n", "@trusted\ndef parse_weight(field):\n    assert field\n    return 7\n"), (0,)),
    113: ("ERROR", ("@trust_boundary(to_level='ASSURED')\ndef port_of(field):\n    try:\n        number = int(field)\n        if number > 65535:\n            raise OverflowError(field)\n        return (number, 'tcp')\n    except OverflowError:\n        return (field, 'tcp')\n", "@trust_boundary(to_level='ASSURED')\ndef port_of(field):\n    try:\n        if field > 65535:\n            raise OverflowError(field)\n        return (field, 'tcp')\n    except OverflowError:\n        return ()\n", "@trust_boundary(to_level='ASSURED')\ndef port_of(field):\n    number = 0\n    try:\n        if field > 65535:\n            raise OverflowError(field)\n        number = field + 1\n    except OverflowError:\n        number = 'any'\n    return number\n"), (0, 2)),
    114: ("ERROR", ("@trusted(level='GUARDED')\ndef f(p):\n    return 1\n", "@trusted(level='ASSURED')\ndef f(p):\n    return 1\n", "@trust_boundary(to_level='INTEGRAL')\ndef f(p):\n    raise ValueError\n", "@trusted(level=LEVEL)\ndef f(p):\n    return 1\n"), (0, 2)),
    119: ("ERROR", ("@trust_boundary(to_level='ASSURED')\ndef admit(parcel, desk):\n    'Take a parcel in.'\n    pass\n    return parcel\n", "@trust_boundary(to_level='ASSURED')\ndef admit(parcel, desk):\n    return desk.take(parcel)\n", "@trusted\ndef admit(parcel, desk):\n    return parcel\n"), (0,)),
    120: ("ERROR", ("@trusted\ndef f(c):\n    return c.fetchone()\n", "@trusted\ndef f(c):\n    return 1\n", "@trusted\ndef f(p):\n    b = io.StringIO('x')\n    return b.read()\n", "@trusted\ndef print_label(line):\n    return 1\n@trusted\ndef f(c):\n    row = c.fetchone()\n    line = row[0]\n    print_label(line)\n", "def note(line):\n    return 1\n@trusted\ndef f(c):\n    row = c.fetchone()\n    note(row)\n    return raw(c)\n"), (0, 3)),
}

for _rule, (_severity, _options, _fire) in SHAPES.items():
    QUERIES[f"rule_{_rule}"] = _shape_query(_rule, *_options)
    ORACLES[f"rule_{_rule}"] = f"SELECT p_partkey, 'PY-WL-{_rule}' AS rule_id, '{_severity}' AS severity FROM part WHERE p_size % {len(_options)} IN ({', '.join(map(str, _fire))})"


def partition_102_111_113_119(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries with more than one finding of the family; and how many have each."""
    options = [SHAPES[r][1][0] for r in (102, 111, 113, 119)]
    found = _key(scan(_files(spark, sf_dir, _choice(*options)), rules=tuple(f"PY-WL-{r}" for r in (102, 111, 113, 119)), diagnose=False)["findings"])
    per = found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule_id"))
    return per.groupBy("rule_id").agg(F.count(F.lit(1)).alias("boundaries"), F.count_if(F.col("n") > 1).alias("overlapping"))


QUERIES["partition_102_111_113_119"] = partition_102_111_113_119
ORACLES["partition_102_111_113_119"] = "SELECT ['PY-WL-102', 'PY-WL-111', 'PY-WL-113', 'PY-WL-119'][(p_size % 4)::INT + 1] AS rule_id, count(*) AS boundaries, 0::BIGINT AS overlapping FROM part GROUP BY 1"


def engine_parse_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that can't be parsed is a finding of its own, and the others go on."""
    text = _choice("def f(:\n", SHAPES[101][1][0], "x = 1\n")
    return _key(scan(_files(spark, sf_dir, text), diagnose=False)["findings"])


QUERIES["engine_parse_error"] = engine_parse_error
ORACLES["engine_parse_error"] = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'WLN-ENGINE-PARSE-ERROR' ELSE 'PY-WL-101' END AS rule_id, 'ERROR' AS severity FROM part WHERE p_size % 3 IN (0, 1)"


def interprocedural_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callers pass reaches the callee's sinks, through a middle function."""
    caller = _choice("def g(p):\n    mid(raw(p))\n", "def g(p):\n    mid('safe')\n", "def g(p):\n    pass\n")
    text = F.concat(F.lit("@trusted\ndef f(cmd):\n    os.system(cmd)\n@trusted\ndef mid(x):\n    f(x)\n"), caller)
    return _key(scan(_files(spark, sf_dir, text), rules=("PY-WL-108",), diagnose=False)["findings"].filter("rule_id = 'PY-WL-108'"))


QUERIES["interprocedural_params"] = interprocedural_params
ORACLES["interprocedural_params"] = "SELECT p_partkey, 'PY-WL-108' AS rule_id, 'ERROR' AS severity FROM part WHERE p_size % 3 = 0"


def seed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared ranks of functions: one marker, several, none, and a level that isn't allowed."""
    text = _choice("@trusted\ndef f(p):\n    return 1\n", "@trust_boundary(to_level='GUARDED')\ndef f(p):\n    raise ValueError\n", "def f(p):\n    return 1\n", "@trusted(level='ASSURED')\n@external_boundary\ndef f(p):\n    return 1\n", "@trusted(level='GUARDED')\ndef f(p):\n    return 1\n")
    f = scan(_files(spark, sf_dir, text), diagnose=False)["functions"].filter(F.col("qualname").endswith(".f"))
    return f.select(F.regexp_extract("path", r"m(\d+)\.py", 1).cast("long").alias("p_partkey"), "body", "ret", "source")


QUERIES["seed_markers"] = seed_markers
ORACLES["seed_markers"] = "SELECT p_partkey, ([0, 5, 6, 5, 6][(p_size % 5)::INT + 1])::INT AS body, ([0, 2, 6, 5, 6][(p_size % 5)::INT + 1])::INT AS ret, CASE WHEN p_size % 5 IN (2, 4) THEN 'fallback' ELSE 'anchored' END AS source FROM part"


def _query(sql: str):
    def put(run):
        QUERIES[run.__name__], ORACLES[run.__name__] = run, sql
        return run

    return put


@_query("SELECT 'PY-WL-101' AS rule_id, 2 * count_if(p_size % 2 = 0) + count_if(p_size % 2 = 1) AS findings FROM part UNION ALL SELECT 'WLN-ENGINE-DUPLICATE-FQN', 2 * count_if(p_size % 2 = 0) FROM part")
def scan_duplicate_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one module: each finding once for each file, and the names that they share."""
    one = _files(spark, sf_dir, F.lit(SHAPES[101][1][0]))
    even = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 2 = 0")
    two = even.select(F.concat(F.lit("m"), F.col("p_partkey"), F.lit(".py")).alias("path"), F.lit(HEAD + SHAPES[101][1][0]).alias("source"))
    found = scan(one.unionByName(two), rules=("PY-WL-101",))["findings"]
    return found.filter("kind = 'defect'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@_query("SELECT p_partkey, 'PY-WL-108' AS rule_id, 'ERROR' AS severity FROM part WHERE p_size % 3 = 0")
def scan_class_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one method writes to an attribute, another one's sink reads."""
    job = "class Job:\n    def load(self, p):\n        self.order = {}\n    @trusted\n    def run(self):\n        os.system(self.{})\n"
    text = _choice(job.format("raw(p)", "order"), job.format("'ls'", "order"), job.format("raw(p)", "name"))
    return _key(scan(_files(spark, sf_dir, text), rules=("PY-WL-108",), diagnose=False)["findings"])


@_query("SELECT p_partkey, 'PY-WL-101' AS rule_id, 'ERROR' AS severity FROM part WHERE p_size % 3 IN (0, 2)")
def scan_module_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the module that hold raw data, from its own level or from a function."""
    read = "@trusted\ndef f(p):\n    return TOKEN\n"
    text = _choice(f"TOKEN = raw('x')\n{read}", f"TOKEN = 'x'\n{read}", f"TOKEN = 'x'\ndef put(p):\n    global TOKEN\n    TOKEN = raw(p)\n{read}")
    return _key(scan(_files(spark, sf_dir, text), rules=("PY-WL-101",), diagnose=False)["findings"])


@_query("SELECT p_partkey, 'PY-WL-101' AS rule_id, 'ERROR' AS severity FROM part WHERE p_size % 3 IN (1, 2)")
def config_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured sanitisers and sources: the results of functions that the project only imports."""
    body = "import cleaner, feeds\n@trusted(level='ASSURED')\ndef f(p):\n    return {}(p)\n"
    text = _choice(*(body.format(x) for x in ("cleaner.scrub", "feeds.fetch", "cleaner.other")))
    return _key(scan(_files(spark, sf_dir, text), rules=("PY-WL-101",), settings={"sanitisers": ["cleaner.scrub"], "untrusted_sources": ["feeds.fetch"]}, diagnose=False)["findings"])


@_query("""SELECT 'PY-WL-101' AS rule_id, 'CRITICAL' AS severity, count_if(p_size % 3 = 0) AS findings FROM part UNION ALL SELECT 'PY-WL-107', 'WARN', count_if(p_size % 3 = 1) FROM part
UNION ALL SELECT 'WLN-ENGINE-POLICY-CONFIG', 'ERROR', 4""")
def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules enabled by patterns, severities overridden, and what is wrong with the settings."""
    text = _choice(SHAPES[101][1][0], "@trusted\ndef f(p):\n    eval(raw(p))\n", "@trusted\ndef f(p):\n    os.system(raw(p))\n")
    settings = {"rules": {"enable": ["PY-WL-101", "PY-WL-*7", "NO-*"], "severity": {"PY-WL-101": "CRITICAL", "PY-WL-102": "LOUD", "PY-WL-103": "NONE", "XX-1": "WARN"}}}
    found = scan(_files(spark, sf_dir, text), settings=settings)["findings"]
    return found.filter("kind = 'defect'").groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


@_query("SELECT p_partkey, p_size % 3 = 0 AS twice, CASE WHEN p_size % 3 = 0 THEN 'ocean.tides' ELSE 'ocean' END AS package FROM part WHERE p_size % 3 IN (0, 1)")
def unknown_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that are neither the project's, nor the standard library's, nor the markers'."""
    text = _choice("from ocean.tides import high\nimport ocean.tides\n", "import ocean, json.decoder\n", "from m1 import f\nfrom . import m2\n")
    found = scan(_files(spark, sf_dir, text), rules=("PY-WL-101",))["findings"].filter("rule_id = 'WLN-ENGINE-UNKNOWN-IMPORT'").filter(F.col("properties")["package"].startswith("ocean"))
    return found.select(F.regexp_extract("path", r"m(\d+)\.py", 1).try_cast("long").alias("p_partkey"), (F.col("properties")["package"] == "ocean.tides").alias("twice"), F.col("properties")["package"].alias("package"))


@_query("SELECT 'WLN-CONFIG-UNUSED-SOURCE' AS rule_id, 'feeds.never' AS name UNION ALL SELECT 'WLN-CONFIG-UNUSED-SANITISER', 'cleaner.never'")
def config_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured names that no call may mean."""
    text = F.lit("import cleaner, feeds\ndef f(p):\n    return cleaner.scrub(feeds.fetch(p))\n")
    settings = {"sanitisers": ["cleaner.scrub", "cleaner.never"], "untrusted_sources": ["feeds.fetch", "feeds.never"]}
    found = scan(_files(spark, sf_dir, text), rules=("PY-WL-101",), settings=settings)["findings"].filter(F.col("rule_id").startswith("WLN-CONFIG-UNUSED"))
    return found.select("rule_id", F.coalesce(F.col("properties")["source"], F.col("properties")["sanitiser"]).alias("name"))


@_query("""SELECT 'WLN-ENGINE-METRICS' AS rule_id, count(*) AS fallback, count(*) + count_if(p_size % 2 = 0) AS anchored FROM part""")
def engine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the run by the source of their ranks."""
    text = F.concat(F.lit("def g(p):\n    return 1\n"), _choice("@trusted\ndef f(p):\n    return 1\n", ""))
    found = scan(_files(spark, sf_dir, text), rules=("PY-WL-101",))["findings"].filter("rule_id = 'WLN-ENGINE-METRICS'")
    return found.select("rule_id", *[F.col("properties")[c].cast("long").alias(c) for c in ("fallback", "anchored")])


@_query("SELECT 0::BIGINT AS anchored")
def shadowed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project with a module named like the markers' package declares nothing."""
    files = _files(spark, sf_dir, _choice("@trusted\ndef f(p):\n    return 1\n", ""))
    own = spark.createDataFrame([("src/credence/markers.py", "def trusted(f):\n    return f\n")], "path string, source string")
    found = scan(files.unionByName(own), rules=("PY-WL-101",), diagnose=False)["functions"]
    return found.agg(F.count_if(F.col("source") == "anchored").alias("anchored"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan and its gate over one project: findings, then what they decide."""
    out = scan(_files(spark, sf_dir, _choice(SHAPES[101][1][0], "@trusted\ndef f(p):\n    return 1\n")))
    findings = out["findings"]
    gate = fo.gate_decision(findings, 1, "ERROR").select("verdict", "would_trip_at")
    return findings.crossJoin(F.broadcast(gate)).select("rule_id", "severity", "path", "line_start", "qualname", "fingerprint", "verdict")
