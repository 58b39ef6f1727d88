"""Queries that run the relational operators on mapped columns of the star schema, each with the SQL that
states the same fact independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import identity, lattice
from credence.operators import findings as fo
from credence.operators import delta, graphs, ordered
from credence.operators.graphs import _cut
from credence.sources import discovery as source_discovery
from credence.sources import sinks

TODAY = "1996-01-01"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NAMES = "['INTEGRAL','ASSURED','GUARDED','UNKNOWN_ASSURED','UNKNOWN_GUARDED','EXTERNAL_RAW','UNKNOWN_RAW','MIXED_RAW']"

#: Findings made of orders: severity, kind, names and paths by the key.
FINDINGS_SQL = """f AS (SELECT o_orderkey AS k, 'PY-WL-' || cast(101 + o_orderkey % 26 AS VARCHAR) AS rule_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'INFO' ELSE 'NONE' END AS severity,
  CASE WHEN o_orderkey % 11 = 0 THEN 'metric' WHEN o_orderkey % 7 = 0 THEN 'fact' ELSE 'defect' END AS kind,
  'src/m' || cast(o_custkey % 50 AS VARCHAR) || '.py' AS path, cast(o_orderkey % 97 + 1 AS INT) AS line_start,
  'm' || cast(o_custkey % 50 AS VARCHAR) || '.C' || cast(o_orderkey % 9 AS VARCHAR) || '.f' AS qualname,
  cast(o_orderkey AS VARCHAR) AS fingerprint FROM orders)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string"))
    return _t(spark, sf_dir, "orders").select(
        k.alias("ordinal"),
        F.concat(F.lit("PY-WL-"), (101 + k % 26).cast("string")).alias("rule_id"),
        F.lit("m").alias("message"),
        F.element_at(F.array(*map(F.lit, ("CRITICAL", "ERROR", "WARN", "INFO", "NONE"))), (k % 5 + 1).cast("int")).alias("severity"),
        F.when(k % 11 == 0, "metric").when(k % 7 == 0, "fact").otherwise("defect").alias("kind"),
        F.concat(F.lit("src/"), m, F.lit(".py")).alias("path"),
        (k % 97 + 1).cast("int").alias("line_start"),
        F.concat(m, F.lit(".C"), (k % 9).cast("string"), F.lit(".f")).alias("qualname"),
        k.cast("string").alias("fingerprint"),
        F.create_map(F.lit("sink"), F.concat(F.lit("s"), (k % 3).cast("string"))).alias("properties"),
        F.lit("active").alias("suppression_state"),
        F.lit(None).cast("string").alias("suppression_reason"),
    )


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = _t(spark, sf_dir, "orders")
    fp = F.col("o_orderkey").cast("string").alias("fingerprint")
    baseline = o.filter("o_orderkey % 4 = 0").select(fp)
    waivers = o.filter("o_orderkey % 6 = 0").select(fp, F.concat(F.lit("w"), F.col("o_orderkey")).alias("reason"), F.col("o_orderdate").cast("date").alias("expires"))
    judged = o.filter("o_orderkey % 10 = 0").select(fp, F.concat(F.lit("j"), F.col("o_orderkey")).alias("rationale"))
    return baseline, waivers, judged


STATE_SQL = f"""s AS (SELECT f.*, CASE WHEN kind <> 'defect' THEN 'active' WHEN k % 6 = 0 AND o_orderdate::DATE >= DATE '{TODAY}' THEN 'waived'
  WHEN k % 10 = 0 THEN 'judged' WHEN k % 4 = 0 THEN 'baselined' ELSE 'active' END AS state FROM f JOIN orders ON o_orderkey = k)"""


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.suppress(_findings(spark, sf_dir), *_stores(spark, sf_dir), F.lit(TODAY).cast("date"))


@query(f"SELECT l_orderkey, {NAMES}[(max(l_partkey % 8))::INT + 1] AS state FROM lineitem GROUP BY 1")
def lattice_least_trusted(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(lattice.state_name(lattice.least_trusted(F.col("l_partkey") % 8)).alias("state"))


@query(f"""WITH g AS (SELECT l_orderkey, bit_or(1 << (l_partkey % 8)::INT) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN bit_count(m) = 1 THEN {NAMES}[(log2(m))::INT + 1]
  WHEN (m & ~88) = 0 THEN CASE WHEN m & 64 <> 0 THEN 'UNKNOWN_RAW' WHEN m & 16 <> 0 THEN 'UNKNOWN_GUARDED' ELSE 'UNKNOWN_ASSURED' END
  ELSE 'MIXED_RAW' END AS state FROM g""")
def lattice_taint_join(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(lattice.state_name(lattice.provenance_clash(F.col("l_partkey") % 8)).alias("state"))


@query("""SELECT p_partkey, CASE WHEN p_size % 8 <= 1 THEN b WHEN p_size % 8 <= 4 THEN CASE b WHEN 'CRITICAL' THEN 'ERROR' WHEN 'ERROR' THEN 'WARN' ELSE 'INFO' END ELSE 'NONE' END AS severity
FROM (SELECT *, ['INFO','WARN','ERROR','CRITICAL'][(p_partkey % 4)::INT + 1] AS b FROM part)""")
def severity_modulate(spark, sf_dir):
    base = F.element_at(F.array(*map(F.lit, lattice.SEVERITIES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", lattice.modulate(base, F.col("p_size") % 8).alias("severity"))


@query("""SELECT cast(c_custkey AS VARCHAR) AS name, min(p) AS prio FROM (
  SELECT c_custkey, 1 AS p FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3 FROM customer) GROUP BY 1""")
def config_precedence(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), "c_custkey")
    level = lambda p, f: c.filter(f).select("name", F.lit(p).alias("prio"), F.lit(p).alias("rank"))
    rows = level(1, "c_custkey % 3 = 0").unionByName(level(2, "c_custkey % 2 = 0")).unionByName(level(3, "true"))
    return graphs.first_by_priority(rows, ["name"], "rank").withColumnRenamed("rank", "prio")


@query("""WITH c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS call_id, l_partkey, l_suppkey FROM lineitem),
r AS (SELECT call_id, 1 AS prio, 'p' || l_partkey AS fqn FROM c UNION ALL SELECT call_id, 2, 's' || l_suppkey FROM c),
k AS (SELECT 'p' || p_partkey AS fqn FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
SELECT call_id, arg_min(fqn, prio * 1000000000 + cast(substr(fqn, 2) AS BIGINT)) AS callee FROM (
  SELECT call_id, prio, fqn FROM r WHERE fqn IN (SELECT fqn FROM k)) GROUP BY 1""")
def callee_resolution(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), "l_partkey", "l_suppkey")  # noqa: E741
    # Names are padded, so that the smaller name is the smaller key, as in the SQL.
    name = lambda c, k: F.concat(F.lit(c), F.lpad(F.col(k).cast("string"), 12, "0"))
    rows = l.select("call_id", F.lit(1).alias("prio"), name("p", "l_partkey").alias("fqn")).unionByName(l.select("call_id", F.lit(2).alias("prio"), name("s", "l_suppkey").alias("fqn")))
    known = _t(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(name("p", "p_partkey").alias("qualname")).unionByName(_t(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(name("s", "s_suppkey").alias("qualname")))
    return graphs.resolve_calls(rows, known).select("call_id", F.regexp_replace("callee", "^([ps])0*(?=.)", "$1").alias("callee"))


@query("""SELECT l_partkey, l_linenumber, max(l_suppkey % 8)::INT AS rank FROM lineitem GROUP BY 1, 2""")
def param_meets(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_partkey", "l_linenumber").agg(lattice.least_trusted(F.col("l_suppkey") % 8).cast("int").alias("rank"))


#: Chains: customers call their nation, nations their region; ranks by the key; some nations are anchored.
def _geography(spark, sf_dir, rank=lambda k: k % 8):
    r, n, c = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda df, p, k, at: df.select(name(p, k).alias("node"), rank(F.col(k)).cast("int").alias("rank"), at.alias("anchored"), F.lit(None).cast("int").alias("returned"))
    nodes = row(r, "r", "r_regionkey", F.lit(False)).unionByName(row(n, "n", "n_nationkey", F.col("n_nationkey") % 4 == 1)).unionByName(row(c, "c", "c_custkey", F.lit(False)))
    edges = n.select(name("n", "n_nationkey").alias("caller"), name("r", "n_regionkey").alias("callee")).unionByName(c.select(name("c", "c_custkey").alias("caller"), name("n", "c_nationkey").alias("callee")))
    return nodes, edges


GEO_SQL = """r AS (SELECT 'r' || r_regionkey AS node, r_regionkey % 8 AS x FROM region),
n AS (SELECT 'n' || n_nationkey AS node, n_nationkey % 8 AS own, n_nationkey % 4 = 1 AS anchored, 'r' || n_regionkey AS up FROM nation),
c AS (SELECT 'c' || c_custkey AS node, c_custkey % 8 AS own, 'n' || c_nationkey AS up FROM customer)"""


@query(f"""WITH {GEO_SQL}, nx AS (SELECT n.node, CASE WHEN anchored THEN own ELSE greatest(own, r.x) END AS x FROM n JOIN r ON up = r.node),
cx AS (SELECT c.node, greatest(own, nx.x) AS x FROM c JOIN nx ON up = nx.node)
SELECT node, x::INT AS rank FROM r UNION ALL SELECT node, x::INT FROM nx UNION ALL SELECT node, x::INT FROM cx""")
def l3_fixed_point(spark, sf_dir):
    return graphs.propagate(*_geography(spark, sf_dir))


@query(f"""WITH {GEO_SQL}, nx AS (SELECT n.node, CASE WHEN anchored THEN own ELSE greatest(own, r.x) END AS x FROM n JOIN r ON up = r.node),
cx AS (SELECT c.node, greatest(own, nx.x) AS x FROM c JOIN nx ON up = nx.node)
SELECT node, x::INT AS rank FROM r UNION ALL SELECT node, x::INT FROM nx UNION ALL SELECT node, x::INT FROM cx""")
def l3_clash(spark, sf_dir):
    # Every node here has one callee, so the provenance join of its callees is that callee.
    return graphs.propagate_clash(*_geography(spark, sf_dir))


def _part_edges(spark, sf_dir):
    """From each part to another: chains of all lengths, and some rings."""
    p = _t(spark, sf_dir, "part")
    top = p.agg((F.max("p_partkey") + 1).alias("m"))
    return p, p.crossJoin(F.broadcast(top)).select(F.col("p_partkey").alias("caller"), ((F.col("p_partkey") * 7 + 3) % F.col("m")).alias("callee"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS caller, (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) AS callee FROM part),
w AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 AND p_retailprice > (SELECT avg(p_retailprice) FROM part) UNION SELECT e.caller FROM e JOIN w ON e.callee = w.node) SELECT node FROM w""")
def reverse_reachability(spark, sf_dir):
    """What leads to the changed parts: those of the least size that cost more than the average."""
    p, edges = _part_edges(spark, sf_dir)
    mean = p.agg(F.avg("p_retailprice").alias("mean"))
    changed = p.crossJoin(F.broadcast(mean)).filter("p_size = 1 AND p_retailprice > mean")
    return graphs.reachable(changed.select(F.col("p_partkey").alias("node")), edges)


def explain_chain(spark, sf_dir):
    """From every part, with the operator's own bound of hops."""
    p = _t(spark, sf_dir, "part")
    n = p.agg(F.count(F.lit(1)).alias("m"))
    nexts = p.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") * 7) % F.col("m")).alias("next"))
    return graphs.chain(p.select(F.col("p_partkey").alias("node")), nexts)


QUERIES["explain_chain"] = explain_chain
ORACLES["explain_chain"] = """WITH RECURSIVE e AS (SELECT p_partkey AS node, (p_partkey * 7) % (SELECT count(*) FROM part) AS next FROM part),
w AS (SELECT p_partkey AS start, 0 AS depth, p_partkey AS node, [p_partkey] AS path FROM part
  UNION ALL SELECT start, depth + 1, e.next, list_append(path, e.next) FROM w JOIN e ON e.node = w.node WHERE depth < 20 AND NOT list_contains(path, e.next)),
more AS (SELECT DISTINCT start AS s FROM w JOIN e ON e.node = w.node WHERE depth = 20 AND NOT list_contains(path, e.next))
SELECT start, depth::INT AS depth, node, more.s IS NOT NULL AS truncated FROM w LEFT JOIN more ON more.s = w.start"""


@query(f"""WITH {FINDINGS_SQL}, {STATE_SQL} SELECT fingerprint, state AS suppression_state, CASE state WHEN 'waived' THEN 'w' || k WHEN 'judged' THEN 'j' || k END AS suppression_reason FROM s""")
def suppression_resolve(spark, sf_dir):
    return _suppressed(spark, sf_dir).select("fingerprint", "suppression_state", "suppression_reason")


@query(f"""WITH {FINDINGS_SQL}, {STATE_SQL} SELECT count(*) AS total, count_if(kind = 'defect' AND state = 'active') AS active, count_if(kind = 'defect' AND state = 'baselined') AS baselined,
count_if(kind = 'defect' AND state = 'waived') AS waived, count_if(kind = 'defect' AND state = 'judged') AS judged, count_if(kind <> 'defect') AS informational, 0::BIGINT AS unanalyzed FROM s""")
def scan_summary(spark, sf_dir):
    return fo.scan_summary(_suppressed(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL}, {STATE_SQL}, h AS (SELECT state FROM s WHERE kind = 'defect' AND severity IN ('ERROR', 'CRITICAL'))
SELECT count_if(state = 'active') AS active, count_if(state <> 'active') AS suppressed FROM h""")
def gate_populations(spark, sf_dir):
    return fo.gate_breakdown(_suppressed(spark, sf_dir), "ERROR")


@query(f"""WITH {FINDINGS_SQL}, w AS (SELECT min(list_position(['CRITICAL', 'ERROR', 'WARN', 'INFO'], severity)) AS worst FROM f WHERE kind = 'defect')
SELECT ['CRITICAL', 'ERROR', 'WARN', 'INFO'][worst] AS would_trip_at, worst <= 2 AS severity_tripped, false AS unanalyzed_tripped, (SELECT count_if(c_custkey % 3 = 0) = 0 AND count(*) >= 5 FROM customer) AS inert_tripped,
CASE WHEN worst <= 2 THEN 'FAILED' ELSE 'PASSED' END AS verdict, CASE WHEN worst <= 2 THEN 1 ELSE 0 END AS exit_class FROM w""")
def gate_decision(spark, sf_dir):
    posture = fo.resolution_posture(_t(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "anchored").otherwise("fallback").alias("source")))
    return fo.gate_decision(_findings(spark, sf_dir), 50, "ERROR", fail_on_unanalyzed=True, fail_on_inert=True, posture=posture)


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint, CASE WHEN kind = 'defect' AND path NOT IN ('src/m1.py', 'src/m2.py') AND qualname NOT LIKE '%.C3.f' THEN 'baselined' ELSE 'active' END AS suppression_state FROM f""")
def delta_relabel(spark, sf_dir):
    f = _findings(spark, sf_dir)
    changed = spark.createDataFrame([("src/m1.py",), ("src/m2.py",)], "path string")
    affected = f.filter(F.col("qualname").endswith(".C3.f")).select("qualname").distinct()
    return fo.delta_relabel(f, changed, affected, "main").select("fingerprint", "suppression_state")


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint FROM f WHERE qualname IN ('m3.C1.f') OR starts_with(qualname, 'm7.') OR starts_with(qualname, 'm9.C2.')""")
def affected_display(spark, sf_dir):
    f = _findings(spark, sf_dir)
    affected = spark.createDataFrame([("m3.C1.f",), ("m7",), ("m9.C2",)], "qualname string")
    return fo.display_filter(f, affected, spark.createDataFrame([], "path string")).select("fingerprint")


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint, rule_id FROM f WHERE severity = 'ERROR' AND kind = 'defect' AND path LIKE 'src/m1%.py' AND k % 3 = 1""")
def where_lens(spark, sf_dir):
    return fo.where(_findings(spark, sf_dir), {"severity": "error", "kind": "DEFECT", "path_glob": "src/m1*.py", "sink": "s1"}).select("fingerprint", "rule_id")


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint, severity, path FROM f ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 3 ELSE 99 END, path, line_start, rule_id, fingerprint LIMIT 40 OFFSET 25""")
def agent_order_page(spark, sf_dir):
    return fo.page(_findings(spark, sf_dir), 25, 40).select("fingerprint", "severity", "path")


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint FROM f WHERE kind = 'defect' ORDER BY k LIMIT 30""")
def triage_selection(spark, sf_dir):
    return fo.triage(_findings(spark, sf_dir), 30, [F.col("ordinal")]).select("fingerprint")


@query("""SELECT p_partkey, sha256('PY-WL-101' || chr(0) || p_name || chr(0) || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || chr(0) || p_type) AS fingerprint FROM part""")
def fingerprints(spark, sf_dir):
    q = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return _t(spark, sf_dir, "part").select("p_partkey", identity.fingerprint(F.lit("PY-WL-101"), F.col("p_name"), q, F.col("p_type")).alias("fingerprint"))


@query("""SELECT p_partkey, sha256('PY-WL-101' || chr(0) || p_name || chr(0) || p_size || chr(0) || p_brand || chr(0) || '') AS fingerprint FROM part""")
def fingerprint_v0(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", identity.fingerprint_v0(F.lit("PY-WL-101"), F.col("p_name"), F.col("p_size"), F.col("p_brand"), F.lit(None)).alias("fingerprint"))


PAIRS_SQL = "p AS (SELECT DISTINCT 'o' || (p_partkey % 900) AS old_fp, 'n' || (CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 450 ELSE p_partkey % 900 END) AS new_fp FROM part)"


def _pairs(spark, sf_dir):
    k = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("o"), k % 900).alias("old_fp"), F.concat(F.lit("n"), F.when(k % 5 == 0, k % 450).otherwise(k % 900)).alias("new_fp"))


@query(f"""WITH {PAIRS_SQL} SELECT old_fp, new_fp FROM p WHERE old_fp NOT IN (SELECT old_fp FROM p GROUP BY 1 HAVING count(*) > 1) AND new_fp NOT IN (SELECT new_fp FROM p GROUP BY 1 HAVING count(*) > 1)""")
def rekey_remap(spark, sf_dir):
    return fo.remap(_pairs(spark, sf_dir))


@query(f"""WITH {PAIRS_SQL}, m AS (SELECT old_fp, new_fp FROM p WHERE old_fp NOT IN (SELECT old_fp FROM p GROUP BY 1 HAVING count(*) > 1) AND new_fp NOT IN (SELECT new_fp FROM p GROUP BY 1 HAVING count(*) > 1))
SELECT c_custkey, coalesce(new_fp, 'o' || c_custkey) AS fingerprint, new_fp IS NULL AS orphan FROM customer LEFT JOIN m ON old_fp = 'o' || c_custkey""")
def store_carry(spark, sf_dir):
    store = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("o"), F.col("c_custkey")).alias("fingerprint"))
    return fo.carry(store, fo.remap(_pairs(spark, sf_dir)))


@query("""SELECT fingerprint, count(DISTINCT l_suppkey) AS members FROM (SELECT cast(l_orderkey AS VARCHAR) AS fingerprint, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def fingerprint_collision(spark, sf_dir):
    return fo.fingerprint_collisions(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("fingerprint"), "l_suppkey"))


@query("""SELECT cast(l_partkey AS VARCHAR) AS qualname, count(*) AS definitions FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_fqn(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("qualname"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line_start"))  # noqa: E741
    return fo.duplicate_names(l).select("qualname", F.col("definitions"))


@query("""SELECT count(*) AS functions_analyzed, count_if(c_custkey % 3 = 0) AS recognized_boundaries, 4::BIGINT AS low_resolution_functions, false AS inert FROM customer""")
def posture(spark, sf_dir):
    return fo.resolution_posture(_t(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "anchored").otherwise("fallback").alias("source")), 4)


TRUST_SQL = f"""{FINDINGS_SQL}, {STATE_SQL}, e AS (SELECT DISTINCT qualname, k9, m FROM (SELECT qualname, k % 9 AS k9, o_custkey % 50 AS m FROM f JOIN orders ON o_orderkey = k)),
a AS (SELECT qualname, max(kind = 'defect' AND state = 'active') AS act FROM s GROUP BY 1),
t AS (SELECT e.*, CASE WHEN coalesce(act, false) THEN 'defect' WHEN m % 6 = 0 OR k9 % 8 IN (3, 4, 6) THEN 'unknown' ELSE 'clean' END AS verdict FROM e LEFT JOIN a USING (qualname))"""


def _trust(spark, sf_dir):
    f = _suppressed(spark, sf_dir)
    o = _t(spark, sf_dir, "orders")
    m, c = F.col("o_custkey") % 50, F.col("o_orderkey") % 9
    entities = o.select(F.concat(F.lit("m"), m.cast("string"), F.lit(".C"), c.cast("string"), F.lit(".f")).alias("qualname"), (c % 8).cast("int").alias("declared_rank"), F.when(m % 6 != 0, F.lit(1)).alias("actual_rank")).distinct()
    return fo.entity_trust(entities, f), f


@query(f"WITH {TRUST_SQL} SELECT qualname, verdict FROM t")
def entity_trust(spark, sf_dir):
    return _trust(spark, sf_dir)[0].select("qualname", "verdict")


@query(f"""WITH {TRUST_SQL} SELECT count(*) AS boundaries_total, count_if(verdict = 'clean') AS proven, count_if(verdict = 'defect') AS defect_total, count_if(verdict = 'unknown') AS unknown_total,
round(100.0 * (count(*) - count_if(verdict = 'unknown')) / (count(*) + 7), 1)::DOUBLE AS coverage_pct FROM t""")
def assurance(spark, sf_dir):
    return fo.assurance(_trust(spark, sf_dir)[0], 7)


@query(f"""WITH {TRUST_SQL}, d AS (SELECT qualname, count_if(state = 'active') AS na, count_if(state <> 'active') AS ns FROM s WHERE kind = 'defect' GROUP BY 1)
SELECT qualname, CASE WHEN coalesce(na, 0) > 0 THEN 'defect' WHEN coalesce(ns, 0) > 0 THEN 'suppressed' WHEN verdict = 'unknown' THEN 'unknown' ELSE 'clean' END AS finding_state, coalesce(na, 0) AS active_findings, coalesce(ns, 0) AS suppressed_findings FROM t LEFT JOIN d USING (qualname)""")
def decorator_coverage(spark, sf_dir):
    return fo.decorator_coverage(*_trust(spark, sf_dir)).select("qualname", "finding_state", "active_findings", "suppressed_findings")


@query(f"""SELECT cast(o_orderkey AS VARCHAR) AS fingerprint, date_diff('day', DATE '{TODAY}', o_orderdate::DATE)::INT AS days_left FROM orders WHERE o_orderkey % 6 = 0""")
def waiver_debt(spark, sf_dir):
    return fo.waiver_debt(_stores(spark, sf_dir)[1], F.lit(TODAY).cast("date")).select("fingerprint", "days_left")


@query("""SELECT l_orderkey AS caller, count(*) AS calls, count_if(l_partkey % 10 >= 3) AS unresolved, (count_if(l_partkey % 10 >= 3) * 100 // count(*))::INT AS percent FROM lineitem GROUP BY 1 HAVING count_if(l_partkey % 10 >= 3) / count(*) > 0.7""")
def low_resolution(spark, sf_dir):
    return fo.low_resolution(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), (F.col("l_partkey") % 10 < 3).alias("resolved")))


@query("""SELECT calls, count(*) AS functions FROM (SELECT count(*) AS calls FROM lineitem GROUP BY l_orderkey) GROUP BY 1""")
def resolver_histogram(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls")).groupBy("calls").agg(F.count(F.lit(1)).alias("functions"))


@query(f"""WITH {FINDINGS_SQL}, kept AS (SELECT * FROM f WHERE kind <> 'metric'), r AS (SELECT rule_id, row_number() OVER (ORDER BY min(k)) - 1 AS rule_index FROM kept GROUP BY 1)
SELECT fingerprint, rule_id, rule_index::INT AS rule_index, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' WHEN 'INFO' THEN 'note' ELSE 'none' END AS level FROM kept JOIN r USING (rule_id)""")
def sarif_results(spark, sf_dir):
    return fo.sarif_results(_findings(spark, sf_dir)).select("fingerprint", "rule_id", "rule_index", "level")


@query(f"""WITH {FINDINGS_SQL} SELECT '{{"kind":"' || kind || '","line_start":' || line_start || ',"path":"' || path || '","rule_id":"' || rule_id || '","suppression_reason":null}}' AS value FROM f""")
def jsonl_rows(spark, sf_dir):
    return fo.jsonl(_findings(spark, sf_dir).select("rule_id", "kind", "path", "line_start", "suppression_reason"))


@query(f"""WITH {FINDINGS_SQL} SELECT fingerprint, CASE WHEN k % 13 = 0 AND kind = 'defect' THEN 'WLN-ENGINE-LINELESS-DEFECT' ELSE rule_id END AS rule_id, CASE WHEN k % 13 = 0 AND kind = 'defect' THEN '<engine>' ELSE path END AS path FROM f""")
def lineless_defects(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("line_start", F.when(F.col("ordinal") % 13 != 0, F.col("line_start")))
    out = fo.replace_lineless(f)
    return out.select(F.coalesce(F.when(F.col("rule_id") == fo.LINELESS, F.col("properties")["original_fingerprint"]), F.col("fingerprint")).alias("fingerprint"), "rule_id", "path")


@query(f"""WITH {FINDINGS_SQL}, {STATE_SQL} SELECT fingerprint, rule_id, path FROM s WHERE kind = 'defect' AND state <> 'waived'""")
def baseline_generate(spark, sf_dir):
    return fo.baseline_rows(_suppressed(spark, sf_dir)).select("fingerprint", "rule_id", "path")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'b' || p_size WHEN p_partkey % 4 = 1 THEN 'pkg.' || p_brand WHEN p_partkey % 4 = 2 THEN 'src.pkg.m' END AS module FROM part""")
def module_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("src/b"), F.col("p_size"), F.lit("/__init__.py"))).when(k == 1, F.concat(F.lit("pkg/"), F.col("p_brand"), F.lit(".py"))).when(k == 2, F.lit("src/src/pkg/m.py")).otherwise(F.lit("src/__init__.py"))
    return _t(spark, sf_dir, "part").select("p_partkey", identity.module_name(path).alias("module"))


@query("""SELECT 'q' || n_nationkey || '.<locals>.' || 'g' AS qualname, (CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE 6 END)::INT AS rank FROM nation""")
def enclosing_tier(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    outer = F.concat(F.lit("q"), F.col("n_nationkey"))
    entities = n.select(F.concat(outer, F.lit(".<locals>.g")).alias("qualname"), F.lit(6).alias("rank"))
    declared = n.filter("n_nationkey % 3 = 0").select(outer.alias("qualname"), F.col("n_regionkey").cast("int").alias("rank"))
    return graphs.enclosing_tier(entities, declared)


@query("""WITH RECURSIVE m AS (SELECT max(p_partkey) + 1 AS m FROM part),
e AS (SELECT p_partkey AS caller, (p_partkey * 7 + 3) % m AS callee FROM part, m UNION SELECT p_partkey, (p_partkey // 3) FROM part),
n AS (SELECT p_partkey AS node, p_size % 8 AS rank, p_size % 5 = 0 AS anchored FROM part),
w AS (SELECT node, rank FROM n UNION SELECT e.caller, w.rank FROM w JOIN e ON e.callee = w.node JOIN n ON n.node = e.caller WHERE NOT n.anchored)
SELECT node, max(rank)::INT AS rank FROM w GROUP BY node""")
def l3_cycles(spark, sf_dir):
    """Ranks over calls with rings, fan-in and anchored functions in the rings."""
    p = _t(spark, sf_dir, "part")
    top = p.agg((F.max("p_partkey") + 1).alias("m"))
    nodes = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 8).cast("int").alias("rank"), (F.col("p_size") % 5 == 0).alias("anchored"), F.lit(None).cast("int").alias("returned"))
    one = p.crossJoin(F.broadcast(top)).select(F.col("p_partkey").alias("caller"), ((F.col("p_partkey") * 7 + 3) % F.col("m")).alias("callee"))
    return graphs.propagate(nodes, one.unionByName(p.select(F.col("p_partkey").alias("caller"), F.floor(F.col("p_partkey") / 3).cast("long").alias("callee"))))


#: Paths of all kinds, by the part's size.
_PATH_SQL = """CASE p_size % 8 WHEN 0 THEN 'src/m' WHEN 1 THEN 'build/m' WHEN 2 THEN 'src/build/m' WHEN 3 THEN 'src/node_modules/x/m' WHEN 4 THEN 'lib/m' WHEN 5 THEN 'src/gen/m' WHEN 6 THEN 'x.egg-info/m' ELSE 'src/keep/gen/m' END || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.txt' END"""


def _paths(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.expr("""concat(CASE p_size % 8 WHEN 0 THEN 'src/m' WHEN 1 THEN 'build/m' WHEN 2 THEN 'src/build/m' WHEN 3 THEN 'src/node_modules/x/m' WHEN 4 THEN 'lib/m' WHEN 5 THEN 'src/gen/m' WHEN 6 THEN 'x.egg-info/m' ELSE 'src/keep/gen/m' END, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.txt' END)""").alias("path"))


@query(f"SELECT {_PATH_SQL} AS path FROM part WHERE p_partkey % 2 = 0 AND p_size % 8 IN (0, 2, 7)")
def discovery(spark, sf_dir):
    """Files of a project that are scanned; every path is given twice."""
    files = _paths(spark, sf_dir)
    return source_discovery.discovered(files.unionByName(files), roots=("src", "build"), excluded=("src/gen/*",))


@query("SELECT 'nowhere' AS root")
def missing_source_roots(spark, sf_dir):
    return source_discovery.missing_roots(_paths(spark, sf_dir), ("src", "lib", "nowhere", "."))


@query(f"SELECT {_PATH_SQL} AS path FROM part WHERE NOT (p_size % 8 IN (1, 2) OR (p_size % 8 = 5) OR (p_size % 8 = 7 AND p_partkey % 2 = 1))")
def ignore_layers(spark, sf_dir):
    """Ignore files of three directories: the last pattern that matches decides, and deeper files come later."""
    ignores = spark.createDataFrame([(".gitignore", "# output\nbuild/\n"), ("src/.gitignore", "gen/\n"), ("src/keep/.gitignore", "!gen/\n*.txt\n")], "path string, text string")
    return source_discovery.without_ignored(_paths(spark, sf_dir), ignores)


def _scope(spark, sf_dir):
    """Entities m<k>.C.f of all parts; a scope of class locators, stale and good SEIs, and unknown names."""
    p = _t(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    entities = p.select(F.concat(F.lit("m"), key, F.lit(".C.f")).alias("qualname"), F.concat(F.lit("m"), key, F.lit(".py")).alias("path"))
    size = F.col("p_size") % 4
    locator = F.when(size == 0, F.concat(F.lit("m"), key, F.lit(".C"))).when(size == 1, F.concat(F.lit("py:function:m"), key, F.lit(".C.f"))).when(size == 2, F.concat(F.lit("gone"), key))
    scope = p.select(locator.alias("locator"), F.when(size != 1, F.concat(F.lit("s"), key)).alias("sei"))
    seis = p.select(F.concat(F.lit("s"), key).alias("sei"), F.when(size == 3, F.concat(F.lit("m"), key, F.lit(".C.f"))).otherwise(F.concat(F.lit("old"), key)).alias("qualname"))
    return scope, entities, seis


@query("""SELECT CASE p_size % 4 WHEN 0 THEN 'm' || p_partkey || '.C' WHEN 1 THEN 'py:function:m' || p_partkey || '.C.f' WHEN 2 THEN 'gone' || p_partkey END AS locator, CASE WHEN p_size % 4 <> 1 THEN 's' || p_partkey END AS sei,
CASE p_size % 4 WHEN 0 THEN 'm' || p_partkey || '.C' WHEN 1 THEN 'm' || p_partkey || '.C.f' WHEN 3 THEN 'm' || p_partkey || '.C.f' END AS qualname, CASE WHEN p_size % 4 <> 2 THEN 'm' || p_partkey || '.py' END AS path,
CASE p_size % 4 WHEN 0 THEN 'locator' WHEN 1 THEN 'locator' WHEN 3 THEN 'sei' END AS how FROM part""")
def scope_match(spark, sf_dir):
    return delta.match_scope(*_scope(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL} SELECT 'delta' AS mode, 'advisory' AS gate_authority, (SELECT count(*) FROM part) AS entities_requested, (SELECT count(*) FROM part) AS files_discovered, (SELECT count_if(p_size % 4 <> 2) FROM part) AS files_analyzed,
count_if(kind = 'defect') AS in_scope_findings, (SELECT count_if(p_size % 4 IN (0, 1)) FROM part) AS fell_back_count, (SELECT count_if(p_size % 4 = 2) FROM part) AS unresolved_count FROM f""")
def delta_report(spark, sf_dir):
    scope, entities, seis = _scope(spark, sf_dir)
    matched = delta.match_scope(scope, entities, seis)
    return delta.delta_report(matched, entities.select("path"), matched.filter("path IS NOT NULL").select("path").distinct(), _findings(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'k' || (p_partkey // 4) AS caller, 'k' || (((p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part)) // 4) AS callee FROM part WHERE (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) > 0),
w AS (SELECT 'k0' AS node UNION SELECT e.caller FROM e JOIN w ON e.callee = w.node WHERE e.caller <> e.callee) SELECT node FROM w""")
def module_reachability(spark, sf_dir):
    """Modules that lead to the first one, by calls between different modules."""
    p, edges = _part_edges(spark, sf_dir)
    entities = p.select(F.col("p_partkey").alias("qualname"), F.concat(F.lit("k"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("module"))
    return graphs.reachable(spark.createDataFrame([("k0",)], "node string"), delta.module_edges(edges, entities))


@query(f"""WITH {FINDINGS_SQL}, kept AS (SELECT * FROM f WHERE kind <> 'metric'), r AS (SELECT rule_id, row_number() OVER (ORDER BY min(k)) - 1 AS rule_index FROM kept GROUP BY 1)
SELECT row_number() OVER (ORDER BY k) AS line, '{{"ruleId":"' || rule_id || '","ruleIndex":' || rule_index || ',"level":"' || CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' WHEN 'INFO' THEN 'note' ELSE 'none' END
|| '","partialFingerprints":{{"v2":"' || fingerprint || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line_start || '}}}}}}]}}' AS result FROM kept JOIN r USING (rule_id)""")
def sarif_document_lines(spark, sf_dir):
    """The results of a SARIF document in its order, as the executors write them."""
    lines = ordered.numbered(_cut(sinks.sarif_lines(_findings(spark, sf_dir))), [F.col("ordinal")], "line")
    return lines.filter(F.col("value").startswith('{"ruleId"') | F.col("value").startswith(",")).select("line", F.regexp_replace("value", "^,", "").alias("result"))


@query(f"WITH {FINDINGS_SQL} SELECT fingerprint, false AS valid, true AS valid_before FROM f WHERE k % 50 = 7")
def signed_findings(spark, sf_dir):
    """All findings in one signed table; of a copy in which some were changed, the rows that don't match."""
    rows = _findings(spark, sf_dir).select("ordinal", "rule_id", "path", "line_start", "qualname", "severity", "fingerprint")
    kept, signature = sinks.signed_rows(rows, ["ordinal"], b"a key of the query's own")
    before, _ = sinks.verify_rows(kept, signature, b"a key of the query's own")
    forged = kept.withColumn("severity", F.when(F.col("ordinal") % 50 == 7, "NOTHING").otherwise(F.col("severity")))
    valid, changed = sinks.verify_rows(forged, signature, b"a key of the query's own")
    return changed.select("fingerprint", F.lit(valid).alias("valid"), F.lit(before).alias("valid_before"))


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT fingerprint, sum(length(qualname) + length(path) + 4 * length(rule_id)) OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 3 ELSE 99 END, path, line_start, rule_id, fingerprint)::BIGINT AS spent,
  (SELECT sum(length(qualname) + length(path) + 4 * length(rule_id)) FROM f) // 3 AS budget FROM f) SELECT fingerprint, spent FROM s WHERE spent <= budget""")
def token_budget_trim(spark, sf_dir):
    """The findings that fit into a third of what all of them cost, in display order."""
    f = _findings(spark, sf_dir)
    cost = (F.length("qualname") + F.length("path") + 4 * F.length("rule_id")).cast("long")
    budget = f.agg(F.sum(cost)).first()[0] // 3
    return ordered.within_budget(f, fo.display_order(), cost, budget).select("fingerprint", "spent")
