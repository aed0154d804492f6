"""Relabelling pipelines over targets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import HOUR, HOURLY, T, UP, latest, out, query, windowed
from tideline.model import label_map, rekey
from tideline.operators import relabel as L
from tideline.operators import rangefn as R
from tideline.operators.matching import v_or_all
from tideline.operators.relabel import Rule
from tideline.sources.targets import expand_groups

HOST = "concat('supplier', {k}, '.nation', {n}, '.example.org')"
# Working labels of a target, valid in both engines.
FIELDS = {
    "address": f"concat({HOST}, CASE WHEN k % 3 = 0 THEN '' ELSE ':9100' END)",
    "port": "CASE WHEN k % 4 = 0 THEN '' ELSE concat('', 9000 + k % 7) END",
    "module": "concat('mod_v', 4 + 2 * (k % 2))",
    "kind": "CASE WHEN k % 2 = 0 THEN 'DaemonSet' ELSE 'ReplicaSet' END",
    "pod": "concat('app', k % 5, CASE WHEN k % 2 = 0 THEN '-ab12x' ELSE '-7f9c-ab12x' END)",
    "scrape": "CASE WHEN k % 5 = 0 THEN 'false' ELSE 'true' END",
    "app": "concat('app', k % 5)",
    "ready": "CASE WHEN k % 6 = 0 THEN '' ELSE 'true' END",
}
BASE = "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier"
SUPP = (
    "d AS (SELECT k, "
    + ", ".join(f"{sql.format(k='k', n='n')} AS {c}" for c, sql in FIELDS.items())
    + f" FROM ({BASE}))"
)
NAMES = {
    "address": "__address__",
    "port": "__meta_port",
    "module": "module",
    "kind": "__meta_kind",
    "pod": "__meta_pod",
    "scrape": "__meta_scrape",
    "app": "__meta_label_app",
    "ready": "__meta_ready",
}


def targets(t):
    base = t.supplier.selectExpr("s_suppkey AS k", "s_nationkey AS n")
    cols = base.selectExpr("k", *[f"{sql.format(k='k', n='n')} AS {c}" for c, sql in FIELDS.items()])
    return cols.select("k", label_map({NAMES[c]: F.col(c) for c in FIELDS}).alias("labels"))


def show(df, *names):
    """Row key and the given labels ('' when missing)."""
    return df.select("k", *[F.coalesce(F.col("labels")[n], F.lit("")).alias(n.strip("_")) for n in names])


def _rules(name, sql, rules, *shown):
    query(name, f"WITH {SUPP} {sql}")(lambda t: show(L.relabel(targets(t), rules), *shown))


#: Suppliers whose number ends in 1 to 6 are placed at their nation, the others nowhere.
ENDS_LOW = "supplier[0-9]*[1-6][.](nation[0-9]+)[.]"

_rules(
    "l1_replace_capture",
    f"SELECT k, CASE WHEN regexp_full_match(address, '{ENDS_LOW}.*') THEN regexp_extract(address, '^{ENDS_LOW}.*$', 1) ELSE '' END AS site FROM d",
    [Rule("replace", ("__address__",), f"{ENDS_LOW}.*", "${1}", "site")],
    "site",
)
_rules(
    "l3_replace_constant",
    "SELECT k, 'inner' AS cluster FROM d",
    [Rule("replace", (), ".*", "inner", "cluster")],
    "cluster",
)
_rules(
    "l4_copy_label",
    "SELECT k, pod FROM d",
    [Rule("replace", ("__meta_pod",), target="pod")],
    "pod",
)
_rules(
    "l5_empty_deletes_label",
    "SELECT k, '' AS module, regexp_replace(address, '^[^:]+', '') AS port FROM d",
    [
        Rule("replace", ("__nothing__",), "(.*)", "$1", "module"),
        Rule("replace", ("__address__",), "[^:]+(:[0-9]+)?", "$1", "port"),
    ],
    "module",
    "port",
)
_rules(
    "l6_keep",
    "SELECT k, address FROM d WHERE scrape = 'true' AND port <> ''",
    [Rule("keep", ("__meta_scrape",), "true"), Rule("keep", ("__meta_port",), r"(\d+)")],
    "__address__",
)
_rules(
    "l7_drop",
    "SELECT k, address FROM d WHERE NOT (kind = 'DaemonSet' AND module = 'mod_v4')",
    [Rule("drop", ("__meta_kind", "module"), "DaemonSet;mod_v4")],
    "__address__",
)
_rules(
    "l8_labelmap",
    "SELECT k, app FROM d",
    [Rule("labelmap", (), "__meta_label_(.+)")],
    "app",
)
_rules(
    "l12_probe_targets",
    "SELECT k, 'exporter:9115' AS address, regexp_replace(address, ':.*', '') AS param_target, module AS param_module, address AS instance FROM d",
    L.probe_target_rules("exporter:9115", "([^:]+).*"),
    "__address__",
    "__param_target",
    "__param_module",
    "instance",
)
def _order_labels(t):
    """Orders as labelled rows: status, priority and the customer's last two digits."""
    labels = {
        "state": F.col("o_orderstatus"),
        "urgency": F.col("o_orderpriority"),
        "tag_queue": F.concat(F.lit("q"), F.col("o_custkey") % 7),
        "tag_lane": F.concat(F.lit("lane "), F.col("o_custkey") % 100),
    }
    return t.orders.select(F.col("o_orderkey").alias("k"), label_map(labels).alias("labels"))


ORDERS = (
    "d AS (SELECT o_orderkey AS k, o_orderstatus AS state, o_orderpriority AS urgency,"
    " 'q' || (o_custkey % 7) AS queue, o_custkey % 100 AS lane FROM orders)"
)


@query(
    "l2_replace_joined_sources",
    f"WITH {ORDERS} SELECT k, CASE WHEN state IN ('F', 'P') AND lane >= 10 THEN state || (lane % 10) ELSE '' END AS slot FROM d",
)
def _(t):
    rule = Rule("replace", ("state", "tag_lane"), "([FP]);lane [0-9](?<low>[0-9])", "$1${low}", "slot")
    return show(L.relabel(_order_labels(t), [rule]), "slot")


@query(
    "l13_host_labels",
    "SELECT p_partkey AS k, regexp_extract(p_brand, '#(.)', 1) AS machine, regexp_extract(p_type, '^(.*)[A-Z]$', 1) AS site FROM part",
)
def _(t):
    named = F.concat(F.col("p_brand"), F.lit(" makes "), F.col("p_type"))
    rows = t.part.select(F.col("p_partkey").alias("k"), label_map({"name": named}).alias("labels"))
    return show(L.relabel(rows, L.host_rules("name", "Brand#([0-9]).*", ".* makes (.+).")), "machine", "site")


@query(
    "l6_rule_chain",
    f"WITH {ORDERS} SELECT k, queue, 'orders' AS origin,"
    " CASE WHEN state = 'O' THEN substr(urgency, 3) WHEN substr(urgency, 1, 1) IN ('1', '2') THEN 'late ' || substr(urgency, 1, 1) ELSE '' END AS note"
    " FROM d WHERE state <> 'P' AND lane < 50 AND substr(urgency, 1, 1) <> '5'",
)
def _(t):
    """Constant, copies by name, two alternatives for one label, and filters in between."""
    rules = [
        Rule("replace", (), ".*", "orders", "origin"),
        Rule("drop", ("state",), "P"),
        Rule("labelmap", (), "tag_(.*)"),
        Rule("replace", ("urgency", "state"), "([12])-.*;F", "late $1", "note"),
        Rule("keep", ("lane",), "lane ([0-9]|[1-4][0-9])"),
        Rule("replace", ("urgency", "state"), "[0-9]-(.*);O", "$1", "note"),
        Rule("drop", ("urgency",), "5.*"),
    ]
    return show(L.relabel(_order_labels(t), rules), "queue", "origin", "note")


@query(
    "l14_missing_group",
    f"WITH {ORDERS} SELECT k, 'a' || substr(urgency, 1, 1) || 'b' AS code, '$' || state AS price FROM d",
)
def _(t):
    """References to groups that a regex lacks are empty text."""
    rows = L.relabel(
        _order_labels(t),
        [
            Rule("replace", ("urgency",), "([0-9]).*", "a${1}b$2z", "code"),
            Rule("replace", ("state",), "(.)", "$$$1", "price"),
        ],
    )
    return show(rows, "code", "price")


@query("l11_strip_internal", f"WITH {SUPP} SELECT k, '{{\"module\":\"' || module || '\"}}' AS labels FROM d")
def _(t):
    from tideline.model import label_key

    return L.strip_internal(targets(t)).select("k", label_key(F.col("labels")).alias("labels"))


EV = (
    "SELECT event_id AS k, event_type, CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS t,"
    " round(value, 6) AS value FROM events"
)


@query(
    "l9_metric_relabel",
    f"SELECT 'ev_' || event_type AS metric, usr, CASE WHEN regexp_full_match(usr, '1(.)') THEN substr(usr, 2) ELSE '' END AS digit, t, value"
    f" FROM ({EV}) WHERE event_type <> 'view'",
)
def _(t):
    rules = [
        Rule("drop", ("type",), "view"),
        Rule("replace", ("usr",), "1(.)", "$1", "digit"),
        Rule("replace", ("type",), "(.*)", "ev_$1", "__name__"),
    ]
    v = L.metric_relabel(t.gauge, rules)
    return out(v.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("metric"), F.col("metric")))), "metric", "usr", "digit")


@query(
    "l7_drop_by_name",
    "SELECT 'event_value' AS metric, event_type AS type, CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(value, 6) AS value FROM events",
)
def _(t):
    both = t.gauge.unionByName(t.up)
    kept = L.metric_relabel(both, [Rule("drop", ("__name__",), "up")])
    return out(kept.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("metric"), F.col("metric")))), "metric", "type", "usr")


def _targets_by_site(t):
    """Target labels of each site; the site identifies the target and ``type`` clashes."""
    sites = t.supplier.select((F.col("s_suppkey") % 10).alias("site")).distinct()
    return sites.select(label_map({"site": F.col("site"), "type": F.concat(F.lit("t"), "site")}).alias("labels"))


def _site_samples(t):
    from tideline.sources.samples import samples_from

    return samples_from(
        t.ev, "m", {"type": F.col("event_type"), "site": F.col("user_id") % 10}, "ts", F.col("value")
    )


SITES = "(SELECT DISTINCT CAST(s_suppkey % 10 AS VARCHAR) AS site FROM supplier)"


@query(
    "l10_target_labels",
    "SELECT 't' || site AS type, event_type AS exported_type, site, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(value, 6) AS value"
    f" FROM events JOIN {SITES} ON site = CAST(user_id % 10 AS VARCHAR)",
)
def _(t):
    v = L.attach_target_labels(_site_samples(t), _targets_by_site(t), "site")
    return out(v, "type", "exported_type", "site")


@query(
    "l10_honor_labels",
    "SELECT event_type AS type, '' AS exported_type, site, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(value, 6) AS value"
    f" FROM events JOIN {SITES} ON site = CAST(user_id % 10 AS VARCHAR)",
)
def _(t):
    v = L.attach_target_labels(_site_samples(t), _targets_by_site(t), "site", honor=True)
    return out(v, "type", "exported_type", "site")


@query(
    "l10_exported_taken",
    "SELECT 't' || site AS type, event_type AS exported_type, 'x' || site AS exported_exported_type, site, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(value, 6) AS value"
    f" FROM events JOIN {SITES} ON site = CAST(user_id % 10 AS VARCHAR)",
)
def _(t):
    """The sample has the label and an exported one of that name already."""
    v = _site_samples(t)
    own = F.create_map(F.lit("exported_type"), F.col("labels")["type"], F.lit("type"), F.concat(F.lit("x"), F.col("labels")["site"]))
    rest = F.map_filter("labels", lambda k, _: k != "type")
    v = rekey(v.withColumn("labels", F.map_concat(rest, own)))
    return out(L.attach_target_labels(v, _targets_by_site(t), "site"), "type", "exported_type", "exported_exported_type", "site")


UPI = f"{UP}, {windowed(HOUR)}, {latest('instance, site')}"


@query(
    "l14_label_replace",
    f"WITH {UPI} SELECT instance, site, CASE WHEN regexp_full_match(instance, '1(.)') THEN 'n' || substr(instance, 2) ELSE '' END AS node, {T}, value FROM i",
)
def _(t):
    v = L.label_replace(R.instant(t.up, HOURLY, "1h"), "node", "n$1", "instance", "1(.)")
    return out(L.check_unique(v), "instance", "site", "node")


@query("l15_label_set", f"WITH {UPI} SELECT instance, site, 'web' AS experiment, {T}, value FROM i")
def _(t):
    return out(L.label_set(R.instant(t.up, HOURLY, "1h"), "experiment", "web"), "instance", "site", "experiment")


@query(
    "l16_distinct_or_operands",
    f"WITH {UPI}, x AS (SELECT instance, site, '1d' AS delay, j + 24 AS j, value FROM i UNION ALL SELECT instance, site, '3d', j + 72, value FROM i)"
    f" SELECT instance, site, delay, {T}, value FROM x",
)
def _(t):
    v = R.instant(t.up, HOURLY, "1h")
    parts = [L.label_set(R.offset(v, d), "delay", d) for d in ("1d", "3d")]
    return out(v_or_all(*parts), "instance", "site", "delay")


@query(
    "s3_target_groups",
    f"WITH {SUPP} SELECT k, module, unnest([address, address || '/backup']) AS address, 'probe' AS job FROM d",
)
def _(t):
    """Target groups as read from files: labels and a list of addresses."""
    groups = targets(t).select(
        label_map({"k": F.col("k"), "module": F.col("labels")["module"]}).alias("labels"),
        F.array(
            F.col("labels")["__address__"], F.concat(F.col("labels")["__address__"], F.lit("/backup"))
        ).alias("targets"),
    )
    rows = expand_groups(groups, {"job": "probe"})
    labels = F.col("labels")
    return rows.select(
        labels["k"].cast("bigint").alias("k"),
        labels["module"].alias("module"),
        labels["__address__"].alias("address"),
        labels["job"].alias("job"),
    )
