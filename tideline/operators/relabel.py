"""Relabelling of targets and samples.

Rules run in order.  A regex must match the whole source text, several sources are
joined by ``;``, and a rule that does not match leaves the row as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.model import clean_labels, label, label_key, labels_of, merge_labels, rekey
from tideline.operators.select import anchored


@dataclass(frozen=True)
class Rule:
    """One step: ``replace``, ``keep``, ``drop`` or ``labelmap``."""

    action: str = "replace"
    source: tuple[str, ...] = ()
    regex: str = "(.*)"
    replacement: str = "$1"
    target: str = ""


def _expanded(text: str, source: Column, regex: str) -> Column:
    """The replacement with its group references ``$1``, ``${1}`` or ``${name}`` filled in.

    A reference reaches over all letters, digits and underscores after it; one to a group that
    the regex lacks is empty text, and ``$$`` is a dollar sign.
    """
    known = re.compile(regex.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!"))
    parts, at = [], 0
    for found in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", text):
        parts.append(F.lit(text[at : found.start()]))
        at = found.end()
        name = found[2] or found[3]
        if found[1]:
            parts.append(F.lit("$"))
        else:
            group = int(name) if name.isdigit() else known.groupindex.get(name, known.groups + 1)
            if group <= known.groups:
                parts.append(F.call_function("regexp_extract", source, F.lit(anchored(regex)), F.lit(group)))
    return F.concat(*parts, F.lit(text[at:]))


def _source(names: tuple[str, ...]) -> Column:
    if not names:
        return F.lit("")
    return F.concat_ws(";", *[label(n) for n in names])


def _named(df: DataFrame) -> bool:
    return "metric" in df.columns


def _set(df: DataFrame, name: str, value: Column, when: Column) -> DataFrame:
    if name == "__name__" and _named(df):
        return df.withColumn("metric", _settled(F.when(when, value).otherwise(F.col("metric"))))
    changed = merge_labels(F.col("labels"), F.create_map(F.lit(name), value))
    # An empty result deletes the label.
    return df.withColumn("labels", _settled(clean_labels(F.when(when, changed).otherwise(F.col("labels")))))


def _settled(value: Column) -> Column:
    """A value behind a generator, so that it is formed once.

    Catalyst would inline the map of one rule into each of its uses by the next, and filters into the
    maps below them: the work of a chain would double with every rule.
    """
    return F.explode(F.array(value))


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    if rule.action == "labelmap":
        return _labelmap(df, rule)
    source = _source(rule.source)
    matched = source.rlike(anchored(rule.regex))
    if rule.action == "keep":
        return df.filter(matched)
    if rule.action == "drop":
        return df.filter(~matched)
    if rule.regex == "(.*)" and rule.replacement in ("$1", "${1}"):
        value = source
    elif "$" not in rule.replacement:
        value = F.lit(rule.replacement)
    else:
        value = _expanded(rule.replacement, source, rule.regex)
    return _set(df, rule.target, value, matched)


def _labelmap(df: DataFrame, rule: Rule) -> DataFrame:
    """Copy labels whose name matches to the name built from the match."""
    entries = F.filter(
        F.array_sort(F.map_entries("labels")), lambda e: e["key"].rlike(anchored(rule.regex))
    )
    copies = F.transform(
        entries,
        lambda e: F.struct(
            _expanded(rule.replacement, e["key"], rule.regex).alias("key"), e["value"].alias("value")
        ),
    )
    # Two sources may lead to one name: the later source name wins.
    kept = F.filter(
        copies, lambda e, i: ~F.exists(F.slice(copies, i + 2, F.size(copies)), lambda o: o["key"] == e["key"])
    )
    return df.withColumn("labels", _settled(merge_labels(F.col("labels"), F.map_from_entries(kept))))


def relabel(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Run rules over any frame with a ``labels`` map (and optionally ``metric``)."""
    for rule in rules:
        df = apply_rule(df, rule)
    if "series_id" in df.columns:
        df = df.withColumn("series_id", label_key(F.col("labels")))
    return df


metric_relabel = relabel


def strip_internal(df: DataFrame) -> DataFrame:
    """Drop working labels (``__*``) at the end of a target pipeline."""
    out = df.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.startswith("__")))
    return rekey(out) if "series_id" in df.columns else out


def attach_target_labels(v: DataFrame, targets: DataFrame, key: str, honor: bool = False):
    """Join target labels to samples on ``key``.

    With ``honor`` the sample keeps a label both sides have; otherwise the target's
    value is used and the sample's is kept as ``exported_<name>``, with further prefixes while
    a label of that name exists.
    """
    side = targets.select(F.col("labels")[key].alias("_k"), F.col("labels").alias("_t"))
    joined = v.withColumn("_k", label(key)).join(side, "_k")
    own, target = F.col("labels"), F.col("_t")
    if honor:
        merged = merge_labels(target, own)
    else:
        # the label that identifies the target is the same on both sides
        merged = merge_labels(_moved_aside(own, target, key), target)
    return rekey(joined.withColumn("labels", merged))


def _moved_aside(own: Column, target: Column, key: str) -> Column:
    """``own`` with the labels that ``target`` has too under free ``exported_`` names."""
    prefix = F.lit("exported_")
    clashes = F.array_sort(F.filter(F.map_keys(own), lambda k: F.map_contains_key(target, k) & (k != key)))
    none = F.array().cast("array<struct<old:string,new:string>>")
    tries = F.sequence(F.lit(0), F.size(own) + F.size(target))

    def place(done: Column, k: Column) -> Column:
        def longer(name: Column, _: Column) -> Column:
            taken = F.map_contains_key(own, name) | F.map_contains_key(target, name)
            return F.when(taken | F.exists(done, lambda d: d["new"] == name), F.concat(prefix, name)).otherwise(name)

        free = F.aggregate(tries, F.concat(prefix, k), longer)
        return F.concat(done, F.array(F.struct(k.alias("old"), free.alias("new"))))

    moves = F.map_from_entries(F.aggregate(clashes, none, place))
    entries = F.transform(
        F.map_entries(own),
        lambda e: F.struct(
            F.coalesce(F.try_element_at(moves, e["key"]), e["key"]).alias("key"), e["value"].alias("value")
        ),
    )
    return F.map_from_entries(entries)


def label_replace(v: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    source = (src,) if src else ()
    return relabel(v, [Rule("replace", source, regex, replacement, dst)])


def label_set(v: DataFrame, dst: str, value: str) -> DataFrame:
    """Set a label to a constant."""
    return relabel(v, [Rule("replace", (), ".*", value, dst)])


def check_unique(v: DataFrame) -> DataFrame:
    """Fail when relabelling made two series equal at one instant."""
    grouped = v.groupBy("ts", "metric", "series_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first("value").alias("_v")
    )
    message = F.lit("relabelling produced equal series")
    value = F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(message).cast("double"))
    labels = labels_of("series_id")
    return grouped.select("metric", labels.alias("labels"), "series_id", "ts", value.alias("value"))


def probe_target_rules(exporter: str, address: str = "(.+)", target: str = "$1") -> list[Rule]:
    """Turn a probed address into probe parameters and point the scrape at the exporter.

    ``address`` matches the probed address and ``target`` builds the probe's target from it.
    """
    copies = {"instance": "__address__", "__param_module": "module"}
    rules = [Rule("replace", (source,), target=name) for name, source in copies.items()]
    rules.append(Rule("replace", ("__address__",), address, target, "__param_target"))
    return [*rules, Rule("replace", (), ".*", exporter, "__address__")]


def host_rules(source: str, host: str, site: str) -> list[Rule]:
    """Machine and site from a host name; ``site`` is a regex with one group."""
    return [
        Rule("replace", (source,), host, "$1", "machine"),
        Rule("replace", (source,), site, "$1", "site"),
    ]
