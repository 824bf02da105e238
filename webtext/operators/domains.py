"""Registrable domain of a URL from a table of public-suffix rules.

Rules are strings as in the public suffix list: ``co.uk`` (exact), ``*.ck``
(any label under ``ck``) and ``!www.ck`` (exception: ``www.ck`` is not a
suffix, ``ck`` is).  The longest matching rule wins; an exception beats all.
The result is ``<label before the suffix>.<suffix>``; a host with no matching
rule gives ``<last label>.`` and a host equal to a suffix gives ``.<suffix>``.
Labels in Punycode meet rules in Unicode and the other way round; the result
has the host's own labels.

With a rule table of bounded size (a public suffix list has ~10k rules) the
lookup is row-local: one broadcast join by the last label brings all rules below
it as a map, in which the row looks up each of its suffixes.  Rows are never
shuffled or regrouped, and no job runs while the plan is built.  Only an oversized
rule table falls back to resolving each distinct host once (``distinct``
aggregates map-side) and joining the result back by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.punycode import decoded_labels
from ..functions.text import let, strip_ws

# Rule tables up to this many rows are broadcast; larger ones are shuffled.
MAX_BROADCAST_RULES = 200_000
#: Bytes of a rule in Spark's estimate of a table's size, at least.
_RULE_BYTES = 32
#: Maps that the rules of one last label are dealt to: a lookup goes through one.
_BUCKETS = 64

# The characters that separate labels (RFC 3490, section 3.1).
_DOTS = r"[.\x{3002}\x{FF0E}\x{FF61}]"
# The host after a scheme (a name before "//") and the last "@" of the user part, up
# to port, path, query or fragment; a bracketed address is a host as it stands.
_AFTER_SLASHES = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
# Without slashes, no white space may stand in it.
_BARE = r"^\s*(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]*)(?:[/?#:]|\s*$)"
_IP = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def host_of(url):
    """Lower-cased host of a URL, with or without a scheme; odd characters,
    underscores, spaces behind ``//`` and non-ASCII labels are kept, trailing dots
    are dropped.  Null where nothing stands in the host's place."""
    found = F.when(url.rlike(_AFTER_SLASHES), F.regexp_extract(url, _AFTER_SLASHES, 1)).otherwise(F.regexp_extract(url, _BARE, 1))
    host = F.regexp_replace(strip_ws(found), f"{_DOTS}+$", "")
    return F.lower(F.when(host != "", host))


def labels_of(host):
    """The host's labels; an address is one label, kept whole."""
    return F.when(host.rlike(_IP), F.array(host)).otherwise(F.split(host, _DOTS))


def prepare_rules(rules: DataFrame, rule_col: str = "rule") -> DataFrame:
    """rule -> (key, kind) with kind 0 = exact, 1 = wildcard, 2 = exception.

    For a wildcard ``*.x`` the stored key is ``x`` and a candidate matches
    when its parent is ``x``; for ``!a.x`` the key is ``a.x`` and the suffix
    becomes ``x``."""
    r = F.lower(strip_ws(F.col(rule_col)))
    named = (rules.select(r.alias("r"))
             .filter((F.col("r") != "") & ~F.col("r").startswith("//"))
             .select(F.split(F.regexp_replace("r", r"^(\*\.|!)", ""), _DOTS).alias("labels"),
                     F.when(F.col("r").startswith("*."), 1).when(F.col("r").startswith("!"), 2).otherwise(0).alias("kind"))
             .select(F.array_join(decoded_labels("labels"), ".").alias("key"), "kind"))
    # one row per key and lookup, so that no join repeats a row; an exception beats
    # an exact rule of the same name
    return (named.groupBy("key", (F.col("kind") == 1).alias("wild")).agg(F.max("kind").alias("kind"))
            .select("key", "kind"))


def _maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    # The rule table is a parameter, not data that grows with the corpus; its
    # row count is checked before it is shipped to every task.
    return F.broadcast(df) if df.count() <= limit else df


def host_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts -> (host, domain)."""
    prepared = _maybe_broadcast(prepare_rules(rules), MAX_BROADCAST_RULES)
    labels = labels_of(F.col(host_col))
    # candidate i = labels[i..n-1] joined (i = 0 is the whole host)
    cand = (hosts.select(host_col, labels.alias("labels")).withColumn("known", decoded_labels("labels"))
            .select(host_col, "labels", "known",
                    F.posexplode(F.transform(
                        F.sequence(F.lit(1), F.size("labels")),
                        lambda i: F.array_join(F.slice("known", i, F.size("known")), "."))
                    ).alias("i", "cand")))
    parent = F.when(F.col("i") + 1 < F.size("labels"),
                    F.array_join(F.slice("known", F.col("i") + 2, F.size("known")), "."))
    cand = cand.withColumn("parent", parent)
    exact = cand.join(prepared.filter("kind IN (0, 2)"), cand["cand"] == prepared["key"])
    exact = exact.select(host_col, "labels", "i", "kind",
                         # exception: the suffix is the rule minus its first label
                         F.when(F.col("kind") == 2, F.col("i") + 1).otherwise(F.col("i")).alias("start"))
    wild = cand.join(prepared.filter("kind = 1"), cand["parent"] == prepared["key"])
    wild = wild.select(host_col, "labels", "i", "kind", F.col("i").alias("start"))
    matches = exact.unionByName(wild)
    # exception rules prevail, then the longest rule (smallest start index)
    best = (matches.groupBy(host_col)
            .agg(F.min(F.struct((F.col("kind") != 2).alias("not_exc"), "start", "labels")).alias("b"))
            .select(host_col, F.col("b.start").alias("start"), F.col("b.labels").alias("labels")))
    dom = F.when(F.col("start") == 0, F.concat(F.lit("."), F.array_join("labels", "."))).otherwise(
        F.concat_ws(".", F.col("labels")[F.col("start") - 1],
                    F.array_join(F.slice("labels", F.col("start") + 1, F.size("labels")), ".")))
    found = best.select(host_col, dom.alias("domain"))
    last = F.element_at(labels, -1)
    return (hosts.join(found, host_col, "left")
            .select(host_col, F.coalesce("domain", F.concat(last, F.lit("."))).alias("domain")))


def rules_by_last_label(rules: DataFrame) -> DataFrame:
    """``last, rules``: all rules below a last label as bucket -> key -> bits, with
    1 for an exact rule, 2 for a wildcard and 4 for an exception."""
    keyed = prepare_rules(rules).groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("bits"))
    buckets = (keyed.groupBy(F.substring_index("key", ".", -1).alias("last"), _bucket(F.col("key")).alias("bucket"))
               .agg(F.map_from_entries(F.collect_list(F.struct("key", "bits"))).alias("keys")))
    return buckets.groupBy("last").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "keys"))).alias("rules"))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int")


def _suffix_size(known: Column, rules: Column) -> Column:
    """Labels in the suffix of a host (``known``: its decoded labels), null if no
    rule holds."""
    n = F.size(known)

    def bits(k: Column) -> Column:
        key = F.array_join(F.slice(known, -k, k), ".")
        return F.coalesce(F.try_element_at(F.try_element_at(rules, _bucket(key)), key), F.lit(0))

    def longest(found: Column) -> Column:
        ks = F.sequence(F.lit(1), n)
        has = lambda k, bit: F.get(found, k - 1).bitwiseAND(bit) > 0
        exception = F.array_max(F.filter(ks, lambda k: has(k, 4))) - 1
        # the wildcard stands for a label that the host must have
        rule = F.array_max(F.filter(ks, lambda k: has(k, 1) | ((k > 1) & F.coalesce(has(k - 1, 2), F.lit(False)))))
        return F.coalesce(exception, rule)

    return F.when(rules.isNotNull(), let(F.transform(F.sequence(F.lit(1), n), bits), longest))


def _domain_from_suffix(labels, sfx):
    n = F.size(labels)
    return (F.when(sfx.isNull(), F.concat(F.element_at(labels, -1), F.lit(".")))
            .when(sfx >= n, F.concat(F.lit("."), F.array_join(labels, ".")))
            .otherwise(F.concat(F.element_at(labels, -(sfx + 1)), F.lit("."),
                                F.array_join(F.slice(labels, -sfx, sfx), "."))))


def _is_small(rules: DataFrame) -> bool:
    """Whether the rule table is small by Spark's estimate of its size, which needs
    no job.  A table of unknown size (its estimate is the largest there is) is counted."""
    limit = MAX_BROADCAST_RULES * _RULE_BYTES
    estimate = int(rules._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate <= limit or (estimate >= 1 << 62 and rules.count() <= MAX_BROADCAST_RULES)


def registered_domain(df: DataFrame, rules: DataFrame, url_col: str = "url",
                      out_col: str = "domain", redirect_col: str | None = None) -> DataFrame:
    """Add ``out_col``: registrable domain of ``redirect_col`` when present,
    else of ``url_col``.  Null when the URL has no host."""
    src = F.col(url_col) if redirect_col is None else F.coalesce(F.col(redirect_col), F.col(url_col))
    with_host = df.withColumn("_host", host_of(src))
    if _is_small(rules):
        labeled = with_host.withColumn("_labels", labels_of(F.col("_host"))).withColumn("_known", decoded_labels("_labels"))
        table = F.broadcast(rules_by_last_label(rules).select(F.col("last").alias("_last"), F.col("rules").alias("_rules")))
        looked = labeled.join(table, F.element_at("_known", -1) == F.col("_last"), "left")
        suffix = _suffix_size(F.col("_known"), F.col("_rules"))
        dom = F.when(F.col("_host").isNotNull(), let(suffix, lambda n: _domain_from_suffix(F.col("_labels"), n)))
        return looked.withColumn(out_col, dom).drop("_host", "_labels", "_known", "_last", "_rules")
    hosts = with_host.select(F.col("_host").alias("host")).filter("host IS NOT NULL").distinct()
    mapping = host_domains(hosts, rules).withColumnRenamed("host", "_host")
    return (with_host.join(mapping, "_host", "left")
            .withColumnRenamed("domain", out_col).drop("_host"))
