"""URL filters: fixed rules, and a tree of path templates for each host that is judged by labelled pages."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A branch stays apart if its labelled share differs from its siblings' with this chi-square or more (one degree of freedom, 5 %).
APART = 3.84
#: Pages of the parent's share that are added to a template's labels, and the smoothed share of bad pages from which it is rejected.
SMOOTHING, REJECT = 4.0, 0.5

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, or a host that it is under, and the start of a path; and its verdict. Null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for action, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def numbered_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path, bad): labels of the documents whose number ends a page's path. bad: poor or toxic by any of its labels."""
    doc = F.regexp_extract("path", r"/([0-9]{1,18})[^0-9/]*/?$", 1)
    numbered = pages.select("host", "path", doc.alias("n")).where("n <> ''").select("host", "path", F.col("n").cast("long").alias("doc"))
    poor = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(poor.cast("int")).alias("bad"))
    return numbered.join(known, "doc").select("host", "path", "bad")


def tokens(path: Column) -> Column:
    """A path's segments with runs of digits generalised."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")


def templates(addresses: DataFrame) -> DataFrame:
    """(host, path, template) for addresses (host, path, n pages, lab labelled, bad of these), one row each.

    The tree grows level by level. Children of a node become one wildcard branch if their labelled shares don't part them from their
    siblings, however many they are; a single child keeps its name. Where all that goes on from a node goes on alike, the rest is named at
    once, so there are as many rounds as levels at which addresses still differ.
    """
    now = written(addresses.select("host", "path", "n", "lab", "bad", tokens(F.col("path")).alias("tokens"), F.lit("").alias("template")))
    level = 0
    while not (here := now.where(F.size("tokens") > level)).isEmpty():
        here = here.withColumn("token", F.col("tokens")[level]).withColumn("left", F.slice("tokens", level + 1, F.size("tokens")))
        child = written(here.groupBy("host", "template", "token").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "bad")), F.min("left").alias("least"), F.max("left").alias("most")))
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "bad")))
        c, r = (F.col("lab").cast("double"), F.col("bad").cast("double")), (F.col("all_lab").cast("double") - F.col("lab"), F.col("all_bad").cast("double") - F.col("bad"))
        gap = r[0] * c[1] - c[0] * r[1]
        apart = (c[0] > 0) & (r[0] > 0) & (gap * gap * F.col("all_lab") >= APART * c[0] * r[0] * F.col("all_bad") * (F.col("all_lab") - F.col("all_bad"))) & (gap != 0)
        # A token's name, and whether its rest goes on alike: then the rest is named with it. What follows a wildcard may meet its siblings'.
        name = F.when((F.col("k") == 1) | apart, F.col("token")).otherwise("*")
        alike = (F.col("name") != "*") & (F.col("least") == F.col("most"))
        named = child.join(node, ["host", "template"]).withColumn("name", name).select("host", "template", "token", "name", alike.alias("alike"))
        longer = now.withColumn("token", F.get("tokens", F.lit(level))).join(named, ["host", "template", "token"], "left")
        rest = F.when(F.col("alike"), F.array_join(F.slice("tokens", level + 2, F.size("tokens")), "/")).otherwise("")
        template = F.concat("template", F.lit("/"), "name", F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(""))
        left = F.when(F.col("alike"), F.slice("tokens", 1, level + 1)).otherwise(F.col("tokens"))
        now = written(longer.select("host", "path", "n", "lab", "bad", left.alias("tokens"), F.when(F.col("name").isNotNull(), template).otherwise(F.col("template")).alias("template")))
        level += 1
    return now.select("host", "path", "n", "lab", "bad", "template")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share): each url's verdict, its rule's or else its template's.

    bad_share: labelled bad pages of the template, smoothed by those of the host, and these by all; null where nothing is labelled, which
    allows. A null url, or one without `://`, has an empty host and path, and they are an address like any other. Repeated rows come back
    repeated. Further columns are not looked at.
    """
    seen = pages.select(F.col("page_id"), host_of().alias("host"), path_of().alias("path"))
    label = numbered_labels(seen, labels).groupBy("host", "path").agg(F.count(F.lit(1)).alias("lab"), F.sum("bad").alias("bad"))
    address = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(label, ["host", "path"], "left").fillna(0, ["lab", "bad"])
    known = templates(address)
    total = known.agg(F.sum("lab").alias("l"), F.sum("bad").alias("b")).first()
    share = float(total.b) / float(total.l) if total.l else None
    by_host = known.groupBy("host").agg(((F.sum("bad") + F.lit(SMOOTHING) * F.lit(share)) / (F.sum("lab") + F.lit(SMOOTHING))).alias("host_share"))
    by_template = known.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    scored = by_template.join(by_host, "host").select("host", "template", ((F.col("bad") + F.lit(SMOOTHING) * F.col("host_share")) / (F.col("lab") + F.lit(SMOOTHING))).alias("bad_share"))
    found = known.select("host", "path", "template").join(scored, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") > REJECT, "block").otherwise("allow")
    return seen.join(found, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", F.round("bad_share", 9).alias("bad_share"))


def _oracle() -> str:
    digits = "regexp_replace(path, '[0-9]+', '#', 'g')"
    split = f"list_filter(string_split({digits}, '/'), lambda s: s <> '')"
    chain = "NULL"
    chain_verdict = "NULL"
    for action, at, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{start}')"
        chain, chain_verdict = f"CASE WHEN {fits} THEN '{at + start}' ELSE {chain} END", f"CASE WHEN {fits} THEN '{action}' ELSE {chain_verdict} END"
    return f"""
    WITH RECURSIVE s AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    l AS (SELECT host, path, count(*) AS lab, sum(bad) AS bad FROM s JOIN b ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT) GROUP BY ALL),
    a AS (SELECT host, path, count(*) AS n FROM s GROUP BY ALL),
    t AS (SELECT 0 AS level, host, path, coalesce(lab, 0) AS lab, coalesce(bad, 0) AS bad, '' AS template, {split} AS tokens FROM a LEFT JOIN l USING (host, path)
        UNION ALL SELECT level + 1, host, path, lab, bad, template || '/' || CASE WHEN k = 1 OR (own_lab > 0 AND all_lab - own_lab > 0 AND gap <> 0
            AND gap * gap * all_lab >= {APART}::DOUBLE * own_lab * (all_lab - own_lab) * all_bad * (all_lab - all_bad)) THEN token ELSE '*' END, tokens
        FROM (SELECT *, (all_lab - own_lab) * own_bad - own_lab * (all_bad - own_bad) AS gap FROM (
            SELECT *, count(DISTINCT token) OVER (PARTITION BY host, template) AS k, sum(lab) OVER (PARTITION BY host, template, token)::DOUBLE AS own_lab, sum(bad) OVER (PARTITION BY host, template, token)::DOUBLE AS own_bad,
                sum(lab) OVER (PARTITION BY host, template)::DOUBLE AS all_lab, sum(bad) OVER (PARTITION BY host, template)::DOUBLE AS all_bad
            FROM (SELECT *, tokens[level + 1] AS token FROM t WHERE len(tokens) > level)))),
    z AS (SELECT * FROM t WHERE level = len(tokens)),
    f AS (SELECT sum(bad)::DOUBLE / sum(lab)::DOUBLE AS share FROM z),
    h AS (SELECT host, (sum(bad) + {SMOOTHING}::DOUBLE * any_value(share)) / (sum(lab) + {SMOOTHING}::DOUBLE) AS host_share FROM z, f GROUP BY host),
    m AS (SELECT host, template, (sum(bad) + {SMOOTHING}::DOUBLE * any_value(host_share)) / (sum(lab) + {SMOOTHING}::DOUBLE) AS bad_share FROM z JOIN h USING (host) GROUP BY ALL)
    SELECT page_id, host, path, {chain} AS rule, coalesce({chain_verdict}, CASE WHEN bad_share > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 9) AS bad_share
    FROM s JOIN (SELECT host, path, template FROM z) USING (host, path) JOIN m USING (host, template)
    """


ORACLE = _oracle()
