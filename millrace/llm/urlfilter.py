"""URL filters: allow and block rules first, then a template tree of paths per host.

The urls that a rule decides are the labelled ones. Per host and number of segments, the
paths form a tree, to its full depth. Segments that vary by nature (numbers, long codes,
dates) are wildcards. A branch whose share of blocked urls does not differ from that of
its siblings by more than chance is merged with them into a wildcard. A template is
rejected if its smoothed share of blocked urls is high enough; the smoothing pulls each
level of a template towards the level above, the first towards its host and a host
towards all urls.

All levels are worked out at once: a path is a row of keys, one for each of its prefixes,
so that no job waits for the level above and a path may have any number of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, let, saved, table

#: (verdict, rule): fixed values of the contract.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Pseudo-counts that a level takes from the level above it.
SMOOTHING = 4.0
#: From this smoothed share of blocked urls on a template is rejected.
PURITY = 0.5
#: A branch merges where its share and that of its siblings are within this many standard errors.
SIMILAR = 2.0
#: A segment that varies by nature.
VARIABLE = r"^[0-9]+([.][a-z]+)?$|[0-9][0-9][0-9][0-9]"
LONG_SEGMENT = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url by the contract; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none does."""
    rule = verdict = None
    for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def _segments(path: Column) -> Column:
    """The segments of a path, those that vary by nature as ``*``; an empty path has none."""
    variable = lambda s: s.rlike(VARIABLE) | (F.length(s) >= LONG_SEGMENT)
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda s: F.when(variable(s), F.lit("*")).otherwise(s))


def _keys(host: Column, segments: Column) -> Column:
    """A key for the root (host and number of segments) and for every prefix of ``segments``."""
    return F.aggregate(
        segments,
        F.array(F.xxhash64(host, F.size(segments))),
        lambda keys, s: F.concat(keys, F.array(F.xxhash64(F.element_at(keys, -1), s))),
    )


def _merged(leaves: DataFrame) -> DataFrame:
    """(leaf, steps): for every leaf its segments, those of merged branches as ``*``."""
    placed = leaves.select("bad", "known", "keys", F.posexplode(F.slice("keys", 2, F.size("keys"))).alias("at", "key"))
    branches = placed.groupBy(F.get("keys", F.col("at")).alias("parent"), "key").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    branches = saved(branches, "branches")
    whole = branches.groupBy("parent").agg(F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
    b, n = F.col("bad").cast("double"), F.col("known").cast("double")
    r, m = F.col("all_bad") - b, F.col("all_known") - n
    # (b/n - r/m)^2 <= SIMILAR^2 * p(1-p)(1/n + 1/m) with the pooled share p, free of divisions
    alike = (b * m - r * n) * (b * m - r * n) * (n + m) <= SIMILAR * SIMILAR * (b + r) * (n + m - b - r) * n * m
    flags = saved(branches.join(whole, "parent").where(F.coalesce((n == 0) | (m == 0) | alike, F.lit(True))).select("key"), "merged")
    steps = leaves.select("leaf", F.posexplode(F.arrays_zip(F.slice("keys", 2, F.size("keys")).alias("key"), F.col("segments").alias("segment"))).alias("at", "x"))
    flagged = steps.select("leaf", "at", "x.segment", "x.key").join(flags.withColumn("star", F.lit(True)), "key", "left")
    one = F.struct("at", F.when(F.col("star"), F.lit("*")).otherwise(F.col("segment")).alias("step"))
    return flagged.groupBy("leaf").agg(F.sort_array(F.collect_list(one)).alias("s")).select("leaf", F.col("s.step").alias("steps"))


def _purities(leaves: DataFrame) -> DataFrame:
    """(leaf, template, purity) of leaves with their ``steps``."""
    keyed = leaves.select("leaf", "steps", "bad", "known", _keys(F.col("host"), F.col("steps")).alias("keys"))
    counts = keyed.select("bad", "known", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("bad").alias("b"), F.sum("known").alias("n"))
    total = leaves.agg(F.sum("bad").alias("b"), F.sum("known").alias("n")).first()
    share = ((total["b"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    levels = keyed.select("leaf", F.posexplode("keys").alias("at", "key")).join(saved(counts, "counts"), "key")
    rows = levels.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "b", "n"))).alias("levels"))
    purity = F.aggregate("levels", F.lit(share), lambda p, x: (x["b"] + F.lit(SMOOTHING) * p) / (x["n"] + F.lit(SMOOTHING)))
    return rows.join(keyed.select("leaf", "steps"), "leaf").select("leaf", F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"), purity.alias("purity"))


def judge(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template.

    A null url, or one without ``://``, has an empty host and path. Urls of one host and
    template share the template's verdict; a host or template without labelled urls gets
    what the smoothing says, and a share at the limit is rejected. A branch without
    labelled urls, or without labelled siblings, merges. Null ids and repeated rows pass
    through; other columns are left out. Urls of any length are taken whole. An empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = cut.select("*", rule.alias("rule"), verdict.alias("said"), _segments(F.col("path")).alias("segments"))
    bad, known = F.sum((F.col("said") == "block").cast("int")), F.count("said")
    grouped = ruled.groupBy("host", "segments").agg(F.coalesce(bad, F.lit(0)).alias("bad"), known.alias("known"))
    keyed = grouped.select("*", _keys(F.col("host"), F.col("segments")).alias("keys"))
    leaves = saved(keyed.select("*", F.element_at("keys", -1).alias("leaf")), "leaves")
    grown = leaves.join(_merged(leaves), "leaf", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
    decided = saved(_purities(saved(grown.select("leaf", "host", "steps", "bad", "known"), "grown")), "decided")
    leaf = let(_keys(F.col("host"), F.col("segments")), lambda k: F.element_at(k, -1))
    told = ruled.select("page_id", "host", "path", "rule", "said", leaf.alias("leaf")).join(decided, "leaf")
    judged = F.coalesce("said", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", "rule", judged.alias("verdict"), "template")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"))


#: The same, said level by level over paths as text; the rules are a table, and the levels of a template are folded by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE rules(verdict, domain, start, name) AS (
  VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
    ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')
), parsed AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '[?#].*$', '', 's') AS path
  FROM parsed
), labelled AS (
  SELECT r, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS said
  FROM parts JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY r
), paths AS (
  SELECT p.*, l.rule, l.said,
    list_transform(string_split(path, '/')[2:], lambda s: CASE WHEN regexp_matches(s, '^[0-9]+([.][a-z]+)?$|[0-9]{4}') OR length(s) >= 40 THEN '*' ELSE s END) AS seg
  FROM parts p LEFT JOIN labelled l ON l.r = p.r
), tree AS (
  SELECT host, seg, len(seg) AS depth, count(*) FILTER (WHERE said = 'block') AS bad, count(said) AS known FROM paths GROUP BY ALL
), branch AS (
  SELECT host, depth, lvl, array_to_string(seg[1:lvl], '/') AS own, CASE WHEN lvl > 1 THEN array_to_string(seg[1:lvl - 1], '/') END AS above, sum(bad)::DOUBLE AS b, sum(known)::DOUBLE AS n
  FROM tree, unnest(range(1, depth + 1)) u(lvl) GROUP BY ALL
), sibling AS (
  SELECT host, depth, lvl, own, b, n, sum(b) OVER w - b AS rb, sum(n) OVER w - n AS rn FROM branch WINDOW w AS (PARTITION BY host, depth, lvl, above)
), merged AS (
  SELECT host, depth, lvl, own FROM sibling
  WHERE n = 0 OR rn = 0 OR (b * rn - rb * n) * (b * rn - rb * n) * (n + rn) <= 4.0 * (b + rb) * (n + rn - b - rb) * n * rn
), step AS (
  SELECT t.host, t.seg, t.depth, u.lvl, CASE WHEN m.own IS NULL THEN t.seg[u.lvl] ELSE '*' END AS step
  FROM tree t, unnest(range(1, t.depth + 1)) u(lvl) LEFT JOIN merged m ON m.host = t.host AND m.depth = t.depth AND m.lvl = u.lvl AND m.own = array_to_string(t.seg[1:u.lvl], '/')
), grown AS (
  SELECT t.host, t.seg, t.depth, t.bad, t.known, coalesce(s.steps, []) AS steps
  FROM tree t LEFT JOIN (SELECT host, seg, list(step ORDER BY lvl) AS steps FROM step GROUP BY host, seg) s ON s.host = t.host AND s.seg = t.seg
), level AS (
  SELECT host, depth, lvl, array_to_string(steps[1:lvl], '/') AS prefix, sum(bad)::DOUBLE AS b, sum(known)::DOUBLE AS n FROM grown, unnest(range(0, depth + 1)) u(lvl) GROUP BY ALL
), fold(host, depth, steps, lvl, purity) AS (
  SELECT g.host, g.depth, g.steps, 0, (l.b + 4.0 * (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(known) + 2.0::DOUBLE) FROM tree)) / (l.n + 4.0::DOUBLE)
  FROM (SELECT DISTINCT host, depth, steps FROM grown) g JOIN level l ON l.host = g.host AND l.depth = g.depth AND l.lvl = 0
  UNION ALL
  SELECT f.host, f.depth, f.steps, f.lvl + 1, (l.b + 4.0::DOUBLE * f.purity) / (l.n + 4.0::DOUBLE)
  FROM fold f JOIN level l ON l.host = f.host AND l.depth = f.depth AND l.lvl = f.lvl + 1 AND l.prefix = array_to_string(f.steps[1:f.lvl + 1], '/')
)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.said, CASE WHEN f.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(g.steps, '/') AS template
FROM paths p JOIN grown g ON g.host = p.host AND g.seg = p.seg JOIN fold f ON f.host = g.host AND f.depth = g.depth AND f.steps = g.steps AND f.lvl = f.depth
"""
