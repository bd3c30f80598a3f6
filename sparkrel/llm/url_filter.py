"""URL filtering by rules and a path-template tree.

A url's host and path first meet the rules: the longest one that fits decides,
and urls decided by a rule are the labels. Urls without a rule are judged by a
tree of path templates, built for each host level by level, as deep as its
paths go:

* segments that look like numbers, hashes, identifiers or slugs become
  wildcards; of more than ``rare`` siblings, those with less than a
  ``rare``-th of their parent's urls become the wildcard ``*`` (``*+`` those
  that labels mostly block, ``*-`` those that labels mostly allow), so a node
  has few branches left;
* sibling branches with labels stand in order of their block rates, and
  neighbours whose rates don't differ by a two-proportion test merge. A branch
  without labels has no rate to compare and merges with none.

A template is rejected when its labelled purity, smoothed by ``weight`` labels
of a prior, reaches ``threshold``. The prior is the share of hosts, with
``weight`` more that allow, whose labels mostly block the same path shape (its
template before branches merge), so every host counts once. A template without
labels of its own has the prior as its purity: it is rejected where enough
other hosts' labels block its shape. What no label speaks of has purity 0.

All steps after the first (map-side combined) aggregation handle one row for
each lexical template of a host, not urls. Only DataFrame functions are used.

Defined results: a null url or one without ``://`` has an empty host and path,
and an empty template; an empty path has the empty template, ``/`` the template
``/``; repeated rows are judged each; extra columns are ignored; without any
rule hit everything is allowed; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep

#: (verdict, host, path); of the rules that fit a url, the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by their looks: numbers (also of a file), hashes, slugs of four words or more, identifiers.
CLASSES = (("<n>", "^[0-9]+([.][A-Za-z]+)?$"), ("<h>", "^[0-9a-f]{16,}$"), ("<s>", "^[^-_]+([-_][^-_]+){3,}$"), ("<i>", "^.*[0-9].*$"))
#: Least length of an identifier.
IDENTIFIER = 8
#: Templates of so many urls are joined by a broadcast; there is at most one for each so many urls.
HOT = 1 << 20
#: Lexical templates that are broadcast at most.
BROADCAST_ROWS = 100_000


def general(seg: Column) -> Column:
    """A segment's class by its looks, or itself."""
    out = seg
    for name, pattern in reversed(CLASSES):
        fits = seg.rlike(pattern)
        out = F.when(fits & (F.length(seg) >= IDENTIFIER) if name == "<i>" else fits, F.lit(name)).otherwise(out)
    return out


def ruled(pages: DataFrame, rules, id_col: str, url_col: str) -> DataFrame:
    """page_id, host, path, rule, said (the rule's verdict), segs (the path's generalised segments)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i)
    rows = pages.select(F.col(id_col).alias("page_id"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    segs = F.when(F.col("path") == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(F.substring("path", 2, 1 << 30), "/", -1), general))
    return rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), segs.alias("segs"))


def branches(paths: DataFrame, level: int, rare: int) -> DataFrame:
    """host, t (the template above), seg, v (seg or its wildcard), nl, nb for every branch below the level's nodes."""
    node = ["host", "t"]
    found = paths.groupBy(*node, F.get("segs", F.lit(level)).alias("seg")).agg(*(F.sum(c).alias(c) for c in ("n", "nl", "nb")))
    above = found.groupBy(*node).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kids"))
    wild = F.when(F.col("nl") == 0, "*").when(2 * F.col("nb") >= F.col("nl"), "*+").otherwise("*-")
    v = F.when((F.col("kids") > rare) & (F.col("n") * rare < F.col("all")), wild).otherwise(F.col("seg"))
    return found.join(above, node).select(*node, "seg", v.alias("v"), "nl", "nb")


def merges(found: DataFrame, z: float) -> DataFrame:
    """host, t, v, token for the labelled branches of each node: token names all that merge. A node has few of them, as rare ones share wildcards."""
    node = Window.partitionBy("host", "t").orderBy(F.col("nb") / F.col("nl"), "v")
    rates = found.groupBy("host", "t", "v").agg(F.sum("nl").alias("nl"), F.sum("nb").alias("nb")).filter("nl > 0")
    l, b = F.col("nl"), F.col("nb")  # noqa: E741
    pl, pb = F.lag("nl").over(node), F.lag("nb").over(node)
    rate = (pb + b) / (pl + l)
    apart = F.abs(b / l - pb / pl) > z * F.sqrt(rate * (1 - rate) * (1 / l + 1 / pl))
    run = F.sum("_new").over(node.rowsBetween(Window.unboundedPreceding, 0))
    runs = rates.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", run)
    names = F.sort_array(F.collect_set("v").over(Window.partitionBy("host", "t", "run")))
    return runs.select("host", "t", "v", F.when(F.size(names) > 1, F.concat(F.lit("("), F.array_join(names, "|"), F.lit(")"))).otherwise(F.col("v")).alias("token"))


def tree(urls: DataFrame, rare: int, z: float) -> DataFrame:
    """host, segs, n, nl, nb with t, the template, and shape, the template before merges, for every lexical template; written level by level."""
    paths = urls.select("*", F.lit("").alias("t"), F.lit("").alias("shape"))
    depth = urls.agg(F.max(F.size("segs"))).first()[0] or 0
    done = None
    for level in range(depth):
        ends = paths.filter(F.size("segs") <= level)
        done = ends if done is None else done.unionByName(ends)
        deep = paths.filter(F.size("segs") > level).withColumn("seg", F.get("segs", F.lit(level)))
        found = keep(branches(deep, level, rare), "url-branches")
        tokens = found.select("host", "t", "seg", "v").join(merges(found, z), ["host", "t", "v"], "left")
        paths = deep.join(tokens, ["host", "t", "seg"]).select("host", "segs", "n", "nl", "nb", F.concat("t", F.lit("/"), F.coalesce("token", "v")).alias("t"), F.concat("shape", F.lit("/"), "v").alias("shape"))
        paths = keep(paths, "url-paths")
    return paths if done is None else done.unionByName(paths)


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", rare: int = 16, z: float = 1.96, weight: int = 4, threshold: float = 0.5) -> DataFrame:
    """Per url: page_id, host, path, rule, verdict, template, purity."""
    rows = ruled(pages, rules, id_col, url_col)
    blocked = F.count(F.when(F.col("said") == "block", 1))
    urls = keep(rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("nl"), blocked.alias("nb")), "urls")
    paths = keep(tree(urls, rare, z), "url-tree")
    told = paths.filter("nl > 0")
    votes = told.groupBy("host", "shape").agg((2 * F.sum("nb") >= F.sum("nl")).cast("int").alias("vote")).groupBy("shape").agg((F.sum("vote") / (F.count(F.lit(1)) + weight)).alias("prior"))
    own = told.groupBy("host", "t").agg(F.sum("nl").alias("tl"), F.sum("nb").alias("tb"))
    prior, tl, tb = F.coalesce("prior", F.lit(0.0)), F.coalesce("tl", F.lit(0)), F.coalesce("tb", F.lit(0))
    purity = F.round((tb + weight * prior) / (tl + weight), 6)
    judged = keep(paths.join(own, ["host", "t"], "left").join(votes, "shape", "left").select("host", "segs", "n", F.col("t").alias("template"), purity.alias("purity")), "url-templates")
    on = ["host", "segs"]
    if judged.count() <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(judged.drop("n")), on)
    else:
        hot = judged.filter(F.col("n") >= HOT).drop("n")
        found = rows.join(judged.filter(F.col("n") < HOT).drop("n"), on).unionByName(rows.join(F.broadcast(hot), on))
    verdict = F.coalesce("said", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def sql(rules=RULES, *, rare: int = 16, z: float = 1.96, weight: int = 4, threshold: float = 0.5) -> str:
    """The same judgement of the table pages in DuckDB SQL: the tree as one recursion with windows over paths."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(v)}, {quoted(h)}, {quoted(p)})" for v, h, p in rules)
    looks = " ".join(f"WHEN regexp_matches(s, {quoted(p)})" + (f" AND length(s) >= {IDENTIFIER}" if n == "<i>" else "") + f" THEN {quoted(n)}" for n, p in CLASSES)
    return f"""
WITH RECURSIVE rules(said, h, p) AS (VALUES {listed}),
  a AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
  b AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
  f AS (SELECT id, max_by(h || p, length(h || p)) AS rule, max_by(said, length(h || p)) AS said FROM b, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id),
  g AS (SELECT b.*, rule, said, CASE WHEN path = '' THEN []::VARCHAR[] ELSE list_transform(string_split(path[2:], '/'), lambda s: CASE {looks} ELSE s END) END AS segs FROM b LEFT JOIN f USING (id)),
  u AS (SELECT host, segs, count(*) AS n, count(said) AS nl, count(*) FILTER (said = 'block') AS nb FROM g GROUP BY ALL),
  lv(i, host, segs, n, nl, nb, t, shape) AS (
    SELECT 1, host, segs, n, nl, nb, '', '' FROM u
    UNION ALL
    SELECT i + 1, host, segs, n, nl, nb, t || '/' || CASE WHEN vl = 0 OR len(list_distinct(same)) = 1 THEN v ELSE '(' || array_to_string(list_sort(list_distinct(same)), '|') || ')' END, shape || '/' || v FROM (
      SELECT *, list(CASE WHEN vl > 0 THEN v END) OVER (PARTITION BY host, t, vl > 0, run) AS same FROM (
        SELECT *, sum(CASE WHEN vl > 0 AND head AND coalesce(apart, true) THEN 1 ELSE 0 END) OVER (PARTITION BY host, t, vl > 0 ORDER BY vb / vl, v RANGE UNBOUNDED PRECEDING) AS run FROM (
          SELECT *, abs(vb / vl - pb / pl) > {z} * sqrt((pb + vb) / (pl + vl) * (1 - (pb + vb) / (pl + vl)) * (1 / vl + 1 / pl)) AS apart FROM (
            SELECT *, lag(vl) OVER w AS pl, lag(vb) OVER w AS pb FROM (
              SELECT *, row_number() OVER (PARTITION BY host, t, v) = 1 AS head, sum(nl) OVER (PARTITION BY host, t, v)::DOUBLE AS vl, sum(nb) OVER (PARTITION BY host, t, v)::DOUBLE AS vb FROM (
                SELECT *, CASE WHEN kids > {rare} AND sn * {rare} < pn THEN CASE WHEN sl = 0 THEN '*' WHEN 2 * sb >= sl THEN '*+' ELSE '*-' END ELSE segs[i] END AS v FROM (
                  SELECT *, sum(n) OVER s AS sn, sum(nl) OVER s AS sl, sum(nb) OVER s AS sb, sum(n) OVER (PARTITION BY host, t) AS pn, count(DISTINCT segs[i]) OVER (PARTITION BY host, t) AS kids FROM lv WHERE len(segs) >= i WINDOW s AS (PARTITION BY host, t, segs[i]))))
            WINDOW w AS (PARTITION BY host, t, vl > 0, head ORDER BY vb / vl, v)))))),
  e AS (SELECT * FROM lv WHERE len(segs) = i - 1),
  k AS (SELECT shape, sum(vote) / (count(*) + {weight}) AS prior FROM (SELECT host, shape, (2 * sum(nb) >= sum(nl))::INT AS vote FROM e WHERE nl > 0 GROUP BY ALL) GROUP BY shape),
  o AS (SELECT host, t, sum(nl) AS tl, sum(nb) AS tb FROM e GROUP BY ALL),
  q AS (SELECT host, segs, t AS template, round((tb + {weight} * coalesce(prior, 0.0)) / (tl + {weight}), 6) AS purity FROM e JOIN o USING (host, t) LEFT JOIN k USING (shape))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM g JOIN q USING (host, segs)"""
