"""URL filter by a tree of path templates per host, beside explicit rules.

Paths are taken segment by segment. Below a node, segments are variable when they are many and mostly new (over ``KINDS`` of them, or more than ``NEW`` of
the node's urls bring one of their own); they become one wildcard branch, others stay as they are. Every url thus has a template, a path of branches.

Sibling branches, inner ones as well as leaves, are merged where they are statistically similar: what follows most in them (the shape of the next
segment, or of the last one) is the same, shapes are distributed as in all siblings of which that holds (chi-square, ``CHI``), and where they have
``LEAST`` labels or more, labelled shares differ by no more than chance, too (a two-proportion test, ``Z``). Urls that a rule decides are the labelled ones; merged branches
share their counts and are one branch from there on: what is below them is merged in turn. So a branch without labels has those of its like. A branch's smoothed purity is (blocked + A * expected) / (labelled + A); expected
is the base (the share of all urls that rules block) for a host, and for other branches halfway (``INHERIT``) from the base to the purity of the branch above. A
template is rejected when its purity reaches ``REJECT``; urls without a fitting rule get their template's verdict.

Below ``DEPTH`` segments the rest of a path is one segment. A null url and one without ``://`` have an empty host and path, hence an unlabelled
template, and are allowed. Repeated rows and ids are judged alike; an empty table gives an empty result; extra columns are ignored.
Counts are aggregated per distinct path first, so a host that holds a third of all rows is shuffled as its distinct paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import dropped, pick, stored

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEPTH, KINDS, NEW, LEAST, Z, A, REJECT = 6, 20, 0.5, 5, 1.96, 4.0, 0.8
#: The quantile of the normal distribution at which the chi-square test (after Wilson and Hilferty) calls branches different: 0.99.
CHI = 2.326
INHERIT = 0.5
COUNTS = ("n", "labelled", "blocked")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host + path) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame) -> DataFrame:
    """paths: distinct (host, path) with n, labelled, blocked. Adds pieces and nodes, the templates of all branches that lead to a path, level by level."""
    pieces = F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH)
    state = stored(paths.select("*", pieces.alias("pieces"), F.lit("").alias("template"), F.array().cast("array<string>").alias("nodes")), "paths")
    depth = state.agg(F.max(F.size("pieces"))).first()[0] or 0
    for level in range(depth):
        open_ = F.size("pieces") > level
        piece = F.get("pieces", F.lit(level))
        children = state.where(open_).groupBy("host", "template", piece.alias("piece")).agg(F.sum("n").alias("n"))
        kinds = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
        wild = kinds.where((F.col("kinds") > KINDS) | ((F.col("kinds") > NEW * F.col("total")) & (F.col("total") >= LEAST))).select("host", "template", F.lit(True).alias("wild"))
        joined = state.join(wild, ["host", "template"], "left")
        longer = F.concat("template", F.lit("/"), F.when(F.col("wild") & (piece != ""), F.lit("*")).otherwise(piece))
        after = joined.select("host", "path", "n", "labelled", "blocked", "pieces", "nodes", F.when(open_, longer).otherwise(F.col("template")).alias("template"))
        state, before = stored(after.withColumn("nodes", F.when(open_, F.array_append("nodes", F.col("template"))).otherwise(F.col("nodes"))), "paths"), state
        dropped(before)
    return state


def shape(piece: Column) -> Column:
    """A segment with its digits as 0 and its letters as a."""
    return F.regexp_replace(F.regexp_replace(piece, "[0-9]+", "0"), "[A-Za-z]+", "a")


def purities(tree: DataFrame, base_share: float) -> DataFrame:
    """host, level, node and purity of every branch; level 0 is the host. Branches are far fewer than paths, and a branch has no more than DEPTH above it."""
    at = F.col("at")
    following = F.when(at < F.size("pieces"), shape(F.get("pieces", at))).otherwise(F.concat(F.lit("$"), shape(F.get("pieces", at - 1))))
    branches = (
        tree.select("host", "n", "labelled", "blocked", "nodes", "pieces", F.explode(F.sequence(F.lit(1), F.size("nodes"))).alias("at"))
        .select("host", at.alias("level"), F.when(at > 1, F.get("nodes", at - 2)).otherwise("").alias("parent"), F.get("nodes", at - 1).alias("node"), following.alias("shape"), "n", "labelled", "blocked")
        .groupBy("host", "level", "parent", "node", "shape").agg(*(F.sum(c).alias(c) for c in COUNTS))
    )
    # the shape that follows most in a branch (of equals the first), and the branch's own counts
    whole = branches.groupBy("host", "level", "node").agg(F.min(F.struct(-F.col("n"), "shape"))["shape"].alias("mode"), *(F.sum(c).alias(f"all_{c}") for c in COUNTS))
    branches = stored(branches.join(whole, ["host", "level", "node"]), "branches")
    roots = branches.where("level = 1").groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # one: the branch that a branch is part of
    found = above = roots.select("host", F.lit(0).alias("level"), F.lit("").alias("node"), F.lit("").alias("one"), _smooth(F.lit(base_share)).alias("purity"))
    for level in range(1, (branches.agg(F.max("level")).first()[0] or 0) + 1):
        upper = above.select("host", F.col("node").alias("parent"), F.col("one").alias("under"), (base_share + INHERIT * (F.col("purity") - base_share)).alias("expected"))
        above = _merged(branches.where(F.col("level") == level).join(upper, ["host", "parent"]))
        found = found.unionByName(above)
    return found


def _smooth(expected: Column) -> Column:
    return (F.col("blocked") + A * expected) / (F.col("labelled") + A)


def _merged(branches: DataFrame) -> DataFrame:
    """The branches of a level with one and purity. What is used more than once is stored, so that no plan holds another twice: the driver's memory goes with the size of plans."""
    family = ["host", "under", "mode"]
    branches = stored(branches, "level")
    # how what follows is distributed in all of a family
    pool = branches.groupBy(*family, "shape").agg(F.sum("n").alias("pool"))
    whole = pool.groupBy(*family).agg(F.sum("pool").alias("whole"), (F.count(F.lit(1)) - 1).alias("free"))
    squares = (
        branches.join(pool, [*family, "shape"]).join(whole, family)
        .groupBy(*family, "level", "node").agg(
            F.sum(F.col("n") * F.col("n") * F.col("whole") / (F.col("all_n") * F.col("pool"))).alias("squares"),
            *(F.first(f"all_{c}").alias(c) for c in COUNTS), F.first("expected").alias("expected"), F.first("free").alias("free"),
        )
    )
    f = 2.0 / (9.0 * F.col("free"))
    most = F.when(F.col("free") > 0, F.col("free") * F.pow(1 - f + CHI * F.sqrt(f), 3)).otherwise(0.0)
    alike = stored(squares.select(*family, "level", "node", "labelled", "blocked", "expected", (F.col("squares") - F.col("n") <= most + 1e-9).alias("alike")), "alike")
    known = F.col("alike") & (F.col("labelled") >= LEAST)
    told = alike.groupBy(*family).agg(F.sum(F.when(known, F.col("labelled"))).alias("all_labelled"), F.sum(F.when(known, F.col("blocked"))).alias("all_blocked"))
    share, together = F.col("blocked") / F.col("labelled"), F.col("all_blocked") / F.col("all_labelled")
    error = F.sqrt(together * (1 - together) * (1 / F.col("labelled") + 1 / F.col("all_labelled")))
    merged = F.col("alike") & ((F.col("labelled") < LEAST) | (F.abs(share - together) <= Z * error + 1e-12))
    marked = stored(alike.join(told, family).select(*family, "level", "node", "labelled", "blocked", "expected", merged.alias("merged")), "marked")
    dropped(branches), dropped(alike)
    sums = marked.where("merged").groupBy(*family).agg(F.sum("labelled").alias("m_labelled"), F.sum("blocked").alias("m_blocked"))
    own = lambda c: F.when(F.col("merged"), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c)
    counts = marked.join(sums, family, "left").select(
        "host", "level", "node", F.when(F.col("merged"), F.concat("under", F.lit("/<"), "mode", F.lit(">"))).otherwise(F.col("node")).alias("one"), own("labelled"), own("blocked"), "expected",
    )
    out = stored(counts.select("host", "level", "node", "one", _smooth(F.col("expected")).alias("purity")), "branch-purities")
    dropped(marked)
    return out


def judged(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (null where a rule decides) for every row."""
    base = pick(pages, key, url)
    host, path = host_path(F.col(url))
    rule, said = fitting(F.col("host"), F.col("path"), rules)
    rows = base.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), said.alias("said"))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    tree = templates(paths)
    total = tree.agg(F.sum("n"), F.sum("blocked")).first()
    found = purities(tree, float((total[1] or 0) / total[0]) if total[0] else 0.0)
    # only what no rule decides needs its template
    leaf = tree.where("labelled < n").select("host", "path", F.col("template").alias("node"), F.size("nodes").alias("level"))
    by_path = leaf.join(found, ["host", "level", "node"]).select("host", "path", F.col("node").alias("template"), "purity")
    open_ = rows.where("rule is null").join(by_path, ["host", "path"], "left")
    left = open_.select("page_id", "host", "path", "rule", F.when(F.col("purity") >= REJECT, "block").otherwise("allow").alias("verdict"), "template", "purity")
    decided = rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    return decided.unionByName(left)


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rules=RULES) -> str:
    """The same rules and tree in SQL, a group of CTEs a level."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in ordered) + " END"
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    parts = [
        rf"h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages))",
        f"r AS MATERIALIZED (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM h)",
        f"""s0 AS (SELECT host, path, n, labelled, blocked, '' AS template, []::VARCHAR[] AS nodes,
          CASE WHEN len(x) > {DEPTH} THEN list_append(list_slice(x, 1, {DEPTH - 1}), array_to_string(list_slice(x, {DEPTH}, len(x)), '/')) ELSE x END AS pieces
          FROM (SELECT host, path, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, string_split(regexp_replace(path, '^/', ''), '/') AS x FROM r GROUP BY host, path))""",
    ]
    for k in range(DEPTH):
        parts += [
            f"c{k} AS (SELECT host, template, pieces[{k + 1}] AS piece, sum(n) AS n FROM s{k} WHERE len(pieces) > {k} GROUP BY ALL)",
            f"w{k} AS (SELECT host, template FROM (SELECT host, template, count(*) AS kinds, sum(n) AS total FROM c{k} GROUP BY ALL) WHERE kinds > {KINDS} OR (kinds > {NEW} * total AND total >= {LEAST}))",
            f"""s{k + 1} AS MATERIALIZED (SELECT host, path, n, labelled, blocked, template, CASE WHEN len(pieces) > {k} THEN list_append(nodes, template) ELSE nodes END AS nodes, pieces FROM (
              SELECT s.host, path, n, labelled, blocked, nodes, pieces,
              CASE WHEN len(pieces) > {k} THEN s.template || '/' || CASE WHEN w.host IS NOT NULL AND pieces[{k + 1}] <> '' THEN '*' ELSE pieces[{k + 1}] END ELSE s.template END AS template
              FROM s{k} s LEFT JOIN w{k} w ON w.host = s.host AND w.template = s.template))""",
        ]
    shape_ = lambda x: f"regexp_replace(regexp_replace({x}, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g')"
    base = f"(SELECT sum(blocked)::DOUBLE / sum(n) FROM s{DEPTH})"
    f = "(2.0::DOUBLE / (9.0::DOUBLE * free))"
    parts += [
        f"""b0 AS MATERIALIZED (SELECT host, k AS level, CASE WHEN k > 1 THEN nodes[k - 1] ELSE '' END AS parent, nodes[k] AS node,
          CASE WHEN k < len(pieces) THEN {shape_("pieces[k + 1]")} ELSE '$' || {shape_("pieces[k]")} END AS shape, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked
          FROM (SELECT *, unnest(range(1, len(nodes) + 1)) AS k FROM s{DEPTH}) GROUP BY ALL)""",
        "br AS MATERIALIZED (SELECT b0.*, mode FROM b0 JOIN (SELECT host, level, node, first(shape ORDER BY n DESC, shape) AS mode FROM b0 GROUP BY ALL) USING (host, level, node))",
        f"p0 AS (SELECT host, 0 AS level, '' AS node, '' AS one, (sum(blocked) + {A} * {base}) / (sum(labelled) + {A}) AS purity FROM br WHERE level = 1 GROUP BY host)",
    ]
    for k in range(1, DEPTH + 1):
        parts += [
            f"e{k} AS MATERIALIZED (SELECT br.*, u.one AS under, {base} + {INHERIT} * (purity - {base}) AS expected FROM br JOIN p{k - 1} u ON u.host = br.host AND u.node = br.parent WHERE br.level = {k})",
            f"po{k} AS (SELECT host, under, mode, shape, sum(n) AS pool FROM e{k} GROUP BY ALL)",
            f"wh{k} AS (SELECT host, under, mode, sum(pool) AS whole, count(*) - 1 AS free FROM po{k} GROUP BY ALL)",
            f"nd{k} AS MATERIALIZED (SELECT host, under, mode, node, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, any_value(expected) AS expected FROM e{k} GROUP BY ALL)",
            f"""sq{k} AS (SELECT e.host, e.under, e.mode, e.node, sum(e.n * e.n * whole / (nd.n * pool)) AS squares, any_value(free) AS free
              FROM e{k} e JOIN po{k} USING (host, under, mode, shape) JOIN wh{k} USING (host, under, mode) JOIN nd{k} nd USING (host, under, mode, node) GROUP BY ALL)""",
            f"al{k} AS MATERIALIZED (SELECT nd.*, squares - n <= CASE WHEN free > 0 THEN free * pow(1 - {f} + {CHI} * sqrt({f}), 3) ELSE 0 END + 1e-9 AS alike FROM nd{k} nd JOIN sq{k} USING (host, under, mode, node))",
            f"te{k} AS (SELECT host, under, mode, sum(labelled) FILTER (alike AND labelled >= {LEAST}) AS al, sum(blocked) FILTER (alike AND labelled >= {LEAST}) AS ab FROM al{k} GROUP BY ALL)",
            f"""ma{k} AS MATERIALIZED (SELECT x.*, alike AND (labelled < {LEAST} OR abs(blocked / labelled - ab / te.al) <= {Z} * sqrt((ab / te.al) * (1 - ab / te.al) * (1 / labelled + 1 / te.al)) + 1e-12) AS merged
              FROM al{k} x JOIN te{k} te USING (host, under, mode))""",
            f"su{k} AS (SELECT host, under, mode, sum(labelled) AS ml, sum(blocked) AS mb FROM ma{k} WHERE merged GROUP BY ALL)",
            f"""p{k} AS MATERIALIZED (SELECT host, {k} AS level, node, CASE WHEN merged THEN under || '/<' || mode || '>' ELSE node END AS one,
              (CASE WHEN merged THEN mb ELSE blocked END + {A} * expected) / (CASE WHEN merged THEN ml ELSE labelled END + {A}) AS purity FROM ma{k} LEFT JOIN su{k} USING (host, under, mode))""",
        ]
    parts += [
        "pu AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(DEPTH + 1)) + ")",
        f"t AS (SELECT s.host, s.path, purity FROM s{DEPTH} s JOIN pu ON pu.host = s.host AND pu.level = len(s.nodes) AND pu.node = s.template)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, r.host, r.path, rule, CASE WHEN said IS NOT NULL THEN said WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN t ON t.host = r.host AND t.path = r.path"


ORACLE_SQL = _oracle()
