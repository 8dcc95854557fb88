"""URL verdicts from rules and, where no rule fits, from path templates per host.

DataFrame operations only. Paths become shapes (runs of digits and long hex strings stand for themselves no more),
shapes are counted per host, and a tree grows over the counts, one branching after the other: what all shapes of a node
share is walked at once, and a branch of one shape is done. A segment turns into the wildcard where its node has many
rare children, or where its branch goes on like its siblings taken together (small total variation distance, and
labelled rates that chance can explain). What reaches the leaves are templates.

Rules label the pages that they fit. A template's purity is the share of blocked among its labelled pages, drawn towards
that of the same template in the registered domain, that towards the same template on all hosts, and that towards the
share of all: a host without labels is judged by what is known of such paths elsewhere. The cut, from which a template is
rejected, is where the fewest labelled pages would be judged wrong if their own host's labels were not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values: (action, host, path), as the query's contract gives them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A segment is variable if its node has more children than this and it holds less than this share of them.
CHILDREN, SHARE = 16, 0.05
#: Branches whose next segments differ less than this (plus a margin for small counts) from their siblings' are merged.
DISTANCE = 0.15
#: Pseudo-counts of the smoothing, and steps of purity that a cut can lie between.
PRIOR, STEPS = 3.0, 100
WILD = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or where `://` is missing."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent and whose path starts the url's; else null."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, action = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _shape(path: Column) -> Column:
    """Segments of a path, digits and long hex generalised."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "~"), "[0-9]+", "#")
    return F.split(F.regexp_replace(plain, "^/", ""), "/")


_NODE = ["host", "at"]
_COUNTS = ("n", "labelled", "blocked")


def _walk(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, live): nodes walk what all their shapes share; done are those with one way to go on, or none."""
    ends = materialize(tree.groupBy(*_NODE).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")))
    same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
    shared = F.when(F.col("lo") == F.col("hi"), F.size("lo")).otherwise(F.array_position(same, F.lit(False)) - 1).cast("int")
    walked = tree.join(ends.select(*_NODE, shared.alias("shared"), (F.col("lo") == F.col("hi")).alias("one")), _NODE)
    path = F.concat_ws("/", F.filter(F.concat(F.array("at"), F.slice("rest", F.lit(1), F.col("shared"))), lambda x, k: (k > 0) | (x != "")))
    walked = walked.withColumn("at", F.when(F.col("shared") > 0, path).otherwise(F.col("at"))).withColumn("rest", F.expr("slice(rest, shared + 1, size(rest))"))
    walked = materialize(walked.drop("shared"))
    return walked.where("one").drop("one"), walked.where("not one").drop("one")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, blocked, template) from shapes: host, shape array, n, labelled, blocked."""
    done, live = _walk(shapes.select("host", "shape", *_COUNTS, F.lit("").alias("at"), F.col("shape").alias("rest")))
    while not live.isEmpty():
        tree = live.withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))).withColumn("next", F.coalesce(F.get("rest", F.lit(1)), F.lit("")))
        counts = materialize(tree.groupBy(*_NODE, "seg", "next").agg(*(F.sum(c).alias(c) for c in _COUNTS)))
        branch = counts.groupBy(*_NODE, "seg").agg(*(F.sum(c).alias("b_" + c) for c in _COUNTS))
        # written, so that joins with them deal both sides anew and a node with very many children can be split
        pool = materialize(branch.groupBy(*_NODE).agg(*(F.sum("b_" + c).alias("p_" + c) for c in _COUNTS), F.count("*").alias("children")))
        ahead = materialize(counts.groupBy(*_NODE, "next").agg(F.sum("n").alias("p_next")))
        # distance of a branch's next segments from the node's: half the sum of differences, those it lacks included
        each = counts.join(branch.select(*_NODE, "seg", "b_n"), [*_NODE, "seg"]).join(ahead, [*_NODE, "next"]).join(pool.select(*_NODE, "p_n"), _NODE)
        own, all_ = F.col("n") / F.col("b_n"), F.col("p_next") / F.col("p_n")
        distance = each.groupBy(*_NODE, "seg").agg((0.5 * (F.sum(F.abs(own - all_)) + 1 - F.sum(all_))).alias("distance"))
        seen = branch.join(pool, _NODE).join(distance, [*_NODE, "seg"])
        rate = F.col("p_blocked") / F.greatest("p_labelled", F.lit(1))
        chance = 2 * F.sqrt(rate * (1 - rate) / F.greatest("b_labelled", F.lit(1)))
        # a branch without labels takes its siblings' only where most of their pages have some; a rare one must agree too
        unlike = F.abs(F.col("b_blocked") / F.greatest("b_labelled", F.lit(1)) - rate) > chance
        alike = F.when(F.col("b_labelled") == 0, 2 * F.col("p_labelled") >= F.col("p_n")).otherwise(~unlike)
        rare = (F.col("children") > CHILDREN) & (F.col("b_n") < SHARE * F.col("p_n"))
        merged = (F.col("children") > 1) & (F.col("distance") <= DISTANCE + 1 / F.sqrt(F.col("b_n"))) & alike
        # rare branches with other labels than the rest, and those without any, have wildcards of their own
        kind = F.when(alike, WILD).when(F.col("b_labelled") == 0, WILD + "?").when(F.col("b_blocked") / F.greatest("b_labelled", F.lit(1)) > rate, WILD + "+").otherwise(WILD + "-")
        name = F.when(F.col("seg") == "", F.col("seg")).when(merged, WILD).when(rare, kind).otherwise(F.col("seg"))
        named = materialize(seen.select(*_NODE, "seg", name.alias("name")))
        path = F.when(F.col("at") == "", F.col("name")).otherwise(F.concat("at", F.lit("/"), "name"))
        grown = tree.join(named, [*_NODE, "seg"]).withColumn("at", path).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
        ended, live = _walk(grown.drop("seg", "next", "name"))
        done = done.unionByName(ended)
    return done.drop("rest").withColumnRenamed("at", "template")


def _purities(by: DataFrame) -> DataFrame:
    """(host, template, purity, without): by has host, domain, template, common, b (blocked), l (labelled); without is
    the purity as if the host's own labels were not known.

    Each level is drawn towards the next wider one by PRIOR pseudo-counts.
    """
    wide = by.groupBy("common").agg(F.sum("b").alias("w_b"), F.sum("l").alias("w_l"))
    domain = by.groupBy("domain", "common").agg(F.sum("b").alias("d_b"), F.sum("l").alias("d_l"))
    host = by.groupBy("host", "common").agg(F.sum("b").alias("h_b"), F.sum("l").alias("h_l"))
    total = by.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    share = F.lit((total["b"] + 0.5 * PRIOR) / (total["l"] + PRIOR) if total["l"] else 0.0)
    drawn = lambda b, l, to: (b + PRIOR * to) / (l + PRIOR)
    rows = by.join(materialize(wide), "common").join(materialize(domain), ["domain", "common"]).join(materialize(host), ["host", "common"])
    c = F.col
    known = drawn(c("b"), c("l"), drawn(c("d_b"), c("d_l"), drawn(c("w_b"), c("w_l"), share)))
    others = drawn(c("d_b") - c("h_b"), c("d_l") - c("h_l"), drawn(c("w_b") - c("h_b"), c("w_l") - c("h_l"), share))
    return rows.select("host", "template", "common", "b", "l", known.alias("purity"), others.alias("without"))


def _cut(purities: DataFrame) -> float:
    """The purity from which templates are rejected: fewest labelled pages judged wrong by `without`, in the middle of
    the widest such range; above 1 where nothing is labelled."""
    step = F.least(F.floor(F.col("without") * STEPS), F.lit(STEPS - 1)).cast("int")
    rows = purities.where("l > 0").groupBy(step.alias("k")).agg(F.sum("b").alias("b"), F.sum("l").alias("l")).collect()  # at most STEPS rows
    if not rows:
        return 2.0
    blocked, allowed = [0] * STEPS, [0] * STEPS
    for r in rows:
        blocked[r["k"]], allowed[r["k"]] = r["b"], r["l"] - r["b"]
    wrong = [sum(blocked[:k]) + sum(allowed[k:]) for k in range(STEPS + 1)]
    best, runs = min(wrong), []
    for k in range(1, STEPS + 1):  # a cut of 0 would reject what nothing speaks against
        if wrong[k] == best and runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        elif wrong[k] == best:
            runs.append([k, k])
    lo, hi = max(runs, key=lambda r: (r[1] - r[0], r[0])) if runs else (STEPS, STEPS)
    return (lo + hi) / 2 / STEPS


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and template and purity where the method decided.

    Null urls and urls without `://` have empty host and path, no rule, and the template of the empty host; very long
    paths are walked whole. An empty table gives no rows; without labelled pages nothing is rejected. Repeated rows are
    judged each; further columns of any name are not looked at.
    """
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action).withColumn("shape", _shape(F.col("path")))
    rows = materialize(rows)
    labelled = F.col("action").isNotNull().cast("long")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.sum((F.col("action") == "block").cast("long")).alias("blocked"))
    shapes = materialize(shapes.fillna(0, ["blocked"]))
    # the same tree over all hosts together, grown beside the hosts' own, gives the templates that hosts share
    pooled = shapes.groupBy("shape").agg(*(F.sum(c).alias(c) for c in _COUNTS)).select(F.lit("all").alias("host"), "shape", *_COUNTS)
    grown = templates(shapes.withColumn("host", F.concat(F.lit("="), "host")).unionByName(pooled))
    common = grown.where("host = 'all'").select("shape", F.col("template").alias("common"))
    tree = grown.where("host != 'all'").withColumn("host", F.expr("substring(host, 2)"))
    tree = materialize(tree.join(common, "shape"))
    domain = F.array_join(F.slice(F.concat(F.array(F.lit("")), F.split("host", r"\.")), F.lit(-2), F.lit(2)), ".")
    by = materialize(tree.groupBy("host", domain.alias("domain"), "template", "common").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")))
    purities = materialize(_purities(by))
    cut = _cut(purities)
    known = materialize(tree.select("host", "shape", "template", "common").join(purities.drop("b", "l"), ["host", "template", "common"]))
    out = rows.join(known, ["host", "shape"])
    verdict = F.coalesce("action", F.when(F.col("purity") >= cut, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
