"""URL filters: host and path rules, and a tree of path templates judged by labels.

All DataFrame operations.  Segments of a path whose form is variable (numbers, hexadecimal
ids, long slugs) become typed wildcards, so a host's paths fall into few forms; labels
are counted per form.  The forms of a host are a tree:

* children of a node that are many and rare each become one wildcard;
* children whose rate of bad labels does not differ from that of their siblings
  together (a binomial test) are merged into the wildcard as well;

and what is below merged nodes is one subtree: the tree is merged level by level, and the counts of a level are
added up under the merged level above before its own children are compared.  What remains is the template of a
form.  A template is rejected if its rate of bad labels,
smoothed by its host's rate, which the corpus's rate smooths, reaches the threshold.

Counts combine in the map tasks; nodes, forms and templates are joined by their keys, never
gathered per host, so a host with a third of all pages is no larger group than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: (rule, verdict); a rule is a host, which its subdomains share, and the start of a path.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
#: Default of ``max_depth``: segments beyond this number are one variable segment, so that a tree has so many levels.
MAX_DEPTH = 12
#: A node may have this many children before those with a smaller share than RARE become a wildcard.
CHILDREN, RARE = 16, 0.05
#: Standard deviations within which siblings count as alike.
ALIKE = 2.6
#: Labels that a prior weighs, and the smoothed rate of bad labels that rejects a template.
PRIOR, BAD_RATE = 8.0, 0.5
ANY = "*"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.  Of equally long ones block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def form(path: Column, max_depth: int = MAX_DEPTH) -> Column:
    """The path's segments, variable ones by their type, joined by slashes; those beyond ``max_depth`` as one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def typed(s: Column) -> Column:
        hexes = s.rlike("^[0-9a-fA-F]{8,}$") | s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
        slug = (F.length(s) > 32) | (F.size(F.split(s, "-")) > 4)
        return F.when(hexes, "<hex>").when(slug, "<slug>").otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))

    deep = F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("<deep>")))).otherwise(parts)
    return F.array_join(F.transform(deep, typed), "/")


def _sums(*by: str):
    return lambda df: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _merged(nodes: DataFrame) -> DataFrame:
    """(host, template, seg, name) of one level's nodes (with n, labelled, bad): what each child of ``template`` is called."""
    on = ["host", "template"]
    parents = nodes.groupBy(*on).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n").alias("p_n"), F.sum("labelled").alias("p_labelled"), F.sum("bad").alias("p_bad")
    )
    nodes = nodes.join(parents, on)
    many = (F.col("children") > CHILDREN) & (F.col("n") < F.col("p_n") * RARE)
    nodes = nodes.withColumn("branch", F.when(many, ANY).otherwise(F.col("seg")))
    branches = nodes.groupBy(*on, "branch").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max("p_labelled").alias("p_labelled"), F.max("p_bad").alias("p_bad")
    )
    rate = F.coalesce(F.col("p_bad") / F.nullif(F.col("p_labelled"), F.lit(0)), F.lit(0.0))
    expected = F.col("labelled") * rate
    alike = F.abs(F.col("bad") - expected) <= F.sqrt(expected * (1 - rate)) * ALIKE + 0.5
    branches = branches.select(*on, "branch", F.when(alike, ANY).otherwise(F.col("branch")).alias("name"))
    return nodes.select(*on, "seg", "branch").join(branches, [*on, "branch"]).select(*on, "seg", "name")


def templates(forms: DataFrame) -> DataFrame:
    """(host, form, template) of stored forms with n, labelled and bad.

    A round per level: ``template`` holds the merged names of the levels above, so the level's counts are those
    of the merged tree.
    """
    now = forms.select("host", "form", "n", "labelled", "bad", F.split("form", "/").alias("parts"), F.lit("").alias("template"))
    depth = now.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        seg = F.get("parts", F.lit(level))
        nodes = _sums("host", "template", "seg")(now.select("host", "template", seg.alias("seg"), "n", "labelled", "bad").filter("seg IS NOT NULL"))
        names = _merged(stored(nodes, "urls-nodes")).select(
            F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), "name"
        )
        here = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (seg == F.col("_s"))
        longer = F.col("name") if not level else F.concat("template", F.lit("/"), "name")
        now = now.join(names, here, "left").withColumn("template", F.coalesce(longer, F.col("template")))
        now = stored(now.drop("_h", "_t", "_s", "name"), "urls-level")
    return now.select("host", "form", "template")


def judged_forms(forms: DataFrame) -> DataFrame:
    """(host, form, template, rate, blocked) of stored forms with n, labelled and bad."""
    whole = forms.agg(F.sum("labelled"), F.sum("bad")).first()
    corpus = (whole[1] or 0) / max(whole[0] or 0, 1)
    named = stored(forms.join(templates(forms), ["host", "form"]), "urls-templates")
    hosts = named.groupBy("host").agg(((F.sum("bad") + PRIOR * corpus) / (F.sum("labelled") + PRIOR)).alias("host_rate"))
    by = named.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad")).join(hosts, "host")
    rate = (F.col("t_bad") + F.col("host_rate") * PRIOR) / (F.col("t_labelled") + PRIOR)
    by = by.select("host", "template", rate.alias("rate"), (rate >= BAD_RATE).alias("blocked"))
    return named.select("host", "form", "template").join(by, ["host", "template"])


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url: str = "url",
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """id, host, path, rule, verdict, template and rate of every row.

    ``labels``: id (as in ``pages``) and bad (0 or 1); null ids or marks are no labels, of
    several marks of an id the worst holds.  Null urls and urls without ``://`` have empty host
    and path and are allowed unless a rule fits; repeated rows are judged each.  Paths that differ only
    beyond ``max_depth`` segments are judged together.
    """
    host, path = host_path(F.col(url))
    named = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    named = stored(named.withColumn("form", form(F.col("path"), max_depth)), "urls-pages")
    marks = labels.select(F.col("id").alias("_m"), F.col("bad")).filter("_m IS NOT NULL AND bad IS NOT NULL")
    marks = marks.groupBy("_m").agg(F.max("bad").cast("long").alias("bad"))
    counted = named.join(marks, F.col("_id") == F.col("_m"), "left").groupBy("host", "form").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    found = stored(judged_forms(stored(counted, "urls-forms")), "urls-judged")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked") & (F.col("host") != ""), "block").otherwise("allow")
    out = named.join(found, ["host", "form"], "left")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "rate"
    )
