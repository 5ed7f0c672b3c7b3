"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a domain - language - source tree. At each level the
children of a parent share its budget by weight, none beyond what its subtree
can give (its tokens times the epochs allowed); what one cannot use goes to its
siblings by weight, and only what all siblings together cannot use is left to
the parent's own siblings. That is water-filling; with siblings sorted by
capacity per weight it is a closed form over running sums, all in integers.

A leaf takes whole epochs of its documents, then the longest prefix of one more
epoch that fits; each epoch has its own seeded order. The prefix's end is found
over hash-range buckets of about BUCKET documents (running sums over bucket
totals, then inside the one bucket where the budget ends), so no leaf is sorted
in one task, and texts are never shuffled.

Defined results: a null lang or source is the leaf value 'none'; null texts
have no tokens; a row without doc_id counts as id 'null'; repeated rows (same
doc_id) have equal places in the order and are taken together; leaves of weight
0 get nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopia.llm.common import SPACES, cut, table

LEVELS = ("domain", "lang", "source")
BUCKET = 512
#: Leaves up to which their table may be broadcast: about 100 bytes each.
MOST_BROADCAST = 50_000
#: Production parameters of the query and the stage.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
EPOCHS, SEED, PERCENT = 3, "mix", 60


def default_domain(source: Column) -> Column:
    """The documents have no domain: sources are dealt to three by their number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.try_cast("long") % 3).cast("string"))).otherwise("none")


def n_tokens(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, "[ \t\n\x0b\x0c\r]+")).cast("long")).otherwise(F.lit(0).cast("long"))


def leaf_columns(docs: DataFrame, domain: Column | None) -> list[Column]:
    own = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    return [F.coalesce(domain if domain is not None else default_domain(own), F.lit("none")).alias("_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("_lang"), own.alias("_source")]


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level, {})
    named = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)]) if known else None
    return (F.coalesce(F.element_at(named, F.col(f"_{level}")), F.lit(1)) if known else F.lit(1)).cast("long")


def share(children: DataFrame, parents: list[str], name: str, budget: str = "budget") -> DataFrame:
    """children (parents, name, weight, cap, budget of the parent) with `alloc` added."""
    of = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    able = children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(0.0))
    order = of.orderBy("ratio", name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    full = able.withColumn("full", F.col("cap") * weight_left <= F.col("weight") * (F.col(budget) - before))
    spent = full.withColumn("left", F.col(budget) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(of)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(of))
    floor = spent.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("weight * left div nullif(open, 0)")))
    rest = floor.withColumn("rest", F.col("left") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("alloc"))).over(of))
    rank = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(of.orderBy(name).rowsBetween(W.unboundedPreceding, 0))
    given = rest.withColumn("alloc", F.col("alloc") + F.when(~F.col("full") & (rank <= F.col("rest")), 1).otherwise(0))
    return given.drop("ratio", "full", "left", "open", "rest")


def allocate(leaves: DataFrame, weights: dict, epochs: int, budget: Column) -> DataFrame:
    """leaves (_domain, _lang, _source, tokens, n_docs) with `alloc`; budget is an expression over `total`, the sum of tokens."""
    caps = leaves.withColumn("cap", F.when(_weight("domain", weights) * _weight("lang", weights) * _weight("source", weights) > 0, F.col("tokens") * epochs).otherwise(0))
    langs = caps.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("total"))
    domains = langs.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("total").alias("total"))
    whole = W.partitionBy(F.lit(0))
    top = domains.withColumn("total", F.sum("total").over(whole)).withColumn("weight", _weight("domain", weights)).withColumn("budget", F.least(budget, F.sum("cap").over(whole)))
    top = share(top, [], "_domain").select("_domain", F.col("alloc").alias("budget"))
    middle = share(langs.drop("total").withColumn("weight", _weight("lang", weights)).join(top, "_domain"), ["_domain"], "_lang").select("_domain", "_lang", F.col("alloc").alias("budget"))
    return share(caps.withColumn("weight", _weight("source", weights)).join(middle, ["_domain", "_lang"]), ["_domain", "_lang"], "_source").drop("cap", "weight", "budget")


def _place(seed: str) -> Column:
    """A document's place in the order of the leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _bucket() -> Column:
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    return F.floor(number * F.greatest(F.lit(1), F.floor(F.col("n_docs") / BUCKET)) / F.lit(1 << 32)).cast("long")


def _join(rows: DataFrame, leaves: DataFrame, few: bool, *more: str) -> DataFrame:
    return rows.join(F.broadcast(leaves) if few else leaves, ["_domain", "_lang", "_source", *more])


def plan(docs: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT, seed: str = SEED, domain: Column | None = None) -> tuple[DataFrame, bool, DataFrame]:
    """Per leaf its whole epochs and where the prefix ends; whether that table may be broadcast; and (doc_id, leaf, tokens) of all rows."""
    narrow = cut(docs.select("doc_id", *leaf_columns(docs, domain), n_tokens(F.col("text")).alias("tokens")))
    leaves = narrow.groupBy("_domain", "_lang", "_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    budget = F.expr(f"total * {int(percent)} div 100")
    allotted = allocate(leaves, weights, epochs, budget)
    whole = F.when(F.col("tokens") > 0, F.expr("alloc div nullif(tokens, 0)")).otherwise(0)
    ends = cut(allotted.withColumn("whole", whole).withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens")).withColumnRenamed("tokens", "leaf_tokens"))
    few = ends.count() <= MOST_BROADCAST
    placed = _join(narrow, ends, few).withColumn("place", _place(seed)).withColumn("bucket", _bucket())
    sums = placed.groupBy("_domain", "_lang", "_source", "bucket").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    running = sums.withColumn("upto", F.sum("sum").over(W.partitionBy("_domain", "_lang", "_source").orderBy("bucket")))
    edge = cut(running.where("upto > rest AND upto - sum <= rest").select("_domain", "_lang", "_source", "bucket", (F.col("rest") - F.col("upto") + F.col("sum")).alias("room")))
    inside = _join(placed, edge, few, "bucket").withColumn("upto", F.sum("tokens").over(W.partitionBy("_domain", "_lang", "_source", "bucket").orderBy("place")))
    last = inside.where("upto <= room").groupBy("_domain", "_lang", "_source").agg(F.max("place").alias("last"))
    tips = edge.select("_domain", "_lang", "_source", F.col("bucket").alias("edge")).join(last, ["_domain", "_lang", "_source"], "left")
    ends = cut(ends.join(tips, ["_domain", "_lang", "_source"], "left"))
    return ends, few, narrow


def copies(rows: DataFrame, ends: DataFrame, few: bool, seed: str = SEED) -> DataFrame:
    """rows with `epochs`, how often each is taken, and without those never taken; rows has doc_id and the leaf columns."""
    placed = _join(rows, ends, few).withColumn("place", _place(seed)).withColumn("bucket", _bucket())
    # no edge: the prefix is the whole leaf only if nothing is left to take, as a whole epoch would have been counted
    taken = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("place") <= F.col("last")))
    return placed.withColumn("epochs", F.col("whole") + F.when(taken, 1).otherwise(0)).where("epochs > 0")


def mix(docs: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT, seed: str = SEED, domain: Column | None = None) -> DataFrame:
    """The rows of docs that are taken, with `epochs`; docs has doc_id, text, lang and source."""
    names = [c for c in docs.columns if c != "epochs"]
    ends, few, _ = plan(docs, weights, epochs, percent, seed, domain)
    tips = ends.select("_domain", "_lang", "_source", "n_docs", "whole", "edge", "last")
    body = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = docs.select("doc_id", body, *leaf_columns(docs, domain))
    return copies(rows, tips, few, seed).select("_row.*", "epochs")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the documents of the mix, with leaf, tokens and epochs."""
    ends, few, narrow = plan(table(spark, sf_dir, "documents"))
    found = copies(narrow, ends.select("_domain", "_lang", "_source", "n_docs", "whole", "edge", "last"), few)
    return found.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("tokens").alias("n_tokens"), "epochs")


def _shared(name: str, children: str, parents: str) -> str:
    """SQL for `share`: the CTEs that give each child its alloc."""
    of = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_f AS (SELECT *, cap * sum(weight) OVER ({of} ORDER BY ratio, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(cap) OVER ({of} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS saturated
  FROM (SELECT *, cap / weight AS ratio FROM ({children}))),
{name}_s AS (SELECT *, budget - sum(CASE WHEN saturated THEN cap ELSE 0 END) OVER ({of}) AS remaining,
    sum(CASE WHEN saturated THEN 0 ELSE weight END) OVER ({of}) AS opened FROM {name}_f),
{name}_a AS (SELECT *, CASE WHEN saturated THEN cap ELSE weight * remaining // nullif(opened, 0) END AS base FROM {name}_s),
{name} AS (SELECT *, CAST(base + CASE WHEN NOT saturated AND sum(CASE WHEN saturated THEN 0 ELSE 1 END) OVER ({of} ORDER BY name ROWS UNBOUNDED PRECEDING)
    <= remaining - sum(CASE WHEN saturated THEN 0 ELSE base END) OVER ({of}) THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM {name}_a)"""


def _cases(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


#: The query in DuckDB, with plain running sums over each leaf.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 3 AS VARCHAR) ELSE 'none' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) * {EPOCHS} AS cap FROM d GROUP BY ALL),
l AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL),
top AS (SELECT least((SELECT CAST(sum(tokens) AS BIGINT) FROM leaf) * {PERCENT} // 100, (SELECT CAST(sum(cap) AS BIGINT) FROM leaf)) AS budget),
{_shared("x", f"SELECT domain AS name, CAST(sum(cap) AS BIGINT) AS cap, {_cases('domain')} AS weight, any_value(budget) AS budget FROM l, top GROUP BY domain", "")},
{_shared("y", f"SELECT l.domain, lang AS name, l.cap, {_cases('lang')} AS weight, x.alloc AS budget FROM l JOIN x ON l.domain = x.name", "domain")},
{_shared("z", f"SELECT leaf.domain, lang, source AS name, leaf.cap, tokens, {_cases('source')} AS weight, y.alloc AS budget FROM leaf JOIN y ON leaf.domain = y.domain AND leaf.lang = y.name", "domain, lang")},
e AS (SELECT domain, lang, name AS source, alloc // nullif(tokens, 0) AS whole, alloc - coalesce(alloc // nullif(tokens, 0), 0) * tokens AS rest FROM z),
p AS (SELECT d.*, coalesce(whole, 0) AS whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || coalesce(whole, 0) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS upto
  FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM p WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""
