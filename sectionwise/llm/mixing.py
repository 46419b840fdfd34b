"""Mixing sources to target weights over a domain-language-source tree.

1. Tokens (whitespace words over whole texts) are summed per leaf (domain, lang, source).
2. The budget goes down the tree. At each node the children share it in proportion to their
   weights, capped by what their subtree can supply (tokens x ``max_epochs``). What a full child
   leaves over goes to its siblings first; only when all of them are full does the node itself
   take less, which its own siblings then share. The closed form: order siblings by
   capacity/weight, find with prefix sums the longest prefix that is filled, share the rest.
   All in exact integers, so the plan does not depend on partitioning.
3. A leaf with budget b and t tokens gives ``b div t`` whole epochs and a prefix of the next one.
   Epoch e orders documents by md5(seed:e:doc_id). The prefix's end is found exactly without
   sorting a leaf: sums per 3-hex-digit hash bucket locate the one bucket with the end, and only
   that bucket is ordered. The outcome is one row a leaf (whole epochs, last hash), so the
   documents are chosen by a map over the table, without shuffling text.

Defined results: null or empty texts have 0 tokens and are never chosen; a null lang or source is
its own child (weight of ``OTHER``); a null doc_id is hashed as the empty string; repeated rows have
the same hash and are taken or left together; equal ratios of capacity to weight are ordered by name; very long texts are counted whole; an empty table gives an empty result; other columns
pass through ``select_documents`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, durable, fresh, n_words, read

SEED = "mix-7"
BUDGET_PERCENT = 70
MAX_EPOCHS = 2


@dataclass(frozen=True)
class Tree:
    """Sources by domain and the weights of a node among its siblings; what isn't named weighs ``other``. Weights are positive integers."""

    domains: dict[str, list[str]]
    domain_weights: dict[str, int]
    lang_weights: dict[str, int]
    source_weights: dict[str, int] = field(default_factory=dict)
    other: int = 2
    other_source: int = 1


#: The tree of these public tables; production gives its own.
TREE = Tree(
    {"web": [f"src{i}" for i in range(8)], "forum": [f"src{i}" for i in range(8, 14)], "reference": [f"src{i}" for i in range(14, 20)]},
    {"web": 45, "forum": 25, "reference": 28},
    {"en": 55, "de": 15, "fr": 15, "es": 15},
)


def _weight(col: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def domain_of(source: Column, tree: Tree = TREE) -> Column:
    out = F.lit("other")
    for k, v in tree.domains.items():
        out = F.when(source.isin(v), F.lit(k)).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Columns of parent + child, w, cap, b (parent's budget) -> the same with ``b`` the child's."""
    big = "decimal(38,0)"
    c = children.withColumn("r", F.col("cap").cast("double") / F.col("w"))
    tie = ["r"] + [x for x in ("domain", "lang", "source") if x in children.columns]
    w = Window.partitionBy(*parent).orderBy(*tie) if parent else Window.partitionBy(F.lit(0)).orderBy(*tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("long").alias("cap0"), (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("long").alias("w0"))
    left = F.col("b") - F.col("cap0")
    full = (left > 0) & (F.col("cap").cast(big) * F.col("w0").cast(big) <= left.cast(big) * F.col("w").cast(big))
    c = c.withColumn("full", full)
    # filled children form a prefix; the first that is not holds what all later ones share
    stop = F.min(F.when(~F.col("full"), F.struct(*tie, "cap0", "w0"))).over(everything)
    c = c.withColumn("stop", stop)
    exact = F.expr("cast((cast(greatest(b - stop.cap0, 0) as decimal(38,0)) * w) div stop.w0 as bigint)")
    return c.withColumn("b", F.when(F.col("full"), F.col("cap")).otherwise(exact)).drop("r", "cap0", "w0", "full", "stop")


def _tokens(docs: DataFrame, tree: Tree) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), domain_of(F.col("source"), tree).alias("domain"), "lang", "source", n_words(F.col("text")).cast("long").alias("tokens"))


def order_hash(doc: Column, epoch: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), epoch.cast("string"), F.lit(":"), doc))


def leaf_plan(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, budget_tokens: int | None = None, tree: Tree = TREE) -> DataFrame:
    """One row a leaf: domain, lang, source, tokens, budget, epochs (whole ones), cut (last hash of the next epoch's prefix, or null)."""
    stats = durable(_tokens(docs, tree).where("tokens > 0"), "mix-tokens")
    leaves = durable(stats.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("t")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("x"))
    budget = F.lit(budget_tokens).cast("long") if budget_tokens is not None else F.expr(f"cast((cast(x as decimal(38,0)) * {int(budget_percent)}) div 100 as bigint)")
    root = total.select(budget.alias("b"))
    dom = leaves.groupBy("domain").agg((F.sum("t") * max_epochs).alias("cap")).crossJoin(root).withColumn("w", _weight(F.col("domain"), tree.domain_weights, tree.other))
    dom = _share(dom, []).select("domain", "b")
    lang = leaves.groupBy("domain", "lang").agg((F.sum("t") * max_epochs).alias("cap")).join(dom, "domain").withColumn("w", _weight(F.col("lang"), tree.lang_weights, tree.other))
    lang = _share(lang, ["domain"]).select(F.col("domain").alias("d2"), F.col("lang").alias("l2"), "b")
    leaf = leaves.withColumn("cap", F.col("t") * max_epochs).join(lang, F.col("domain").eqNullSafe(F.col("d2")) & F.col("lang").eqNullSafe(F.col("l2"))).drop("d2", "l2").withColumn("w", _weight(F.col("source"), tree.source_weights, tree.other_source))
    leaf = _share(leaf, ["domain", "lang"]).select("domain", "lang", "source", "t", "b", F.expr("b div t").alias("epochs"), F.expr("b % t").alias("rest"))
    leaf = durable(leaf, "mix-budget")
    small = leaf.select(F.col("domain").alias("d_"), F.col("lang").alias("l_"), F.col("source").alias("s_"), "epochs", "rest").where("rest > 0")
    hashed = attach(stats, small, [("domain", "d_"), ("lang", "l_"), ("source", "s_")]).withColumn("h", order_hash(F.col("id"), F.col("epochs"), seed)).withColumn("bucket", F.substring("h", 1, 3))
    sums = hashed.groupBy("domain", "lang", "source", "bucket", "rest").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("domain", "lang", "source").orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(w)).where("upto > rest").groupBy("domain", "lang", "source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "bucket").alias("e"))
    ends = durable(ends.select(F.col("domain").alias("d_"), F.col("lang").alias("l_"), F.col("source").alias("s_"), F.col("e.bucket").alias("end_bucket"), F.col("e.room").alias("room")), "mix-ends")
    edge = attach(hashed, ends, [("domain", "d_"), ("lang", "l_"), ("source", "s_")]).where("bucket = end_bucket").groupBy("domain", "lang", "source", "end_bucket", "room", "h").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("domain", "lang", "source").orderBy("h")
    cuts = edge.withColumn("upto", F.sum("n").over(w)).groupBy("domain", "lang", "source").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("room"), F.col("h"))), F.max("end_bucket")).alias("cut"))
    cuts = cuts.select(F.col("domain").alias("d_"), F.col("lang").alias("l_"), F.col("source").alias("s_"), "cut")
    on = F.col("domain").eqNullSafe(F.col("d_")) & F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_"))
    return durable(leaf.join(cuts, on, "left").select("domain", "lang", "source", F.col("t").alias("tokens"), F.col("b").alias("budget"), "epochs", "cut"), "mix-plan")


def select_documents(docs: DataFrame, epoch_column: str | None = None, plan: DataFrame | None = None, seed: str = SEED, tree: Tree = TREE, **plan_args) -> DataFrame:
    """The chosen rows of ``docs``, one for each epoch in which a row is chosen, with all their columns.

    A leaf's hashes up to its cut are chosen. A cut of three digits (nothing of its bucket fits) sorts before all hashes of that bucket, so buckets before it are.
    """
    plan = leaf_plan(docs, seed=seed, tree=tree, **plan_args) if plan is None else plan
    d, l, s, ep, cut, dom, e = fresh(docs, "__d", "__l", "__s", "__epochs", "__cut", "__domain", epoch_column or "__epoch")
    small = plan.select(F.col("domain").alias(d), F.col("lang").alias(l), F.col("source").alias(s), F.col("epochs").alias(ep), F.col("cut").alias(cut))
    x = docs.withColumn(dom, domain_of(F.col("source"), tree)).where(n_words(F.col("text")) > 0)
    x = attach(x, small, [(dom, d), ("lang", l), ("source", s)])
    h = order_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(ep), seed)
    last = F.when(h <= F.col(cut), F.col(ep)).otherwise(F.col(ep) - 1)
    x = x.withColumn(e, F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))))
    x = x.drop(dom, ep, cut)
    return x if epoch_column else x.drop(e)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = select_documents(docs.select("doc_id", "text", "lang", "source"), "epoch")
    return out.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_words(F.col("text")).cast("long").alias("tokens"), F.col("epoch").cast("long").alias("epoch"))


def _case(col: str, table: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items())} ELSE {TREE.other} END"


def mixing_sql(docs: str = "documents", final: str = "SELECT doc_id, domain, lang, source, tokens, epoch FROM chosen") -> str:
    """DuckDB SQL of the same rows; ``docs`` is any table of documents."""
    doms = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in TREE.domains.items())

    def share(name: str, children: str, keys: list[str]) -> str:
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        order = "CAST(cap AS DOUBLE) / w, " + ", ".join(f"{k} NULLS FIRST" for k in (["domain"], ["domain", "lang"], ["domain", "lang", "source"])[len(keys)])
        return f"""
{name}_a AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) AS rk,
    CAST(coalesce(sum(cap) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap0,
    CAST(sum(w) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w0
  FROM ({children})),
{name}_b AS (SELECT *, (b - cap0 > 0 AND CAST(cap AS HUGEINT) * w0 <= CAST(b - cap0 AS HUGEINT) * w) AS is_full FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT is_full THEN rk END) OVER ({part}) AS stop FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN rk = stop THEN cap0 END) OVER ({part}) AS scap, max(CASE WHEN rk = stop THEN w0 END) OVER ({part}) AS sw FROM {name}_c),
{name} AS (SELECT * EXCLUDE (b), CASE WHEN is_full THEN cap ELSE CAST((CAST(greatest(b - scap, 0) AS HUGEINT) * w) // sw AS BIGINT) END AS b FROM {name}_d)"""

    return f"""
WITH stats AS MATERIALIZED (SELECT *, CASE {doms} ELSE 'other' END AS domain, CAST(len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS BIGINT) AS tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS t FROM stats WHERE tokens > 0 GROUP BY ALL),
root AS (SELECT CAST((CAST(sum(t) AS HUGEINT) * {BUDGET_PERCENT}) // 100 AS BIGINT) AS b FROM leaves),
{share("dom", f"SELECT domain, CAST(sum(t) * {MAX_EPOCHS} AS BIGINT) AS cap, {_case('domain', TREE.domain_weights)} AS w, (SELECT b FROM root) AS b FROM leaves GROUP BY domain", []).strip()},
{share("lan", f"SELECT l.domain, l.lang, l.cap, {_case('l.lang', TREE.lang_weights)} AS w, d.b FROM (SELECT domain, lang, CAST(sum(t) * {MAX_EPOCHS} AS BIGINT) AS cap FROM leaves GROUP BY ALL) l JOIN dom d ON l.domain = d.domain", ["domain"]).strip()},
{share("lea", f"SELECT v.domain, v.lang, v.source, v.t, v.t * {MAX_EPOCHS} AS cap, 1 AS w, n.b FROM leaves v JOIN lan n ON v.domain = n.domain AND v.lang IS NOT DISTINCT FROM n.lang", ["domain", "lang"]).strip()},
plan AS (SELECT domain, lang, source, b // t AS epochs, b % t AS rest FROM lea),
hashed AS (SELECT s.*, p.epochs, p.rest, md5('{SEED}:' || p.epochs || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS h FROM stats s JOIN plan p
  ON s.domain = p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source WHERE s.tokens > 0),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM hashed),
chosen AS (SELECT * EXCLUDE (epoch), CAST(epoch AS BIGINT) AS epoch FROM (SELECT *, unnest(range(CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM summed))
{final}"""
