"""Mixing sources to target weights. DataFrame operations only.

Hierarchical budgeting: a token budget flows down a tree of domain, language and
source. At each node the amount is shared out by the children's weights, none
over its capacity; what a child cannot take goes to its siblings first and only
what all of them cannot take goes back up, to the siblings of their parent. As a
node's capacity is the sum of its leaves', one pass from the top settles this:
children in order of capacity / weight are filled while their share exceeds
their capacity, and the rest share what is left. All amounts are whole tokens.

Each leaf takes full epochs of its rows and then a prefix of the next one, in
the order of md5(seed:epoch:id). The prefix is found without sorting a leaf in
one task: rows fall into ``buckets`` ranges of the digest, the running sum over
the buckets of a leaf says where each begins, and only rows of the same bucket
are sorted together. The prefix is one of whole rows: the row that crosses the budget
is left out, so each leaf falls short by less than that row's tokens, which its siblings
do not get; a leaf whose first row is longer than its rest takes full epochs only (none
if its budget is below one epoch). The tables of leaves and buckets are small; no broadcast is
forced on them.

Defined cases: null texts and texts without words have 0 tokens and are taken
only in full epochs or within a prefix that is not yet full; null domain,
language, source or id are keys like any other; repeated rows count each;
missing weights are 1; a weight of 0 gives nothing; an empty table gives an
empty result; a budget above all capacities takes everything max_epochs times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKET_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")


def fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes: parent columns, key, cap, weight, amount (of the parent). Adds given, the node's part."""
    over = [*parent, "whole"]
    order = [(F.col("cap") / F.col("weight")).asc(), F.col(key).asc_nulls_first()]
    by = Window.partitionBy(*over).orderBy(*order)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = nodes.where("weight > 0").withColumn("whole", F.lit(0))
    rows = rows.withColumn("pot", F.greatest(F.col("amount") - before, F.lit(0))).withColumn("among", onward)
    full = F.expr("cast(pot as decimal(19,0)) * cast(weight as decimal(12,0)) >= cast(cap as decimal(19,0)) * cast(among as decimal(12,0))")
    rows = rows.withColumn("full", full)
    # the first that is not full has before it what is left for all of these
    rest = Window.partitionBy(*over, "full").orderBy(*order)
    rows = rows.withColumn("pot", F.first("pot").over(rest)).withColumn("among", F.first("among").over(rest))
    part = F.expr("(cast(pot as decimal(19,0)) * cast(weight as decimal(12,0))) div among")
    given = F.when(F.col("full"), F.col("cap")).otherwise(part)
    return rows.withColumn("given", given.cast("long")).drop("whole", "pot", "among", "full")


def _weighted(nodes: DataFrame, key: str, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return nodes.withColumn("weight", F.lit(1).cast("long"))
    w = weights.select(F.col(key).alias("__key"), F.col("weight").cast("long").alias("weight"))
    met = nodes.join(w, nodes[key].eqNullSafe(F.col("__key")), "left").drop("__key")
    return met.withColumn("weight", F.coalesce("weight", F.lit(1)))


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, DataFrame]) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds given: the leaf's tokens under a budget of share of all tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = caps.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("amount"))
    path: list[str] = []
    above = None
    for key in LEVELS:
        nodes = caps.groupBy(*path, key).agg(F.sum("cap").cast("long").alias("cap"))
        if above is None:
            nodes = nodes.crossJoin(F.broadcast(total))  # one row
        else:
            a = above.select(*[F.col(c).alias(f"__{c}") for c in path], F.col("given").alias("amount"))
            on = [nodes[c].eqNullSafe(a[f"__{c}"]) for c in path]
            nodes = nodes.join(a, on).drop(*[f"__{c}" for c in path])
        above = fill(_weighted(nodes, key, weights.get(key)), path, key).select(*path, key, "cap", "given")
        path.append(key)
    return above


def mix(
    docs: DataFrame,
    domain: Column,
    share: float,
    max_epochs: int = 2,
    seed: int = 1,
    weights: dict[str, DataFrame] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Rows taken at least once: id, domain, lang, source, n_tokens, copies."""
    rows = cut(
        docs.select(
            docs[id_col].alias("id"),
            domain.alias("domain"),
            docs[lang_col].alias("lang"),
            docs[source_col].alias("source"),
            word_count(F.coalesce(docs[text_col], F.lit(""))).alias("n_tokens"),
        )
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    given = leaf_budgets(leaves, share, max_epochs, weights or {}).withColumn("tokens", F.expr(f"cap div {max_epochs}"))
    plan = given.select(
        *[F.col(c).alias(f"p_{c}") for c in LEVELS],
        F.expr("if(tokens > 0, given div tokens, 0)").alias("epochs"),
        F.expr("if(tokens > 0, given % tokens, 0)").alias("rest"),
    )
    on = lambda side: [F.col(c).eqNullSafe(F.col(f"{side}_{c}")) for c in LEVELS]
    key = F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    ordered = rows.join(plan, on("p")).drop(*[f"p_{c}" for c in LEVELS]).withColumn("digest", F.md5(key))
    ordered = ordered.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(c).alias(f"b_{c}") for c in LEVELS],
        F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
    )
    placed = ordered.join(starts, [*on("b"), F.col("bucket") == F.col("b_bucket")])
    upto = Window.partitionBy(*LEVELS, "bucket").orderBy("digest", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.sum("n_tokens").over(upto)
    copies = F.col("epochs") + F.when(end <= F.col("rest"), 1).otherwise(0)
    taken = placed.withColumn("copies", copies.cast("long")).where("copies > 0")
    return taken.select(
        F.col("id").alias(id_col), "domain", F.col("lang").alias(lang_col), F.col("source").alias(source_col), "n_tokens", "copies"
    )
