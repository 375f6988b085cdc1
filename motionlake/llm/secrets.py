"""Secret scans with multipart credential linking. DataFrame operations only.

Base spans, leftmost and non-overlapping per kind: ``assign``, ``access`` and
``hex``. A pattern's spans come from splitting the text at its matches: the gaps
and the matches, laid end to end, give every offset in code points. Texts are read once,
into a table of the lengths of gaps and matches; running sums over its rows give the offsets,
so a text with very many matches costs what they come to and no more.

Linking adds spans of weak kinds. A ``secret`` (40 characters of base64 without
padding, also directly after a name and ``=``) or an
``endpoint`` (a URL or a host with a port) means nothing alone; one is reported
only where its scope holds the complementary part: an access identifier within
``scope`` code points for a secret, an access identifier or an assignment for an
endpoint. The interval join meets on (document, bucket) where a bucket is as wide
as a scope: any part in the same bucket is near enough, and of the buckets beside
it only the last or first part can be the nearest. So a bucket is folded into its
least and greatest offset before the join, and no pairs are ever listed.

Defined cases: a null text counts as empty; without spans the counts are 0 and
the strings empty; a null doc_id is a key like any other; rows that repeat
doc_id and text each get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut

# The base patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of AKIA[A-Z0-9]+ those with 20 characters or more
HEX = r"[0-9a-f]{24,}"  # of the runs [0-9a-f]+ those with 24 characters or more
SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/?&=%+-]*)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])"

KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 400


def laid_out(text: Column, kind: str, pattern: str, least: int | None = None) -> Column:
    """Array of (k, i, g, m, ok): the kind's place, the match's number, the lengths of the gap before it and its own."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    ok = lambda x: F.lit(True)
    if least is not None:
        parts = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("held"))
        ok = lambda x: F.length(x["held"]) >= least
    whole = F.filter(parts, lambda x: x["hit"].isNotNull())  # the gap after the last match has none
    row = lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.length(x["gap"]).alias("g"), F.length(x["hit"]).alias("m"), ok(x).alias("ok"))
    none = F.array().cast("array<struct<k:int,i:int,g:int,m:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.transform(whole, row)).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(
        F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    )
    return F.array_join(shown, ",")


def _near(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The rows of weak with a part of the same document no more than scope away."""
    bucket = lambda at: F.floor(at / F.lit(scope)).cast("long")
    folded = parts.withColumn("b", bucket(F.col("s"))).groupBy("rid", "b").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    beside = folded.select("rid", "lo", "hi", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    bounds = beside.groupBy("rid", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("around"))  # three at most
    met = weak.withColumn("b", bucket(F.col("s"))).join(bounds, ["rid", "b"])
    gap = lambda x: F.least(F.abs(F.col("s") - x["lo"]), F.abs(F.col("s") - x["hi"]))
    inside = lambda x: (x["lo"] <= F.col("s")) & (F.col("s") <= x["hi"]) & (bucket(x["lo"]) == F.col("b"))
    return met.where(F.exists("around", lambda x: (gap(x) <= scope) | inside(x))).select("rid", "s", "k", "e")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, base and linked, arrays of (s, k, e) with k the place in KINDS."""
    tables = Tables(docs.sparkSession)
    t = F.col("t")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    patterns = (("assign", ASSIGN, ASSIGN_LEAST), ("access", ACCESS), ("hex", HEX), ("secret", SECRET), ("endpoint", ENDPOINT))
    seen = tables.cut(rows.select("id", "rid", F.concat(*[laid_out(t, *p) for p in patterns]).alias("found")))
    upto = F.sum(F.col("g") + F.col("m")).over(Window.partitionBy("rid", "k").orderBy("i"))
    spans = seen.select("rid", F.inline("found")).withColumn("e", upto.cast("int")).where("ok")
    spans = tables.cut(spans.select("rid", (F.col("e") - F.col("m")).alias("s"), "k", "e"))
    of = lambda kind: F.col("k") == KINDS.index(kind)
    linked = _near(spans.where(of("secret")), spans.where(of("access")), scope)
    linked = linked.unionByName(_near(spans.where(of("endpoint")), spans.where(of("access") | of("assign")), scope))
    base = spans.where(F.col("k") <= KINDS.index("hex"))
    kept = base.withColumn("base", F.lit(True)).unionByName(linked.withColumn("base", F.lit(False)))
    listed = lambda own: F.collect_list(F.when(own, F.struct("s", "k", "e")))
    per_row = kept.groupBy("rid").agg(listed(F.col("base")).alias("base"), listed(~F.col("base")).alias("linked"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    met = seen.select("id", "rid").join(per_row, "rid", "left")
    out = cut(met.select(F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked")))
    tables.close()
    return out


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Counts and the two digests of secret_spans()."""
    of = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    return secret_spans(docs, id_col, text_col, scope).select(
        id_col,
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
    )
