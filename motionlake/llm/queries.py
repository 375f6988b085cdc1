"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe_count import token_counts
from .chat import conversation_digests, format_turns
from .collocations import collocations
from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_text import main_texts
from .jaccard_join import jaccard_components
from .mixing import mix
from .periodic_runs import periodic_runs
from .secrets import secret_report
from .toxicity import ToxicityModel, drop_toxic, learn_from, score_texts
from .window_dedup import repeated_windows

TOKEN_LIMIT = 4096


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chat_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The production mix: half of all tokens, at most two epochs of a leaf.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 1
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}
LANG_WEIGHTS = {"en": 6, "fr": 2, "de": 2, "es": 1}


def _weights(spark: SparkSession, key: str, weights: dict[str, int]) -> DataFrame:
    rows = ", ".join(f"('{k}', {w})" for k, w in weights.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({key}, weight)")


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    domain = F.concat(F.lit("domain"), F.coalesce(number % 4, F.lit(0)).cast("string"))
    weights = {"domain": _weights(spark, "domain", DOMAIN_WEIGHTS), "lang": _weights(spark, "lang", LANG_WEIGHTS)}
    return mix(docs, domain, MIX_SHARE, MIX_EPOCHS, MIX_SEED, weights)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    path = chat_tokenizer()
    return conversation_digests(format_turns(told.unionByName(extra), path), path)


LEAST_SCORE = 0.7


def predicted(scores: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted")
    )


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """Learned from the labelled rows outside the held-out third."""
    return learn_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", remainder(3) != 1)


def not_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    return drop_toxic(docs, model, LEAST_SCORE)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn_from(docs, table(spark, sf_dir, "labels"), "quality", remainder(4) != 2)
    return predicted(quality.score_texts(docs, model), remainder(4) == 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(score_texts(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir)), remainder(3) == 1)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), piece_model())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), with_tails=True)


def op13_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_source_mixing": op2_source_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_text": op8_html_text,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_window_dedup": op13_window_dedup,
}



def _fill_sql(name: str, parent: list[str], key: str, nodes: str) -> str:
    """One level of the budget tree, as in mixing.fill."""
    over = f"PARTITION BY {', '.join(parent)}" if parent else ""
    and_full = f"PARTITION BY {', '.join([*parent, 'is_full'])}"
    order = f"ORDER BY cap / weight, {key} NULLS FIRST"
    return f"""
        {name}_a AS (
            SELECT *, greatest(amount - coalesce(sum(cap) OVER ({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS pot,
                   sum(weight) OVER ({over} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
            FROM ({nodes}) WHERE weight > 0),
        {name}_b AS (SELECT *, pot::HUGEINT * weight >= cap::HUGEINT * among AS is_full FROM {name}_a),
        {name} AS (
            SELECT * EXCLUDE (pot, among),
                   CASE WHEN is_full THEN cap ELSE (first_value(pot) OVER w)::HUGEINT * weight // first_value(among) OVER w END AS given
            FROM {name}_b WINDOW w AS ({and_full} {order}))"""


def _mix_sql(docs: str) -> str:
    case = lambda key, ws: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in ws.items()) + " ELSE 1 END"
    caps = lambda keys: f"SELECT {', '.join(keys)}, sum(tokens)::BIGINT * {MIX_EPOCHS} AS cap FROM leaves GROUP BY ALL"
    below = lambda keys, up, on: (
        f"SELECT n.*, u.given AS amount FROM ({caps(keys)}) n JOIN {up} u ON "
        + " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in on)
    )
    return f"""
        WITH docs AS ({docs}),
        rows_ AS (
            SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4, 0) AS domain, lang, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS n_tokens
            FROM docs),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
        {_fill_sql("by_domain", [], "domain", f"SELECT *, {case('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT floor(sum(tokens) * {MIX_SHARE})::BIGINT FROM leaves) AS amount FROM ({caps(['domain'])})")},
        {_fill_sql("by_lang", ["domain"], "lang", f"SELECT *, {case('lang', LANG_WEIGHTS)} AS weight FROM ({below(['domain', 'lang'], 'by_domain', ['domain'])})")},
        {_fill_sql("by_source", ["domain", "lang"], "source", f"SELECT *, 1 AS weight FROM ({below(['domain', 'lang', 'source'], 'by_lang', ['domain', 'lang'])})")},
        plan AS (
            SELECT domain, lang, source, CASE WHEN cap > 0 THEN given // (cap // {MIX_EPOCHS}) ELSE 0 END AS epochs,
                   CASE WHEN cap > 0 THEN given % (cap // {MIX_EPOCHS}) ELSE 0 END AS rest
            FROM by_source),
        placed AS (
            SELECT r.*, p.epochs, p.rest, sum(r.n_tokens) OVER (
                       PARTITION BY r.domain, r.lang, r.source ORDER BY md5('{MIX_SEED}:' || p.epochs || ':' || coalesce(r.doc_id::VARCHAR, '')), r.n_tokens
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM rows_ r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang
                 AND r.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, domain, lang, source, n_tokens, (epochs + (upto <= rest)::INT)::BIGINT AS copies
        FROM placed WHERE epochs + (upto <= rest)::INT > 0"""


_COLLOCATIONS_SQL = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS (
        SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) t(m) WHERE len(w) >= m)),
    f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY ALL),
    cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
    cuts AS (
        SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS part1, array_to_string(w[k + 1:], ' ') AS part2
        FROM cand c, (VALUES (1), (2), (3)) t(k) WHERE k < c.m),
    cut_scores AS (
        SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, (u.a::HUGEINT * 2000000 // (x.f + y.f))::BIGINT AS score
        FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.part1 JOIN f y ON y.lang = u.lang AND y.phrase = u.part2),
    worst AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (
        SELECT lang, array_to_string(w[i:i + short - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(range(1, m - short + 2)) AS i FROM cand, (VALUES (2), (3)) t(short) WHERE short < m) GROUP BY ALL)
    SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, t.n, w.score
    FROM worst w JOIN totals t ON t.lang = w.lang LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a
    QUALIFY rank <= 2000"""

ORACLE_SQL = {
    "op11_collocations": _COLLOCATIONS_SQL,
    "op2_source_mixing": _mix_sql("SELECT * FROM documents"),
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
}
