"""Queries by name over the test tables, and the SQL that says the same; each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.functions.formats import format_items
from loamworks.functions.verdicts import BLOCKED, ContentFilter, LanguageFilter, LengthFilter, QASpecificFilter, RepetitionFilter, TokenLengthFilter
from loamworks.operators import analytics, augmentation, chunking, cost, extraction, jobs, lineage, parallel, quality
from loamworks.operators.dataset import Dataset
from loamworks.plans import views
from loamworks.plans.views import CONVS, DOCS, ITEMS, PAIRS, sql_norm, sql_words
from loamworks.sources import loaders
from loamworks.sources.scratch import shared_folder
from loamworks.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- quality predicates ----


@query(f"WITH {ITEMS} SELECT pos, length(output) BETWEEN 10 AND 10000 AS passed, CASE WHEN length(output) < 10 THEN 'Too short (' || length(output) || ' < 10)' WHEN length(output) > 10000 THEN 'Too long (' || length(output) || ' > 10000)' ELSE '' END AS reason FROM items")
def q_length_filter(spark, d):
    return views.doc_items(spark, d).select("pos", LengthFilter().verdict().alias("v")).select("pos", "v.passed", "v.reason")


@query(f"WITH {ITEMS}, n AS (SELECT pos, len({sql_words('output')}) AS n FROM items) SELECT pos, n BETWEEN 5 AND 2000 AS passed, CASE WHEN n < 5 THEN 'Too few tokens (' || n || ' < 5)' WHEN n > 2000 THEN 'Too many tokens (' || n || ' > 2000)' ELSE '' END AS reason FROM n")
def q_token_length(spark, d):
    return views.doc_items(spark, d).select("pos", TokenLengthFilter().verdict().alias("v")).select("pos", "v.passed", "v.reason")


@query("SELECT doc_id, length(text) < 20 OR lang = 'en' AS passed FROM documents")
def q_language_filter(spark, d):
    t = views.table(spark, d, "documents")
    return t.select("doc_id", LanguageFilter("text", language=F.col("lang")).verdict()["passed"].alias("passed"))


_CONTENT = " ".join(f"WHEN regexp_matches(output, '{p}') THEN 'Contains blocked pattern: {p}'" for p in BLOCKED)


@query(f"WITH {ITEMS}, r AS (SELECT pos, CASE {_CONTENT} ELSE '' END AS reason FROM items) SELECT pos, reason = '' AS passed, reason FROM r")
def q_content_filter(spark, d):
    return views.doc_items(spark, d).select("pos", ContentFilter().verdict().alias("v")).select("pos", "v.passed", "v.reason")


_SHARES = f"""w AS (SELECT pos, {sql_words('lower(output)')} AS w FROM items),
word AS (SELECT pos, max(c) AS c FROM (SELECT pos, x, count(*) AS c FROM (SELECT pos, unnest(w) AS x FROM w) GROUP BY pos, x) GROUP BY pos),
gram AS (SELECT pos, max(c) AS c FROM (SELECT pos, x, count(*) AS c FROM (SELECT pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) > 2) GROUP BY pos, x) GROUP BY pos),
shares AS (SELECT w.pos, CASE WHEN len(w) < 5 THEN 0.0::DOUBLE ELSE coalesce(word.c, 0)::DOUBLE / len(w) END AS word_share, CASE WHEN len(w) < 5 THEN 0.0::DOUBLE ELSE coalesce(gram.c, 0)::DOUBLE / (len(w) - 2) END AS ngram_share FROM w LEFT JOIN word USING (pos) LEFT JOIN gram USING (pos))"""


@query(f"WITH {ITEMS}, {_SHARES} SELECT pos, round(word_share, 6) AS word_share, NOT word_share > 0.3::DOUBLE AS passed FROM shares")
def q_word_repetition(spark, d):
    t = quality.repetition_shares(views.doc_items(spark, d))
    return t.select("pos", _r("word_share").alias("word_share"), (F.col("word_share") <= 0.3).alias("passed"))


@query(f"WITH {ITEMS}, {_SHARES} SELECT pos, round(ngram_share, 6) AS ngram_share, NOT ngram_share > 0.2::DOUBLE AS passed FROM shares")
def q_ngram_repetition(spark, d):
    t = quality.repetition_shares(views.doc_items(spark, d))
    return t.select("pos", _r("ngram_share").alias("ngram_share"), (F.col("ngram_share") <= 0.2).alias("passed"))


_ASKING = " OR ".join(f"starts_with(q, '{w}')" for w in "are can could did do does how is should what when where which who why would".split())


@query(
    rf"""WITH {PAIRS}, p AS (SELECT pos, input, output, regexp_replace(regexp_replace(lower(input), '^\s+', ''), '\s+$', '') AS q FROM pairs),
s AS (SELECT *, list_distinct({sql_words('q')}) AS qw, list_distinct({sql_words('lower(output)')}) AS aw FROM p),
r AS (SELECT pos, CASE WHEN length(input) < 10 THEN 'Question too short' WHEN length(output) < 20 THEN 'Answer too short' WHEN NOT (ends_with(q, '?') OR {_ASKING}) THEN 'Question doesn''t appear to be interrogative'
 WHEN contains(lower(output), q) AND len(list_intersect(qw, aw))::DOUBLE / greatest(len(aw), 1) > 0.7::DOUBLE THEN 'Answer repeats too much of question' ELSE '' END AS reason FROM s)
SELECT pos, reason = '' AS passed, reason FROM r"""
)
def q_qa_specific(spark, d):
    return views.pairs(spark, d).select("pos", QASpecificFilter().verdict().alias("v")).select("pos", "v.passed", "v.reason")


_FIRST = f"""first AS (SELECT pos, CASE WHEN length(output) < 10 OR length(output) > 10000 THEN 'length' WHEN word_share > 0.3::DOUBLE OR ngram_share > 0.2::DOUBLE THEN 'repetition' WHEN (CASE {_CONTENT} ELSE '' END) <> '' THEN 'content' END AS first_fail FROM items JOIN shares USING (pos))"""


def _plain() -> quality.QualityFilterPipeline:
    return quality.QualityFilterPipeline(quality.default_filters())


@query(f"WITH {ITEMS}, {_SHARES}, {_FIRST} SELECT pos, first_fail FROM first")
def q_quality_pipeline(spark, d):
    return _plain().verdicts(views.doc_items(spark, d)).select("pos", "first_fail")


@query(
    f"""WITH {ITEMS}, {_SHARES}, {_FIRST} SELECT unnest(['total_input', 'total_passed', 'total_failed', 'failed_length', 'failed_repetition', 'failed_content']) AS name,
unnest([count(*), count(*) FILTER (first_fail IS NULL), count(*) FILTER (first_fail IS NOT NULL), count(*) FILTER (first_fail = 'length'), count(*) FILTER (first_fail = 'repetition'), count(*) FILTER (first_fail = 'content')]) AS n FROM first"""
)
def q_pipeline_stats(spark, d):
    return _plain().stats(views.doc_items(spark, d))


@query(
    f"""WITH {ITEMS}, {_SHARES}, s AS (SELECT pos, (length(output) BETWEEN 20 AND 5000)::INT AS a, (NOT (word_share > 0.3::DOUBLE OR ngram_share > 0.2::DOUBLE))::INT AS b, ((CASE {_CONTENT} ELSE '' END) = '')::INT AS c FROM items JOIN shares USING (pos))
SELECT pos, round((a + b + c)::DOUBLE / 3, 6) AS overall, a + b + c = 3 AS passed, (3 - a - b - c)::INT AS n_reasons FROM s"""
)
def q_quality_score(spark, d):
    t = quality.QualityScorer().score(views.doc_items(spark, d))
    return t.select("pos", _r("score.overall").alias("overall"), "score.passed", F.size("score.reasons").alias("n_reasons"))


@query()
def q_default_pipeline(spark, d):
    """With the sequential duplicate filter: tested against a plain statement of the rule."""
    return quality.QualityFilterPipeline().verdicts(views.doc_items(spark, d)).select("pos", "first_fail")


# ---- duplicates ----


@query(f"WITH {ITEMS}, k AS (SELECT pos, left(sha256({sql_norm('output')}), 16) AS key FROM items) SELECT pos, key, row_number() OVER (PARTITION BY key ORDER BY pos) = 1 AS keep FROM k")
def q_exact_dedup(spark, d):
    return quality.exact_duplicates(views.doc_items(spark, d))


@query(
    f"""WITH {ITEMS}, s AS (SELECT pos, list_distinct({sql_words('lower(output)')}) AS w FROM items), l AS (SELECT pos, unnest(w) AS x FROM s),
p AS (SELECT a.pos AS a, b.pos AS b, count(*) AS c FROM l a JOIN l b ON a.x = b.x AND a.pos < b.pos GROUP BY a.pos, b.pos),
j AS (SELECT a, b, c::DOUBLE / (len(x.w) + len(y.w) - c) AS similarity FROM p JOIN s x ON a = x.pos JOIN s y ON b = y.pos) SELECT a, b, round(similarity, 6) AS similarity FROM j WHERE similarity > 0.9::DOUBLE"""
)
def q_near_dup_pairs(spark, d):
    t = views.doc_items(spark, d).select("pos", quality.normalised(F.col("output")).alias("norm"))
    return quality.near_pairs(t, 0.9).select("a", "b", _r("similarity").alias("similarity"))


@query()
def q_near_dup_sequential(spark, d):
    t = quality.DuplicateFilter(mode="sequential").mark(views.doc_items(spark, d))
    return t.select("pos", "duplicate.passed", "duplicate.reason")


@query()
def q_near_dup_scalable(spark, d):
    t = quality.DuplicateFilter(mode="scalable").mark(views.doc_items(spark, d))
    return t.select("pos", "duplicate.passed", "duplicate.reason")


# ---- formats ----


def _turns(f: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return f.select("pos", F.posexplode(f"formatted.{name}").alias("turn", "m")).select("pos", F.col("turn").cast("long").alias("turn"), f"m.{a}", f"m.{b}")


_UNROLL = "e AS (SELECT pos, unnest(range(len(c))) AS turn, unnest(c) AS m FROM convs WHERE len(c) >= 2)"


@query(f"WITH {CONVS}, {_UNROLL} SELECT pos, turn, m.role AS role, m.content AS content FROM e")
def q_fmt_openai(spark, d):
    return _turns(format_items(views.conversations(spark, d), "openai", keep=["pos"]), "messages", "role", "content")


@query(f"WITH {CONVS}, {_UNROLL} SELECT pos, turn, CASE m.role WHEN 'user' THEN 'human' ELSE 'gpt' END AS \"from\", m.content AS value FROM e")
def q_fmt_sharegpt(spark, d):
    return _turns(format_items(views.conversations(spark, d), "sharegpt", keep=["pos"]), "conversations", "from", "value")


@query(f"WITH {CONVS} SELECT pos, coalesce(list_filter(c, lambda t: t.role = 'user')[1].content, '') AS instruction, '' AS input, coalesce(list_filter(c, lambda t: t.role = 'assistant')[1].content, '') AS output FROM convs WHERE len(c) >= 2")
def q_fmt_alpaca(spark, d):
    return format_items(views.conversations(spark, d), "alpaca", keep=["pos"]).select("pos", "formatted.*")


@query(f"WITH {PAIRS} SELECT pos, input AS instruction, '' AS input, output FROM pairs")
def q_fmt_alpaca_qa(spark, d):
    return format_items(views.pairs(spark, d, "question", "answer"), "alpaca", keep=["pos"]).select("pos", "formatted.*")


@query(
    f"""WITH {CONVS} SELECT pos, CASE WHEN c[-2].role = 'user' THEN c[-2].content ELSE c[-1].content END AS instruction, CASE WHEN c[-1].role = 'assistant' THEN c[-1].content ELSE c[-2].content END AS output,
((len(c) - 2) // 2)::INT AS n_history, CASE WHEN len(c) >= 4 THEN c[1].content END AS first_asked, CASE WHEN len(c) >= 4 THEN c[2].content END AS first_said FROM convs WHERE len(c) >= 2"""
)
def q_fmt_llamafactory(spark, d):
    f = F.col("formatted")
    h = F.get(f["history"], F.lit(0))
    return format_items(views.conversations(spark, d), "llamafactory", keep=["pos"]).select("pos", f["instruction"].alias("instruction"), f["output"].alias("output"), F.size(f["history"]).alias("n_history"), F.get(h, F.lit(0)).alias("first_asked"), F.get(h, F.lit(1)).alias("first_said"))


@query(f"WITH {CONVS} SELECT pos, '<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n' || array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.role || '\n' || t.content || '<|im_end|>\n'), '') AS text FROM convs".replace("\n", "' || chr(10) || '"))
def q_fmt_chatml(spark, d):
    return format_items(views.conversations(spark, d), "chatml", keep=["pos"]).select("pos", "formatted.text")


@query(f"WITH {PAIRS} SELECT pos, input, output FROM pairs")
def q_fmt_generic(spark, d):
    t = views.pairs(spark, d).withColumn("_source", F.lit("conversations"))
    return format_items(t, "generic", keep=["pos"]).select("pos", "formatted.*")


# ---- datasets ----


def _dataset(spark, d) -> Dataset:
    return Dataset(views.doc_items(spark, d).withColumnRenamed("type", "extractor_type"))


@query("SELECT 'total' AS kind, '' AS name, count(*) AS n FROM documents UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'extractor_type', lang, count(*) FROM documents GROUP BY lang")
def q_dataset_statistics(spark, d):
    return _dataset(spark, d).statistics()


@query("SELECT doc_id AS pos FROM documents WHERE contains(source, 'src1')")
def q_filter_by_source(spark, d):
    return _dataset(spark, d).filter_by_source("src1").df.select("pos")


@query("SELECT doc_id AS pos FROM documents WHERE lang = 'fr'")
def q_filter_by_type(spark, d):
    return _dataset(spark, d).filter_by_type("fr").df.select("pos")


@query("SELECT min(doc_id) AS pos FROM documents GROUP BY text")
def q_dedup_first(spark, d):
    return _dataset(spark, d).deduplicate().df.select("pos")


@query(f"WITH {PAIRS} SELECT doc_id AS pos, text AS output, NULL AS input FROM documents UNION ALL SELECT pos + (SELECT max(doc_id) + 1 FROM documents), output, input FROM pairs")
def q_merge(spark, d):
    other = Dataset(views.pairs(spark, d).withColumn("source", F.lit("conversations")).withColumn("extractor_type", F.lit("qa")))
    return _dataset(spark, d).merge(other).df.select("pos", "output", "input")


_ORDER = "o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('0:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


@query(f"WITH {_ORDER} SELECT doc_id, pos FROM o")
def q_shuffle(spark, d):
    t = Dataset(_dataset(spark, d).df.withColumn("doc_id", F.col("pos")))
    return t.shuffle(0).df.select("doc_id", "pos")


@query(f"WITH {_ORDER} SELECT doc_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM o")
def q_split(spark, d):
    train, test = Dataset(_dataset(spark, d).df.withColumn("doc_id", F.col("pos"))).split(0.8, 0)
    return train.df.select("doc_id", F.lit("train").alias("part")).unionAll(test.df.select("doc_id", F.lit("test")))


@query("SELECT doc_id AS pos FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def q_sample(spark, d):
    """The limit is the operator: a random sample of 100 rows."""
    return _dataset(spark, d).sample(100, 7).df.select("pos")


# ---- analytics ----

_STATS = """SELECT '{f}' AS field, count(*) AS n, round(avg(length({f})), 6) AS char_mean, round(stddev_pop(length({f})), 6) AS char_std, min(length({f}))::INT AS char_min, max(length({f}))::INT AS char_max, quantile_cont(length({f}), 0.25) AS char_p25, quantile_cont(length({f}), 0.5) AS char_median, round(quantile_cont(length({f}), 0.75), 6) AS char_p75, round(quantile_cont(length({f}), 0.95), 6) AS char_p95,
round(avg(len({w})), 6) AS token_mean, round(stddev_pop(len({w})), 6) AS token_std, min(len({w}))::INT AS token_min, max(len({w}))::INT AS token_max, quantile_cont(len({w}), 0.5) AS token_median, sum(len({w}))::BIGINT AS token_total FROM pairs"""


@query(f"WITH {PAIRS} " + " UNION ALL ".join(_STATS.format(f=f, w=sql_words(f)) for f in ("input", "output")))
def q_analyze_fields(spark, d):
    t = analytics.field_stats(views.pairs(spark, d))
    rounded = {"char_mean", "char_std", "token_mean", "token_std", "char_p75", "char_p95"}
    return t.select(*[_r(c).alias(c) if c in rounded else F.col(c) for c in t.columns])


@query(f"WITH {PAIRS}, t AS (SELECT len({sql_words('input')}) + len({sql_words('output')}) AS n FROM pairs) SELECT count(*) AS total_items, sum(n)::BIGINT AS total_tokens, round(avg(n), 6) AS avg_tokens_per_item FROM t")
def q_totals(spark, d):
    return analytics.totals(views.pairs(spark, d)).withColumn("avg_tokens_per_item", _r("avg_tokens_per_item"))


@query("SELECT 'type' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def q_histograms(spark, d):
    return analytics.histograms(views.doc_items(spark, d))


@query(
    rf"""WITH {ITEMS}, w AS (SELECT {sql_words('output')} AS w, len(list_filter(regexp_split_to_array(output, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS s FROM items),
q AS (SELECT len(w) AS n, s, CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / len(w) END AS d, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w) END AS l FROM w)
SELECT round(avg(n), 6) AS word_mean, round(stddev_pop(n), 6) AS word_std, min(n)::INT AS word_min, max(n)::INT AS word_max, round(avg(s), 6) AS sentence_mean, round(stddev_pop(s), 6) AS sentence_std, round(coalesce(avg(d), 0), 6) AS diversity, round(coalesce(avg(l), 0), 6) AS word_length FROM q"""
)
def q_text_quality(spark, d):
    t = analytics.text_quality(views.doc_items(spark, d))
    return t.select(*[F.col(c) if c in ("word_min", "word_max") else _r(c).alias(c) for c in t.columns])


@query(f"WITH {ITEMS}, c AS (SELECT count(*) AS c FROM items GROUP BY {sql_norm('output')}) SELECT sum(c)::BIGINT AS total, count(*) AS unique_hashes, sum(c - 1)::BIGINT AS exact_duplicates, round(sum(c - 1)::DOUBLE / greatest(sum(c), 1), 6) AS duplicate_rate FROM c")
def q_dup_rate(spark, d):
    return analytics.duplicate_rate(views.doc_items(spark, d)).withColumn("duplicate_rate", _r("duplicate_rate"))


_TOKENS = r"t AS (SELECT doc_id AS pos, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)"


@query(f"WITH {_TOKENS}, l AS (SELECT pos, unnest(range(len(w))) AS i, unnest(w) AS word FROM t), c AS (SELECT word, count(*) AS n, min((pos, i)) AS f FROM l GROUP BY word) SELECT word, n FROM c ORDER BY n DESC, f LIMIT 50")
def q_top_words(spark, d):
    """The limit is the report: the 50 most frequent."""
    return analytics.top_words(views.doc_items(spark, d))


@query(
    f"WITH {_TOKENS}, l AS (SELECT pos, unnest(range(len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM t WHERE len(w) > 1), c AS (SELECT bigram, count(*) AS n, min((pos, i)) AS f FROM l GROUP BY bigram) SELECT bigram, n FROM c ORDER BY n DESC, f LIMIT 50"
)
def q_top_bigrams(spark, d):
    """The limit is the report: the 50 most frequent."""
    return analytics.top_bigrams(views.doc_items(spark, d))


@query(f"WITH {_TOKENS}, l AS (SELECT unnest(w) AS word FROM t) SELECT word, count(*) AS n FROM l GROUP BY word")
def q_vocabulary(spark, d):
    return analytics.vocabulary(views.doc_items(spark, d)).select("word", "n")


@query(
    f"""WITH {PAIRS}, c AS (SELECT 'pairs' AS name, count(*) AS total_items, sum(len({sql_words('input')}) + len({sql_words('output')}))::BIGINT AS total_tokens FROM pairs UNION ALL SELECT 'documents', count(*), sum(len({sql_words('text')}))::BIGINT FROM documents),
f AS (SELECT * FROM c WHERE name = 'pairs') SELECT c.*, round(f.total_items::DOUBLE / greatest(c.total_items, 1), 6) AS size_ratio, round(f.total_tokens::DOUBLE / greatest(c.total_tokens, 1), 6) AS token_ratio FROM c, f"""
)
def q_compare(spark, d):
    t = analytics.compare({"pairs": views.pairs(spark, d), "documents": views.doc_items(spark, d).select(F.lit("").alias("input"), "output")})
    return t.select("name", "total_items", "total_tokens", _r("size_ratio").alias("size_ratio"), _r("token_ratio").alias("token_ratio"))


def _log(spark, d) -> DataFrame:
    t = views.table(spark, d, "events")
    return t.select(F.col("user_id").cast("string").alias("source"), "ts", F.lit(1).cast("long").alias("items"), F.col("value").alias("seconds"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("cost"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query(
    """WITH l AS (SELECT value AS s, event_type IS NOT DISTINCT FROM 'error' AS bad FROM events), t AS (SELECT count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS bad, avg(s) FILTER (NOT bad) AS m, median(s) FILTER (NOT bad) AS md, min(s) FILTER (NOT bad) AS lo, max(s) FILTER (NOT bad) AS hi, sum(s) FILTER (NOT bad) AS total FROM l)
SELECT ok AS documents, bad AS errors, round(ok::DOUBLE / (ok + bad), 6) AS success_rate, ok AS total_items, 0::BIGINT AS total_tokens, 0.0::DOUBLE AS total_cost, round(m, 4) AS time_mean, round(md, 4) AS time_median, round(lo, 4) AS time_min, round(hi, 4) AS time_max, round(total, 2) AS time_total, round(ok / greatest(total, 1) * 60, 4) AS per_minute FROM t"""
)
def q_processing_summary(spark, d):
    t = analytics.processing_summary(_log(spark, d))
    digits = {"success_rate": 6, "time_mean": 4, "time_median": 4, "time_min": 4, "time_max": 4, "time_total": 2, "per_minute": 4}
    return t.select(*[_r(c, digits[c]).alias(c) if c in digits else F.col(c) for c in t.columns])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", count(*) FILTER (event_type <> 'error') AS documents, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def q_windowed_log(spark, d):
    return ingest.windowed_log(_log(spark, d))


# ---- cost ----


@query(f"WITH {DOCS} SELECT pos, length(content) // 4 + 500 AS input_tokens, greatest(floor((length(content) // 4) * 0.8::DOUBLE)::BIGINT, 100) AS output_tokens FROM docs")
def q_cost_estimate(spark, d):
    return cost.estimates(views.docs(spark, d)).select("pos", "input_tokens", "output_tokens")


@query(
    """WITH k(t, s) AS (VALUES ('qa', 0.8::DOUBLE), ('rules', 0.5::DOUBLE), ('facts', 0.6::DOUBLE), ('instructions', 1.0::DOUBLE)),
c AS (SELECT t, count(*) AS documents, sum(length(text) // 4 + 500)::BIGINT AS i, sum(greatest(floor((length(text) // 4) * s)::BIGINT, 100))::BIGINT AS o FROM documents, k GROUP BY t),
m AS (SELECT t AS extraction_type, documents, i AS input_tokens, o AS output_tokens, i * 30::DOUBLE / 1e6 AS input_cost, o * 60::DOUBLE / 1e6 AS output_cost FROM c)
SELECT extraction_type, max(documents) AS documents, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(input_cost), 6) AS input_cost, round(sum(output_cost), 6) AS output_cost, round(sum(input_cost + output_cost), 6) AS total_cost FROM m GROUP BY GROUPING SETS ((extraction_type), ())"""
)
def q_cost_batch(spark, d):
    t = cost.processing_cost(views.docs(spark, d))
    return t.select(*[_r(c).alias(c) if c.endswith("cost") else F.col(c) for c in t.columns])


@query("SELECT conv_id AS pos, (2 + sum(4 + length(role) // 4 + length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def q_count_messages(spark, d):
    return views.conversations(spark, d).select("pos", cost.message_tokens(F.col("conversation")).alias("tokens"))


# ---- chunks and extraction ----


def _chunk_sql(size: int, overlap: int) -> str:
    def cut(sep: str, n: int) -> str:
        at = f"{size} - strpos(reverse(s), reverse({sep})) - {n} + 1"
        return f"CASE WHEN strpos(reverse(s), reverse({sep})) > 0 AND {at} > {size // 2} THEN {at} + {n} END"

    stop = f"CASE WHEN from_ + {size} < n THEN from_ + coalesce({cut('chr(10) || chr(10)', 2)}, {cut('chr(10)', 1)}, {cut(chr(39) + '. ' + chr(39), 2)}, {cut(chr(39) + ' ' + chr(39), 1)}, {size}) ELSE from_ + {size} END"
    return rf"""RECURSIVE r AS (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS from_, NULL::BIGINT AS was, NULL::BIGINT AS stop FROM documents WHERE length(text) > {size}
UNION ALL SELECT doc_id, text, n, stop2 - {overlap}, from_, stop2 FROM (SELECT *, {stop} AS stop2 FROM (SELECT * EXCLUDE (stop), substr(text, from_ + 1, {size}) AS s FROM r WHERE from_ < n))),
cuts AS (SELECT doc_id, was, regexp_replace(regexp_replace(substr(text, was + 1, stop - was), '^\s+', ''), '\s+$', '') AS chunk FROM r WHERE was IS NOT NULL),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY was) - 1 AS chunk_index, chunk FROM cuts WHERE chunk <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {size})"""


@query(f"WITH {_chunk_sql(3000, 0)} SELECT doc_id AS pos, chunk_index::INT AS chunk_index, chunk FROM chunks")
def q_chunk(spark, d):
    return chunking.chunks(views.docs(spark, d).drop("source"), 3000)


@query(f"WITH {_chunk_sql(2000, 200)} SELECT doc_id AS pos, chunk_index::INT AS chunk_index, chunk FROM chunks")
def q_chunk_overlap(spark, d):
    return chunking.chunks(views.docs(spark, d).drop("source"), 2000, 200)


def stub_llm(prompt: str) -> str:
    """In place of a model: says how long the passage is."""
    passage = prompt.split("Passage:\n", 1)[1]
    return f'Here it is: [{{"question": "How long is it?", "answer": "{len(passage)} characters"}}, {{"question": "no answer"}}]'


@query(f"WITH {_chunk_sql(3000, 0)} SELECT source || '/' || doc_id || '.txt' AS source, chunk_index::INT AS chunk_index, 'How long is it?' AS question, length(chunk) || ' characters' AS answer FROM chunks JOIN documents USING (doc_id)")
def q_extract_parse(spark, d):
    t = extraction.extract(views.docs(spark, d), [extraction.get_extractor("qa")], stub_llm)
    return t.select("source", "chunk_index", "item.question", "item.answer")


@query("SELECT count(*) FILTER (lang <> 'de') AS successes, count(*) FILTER (lang = 'de') AS failures, round(count(*) FILTER (lang <> 'de')::DOUBLE / count(*), 6) AS success_rate FROM documents")
def q_batch_counters(spark, d):
    def check(lang: str) -> str:
        if lang == "de":
            raise ValueError(lang)
        return lang

    t = views.table(spark, d, "documents").select(parallel.apply(check)(F.col("lang")).alias("result"))
    return parallel.counters(t).withColumn("success_rate", _r("success_rate"))


# ---- loaders' text ----


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM pages")
def q_md_strip_html(spark, d):
    return views.table(spark, d, "pages").select("page_id", loaders.clean_markdown(F.col("html")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM documents")
def q_pdf_clean(spark, d):
    return views.table(spark, d, "documents").select("doc_id", loaders.clean_pdf(F.col("text")).alias("text"))


# ---- lineage ----


@query("SELECT doc_id, (1 + length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')))::INT AS line FROM documents")
def q_char_to_line(spark, d):
    return views.table(spark, d, "documents").select("doc_id", lineage.line_of(F.col("text"), F.floor(F.length("text") / 2)).alias("line"))


@query(
    f"""WITH f AS (SELECT doc_id, {sql_norm('text')} AS space, {sql_norm('substr(text, length(text) // 3 + 1, 60)')} AS wanted, array_to_string(({sql_words('lower(substr(text, length(text) // 3 + 1, 60))')})[1:5], ' ') AS head, length(substr(text, length(text) // 3 + 1, 60)) AS n FROM documents),
g AS (SELECT doc_id, n, nullif(strpos(space, wanted), 0) AS whole, CASE WHEN head <> '' THEN nullif(strpos(space, head), 0) END AS part FROM f)
SELECT doc_id, (coalesce(whole, part) - 1)::INT AS char_start, (coalesce(whole, part) - 1 + n)::INT AS char_end, whole IS NULL AS fuzzy FROM g WHERE coalesce(whole, part) IS NOT NULL"""
)
def q_find_text(spark, d):
    part = F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(60))
    found = views.table(spark, d, "documents").select("doc_id", lineage.find_text(F.col("text"), part).alias("f")).where("f IS NOT NULL")
    return found.select("doc_id", "f.char_start", "f.char_end", "f.fuzzy")


@query(
    """WITH l AS (SELECT doc_id, 1 + length(left(text, 10)) - length(replace(left(text, 10), chr(10), '')) AS a, 1 + length(text) - length(replace(text, chr(10), '')) AS b FROM documents)
SELECT doc_id, doc_id || '.txt, "body", ' || CASE WHEN a <> b THEN 'lines ' || a || '-' || b ELSE 'line ' || a END AS citation FROM l"""
)
def q_citation(spark, d):
    t = views.docs(spark, d)
    at = lineage.span(F.col("content"), F.col("source"), F.lit(10), F.length("content"), F.lit("body"))
    return t.select(F.col("pos").alias("doc_id"), lineage.citation(at).alias("citation"))


@query()
def q_section_asof(spark, d):
    """Headers need their offsets, which SQL's regular expressions don't give: tested against Python."""
    t = views.table(spark, d, "documents").withColumn("h", lineage.section_headers(F.col("text")))
    return t.select("doc_id", F.size("h").alias("n_headers"), lineage.section_at(F.col("h"), F.floor(F.length("text") / 2)).alias("section"))


@query("SELECT doc_id, left(sha256(text), 12) AS item_id FROM documents")
def q_attr_id(spark, d):
    return views.table(spark, d, "documents").select("doc_id", lineage.item_id(F.col("text")).alias("item_id"))


@query("SELECT count(*) AS total_items, 1.0::DOUBLE AS avg_sources, count(DISTINCT source) AS unique_sources FROM documents")
def q_attribution_stats(spark, d):
    t = views.table(spark, d, "documents").select(F.array(F.struct(F.col("source").alias("file_path"))).alias("sources"), F.col("lang").alias("extraction_method"))
    return lineage.attribution_stats(t).select("total_items", "avg_sources", "unique_sources")


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def q_attributed_by_source(spark, d):
    t = views.table(spark, d, "documents").select("doc_id", F.array(F.struct(F.col("source").alias("file_path"))).alias("sources"))
    return lineage.filter_by_source(t, "src1").select("doc_id")


# ---- jobs ----


@query(f"WITH {DOCS} SELECT pos, left(sha256(source), 16) AS doc_id FROM docs")
def q_doc_id(spark, d):
    return views.docs(spark, d).select("pos", jobs.doc_id(F.col("source"), F.col("content")).alias("doc_id"))


@query(f"WITH {DOCS} SELECT left(sha256('extract:gpt-4:' || string_agg(source, ':' ORDER BY source)), 16) AS job_id FROM docs")
def q_job_id(spark, d):
    return jobs.job_id(views.docs(spark, d), "extract", "gpt-4")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_pending_antijoin(spark, d):
    """What a job of all documents has still to do, where those with a label are done."""
    job = jobs.Jobs(spark, f"{shared_folder(spark)}/loamworks/jobs-{uuid.uuid4().hex}")
    done = views.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("result"))
    job.append("job", done)
    docs = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return job.pending("job", docs).select(F.col("doc_id").cast("long").alias("doc_id"))


@query("SELECT 'job' AS job_id, count(*) FILTER (quality = 1) AS done, count(*) FILTER (quality = 0) AS failed, round(count(*) FILTER (quality = 1)::DOUBLE / count(*), 6) AS success_rate FROM labels")
def q_job_summary(spark, d):
    t = views.table(spark, d, "labels").select(F.lit("job").alias("job_id"), F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    return jobs.summary(t).select("job_id", "done", "failed", _r("success_rate").alias("success_rate"))


# ---- augmentation ----


_SYNONYMS = ", ".join(f"('{k}', {list(v)})" for k, v in augmentation.SYNONYMS.items())


@query(
    f"""WITH {PAIRS}, syn(bare, other) AS (VALUES {_SYNONYMS}), w AS (SELECT pos, output, v, {sql_words('output')} AS w FROM pairs, range(1, 3) AS r(v)),
e AS (SELECT pos, output, v, i, w[i + 1] AS word FROM (SELECT *, unnest(range(len(w))) AS i FROM w)),
h AS (SELECT *, ('0x' || left(sha256('0:' || pos || ':' || v || ':' || i), 15))::BIGINT % 1000000 AS h FROM e),
p AS (SELECT h.*, other[(h // 7) % len(other) + 1] AS pick FROM h LEFT JOIN syn ON trim(lower(word), '.,!?;:') = bare),
n AS (SELECT pos, output, v, string_agg(CASE WHEN pick IS NOT NULL AND h < 200000 THEN CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper(pick[1]) || pick[2:] ELSE pick END || regexp_extract(word, '([.,!?;:])$', 1) ELSE word END, ' ' ORDER BY i) AS made FROM p GROUP BY pos, output, v)
SELECT pos, made AS output, 'synonym' AS _augmentation FROM n WHERE made <> output"""
)
def q_synonym_augment(spark, d):
    return augmentation.synonym_augmenter().make(views.pairs(spark, d)).select("pos", "output", "_augmentation")


@query(f"WITH {PAIRS}, v AS (SELECT pos, unnest(range(1, 4)) AS v FROM pairs), c AS (SELECT pos, (row_number() OVER (ORDER BY pos) - 1) * 3 AS before, floor(count(*) OVER () * 1.5::DOUBLE) AS target FROM pairs) SELECT pos, v::INT AS v FROM v JOIN c USING (pos) WHERE before < target OR before = 0")
def q_augment_cutoff(spark, d):
    t = views.pairs(spark, d)
    each = t.select("pos", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v"))
    return augmentation.cut_off(each, int(t.count() * 1.5))
