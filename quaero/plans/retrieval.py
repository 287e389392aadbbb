"""Queries over the retrieval side: index tables, searches, fusion, metrics and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import vectors as vec
from quaero.operators import bootstrap, dense, fusion, lexical, metrics, ranking, reconcile
from quaero.plans import tables as t
from quaero.plans.tables import CONSTANT, POOL, TOP, sql

QUERIES, SQL = {}, {}


def query(select: str | None):
    """Register a plan, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if select is not None:
            SQL[f.__name__] = sql(select)
        return f

    return add


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query("SELECT id, unnest(range(len(toks))) AS pos, unnest(toks) AS term FROM dt")
def token_explode(spark, sf_dir):
    return lexical.tokenized(t.corpus(spark, sf_dir)).select("id", F.posexplode("tokens").alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT id, term, tf FROM tf")
def token_counts(spark, sf_dir):
    return lexical.build_index(t.corpus(spark, sf_dir)).postings.select("id", "term", "tf")


@query("SELECT term, id, tf FROM tf WHERE term IN (SELECT term FROM qt)")
def postings(spark, sf_dir):
    wanted = lexical.query_terms(t.questions(spark, sf_dir))
    return lexical.build_index(t.corpus(spark, sf_dir), F.broadcast(wanted)).postings.select("term", "id", "tf")


@query("SELECT id, dl FROM lens")
def doc_lengths(spark, sf_dir):
    return lexical.build_index(t.corpus(spark, sf_dir)).lengths


@query("SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return lexical.build_index(t.corpus(spark, sf_dir)).stats.select("n", _r("avgdl"))


@query("SELECT term, df, round(ln(1.0 + (CAST(n AS DOUBLE) - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, stats")
def term_idf(spark, sf_dir):
    index = lexical.build_index(t.corpus(spark, sf_dir))
    both = index.terms.crossJoin(F.broadcast(index.stats))
    return both.select("term", "df", F.round(lexical.idf(F.col("df").cast("double"), F.col("n").cast("double")), 6).alias("idf"))


def _scores(spark, sf_dir):
    return lexical.score(t.questions(spark, sf_dir), t.corpus(spark, sf_dir))


@query("SELECT query_id, id, round(score, 6) AS score, matched FROM scored")
def bm25_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "id", _r("score"), "matched")


@query(f"SELECT query_id, rank, round(score, 6) AS score, id FROM lex WHERE rank <= {TOP}")
def bm25_topk(spark, sf_dir):
    return lexical.search(t.questions(spark, sf_dir), t.corpus(spark, sf_dir), TOP).select("query_id", F.col("rank").cast("long").alias("rank"), _r("score"), "id")


@query("SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM vd")
def vec_l2_norm(spark, sf_dir):
    v = F.transform("vector", lambda x: x.cast("double"))
    return t.vectors(spark, sf_dir).select("id", F.round(vec.norm(v), 6).alias("norm"), F.round(vec.l2_normalize(v)[0], 6).alias("first"))


@query("SELECT query_id, id, round(list_dot_product(vq.v, vd.v), 6) AS score FROM vq, vd")
def vec_inner_product(spark, sf_dir):
    return dense.products(t.vector_queries(spark, sf_dir), t.vectors(spark, sf_dir))


@query("SELECT query_id, rank, round(score, 6) AS score, id FROM (SELECT query_id, id, list_dot_product(vq.v, vd.v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(vq.v, vd.v), 9) DESC, id) AS rank FROM vq, vd) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return dense.search(t.vector_queries(spark, sf_dir), t.vectors(spark, sf_dir), TOP).select("query_id", F.col("rank").cast("long").alias("rank"), _r("score"), "id")


def kept(table: DataFrame) -> DataFrame:
    """``table``, worked out once and held; for tables of a few rows a query, which plans read several times."""
    table = table.persist()
    table.count()  # else jobs that begin together would each work it out
    return table


#: Ranked rows that are sent to the texts; for more, the texts are dealt by id.
SENT = 1_000_000


def sent(ranked: DataFrame) -> DataFrame:
    return F.broadcast(ranked) if ranked.limit(SENT + 1).count() <= SENT else ranked


def lists(spark, sf_dir, k: int = TOP) -> DataFrame:
    """(retriever, query_id, rank, score, id): BM25, term overlap (in place of dense: documents have no vectors), and both fused."""
    best = kept(lexical.best(t.questions(spark, sf_dir), t.corpus(spark, sf_dir), POOL))
    lex, ovl = (ranking.top_k(best.where(F.col("kind") == kind).drop("kind"), POOL) for kind in ("score", "matched"))
    hyb = fusion.fuse([lex, ovl], k, POOL, CONSTANT)
    named = [x.where(F.col("rank") <= k).select(F.lit(n).alias("retriever"), "query_id", "rank", "score", "id") for n, x in (("bm25", lex), ("dense", ovl), ("hybrid", hyb))]
    return kept(reduce(DataFrame.unionByName, named))


@query(f"SELECT query_id, rank, round(score, 6) AS score, id FROM hyb WHERE rank <= {TOP}")
def rrf_fusion(spark, sf_dir):
    return lists(spark, sf_dir).where("retriever = 'hybrid'").select("query_id", F.col("rank").cast("long").alias("rank"), _r("score"), "id")


@query("SELECT query_id, id FROM gold")
def gold_pairs(spark, sf_dir):
    return t.gold(spark, sf_dir)


RETRIEVERS = ("bm25", "dense", "hybrid")


def _per_query(spark, sf_dir):
    return metrics.per_retriever(t.questions(spark, sf_dir), lists(spark, sf_dir), kept(t.gold(spark, sf_dir)), RETRIEVERS)


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.NAMES)
_MEANS = ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS {m}" for m in metrics.NAMES)


@query(f"SELECT retriever, query_id, {_ROUNDED} FROM pq")
def per_query_metrics(spark, sf_dir):
    return _per_query(spark, sf_dir).select("retriever", "query_id", *map(_r, metrics.NAMES))


@query(f"SELECT retriever, count(*) AS query_count, {_MEANS} FROM pq GROUP BY retriever")
def metrics_summary(spark, sf_dir):
    return metrics.summary(_per_query(spark, sf_dir), "retriever")


@query("SELECT retriever, query_id, CAST(min(rank) AS BIGINT) AS first_rank FROM lists JOIN gold USING (query_id, id) GROUP BY ALL")
def mrr_first_hit(spark, sf_dir):
    found = lists(spark, sf_dir).join(t.gold(spark, sf_dir), ["query_id", "id"])
    return found.groupBy("retriever", "query_id").agg(F.min("rank").cast("long").alias("first_rank"))


#: Gold definitions over documents: all pairs, pairs of short questions, of even documents, of English-looking ones.
_SETS = {"raw_all": "true", "raw_clean": "query_id % 2 = 0", "high_confidence_reconciled": "id % 2 = 0", "resolved_agreement": "id % 3 <> 0"}
_SETS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS gold_definition, query_id, id FROM gold WHERE {w}" for n, w in _SETS.items())


def _gold_sets(spark, sf_dir):
    gold = kept(t.gold(spark, sf_dir))
    return reduce(DataFrame.unionByName, [gold.where(w).select(F.lit(n).alias("gold_definition"), "query_id", "id") for n, w in _SETS.items()])


_SUBSET_SQL = f"""SELECT gold_definition, retriever, query_id, coalesce(CAST(f <= 5 AS DOUBLE), 0.0) AS hit_at_5, coalesce(CAST(f <= 10 AS DOUBLE), 0.0) AS hit_at_10, coalesce(c5 / g, 0.0) AS recall_at_5, coalesce(c10 / g, 0.0) AS recall_at_10, coalesce(1.0::DOUBLE / f, 0.0) AS mrr
FROM (SELECT gold_definition, query_id, CAST(count(*) AS DOUBLE) AS g FROM ({_SETS_SQL}) GROUP BY ALL) CROSS JOIN (SELECT DISTINCT retriever FROM lists)
LEFT JOIN (SELECT gold_definition, retriever, query_id, min(rank) AS f, count(*) FILTER (WHERE rank <= 5) AS c5, count(*) FILTER (WHERE rank <= 10) AS c10 FROM lists JOIN ({_SETS_SQL}) USING (query_id, id) GROUP BY ALL) USING (gold_definition, retriever, query_id)"""
_COMPARED = ("hit_at_5", "hit_at_10", "recall_at_5", "recall_at_10", "mrr")


@query(f"SELECT gold_definition, retriever, count(*) AS query_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _COMPARED)} FROM ({_SUBSET_SQL}) GROUP BY ALL")
def metrics_by_subset(spark, sf_dir):
    values = metrics.by_subset(lists(spark, sf_dir), _gold_sets(spark, sf_dir))
    return metrics.summary(values, "gold_definition", "retriever").select("gold_definition", "retriever", "query_count", *_COMPARED)


def _flags(spark, sf_dir):
    return metrics.success(lists(spark, sf_dir), kept(t.gold(spark, sf_dir)), t.questions(spark, sf_dir), RETRIEVERS)


@query("SELECT query_id, category FROM cats")
def error_categories(spark, sf_dir):
    return metrics.error_categories(_flags(spark, sf_dir))


@query("SELECT category, count(*) AS queries FROM cats GROUP BY category")
def error_category_counts(spark, sf_dir):
    return metrics.error_categories(_flags(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("queries"))


@query("SELECT category, query_id FROM (SELECT category, query_id, row_number() OVER (PARTITION BY category ORDER BY query_id) AS n FROM cats) WHERE n <= 20")
def error_examples(spark, sf_dir):
    """The first queries of each category, after all are counted."""
    from pyspark.sql import Window

    order = Window.partitionBy("category").orderBy("query_id")
    return metrics.error_categories(_flags(spark, sf_dir)).withColumn("n", F.row_number().over(order)).where("n <= 20").select("category", "query_id")


@query("SELECT retriever, query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM lists WHERE rank <= 5 GROUP BY ALL")
def readable_top5(spark, sf_dir):
    own = lists(spark, sf_dir, 10).where("rank <= 5").groupBy("retriever", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    return own.select("retriever", "query_id", F.array_join(F.col("r.id").cast("array<string>"), ",").alias("ids"))


@query("SELECT query_id, retriever, 'missing' AS problem FROM (SELECT query_id, retriever FROM q, (SELECT DISTINCT retriever FROM lists)) ANTI JOIN (SELECT * FROM lists WHERE query_id % 3 <> 0 OR retriever <> 'dense') USING (query_id, retriever)")
def coverage_diff(spark, sf_dir):
    from quaero.operators.quality import coverage_gaps

    ranked = lists(spark, sf_dir).where("query_id % 3 <> 0 or retriever <> 'dense'")
    return coverage_gaps(t.questions(spark, sf_dir), ranked)


def _values(spark, sf_dir):
    by = metrics.by_subset(lists(spark, sf_dir), _gold_sets(spark, sf_dir))
    return by.select("gold_definition", "retriever", "query_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _COMPARED])))


@query(None)
def bootstrap_numpy_ci(spark, sf_dir):
    """All gold definitions, pairs of retrievers and metrics."""
    return bootstrap.paired(_values(spark, sf_dir), ["gold_definition"], [("dense", "hybrid"), ("dense", "bm25"), ("hybrid", "bm25")])


_MIX = "(xor({0}, {0} >> 16) * 73244475) % 4294967296"


@query(
    f"""SELECT round((SELECT avg(g) FROM gaps), 6) AS difference, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM (
SELECT rep, avg(g) AS m FROM (SELECT CAST(floor(x / n) AS BIGINT) AS rep, xor(h3, h3 >> 16) % n AS pos FROM (SELECT *, {_MIX.format('h2')} AS h3 FROM (SELECT *, {_MIX.format('h1')} AS h2 FROM (SELECT x, n, ((x + 42) * 2654435761) % 4294967296 AS h1 FROM (SELECT unnest(range(200 * n)) AS x, n FROM (SELECT count(*) AS n FROM gaps)))))) JOIN gaps USING (pos) GROUP BY rep)"""
    .replace("FROM gaps", "FROM (SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, l.mrr - r.mrr AS g FROM (SELECT * FROM pq WHERE retriever = 'bm25') l JOIN (SELECT * FROM pq WHERE retriever = 'dense') r USING (query_id)) gaps")
    .replace("JOIN gaps", "JOIN (SELECT row_number() OVER (ORDER BY query_id) - 1 AS pos, l.mrr - r.mrr AS g FROM (SELECT * FROM pq WHERE retriever = 'bm25') l JOIN (SELECT * FROM pq WHERE retriever = 'dense') r USING (query_id)) gaps")
)
def bootstrap_hash_ci(spark, sf_dir):
    by = _per_query(spark, sf_dir)
    gaps = by.where("retriever = 'bm25'").select("query_id", F.col("mrr").alias("l")).join(by.where("retriever = 'dense'").select("query_id", F.col("mrr").alias("r")), "query_id")
    return bootstrap.hashed(gaps.select("query_id", (F.col("l") - F.col("r")).alias("gap")))


@query("SELECT retriever, round(quantile_cont(mrr, 0.025), 6) AS low, round(quantile_cont(mrr, 0.975), 6) AS high FROM pq GROUP BY retriever")
def percentile_ci(spark, sf_dir):
    p = F.percentile("mrr", F.array(F.lit(0.025), F.lit(0.975)))
    return _per_query(spark, sf_dir).groupBy("retriever").agg(p.alias("p")).select("retriever", F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))


@query(f"SELECT gold_definition, count(*) AS n FROM (SELECT DISTINCT 'raw_all' AS gold_definition, query_id, unnest(ids) AS id FROM rec UNION ALL SELECT DISTINCT 'raw_clean', query_id, unnest(ids) FROM rec WHERE clean UNION ALL SELECT DISTINCT 'high_confidence_reconciled', query_id, unnest(rec) FROM rec WHERE high AND allres UNION ALL SELECT DISTINCT 'resolved_agreement', query_id, unnest(rec) FROM rec WHERE status IN ('clean', 'order_only_conflict') AND allres) GROUP BY gold_definition")
def gold_definitions(spark, sf_dir):
    rows = reconcile.reconcile(t.references(spark, sf_dir), t.related(spark, sf_dir), t.named_corpus(spark, sf_dir))
    return metrics.subsets(rows).groupBy("gold_definition").agg(F.count("*").alias("n"))
