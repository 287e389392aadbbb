"""Queries over the data side: normalization, validation, logs, samples and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.functions.text import is_blank, match_key, safe_name
from quaero.operators import quality, ranking, reconcile
from quaero.plans import tables as t
from quaero.plans.tables import key_sql, sql

QUERIES, SQL = {}, {}


def query(select: str | None):
    """Register a plan, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if select is not None:
            SQL[f.__name__] = sql(select)
        return f

    return add


@query("SELECT doc_id AS id, source AS name, length(text) AS size FROM documents")
def normalize_corpus(spark, sf_dir):
    raw = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("text").alias("content"))
    return quality.normalize_corpus(raw).select("id", "name", F.length("text").cast("long").alias("size"))


@query("SELECT p_name AS value, TRY_CAST(p_name AS BIGINT) AS number FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_partkey FROM part")
def integer_coercion(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    values = part.select(F.col("p_name").alias("value")).union(part.select(F.col("p_partkey").cast("string")))
    return values.select("value", quality.whole_number(F.col("value")).alias("number"))


def _qa(spark, sf_dir):
    return quality.normalize_qa(t.conversations_qa(spark, sf_dir), t.corpus(spark, sf_dir))


@query("SELECT query_id, string_agg(CAST(gold_id AS VARCHAR), ',' ORDER BY pos) AS ids, string_agg(coalesce(corpus_name, '-'), ',' ORDER BY pos) AS corpus_names, string_agg(CASE WHEN gold_name = corpus_name THEN 'y' ELSE 'n' END, ',' ORDER BY pos) AS same, CAST(sum(coalesce(length(gold_text), 0)) AS BIGINT) AS size FROM nqa GROUP BY query_id")
def normalize_qa(spark, sf_dir):
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return _qa(spark, sf_dir).select(
        "query_id", text("gold_ids", lambda x: x.cast("string")).alias("ids"), text("gold_corpus_names", lambda x: F.coalesce(x, F.lit("-"))).alias("corpus_names"),
        text("gold_name_matches_corpus", lambda x: F.when(x, "y").otherwise("n")).alias("same"), F.aggregate("gold_texts", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0))).alias("size"),
    )


@query("SELECT query_id, gold_id FROM nqa WHERE NOT there")
def fk_violations(spark, sf_dir):
    refs = quality.pairs(t.conversations_qa(spark, sf_dir)).select("query_id", "gold_id")
    return quality.unmatched(refs, "gold_id", t.corpus(spark, sf_dir), "id").select("query_id", "gold_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(t.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT query_id FROM qa WHERE trim(question) = '' OR trim(answer) = ''")
def empty_text_check(spark, sf_dir):
    return t.conversations_qa(spark, sf_dir).where(is_blank(F.col("question")) | is_blank(F.col("answer"))).select("query_id")


@query("SELECT query_id, CAST(len(match_id) AS INTEGER) AS first_size, 1 AS second_size FROM qa WHERE query_id // 100 % 10 = 3")
def array_alignment(spark, sf_dir):
    """Questions whose references and names are of unequal number: those of every tenth conversation, of which a name is taken away."""
    qa = t.conversations_qa(spark, sf_dir)
    short = F.when(F.expr("query_id div 100 % 10 = 3"), F.slice("match_name", 1, 1)).otherwise(F.col("match_name"))
    return quality.misaligned(qa.withColumn("match_name", short), "query_id", "match_id", "match_name")


@query("""SELECT 'empty answer' AS rule, CAST(query_id AS VARCHAR) AS key FROM qa WHERE trim(answer) = ''
UNION ALL SELECT 'empty question', CAST(query_id AS VARCHAR) FROM qa WHERE trim(question) = ''
UNION ALL SELECT DISTINCT 'missing corpus row', CAST(query_id AS VARCHAR) FROM nqa WHERE NOT there
UNION ALL SELECT 'duplicate query id', CAST(query_id AS VARCHAR) FROM qa GROUP BY query_id HAVING count(*) > 1
UNION ALL SELECT 'empty corpus text', CAST(id AS VARCHAR) FROM corpus WHERE trim(name) = '' OR trim(text) = ''""")
def validation_report(spark, sf_dir):
    return quality.validation_report(_qa(spark, sf_dir), t.corpus(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM qa) AS qa_total, (SELECT count(*) FROM corpus) AS corpus_count, (SELECT round(avg(len(match_id)), 6) FROM qa) AS average_gold, (SELECT round(avg(length(question)), 6) FROM qa) AS average_question_length, (SELECT round(avg(length(answer)), 6) FROM qa) AS average_answer_length,
(SELECT count(DISTINCT query_id) FROM nqa WHERE NOT coalesce(gold_name = corpus_name, false)) AS mismatch_qa, (SELECT count(*) FROM nqa WHERE NOT coalesce(gold_name = corpus_name, false)) AS mismatch_pairs""")
def dataset_stats(spark, sf_dir):
    out = quality.statistics(_qa(spark, sf_dir), t.corpus(spark, sf_dir))
    return out.withColumn("mismatch_pairs", F.col("mismatch_pairs").cast("long"))


@query("SELECT CASE WHEN query_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, min(query_id) AS first, max(query_id) AS last, count(*) AS n FROM qa GROUP BY ALL")
def split_id_ranges(spark, sf_dir):
    split = F.when(F.col("query_id") % 5 == 0, "test").otherwise("train").alias("split")
    return t.conversations_qa(spark, sf_dir).groupBy(split).agg(F.min("query_id").alias("first"), F.max("query_id").alias("last"), F.count("*").alias("n"))


@query("SELECT query_id, string_agg(CAST(gold_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM nqa WHERE NOT coalesce(gold_name = corpus_name, false) GROUP BY query_id ORDER BY query_id LIMIT 20")
def mismatch_examples(spark, sf_dir):
    qa = _qa(spark, sf_dir)
    wrong = F.filter(F.arrays_zip("gold_ids", "gold_name_matches_corpus"), lambda z: ~F.coalesce(z["gold_name_matches_corpus"], F.lit(False)))
    out = qa.select("query_id", F.transform(wrong, lambda z: z["gold_ids"].cast("string")).alias("ids")).where(F.size("ids") > 0)
    return out.orderBy("query_id").limit(20).select("query_id", F.array_join("ids", ",").alias("ids"))


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins_dedup(spark, sf_dir):
    log = t.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return ranking.last_wins(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def resume_pending(spark, sf_dir):
    wanted = t.table(spark, sf_dir, "customer").select("c_custkey")
    done = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return ranking.pending(wanted, done, ["c_custkey"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region")
def jsonl_lines(spark, sf_dir):
    return t.table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id || ':42'), doc_id LIMIT 10")
def hashed_sample(spark, sf_dir):
    return quality.hashed_sample(t.table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


@query(None)
def seeded_sample(spark, sf_dir):
    return quality.seeded_sample(t.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "lang", "source")


@query(f"SELECT id, sha256({key_sql('text')}) AS digest FROM corpus")
def normalize_match_text(spark, sf_dir):
    return t.corpus(spark, sf_dir).select("id", F.sha2(match_key(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def sha256_rows(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT sha256(string_agg(doc_id || chr(0) || source || chr(0) || text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents")
def corpus_fingerprint(spark, sf_dir):
    from quaero.sources.files import fingerprint

    return fingerprint(t.table(spark, sf_dir, "documents"), "doc_id", "doc_id", "source", "text")


@query(None)
def wide_fingerprint(spark, sf_dir):
    from quaero.sources.files import wide_fingerprint as wide

    return wide(t.table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM pages")
def filename_sanitize(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


@query("SELECT o_orderkey, i AS part, i * 100000 AS first, CAST(least((i + 1) * 100000, size) - 1 AS BIGINT) AS last FROM (SELECT o_orderkey, size, unnest(range(CAST(ceil(size / 100000.0) AS BIGINT))) AS i FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS size FROM orders))")
def range_plan(spark, sf_dir):
    """Byte ranges of 100,000 for files as large as ten times an order's price."""
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("size")).where("size > 0")
    parts = rows.select("o_orderkey", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / 100000) - 1)).alias("part"))
    return parts.select("o_orderkey", "part", (F.col("part") * 100000).alias("first"), (F.least((F.col("part") + 1) * 100000, "size") - 1).alias("last"))


@query("SELECT query_id, pos, level, rid AS resolved_id FROM lvr")
def resolution_level(spark, sf_dir):
    return reconcile.resolve_ids(t.related(spark, sf_dir), t.named_corpus(spark, sf_dir)).select("query_id", "pos", "level", "resolved_id")


@query("SELECT level, count(*) AS n FROM lvr GROUP BY level")
def resolution_counts(spark, sf_dir):
    return reconcile.resolve_ids(t.related(spark, sf_dir), t.named_corpus(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT query_id, pos, array_to_string(cand, ',') AS ids FROM lvr")
def candidate_union(spark, sf_dir):
    rows = reconcile.resolve(t.related(spark, sf_dir), t.named_corpus(spark, sf_dir))
    return rows.select("query_id", "pos", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("ids"))


def _lookup(kind: str, *keys: str):
    def plan(spark, sf_dir):
        rows = t.named_corpus(spark, sf_dir).select("id", match_key(F.col("name")).alias("name"), match_key(F.col("text")).alias("text"))
        asked = t.related(spark, sf_dir).select("query_id", "pos", match_key(F.col("name")).alias("name"), match_key(F.col("text")).alias("text"))
        found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first"))
        return asked.join(found, list(keys), "left").select("query_id", "pos", F.coalesce("n", F.lit(0)).alias("n"), "first")

    on = " AND ".join(f"a.{ {'name': 'kn', 'text': 'kt'}[k] } = k.{ {'name': 'kn', 'text': 'kt'}[k] }" for k in keys)
    plan.__name__ = f"lookup_by_{kind}"
    query(f"SELECT a.query_id, a.pos, count(k.id) AS n, min(k.id) AS first FROM asked a LEFT JOIN keyed k ON {on} GROUP BY a.query_id, a.pos")(plan)


_lookup("pair", "name", "text")
_lookup("text", "text")
_lookup("name", "name")


def _reconciled(spark, sf_dir):
    return reconcile.reconcile(t.references(spark, sf_dir), t.related(spark, sf_dir), t.named_corpus(spark, sf_dir))


@query("SELECT query_id, status, array_to_string(ids, ',') AS raw_ids, array_to_string(rec, ',') AS reconciled_ids, clean AS raw_clean, high AS all_high_confidence, allres AS all_resolved FROM rec")
def reconcile_rows(spark, sf_dir):
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _reconciled(spark, sf_dir).select("query_id", "status", ids("raw_ids"), ids("reconciled_ids"), "raw_clean", "all_high_confidence", "all_resolved")


@query("SELECT status, count(*) AS n FROM rec GROUP BY status")
def reconcile_status_counts(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS query_count, count(*) FILTER (WHERE clean) AS raw_position_clean, count(*) FILTER (WHERE allres) AS all_related_resolved, count(*) FILTER (WHERE high) AS high_confidence_all_related, count(*) FILTER (WHERE high AND status IN ('clean', 'order_only_conflict')) AS high_confidence_agreement,
count(*) FILTER (WHERE NOT high) AS not_strict_high_confidence, count(*) FILTER (WHERE status IN ('ambiguous', 'unresolved', 'true_set_conflict')) AS actual_unresolved_or_conflicted FROM rec""")
def reconcile_counts(spark, sf_dir):
    return reconcile.counts(_reconciled(spark, sf_dir))


@query("SELECT query_id, same FROM rec")
def set_equality(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("query_id", F.col("same_set").alias("same"))


_AUDIT = "SELECT query_id, CASE max(CASE WHEN NOT there THEN 3 WHEN coalesce(rn, gold_name) <> corpus_name THEN 2 WHEN gold_name <> corpus_name THEN 1 ELSE 0 END) WHEN 3 THEN 'unresolved' WHEN 2 THEN 'id_evidence_conflict' WHEN 1 THEN 'name_mismatch_only' ELSE 'clean' END AS classification, count(*) AS pairs FROM (SELECT nqa.*, CASE WHEN query_id % 3 = 0 AND pos = 0 THEN 'src1' WHEN query_id % 3 = 1 THEN corpus_name END AS rn FROM nqa) GROUP BY query_id"


def _audit(spark, sf_dir):
    qa = t.conversations_qa(spark, sf_dir)
    named = quality.pairs(qa).join(t.corpus(spark, sf_dir).select(F.col("id").alias("gold_id"), F.col("name").alias("own")), "gold_id", "left")
    told = F.when((F.col("query_id") % 3 == 0) & (F.col("pos") == 0), "src1").when(F.col("query_id") % 3 == 1, F.col("own"))
    related = named.select("query_id", "pos", told.alias("related_name")).where("related_name is not null")
    return quality.positional_audit(qa, related, t.corpus(spark, sf_dir))


@query(_AUDIT)
def positional_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(f"SELECT classification, count(*) AS n FROM ({_AUDIT}) GROUP BY classification")
def audit_counts(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from quaero.streaming.runs import windowed_counts as windowed

    out = windowed(t.table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))
