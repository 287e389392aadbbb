"""Queries over evidence, prompts, audits, generation records and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.functions.text import error_class as classify
from quaero.operators import evidence as ev
from quaero.operators import generation, reports
from quaero.plans import tables as t
from quaero.plans.retrieval import lists, sent
from quaero.plans.tables import sql

QUERIES, SQL = {}, {}
LIMIT = 9000


def query(select: str | None):
    """Register a plan, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if select is not None:
            SQL[f.__name__] = sql(select)
        return f

    return add


def _ranked(spark, sf_dir):
    return sent(lists(spark, sf_dir))


def _blocks(spark, sf_dir, ranked=None):
    ranked = _ranked(spark, sf_dir) if ranked is None else ranked
    return ev.blocks(ranked.where("retriever = 'bm25'"), t.corpus(spark, sf_dir))


def _ids(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("SELECT query_id, CAST(rank AS BIGINT) AS rank, id, sha256(block) AS digest FROM blk WHERE retriever = 'bm25'")
def evidence_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.sha2("block", 256).alias("digest"))


@query("SELECT query_id, ids, sha256(evidence) AS digest FROM ev WHERE retriever = 'bm25'")
def evidence_join(spark, sf_dir):
    return ev.evidence(_blocks(spark, sf_dir)).select("query_id", _ids("ids"), F.sha2("evidence", 256).alias("digest"))


def _packed(spark, sf_dir, ranked=None):
    return ev.pack(t.questions(spark, sf_dir), _blocks(spark, sf_dir, ranked), LIMIT)


@query("SELECT query_id, array_to_string(ids, ',') AS included_ids, CAST(length(prompt) AS BIGINT) AS tokens, sha256(prompt) AS digest FROM pkd")
def pack_budget(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", _ids("included_ids"), F.col("tokens").cast("long").alias("tokens"), F.sha2("prompt", 256).alias("digest"))


def _prompts(spark, sf_dir, ranked=None):
    ranked = _ranked(spark, sf_dir) if ranked is None else ranked
    own = {r: ranked.where(F.col("retriever") == r) for r in ev.METHODS}
    return ev.prompts_for(own, t.questions(spark, sf_dir), t.corpus(spark, sf_dir))


@query("SELECT method, query_id, sha256(prompt) AS digest FROM pr")
def prompt_render(spark, sf_dir):
    return _prompts(spark, sf_dir).select("method", "query_id", F.sha2("prompt", 256).alias("digest"))


def _keyed(spark, sf_dir, ranked=None):
    """Prompts with method and query in one key, as a struct named query_id."""
    return _prompts(spark, sf_dir, ranked).select(F.struct("method", F.col("query_id").alias("q")).alias("query_id"), "prompt")


@query('SELECT method, query_id, CAST(pos AS BIGINT) AS pos, id, st AS start, en AS "end" FROM spn')
def marker_spans(spark, sf_dir):
    out = ev.marker_spans(_keyed(spark, sf_dir))
    return out.select("query_id.method", F.col("query_id.q").alias("query_id"), F.col("pos").cast("long").alias("pos"), "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _audits(spark, sf_dir, ranked=None):
    out = ev.audit(_keyed(spark, sf_dir, ranked), LIMIT)
    return out.select("query_id.method", F.col("query_id.q").alias("query_id"), F.col("tokens").cast("long").alias("tokens"), "truncated", "visible", "full", "partial")


@query("SELECT method, query_id, tokens, truncated, array_to_string(v, ',') AS visible, array_to_string(f, ',') AS \"full\", array_to_string(r, ',') AS \"partial\" FROM au")
def visibility_audit(spark, sf_dir):
    return _audits(spark, sf_dir).select("method", "query_id", "tokens", "truncated", _ids("visible"), _ids("full"), _ids("partial"))


@query("SELECT method, count(*) AS record_count, count(*) FILTER (WHERE truncated) AS truncated_count, CAST(sum(len(r)) AS BIGINT) AS partial_blocks, CAST(sum(len(f)) AS BIGINT) AS full_blocks FROM au GROUP BY method")
def audit_by_method(spark, sf_dir):
    return reports.audit_by_method(_audits(spark, sf_dir))


def _records(spark, sf_dir):
    """Records of a run: audits with the packed prompt's ids and size; every seventh query failed."""
    ranked = _ranked(spark, sf_dir)
    packed = _packed(spark, sf_dir, ranked).select("query_id", F.col("included_ids").alias("included"), F.col("tokens").cast("long").alias("packed_tokens"), "prompt")
    status = F.when(F.col("query_id") % 7 == 0, "error").otherwise("ok")
    return _audits(spark, sf_dir, ranked).withColumn("status", status).join(packed, "query_id", "left")


_SUMMARY = """SELECT method, count(*) AS record_count, count(DISTINCT query_id) AS unique_query_count, count(*) FILTER (WHERE status = 'ok') AS ok_count, count(*) FILTER (WHERE status = 'error') AS error_count,
count(*) FILTER (WHERE truncated) AS truncated_count, round(count(*) FILTER (WHERE truncated) / count(*), 6) AS truncation_rate, CAST(sum(len(r)) AS BIGINT) AS partial_blocks, CAST(sum(len(f)) AS BIGINT) AS full_blocks, CAST(sum(len(included)) AS BIGINT) AS visible_evidence_ids,
count(*) FILTER (WHERE NOT (v = included AND f = included)) AS consistency_failures, round(avg(packed), 3) AS token_mean, CAST(max(packed) AS BIGINT) AS token_max FROM runs GROUP BY method"""


@query(_SUMMARY)
def run_summary(spark, sf_dir):
    return reports.run_summary(_records(spark, sf_dir), "method", packed=True).drop("marker_missing")


@query(f"SELECT method, record_count = ok_count AND record_count = 40 AS all_ok, record_count = 40 AND ok_count = 40 AND partial_blocks = 0 AND consistency_failures = 0 AND truncated_count = 0 AS ready FROM ({_SUMMARY})")
def acceptance_flags(spark, sf_dir):
    summary = reports.run_summary(_records(spark, sf_dir), "method", packed=True)
    return reports.acceptance(summary, t.questions(spark, sf_dir).count()).select("method", "all_ok", "ready")


@query("SELECT event_type AS retriever, round(avg(value), 4) AS avg_latency_ms FROM events GROUP BY event_type")
def latency_mean(spark, sf_dir):
    return reports.latency(t.table(spark, sf_dir, "events").select(F.col("event_type").alias("retriever"), F.col("value").alias("latency_ms")))


@query("""SELECT event_id, CASE WHEN m LIKE '%out of memory%' OR (m LIKE '%cuda%' AND m LIKE '%memory%') THEN 'cuda_oom' WHEN m LIKE '%bitsandbytes%' THEN 'missing_bitsandbytes' ELSE 'RuntimeError' END AS class
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cuda: not enough memory' WHEN 1 THEN 'out of memory' WHEN 2 THEN 'no module bitsandbytes' WHEN 3 THEN 'memory' ELSE 'cuda' END AS m FROM events)""")
def error_class(spark, sf_dir):
    said = F.array(*map(F.lit, ("CUDA: not enough memory", "Out of memory", "No module bitsandbytes", "memory", "cuda")))
    rows = t.table(spark, sf_dir, "events").select("event_id", F.element_at(said, (F.col("event_id") % 5 + 1).cast("int")).alias("message"))
    return rows.select("event_id", classify(F.lit("RuntimeError"), F.col("message")).alias("class"))


@query("SELECT query_id, method, 'ok' AS status, length(prompt) AS size FROM pr WHERE method <> 'dense'")
def generate_stub(spark, sf_dir):
    """A run with the stand-in model that goes on where another has done the dense prompts."""
    prompts = _prompts(spark, sf_dir)
    done = prompts.where("method = 'dense'").select(F.lit("run").alias("run_id"), "method", "query_id")
    out = generation.generate(prompts, run_id="run", done=done)
    return out.select("query_id", "method", "status", F.length("prompt").cast("long").alias("size"))
