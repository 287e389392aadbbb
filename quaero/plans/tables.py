"""The driver tables in the engine's roles, and the same as DuckDB common table expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quaero.functions.text import TOKEN, WHITE
from quaero.operators.lexical import SMALL_QUERIES

#: Every vector whose id this number divides is a query.
VECTOR_QUERIES = 20
TOP, POOL, CONSTANT = 10, 50, 60


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text")


def named_corpus(spark, sf_dir):
    """The corpus with names that mostly differ."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("-", "lang", "source", F.col("n_chars").cast("string")).alias("name"), "text")


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


#: Words of a question by which documents that may hold it are looked up.
ANCHOR = 4


def gold(spark, sf_dir):
    """(query_id, id): documents that hold a question's text whole.

    The words inside a question, between its first and last space, are words of
    every text that holds it.  Texts are looked up by ANCHOR of them in a row,
    and those found are compared whole.  Questions of fewer words are a stated
    set that is compared with all texts.  Up to SMALL_QUERIES questions
    (counted) are sent to the texts, which then are read once and not copied.
    """
    q = questions(spark, sf_dir).where("question <> ''")
    small = q.limit(SMALL_QUERIES + 1).count() <= SMALL_QUERIES
    words, docs = F.split(F.col("question"), " "), corpus(spark, sf_dir).select("id", "text")
    enough = F.size(words) >= ANCHOR + 2
    if small:
        return _held(q, docs)
    anchored = q.where(enough).select("query_id", "question", F.xxhash64(F.slice(words, 2, ANCHOR)).alias("anchor"))
    parts = F.split(F.col("text"), " ")
    starts = F.when(F.size(parts) >= ANCHOR, F.sequence(F.lit(1), F.size(parts) - (ANCHOR - 1)))
    anchors = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("parts"), i, ANCHOR))))
    at = docs.withColumn("parts", parts).select("id", F.explode(anchors).alias("anchor"))
    maybe = at.join(anchored.select("query_id", "anchor"), "anchor").select("query_id", "id")
    found = maybe.join(docs, "id").join(q, "query_id").where(F.contains("text", "question")).select("query_id", "id")
    return found.union(docs.join(q.where(~enough), F.contains("text", "question")).select("query_id", "id"))


def _held(q, docs):
    """:func:`gold` of questions that every task has: a text's words are met with the anchors, four in a row at a time."""
    anchors, short = {}, []
    for r in q.select("query_id", F.col("question").cast("binary").alias("question")).collect():
        asked = (r.query_id, bytes(r.question))
        words = asked[1].split(b" ")
        if len(words) >= ANCHOR + 2:
            anchors.setdefault(tuple(words[1 : 1 + ANCHOR]), []).append(asked)
        else:
            short.append(asked)
    shared = q.sparkSession.sparkContext.broadcast((anchors, short))

    def run(batches):
        anchors, short = shared.value
        for batch in batches:
            query_ids, at = [], []
            for n, text in enumerate(batch.column(1)):
                text = text.as_py()
                parts = text.split(b" ")
                maybe = [x for four in anchors.keys() & zip(*(parts[i:] for i in range(ANCHOR)), strict=False) for x in anchors[four]]
                own = [q for q, question in maybe + short if question in text]
                query_ids += own
                at += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))], ["query_id", "id"])

    return docs.where("text is not null").select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "query_id long, id long")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).where(F.col("id") % VECTOR_QUERIES == 0).select(F.col("id").alias("query_id"), "vector", "label")


def conversations_qa(spark, sf_dir):
    """Each user turn with the next turn as its answer, and two made-up references."""
    from pyspark.sql import Window

    turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(turn)).where("role = 'user'")
    key = F.col("conv_id") * 100 + F.col("turn")
    first, second = F.col("conv_id") * 7 % 1050, F.col("conv_id") % 400
    return rows.select(
        key.alias("query_id"), F.col("text").alias("question"), F.coalesce("answer", F.lit(" ")).alias("answer"), F.array(first, second).alias("match_id"),
        F.array(F.concat(F.lit("src"), (first % 20).cast("string")), F.lit("src3")).alias("match_name"),
    )


def related(spark, sf_dir):
    """(query_id, pos, name, text): what each document says of itself and, for every fourth, of the next; partly altered."""
    c = named_corpus(spark, sf_dir)
    text = F.when((F.col("id") % 3 == 1) | (F.col("id") % 50 == 49), F.concat("text", F.lit(" x"))).otherwise(F.concat(F.lit("\n "), "text", F.lit("\r\n")))
    name = F.when((F.col("id") % 5 == 0) | (F.col("id") % 50 == 49), F.concat("name", F.lit("?"))).otherwise(F.col("name"))
    own = c.select(F.col("id").alias("query_id"), F.lit(0).alias("pos"), name.alias("name"), text.alias("text"))
    other = c.where("id % 4 = 1").select((F.col("id") - 1).alias("query_id"), F.lit(1).alias("pos"), "name", "text")
    return own.union(other)


def references(spark, sf_dir):
    """(query_id, match_id, match_name): each document and, for every fourth, the next one."""
    c = named_corpus(spark, sf_dir)
    nxt = c.select((F.col("id") - 1).alias("id"), F.col("name").alias("other"))
    both = (F.col("id") % 4 == 0) & F.col("other").isNotNull()
    mine = F.when(both & (F.col("id") % 8 == 4), F.array(F.col("id") + 1, "id")).when(both, F.array("id", F.col("id") + 1)).otherwise(F.array("id"))
    names = F.when(both & (F.col("id") % 8 == 4), F.array("other", "name")).when(both, F.array("name", "other")).otherwise(F.array("name"))
    return c.join(nxt, "id", "left").select(F.col("id").alias("query_id"), mine.alias("match_id"), names.alias("match_name"))


_WS = WHITE.replace("'", "''")


def key_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({column}, ''), '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


#: Common table expressions in order; a query's SQL is all of them and its own SELECT.
CTES = {
    "corpus": "SELECT doc_id AS id, source AS name, text FROM documents",
    "q": "SELECT item_id AS query_id, text AS question FROM benchmark",
    "gold": "SELECT query_id, id FROM corpus, q WHERE question <> '' AND contains(text, question)",
    "dt": f"SELECT id, [lower(x) FOR x IN regexp_extract_all(coalesce(name, '') || ' ' || coalesce(text, ''), '{TOKEN}')] AS toks FROM corpus",
    "qt": f"SELECT DISTINCT query_id, unnest([lower(x) FOR x IN regexp_extract_all(coalesce(question, ''), '{TOKEN}')]) AS term FROM q",
    "lens": "SELECT id, CAST(len(toks) AS BIGINT) AS dl FROM dt",
    "stats": "SELECT count(*) AS n, coalesce(avg(dl), 0.0) AS avgdl FROM lens",
    "tf": "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM dt) GROUP BY id, term",
    "dfs": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "scored": "SELECT query_id, tf.id AS id, sum(ln(1.0 + (CAST(n AS DOUBLE) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN lens ON lens.id = tf.id, stats GROUP BY query_id, tf.id",
    "lex": "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored",
    "ovl": "SELECT query_id, id, CAST(matched AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, id) AS rank FROM scored",
    "fus": f"SELECT query_id, id, sum(1.0::DOUBLE / ({CONSTANT} + rank)) AS score FROM (SELECT query_id, id, rank FROM lex WHERE rank <= {POOL} UNION ALL SELECT query_id, id, rank FROM ovl WHERE rank <= {POOL}) GROUP BY query_id, id",
    "hyb": "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fus",
    "lists": f"SELECT 'bm25' AS retriever, query_id, rank, score, id FROM lex WHERE rank <= {TOP} UNION ALL SELECT 'dense', query_id, rank, score, id FROM ovl WHERE rank <= {TOP} UNION ALL SELECT 'hybrid', query_id, rank, score, id FROM hyb WHERE rank <= {TOP}",
    "pq": """SELECT retriever, query_id, CAST(coalesce(f <= 1, false) AS DOUBLE) AS hit_at_1, CAST(coalesce(f <= 5, false) AS DOUBLE) AS hit_at_5, CAST(coalesce(f <= 10, false) AS DOUBLE) AS hit_at_10,
        coalesce(c1 / g, 0.0::DOUBLE) AS recall_at_1, coalesce(c5 / g, 0.0::DOUBLE) AS recall_at_5, coalesce(c10 / g, 0.0::DOUBLE) AS recall_at_10, coalesce(1.0::DOUBLE / f, 0.0::DOUBLE) AS mrr
        FROM (SELECT retriever, query_id FROM q, (SELECT DISTINCT retriever FROM lists))
        LEFT JOIN (SELECT query_id, CAST(count(*) AS DOUBLE) AS g FROM gold GROUP BY query_id) USING (query_id)
        LEFT JOIN (SELECT retriever, query_id, min(rank) AS f, count(*) FILTER (WHERE rank <= 1) AS c1, count(*) FILTER (WHERE rank <= 5) AS c5, count(*) FILTER (WHERE rank <= 10) AS c10 FROM lists JOIN gold USING (query_id, id) GROUP BY ALL) USING (retriever, query_id)""",
    "flags": "SELECT query_id, coalesce(bool_or(retriever = 'bm25' AND hit), false) AS bm25, coalesce(bool_or(retriever = 'dense' AND hit), false) AS dense, coalesce(bool_or(retriever = 'hybrid' AND hit), false) AS hybrid FROM q LEFT JOIN (SELECT l.query_id, retriever, true AS hit FROM lists l JOIN gold USING (query_id, id)) USING (query_id) GROUP BY query_id",
    "cats": """SELECT query_id, unnest(list_filter([CASE WHEN bm25 AND NOT dense THEN 'bm25_success_dense_failure' END, CASE WHEN dense AND NOT bm25 THEN 'dense_success_bm25_failure' END, CASE WHEN NOT bm25 AND NOT dense THEN 'both_bm25_dense_failure' END,
        CASE WHEN hybrid AND NOT bm25 AND NOT dense THEN 'hybrid_rescue' END, CASE WHEN NOT hybrid AND (bm25 OR dense) THEN 'hybrid_regression' END], lambda x: x IS NOT NULL)) AS category FROM flags""",
    "vq": f"SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % {VECTOR_QUERIES} = 0",
    "vd": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "qa": "SELECT conv_id * 100 + turn AS query_id, text AS question, coalesce(answer, ' ') AS answer, [conv_id * 7 % 1050, conv_id % 400] AS match_id, ['src' || (conv_id * 7 % 1050 % 20), 'src3'] AS match_name FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user'",
    "refs": "SELECT query_id, pos - 1 AS pos, match_id[pos] AS gold_id, match_name[pos] AS gold_name FROM (SELECT query_id, match_id, match_name, unnest(range(1, 3)) AS pos FROM qa)",
    "nqa": "SELECT query_id, pos, gold_id, gold_name, c.id IS NOT NULL AS there, c.name AS corpus_name, c.text AS gold_text FROM refs LEFT JOIN corpus c ON c.id = gold_id",
    "named": "SELECT doc_id AS id, concat_ws('-', lang, source, CAST(n_chars AS VARCHAR)) AS name, text FROM documents",
    "rel": "SELECT * FROM (SELECT id AS query_id, 0 AS pos, CASE WHEN id % 5 = 0 OR id % 50 = 49 THEN name || '?' ELSE name END AS name, CASE WHEN id % 3 = 1 OR id % 50 = 49 THEN text || ' x' ELSE chr(10) || ' ' || text || chr(13) || chr(10) END AS text FROM named UNION ALL SELECT id - 1, 1, name, text FROM named WHERE id % 4 = 1)",
    "keyed": f"SELECT id, {key_sql('name')} AS kn, {key_sql('text')} AS kt FROM named",
    "asked": f"SELECT query_id, pos, name, {key_sql('name')} AS kn, {key_sql('text')} AS kt FROM rel",
    "lv": """SELECT query_id, pos, name, CASE WHEN coalesce(len(p), 0) = 1 THEN 'A_exact_name_and_text' WHEN coalesce(len(t), 0) = 1 THEN 'B_exact_text_unique' WHEN coalesce(len(m), 0) = 1 THEN 'C_exact_name_unique' WHEN coalesce(len(p), 0) + coalesce(len(t), 0) + coalesce(len(m), 0) > 0 THEN 'D_ambiguous' ELSE 'D_unresolved' END AS level,
        CASE WHEN coalesce(len(p), 0) = 1 THEN p WHEN coalesce(len(t), 0) = 1 THEN t WHEN coalesce(len(m), 0) = 1 THEN m ELSE list_sort(list_distinct(coalesce(p, []) || coalesce(t, []) || coalesce(m, []))) END AS cand, p, t, m
        FROM asked LEFT JOIN (SELECT kn, kt, list(id ORDER BY id) AS p FROM keyed GROUP BY kn, kt) USING (kn, kt) LEFT JOIN (SELECT kt, list(id ORDER BY id) AS t FROM keyed GROUP BY kt) USING (kt) LEFT JOIN (SELECT kn, list(id ORDER BY id) AS m FROM keyed GROUP BY kn) USING (kn)""",
    "lvr": "SELECT query_id, pos, name, level, cand, CASE WHEN level[1] <> 'D' THEN cand[1] END AS rid FROM lv",
    "refq": "SELECT a.id AS query_id, CASE WHEN a.id % 4 = 0 AND b.id IS NOT NULL THEN CASE WHEN a.id % 8 = 4 THEN [a.id + 1, a.id] ELSE [a.id, a.id + 1] END ELSE [a.id] END AS ids, CASE WHEN a.id % 4 = 0 AND b.id IS NOT NULL THEN CASE WHEN a.id % 8 = 4 THEN [b.name, a.name] ELSE [a.name, b.name] END ELSE [a.name] END AS names FROM named a LEFT JOIN named b ON b.id = a.id + 1",
    "items": "SELECT query_id, count(*) AS k, list(name ORDER BY pos) AS rn, coalesce(list(rid ORDER BY pos) FILTER (WHERE rid IS NOT NULL), []) AS res, bool_and(level[1] IN ('A', 'B')) AS high, bool_and(rid IS NOT NULL) AS allres, bool_or(level = 'D_ambiguous') AS amb FROM lvr GROUP BY query_id",
    "recs": """SELECT query_id, ids, coalesce(res, []) AS res, list_sort(list_distinct(coalesce(res, []))) AS rec, coalesce(high, false) AS high, coalesce(allres, false) AS allres, coalesce(amb, false) AS amb, coalesce(k, 0) AS k,
        list_sort(list_distinct(ids)) = list_sort(list_distinct(coalesce(res, []))) AS same, coalesce(names = rn, false) AS clean FROM refq LEFT JOIN items USING (query_id)""",
    "rec": "SELECT *, CASE WHEN k = 0 THEN 'unresolved' WHEN allres AND same THEN CASE WHEN clean AND ids = res THEN 'clean' ELSE 'order_only_conflict' END WHEN allres THEN 'true_set_conflict' WHEN len(res) > 0 THEN 'partially_resolved' WHEN amb THEN 'ambiguous' ELSE 'unresolved' END AS status FROM recs",
    "blk": "SELECT retriever, query_id, rank, id, '[法条ID ' || id || '] ' || name || chr(10) || text AS block FROM lists JOIN corpus USING (id)",
    "ev": "SELECT retriever, query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS evidence, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM blk GROUP BY ALL",
    "pk": "SELECT query_id, rank, id, block, length(question) + 5 + sum(length(block)) OVER w + 2 * (count(*) OVER w - 1) AS used FROM blk JOIN q USING (query_id) WHERE retriever = 'bm25' WINDOW w AS (PARTITION BY query_id ORDER BY rank)",
    "pkd": "SELECT query_id, question, coalesce(evidence, '') AS evidence, coalesce(ids, []) AS ids, 'Q=' || question || ' E=' || coalesce(evidence, '') AS prompt FROM q LEFT JOIN (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS evidence, list(id ORDER BY rank) AS ids FROM pk WHERE used <= 9000 GROUP BY query_id) USING (query_id)",
    "pr": "SELECT 'direct' AS method, query_id, 'Q=' || question AS prompt FROM q UNION ALL SELECT r.retriever, q.query_id, 'Q=' || question || ' E=' || coalesce(evidence, '') FROM q CROSS JOIN (SELECT DISTINCT retriever FROM lists) r LEFT JOIN ev ON ev.query_id = q.query_id AND ev.retriever = r.retriever",
    "mk": r"SELECT method, query_id, length(prompt) AS size, unnest(range(1, len(regexp_extract_all(prompt, '\[法条ID (\d+)\]')) + 1)) AS i, regexp_extract_all(prompt, '\[法条ID (\d+)\]') AS ms, regexp_extract_all(prompt, '\[法条ID (\d+)\]', 1) AS ns, regexp_split_to_array(prompt, '\[法条ID (?:\d+)\]') AS gs FROM pr",
    "sp": "SELECT method, query_id, size, i - 1 AS pos, CAST(ns[i] AS BIGINT) AS id, sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY method, query_id ORDER BY i) - length(ms[i]) AS st FROM mk",
    "spn": "SELECT method, query_id, pos, id, CAST(st AS BIGINT) AS st, CAST(coalesce(lead(st) OVER (PARTITION BY method, query_id ORDER BY pos), size) AS BIGINT) AS en FROM sp",
    "au": "SELECT p.method, p.query_id, CAST(length(p.prompt) AS BIGINT) AS tokens, length(p.prompt) > 9000 AS truncated, coalesce(v, []) AS v, coalesce(f, []) AS f, coalesce(r, []) AS r FROM pr p LEFT JOIN (SELECT method, query_id, list(id ORDER BY pos) FILTER (WHERE st < 9000) AS v, list(id ORDER BY pos) FILTER (WHERE en <= 9000) AS f, list(id ORDER BY pos) FILTER (WHERE st < 9000 AND en > 9000) AS r FROM spn GROUP BY ALL) s USING (method, query_id)",
    "runs": "SELECT a.*, CASE WHEN query_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, b.ids AS included, length(b.prompt) AS packed FROM au a LEFT JOIN pkd b USING (query_id)",
}


def sql(select: str) -> str:
    """A query's SQL: the expressions it needs, in order, and its SELECT."""
    import re

    needed, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {body}\n{select}" if body else select
