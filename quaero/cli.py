"""Command line: ``spark-submit quaero/cli.py STAGE ...`` over files of a corpus and questions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quaero.operators import bootstrap, fusion, lexical, metrics, quality, ranking, reconcile
from quaero.sources import files

QA = "query_id long, `问题` string, `答案文本` string, match_id array<long>, match_name array<string>, `相关法规` map<string,string>"


def _corpus(spark, path: str):
    return quality.normalize_corpus(files.read_jsonl(spark, path, files.CORPUS))


def _qa(spark, path: str):
    raw = files.read_json(spark, path, QA)
    return raw.select("query_id", F.col("问题").alias("question"), F.col("答案文本").alias("answer"), "match_id", "match_name", F.map_entries("相关法规").alias("related"))


def prepare(spark, a) -> None:
    """Normalize and validate a corpus and questions; write both as Parquet, and statistics."""
    corpus, qa = _corpus(spark, a.corpus), _qa(spark, a.questions)
    rows = quality.normalize_qa(qa, corpus)
    quality.validate(rows, corpus)
    corpus.write.mode("overwrite").parquet(f"{a.output}/corpus")
    rows.write.mode("overwrite").parquet(f"{a.output}/questions")
    quality.statistics(rows, corpus).write.mode("overwrite").json(f"{a.output}/statistics")
    quality.seeded_sample(rows, "query_id", a.sample_count).write.mode("overwrite").json(f"{a.output}/sample")


def inspect(spark, a) -> None:
    """Show statistics and violations without writing."""
    corpus = _corpus(spark, a.corpus)
    rows = quality.normalize_qa(_qa(spark, a.questions), corpus)
    quality.statistics(rows, corpus).show(truncate=False)
    quality.validation_report(rows, corpus).show(a.sample_count, truncate=False)


def retrieve(spark, a) -> None:
    """Search all questions that the output doesn't have yet; write ranked lists and metrics."""
    corpus = spark.read.parquet(f"{a.prepared}/corpus")
    rows = spark.read.parquet(f"{a.prepared}/questions")
    wanted = rows.select("query_id", "question")
    if a.mode == "smoke":
        wanted = quality.seeded_sample(wanted, "query_id", 10, a.seed)
    if not a.no_resume and files._exists(spark, f"{a.output}/ranked"):
        wanted = ranking.pending(wanted, spark.read.parquet(f"{a.output}/ranked"), ["query_id"])
    model = lexical.Bm25(a.k1, a.b)
    scores = lexical.score(wanted, corpus, model).persist()
    lex = ranking.top_k(scores.select("query_id", "id", "score"), a.pool)
    ovl = ranking.top_k(scores.select("query_id", "id", F.col("matched").cast("double").alias("score")), a.pool)
    out = {"bm25": lex.where(F.col("rank") <= a.top_k), "hybrid": fusion.fuse([lex, ovl], a.top_k, a.pool, a.rrf_k)}
    for name, ranked in out.items():
        ranked.select(F.lit(name).alias("retriever"), "query_id", "rank", "score", "id").write.mode("overwrite" if a.no_resume and name == "bm25" else "append").parquet(f"{a.output}/ranked")
    ranked, gold = spark.read.parquet(f"{a.output}/ranked"), rows.select("query_id", F.explode("gold_ids").alias("id"))
    found = ranked.select("query_id").distinct()
    for name in out:
        own = metrics.per_query(found, ranked.where(F.col("retriever") == name), gold)
        files.write_csv(metrics.summary(own).withColumn("retriever", F.lit(name)), f"{a.output}/metrics-{name}")


def reconcile_gold(spark, a) -> None:
    """Resolve each question's related rows in the corpus; write all rows, those that aren't clean, and counts."""
    qa = _qa(spark, a.questions)
    related = qa.select("query_id", F.posexplode(F.transform("related", lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))).alias("pos", "r")).select("query_id", "pos", "r.name", "r.text")
    rows = reconcile.reconcile(qa.select("query_id", "match_id", "match_name"), related, _corpus(spark, a.corpus)).persist()
    rows.write.mode("overwrite").parquet(f"{a.output}/rows")
    rows.where("status <> 'clean'").write.mode("overwrite").json(f"{a.output}/cases")
    reconcile.counts(rows).write.mode("overwrite").json(f"{a.output}/counts")


def evaluate(spark, a) -> None:
    """Metrics of stored ranked lists under every gold definition, and paired intervals."""
    ranked, rows = spark.read.parquet(f"{a.output}/ranked"), spark.read.parquet(a.reconciled)
    if gap := quality.coverage_gaps(rows, ranked).limit(1).collect():
        raise quality.InvalidData(f"ranked lists and gold don't cover the same queries: {gap[0]}")
    by = metrics.by_subset(ranked, metrics.subsets(rows)).persist()
    files.write_csv(metrics.summary(by, "gold_definition", "retriever"), f"{a.output}/subsets")
    values = by.select("gold_definition", "retriever", "query_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics.NAMES])))
    names = sorted(r[0] for r in ranked.select("retriever").distinct().collect())
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    files.write_csv(bootstrap.paired(values, ["gold_definition"], pairs, a.bootstrap_samples, a.seed), f"{a.output}/bootstrap")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="stage", required=True)

    def stage(f, *options):
        s = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        s.set_defaults(run=f)
        for name, kind, default in options:
            s.add_argument(f"--{name}", type=kind, default=default, required=default is None)

    both = [("corpus", str, None), ("questions", str, None)]
    stage(prepare, *both, ("output", str, None), ("sample-count", int, 10))
    stage(inspect, *both, ("sample-count", int, 10))
    stage(retrieve, ("prepared", str, None), ("output", str, None), ("mode", str, "smoke"), ("top-k", int, 10), ("pool", int, 50), ("rrf-k", int, 60), ("k1", float, 1.5), ("b", float, 0.75), ("seed", int, 42), ("no-resume", lambda v: v != "0", False))
    stage(reconcile_gold, *both, ("output", str, None))
    stage(evaluate, ("reconciled", str, None), ("output", str, None), ("bootstrap-samples", int, 10_000), ("seed", int, 42))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
