import json

import pytest
from pyspark.sql import functions as F

from quaero.operators import evidence as ev
from quaero.operators import generation, reports
from quaero.sources import files
from quaero.streaming import runs

CORPUS = [(1, "n1", "t1"), (2, "n2", "t2")]


@pytest.fixture
def parts(spark):
    corpus = spark.createDataFrame(CORPUS, "id long, name string, text string")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 99), (1, 3, 2)], "query_id long, rank int, id long")
    return corpus, ranked, spark.createDataFrame([(1, "Question {x}"), (2, "none")], "query_id long, question string")


def test_blocks_skip_unknown_ids_after_the_cut(parts):
    corpus, ranked, _ = parts
    assert [(r.id, r.block) for r in ev.blocks(ranked, corpus).orderBy("rank").collect()] == [(1, "[法条ID 1] n1\nt1"), (2, "[法条ID 2] n2\nt2")]
    assert [r.id for r in ev.blocks(ranked, corpus, 2).collect()] == [1]


def test_render_does_not_rescan(spark, parts):
    q = parts[2].where("query_id = 1").select(ev.prompt("bm25", ev.Templates(), F.col("question"), F.lit("{question}")).alias("p"), ev.prompt("direct", ev.Templates("{{{question}}}"), F.col("question")).alias("d")).first()
    assert (q.p, q.d) == ("Q=Question {x} E={question}", "{Question {x}}")
    with pytest.raises(ValueError):
        ev.prompt("other", ev.Templates(), F.lit(""))


@pytest.mark.parametrize("budget, ids", [(1000, [1, 2]), (45, [1]), (10, [])])
def test_packing(parts, budget, ids):
    corpus, ranked, q = parts
    found = ev.blocks(ranked, corpus)
    out = {r.query_id: r for r in ev.pack(q, found, budget).collect()}
    same = {r.query_id: r for r in ev.pack_with(len, q.select("query_id", F.regexp_replace("question", "[{}]", "").alias("question")), found, budget - 2).collect()}
    assert out[1].included_ids == ids == same[1].included_ids and out[1].tokens == len(out[1].prompt) and out[2].included_ids == []
    if ids:
        assert out[1].tokens <= budget


def chars(text):
    return [(i, i + 1) for i in range(len(text))]


@pytest.mark.parametrize("limit, visible, full, partial", [(200, [1], [1], []), (10, [1], [], [1]), (6, [], [], [])])
def test_audit(spark, limit, visible, full, partial):
    prompts = spark.createDataFrame([(1, "Q=Q E=[法条ID 1] n1\nt1"), (2, "no block")], "query_id long, prompt string")
    for out in (ev.audit(prompts, limit), ev.audit_with(chars, prompts, limit)):
        row = out.where("query_id = 1").first()
        assert (row.visible, row.full, row.partial, row.tokens, row.truncated) == (visible, full, partial, 20, 20 > limit)
        assert out.where("query_id = 2").first().visible == []


def test_marker_spans(spark):
    rows = ev.marker_spans(spark.createDataFrame([(1, "a[法条ID 7]bc[法条ID 8]")], "query_id long, prompt string")).orderBy("pos").collect()
    assert [(r.id, r.start, r.end) for r in rows] == [(7, 1, 11), (8, 11, 19)]


def test_generation_goes_on_and_records_failures(spark):
    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("CUDA ran out of memory")
        return prompt.upper()

    prompts = spark.createDataFrame([("bm25", 1, "good"), ("bm25", 2, "bad"), ("bm25", 3, "done")], "method string, query_id long, prompt string")
    done = spark.createDataFrame([("run", "bm25", 3), ("other", "bm25", 1)], "run_id string, method string, query_id long")
    out = {r.query_id: r for r in generation.generate(prompts, model, done=done).collect()}
    assert set(out) == {1, 2} and out[1].answer == "GOOD" and out[2].status == "error" and out[2].error.type == "cuda_oom"


def test_summary_and_acceptance(spark):
    schema = "query_id long, prompt string, status string, truncated boolean, tokens long, packed_tokens long, visible array<long>, full array<long>, partial array<long>, included array<long>"
    rows = [(1, "[法条ID 1] x", "ok", False, 5, 4, [1], [1], [], [1]), (2, "x", "ok", True, 9, None, [1], [], [1], [1])]
    row = reports.acceptance(reports.run_summary(spark.createDataFrame(rows, schema), packed=True), 2).first()
    assert (row.record_count, row.truncation_rate, row.partial_blocks, row.full_blocks, row.consistency_failures, row.marker_missing, row.token_mean, row.token_max, row.all_ok, row.ready) == (2, 0.5, 1, 1, 1, 1, 6.5, 9, True, False)
    empty = reports.run_summary(spark.createDataFrame([], schema)).first()
    assert empty.record_count == 0 and empty.truncation_rate is None and empty.token_mean is None


def test_files(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    open(path, "w").write('{"id": "1", "name": "法", "content": "é"}\n\n{"id": "2"}\n')
    assert [r.id for r in files.read_jsonl(spark, path, files.CORPUS).orderBy("id").collect()] == ["1", "2"]
    open(path, "a").write("{broken\n")
    with pytest.raises(files.BadLine):
        files.read_jsonl(spark, path, files.CORPUS)
    assert files.read_jsonl(spark, path, files.CORPUS, strict=False).count() == 2
    assert [(r.line, r.value) for r in files.bad_lines(spark, path).collect()] == [(4, "{broken")]
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.CORPUS, strict=False).count() == 0
    files.write_jsonl(spark.createDataFrame([(1, "法")], "a long, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().b == "法"
    files.write_csv(spark.createDataFrame([(1, "x")], "a long, b string"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).first().asDict() == {"a": "1", "b": "x"}
    assert files.byte_ranges(10, 4) == [(0, 0, 3), (1, 4, 7), (2, 8, 9)]


def test_cache_hits_only_the_same_manifest(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for manifest in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert files.cached(spark, str(tmp_path / "c"), manifest, build).count() == 3
    assert len(built) == 2


def test_config_chain(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"a": 1, "b": 2}, "y": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"base_config": "a.json", "x": {"b": 3}}))
    assert files.load_config(str(tmp_path / "b.json")) == {"x": {"a": 1, "b": 3}, "y": 1}


def test_fingerprint(spark):
    import hashlib

    table = spark.createDataFrame([(2, "b", "y"), (1, "a", None)], "i long, n string, t string")
    expected = hashlib.sha256(b"1\0a\0\n2\0b\0y\n").hexdigest()
    assert files.fingerprint(table, "i", "i", "n", "t").first().sha256 == expected


def test_stream_folds_new_files_only(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "query_id long, line long, v string"
    for n, rows in enumerate(([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        runs.fold_log(spark, source, schema, target, check, ["query_id"], ["line"])
        assert spark.read.parquet(target).count() == (1, 3)[n]
    assert {r.query_id: r.v for r in runs.latest(spark, target, ["query_id"], ["line"]).collect()} == {1: "c", 2: "z"}


def test_command_line(spark, tmp_path):
    from quaero import cli

    (tmp_path / "c.jsonl").write_text('{"id": 1, "name": "法甲", "content": "甲文"}\n{"id": 2, "name": "法乙", "content": "乙文"}\n')
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": 1, "问题": "甲文？", "答案文本": "a", "match_id": [1], "match_name": ["法甲"], "相关法规": {"法甲": "甲文"}}]))
    p = {k: str(tmp_path / v) for k, v in {"c": "c.jsonl", "q": "q.json", "p": "prepared", "r": "rec", "o": "out"}.items()}
    cli.main(["prepare", "--corpus", p["c"], "--questions", p["q"], "--output", p["p"]])
    cli.main(["retrieve", "--prepared", p["p"], "--output", p["o"], "--mode", "full"])
    cli.main(["retrieve", "--prepared", p["p"], "--output", p["o"], "--mode", "full"])
    cli.main(["reconcile-gold", "--corpus", p["c"], "--questions", p["q"], "--output", p["r"]])
    cli.main(["evaluate", "--reconciled", p["r"] + "/rows", "--output", p["o"], "--bootstrap-samples", "100"])
    assert files.read_csv(spark, p["o"] + "/subsets").where("gold_definition = 'raw_clean' and retriever = 'bm25'").first().mrr == "1.0"
    assert spark.read.parquet(p["o"] + "/ranked").where("retriever = 'bm25'").count() == spark.read.parquet(p["o"] + "/ranked").where("retriever = 'bm25'").distinct().count()


def test_acceptance_expects_a_record_of_each_question(spark, monkeypatch):
    from quaero.plans import evidence as plans

    schema = "method string, query_id long, status string, truncated boolean, visible array<long>, full array<long>, partial array<long>, included array<long>, tokens long, packed_tokens long, prompt string"
    for answered, whole in ((3, True), (2, False)):
        rows = [("bm25", i, "ok", False, [1], [1], [], [1], 5, 5, "[法条ID 1] x") for i in range(answered)]
        monkeypatch.setattr(plans.t, "questions", lambda spark, sf_dir: spark.range(3).withColumnRenamed("id", "query_id"))
        monkeypatch.setattr(plans, "_records", lambda spark, sf_dir, rows=rows: spark.createDataFrame(rows, schema))
        row = plans.acceptance_flags(spark, "").first()
        assert (row.all_ok, row.ready) == (whole, whole)


def test_fingerprint_packs_sorted_ranges(spark, monkeypatch):
    """Many partitions and chunks, equal orders, nulls and no rows; no task holds the rows in one array."""
    import hashlib

    rows = [(i % 40 if i % 7 else None, f"n{i}", None if i % 5 == 0 else "é" * (i % 9)) for i in range(300)]
    monkeypatch.setattr(files, "CHUNK", 64)
    table = spark.createDataFrame(rows, "i long, n string, t string").repartition(5)
    line = lambda i, n, t: f"{'' if i is None else i}\0{n}\0{t or ''}\n".encode()
    lines = sorted(((i is not None, i or 0), line(i, n, t)) for i, n, t in rows)
    found = files.fingerprint(table, "i", "i", "n", "t")
    assert found.first().sha256 == hashlib.sha256(b"".join(x for _, x in lines)).hexdigest()
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert files.fingerprint(table.limit(0), "i", "i", "n", "t").first().sha256 == hashlib.sha256(b"").hexdigest()
