"""Secret scans over an incremental ledger of content-addressed blobs.

Every row of the input is one version of a text at a path.  A version's blob is
named by the SHA-256 of its text; the ledger records, for each blob and rule-set
version, what was found.  A run scans one copy of each blob that the ledger
doesn't have for the rules in use, appends the findings, and joins them back to
all paths.  Everything is built-in SQL functions: spans come from the pieces
between the matches (``split``) and the matches (``regexp_extract_all``), whose
lengths are summed by a window over one blob's matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.scratch import Scratch, shuffle_cleanup
from quaero.llm.skew import free_name, lookup


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the length that a group of a match needs."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds first, in the order in which spans with equal starts are listed.
BASE = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
)
RULES = (*BASE, *MORE)


def rules_version(rules) -> str:
    """A name for a rule set that changes with any pattern."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<kind, i, gap, size, ok>> of a rule's matches in a text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("match"), tested.alias("tested"))
    made = F.transform(
        F.filter(found, lambda m: m["match"].isNotNull()),
        lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), (F.length(m["tested"]) >= rule.least).alias("ok")),
    )
    return F.when(F.rlike(text, F.lit(rule.pattern)), made)


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, found array<struct<start, kind, end>>) of the blobs (blob, text) in which any rule finds a secret.

    Matches of one rule are leftmost and don't overlap; a match that is too
    short is dropped, but its characters are passed over.
    """
    text = F.col("text")
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>)")
    every = F.concat(*[F.coalesce(_matches(text, n, r), none) for n, r in enumerate(rules)])
    rows = blobs.select("blob", F.explode(every).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)).where("ok")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))).alias("found"))


def _listed(found: Column, rules) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blob(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def _found(docs: DataFrame, scratch: Scratch, ledger: str | None, rules, text_col: str) -> tuple[DataFrame, int]:
    """((blob, n, found) of every blob of ``docs``, rows of ``docs``): n rows have it, found is null where nothing was found.

    Blobs that the ledger doesn't have under these rules are scanned, one copy
    each, and appended to it with what was found.
    """
    spark, version = docs.sparkSession, rules_version(rules)
    ledger = ledger or f"{scratch.root}/ledger"
    uses = scratch.table(docs.select(_blob(text_col).alias("blob")).groupBy("blob").agg(F.count("*").alias("n")))
    known = _read_ledger(spark, ledger)
    texts = docs.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unseen = uses.select("blob")
    if known is not None:
        unseen = scratch.table(unseen.join(known.where(F.col("version") == version).select("blob"), "blob", "left_anti"))
        texts = texts.join(unseen, "blob", "left_semi")
    found = find_spans(texts.groupBy("blob").agg(F.first("text").alias("text")), rules)
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    with shuffle_cleanup(spark):
        unseen.join(found, "blob", "left").select("blob", F.lit(version).alias("version"), F.coalesce("found", empty).alias("found")).write.mode("append").parquet(ledger)
    telling = _read_ledger(spark, ledger).where((F.col("version") == version) & (F.size("found") > 0)).dropDuplicates(["blob"]).select("blob", "found")
    return scratch.table(uses.join(telling, "blob", "left")), uses.agg(F.sum("n")).first()[0] or 0


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, found) for each row of ``docs``; found is null where nothing was found.

    ``ledger`` is the folder of a ledger kept between runs; a blob that it has
    under these rules is not scanned again.  Without one, a new ledger is kept
    in the scratch folder for this run.  A null text counts as empty; a null
    doc_id is kept; repeated rows each give a row; no other columns are read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found, total = _found(docs, scratch, ledger, rules, text_col)
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), _blob(text_col).alias("blob"))
    # every blob is in the lookup, so that one that many paths have is hot whether or not anything was found in it
    return lookup(paths, found, "blob", "n", total).select("doc_id", "blob", "found")


_LEDGER = "blob string, version string, found array<struct<start:bigint,kind:int,end:bigint>>"


def _read_ledger(spark, ledger: str) -> DataFrame | None:
    """The ledger's rows, None for a ledger that doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_LEDGER).parquet(ledger)


def report(found: DataFrame, rules=RULES) -> DataFrame:
    """The digest of :func:`scan`: counts of the base kinds, the base spans' SHA-256, and all spans as text."""
    spans = F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(spans, rules).alias("spans"))


#: What takes a document out of the pipeline: as the rules above, but a run of digits alone (a card, an order number) is no credential.
DECIDING = tuple(Rule("hex", r"(?<![0-9a-f])(?=[0-9]*[a-f])[0-9a-f]{16,}") if r.kind == "hex" else r for r in RULES)


def drop_secret(docs: DataFrame, ledger: str | None = None, rules=DECIDING) -> DataFrame:
    """The rows of ``docs`` in whose text no secret is found by ``rules``, with all their columns.

    Verdicts are joined back by the text's blob, so each row is judged by its
    own text, with or without doc_id; null and empty texts stay.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found, total = _found(docs, scratch, ledger, rules, "text")
    blob, n, leaks = (free_name(c, docs) for c in ("_blob", "_n", "_leaks"))
    verdict = found.select(F.col("blob").alias(blob), F.col("n").alias(n), F.col("found").isNotNull().alias(leaks))
    return lookup(docs.withColumn(blob, _blob("text")), verdict, blob, n, total).where(~F.col(leaks)).select(*docs.columns)


def sql(rules=RULES) -> str:
    """DuckDB SQL for :func:`report` of ``documents``."""

    def one(number, rule):
        pattern = rule.pattern.replace("'", "''")
        return f"SELECT doc_id, {number} AS kind, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs, {rule.least} AS least FROM d"

    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(one(n, r) for n, r in enumerate(rules))}),
p AS (SELECT doc_id, kind, i, length(ms[i]) AS size, length(gs[i]) >= least AS ok, sum(length(gaps[i]) + length(ms[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
f AS (SELECT doc_id, kind, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE ok),
g AS (SELECT doc_id, {counts}, coalesce({listed} FILTER (WHERE kind < {len(BASE)}), '') AS base, {listed} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
