"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.text import spans
from sentinela.operators import checksums, ethics, evaluate, evidence, mask, provenance, registry, scan, tokens, usage
from sentinela.operators import patterns as P
from sentinela.plans import corpora, guard
from sentinela.plans import oracle as O
from sentinela.streaming.usage import windowed_usage

AT = "2024-01-01T00:00:00.000Z"
SEED = "session-1"
DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
TALK = "SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations"
BLOCKED = ("Maria Silva", "ANVISA")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of ``customer``, dealt over all cores: a file of few bytes is read by few tasks, and each
    key becomes a text that is scanned in the same stage. AQE leaves a given number of partitions alone."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return keys.repartition(3 * spark.sparkContext.defaultParallelism, "c_custkey")


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(corpora.SYNTHETIC.replace("FROM customer", "FROM {customer}"), customer=customers(spark, sf_dir))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(corpora.SPOKEN.replace("FROM customer", "FROM {customer}"), customer=customers(spark, sf_dir))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, whoever speaks."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_CORPORA = {"synthetic": (synthetic, corpora.SYNTHETIC), "documents": (docs, DOCS), "conversations": (talk, TALK)}
_GROUPS = {"defaults": P.SCAN, "secrets": P.SECRETS, "profile": P.PROFILE_PCMG}


def _counts(make, patterns):
    def run(spark, sf_dir):
        text = F.col("text")
        n = [F.sum(F.size(spans(text, p.source, p.flags))).cast("long").alias(p.id) for p in patterns]
        one = make(spark, sf_dir).agg(*n)
        return one.select(F.explode(F.array(*[F.struct(F.lit(p.id).alias("pattern"), F.coalesce(F.col(f"`{p.id}`"), F.lit(0).cast("long")).alias("n")) for p in patterns])).alias("r")).select("r.*")

    return run


def _counts_sql(corpus, patterns):
    ids = ", ".join(f"({O.q(p.id)})" for p in patterns)
    return f"WITH corpus AS ({corpus}), {O.candidates('corpus', patterns, False)} SELECT p.id AS pattern, count(c.id) AS n FROM (VALUES {ids}) p(id) LEFT JOIN cand c ON c.id = p.id GROUP BY p.id"


for _c, (_make, _sql) in _CORPORA.items():
    for _g, _ps in _GROUPS.items():
        if _c == "synthetic" or _g == "defaults":
            query(f"pattern_counts_{_g}_{_c}", _counts_sql(_sql, _ps))(_counts(_make, _ps))


def _exploded(df: DataFrame, found) -> DataFrame:
    return df.select("doc_id", F.explode(found).alias("f"))


_FOUND = 'SELECT doc_id, category, label, start, "end", m AS matched FROM kept'


def _scan_query(make):
    return lambda spark, sf_dir: _exploded(make(spark, sf_dir), scan.scan(F.col("text"))).select("doc_id", "f.category", "f.label", "f.start", "f.end", "f.matched")


for _c, (_make, _sql) in _CORPORA.items():
    query(f"scan_findings_{_c}", O.findings(_sql) + _FOUND)(_scan_query(_make))


@query("detect_pii", O.findings(corpora.SYNTHETIC, P.DEFAULT, False) + 'SELECT doc_id, id AS pattern_id, start, "end", m AS matched FROM kept')
def detect(spark, sf_dir):
    return _exploded(synthetic(spark, sf_dir), scan.detect_pii(F.col("text"))).select("doc_id", "f.pattern_id", "f.start", "f.end", "f.matched")


@query("detect_secrets", O.findings(corpora.SYNTHETIC, P.SECRETS, False) + 'SELECT doc_id, id AS pattern_id, start, "end", m AS matched FROM kept')
def secrets_(spark, sf_dir):
    return _exploded(synthetic(spark, sf_dir), scan.detect_secrets(F.col("text"))).select("doc_id", "f.pattern_id", "f.start", "f.end", "f.matched")


@query("scan_with_profile", O.findings(corpora.SYNTHETIC, (*P.SCAN, *P.PROFILE_PCMG)) + _FOUND)
def with_profile(spark, sf_dir):
    return _exploded(synthetic(spark, sf_dir), scan.scan(F.col("text"), extra=P.PROFILE_PCMG)).select("doc_id", "f.category", "f.label", "f.start", "f.end", "f.matched")


@query("ner_findings", O.findings(corpora.SPOKEN, ner=True) + _FOUND)
def ner(spark, sf_dir):
    return _exploded(spoken(spark, sf_dir), scan.scan(F.col("text"), ner=True)).select("doc_id", "f.category", "f.label", "f.start", "f.end", "f.matched")


@query("offline_findings", O.findings(corpora.SPOKEN, P.OFFLINE, False, by_key=True) + 'SELECT doc_id, category AS key, label, start, "end", m AS matched FROM kept')
def offline(spark, sf_dir):
    return _exploded(spoken(spark, sf_dir), scan.scan_offline(F.col("text"))).select("doc_id", F.col("f.category").alias("key"), "f.label", "f.start", "f.end", "f.matched")


def _policy(make):
    def run(spark, sf_dir):
        d = make(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
        t, f = F.col("text"), F.col("f")
        return d.select(
            "doc_id", mask.masked(t, f).alias("output"), mask.masked(t, f, critical_action="block").alias("blocked_output"), mask.sensitivity(f).alias("sensitivity"),
            mask.disclosure(f).alias("disclosure"), scan.pii_summary(f).alias("summary"), (F.size(f) == 0).alias("public_safe"),
        )

    return run


for _c, (_make, _sql) in _CORPORA.items():
    query(f"mask_policy_{_c}", O.mask_policy(_sql))(_policy(_make))


@query("mask_partial", O.mask_partial(corpora.SYNTHETIC))
def partial(spark, sf_dir):
    return synthetic(spark, sf_dir).select("doc_id", mask.mask_pii(F.col("text"), None, "partial").alias("output"))


@query("mask_partial_strict", O.mask_partial(corpora.SYNTHETIC, P.SCAN, True))
def partial_strict(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    return d.select("doc_id", mask.masked(F.col("text"), F.col("f"), "partial", strict=True).alias("output"))


@query("mask_subset", O.findings(corpora.SYNTHETIC, [p for p in P.DEFAULT if p.id in ("cpf", "email")], False) + O.spliced("k.mask") + " SELECT doc_id, out AS output FROM out")
def subset(spark, sf_dir):
    return synthetic(spark, sf_dir).select("doc_id", mask.mask_pii(F.col("text"), ("cpf", "email")).alias("output"))


@query("mask_actions", O.findings(corpora.SYNTHETIC) + O.grades() + """
SELECT k.doc_id, k.category, CASE WHEN g.sensitivity = 'critical' THEN 'block' ELSE 'redact' END AS action, count(*) AS n, min(k.start) AS first_start, max(k."end") AS last_end
FROM kept k JOIN grade g ON g.doc_id = k.doc_id GROUP BY k.doc_id, k.category, g.sensitivity""")
def actions(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    a = d.select("doc_id", F.explode(mask.actions(F.col("f"), mask.sensitivity(F.col("f")), "block")).alias("a"))
    return a.select("doc_id", "a.category", "a.action", F.col("a.count").cast("long").alias("n"), F.array_min("a.positions")["start"].alias("first_start"), F.element_at("a.positions", -1)["end"].alias("last_end"))


@query("tokens_opaque", O.opaque(corpora.SYNTHETIC, SEED))
def opaque(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    return d.select("doc_id", tokens.tokenize(F.col("text"), F.col("f"), SEED)[0].alias("tokenized"))


@query("tokens_restored", f"SELECT doc_id, text AS restored, FALSE AS still_tokens FROM ({corpora.SYNTHETIC}) t")
def restored(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    text, vault, _ = tokens.tokenize(F.col("text"), F.col("f"), SEED)
    d = d.withColumns({"t": text, "v": vault}).withColumn("restored", tokens.restore(F.col("t"), F.col("v")))
    return d.select("doc_id", "restored", tokens.has_tokens(F.col("restored"), F.col("v")).alias("still_tokens"))


@query("tokens_named_vault", O.named(corpora.SYNTHETIC))
def vault(spark, sf_dir):
    found = _exploded(synthetic(spark, sf_dir), scan.scan(F.col("text"))).select("doc_id", "f.category", "f.start", "f.matched")
    return tokens.named_vault(found)


@query("tokens_named_array", O.named(corpora.SYNTHETIC))
def vault_array(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    return d.select("doc_id", F.explode(tokens.named_entries(F.col("f"))).alias("e")).select("doc_id", "e.token", "e.original")


@query("tokens_named_restored", f"SELECT doc_id, text AS restored FROM ({corpora.SYNTHETIC}) t")
def named_restored(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan(F.col("text")))
    d = d.withColumn("e", tokens.named_entries(F.col("f"))).withColumn("t", tokens.named_tokenize(F.col("text"), F.col("f"), F.col("e")))
    return d.select("doc_id", tokens.restore(F.col("t"), F.col("e")).alias("restored"))


@query("tokens_offline_restored", f"SELECT doc_id, text AS restored FROM ({corpora.SYNTHETIC}) t")
def offline_restored(spark, sf_dir):
    d = synthetic(spark, sf_dir).withColumn("f", scan.scan_offline(F.col("text")))
    d = d.withColumn("e", tokens.named_entries(F.col("f"), is_key=True)).withColumn("t", tokens.named_tokenize(F.col("text"), F.col("f"), F.col("e")))
    return d.select("doc_id", tokens.restore_counted(F.col("t"), F.col("e"))[0].alias("restored"))


def _offline(spark, sf_dir) -> DataFrame:
    return spoken(spark, sf_dir).withColumn("f", scan.scan_offline(F.col("text")))


@query("tokens_offline_vault", O.named(corpora.SPOKEN, offline=True))
def offline_vault(spark, sf_dir):
    # an exploded column, not an expression, gets a filter that Spark pushes below it, with all of the scan copied into it
    e = tokens.named_entries(F.col("f"), is_key=True)
    return _offline(spark, sf_dir).select("doc_id", F.explode(e).alias("e")).select("doc_id", "e.token", "e.original")


@query("tokens_offline_count", O.findings(corpora.SPOKEN, P.OFFLINE, False, by_key=True) + " SELECT c.doc_id, count(k.doc_id) AS n, any_value(c.text) AS restored FROM corpus c LEFT JOIN kept k ON k.doc_id = c.doc_id GROUP BY c.doc_id")
def offline_count(spark, sf_dir):
    d = _offline(spark, sf_dir).withColumn("e", tokens.named_entries(F.col("f"), is_key=True))
    d = d.withColumn("t", tokens.named_tokenize(F.col("text"), F.col("f"), F.col("e")))
    back, n = tokens.restore_counted(F.col("t"), F.col("e"))
    return d.select("doc_id", n.cast("long").alias("n"), back.alias("restored"))


@query("tokens_stats", "SELECT regexp_extract(token, '^\\[([A-Z0-9]+)_', 1) AS key, count(*) AS n FROM (" + O.named(corpora.SYNTHETIC) + ") t GROUP BY 1")
def token_stats(spark, sf_dir):
    return tokens.stats_by_key(vault(spark, sf_dir))


def _ethics(make, blocked, **lists):
    def run(spark, sf_dir):
        d = make(spark, sf_dir).withColumn("v", ethics.violations(F.col("text"), blocked, **lists))
        n = lambda c: F.size(F.filter("v", lambda x: x["category"] == c)).cast("long")
        return d.select(
            "doc_id", n("blocked_entity").alias("n_blocked"), n("invented_acronym").alias("n_acronym"), n("absolute_claim").alias("n_absolute"), n("fabricated_data").alias("n_fabricated"),
            n("false_promise").alias("n_promise"), ethics.score(F.col("v")).alias("score"), ethics.passed(F.col("v")).alias("passed"),
        )

    return run


for _c, (_make, _sql) in _CORPORA.items():
    _b = BLOCKED if _c == "synthetic" else ()
    query(f"ethics_{_c}", O.violations(_sql, _b))(_ethics(_make, _b))


#: Every list of the claims layer replaced.
_OWN = {"known": ("XYZW",), "absolute": (r"\b(limpo|diabetes)\b",), "fabricated": (r"\bplaca\b",), "promise": (r"\b(cliente|contato)\b", "teste"), "context": "portador"}
query("ethics_own_lists", O.violations(corpora.SYNTHETIC, ("teste", "situa"), **_OWN))(_ethics(synthetic, ("teste", "situa"), **_OWN))


@query("ethics_filter_chunk", f"SELECT doc_id, regexp_replace(text, '(?i){'|'.join(BLOCKED)}', '***', 'g') AS text FROM ({corpora.SYNTHETIC}) t")
def chunk(spark, sf_dir):
    return synthetic(spark, sf_dir).select("doc_id", ethics.filter_chunk(F.col("text"), BLOCKED).alias("text"))


_WIDE = "lpad(CAST(c_custkey * 7919 % 1000000007 * 1000003 AS VARCHAR(40)), 15, '1')"
_RAW = {"cpf": f"substr({_WIDE}, 1, 11)", "cnpj": f"substr({_WIDE}, 1, 14)", "cnh": f"substr({_WIDE}, 1, 11)", "pis": f"substr({_WIDE}, 1, 11)", "cns": f"substr({_WIDE}, 1, 15)", "titulo": f"substr({_WIDE}, 1, 8) || '0' || substr({_WIDE}, 9, 3)"}


@query("checksums", "SELECT c_custkey, " + ", ".join(f"{O.checksum(k, raw)} AS {k}" for k, raw in _RAW.items()) + " FROM customer")
def check_digits(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", *[checksums.VALIDATORS[k](F.expr(raw)).alias(k) for k, raw in _RAW.items()])


@query("evidence_chain", f"""
WITH c AS (SELECT c_custkey, 'resp-' || c_custkey AS rid, 'cliente ' || c_name AS a, 'segmento ' || c_mktsegment AS b FROM customer)
SELECT c_custkey, 'ev-' || sha256('{{"responseId":"' || rid || '","createdAt":"{AT}","claims":[{{"claim":"' || a || '","confidence":"high"}},{{"claim":"' || b || '","confidence":"medium"}}]}}') AS audit_hash,
       'medium' AS overall, '[Evidências — ' || rid || ']' || chr(10) || '• ' || a || ' (confiança: high)' || chr(10) || '  ↳ [tool_call] crm: "' || a || '..."' || chr(10)
       || '• ' || b || ' (confiança: medium)' || chr(10) || '  ↳ [document] tabela: "' || b || '..."' || chr(10) || 'Audit hash: ev-'
       || sha256('{{"responseId":"' || rid || '","createdAt":"{AT}","claims":[{{"claim":"' || a || '","confidence":"high"}},{{"claim":"' || b || '","confidence":"medium"}}]}}') AS block, TRUE AS valid
FROM c""")
def chains(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rid = F.concat(F.lit("resp-"), F.col("c_custkey").cast("string"))
    a, b = F.concat(F.lit("cliente "), "c_name"), F.concat(F.lit("segmento "), "c_mktsegment")
    claims = F.array(evidence.tool_claim(a, F.lit("crm"), a, F.lit(AT)), evidence.document_claim(b, F.lit("tabela"), b, F.lit(AT), F.lit("medium")))
    d = c.select("c_custkey", evidence.chain(rid, F.lit(AT), claims).alias("c"))
    return d.select("c_custkey", F.col("c.auditHash").alias("audit_hash"), F.col("c.overallConfidence").alias("overall"), evidence.block(F.col("c")).alias("block"), evidence.valid(F.col("c")).alias("valid"))


@query("evidence_shapes", f"""
WITH c AS (SELECT c_custkey, c_name, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'medium' WHEN 1 THEN 'speculative' WHEN 2 THEN 'low' ELSE 'certain' END AS confidence, k >= 2 AS verifiable,
       CASE k WHEN 0 THEN 'medium' WHEN 1 THEN 'speculative' WHEN 2 THEN 'low' ELSE 'high' END AS overall, k <> 1 AS valid,
       CASE WHEN k = 1 THEN NULL ELSE 'ev-' || left(sha256('modelo|' || c_name), 12) END AS evidence_id, 'ev-' || sha256('{{"responseId":"r","createdAt":"{AT}","claims":[]}}') AS empty_hash, 'speculative' AS empty_overall
FROM c""")
def shapes(spark, sf_dir):
    k, at = F.col("c_custkey") % 4, F.lit(AT)
    made = lambda kind, level: evidence.evidence(kind, F.lit("modelo"), F.col("c_name"), F.lit(level), at)
    none = F.array().cast(f"array<{evidence.EVIDENCE}>")
    items = F.when(k == 0, F.array(made("inference", "medium"))).when(k == 1, none).when(k == 2, F.array(made("inference", "low"), made("tool_call", "certain"))).otherwise(F.array(made("document", "low")))
    c = evidence.claim(F.col("c_name"), items, F.when(k == 3, F.lit("certain")))
    claims = F.when(k == 3, F.array(c, evidence.tool_claim(F.lit("x"), F.lit("y"), F.lit("z"), at))).otherwise(F.array(c))
    d = table(spark, sf_dir, "customer").select("c_custkey", c.alias("c"), evidence.chain(F.lit("r"), at, claims).alias("h"), evidence.chain(F.lit("r"), at, F.array().cast(f"array<{evidence.CLAIM}>")).alias("e"))
    return d.select(
        "c_custkey", "c.confidence", "c.verifiable", F.col("h.overallConfidence").alias("overall"), evidence.valid(F.col("h")).alias("valid"), F.get("c.evidence", F.lit(0))["id"].alias("evidence_id"),
        F.col("e.auditHash").alias("empty_hash"), F.col("e.overallConfidence").alias("empty_overall"),
    )


_ROW = """'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'"""


@query("provenance", f"""SELECT c_custkey, sha256({_ROW}) AS raw_line_hash, 'http://x.example/' || c_custkey AS source_url, 'unknown' AS source_method,
       sha256('http://x.example/' || c_custkey || '||{AT}') AS source_fingerprint FROM customer""")
def audit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    row = provenance.canonical_row(c.columns)
    url = F.concat(F.lit(" http://x.example/"), F.col("c_custkey").cast("string"))
    d = c.select("c_custkey", provenance.audit_fields(row, url, F.lit(" "), F.lit(AT)).alias("a"))
    return d.select("c_custkey", "a.raw_line_hash", "a.source_url", "a.source_method", "a.source_fingerprint")


@query("receipts", O.findings(corpora.SYNTHETIC) + O.spliced("k.mask") + f"""
SELECT c.doc_id, sha256(c.text) AS input_hash, sha256(o.out) AS output_hash,
       sha256('{{"inputHash":"' || sha256(c.text) || '","outputHash":"' || sha256(o.out) || '","inspectedAt":"{AT}","evidenceHash":null,"sourceFingerprint":null,"guardVersion":"0.2.2","provenanceLevel":"inspection_only"}}') AS inspection_hash
FROM corpus c JOIN out o ON o.doc_id = c.doc_id""")
def receipts(spark, sf_dir):
    d = guard.inspect(synthetic(spark, sf_dir), inspected_at=F.lit(AT))
    return d.select("doc_id", F.col("receipt.inputHash").alias("input_hash"), F.col("receipt.outputHash").alias("output_hash"), F.col("receipt.inspectionHash").alias("inspection_hash"))


_BOUND = f"""WITH c AS (
  SELECT c_custkey, c_name AS t, c_mktsegment AS o, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' http://x.example/' || c_custkey || ' ' END AS url, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN ' ' ELSE 'api' END AS m,
         CASE WHEN c_custkey % 2 = 0 THEN '{{"k":' || c_custkey || '}}' END AS r, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'q' || c_custkey END AS qu FROM customer
), k AS (SELECT *, url <> '' AND m <> '' AS known FROM c), f AS (
  SELECT *, CASE WHEN known THEN sha256(trim(url) || '|' || trim(m) || '|{AT}') END AS fp, CASE WHEN known AND r IS NOT NULL THEN 'source_row_bound' WHEN known THEN 'source_context' ELSE 'inspection_only' END AS level FROM k
)
SELECT c_custkey, level, sha256('{{"inputHash":"' || sha256(t) || '","outputHash":"' || sha256(o) || '","inspectedAt":"{AT}","evidenceHash":"ev-1","sourceFingerprint":' || coalesce('"' || fp || '"', 'null')
         || ',"guardVersion":"{provenance.VERSION}","provenanceLevel":"' || level || '"}}') AS inspection_hash, CASE WHEN known THEN trim(url) END AS source_url, CASE WHEN known THEN CASE WHEN trim(m) = '' THEN 'unknown' ELSE m END END AS source_method,
       CASE WHEN known THEN sha256(r) END AS raw_line_hash, CASE WHEN known AND r IS NOT NULL THEN 'verified' END AS audit_status, fp AS source_fingerprint, CASE WHEN known AND qu <> '' THEN sha256(qu) END AS query_hash, CASE WHEN known THEN 'id' END AS record_id
FROM f"""


@query("receipts_sources", _BOUND)
def receipts_sources(spark, sf_dir):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" http://x.example/"), k.cast("string"), F.lit(" ")))
    method = F.when(k % 5 == 0, "").when(k % 5 == 1, " ").otherwise("api")
    row = F.when(k % 2 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")))
    asked = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("q"), k.cast("string")))
    r = provenance.receipt(F.col("c_name"), F.col("c_mktsegment"), F.lit(AT), F.lit("ev-1"), url=url, method=method, row=row, query=asked, record_id=F.lit("id"))
    d = table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"))
    s = "r.source."
    return d.select(
        "c_custkey", F.col("r.provenanceLevel").alias("level"), F.col("r.inspectionHash").alias("inspection_hash"), s + "source_url", s + "source_method", s + "raw_line_hash", s + "audit_status", s + "source_fingerprint",
        F.col(s + "queryHash").alias("query_hash"), F.col(s + "recordId").alias("record_id"),
    )


def _inspected(df: DataFrame, blocked=()) -> DataFrame:
    d = guard.inspect(df, config=guard.Config(blocked_entities=blocked, critical_action="block"), inspected_at=F.lit(AT))
    return d.select("doc_id", "output", "safe", "blocked", "score", "sensitivity", F.size("findings").alias("n_findings"), "summary")


@query("inspect_synthetic", O.inspected(corpora.SYNTHETIC, BLOCKED) + O.INSPECTED)
def inspect_synthetic(spark, sf_dir):
    return _inspected(synthetic(spark, sf_dir), BLOCKED)


@query("inspect_documents", O.inspected(DOCS, ()) + O.INSPECTED)
def inspect_documents(spark, sf_dir):
    return _inspected(docs(spark, sf_dir))


@query("inspect_conversations", O.inspected(TALK, ()) + O.INSPECTED)
def inspect_conversations(spark, sf_dir):
    return _inspected(talk(spark, sf_dir))


_EVAL = O.evaluated([(i, t, e) for i, (t, e) in enumerate(corpora.LABELLED)])


def _evaluated(spark) -> DataFrame:
    rows = [(i, t, list(e)) for i, (t, e) in enumerate(corpora.LABELLED)]
    return evaluate.cases(spark.createDataFrame(rows, "case_id int, text string, expected array<string>"))


@query("evaluate_patterns", _EVAL + " SELECT * FROM m")
def eval_patterns(spark, sf_dir):
    return evaluate.by_pattern(_evaluated(spark))


@query("evaluate_macro", _EVAL + """ SELECT a.*, s.perfect_pct, CASE WHEN f1 >= 0.9 THEN 'competitive' WHEN f1 >= 0.8 THEN 'adequate' ELSE 'needs work' END AS verdict
FROM (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM m) a, share s""")
def eval_macro(spark, sf_dir):
    return evaluate.macro(_evaluated(spark))


def _reviewed(spark) -> DataFrame:
    rows = spark.createDataFrame(list(corpora.REVIEW), "id string, pattern_id string, text string, should_match boolean, answer string")
    hits = registry.hitl_matches(rows.drop("answer"))
    return hits.join(rows.select("id", "answer"), "id").withColumn("decision", F.when(F.col("found"), registry.decision(F.col("answer"))).otherwise("rejected"))


_SESSION = ", ".join(f"({O.q(i)}, {O.q(p)}, {O.q(t)}, {m}, {O.q(a)})" for i, p, t, m, a in corpora.REVIEW)
_HITS = O.findings(f"SELECT id AS doc_id, text FROM (VALUES {_SESSION}) s(id, pattern_id, text, should_match, answer)", (*P.SCAN, *P.PROFILE_PCMG)) + f""",
reviewed AS (
  SELECT s.id, CASE WHEN k.m IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY s.id ORDER BY k.start) END AS finding_no, coalesce(k.m, '') AS matched, k.m IS NOT NULL AS found,
         CASE WHEN k.m IS NULL OR lower(trim(answer)) = 'n' THEN 'rejected' WHEN lower(trim(answer)) IN ('s', '') THEN 'confirmed' WHEN lower(trim(answer)) = 'p' THEN 'partial' ELSE 'skipped' END AS decision, should_match
  FROM (VALUES {_SESSION}) s(id, pattern_id, text, should_match, answer) LEFT JOIN kept k ON k.doc_id = s.id AND k.category = s.pattern_id
  WHERE k.m IS NOT NULL OR should_match
)"""


@query("hitl_matches", _HITS + " SELECT id, finding_no, matched, found, decision FROM reviewed")
def hitl(spark, sf_dir):
    return _reviewed(spark).select("id", "finding_no", "matched", "found", "decision")


@query("hitl_summary", _HITS + """ SELECT count(*) AS total_matches, count(*) FILTER (WHERE decision = 'confirmed') AS confirmed, count(*) FILTER (WHERE decision = 'rejected') AS rejected,
  count(*) FILTER (WHERE decision = 'partial') AS partial, count(*) FILTER (WHERE decision = 'rejected' AND should_match) AS false_positives FROM reviewed""")
def hitl_summary(spark, sf_dir):
    return registry.session_summary(_reviewed(spark))


@query("hitl_promotion", """SELECT c_custkey, CASE WHEN c + r = 0 THEN 'low' WHEN r / CAST(c + r AS DOUBLE) > 0.2 THEN 'low' WHEN c >= 30 THEN 'high' WHEN c >= 10 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT c_custkey, c_custkey % 45 AS c, c_custkey % 7 AS r FROM customer) t""")
def promotion(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", registry.promoted(F.col("c_custkey") % 45, F.col("c_custkey") % 7, F.lit("low")).alias("confidence"))


@query("hitl_highlight", "SELECT c_custkey, replace(c_name, '#', '>>>>#<<<<') AS text FROM customer")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", registry.highlight(F.col("c_name"), F.lit("#")).alias("text"))


_EVENTS = "SELECT event_id, ts AS created_at, CAST(user_id AS VARCHAR) AS tenant_id, event_type, value FROM events"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("tenant_id"), "event_type", "value")


@query("usage_by_tenant", f"SELECT tenant_id, count(*) AS calls FROM ({_EVENTS}) e GROUP BY tenant_id")
def usage_by_tenant(spark, sf_dir):
    return usage.usage(_events(spark, sf_dir))


@query("usage_windows", "SELECT date_trunc('day', ts) AS window_start, user_id AS tenant_id, count(*) AS calls FROM events GROUP BY 1, 2")
def usage_windows(spark, sf_dir):
    return windowed_usage(table(spark, sf_dir, "events"))


@query("budget_warnings", f"""
WITH e AS ({_EVENTS}), u AS (SELECT tenant_id, count(*) AS calls, CAST(CASE WHEN CAST(tenant_id AS BIGINT) % 9 = 0 THEN 0 ELSE 60 + CAST(tenant_id AS BIGINT) % 40 END AS BIGINT) AS quota_limit FROM e GROUP BY tenant_id),
w AS (SELECT *, (calls + 1) / CAST(quota_limit AS DOUBLE) AS share FROM u WHERE quota_limit > 0),
d AS (SELECT tenant_id, calls, quota_limit, CASE WHEN share >= 1 THEN 'critical' WHEN share >= 0.8 THEN 'warning' END AS level, CAST(floor(share * 100 + 0.5) AS BIGINT) AS pct FROM w),
sent AS (SELECT DISTINCT tenant_id, 'critical' AS level FROM e WHERE event_type = 'error' AND created_at >= TIMESTAMP '2024-02-20' - INTERVAL 31 DAYS)
SELECT d.* FROM d LEFT JOIN sent s ON s.tenant_id = d.tenant_id AND s.level = d.level WHERE d.level IS NOT NULL AND s.tenant_id IS NULL""")
def budget(spark, sf_dir):
    e = _events(spark, sf_dir)
    n = F.col("tenant_id").cast("long")
    tenants = usage.usage(e).withColumn("quota_limit", F.when(n % 9 == 0, 0).otherwise(60 + n % 40).cast("long"))
    sent = e.where("event_type = 'error'").select("tenant_id", F.lit("critical").alias("level"), "created_at")
    return usage.budget_warnings(tenants, sent, F.lit("2024-02-20").cast("timestamp"))


@query("recent_events", f"SELECT event_id, created_at, tenant_id, event_type, value FROM ({_EVENTS}) e ORDER BY created_at DESC, event_id DESC LIMIT 50")
def recent(spark, sf_dir):
    return usage.recent_events(_events(spark, sf_dir))


@query("validate_keys", """
WITH t AS (SELECT 't' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'off' ELSE 'active' END AS status, sha256('k' || (c_custkey - c_custkey % 10 * CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END)) AS h FROM customer),
o AS (SELECT h, min(id) AS tenant_id FROM t WHERE status = 'active' GROUP BY h HAVING count(*) = 1)
SELECT o_orderkey, o.tenant_id FROM orders LEFT JOIN o ON o.h = sha256('k' || o_custkey)""")
def keys(spark, sf_dir):
    k = F.col("c_custkey")
    same = k - F.when(k % 10 == 3, k % 10).otherwise(0)
    t = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "off").otherwise("active").alias("status"), F.lit("free").alias("tier"), usage.hash_key(F.concat(F.lit("k"), same.cast("string"))).alias("api_key_hash"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("api_key"))
    return usage.validate_keys(r, t).select("o_orderkey", "tenant_id")


@query("telemetry_events", O.inspected(TALK, (), "redact") + """
SELECT 't' || doc_id % 10 AS tenant_id, 'pii_inspection' AS event_type, sha256(text) AS input_hash, coalesce(kinds, '') AS pii_types, n_findings AS pii_count, CASE WHEN safe THEN 'safe' ELSE 'blocked' END AS verdict,
       CAST(0 AS BIGINT) AS duration_ms, nullif(score, 0) AS ethics_score, n_violations AS ethics_violations, 200 AS status_code, 'v1' AS api_version FROM r""")
def telemetry(spark, sf_dir):
    d = guard.inspect(talk(spark, sf_dir), inspected_at=F.lit(AT))
    e = usage.call_events(d, F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string")), F.lit("2024-01-01").cast("timestamp"))
    return e.withColumn("pii_types", F.array_join("pii_types", ",")).drop("error_message", "session_id", "created_at")


@query("free_tenants", "SELECT 't' || c_custkey AS id, c_name AS name, c_name || '@x.br' AS email, 'free' AS tier, CAST(500 AS BIGINT) AS quota_limit, CAST(0 AS BIGINT) AS calls_this_month, 'active' AS status, sha256('k' || c_custkey) AS api_key_hash FROM customer")
def free(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return usage.free_tenant(table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), k).alias("id"), F.col("c_name").alias("name"), F.concat("c_name", F.lit("@x.br")).alias("email"), F.concat(F.lit("k"), k).alias("api_key")))
