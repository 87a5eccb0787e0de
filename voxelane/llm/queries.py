"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, line_dedup, mtree, pitman_yor, runs, secrets, simhash, suffix_dedup, token_files, toxicity, warc
from .workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archives"
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    captures = warc.transactions(warc.read_records(spark, path, payloads=False))
    page = lambda c: F.try_to_number(F.regexp_extract(c, "urn:x-capture:(-?[0-9]*)", 1), F.lit("S9999999999999999999")).cast("long")
    return captures.select(page("capture").alias("page_id"), "main.payload_bytes", "main.payload_digest", "main.record_type", page("main.refers_to").alias("refers_to"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=toxicity.remainder("doc_id") != 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", (toxicity.remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'tokens').path}/ids"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.digests(token_files.read_tokens(spark, path))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeats(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    joined = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    of = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda f: f["kind"].isin(*secrets.KINDS))
    rows = secrets.find(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[of(kind) for kind in secrets.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.encode(table(spark, sf_dir, "embeddings"))
    return codes.label_errors(found).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.planted(table(spark, sf_dir, "documents")))
    best = runs.longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}") for c in ("start", "length", "period")], F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("*", F.expr("1000 * length DIV period").alias("exponent_milli"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return SQL


_TOKENS = """regexp_extract_all(lower(regexp_replace(regexp_replace(translate(COALESCE(text, ''), chr(1), ' '), '{unit}', '\\1' || chr(1) || 'u\\2\\3', 'g'), '{name}', '\\1' || chr(1) || 'p\\2', 'g')), '\\p{{Nd}}+(?:[.,:/]\\p{{Nd}}+)*|\\x01?[\\p{{L}}\\p{{M}}]+')""".format(unit=decontaminate.UNIT, name=decontaminate.NAME)
_TEMPLATE = "CASE WHEN {0}[1] = chr(1) THEN {0}[1:2] WHEN regexp_matches({0}, '^\\p{{Nd}}') THEN chr(1) || 'n' ELSE {0} END"

SQL = {
    "op1_decontaminate": f"""
        WITH i AS (SELECT item_id, {_TOKENS} AS v FROM benchmark WHERE item_id IS NOT NULL),
        d AS (SELECT doc_id, {_TOKENS} AS v FROM documents WHERE doc_id IS NOT NULL),
        it AS (SELECT item_id, v, list_transform(v, lambda x: {_TEMPLATE.format("x")}) AS t FROM i WHERE len(v) >= 5),
        dt AS (SELECT doc_id, v, list_transform(v, lambda x: {_TEMPLATE.format("x")}) AS t FROM d WHERE len(v) >= 5),
        iw AS (SELECT item_id, CAST(len(t) AS INTEGER) AS n, unnest(range(1, len(t) - 3)) AS ip, v, t FROM it),
        dw AS (SELECT doc_id, unnest(range(1, len(t) - 3)) AS dp, v, t FROM dt),
        ih AS (SELECT item_id, n, ip, array_to_string(t[ip:ip + 4], ' ') AS w, v[ip:ip + 4] AS iv, t[ip:ip + 4] AS s FROM iw),
        dh AS (SELECT doc_id, dp, array_to_string(t[dp:dp + 4], ' ') AS w, v[dp:dp + 4] AS dv FROM dw),
        h AS (SELECT doc_id, item_id, n, ip, phase, CAST(floor((dp - ip + phase * 4) / 8.0) AS BIGINT) AS bucket, iv, dv, s
              FROM dh JOIN ih USING (w), (VALUES (0), (1)) p(phase)),
        tok AS (SELECT doc_id, item_id, n, phase, bucket, ip + k AS spot, iv[k + 1] AS a, dv[k + 1] AS b, s[k + 1] AS s FROM h, (VALUES (0), (1), (2), (3), (4)) o(k)),
        c AS (SELECT doc_id, item_id, n, phase, bucket, CAST(count(DISTINCT spot) AS INTEGER) AS covered, bool_and(a = b) AS same FROM tok GROUP BY ALL HAVING count(DISTINCT spot) >= 0.7 * n),
        v AS (SELECT doc_id, item_id, phase, bucket, max(k) AS most FROM (SELECT doc_id, item_id, phase, bucket, a, count(DISTINCT b) AS k FROM tok WHERE s <> a GROUP BY ALL) GROUP BY ALL)
        SELECT doc_id, item_id, max(covered) AS covered, arg_max(n, (covered, same)) AS item_tokens, arg_max(same, (covered, same)) AS same_slots
        FROM c LEFT JOIN v USING (doc_id, item_id, phase, bucket) WHERE COALESCE(most, 1) = 1 GROUP BY doc_id, item_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS body, sha1(COALESCE(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS k FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN keeper END AS refers_to
        FROM g""",
    "op9_mtree": """
        WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.row <> q.row AND len(c.v) = len(q.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
        SELECT * FROM r WHERE "rank" <= 10""",
    "op10_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM s),
        e AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS k FROM l WHERE trim(line, ' ') <> ''),
        d AS (SELECT line, min(k) AS k, length(line) AS n FROM e GROUP BY line),
        p AS (SELECT b.line, a.k, levenshtein(a.line, b.line) AS edits FROM d a JOIN d b ON a.k < b.k AND a.n >= 24 AND b.n >= 24 AND b.n BETWEEN a.n - 2 AND a.n + 2),
        r AS (SELECT line, min(k) AS near, arg_min(edits, k) AS edits FROM p WHERE edits <= 2 GROUP BY line),
        f AS (SELECT e.doc_id, e.line_no, e.k <> d.k AS same, CASE WHEN e.k <> d.k THEN d.k ELSE near END AS first, CAST(CASE WHEN e.k <> d.k THEN 0 ELSE edits END AS INTEGER) AS edits
              FROM e JOIN d USING (line) LEFT JOIN r USING (line) WHERE e.k <> d.k OR near IS NOT NULL)
        SELECT f.doc_id, f.line_no, CASE WHEN same THEN 'exact' ELSE 'near' END AS kind, e.doc_id AS first_doc, e.line_no AS first_line, f.edits FROM f JOIN e ON e.k = f.first""",
}
