"""The operators' queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import neighbours
from .bpe import encode_documents
from .exact_dedup import exact_dedup
from .langid import identify
from .line_dedup import line_dedup
from .minhash import near_dedup
from .packing import pack
from .secret_scan import ACCESS, ALPHABET, ASSIGN, ASSIGN_VALUE, HEX, KINDS, LETTERS, MIN_RATIO, NAMES, ORDINARY_SAMPLES, RANDOM_SAMPLES, STEP, TOKEN, scan, span_text
from .substring import repeated_passages
from .toxicity import score_toxicity

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), width=2, percent=80)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(span_text(F.col("spans"), True), 256).alias("base_sha256"), span_text(F.col("spans"), False).alias("spans"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), tokenizer())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1,
        "op2_exact_dedup": op2,
        "op3_toxicity": op3,
        "op4_secret_scan": op4,
        "op5_packing": op5,
        "op6_nearest_neighbours": op6,
        "op7_substring_dedup": op7,
        "op8_bpe": op8,
        "op9_language_id": op9,
        "op10_line_dedup": op10,
    }


def secret_sql() -> str:
    """The scan; the ordinary words are those of every text, at every size."""
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)}
    size = len(ALPHABET)
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, regexp_extract_all(t, {quoted[k]}) AS m, string_split_regex(t, {quoted[k]}) AS g FROM d" for i, k in enumerate(KINDS))
    log_p = f"ln(({{n}} + {size}.0 * (sum({{n}}) OVER (PARTITION BY b) + 1.0) / (sum({{n}}) OVER () + {size}.0)) / (sum({{n}}) OVER (PARTITION BY a) + {size}.0))"
    steps = f"unnest(list_filter(list_transform(range(1, length(v)), lambda i: substring(v, i, 2)), lambda p: regexp_matches(p, '{STEP}')))"
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    join = "coalesce(string_agg(CASE kind {} END || ':' || s || ':' || e, ',' ORDER BY s, kind){{}}, '')".format(" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), "
        "x AS (SELECT doc_id, kind, m[i] AS v, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS s "
        "FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)), "
        f"a AS (SELECT doc_id, kind, v, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM x WHERE kind <> 0 OR length(regexp_extract(v, {quoted['assign']}, 1)) >= {ASSIGN_VALUE}), "
        f"h AS (SELECT sha256(CAST(range AS VARCHAR)) AS h FROM range({RANDOM_SAMPLES})), b AS (SELECT h, replace(base64(unhex(h)), '=', '') AS b FROM h), "
        "samples AS (SELECT h AS v, 1 AS r FROM b UNION ALL SELECT b, 1 FROM b UNION ALL SELECT translate(upper(b), '+/', '23'), 1 FROM b "
        "UNION ALL SELECT unnest([d, replace(d, '-', ''), CAST(i * 2654435761 % 1000000000000 AS VARCHAR), "
        f"{names}[i % {len(NAMES)} + 1] || CAST(i % 997 AS VARCHAR)]), 0 FROM (SELECT range AS i, CAST(DATE '1990-01-01' + CAST(range * 5 AS INTEGER) AS VARCHAR) AS d FROM range({ORDINARY_SAMPLES})) "
        f"UNION ALL SELECT unnest(regexp_extract_all(t, '{LETTERS}')), 0 FROM d), "
        f"counts AS (SELECT pair, sum(r) AS n1, sum(1 - r) AS n0 FROM (SELECT r, {steps} AS pair FROM samples) GROUP BY pair), "
        f"letters AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c), grid AS (SELECT x.c AS a, y.c AS b, x.c || y.c AS pair FROM letters x, letters y), "
        "steps AS (SELECT a, b, pair, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0 FROM grid LEFT JOIN counts USING (pair)), "
        f"model AS (SELECT pair, {log_p.format(n='n1')} - {log_p.format(n='n0')} AS ratio FROM steps), "
        f"judged AS (SELECT doc_id, s, e, avg(ratio) AS ratio FROM (SELECT doc_id, s, e, {steps} AS pair FROM a WHERE kind = 3) JOIN model USING (pair) GROUP BY doc_id, s, e), "
        f"spans AS (SELECT doc_id, kind, s, e FROM a WHERE kind < 3 UNION ALL SELECT doc_id, 3, s, e FROM judged j WHERE ratio >= {MIN_RATIO} "
        "AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = j.doc_id AND a.kind < 3 AND a.s < j.e AND a.e > j.s)) "
        "SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, "
        f"sha256({join.format(' FILTER (WHERE kind < 3)')}) AS base_sha256, {join.format('')} AS spans FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id")


def oracle_sql() -> dict[str, str]:
    low = LOWER.format("coalesce(text, '')")
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return {
        "op1_minhash_dedup": (
            f"WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents), "
            "s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w), "
            "n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), "
            "t AS MATERIALIZED (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)), "
            "p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id "
            "AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL), "
            "l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 80 * (na + nb - c)), "
            "r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a), "
            "c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) "
            "SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"),
        "op2_exact_dedup": (
            f"WITH t AS (SELECT doc_id, {low} AS n FROM documents), g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n) "
            "SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)"),
        "op4_secret_scan": secret_sql(),
        "op10_line_dedup": (
            "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents), "
            f"k AS (SELECT doc_id, pos, line, {LOWER.format(f'trim(line, {blanks})')} AS key FROM l), "
            "f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10) "
            "SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256 "
            "FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id"),
    }
