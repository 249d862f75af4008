"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, ngram_join, packing, secrets, substring, token_counts, token_ids, topk, toxicity
from .common import table
from .encoding import tokenizer_path


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.addressable_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.piece_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_toxicity, op3_token_counts, op4_decontaminate, op5_chat, op6_pack, op7_substring_dedup, op8_ngram_join, op9_secrets, op10_topk)}


_WORDS = r"regexp_extract_all(lower(text), '[^\pP\pS\pZ\p{Cc}\x{200B}\x{FEFF}]+')"


def _secret_spans(kind: int, pattern: str, where: str) -> str:
    """SQL for the matches of one pattern in t(r, text): what lies between them comes from splitting by it."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
        SELECT r, CAST(list_sum([len(g[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([len(h[j]) FOR j IN range(1, i)]), 0) AS BIGINT) AS s, {kind} AS k, len(h[i]) AS n
        FROM (SELECT r, g, h, v, unnest(range(1, len(h) + 1)) AS i
              FROM (SELECT r, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}) AS h, {"regexp_extract_all(text, " + p + ", 2)" if "v[i]" in where else "NULL"} AS v FROM t WHERE regexp_matches(text, {p})))
        WHERE {where}"""


_ANY_CASE = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key", "access_?key", "_?id", "client_?id", "user", "name", "login")}
_SQL_ASSIGN = "(" + "|".join(_ANY_CASE[w] for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SQL_WEAK_ID = f"({_ANY_CASE['access_?key']}(?:{_ANY_CASE['_?id']})?|{_ANY_CASE['client_?id']}|{_ANY_CASE['user']}(?:{_ANY_CASE['name']})?|{_ANY_CASE['login']})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": f"""
            WITH d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
            b AS (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
            k AS (SELECT item_id, text, w, least(5, len(w)) AS n FROM b WHERE len(w) > 0),
            s AS (SELECT DISTINCT item_id, text, n, array_to_string(w[i:i + n - 1], ' ') AS s
                  FROM (SELECT item_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
            t AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
                  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
            z AS (SELECT item_id, text, count(*) AS size FROM s GROUP BY ALL),
            m AS (SELECT t.doc_id, s.item_id, s.text, count(*) AS shared FROM s JOIN t USING (n, s) GROUP BY ALL)
            SELECT doc_id, item_id, CAST(size AS INTEGER) AS item_shingles, CAST(shared AS INTEGER) AS shared_shingles, shared / size AS containment
            FROM m JOIN z USING (item_id, text) WHERE 100 * shared >= 75 * size""",
        # The table holds no tool calls: every message is plain. Tests hold calls and results against a plain version.
        "op5_chat": """
            SELECT conv_id, turn, CAST(0 AS INTEGER) AS nth, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BOOLEAN) AS linked,
                CAST(NULL AS BOOLEAN) AS valid, CAST(0 AS INTEGER) AS level,
                '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' AS json
            FROM conversations""",
        "op7_substring_dedup": r"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
            h AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
            m AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h),
            g AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i FROM h JOIN m USING (h) WHERE low < doc_id), (SELECT unnest(range(50)) AS j)),
            x AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
            k AS (SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END AS kept FROM d LEFT JOIN x USING (r))
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
        "op8_ngram_join": r"""
            WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            k AS (SELECT doc_id, w, least(5, len(w)) AS n FROM d WHERE len(w) > 0),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
            z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
            o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM o JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.size + q.size - shared)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
            SELECT a AS doc_id, CAST(coalesce(any_value(size), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
            FROM r LEFT JOIN z ON z.doc_id = a GROUP BY a""",
        "op9_secrets": f"""
            WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
            p AS ({_secret_spans(0, _SQL_ASSIGN, "len(v[i]) >= 12")} UNION ALL {_secret_spans(1, "AKIA[A-Z0-9]+", "len(h[i]) >= 18")}
                UNION ALL {_secret_spans(2, "[0-9a-f]{16,}", "true")}
                UNION ALL {_secret_spans(3, _SQL_WEAK_ID, "true")}
                UNION ALL {_secret_spans(4, "[A-Za-z0-9+/]{24,}", "regexp_matches(h[i], '[0-9]') AND regexp_matches(h[i], '[A-Z]') AND regexp_matches(h[i], '[a-z]')")}
                UNION ALL {_secret_spans(5, "https?://[A-Za-z0-9.:/_-]{4,}", "true")}),
            m AS (SELECT w.r, w.s, w.k, w.n,
                    bool_or(x.s < w.s + w.n AND w.s < x.s + x.n AND x.k < w.k) AS covered,
                    bool_or(NOT (x.s < w.s + w.n AND w.s < x.s + x.n) AND x.k IN (1, 3)) AS identifier,
                    bool_or(NOT (x.s < w.s + w.n AND w.s < x.s + x.n) AND x.k IN (0, 2, 4)) AS secret
                  FROM p w JOIN p x ON w.r = x.r AND w.k >= 3 AND greatest(w.s, x.s) - least(w.s + w.n, x.s + x.n) <= 200 GROUP BY ALL),
            a AS (SELECT r, s, k, n FROM p WHERE k < 3
                  UNION ALL SELECT r, s, k, n FROM m WHERE NOT covered AND CASE k WHEN 3 THEN secret WHEN 4 THEN identifier ELSE identifier AND secret END),
            z AS (SELECT r, s, k, ['assign', 'access', 'hex', 'identifier', 'string', 'endpoint'][k + 1] || ':' || s || ':' || (s + n) AS x FROM a)
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans
            FROM t LEFT JOIN z USING (r) GROUP BY r, doc_id""",
        "op10_topk": """
            WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
            SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p) WHERE r <= 5""",
    }
