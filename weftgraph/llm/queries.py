"""The opN_ queries: each reads a whole table and returns its operator's full result."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

#: Query: (module, function, table).
OPERATORS = {
    "op1_suffix_array_dedup": ("suffix", "op1_suffix_array", "documents"),
    "op2_secret_scan": ("secrets", "op2_secret_scan", "documents"),
    "op3_quality_perplexity": ("quality", "op3_quality", "documents"),
    "op4_toxicity": ("toxicity", "op4_toxicity", "documents"),
    "op5_reshard": ("reshard", "op5_reshard", "documents"),
    "op6_bpe": ("bpe", "op6_bpe", "documents"),
    "op7_mix": ("mixing", "op7_mix", "documents"),
    "op8_embedding_near_dup": ("embeddings", "op8_embeddings", "embeddings"),
    "op9_substring_dedup": ("substring", "op9_substring", "documents"),
    "op10_jaccard_join": ("jaccard", "op10_jaccard", "documents"),
}


def queries() -> dict:
    def query(module: str, function: str, table: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            operator = getattr(importlib.import_module(f"{__package__}.{module}"), function)
            docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if function == "op4_toxicity":
                return operator(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            return operator(docs)

        return run

    return {name: query(*how) for name, how in OPERATORS.items()}


_WORDS = r"'[^\x20\x09-\x0D]+'"
#: Reachability over links (a, b) in both directions, from every node's own id.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT id, id AS c FROM nodes UNION SELECT reach.id, b FROM reach JOIN both_ways ON reach.c = a),
  least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

_OP1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  win AS (SELECT doc_id, unnest([substr(h, 2 * i - 1, 200) FOR i IN range(1, len(h) // 2 - 98)]) AS s, unnest(range(1, len(h) // 2 - 98)) AS i FROM d WHERE len(h) >= 200),
  again AS (SELECT doc_id, i, true AS r FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
  byte AS (SELECT doc_id, unnest(range(1, len(h) // 2 + 1)) AS i FROM d),
  c AS (SELECT byte.doc_id, byte.i, bool_or(coalesce(r, false)) OVER (PARTITION BY byte.doc_id ORDER BY byte.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
    FROM byte LEFT JOIN again ON again.doc_id = byte.doc_id AND again.i = byte.i),
  e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, list(i ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
  SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(array_to_string([substr(h, 2 * x - 1, 2) FOR x IN kept], ''), ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_OP8 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.e) = len(q.e)
    WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
  nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
  n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
  SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN n ON a = id"""

_OP9 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
  t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
  win AS (SELECT doc_id, unnest([array_to_string(ws[i:i + 34], ' ') FOR i IN range(1, len(ws) - 33)]) AS s, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
  rep AS (SELECT doc_id, i, true AS r FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
  c AS (SELECT t.doc_id, t.i, word, bool_or(coalesce(r, false)) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id AND rep.i = t.i),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
  n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
  SELECT doc_id, n AS n_shingles, component_id FROM n JOIN least ON id = doc_id"""


def oracle_sql() -> dict[str, str]:
    """The operators whose rows SQL can give; the others are tested against brute force."""
    return {"op1_suffix_array_dedup": _OP1, "op8_embedding_near_dup": _OP8, "op9_substring_dedup": _OP9, "op10_jaccard_join": _OP10}
