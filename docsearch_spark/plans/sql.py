"""DuckDB SQL fragments for the oracle twins of the registered queries.

These strings are the independent, declarative definition each Spark query is
checked against; they mirror the semantics, not the Spark plan.
"""

from __future__ import annotations

WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}]+"


def norm_ws(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{WS}+', ' ', 'g'))"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def window_count(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    many = (f"1 + ({n} - {size} + {step - 1}) // {step}" if step <= size
            else f"({n} + {step - 1}) // {step}")
    return f"CASE WHEN {n} <= {size} THEN 1 ELSE {many} END"


def chunk_rows(src: str, text: str, size: int, overlap: int, keep: str) -> str:
    """Rows (keep..., chunk_index, content) of chunk_fixed over ``src``.

    ``keep`` is a comma separated column list carried through.
    """
    step = size - overlap
    body = f"""
      SELECT {keep}, i, trim(substr(t, i * {step} + 1, {size})) AS content
      FROM (
        SELECT {keep}, t, unnest(range(0, {window_count('length(t)', size, overlap)})) AS i
        FROM (SELECT {keep}, {norm_ws(text)} AS t FROM {src}) WHERE length(t) > 0
      )"""
    if size >= 2:
        return f"SELECT {keep}, CAST(i AS INTEGER) AS chunk_index, content FROM ({body})"
    return f"""SELECT {keep},
        CAST(row_number() OVER (PARTITION BY {keep} ORDER BY i) - 1 AS INTEGER) AS chunk_index,
        content FROM ({body}) WHERE length(content) > 0"""


def uuid_of(*parts: str) -> str:
    h = "md5(" + " || '#' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12))")


def bucket(token: str, dim: int) -> str:
    return f"CAST((('0x' || substr(md5({token}), 1, 8))::BIGINT % {dim}) AS INTEGER)"


def sparse_weights(src: str, id_cols: str, text: str, dim: int) -> str:
    """(id..., b, w): L2-normalised hashed term counts of a text column."""
    return f"""
      SELECT {id_cols}, b, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {id_cols})) AS w
      FROM (
        SELECT {id_cols}, {bucket('tok', dim)} AS b, CAST(count(*) AS DOUBLE) AS tf
        FROM (SELECT {id_cols}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}')) AS tok
              FROM {src})
        GROUP BY ALL
      )"""


def documents_chunks(size: int = 1200, overlap: int = 200) -> str:
    """Chunk table of ``documents`` with deterministic ids (as the Spark side)."""
    rows = chunk_rows("documents", "text", size, overlap, "doc_id, source")
    return f"""SELECT {uuid_of('doc_id', 'chunk_index')} AS chunk_id, doc_id,
        source AS source_path, chunk_index, content FROM ({rows})"""


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE[])"


def cosine(a: str, b: str) -> str:
    return (f"(list_dot_product({dbl(a)}, {dbl(b)}) / nullif(sqrt(list_dot_product({dbl(a)}, {dbl(a)})) "
            f"* sqrt(list_dot_product({dbl(b)}, {dbl(b)})), 0))")


def cosine_eps(a: str, b: str) -> str:
    return (f"(list_dot_product({dbl(a)}, {dbl(b)}) / ((sqrt(list_dot_product({dbl(a)}, {dbl(a)})) + 1e-12) "
            f"* (sqrt(list_dot_product({dbl(b)}, {dbl(b)})) + 1e-12)))")


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({dbl(a)}, {dbl(b)}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
