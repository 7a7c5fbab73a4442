"""The library's tables in DuckDB's SQL, for the queries' counterparts."""

from __future__ import annotations

TABLES = {
    "assets": """
      SELECT CAST(o_orderkey AS VARCHAR) AS id,
        '/lib/' || o_orderstatus || '/' || CASE o_orderkey % 11 WHEN 0 THEN 'Screenshot ' WHEN 1 THEN 'selfie-' ELSE 'IMG_' END || o_orderkey
          || CASE o_orderkey % 10 WHEN 0 THEN '.mp4' WHEN 1 THEN '.CR2' WHEN 2 THEN '.dng' ELSE '.jpg' END AS path,
        sha256(CAST(o_orderkey AS VARCHAR)) AS hash, CAST(NULL AS VARCHAR) AS perceptual_hash,
        CASE WHEN o_orderkey % 10 = 0 THEN 'video' ELSE 'image' END AS media_type,
        CASE WHEN o_orderkey % 13 <> 0 THEN 1000 + (o_orderkey * 37) % 5000 END AS width,
        CASE WHEN o_orderkey % 13 <> 0 THEN 1000 + (o_orderkey * 53) % 3000 END AS height,
        CASE WHEN o_orderkey % 10 = 0 THEN 1000 * (o_orderkey % 600) END AS duration_ms,
        1000 + (o_orderkey * 7919) % 9000000 AS file_size,
        o_orderdate + INTERVAL 1 DAY AS created_at,
        CASE WHEN o_orderkey % 20 <> 19 THEN o_orderdate END AS captured_at,
        o_orderdate + (o_orderkey % 97) * INTERVAL 1 DAY AS indexed_at,
        o_orderkey % 7 = 0 AS favorite, o_orderkey % 6 AS rating,
        CASE o_orderkey % 8 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' WHEN 4 THEN 'purple' WHEN 5 THEN '' END AS color_label,
        CASE WHEN o_orderkey % 3 <> 0 THEN '/t/' || o_orderkey END AS thumbnail_path,
        CASE o_orderkey % 5 WHEN 1 THEN 'iPhone 15' WHEN 2 THEN 'Canon EOS' WHEN 3 THEN 'NIKON Z6' WHEN 4 THEN 'Pixel 8' END AS camera,
        CASE WHEN o_orderkey % 9 = 0 THEN 'front camera' END AS lens,
        CASE WHEN o_orderkey % 25 = 0 THEN o_orderdate + INTERVAL 100 DAY END AS deleted_at,
        CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 3 THEN CAST((o_orderkey * 17) % 200 AS DOUBLE) END AS blur_score,
        coalesce(CASE WHEN o_orderkey % 20 <> 19 THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) AS ev
      FROM orders""",
    "live": "SELECT * FROM assets WHERE deleted_at IS NULL",
    "tags": "SELECT DISTINCT p_brand AS id, p_brand AS name FROM part",
    "asset_tags": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS asset_id, p_brand AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "albums": """
      SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN CAST((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS VARCHAR) END AS cover_asset_id,
        TIMESTAMP '1994-01-01' + c_custkey * INTERVAL 1 DAY AS created_at FROM customer""",
    "album_assets": "SELECT CAST(o_custkey AS VARCHAR) AS album_id, CAST(o_orderkey AS VARCHAR) AS asset_id FROM orders",
    "faces": """
      SELECT l_orderkey || ':' || l_suppkey AS id, CAST(l_orderkey AS VARCHAR) AS asset_id, CAST(l_suppkey AS VARCHAR) AS person_id, ((l_orderkey * 31 + l_suppkey) % 100) / 100.0::DOUBLE AS score,
        CASE WHEN (l_orderkey + l_suppkey) % 3 <> 0 THEN '/crops/' || l_orderkey || '-' || l_suppkey || '.jpg' END AS crop_path
      FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""",
    "people": """
      SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, s_suppkey % 10 = 3 AS ignored, coalesce(n, 0) AS face_count
      FROM supplier LEFT JOIN (SELECT person_id, count(*) AS n FROM faces GROUP BY person_id) f ON f.person_id = CAST(s_suppkey AS VARCHAR)""",
    "asset_places": """
      SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, CAST((n_nationkey * 7) % 180 - 90 AS DOUBLE) AS lat, CAST((n_nationkey * 13) % 360 - 180 AS DOUBLE) AS lon,
        CASE WHEN n_nationkey = 24 THEN '' ELSE n_name END AS place_label, r_name AS country
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "asset_views": "SELECT CAST(user_id AS VARCHAR) AS asset_id, max(ts) AS viewed_at FROM events WHERE event_type = 'view' GROUP BY user_id",
    "ml_jobs": """
      SELECT asset_id, kind, CASE WHEN k < 30 THEN 'failed' ELSE 'done' END AS state, attempts, CASE WHEN k < 30 THEN 'code ' || k END AS error, updated_at
      FROM (SELECT CAST(event_id % 2000 AS VARCHAR) AS asset_id, event_type AS kind, count(*) AS attempts, max(ts) AS updated_at,
              arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, event_id)) AS k FROM events GROUP BY 1, 2)""",
    "activity_log": "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, props AS detail, ts AS created_at FROM events",
    "searches": "SELECT split_part(replace(text, chr(10), ' '), ' ', 1) AS query, conv_id * 1000 + turn AS made FROM conversations WHERE role = 'user'",
    "doc_assets": """
      SELECT CAST(doc_id AS VARCHAR) AS id, '/docs/' || source || '/doc' || doc_id || '.png' AS path, sha256(text) AS hash, 'image' AS media_type,
        TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS created_at FROM documents""",
    "asset_text": """
      SELECT CAST(d.doc_id AS VARCHAR) AS asset_id, text, CASE quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS confidence
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "asset_captions": "SELECT CAST(doc_id AS VARCHAR) AS asset_id, split_part(text, chr(10), 1) AS caption FROM documents",
    "asset_labels": "SELECT CAST(doc_id AS VARCHAR) AS asset_id, lang AS label, 0.9::DOUBLE AS score, 0 AS rank FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), source, 0.4::DOUBLE, 1 FROM documents",
    "asset_embeddings": "SELECT CAST(vec_id AS VARCHAR) AS asset_id, embedding AS vector, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "word_bands": """
      SELECT id, """ + ", ".join(
        "CAST(" + " + ".join(f"CASE WHEN sum(CASE WHEN (p{i} >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << b} ELSE 0 END" for b in range(16)) + f" AS INTEGER) AS b{i}" for i in range(4)
    ) + """
      FROM (SELECT id, """ + ", ".join(f"CAST('0x' || substring(h, {1 + 4 * i}, 4) AS INTEGER) AS p{i}" for i in range(4)) + """
            FROM (SELECT DISTINCT id, w, md5(w) AS h FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS w FROM documents) WHERE w <> ''))
      GROUP BY id""",
}

_NEEDS = {"live": ["assets"], "people": ["faces"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """The body after the tables that it names."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{',' if body.lstrip().startswith(',') else ''}\n{body.lstrip().removeprefix(',')}"
