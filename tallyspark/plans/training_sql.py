"""SQL for DuckDB that states the results of p1_found, p2_found and p4_found independently."""

P1 = r"""
WITH props AS (
  SELECT upper(trim(id_prefix)) AS prefix, lower(p->>'name') AS name, p->>'data_type' AS kind
  FROM (SELECT id_prefix, primary_key_column, unnest(CAST(properties_json AS JSON[])) AS p FROM ontology_objects)
  WHERE p->>'name' <> primary_key_column),
edits AS (
  SELECT upper(trim(instance_id)) AS id, lower(trim(column_name)) AS name, new_value, executed_at
  FROM writeback_table WHERE trim(instance_id) <> '' AND trim(column_name) <> '' AND executed_at IS NOT NULL),
newest AS (
  SELECT id, e.name, kind, trim(new_value) AS v,
         row_number() OVER (PARTITION BY id, e.name ORDER BY executed_at DESC, new_value DESC NULLS LAST) AS k
  FROM edits e JOIN props ON props.prefix = split_part(id, '-', 1) AND props.name = e.name),
kept AS (
  SELECT id, name, kind, v,
         regexp_replace(translate(v, '０１２３４５６７８９．，－＋', '0123456789.,-+'), '[$¥€£￥, ]', '', 'g') AS num,
         regexp_replace(regexp_replace(v, '^(\d{4})(\d{2})(\d{2})$', '\1-\2-\3'), '^(\d{1,2})\.(\d{1,2})\.(\d{4})', '\3-\2-\1') AS day
  FROM newest WHERE k = 1 AND lower(v) NOT IN ('', 'none', 'null', 'n/a')),
read AS (
  SELECT id, name, CASE kind
    WHEN 'string' THEN v
    WHEN 'float' THEN CASE WHEN regexp_full_match(num, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN CAST(TRY_CAST(TRY_CAST(num AS DOUBLE) AS DECIMAL(30, 2)) AS VARCHAR) END
    WHEN 'integer' THEN CASE WHEN regexp_full_match(num, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AND TRY_CAST(num AS DOUBLE) = floor(TRY_CAST(num AS DOUBLE)) THEN CAST(TRY_CAST(TRY_CAST(num AS DOUBLE) AS BIGINT) AS VARCHAR) END
    WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END
    WHEN 'timestamp' THEN CASE WHEN regexp_matches(day, '^\d{4}[-/年]') THEN
      strftime(TRY_CAST(replace(replace(replace(replace(day, '年', '-'), '月', '-'), '日', ''), '/', '-') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END END AS value_text
  FROM kept)
SELECT id AS instance_id, name AS column_name, value_text FROM read WHERE value_text IS NOT NULL
"""

_COLUMNS = "line_id order_id order_date region channel customer_id segment industry product_id category quantity unit_price discount sales cogs profit".split()

P2 = f"""
WITH reg AS (
  SELECT dataset_name, load_no, row_count, CAST(columns_json AS JSON[]) AS spec FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_name, load_no ORDER BY updated_at DESC) AS k FROM catalog_tables)
  WHERE k = 1 AND dataset_name IN (SELECT dataset_name FROM sales_lines)),
cols AS (
  SELECT dataset_name, load_no, s->>'name' AS c, s->>'semantic_type' AS kind, CAST(s->>'is_nullable' AS BOOLEAN) AS nullable, s->>'comment' AS note
  FROM (SELECT dataset_name, load_no, unnest(spec) AS s FROM reg)),
long AS (
  SELECT dataset_name, load_no, c, v FROM (SELECT dataset_name, load_no, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _COLUMNS)} FROM sales_lines)
  UNPIVOT INCLUDE NULLS (v FOR c IN ({", ".join(_COLUMNS)}))),
fig AS (
  SELECT dataset_name, load_no, c, count(*) AS n, count(v) AS f, count(DISTINCT v) AS d, min(TRY_CAST(v AS DOUBLE)) AS lo, max(TRY_CAST(v AS DOUBLE)) AS hi,
         min(v) AS tlo, max(v) AS thi, avg(TRY_CAST(v AS DOUBLE)) AS m, stddev_pop(TRY_CAST(v AS DOUBLE)) AS sd
  FROM long GROUP BY ALL),
pair AS (
  SELECT a.*, k.kind, k.nullable, k.note, b.n AS bn, b.f AS bf, b.d AS bd, b.m AS bm, b.sd AS bsd,
         regexp_extract(note, '^range (\\S+?)\\.\\.(\\S+)$', 1) AS r0, regexp_extract(note, '^range (\\S+?)\\.\\.(\\S+)$', 2) AS r1
  FROM fig a JOIN cols k USING (dataset_name, load_no, c)
  LEFT JOIN fig b ON b.dataset_name = a.dataset_name AND b.c = a.c AND b.load_no = a.load_no - 1),
shares AS (
  SELECT l.dataset_name, l.load_no, l.c, l.v, count(*) / any_value(b.f) AS p FROM long l JOIN fig b USING (dataset_name, load_no, c)
  WHERE l.v IS NOT NULL AND l.c IN (SELECT c FROM cols WHERE kind = 'DIMENSION_CATEGORICAL') GROUP BY ALL),
mix AS (
  SELECT dataset_name, load_no, c, sum(d) / 2 AS x FROM (
    SELECT dataset_name, load_no, c, v, abs(sum(p)) AS d FROM (
      SELECT dataset_name, load_no, c, v, p FROM shares UNION ALL SELECT dataset_name, load_no + 1, c, v, -p FROM shares)
    GROUP BY ALL) GROUP BY ALL),
found AS (
  SELECT dataset_name, load_no, c, 'null_in_required' AS finding FROM pair WHERE NOT nullable AND f < n
  UNION ALL SELECT dataset_name, load_no, c, 'range' FROM pair WHERE r0 <> '' AND CASE WHEN lo IS NOT NULL THEN lo < TRY_CAST(r0 AS DOUBLE) OR hi > TRY_CAST(r1 AS DOUBLE) ELSE tlo < r0 OR thi > r1 END
  UNION ALL SELECT DISTINCT l.dataset_name, l.load_no, l.c, 'pattern' FROM long l JOIN cols k USING (dataset_name, load_no, c)
    WHERE starts_with(note, 'pattern ') AND NOT regexp_full_match(v, substr(note, 9))
  UNION ALL SELECT dataset_name, load_no, c, 'null_share' FROM pair WHERE 100 * abs((n - f) * bn - (bn - bf) * n) > 15 * n * bn
  UNION ALL SELECT b.dataset_name, b.load_no, b.c, 'mix' FROM pair b JOIN mix USING (dataset_name, load_no, c) WHERE kind = 'DIMENSION_CATEGORICAL' AND f > 0 AND bf > 0 AND x > 0.35
  UNION ALL SELECT dataset_name, load_no, c, 'level' FROM pair WHERE kind = 'MEASURE' AND f > 0 AND bf > 0 AND abs(m - bm) > bsd
  UNION ALL SELECT dataset_name, load_no, c, 'distinct' FROM pair WHERE kind = 'IDENTIFIER' AND f > 0 AND bf > 0 AND (2 * d * bf < bd * f OR d * bf > 2 * bd * f)
  UNION ALL SELECT r.dataset_name, r.load_no, '*', 'row_count' FROM reg r LEFT JOIN (SELECT dataset_name, load_no, count(*) AS n FROM sales_lines GROUP BY ALL) s USING (dataset_name, load_no)
    WHERE r.row_count <> coalesce(s.n, 0))
SELECT dataset_name, load_no, c AS column_name, finding FROM found
"""

P2_PROFILE = P2[: P2.index("found AS (")].rstrip().removesuffix(",") + """,
entropy AS (SELECT dataset_name, load_no, c, -sum(p * ln(p)) AS h FROM (
    SELECT l.dataset_name, l.load_no, l.c, l.v, count(*) / any_value(b.f) AS p FROM long l JOIN fig b USING (dataset_name, load_no, c) WHERE l.v IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT p.dataset_name, p.load_no, p.c AS column_name, p.kind AS semantic_type, p.n AS n_rows, p.n - p.f AS n_null, p.d AS n_distinct, round(p.m, 4) AS mean, round(p.sd, 4) AS deviation,
       round(coalesce(e.h, 0), 6) AS entropy, CASE WHEN p.kind = 'DIMENSION_CATEGORICAL' AND p.f > 0 AND p.bf > 0 THEN round(x.x, 6) END AS shift
FROM pair p LEFT JOIN entropy e USING (dataset_name, load_no, c) LEFT JOIN mix x USING (dataset_name, load_no, c)
"""

_TYPE = """CASE WHEN t IN ('int32', 'integer') THEN 'int' WHEN t IN ('int64', 'bigint') THEN 'bigint' WHEN t IN ('double', 'float64', 'double precision') THEN 'double'
  WHEN t IN ('decimal128(18, 2)', 'decimal(18,2)', 'numeric(18,2)') THEN 'decimal' WHEN t IN ('string', 'varchar', 'text') THEN 'string' WHEN t IN ('date32[day]', 'date') THEN 'date'
  WHEN t IN ('timestamp[us]', 'timestamp', 'timestamp without time zone') THEN 'timestamp' WHEN t IN ('bool', 'boolean') THEN 'boolean' ELSE t END"""

P4 = f"""
WITH reg AS (
  SELECT dataset_name AS d, load_no AS l, CAST(columns_json AS JSON[]) AS spec FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_name, load_no ORDER BY updated_at DESC) AS k FROM catalog_tables) WHERE k = 1),
cols AS (SELECT d, l, n, {_TYPE} AS t FROM (SELECT d, l, s->>'name' AS n, lower(s->>'physical_type') AS t FROM (SELECT d, l, unnest(spec) AS s FROM reg))),
later AS (SELECT d, l FROM reg WHERE (d, l - 1) IN (SELECT (d, l) FROM reg)),
gone AS (SELECT p.d, p.l, c.n, c.t FROM later p JOIN cols c ON c.d = p.d AND c.l = p.l - 1 WHERE NOT EXISTS (SELECT 1 FROM cols x WHERE x.d = p.d AND x.l = p.l AND x.n = c.n)),
come AS (SELECT p.d, p.l, c.n, c.t FROM later p JOIN cols c ON c.d = p.d AND c.l = p.l WHERE NOT EXISTS (SELECT 1 FROM cols x WHERE x.d = p.d AND x.l = p.l - 1 AND x.n = c.n)),
rec AS (SELECT DISTINCT dataset_name AS d, load_no AS l, record_no AS r, payload FROM raw_records),
vals AS (
  SELECT g.d, g.l, g.n AS a, g.t AS ta, c.n AS b, c.t AS tb, json_extract_string(x.payload, '$."' || g.n || '"') AS va, json_extract_string(y.payload, '$."' || c.n || '"') AS vb
  FROM gone g JOIN come c USING (d, l) JOIN rec x ON x.d = g.d AND x.l = g.l - 1 JOIN rec y ON y.d = g.d AND y.l = g.l AND y.r = x.r),
same AS (
  SELECT d, l, a, ta, b, tb FROM vals GROUP BY ALL
  HAVING count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) >= 2 AND count(*) FILTER (va = vb OR TRY_CAST(va AS DECIMAL(30, 6)) = TRY_CAST(vb AS DECIMAL(30, 6))
      OR (regexp_matches(va, '^\\d{{4}}-\\d\\d-\\d\\d') AND least(length(va), length(vb)) = 10 AND left(va, 10) = left(vb, 10))
      OR (CASE WHEN va IN ('true', '1') THEN 1 WHEN va IN ('false', '0') THEN 0 END) = (CASE WHEN lower(vb) IN ('true', '1') THEN 1 WHEN lower(vb) IN ('false', '0') THEN 0 END)
      OR lower(va) = lower(vb)) >= 0.9 * count(*) FILTER (va IS NOT NULL OR vb IS NOT NULL))
SELECT d AS dataset_name, l AS load_no, kind AS change_kind, a AS old_name, b AS new_name FROM (
  SELECT d, l, 'renamed' AS kind, a, b FROM same
  UNION ALL SELECT d, l, 'retyped', a, b FROM same WHERE ta <> tb
  UNION ALL SELECT o.d, p.l, 'retyped', o.n, o.n FROM later p JOIN cols o ON o.d = p.d AND o.l = p.l - 1 JOIN cols c ON c.d = p.d AND c.l = p.l AND c.n = o.n WHERE o.t <> c.t
  UNION ALL SELECT d, l, 'removed', n, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.d = g.d AND s.l = g.l AND s.a = g.n)
  UNION ALL SELECT d, l, 'added', '', n FROM come c WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.d = c.d AND s.l = c.l AND s.b = c.n))
"""
