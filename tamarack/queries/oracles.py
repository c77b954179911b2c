"""SQL counterparts of the pN_ queries, for DuckDB over the same tables."""

from __future__ import annotations

#: Name key: outer blanks, one pair of brackets and case away.
_KEY = "lower(trim(CASE WHEN trim({0}, e' \\t\\r\\n') LIKE '[%]' THEN trim({0}, e' \\t\\r\\n')[2:-2] ELSE {0} END, e' \\t\\r\\n'))"


def _key(column: str) -> str:
    return _KEY.format(column)


_PARENTS = f"""
d AS (SELECT control_id, arg_max(form_id, loaded_at) AS form_id, arg_max(db_file, loaded_at) AS db_file, arg_max(form_name, loaded_at) AS form_name,
             arg_max(ctl_name, loaded_at) AS ctl_name, arg_max(section_name, loaded_at) AS section_name, arg_max(is_section, loaded_at) AS is_section,
             arg_max(source_object, loaded_at) AS source_object, arg_max(ctl_type, loaded_at) AS ctl_type
      FROM form_control GROUP BY control_id),
named AS (SELECT form_id, {_key('ctl_name')} AS name, min(control_id) AS parent_id FROM d WHERE ctl_name IS NOT NULL GROUP BY 1, 2),
hosts AS (SELECT db_file, {_key("regexp_replace(source_object, '(?i)^ *form *[.]', '')")} AS name, min(control_id) AS parent_id FROM d
          WHERE ctl_type = 'SubForm' AND trim(source_object) <> '' AND NOT regexp_matches(source_object, '(?i)^ *(table|query|report) *[.]') GROUP BY 1, 2),
par AS (SELECT d.control_id, CASE WHEN d.is_section THEN h.parent_id ELSE n.parent_id END AS parent_id FROM d
        LEFT JOIN named n ON NOT d.is_section AND n.form_id = d.form_id AND n.name = {_key('d.section_name')}
        LEFT JOIN hosts h ON d.is_section AND h.db_file = d.db_file AND h.name = {_key('d.form_name')}),
walk(id, cur, path) AS (SELECT control_id, control_id, [control_id] FROM par
        UNION ALL SELECT w.id, p.parent_id, list_append(w.path, p.parent_id) FROM walk w JOIN par p ON p.control_id = w.cur
        WHERE p.parent_id IS NOT NULL AND NOT list_contains(w.path[:-2], w.cur)),
ends AS (SELECT w.id, w.cur, w.path, list_contains(w.path[:-2], w.cur) AS looped FROM walk w JOIN par p ON p.control_id = w.cur
         WHERE p.parent_id IS NULL OR list_contains(w.path[:-2], w.cur))
"""

_TYPES = """CASE WHEN col_type IS NOT NULL THEN CAST(col_type AS VARCHAR) ELSE CASE lower(trim(type_name))
 WHEN 'bool' THEN '1' WHEN 'yes/no' THEN '1' WHEN 'byte' THEN '2' WHEN 'int' THEN '3' WHEN 'integer' THEN '3' WHEN 'longint' THEN '4' WHEN 'long integer' THEN '4'
 WHEN 'money' THEN '5' WHEN 'currency' THEN '5' WHEN 'double' THEN '7' WHEN 'datetime' THEN '8' WHEN 'date/time' THEN '8' WHEN 'text' THEN '10' WHEN 'short text' THEN '10'
 WHEN 'memo' THEN '12' WHEN 'long text' THEN '12' WHEN 'numeric' THEN '16' WHEN 'decimal' THEN '16' ELSE lower(trim(type_name)) END END"""

_SEPS = ";,|\\t\\r\\n；，"

_LIVES = "o.created_at <= r.exported_at AND (o.deleted_at IS NULL OR o.deleted_at > r.exported_at)"
_REASON = "CASE WHEN count(o.known) = 0 THEN 'missing' WHEN bool_or(o.created_at <= r.exported_at) THEN 'deleted' ELSE 'late' END"

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_PARENTS}
SELECT id AS control_id, CASE WHEN looped THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root_id,
       CAST(CASE WHEN looped THEN -1 ELSE len(path) - 1 END AS INTEGER) AS node_depth FROM ends""",
    "p1_descendants": f"""WITH RECURSIVE {_PARENTS}
SELECT path[k + 1] AS ancestor_id, id, CAST(k AS INTEGER) AS distance FROM (SELECT id, path, unnest(range(1, len(path))) AS k FROM ends WHERE NOT looped)""",
    "p2_found": """WITH RECURSIVE
docs AS (SELECT export_id, arg_max(content_json, loaded_at) AS j FROM form_export GROUP BY export_id),
lists(owner, list_key, kind) AS (VALUES ('form', 'properties', 'property'), ('form', 'sections', 'section'), ('section', 'properties', 'property'),
    ('section', 'controls', 'control'), ('control', 'properties', 'property'), ('control', 'controls', 'control')),
nodes(export_id, kind, path, obj) AS (
    SELECT export_id, 'form', '', CAST(lower(j) AS JSON) FROM docs WHERE j IS NOT NULL AND json_valid(j)
    UNION ALL
    SELECT s.export_id, s.kind, CASE WHEN s.path = '' THEN '' ELSE s.path || '.' END || CAST(s.pos AS VARCHAR), s.item FROM (
        SELECT x.export_id, x.kind, x.path, unnest(x.arr) AS item, generate_subscripts(x.arr, 1) - 1 AS pos FROM (
            SELECT y.export_id, y.kind, y.path, CASE json_type(y.v) WHEN 'ARRAY' THEN CAST(y.v AS JSON[]) WHEN 'OBJECT' THEN [y.v] ELSE CAST([] AS JSON[]) END AS arr FROM (
                SELECT n.export_id, l.kind, n.path, CASE WHEN json_type(n.obj, '$.' || l.list_key) = 'VARCHAR'
                       THEN CASE WHEN json_valid(json_extract_string(n.obj, '$.' || l.list_key)) THEN CAST(json_extract_string(n.obj, '$.' || l.list_key) AS JSON) END
                       ELSE json_extract(n.obj, '$.' || l.list_key) END AS v
                FROM nodes n JOIN lists l ON l.owner = n.kind) y) x) s
    WHERE json_type(s.item) = 'OBJECT'),
comps AS (SELECT export_id, unnest(c) AS comp, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT export_id, arg_max(components, loaded_at) AS c FROM form_export GROUP BY export_id))
SELECT export_id, kind AS node_kind, path AS node_path FROM nodes WHERE kind <> 'form'
UNION ALL SELECT export_id, 'component', CAST(pos AS VARCHAR) FROM comps WHERE comp IS NOT NULL
UNION ALL SELECT export_id, 'item', CAST(pos AS VARCHAR) || '.' || CAST(inner_pos AS VARCHAR)
    FROM (SELECT export_id, pos, unnest(comp.properties) AS i, generate_subscripts(comp.properties, 1) - 1 AS inner_pos FROM comps) WHERE i IS NOT NULL""",
    "p3_found": f"""WITH f AS (
    SELECT DISTINCT control_id, unnest(['link_child_fields', 'link_master_fields', 'column_widths', 'row_source']) AS field_name,
           unnest([link_child_fields, link_master_fields, regexp_replace(regexp_replace(column_widths, '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'),
                   CASE WHEN replace(lower(row_source_type), ' ', '') = 'valuelist' THEN row_source END]) AS txt FROM form_control),
t AS (SELECT control_id, field_name, trim(txt) AS s FROM f WHERE trim(txt) <> ''),
v AS (SELECT control_id, field_name, regexp_extract_all(replace(CASE WHEN regexp_matches(s, e'[{_SEPS}]$') THEN s ELSE s || ';' END, e'\\r\\n', e'\\n'),
        e'( *"(?:[^"]|"")*" *| *\\'(?:[^\\']|\\'\\')*\\' *| *\\\\[[^\\\\]]*\\\\] *|[^{_SEPS}]*)[{_SEPS}]', 1) AS parts FROM t),
p AS (SELECT control_id, field_name, trim(unnest(parts)) AS x, generate_subscripts(parts, 1) AS n FROM v)
SELECT control_id, field_name, CAST(n AS INTEGER) AS item_no,
       replace(CASE WHEN len(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN replace(x[2:-2], '""', '"') WHEN len(x) > 1 AND x[1] = '''' AND x[-1] = '''' THEN replace(x[2:-2], '''''', '''')
            WHEN x[1] = '[' AND x[-1] = ']' THEN x[2:-2] ELSE x END, chr(1), ',') AS item_text FROM p""",
    "p4_found": f"""WITH c AS (SELECT DISTINCT ON (db_name, file_no, tn, cn) db_name, file_no, lower(trim(file_name)) AS file_name, lower(trim(table_name)) AS tn, lower(trim(col_name)) AS cn, {_TYPES} AS kind, col_pos
           FROM schema_column ORDER BY db_name, file_no, tn, cn, loaded_at DESC),
o AS (SELECT *, coalesce(lag(cn) OVER w, '^') AS l, coalesce(lead(cn) OVER w, '$') AS r FROM c WINDOW w AS (PARTITION BY db_name, file_no, tn ORDER BY col_pos)),
files AS (SELECT *, lag(file_no) OVER (PARTITION BY db_name ORDER BY file_no) AS prev FROM (SELECT DISTINCT db_name, file_no, file_name FROM c)),
tabs AS (SELECT db_name, file_no, tn, string_agg(cn || ':' || kind, ',' ORDER BY col_pos) AS layout FROM c GROUP BY ALL),
news AS (SELECT f.db_name, f.file_no, f.file_name, t.tn, t.layout FROM files f JOIN tabs t USING (db_name, file_no) WHERE f.prev IS NOT NULL),
olds AS (SELECT f.db_name, f.file_no, f.file_name, t.tn, t.layout FROM files f JOIN tabs t ON t.db_name = f.db_name AND t.file_no = f.prev),
came AS (SELECT *, row_number() OVER (PARTITION BY db_name, file_no, layout ORDER BY tn) AS k FROM news ANTI JOIN olds USING (db_name, file_no, tn)),
gone AS (SELECT *, row_number() OVER (PARTITION BY db_name, file_no, layout ORDER BY tn) AS k FROM olds ANTI JOIN news USING (db_name, file_no, tn)),
both_in AS (SELECT db_name, file_no, file_name, tn FROM news SEMI JOIN olds USING (db_name, file_no, tn)),
nc AS (SELECT b.db_name, b.file_no, b.file_name, b.tn, o.cn, o.kind, o.l, o.r FROM both_in b JOIN o USING (db_name, file_no, tn)),
oc AS (SELECT b.db_name, b.file_no, b.file_name, b.tn, o.cn, o.kind, o.l, o.r FROM both_in b JOIN files f USING (db_name, file_no) JOIN o ON o.db_name = b.db_name AND o.file_no = f.prev AND o.tn = b.tn),
cc AS (SELECT * FROM nc ANTI JOIN oc USING (db_name, file_no, tn, cn)),
gc AS (SELECT * FROM oc ANTI JOIN nc USING (db_name, file_no, tn, cn)),
ren AS (SELECT cc.db_name, cc.file_no, cc.file_name, cc.tn, cc.cn, gc.cn AS old FROM cc JOIN gc USING (db_name, file_no, tn, kind, l, r))
SELECT came.file_name, came.tn AS table_name, '' AS col_name, CASE WHEN gone.tn IS NOT NULL THEN 'table_renamed' ELSE 'table_added' END AS change_kind
    FROM came LEFT JOIN gone ON gone.db_name = came.db_name AND gone.file_no = came.file_no AND gone.layout = came.layout AND gone.k = came.k
UNION ALL SELECT file_name, tn, '', 'table_removed' FROM gone ANTI JOIN came USING (db_name, file_no, layout, k)
UNION ALL SELECT file_name, tn, cn, 'renamed' FROM ren
UNION ALL SELECT file_name, tn, cn, 'added' FROM cc ANTI JOIN ren USING (db_name, file_no, tn, cn)
UNION ALL SELECT gc.file_name, gc.tn, gc.cn, 'removed' FROM gc LEFT JOIN ren ON ren.db_name = gc.db_name AND ren.file_no = gc.file_no AND ren.tn = gc.tn AND ren.old = gc.cn WHERE ren.cn IS NULL
UNION ALL SELECT nc.file_name, nc.tn, nc.cn, 'type_changed' FROM nc JOIN oc USING (db_name, file_no, tn, cn) WHERE nc.kind <> oc.kind""",
    "p6_found": f"""WITH fo AS (SELECT DISTINCT form_id, db_file, form_name, record_source, created_at, deleted_at, exported_at FROM form_content),
co AS (SELECT DISTINCT control_id, form_id, db_file, source_object, control_source, exported_at FROM form_control),
targets AS (SELECT db_file, 'form' AS kind, {_key('form_name')} AS name, created_at, deleted_at, 1 AS known FROM fo
    UNION ALL SELECT db_file, CASE obj_type WHEN 1 THEN 'table' WHEN 5 THEN 'query' ELSE 'report' END, {_key('obj_name')}, created_at, deleted_at, 1 FROM catalog_object),
uses AS (SELECT control_id, db_file, exported_at, coalesce(nullif(lower(regexp_extract(source_object, '(?i)^ *(form|table|query|report) *[.]', 1)), ''), 'form') AS kind,
                {_key("regexp_replace(source_object, '(?i)^ *(form|table|query|report) *[.]', '')")} AS name FROM co WHERE trim(source_object) <> ''),
so AS (SELECT 'source_object' AS ref_field, r.control_id AS record_id, {_REASON} AS reason, r.exported_at FROM uses r LEFT JOIN targets o USING (db_file, kind, name)
       GROUP BY r.control_id, r.exported_at HAVING NOT coalesce(bool_or({_LIVES}), FALSE)),
src AS (SELECT form_id, db_file, exported_at, CASE WHEN regexp_matches(record_source, '(?i)^\\s*select\\s')
           THEN list_transform(regexp_extract_all(regexp_replace(regexp_replace(record_source, '''[^'']*''', '', 'g'), '"[^"]*"', '', 'g'), '(?i)\\b(?:from|join)\\s+[(]*\\s*(\\[[^\\]]+\\]|[^\\s,;()]+)', 1), lambda x: {_key('x')})
           ELSE [{_key('record_source')}] END AS names FROM fo WHERE trim(record_source) <> ''),
reads AS (SELECT DISTINCT form_id, db_file, exported_at, unnest(names) AS name FROM src),
lost AS (SELECT r.form_id, r.name, r.db_file, {_REASON} AS reason, r.exported_at FROM reads r LEFT JOIN (SELECT * FROM targets WHERE kind IN ('table', 'query')) o USING (db_file, name)
         GROUP BY r.form_id, r.name, r.db_file, r.exported_at HAVING NOT coalesce(bool_or({_LIVES}), FALSE)),
rs AS (SELECT 'record_source' AS ref_field, form_id AS record_id, arg_min(reason, list_position(['missing', 'deleted', 'late'], reason)) AS reason, exported_at FROM lost GROUP BY form_id, exported_at),
fr AS (SELECT c.control_id, c.db_file, c.exported_at, src.form_id, src.names, trim(c.control_source) AS t FROM co c JOIN src USING (form_id)
       WHERE trim(c.control_source) <> '' AND NOT starts_with(trim(c.control_source), '=')),
then_lost AS (SELECT x.control_id FROM (SELECT control_id, db_file, exported_at, unnest(names) AS name FROM fr) x LEFT JOIN (SELECT * FROM targets WHERE kind IN ('table', 'query')) o USING (db_file, name)
       GROUP BY x.control_id, x.name HAVING NOT coalesce(bool_or(o.created_at <= x.exported_at AND (o.deleted_at IS NULL OR o.deleted_at > x.exported_at)), FALSE)),
judged AS (SELECT *, regexp_extract(t, '^(\\[[^\\]]*\\]|[^.\\[\\]]*)\\s*[.]', 1) AS own FROM fr ANTI JOIN then_lost USING (control_id)),
asked AS (SELECT control_id, db_file, exported_at, unnest(CASE WHEN own = '' THEN names ELSE [{_key('own')}] END) AS name,
          {_key("CASE WHEN own = '' THEN t ELSE regexp_replace(t, '^(\\[[^\\]]*\\]|[^.\\[\\]]*)\\s*[.]', '') END")} AS field FROM judged),
flds AS (SELECT db_file, {_key('obj_name')} AS name, {_key('field_name')} AS field, created_at, deleted_at, 1 AS known FROM catalog_field),
cs AS (SELECT 'control_source' AS ref_field, r.control_id AS record_id, {_REASON} AS reason, r.exported_at FROM asked r LEFT JOIN flds o USING (db_file, name, field)
       GROUP BY r.control_id, r.exported_at HAVING NOT coalesce(bool_or({_LIVES}), FALSE))
SELECT ref_field, record_id, reason, strftime(exported_at, '%Y-%m') AS period_month FROM (SELECT * FROM so UNION ALL SELECT * FROM rs UNION ALL SELECT * FROM cs)""",
    "p7_found": """WITH a AS (SELECT owner_kind, owner_id, regexp_replace(lower(prop_name), '[\\s_]+', '', 'g') AS attr, trim(prop_value) AS v, recorded_at, prop_row_id FROM form_property),
n AS (SELECT *, CASE WHEN regexp_matches(v, '^[-+]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.]0*)?$') THEN CAST(replace(replace(regexp_replace(v, '[.]0*$', ''), ',', ''), '+', '') AS BIGINT)
                     WHEN regexp_matches(v, '^&[hH][0-9a-fA-F]+&?$') THEN CAST('0x' || regexp_replace(v, '^&[hH]|&$', '', 'g') AS BIGINT) END AS whole FROM a),
r AS (SELECT owner_kind, owner_id, attr, recorded_at, prop_row_id, CASE
    WHEN attr IN ('width', 'height', 'left', 'top', 'tabindex', 'fontsize', 'columncount', 'listrows', 'borderwidth') THEN CAST(whole AS VARCHAR)
    WHEN attr IN ('visible', 'locked', 'canshrink', 'underline') THEN CASE WHEN lower(v) IN ('-1', '1', 'true', 'yes', 'on') THEN 'true' WHEN lower(v) IN ('0', 'false', 'no', 'off') THEN 'false' END
    WHEN attr IN ('backcolor', 'forecolor', 'bordercolor') THEN CASE WHEN regexp_matches(v, '^#[0-9a-fA-F]{6}$') THEN lower(v)
        WHEN whole BETWEEN 0 AND 16777215 AND NOT contains(v, ',') THEN printf('#%02x%02x%02x', whole & 255, (whole >> 8) & 255, (whole >> 16) & 255) END
    WHEN attr IN ('linespacing', 'scalefactor') THEN CASE WHEN regexp_matches(v, '^[-+]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)$') THEN CAST(CAST(CAST(replace(v, ',', '.') AS DECIMAL(30, 10)) AS DECIMAL(18, 2)) AS VARCHAR) END
    WHEN attr IN ('datecreated', 'lastupdated') THEN strftime(coalesce(try_strptime(v, '%Y%m%d'), try_strptime(v[1:10], '%Y-%m-%d'), try_strptime(v[1:10], '%Y/%m/%d'), try_strptime(v[1:10], '%d.%m.%Y')), '%Y-%m-%d')
    WHEN attr IN ('caption', 'fontname', 'tag', 'statusbartext') THEN nullif(v, '') END AS cell FROM n)
SELECT owner_kind, owner_id, attr AS attr_name, arg_max(cell, (recorded_at, prop_row_id)) AS cell_value FROM r WHERE cell IS NOT NULL GROUP BY ALL""",
}
ORACLES["p4_objects"] = """SELECT db_file, obj_name, CAST(obj_type AS INTEGER) AS obj_type, created_at, deleted_at FROM catalog_object
UNION ALL SELECT db_file, form_name, NULL, created_at, deleted_at FROM form_content"""
ORACLES["p2_schema"] = ORACLES["p2_found"][: ORACLES["p2_found"].index("SELECT export_id, kind AS node_kind")] + """,
pairs AS (SELECT n.kind, trim(e.key) AS attribute, CASE WHEN e.type = 'NULL' THEN NULL ELSE trim(coalesce(json_extract_string(e.value, '$'), CAST(e.value AS VARCHAR))) END AS v
          FROM nodes n, json_each(n.obj) e WHERE n.kind <> 'form' AND NOT (n.kind IN ('section', 'control') AND trim(e.key) IN ('properties', 'controls'))
    UNION ALL SELECT 'component', 'comp_name', trim(comp.comp_name) FROM comps WHERE comp IS NOT NULL
    UNION ALL SELECT 'item', unnest(['prop_key', 'prop_value']), unnest([trim(i.prop_key), trim(i.prop_value)]) FROM (SELECT unnest(comp.properties) AS i FROM comps) WHERE i IS NOT NULL),
shaped AS (SELECT kind, attribute, CASE WHEN v IS NULL THEN 0 WHEN regexp_full_match(v, '-?[0-9]{1,18}') THEN 1 WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?(e[-+]?[0-9]+)?') THEN 2 WHEN v IN ('true', 'false') THEN 8 ELSE 4 END AS shape FROM pairs),
seen AS (SELECT kind, attribute, count(*) AS n_rows, bit_or(shape) AS shapes FROM shaped GROUP BY ALL)
SELECT kind, attribute, n_rows, CASE WHEN shapes = 0 THEN 'string' WHEN shapes = 1 THEN 'bigint' WHEN shapes < 4 THEN 'double' WHEN shapes = 8 THEN 'boolean' ELSE 'string' END AS type FROM seen"""
_CI = "coalesce(nullif(json_extract({0}, '$.{1}'), 'null'), nullif(json_extract({0}, '$.{2}'), 'null'), nullif(json_extract({0}, '$.{3}'), 'null'))"


def _ci(obj: str, key: str) -> str:
    """A key's value, written in small letters, capitals or with one capital."""
    return _CI.format(obj, key.lower(), key, key.upper())


_ARRAY = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({0}, '$')) THEN CASE json_type(CAST(json_extract_string({0}, '$') AS JSON)) WHEN 'ARRAY' THEN CAST(CAST(json_extract_string({0}, '$') AS JSON) AS JSON[]) WHEN 'OBJECT' THEN [CAST(json_extract_string({0}, '$') AS JSON)] END END END"
_CELL = "json_extract_string({0}, '$')"
_WHOLE = "CASE WHEN regexp_full_match(trim(json_extract_string({0}, '$')), '[-+]?[0-9]{{1,18}}') THEN CAST(trim(json_extract_string({0}, '$')) AS BIGINT) END"
ORACLES["p2_controls"] = f"""WITH RECURSIVE docs AS (SELECT export_id, arg_max(content_json, loaded_at) AS j FROM form_export GROUP BY export_id),
secs AS (SELECT export_id, unnest(a) AS obj, generate_subscripts(a, 1) - 1 AS n FROM (SELECT export_id, {_ARRAY.format('v')} AS a FROM (SELECT export_id, {_ci('CAST(j AS JSON)', 'Sections')} AS v FROM docs WHERE j IS NOT NULL AND json_valid(j)))),
ctl AS (
    SELECT export_id, 'sections.controls' AS route, s.export_id || ':sections:' || s.n AS parent_key, s.n || '.' || k AS path, k AS ordinal, item AS obj
    FROM (SELECT export_id, n, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS k FROM (SELECT export_id, n, {_ARRAY.format('v')} AS a FROM (SELECT export_id, n, {_ci('obj', 'Controls')} AS v FROM secs WHERE json_type(obj) = 'OBJECT'))) s WHERE json_type(item) = 'OBJECT'
    UNION ALL
    SELECT export_id, route || '.controls', export_id || ':' || route || ':' || path, path || '.' || k, k, item
    FROM (SELECT export_id, route, path, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS k FROM (SELECT export_id, route, path, {_ARRAY.format('v')} AS a FROM (SELECT export_id, route, path, {_ci('obj', 'Controls')} AS v FROM ctl))) WHERE json_type(item) = 'OBJECT')
SELECT export_id, export_id || ':' || route || ':' || path AS node_key, parent_key, path, CAST(ordinal AS INTEGER) AS ordinal, {_CELL.format(_ci('obj', 'Name'))} AS name, {_CELL.format(_ci('obj', 'Type'))} AS type,
    {_WHOLE.format("coalesce(json_extract(obj, '$.TypeCode'), json_extract(obj, '$.typecode'), json_extract(obj, '$.typeCode'), json_extract(obj, '$.TYPECODE'))")} AS typecode, {_WHOLE.format(_ci('obj', 'Left'))} AS "left", {_WHOLE.format(_ci('obj', 'Top'))} AS top, {_CELL.format(_ci('obj', 'Caption'))} AS caption FROM ctl"""
ORACLES["p1_below"] = f"""WITH RECURSIVE {_PARENTS}
SELECT path[k + 1] AS ancestor_id, id, CAST(k AS INTEGER) AS distance FROM (SELECT id, path, unnest(range(1, CASE WHEN looped THEN list_position(path, cur) ELSE len(path) END)) AS k FROM ends)"""
_P4 = ORACLES["p4_found"][: ORACLES["p4_found"].index("SELECT came.file_name")].rstrip()
_ENDS = f"""WITH RECURSIVE{_P4[4:]},
steps AS (SELECT nc.db_name, f.prev AS no, nc.tn, oc.cn, nc.file_no AS no2, nc.tn AS tn2, nc.cn AS cn2 FROM nc JOIN oc USING (db_name, file_no, tn, cn) JOIN files f USING (db_name, file_no)
    UNION ALL SELECT ren.db_name, f.prev, ren.tn, ren.old, ren.file_no, ren.tn, ren.cn FROM ren JOIN files f USING (db_name, file_no)
    UNION ALL SELECT c.db_name, c.file_no, c.tn, c.cn, came.file_no, came.tn, c.cn FROM came JOIN gone ON gone.db_name = came.db_name AND gone.file_no = came.file_no AND gone.layout = came.layout AND gone.k = came.k
        JOIN files f ON f.db_name = came.db_name AND f.file_no = came.file_no JOIN c ON c.db_name = came.db_name AND c.file_no = f.prev AND c.tn = gone.tn),
reach AS (SELECT db_name, file_no, file_name, kind, tn AS old_table, cn AS old_column, file_no AS no, tn, cn FROM c
    UNION ALL SELECT r.db_name, r.file_no, r.file_name, r.kind, r.old_table, r.old_column, s.no2, s.tn2, s.cn2 FROM reach r JOIN steps s ON s.db_name = r.db_name AND s.no = r.no AND s.tn = r.tn AND s.cn = r.cn),
ends AS (SELECT r.* FROM reach r ANTI JOIN steps s ON s.db_name = r.db_name AND s.no = r.no AND s.tn = r.tn AND s.cn = r.cn)"""
ORACLES["p4_columns"] = f"{_ENDS} SELECT db_name, file_no, file_name, old_table, old_column, kind, tn AS table_name, cn AS col_name FROM ends"
ORACLES["p4_layout"] = f"""{_ENDS},
grouped AS (SELECT db_name, no, tn, cn, max(coalesce(nullif(list_position(['1', '2', '3', '4', '5', '16', '6', '7', '8', '10', '12', '15', '9', '11', '18'], kind), 0), 10)) AS widest, bool_or(kind IN ('8', '9', '11')) AS odd, count(DISTINCT kind) AS n_types,
    array_to_string(list_sort(list(DISTINCT kind)), ',') AS access_types, arg_min(file_name, file_no) AS first_file, arg_max(file_name, file_no) AS last_file, count(DISTINCT file_no) AS n_files FROM ends GROUP BY ALL)
SELECT db_name, tn AS table_name, cn AS col_name, CASE WHEN n_types > 1 AND odd THEN 'string' ELSE (['boolean', 'smallint', 'smallint', 'int', 'decimal(19,4)', 'decimal(28,6)', 'double', 'double', 'timestamp_ntz', 'string', 'string', 'string', 'binary', 'binary', 'int'])[widest] END AS spark_type,
    access_types, first_file, last_file, n_files FROM grouped"""
ORACLES["p6_counts"] = f"SELECT ref_field, reason, period_month, count(*) AS n_orphans FROM ({ORACLES['p6_found']}) GROUP BY ALL"
ORACLES["p1_paths"] = f"""WITH RECURSIVE {_PARENTS},
credited AS (SELECT unnest(CASE WHEN looped THEN path[1:list_position(path, cur)] ELSE path END) AS x FROM ends),
sizes AS (SELECT x, count(*) AS n FROM credited GROUP BY 1),
steps AS (SELECT id, unnest(path) AS node, generate_subscripts(path, 1) AS k FROM ends WHERE NOT looped),
names AS (SELECT s.id, string_agg(trim(coalesce(d.ctl_name, ''), e' \\t\\r\\n'), '/' ORDER BY s.k DESC) AS path_text FROM steps s JOIN d ON d.control_id = s.node GROUP BY 1)
SELECT e.id, par.parent_id, CASE WHEN looped THEN list_min(e.path[list_position(e.path, cur):]) ELSE cur END AS root_id, CAST(CASE WHEN looped THEN -1 ELSE len(e.path) - 1 END AS INTEGER) AS depth,
       names.path_text AS path, sizes.n AS subtree_size, looped AND list_position(e.path, cur) = 1 AS on_loop
FROM ends e JOIN par ON par.control_id = e.id JOIN sizes ON sizes.x = e.id LEFT JOIN names ON names.id = e.id"""


def _wide() -> str:
    from tamarack.operators.widen import ATTRIBUTES, SPARK_TYPES

    cells = [f"CAST(max(cell_value) FILTER (WHERE attr_name = '{n}') AS {SPARK_TYPES[k].replace('string', 'VARCHAR')}) AS \"{n}\"" for k, names in ATTRIBUTES.items() for n in names]
    return f"SELECT owner_kind, owner_id, {', '.join(cells)} FROM ({ORACLES['p7_found']}) GROUP BY ALL"


ORACLES["p7_wide"] = _wide()
