"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each fixture view of ``tagwarden.sources.fixtures`` has a CTE here with the same
definition; each query is ``WITH <ctes> SELECT ...`` over the pre-registered driver
tables. Column names and types are aligned with the Spark side.
"""

from __future__ import annotations

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


CTE = {
    "entities": """entities AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id,
         '/dags/' || c_mktsegment || '/' || CAST(o_orderkey AS VARCHAR) || '.py' AS path
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "entity_tags": """entity_tags AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entity_id, 'RF_' || l_returnflag AS tag FROM lineitem
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 'OS_' || o_orderstatus FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), CASE o_orderkey % 4 WHEN 0 THEN '  OS_' || o_orderstatus || ' ' WHEN 1 THEN '  '
         WHEN 2 THEN 'it''s a \\ tag' END FROM orders)""",
    "wide_tags": """entity_tags AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, 'PART_' || CAST(l_partkey AS VARCHAR) AS tag FROM lineitem)""",
    "wide_map": """tag_map AS (
  SELECT 'PART_' || CAST(p_partkey AS VARCHAR) AS tag, CASE WHEN p_size < 45 THEN 'us' ELSE 'global' END AS scope FROM part
  UNION ALL SELECT 'PART_' || CAST(p_partkey AS VARCHAR), 'apac' FROM part WHERE p_partkey % 7 = 0)""",
    "region_roles": """scope_role AS (
  SELECT * FROM (VALUES ('global','AF_TRIGGER_SCOPE_GLOBAL'), ('us','AF_TRIGGER_SCOPE_US'),
                        ('apac','AF_TRIGGER_SCOPE_APAC'), ('emea','AF_TRIGGER_SCOPE_EMEA')) t(scope, role))""",
    "tag_map": """tag_map AS (
  SELECT * FROM (VALUES ('RF_A','us'), ('OS_F','us'), ('RF_R','global'), ('OS_P','apac')) t(tag, scope))""",
    "scope_role": """scope_role AS (
  SELECT * FROM (VALUES ('global','AF_TRIGGER_SCOPE_GLOBAL'), ('us','AF_TRIGGER_SCOPE_US'),
                        ('mx','AF_TRIGGER_SCOPE_MX'), ('cn','AF_TRIGGER_SCOPE_CN')) t(scope, role))""",
}


def with_(*names: str, extra: tuple[str, ...] = ()) -> str:
    return "WITH " + ",\n".join([CTE[n] for n in names] + list(extra)) + "\n"


def classify_cte(name: str, entities: str, trim: bool) -> str:
    """SQL twin of operators.classify.classify over CTEs ``entities``/``entity_tags``/``tag_map``."""
    tag = strip("t.tag") if trim else "t.tag"
    return f"""{name} AS (
  SELECT e.entity_id,
         CASE WHEN coalesce(p.n, 0) = 1 THEN 'valid' WHEN coalesce(p.n, 0) > 1 THEN 'conflict' ELSE 'missing' END AS status,
         CASE WHEN p.n = 1 THEN p.scope1 END AS scope,
         coalesce(p.matched, []) AS matched_tags,
         coalesce(p.tags, []) AS tags
  FROM {entities} e LEFT JOIN (
    SELECT t.entity_id, count(DISTINCT m.scope) AS n, min(m.scope) AS scope1,
           list_sort(list(DISTINCT t.tag) FILTER (WHERE m.scope IS NOT NULL)) AS matched,
           list_sort(list(DISTINCT t.tag)) AS tags
    FROM (SELECT entity_id, {tag} AS tag FROM entity_tags t) t
         LEFT JOIN tag_map m ON t.tag = m.tag
    WHERE t.entity_id IS NOT NULL AND t.tag IS NOT NULL AND t.tag <> ''
    GROUP BY t.entity_id) p ON e.entity_id = p.entity_id)"""


def norm_path_sql(x: str) -> str:
    """Lexical path normalisation, the twin of functions.text.normalize_path."""
    parts = f"list_filter(string_split({x}, '/'), lambda s: s <> '' AND s <> '.')"
    fold = (f"list_reduce(list_prepend('', {parts}), lambda acc, s: CASE WHEN s <> '..' THEN acc || '/' || s "
            f"WHEN acc = '' THEN acc ELSE regexp_replace(acc, '/[^/]*$', '') END)")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE CASE WHEN {fold} = '' THEN '/' ELSE {fold} END END"


def under_root_sql(x: str, root: str) -> str:
    p = norm_path_sql(x)
    return f"coalesce(({p}) IS NOT NULL AND (({p}) = '{root}' OR starts_with({p}, '{root}/')), false)"


ROOT = "/dags/MACHINERY"

ORACLE: dict[str, str] = {}

ORACLE["classify_status"] = with_("entities", "entity_tags", "tag_map",
                                  extra=(classify_cte("classified", "entities", trim=True),)) + """
SELECT entity_id, status, scope, array_to_string(matched_tags, ',') AS matched_tags FROM classified"""

ORACLE["classify_wide"] = with_("entities", "wide_tags", "wide_map",
                                extra=(classify_cte("classified", "entities", trim=True),)) + """
SELECT entity_id, status, scope, array_to_string(matched_tags, ',') AS matched_tags FROM classified"""

ORACLE["tags_norm"] = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE array_to_string(list_filter(
  [{strip("' ' || o_orderstatus || chr(9)")}, CAST(NULL AS VARCHAR), o_orderpriority], lambda x: x <> ''), '|') END AS tags
FROM orders"""

ORACLE["no_role"] = with_("entities", "entity_tags", "tag_map", "scope_role",
                          extra=(classify_cte("classified", "entities", trim=True),)) + """
SELECT c.entity_id,
       CASE WHEN c.status = 'valid' AND r.role IS NULL THEN 'no_role' ELSE c.status END AS status,
       c.scope, CASE WHEN c.status = 'valid' THEN r.role END AS role
FROM classified c LEFT JOIN scope_role r ON c.scope = r.scope"""

ORACLE["outside_root"] = with_("entities") + f"""
SELECT entity_id, path, {under_root_sql('path', ROOT)} AS under_root FROM entities"""


def pylist(x: str) -> str:
    """Python's form of a list of strings (tags of the fixtures hold no control characters)."""
    body = "replace(t, '\\', '\\\\')"
    return (f"'[' || array_to_string(list_transform({x}, lambda t: CASE WHEN contains(t, chr(39)) AND NOT contains(t, chr(34)) "
            f"THEN chr(34) || {body} || chr(34) ELSE chr(39) || replace({body}, chr(39), '\\' || chr(39)) || chr(39) END), "
            "', ') || ']'")


CTE["inside"] = f"""inside AS (SELECT entity_id, path FROM entities WHERE {under_root_sql('path', ROOT)})"""
CTE["inside_sync"] = f"""inside_sync AS (
  SELECT entity_id, path FROM entities
  WHERE entity_id IS NOT NULL AND entity_id <> '' AND {under_root_sql('path', ROOT)})"""

ORACLE["violations"] = with_("entities", "entity_tags", "tag_map", "scope_role", "inside",
                             extra=(classify_cte("classified", "inside", trim=True),)) + f"""
SELECT entity_id, reason, {pylist('matched_tags')} AS matched_tags,
       '[''OS_F'', ''OS_P'', ''RF_A'', ''RF_R'']' AS expected_tags,
       {pylist('tags')} AS actual_tags,
       CASE reason
         WHEN 'conflict' THEN 'DAG ''' || entity_id || ''' has conflicting classification tags '
              || {pylist('matched_tags')} || '; expected exactly one classification tag.'
         WHEN 'missing' THEN 'DAG ''' || entity_id || ''' is missing required classification tag. Expected one of '
              || '[''OS_F'', ''OS_P'', ''RF_A'', ''RF_R'']' || ', got tags=' || {pylist('tags')}
         ELSE 'No trigger role mapping configured for scope ''' || scope || ''''
       END AS message
FROM (SELECT c.*, CASE WHEN c.status = 'valid' AND r.role IS NULL THEN 'no_role' ELSE c.status END AS reason
      FROM classified c LEFT JOIN scope_role r ON c.scope = r.scope)
WHERE reason <> 'valid'"""

CTE["desired"] = """desired AS (
  SELECT scope, entity_id FROM classified_sync WHERE status = 'valid' AND scope IN ('us', 'global'))"""


def _desired_ctes() -> tuple[str, ...]:
    return ("entities", "entity_tags", "tag_map", "inside_sync")


DESIRED_EXTRA = (classify_cte("classified_sync", "inside_sync", trim=False), CTE["desired"])

ORACLE["desired_grants"] = with_(*_desired_ctes(), extra=DESIRED_EXTRA) + "SELECT scope, entity_id FROM desired"

ORACLE["source_label"] = """
SELECT doc_id, source, tag,
       CASE tag WHEN 'GDTET_US_DAG' THEN 'us_dag' WHEN 'GDTET_GLOBAL_DAG' THEN 'global_dag' ELSE 'illegal_dag' END AS label
FROM (SELECT doc_id, source,
             CASE WHEN source IS NULL THEN NULL
                  WHEN source IN ('src0', 'src3', 'src5', 'src7') THEN 'GDTET_US_DAG'
                  ELSE 'GDTET_GLOBAL_DAG' END AS tag
      FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN source END AS source FROM documents))"""

CTE["tag_map_texts"] = """tag_map_texts AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN ' , =x, A= ' ELSE concat_ws(',',
           ' OS_' || o_orderstatus || ' = ' || o_orderpriority,
           CASE WHEN o_orderkey % 3 = 0 THEN 'OS_' || o_orderstatus || '=late=' || CAST(o_custkey AS VARCHAR) END,
           CASE WHEN o_orderkey % 4 = 1 THEN 'junk' ELSE '=' || o_orderstatus END,
           ' ',
           'P' || substr(o_orderpriority, 1, 1) || '= ' || upper(o_orderstatus) || ' ') END AS text
  FROM orders)"""
CTE["tag_map_items"] = f"""tag_map_items AS (
  SELECT o_orderkey, pos - 1 AS pos, item,
         {strip("substr(item, 1, strpos(item, '=') - 1)")} AS tag,
         lower({strip("substr(item, strpos(item, '=') + 1)")}) AS scope
  FROM (SELECT o_orderkey, {strip('parts[pos]')} AS item, pos
        FROM (SELECT o_orderkey, string_split(text, ',') AS parts FROM tag_map_texts),
             LATERAL (SELECT unnest(generate_series(1, len(parts))) AS pos)))"""
CTE["tag_map_valid"] = """tag_map_valid AS (
  SELECT * FROM tag_map_items WHERE item <> '' AND strpos(item, '=') > 0 AND tag <> '' AND scope <> '')"""

ORACLE["tag_map_parse"] = with_("tag_map_texts", "tag_map_items", "tag_map_valid") + """
SELECT o_orderkey, tag, arg_max(scope, pos) AS scope, 'parsed' AS origin FROM tag_map_valid GROUP BY o_orderkey, tag
UNION ALL
SELECT t.o_orderkey, d.tag, d.scope, 'default' AS origin
FROM tag_map_texts t CROSS JOIN (VALUES ('GDTET_GLOBAL_DAG', 'global'), ('GDTET_US_DAG', 'us')) d(tag, scope)
WHERE t.o_orderkey NOT IN (SELECT o_orderkey FROM tag_map_valid)"""

ORACLE["tag_map_rejects"] = with_("tag_map_texts", "tag_map_items") + """
SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, item,
       CASE WHEN strpos(item, '=') = 0 THEN 'missing ''=''' ELSE 'empty tag/scope' END AS reason
FROM tag_map_items
WHERE item <> '' AND NOT (strpos(item, '=') > 0 AND tag <> '' AND scope <> '')"""

CTE["scope_texts"] = """scope_texts AS (
  SELECT c_custkey, ' ' || c_mktsegment || ' , ' || lower(n_name) || ',,' ||
         CASE WHEN c_custkey % 2 = 0 THEN ' Global ' ELSE '' END AS text
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORACLE["scopes_norm"] = with_("scope_texts") + f"""
SELECT c_custkey, form, scope, 'AF_TRIGGER_SCOPE_' || upper(scope) AS role FROM (
  SELECT DISTINCT c_custkey, 'lenient' AS form, lower({strip('x')}) AS scope
  FROM scope_texts, LATERAL (SELECT unnest(string_split(text, ',')) AS x)
  WHERE lower({strip('x')}) <> ''
  UNION
  SELECT c_custkey, 'lenient', 'global' FROM scope_texts
  UNION
  SELECT DISTINCT c_custkey, 'strict', x
  FROM scope_texts, LATERAL (SELECT unnest(string_split(lower(regexp_replace(text, '\\s', '', 'g')), ',')) AS x)
  WHERE x <> ''
  UNION
  SELECT c_custkey, 'strict', 'global' FROM scope_texts WHERE regexp_replace(text, '\\s', '', 'g') <> '')"""

# ------------------------------------------------------------------ family C
CTE["grants"] = """grants AS (
  SELECT CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'AF_TRIGGER_SCOPE_US'
              WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN 'AF_TRIGGER_SCOPE_GLOBAL'
              ELSE 'Viewer' END AS role,
         CASE WHEN o_orderkey % 5 = 0 THEN 'can_read' ELSE 'can_create' END AS action,
         CASE WHEN o_orderkey % 7 = 0 THEN 'DAG:' || CAST(o_orderkey AS VARCHAR)
              ELSE 'DAG Run:' || CAST(o_orderkey AS VARCHAR) END AS resource
  FROM orders)"""
CTE["existing"] = """existing AS (
  SELECT DISTINCT s.scope, substr(g.resource, 9) AS entity_id
  FROM grants g JOIN (VALUES ('us', 'AF_TRIGGER_SCOPE_US'), ('global', 'AF_TRIGGER_SCOPE_GLOBAL')) s(scope, role)
       ON g.role = s.role
  WHERE g.action = 'can_create' AND starts_with(g.resource, 'DAG Run:') AND substr(g.resource, 9) <> '')"""
CTE["diff"] = """diff AS (
  SELECT coalesce(d.scope, e.scope) AS scope, CASE WHEN e.scope IS NULL THEN 'add' ELSE 'remove' END AS op,
         coalesce(d.entity_id, e.entity_id) AS entity_id
  FROM desired d FULL OUTER JOIN existing e ON d.scope = e.scope AND d.entity_id = e.entity_id
  WHERE d.scope IS NULL OR e.scope IS NULL)"""


def _c_with(*more: str) -> str:
    return with_(*_desired_ctes(), extra=DESIRED_EXTRA + (CTE["grants"], CTE["existing"]) + tuple(CTE[m] for m in more))


ORACLE["existing_grants"] = with_("grants", "existing") + "SELECT scope, entity_id FROM existing"
ORACLE["grant_diff"] = _c_with("diff") + "SELECT scope, op, entity_id FROM diff"
ORACLE["plan_rank"] = _c_with("diff") + """
SELECT scope, op, entity_id, row_number() OVER (ORDER BY scope, op = 'remove', entity_id) AS pos FROM diff"""
ORACLE["sync_counts"] = _c_with("diff") + """
SELECT 1 AS run, count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'remove') AS removed FROM diff
UNION ALL SELECT 2, 0, 0"""
ORACLE["diff_summary"] = _c_with("diff") + """
SELECT coalesce(scope, 'total') AS scope, count(*) FILTER (WHERE op = 'add') AS added,
       count(*) FILTER (WHERE op = 'remove') AS removed
FROM diff GROUP BY ROLLUP (scope)"""
ORACLE["grant_plan"] = _c_with("diff") + """
SELECT scope, op, entity_id,
       '[DRY-RUN] ctl roles ' || CASE WHEN op = 'add' THEN 'add-perms' ELSE 'del-perms' END || ' '
       || 'AF_TRIGGER_SCOPE_' || upper(scope) || ' -a can_create -r ''DAG Run:' || entity_id || '''' AS command
FROM diff"""
ORACLE["apply_diff"] = _c_with("diff") + """
SELECT scope, entity_id FROM existing
WHERE (scope, entity_id) NOT IN (SELECT scope, entity_id FROM diff WHERE op = 'remove')
UNION
SELECT scope, entity_id FROM diff WHERE op = 'add'"""

from tagwarden.sources.fixtures import ACL_DOCS  # noqa: E402  the documents themselves, not their reading

_docs = " ".join(f"WHEN {i} THEN " + ("NULL" if d is None else "'" + d.replace("'", "''") + "'") for i, d in enumerate(ACL_DOCS))
CTE["acl"] = f"""acl_raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, nullif(trim(CASE o_orderkey % {len(ACL_DOCS)} {_docs} END), '') AS acl_json
  FROM orders),
acl_judged AS (
  SELECT entity_id, acl_json, CASE WHEN acl_json IS NULL THEN NULL WHEN NOT json_valid(acl_json) THEN 'unreadable'
    WHEN json_type(acl_json) <> 'OBJECT' THEN 'not an object'
    WHEN len(json_keys(acl_json)) <> len(list_distinct(json_keys(acl_json))) THEN 'unreadable' END AS reason FROM acl_raw),
acl AS (SELECT entity_id, acl_json FROM acl_judged WHERE acl_json IS NOT NULL AND reason IS NULL)"""


def _acts(v: str) -> str:
    return (f"CASE json_type({v}) WHEN 'VARCHAR' THEN [json_extract_string({v}, '$')] "
            f"WHEN 'ARRAY' THEN list_transform(json_extract({v}, '$[*]'), lambda e: CASE json_type(e) WHEN 'NULL' THEN 'None' "
            f"WHEN 'BOOLEAN' THEN CASE WHEN CAST(e AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END "
            f"WHEN 'VARCHAR' THEN json_extract_string(e, '$') ELSE CAST(e AS VARCHAR) END) "
            f"WHEN 'OBJECT' THEN json_keys({v}) ELSE [] END")


CTE["acl_roles"] = """acl_roles AS (
  SELECT entity_id, r AS role, json_extract(acl_json, '$."' || r || '"') AS pv
  FROM acl, LATERAL (SELECT unnest(json_keys(acl_json)) AS r))"""
CTE["acl_rows"] = f"""acl_rows AS (
  SELECT DISTINCT entity_id, role, 'DAGs' AS resource, a AS action
  FROM acl_roles, LATERAL (SELECT unnest({_acts('pv')}) AS a)
  WHERE json_type(pv) <> 'OBJECT'
  UNION
  SELECT DISTINCT entity_id, role, {strip('k')} AS resource, a AS action
  FROM (SELECT entity_id, role, k, json_extract(pv, '$."' || k || '"') AS av
        FROM acl_roles, LATERAL (SELECT unnest(json_keys(pv)) AS k) WHERE json_type(pv) = 'OBJECT'),
       LATERAL (SELECT unnest({_acts('av')}) AS a)
  WHERE {strip('k')} <> '')"""

ORACLE["acl_normalize"] = with_("acl", "acl_roles", "acl_rows") + "SELECT entity_id, role, resource, action FROM acl_rows"
ORACLE["acl_rejects"] = with_("acl") + "SELECT entity_id, reason FROM acl_judged WHERE reason IS NOT NULL"

MERGED = """,
targets AS (
  SELECT c.entity_id, r.role FROM classified c JOIN scope_role r ON c.scope = r.scope
  WHERE c.status = 'valid' AND c.entity_id NOT IN (SELECT entity_id FROM acl_judged WHERE reason IS NOT NULL))
SELECT a.entity_id, a.role, a.resource, a.action FROM acl_rows a JOIN targets t ON a.entity_id = t.entity_id
WHERE a.role <> t.role AND a.role NOT IN (SELECT role FROM scope_role)
UNION ALL
SELECT t.entity_id, t.role, p.resource, p.action
FROM targets t CROSS JOIN (VALUES ('DAGs', 'can_edit'), ('DAG Runs', 'can_create')) p(resource, action)"""
ORACLE["acl_merge"] = with_("entities", "entity_tags", "tag_map", "region_roles", "acl", "acl_roles", "acl_rows",
                            extra=(classify_cte("classified", "entities", trim=True),)) + MERGED

ORACLE["permission_state"] = """
SELECT role, action, resource, CASE WHEN arg_max(op, seq) = 'grant' THEN 'grant' ELSE 'revoke' END AS last_op
FROM (SELECT event_id AS seq, CASE WHEN value > 50 THEN 'revoke' ELSE 'grant' END AS op,
             'ROLE_' || CAST(user_id AS VARCHAR) AS role, event_type AS action, 'DAGs' AS resource FROM events)
GROUP BY role, action, resource"""

ORACLE["bypass_guard"] = """
WITH gg AS (
  SELECT 'AF_TRIGGER_SCOPE_' || upper(replace(n_name, ' ', '_')) AS role,
         CASE WHEN c_custkey % 50 = 0 THEN 'can_create' ELSE 'can_read' END AS action,
         CASE WHEN c_custkey % 3 = 0 THEN 'DAG Runs' ELSE 'DAG Run:' || CAST(c_custkey AS VARCHAR) END AS resource
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
managed AS (
  SELECT 'AF_TRIGGER_SCOPE_' || upper(replace(n_name, ' ', '_')) AS role
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA'))
SELECT role, count(*) AS grants FROM gg
WHERE action = 'can_create' AND resource = 'DAG Runs' AND role IN (SELECT role FROM managed)
GROUP BY role"""

ORACLE["effective_access"] = """
WITH requests AS (
  SELECT event_id AS request_id, 'user_' || CAST(user_id AS VARCHAR) AS username,
         json_extract_string(props, '$.k') AS entity_id FROM events),
user_roles AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS username, event_type AS role
               FROM events GROUP BY user_id, event_type HAVING sum(event_id) % 5 <> 0),
ag AS (
  SELECT DISTINCT event_type AS role, CASE WHEN event_id % 40 = 0 THEN 'can_create' ELSE 'can_read' END AS action,
         'DAG Run:' || json_extract_string(props, '$.k') AS resource FROM events
  UNION SELECT 'signup', 'can_create', 'DAG Runs'),
flags AS (
  SELECT r.request_id, r.username, r.entity_id,
         EXISTS (SELECT 1 FROM user_roles u JOIN ag g ON u.role = g.role
                 WHERE u.username = r.username AND g.action = 'can_create'
                   AND g.resource = 'DAG Run:' || r.entity_id) AS s,
         EXISTS (SELECT 1 FROM user_roles u JOIN ag g ON u.role = g.role
                 WHERE u.username = r.username AND g.action = 'can_create' AND g.resource = 'DAG Runs') AS g
  FROM requests r)
SELECT request_id, username, entity_id, (s OR g) AS allowed,
       CASE WHEN s THEN 'scoped' WHEN g THEN 'global' END AS via
FROM flags"""

ORACLE["access_bitmaps"] = """
WITH user_roles AS (SELECT DISTINCT 'user_' || CAST(user_id AS VARCHAR) AS username, event_type AS role
                    FROM events GROUP BY user_id, event_type HAVING sum(event_id) % 5 <> 0),
entities AS (SELECT DISTINCT json_extract_string(props, '$.k') AS entity_id FROM events),
over_all AS (SELECT DISTINCT username FROM user_roles WHERE role = 'signup'),
scoped AS (SELECT DISTINCT event_type AS role, json_extract_string(props, '$.k') AS entity_id FROM events WHERE event_id % 40 = 0),
reach AS (SELECT s.entity_id, count(DISTINCT u.username) AS n FROM scoped s JOIN user_roles u ON u.role = s.role
          WHERE u.username NOT IN (SELECT username FROM over_all) GROUP BY s.entity_id)
SELECT e.entity_id, coalesce(n, 0) + (SELECT count(*) FROM over_all) AS n_users, coalesce(n, 0) AS n_scoped
FROM entities e LEFT JOIN reach r ON r.entity_id = e.entity_id WHERE e.entity_id IS NOT NULL"""

ORACLE["missing_roles"] = """
SELECT DISTINCT 'ROLE_' || c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS role FROM customer
EXCEPT
SELECT 'ROLE_' || c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal < 0"""

# ------------------------------------------------------------------ family D
CTE["cur_roles"] = """cur_roles AS (
  SELECT 'user_' || CAST(user_id AS VARCHAR) AS username, event_type AS role FROM events
  GROUP BY user_id, event_type HAVING sum(event_id) % 5 <> 0)"""
CTE["des_roles"] = """des_roles AS (
  SELECT 'user_' || CAST(user_id AS VARCHAR) AS username, event_type AS role FROM events
  GROUP BY user_id, event_type HAVING sum(event_id) % 7 <> 0)"""
CTE["role_changes"] = """role_changes AS (
  SELECT username, 'add' AS op, role FROM (SELECT username, role FROM des_roles EXCEPT SELECT username, role FROM cur_roles)
  UNION ALL
  SELECT username, 'remove' AS op, role FROM (
    SELECT username, role FROM cur_roles
    WHERE role IN ('click', 'view', 'purchase') AND username IN (SELECT username FROM des_roles)
    EXCEPT SELECT username, role FROM des_roles))"""

ORACLE["reconcile_roles"] = with_("cur_roles", "des_roles", "role_changes") + "SELECT username, op, role FROM role_changes"
ORACLE["aligned_users"] = with_("cur_roles", "des_roles", "role_changes") + """
SELECT DISTINCT username FROM des_roles WHERE username NOT IN (SELECT username FROM role_changes)"""

ORACLE["role_matrix"] = """
WITH matrix(profile, strict, role) AS (VALUES
  ('normal', false, 'Viewer'), ('normal', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('normal', true, 'Viewer'), ('normal', true, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_user', false, 'Viewer'), ('us_user', false, 'AF_TRIGGER_SCOPE_US'), ('us_user', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_user', true, 'Viewer'), ('us_user', true, 'AF_TRIGGER_SCOPE_US'),
  ('nonus_priv', false, 'Viewer'), ('nonus_priv', false, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('nonus_priv', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('nonus_priv', true, 'Viewer'), ('nonus_priv', true, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('us_priv', false, 'Viewer'), ('us_priv', false, 'AF_TRIGGER_SCOPE_US'), ('us_priv', false, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('us_priv', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_priv', true, 'Viewer'), ('us_priv', true, 'AF_TRIGGER_SCOPE_US'), ('us_priv', true, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('admin_observer', false, 'AF_ADMIN_OBSERVER_NO_DAG'), ('admin_observer', true, 'AF_ADMIN_OBSERVER_NO_DAG')),
prof AS (
  SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS username,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'normal' WHEN 'BUILDING' THEN 'us_user'
              WHEN 'FURNITURE' THEN 'nonus_priv' WHEN 'HOUSEHOLD' THEN 'us_priv' WHEN 'MACHINERY' THEN 'admin_observer' END
           AS profile,
         c_acctbal < 0 AS strict
  FROM customer)
SELECT p.username, m.role FROM prof p JOIN matrix m ON p.profile = m.profile AND p.strict = m.strict"""

ORACLE["users_to_create"] = """
SELECT DISTINCT 'user_' || CAST(user_id AS VARCHAR) AS username, 'Viewer' AS role FROM events
WHERE 'user_' || CAST(user_id AS VARCHAR) NOT IN (SELECT 'user_' || CAST(user_id AS VARCHAR) FROM events WHERE value < 0.5)"""

ORACLE["teardown_plan"] = """
WITH targets AS (
  SELECT 'user' AS kind, 'supp_' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier
  UNION ALL SELECT 'role', 'ROLE_' || replace(n_name, ' ', '_') FROM nation),
present AS (
  SELECT 'user' AS kind, 'supp_' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_acctbal > 0
  UNION SELECT 'role', 'ROLE_' || replace(n_name, ' ', '_') FROM nation
        WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0))
SELECT t.kind, t.name, CASE WHEN p.name IS NULL THEN 'skip' ELSE 'delete' END AS action
FROM targets t LEFT JOIN present p ON t.kind = p.kind AND t.name = p.name"""

ORACLE["teardown_rank"] = ORACLE["teardown_plan"].replace("SELECT t.kind, t.name, CASE", "SELECT t.kind, t.name, row_number() OVER (ORDER BY t.kind = 'role', t.name) AS pos, CASE")
ORACLE["group_roles"] = """
SELECT DISTINCT 'cust_' || CAST(o_custkey AS VARCHAR) AS username, m.role
FROM orders JOIN (VALUES ('1-URGENT', 'Viewer'), ('2-HIGH', 'Viewer'), ('3-MEDIUM', 'AF_RERUN_ALL_NO_TRIGGER')) m(grp, role)
  ON o_orderpriority = m.grp"""

# The listing and role-list texts are rendered from events and parsed back: the parse
# must give back exactly the source pairs.
ORACLE["user_listing"] = """
SELECT DISTINCT 'user_' || CAST(user_id AS VARCHAR) AS username, event_type AS role FROM events"""
ORACLE["role_list_parse"] = ORACLE["user_listing"]

# ------------------------------------------------------------------ family E
LINE_RE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (?:\[(INFO|WARN|ERROR|DEBUG|DRYRUN)\] )?(.*)$"

ORACLE["log_parse"] = f"""
WITH lines AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [ERROR] ' || event_type || ' user=' || CAST(user_id AS VARCHAR)
              WHEN event_type = 'view' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type || ' user=' || CAST(user_id AS VARCHAR)
              WHEN event_type = 'click' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [INFO] [k=' || json_extract_string(props, '$.k') || '] ' || event_type || ' user=' || CAST(user_id AS VARCHAR)
              WHEN event_type = 'purchase' AND value > 400 THEN '  at job.step(' || CAST(event_id AS VARCHAR) || ')'
              ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [INFO] ' || event_type || ' user=' || CAST(user_id AS VARCHAR) END AS value
  FROM events)
SELECT event_id,
       CASE WHEN regexp_matches(value, '{LINE_RE}')
            THEN strftime(try_strptime(regexp_extract(value, '{LINE_RE}', 1), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS ts,
       CASE WHEN regexp_matches(value, '{LINE_RE}') AND regexp_extract(value, '{LINE_RE}', 2) <> ''
            THEN regexp_extract(value, '{LINE_RE}', 2) END AS level,
       CASE WHEN regexp_matches(value, '{LINE_RE}') THEN regexp_extract(value, '{LINE_RE}', 3) ELSE value END AS message
FROM lines"""

ORACLE["tail_30"] = """
SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 30"""

ORACLE["retention"] = """
SELECT o_orderkey, age_days, age_days > 90 AS expired FROM (
  SELECT o_orderkey, CAST(floor(date_diff('second', o_orderdate, TIMESTAMP '1999-01-01 00:00:00') / 86400) AS BIGINT) AS age_days
  FROM orders)"""

ORACLE["run_outcome"] = """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS rc
FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')"""

ORACLE["auth_failures"] = """
SELECT page_id,
       coalesce((contains(lower(text), 'sasl negotiation failure') OR contains(lower(text), 'gss initiate failed'))
                AND NOT contains(lower(url), 'principal='), false) AS auth_failure
FROM (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' SASL Negotiation failure' WHEN 1 THEN ' gss INITIATE failed'
                              ELSE ' done' END AS text,
             url || CASE WHEN page_id % 3 = 0 THEN ';Principal=hive/x' ELSE '' END AS url FROM pages)"""

ORACLE["status_rollup"] = """
WITH obs AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS service,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS source,
         event_id AS ord, event_id AS pid, event_id % 3 <> 0 AS live, event_type FROM events),
agg AS (
  SELECT service,
         arg_min(pid, ord) FILTER (WHERE live AND source = 1) AS p1,
         arg_min(pid, ord) FILTER (WHERE live AND source = 2) AS p2,
         arg_min(pid, ord) FILTER (WHERE source = 3) AS p3,
         arg_min(live, ord) FILTER (WHERE source = 3) AS l3
  FROM obs GROUP BY service),
services AS (SELECT service, bool_or(event_type IN ('purchase', 'view')) AS managed FROM obs GROUP BY service),
picked AS (SELECT service, coalesce(p1, p2, CASE WHEN l3 THEN p3 END) AS pid FROM agg)
SELECT s.service, 'dev' AS env,
       CASE WHEN NOT s.managed THEN 'disabled' WHEN p.pid IS NULL THEN 'stopped' ELSE 'running' END AS status,
       CASE WHEN s.managed AND p.pid IS NOT NULL THEN CAST(p.pid AS VARCHAR) ELSE '-' END AS pid
FROM services s LEFT JOIN picked p ON s.service = p.service"""

# ------------------------------------------------------------------ family A
ORACLE["reload_twice"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
ORACLE["ordered_read"] = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey"
ORACLE["ordered_rank"] = "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS pos FROM orders"
ORACLE["preview_20"] = "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20"
ORACLE["literal_weights"] = """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 END AS weight
FROM orders"""
ORACLE["first_usable"] = """
SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN nullif(lang, '') END,
                        CASE WHEN doc_id % 5 <> 0 THEN nullif(source, '') END, 'none') AS value
FROM documents"""
ORACLE["table_count"] = "SELECT count(*) AS cnt FROM customer"
ORACLE["table_smoke"] = """
SELECT * FROM (VALUES ('create', true, CAST(NULL AS BIGINT))) t(step, ok, rows)
UNION ALL SELECT 'insert', true, count(*) FROM supplier
UNION ALL SELECT 'count', true, count(*) FROM supplier
UNION ALL SELECT 'query', true, count(*) FROM supplier"""

# after a sync the written state is what was desired, and a second diff is empty
ORACLE["grant_sync"] = with_(*_desired_ctes(), extra=DESIRED_EXTRA) + "SELECT scope, entity_id, 'state' AS what FROM desired"
_services = """'svc-' || CAST(user_id % 20 AS VARCHAR) AS script, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'prod' END AS env,
         strftime(ts, '%Y-%m-%d') AS log_date"""
_parsed = ORACLE["log_parse"].replace("  SELECT event_id,\n", f"  SELECT event_id, ts AS seen, {_services},\n")
ORACLE["log_files"] = _parsed.replace("SELECT event_id,\n       CASE WHEN regexp", "SELECT script, env, log_date, CASE WHEN regexp")
_file_lines = _parsed[:_parsed.index("\nSELECT event_id")] + """,
named AS (SELECT *, script || '-' || env || '-' || log_date || '.log' AS name FROM lines)
"""
ORACLE["tail_files"] = _file_lines + """
SELECT name, script, env, log_date, CAST(rn AS INTEGER) AS rn, value FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY date_trunc('second', seen) DESC, event_id DESC) AS rn FROM named)
WHERE rn <= 30"""
ORACLE["retention_files"] = _file_lines + """
SELECT name, script, env, bytes, age_days, age_days > 90 AS expired FROM (
  SELECT name, script, env, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes,
         CAST(floor(date_diff('second', date_trunc('second', max(seen)), TIMESTAMP '2024-04-15 12:00:00') / 86400) AS BIGINT) AS age_days
  FROM named GROUP BY ALL)"""
# of a user's two lines the first counts
ORACLE["listing_files"] = """
SELECT DISTINCT 'user_' || CAST(user_id AS VARCHAR) AS username,
       CASE WHEN user_id % 3 = 0 AND 2 * ((31 * user_id) % 61) + 1 < 2 * user_id THEN 'LATE_' || CAST(user_id % 4 AS VARCHAR)
            ELSE event_type END AS role FROM events"""

ORACLE["role_names"] = with_("scope_texts") + f"""
SELECT scope, 'AF_TRIGGER_SCOPE_' || upper(scope) AS role FROM (
  SELECT DISTINCT lower({strip('x')}) AS scope
  FROM scope_texts, LATERAL (SELECT unnest(string_split(text, ',')) AS x)
  WHERE lower({strip('x')}) <> ''
  UNION SELECT 'global')"""

ORACLE["user_plan"] = """
WITH matrix(profile, strict, role) AS (VALUES
  ('normal', false, 'Viewer'), ('normal', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('normal', true, 'Viewer'), ('normal', true, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_user', false, 'Viewer'), ('us_user', false, 'AF_TRIGGER_SCOPE_US'), ('us_user', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_user', true, 'Viewer'), ('us_user', true, 'AF_TRIGGER_SCOPE_US'),
  ('nonus_priv', false, 'Viewer'), ('nonus_priv', false, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('nonus_priv', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('nonus_priv', true, 'Viewer'), ('nonus_priv', true, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('us_priv', false, 'Viewer'), ('us_priv', false, 'AF_TRIGGER_SCOPE_US'), ('us_priv', false, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('us_priv', false, 'AF_RERUN_ALL_NO_TRIGGER'),
  ('us_priv', true, 'Viewer'), ('us_priv', true, 'AF_TRIGGER_SCOPE_US'), ('us_priv', true, 'AF_TRIGGER_SCOPE_GLOBAL'),
  ('admin_observer', false, 'AF_ADMIN_OBSERVER_NO_DAG'), ('admin_observer', true, 'AF_ADMIN_OBSERVER_NO_DAG')),
desired AS (
  SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS username, m.role
  FROM customer JOIN matrix m
    ON m.profile = CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'normal' WHEN 'BUILDING' THEN 'us_user'
                    WHEN 'FURNITURE' THEN 'nonus_priv' WHEN 'HOUSEHOLD' THEN 'us_priv'
                    WHEN 'MACHINERY' THEN 'admin_observer' END
   AND m.strict = (c_acctbal < 0)),
present AS (SELECT 'cust_' || CAST(c_custkey AS VARCHAR) AS username FROM customer WHERE c_acctbal > 0),
cur AS (
  SELECT DISTINCT 'cust_' || CAST(o_custkey AS VARCHAR) AS username, g.role
  FROM orders JOIN (VALUES ('1-URGENT', 'Viewer'), ('2-HIGH', 'Viewer'), ('3-MEDIUM', 'AF_RERUN_ALL_NO_TRIGGER')) g(grp, role)
    ON o_orderpriority = g.grp
  WHERE 'cust_' || CAST(o_custkey AS VARCHAR) IN (SELECT username FROM present)),
created AS (SELECT DISTINCT username, 'Viewer' AS role FROM desired WHERE username NOT IN (SELECT username FROM present)),
cur2 AS (SELECT username, role FROM cur UNION SELECT username, role FROM created)
SELECT username, 'create' AS op, role FROM created
UNION ALL
SELECT username, 'add', role FROM (SELECT username, role FROM desired EXCEPT SELECT username, role FROM cur2)
UNION ALL
SELECT username, 'remove', role FROM (
  SELECT username, role FROM cur2
  WHERE role IN ('Viewer', 'AF_RERUN_ALL_NO_TRIGGER', 'AF_ADMIN_OBSERVER_NO_DAG', 'AF_TRIGGER_SCOPE_GLOBAL',
                 'AF_TRIGGER_SCOPE_NONUS', 'AF_TRIGGER_SCOPE_US', 'AF_TRIGGER_SCOPE_MX', 'AF_TRIGGER_SCOPE_CN')
    AND username IN (SELECT username FROM desired)
  EXCEPT SELECT username, role FROM desired)"""

ORACLE["policy_acl"] = with_("entities", "entity_tags", "tag_map", "region_roles", "inside", "acl", "acl_roles",
                             "acl_rows", extra=(classify_cte("classified", "inside", trim=True),)) + MERGED

_desired_sql = ORACLE["role_matrix"].replace("SELECT p.username, m.role FROM", ", want AS (SELECT p.username, m.role FROM") + ")"
ORACLE["user_plan_dry"] = _desired_sql + """
SELECT DISTINCT username, 'create' AS op, 'Viewer' AS role FROM want
UNION ALL SELECT DISTINCT username, 'add', role FROM want"""
