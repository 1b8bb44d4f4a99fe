"""The registered queries once more, as SQL for the correctness check."""

from factgraph.sources.generated import JAVA_PATH, JAVA_TEXT, PYTHON_PATH, PYTHON_TEXT

_CUST = """
cust AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, 'f/n' || c_nationkey AS file_uid,
         'f/n' || c_nationkey || ':c' || c_custkey AS class_uid FROM customer),
ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_name, file_uid, class_uid,
        class_uid || '.o' || o_orderkey AS order_uid FROM orders JOIN cust ON o_custkey = c_custkey),
line AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, order_uid, file_uid
         FROM lineitem JOIN ord ON l_orderkey = o_orderkey)"""


def _node(uid, name, qualified, node_type, filepath, src, start="1", end="1", doc="NULL", sig="NULL",
          fhash="NULL", where=""):
    return (f"SELECT {uid} AS uid, {name} AS name, {qualified} AS qualified_name, '{node_type}' AS node_type, "
            f"{filepath} AS filepath, CAST({start} AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line, "
            f"CAST({doc} AS VARCHAR) AS docstring, CAST({sig} AS VARCHAR) AS signature, "
            f"CAST({fhash} AS VARCHAR) AS file_hash FROM {src} {where}")


_NODES = "nodes AS (" + " UNION ALL ".join([
    _node("'f/n' || n_nationkey", "n_name", "n_name", "File", "'f/n' || n_nationkey", "nation", "1", "100",
          fhash="sha256(n_name)"),
    _node("class_uid", "c_name", "'c' || c_custkey", "Class", "file_uid", "cust", "c_custkey + 1",
          "c_custkey + 1", doc="c_mktsegment"),
    _node("'f/n' || s_nationkey || ':s' || s_suppkey", "s_name", "'s' || s_suppkey", "Constructor",
          "'f/n' || s_nationkey", "supplier", sig="s_name || '()'"),
    _node("'lib/p' || p_partkey", "p_name", "p_name", "Function", "'lib'", "part", "p_size", "p_size",
          doc="p_brand || ' ' || p_type", sig="p_name || '(int size)'"),
    _node("order_uid", "'order_' || o_orderkey", "'c' || o_custkey || '.o' || o_orderkey", "Function", "file_uid",
          "ord", doc="o_orderpriority", sig="'order(' || o_orderstatus || ')'"),
    _node("'lib/r' || r_regionkey", "r_name", "r_name", "Interface", "'lib'", "region"),
    _node("order_uid || ':branch@L' || l_linenumber", "'if_statement@L' || l_linenumber",
          "split_part(order_uid, ':', 2) || ':branch@L' || l_linenumber", "ConditionalBranch", "file_uid", "line",
          "l_linenumber", "l_linenumber", doc="'Condition: (qty > ' || CAST(l_quantity AS INTEGER) || ')'",
          where="WHERE l_returnflag = 'R'"),
    _node("order_uid || ':return@L1'", "'return'", "split_part(order_uid, ':', 2) || ':return@L1'",
          "ReturnStatement", "file_uid", "ord", where="WHERE o_orderstatus = 'F'"),
]) + ")"


def _edge(source, target, edge_type, filepath, src, line="NULL", where=""):
    return (f"SELECT {source} AS source_uid, {target} AS target_uid, '{edge_type}' AS edge_type, "
            f"{filepath} AS filepath, CAST({line} AS INTEGER) AS line, {target} AS raw_target FROM {src} {where}")


_EDGES = "edges AS (" + " UNION ALL ".join([
    _edge("file_uid", "class_uid", "contains", "file_uid", "cust"),
    _edge("'f/n' || s_nationkey", "'f/n' || s_nationkey || ':s' || s_suppkey", "contains",
          "'f/n' || s_nationkey", "supplier"),
    _edge("class_uid", "order_uid", "contains", "file_uid", "ord"),
    _edge("order_uid", "'unresolved:supply.' || s_name", "calls", "file_uid",
          "line JOIN supplier ON l_suppkey = s_suppkey", "l_linenumber"),
    _edge("order_uid", "'unresolved:catalog.' || p_name", "calls", "file_uid",
          "line JOIN part ON l_partkey = p_partkey", "l_linenumber"),
    _edge("order_uid", "'unresolved:' || c_name || '.<init>'", "calls", "file_uid", "ord", "0",
          "WHERE o_orderpriority = '1-URGENT'"),
    _edge("class_uid", "'unresolved:' || c_mktsegment", "extends", "file_uid", "cust", "1"),
    _edge("class_uid", "'lib/r' || n_regionkey", "implements", "file_uid",
          "cust JOIN nation ON c_nationkey = n_nationkey", "1"),
    _edge("'f/n' || n_nationkey", "'import:' || r_name", "imports", "'f/n' || n_nationkey",
          "nation JOIN region ON n_regionkey = r_regionkey", "1"),
    _edge("order_uid", "order_uid || ':branch@L' || l_linenumber", "has_branch", "file_uid", "line",
          "l_linenumber", "WHERE l_returnflag = 'R'"),
    _edge("order_uid", "order_uid || ':return@L1'", "returns", "file_uid", "ord", "1",
          "WHERE o_orderstatus = 'F'"),
]) + ")"

# resolved(…): edges after name resolution; store_*: the merged graph
_RESOLVED = """
idx AS (SELECT name, count(*) AS n, min(uid) AS uid FROM nodes
        WHERE node_type IN ('Function', 'Constructor') GROUP BY name),
named AS (SELECT *, CASE WHEN raw_target LIKE 'unresolved:%' THEN
            CASE WHEN raw_target LIKE '%.<init>' THEN split_part(substr(raw_target, 12), '.', -2)
                 ELSE split_part(substr(raw_target, 12), '.', -1) END END AS lookup FROM edges),
resolved AS (SELECT source_uid, CASE WHEN n = 1 THEN uid ELSE raw_target END AS target_uid, edge_type, filepath,
             line, raw_target FROM named LEFT JOIN idx ON lookup = name)"""

_STORE = """
unode AS (SELECT DISTINCT ON (node_type, uid) * FROM nodes
          ORDER BY node_type, uid, start_line DESC, name DESC, qualified_name DESC, filepath DESC, end_line DESC,
                   docstring DESC NULLS LAST),
uedge AS (SELECT source_uid, target_uid, edge_type, any_value(filepath) AS filepath, max(line) AS line
          FROM resolved GROUP BY ALL),
ends AS (SELECT uid, max(t) AS t FROM (SELECT source_uid AS uid, 0 AS t FROM uedge UNION ALL
         SELECT target_uid, 1 FROM uedge) GROUP BY uid),
holders AS (SELECT uid, CASE WHEN t = 1 THEN 'Unresolved' ELSE 'Unlabelled' END AS node_type FROM ends
            WHERE uid NOT IN (SELECT uid FROM nodes)),
allnode AS (SELECT uid, name, qualified_name, node_type, filepath, start_line, end_line, docstring, signature,
            file_hash FROM unode UNION ALL
            SELECT uid, NULL, NULL, node_type, NULL, NULL, NULL, NULL, NULL, NULL FROM holders)"""


def _with(*parts):
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


GRAPH = _with(_CUST, _NODES, _EDGES)
RESOLVED = _with(_CUST, _NODES, _EDGES, _RESOLVED)
STORE = _with(_CUST, _NODES, _EDGES, _RESOLVED, _STORE)


def _context(condition):
    return f""", center AS (SELECT uid, name AS symbol, node_type AS type, filepath, signature
            FROM allnode WHERE {condition} AND node_type <> 'Unresolved'),
        link AS (SELECT target_uid AS k, source_uid AS o, 'caller' AS role FROM uedge WHERE edge_type = 'calls'
            UNION ALL SELECT source_uid, target_uid, 'callee' FROM uedge WHERE edge_type = 'calls'
            UNION ALL SELECT source_uid, target_uid, 'branch' FROM uedge WHERE edge_type = 'has_branch')
        SELECT DISTINCT symbol, type, center.filepath, center.signature, role, o.name FROM link
            JOIN center ON k = center.uid JOIN allnode o ON link.o = o.uid WHERE o.name <> ''
        UNION SELECT symbol, type, filepath, signature, 'center', symbol FROM center"""


CORE = {
    "resolve_calls": RESOLVED + "SELECT * FROM resolved",
    "node_summary": GRAPH + "SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type",
    "edge_summary": GRAPH + "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type",
    "graph_stats": GRAPH + """SELECT count(*) FILTER (node_type = 'File') AS files,
        count(*) FILTER (node_type = 'Class') AS classes, count(*) FILTER (node_type = 'Function') AS methods,
        count(*) FILTER (node_type = 'Constructor') AS constructors,
        count(*) FILTER (node_type = 'ConditionalBranch') AS branches FROM nodes""",
    "unresolved_count": RESOLVED + """SELECT count(*) FILTER (target_uid LIKE 'unresolved:%') AS unresolved,
        count(*) AS total FROM resolved""",
    "first_classes": GRAPH + """SELECT qualified_name, filepath || ':' || start_line AS location FROM nodes
        WHERE node_type = 'Class' ORDER BY filepath, start_line, uid LIMIT 10""",
    "name_index": RESOLVED + "SELECT * FROM idx",
    "resolution_report": RESOLVED + """SELECT count(*) FILTER (lookup IS NOT NULL AND n = 1) AS resolved,
        count(*) FILTER (lookup IS NOT NULL AND n > 1) AS ambiguous,
        count(*) FILTER (lookup IS NOT NULL AND n IS NULL) AS missing,
        count(*) AS total FROM named LEFT JOIN idx ON lookup = name""",
    "find_symbol": STORE + """SELECT uid, name, node_type, filepath FROM allnode
        WHERE name IS NOT NULL AND node_type <> 'Unresolved'""",
    "present": GRAPH + """SELECT uid, node_type AS type, name, filepath, coalesce(signature, 'N/A') AS signature,
        CASE WHEN length(docstring) > 100 THEN docstring[1:100] || '...' ELSE docstring END AS docstring FROM nodes""",
    "callers": STORE + """SELECT t.name AS symbol, c.node_type AS type, c.name, c.filepath
        FROM uedge e JOIN allnode t ON e.target_uid = t.uid JOIN allnode c ON e.source_uid = c.uid
        WHERE e.edge_type = 'calls' AND t.name IS NOT NULL""",
    "callers_of_symbol": STORE + """SELECT t.name AS symbol, c.node_type AS type, c.name, c.filepath
        FROM uedge e JOIN allnode t ON e.target_uid = t.uid JOIN allnode c ON e.source_uid = c.uid
        WHERE e.edge_type = 'calls' AND t.name = 'Supplier#000000001'""",
    "callees": STORE + """SELECT s.name AS symbol, c.node_type AS type, c.name
        FROM uedge e JOIN allnode s ON e.source_uid = s.uid JOIN allnode c ON e.target_uid = c.uid
        WHERE e.edge_type = 'calls' AND s.name IS NOT NULL AND s.node_type <> 'Unresolved'""",
    "code_context": STORE + """, center AS (SELECT uid, name AS symbol, node_type AS type, filepath, signature
            FROM allnode WHERE name IS NOT NULL AND node_type <> 'Unresolved'),
        link AS (SELECT target_uid AS k, source_uid AS o, 'caller' AS role FROM uedge WHERE edge_type = 'calls'
            UNION ALL SELECT source_uid, target_uid, 'callee' FROM uedge WHERE edge_type = 'calls'
            UNION ALL SELECT source_uid, target_uid, 'branch' FROM uedge WHERE edge_type = 'has_branch')
        SELECT DISTINCT symbol, type, center.filepath, center.signature, role, o.name FROM link
            JOIN center ON k = center.uid JOIN allnode o ON link.o = o.uid WHERE o.name <> ''
        UNION SELECT symbol, type, filepath, signature, 'center', symbol FROM center""",
    "induced_subgraph": RESOLVED + """, keep AS (SELECT uid FROM nodes WHERE node_type IN ('Class', 'Function'))
        SELECT * FROM resolved WHERE source_uid IN (FROM keep) AND target_uid IN (FROM keep)""",
    "node_scan": GRAPH + """SELECT uid, name, signature FROM nodes
        WHERE node_type IN ('Class', 'Function', 'Interface')""",
    "domain_projection": RESOLVED + """, keep AS (SELECT uid FROM nodes
            WHERE node_type IN ('Class', 'Function', 'Interface'))
        SELECT source_uid, target_uid FROM resolved WHERE edge_type IN ('calls', 'contains', 'implements', 'extends')
            AND source_uid IN (FROM keep) AND target_uid IN (FROM keep)""",
    "undirected": RESOLVED + """, keep AS (SELECT uid FROM nodes
            WHERE node_type IN ('Class', 'Function', 'Interface'))
        SELECT DISTINCT least(source_uid, target_uid) AS u, greatest(source_uid, target_uid) AS v FROM resolved
        WHERE edge_type IN ('calls', 'contains', 'implements', 'extends')
            AND source_uid IN (FROM keep) AND target_uid IN (FROM keep)""",
    "placeholders": STORE + "SELECT uid, node_type FROM holders",
    "orphans": STORE + """SELECT uid FROM allnode WHERE node_type = 'Unresolved' AND uid NOT IN (
        SELECT source_uid FROM uedge WHERE edge_type <> 'extends' UNION
        SELECT target_uid FROM uedge WHERE edge_type <> 'extends')""",
    "upsert_nodes": STORE + "SELECT * FROM unode",
    "upsert_versions": STORE + """SELECT * REPLACE (
        CAST(CASE WHEN signature = 'order(F)' THEN end_line + 9 ELSE end_line END AS INTEGER) AS end_line,
        CASE WHEN signature IS DISTINCT FROM 'order(F)' THEN docstring END AS docstring) FROM unode""",
    "upsert_edges": STORE + "SELECT source_uid, target_uid, edge_type, filepath, line FROM uedge",
    "ingest": STORE + "SELECT node_type, count(*) AS n FROM allnode GROUP BY node_type",
    "unique_check": GRAPH + "SELECT node_type, uid, count(*) AS n FROM nodes GROUP BY node_type, uid HAVING count(*) > 1",
    "duplicate_uids": GRAPH + "SELECT uid, count(*) AS n FROM nodes GROUP BY uid HAVING count(*) > 1",
    "contains_tree_check": GRAPH + """SELECT uid, coalesce(p, 0) AS parents FROM (SELECT DISTINCT uid FROM nodes
            WHERE node_type IN ('Class', 'Function', 'Constructor', 'Interface'))
        LEFT JOIN (SELECT target_uid, count(*) AS p FROM edges WHERE edge_type = 'contains' GROUP BY 1)
            ON uid = target_uid WHERE coalesce(p, 0) <> 1""",
    "purge_files": RESOLVED + """SELECT * FROM resolved WHERE filepath IS NULL OR filepath NOT IN
        (SELECT 'f/n' || n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "detach_delete": RESOLVED + """, gone AS (SELECT uid FROM nodes WHERE filepath IN
            (SELECT 'f/n' || n_nationkey FROM nation WHERE n_regionkey = 1))
        SELECT * FROM resolved WHERE source_uid NOT IN (FROM gone) AND target_uid NOT IN (FROM gone)""",
    "khop": RESOLVED + """, step AS (SELECT source_uid AS a, target_uid AS b FROM resolved WHERE edge_type <> 'imports'
            UNION SELECT target_uid, source_uid FROM resolved WHERE edge_type <> 'imports'),
        h0 AS (SELECT uid FROM nodes WHERE name = 'Supplier#000000001'),
        h1 AS (SELECT DISTINCT b AS uid FROM step WHERE a IN (FROM h0)),
        h2 AS (SELECT DISTINCT b AS uid FROM step WHERE a IN (FROM h1))
        SELECT uid, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT uid, 0 AS hop FROM h0
            UNION ALL SELECT uid, 1 FROM h1 UNION ALL SELECT uid, 2 FROM h2) GROUP BY uid""",
    "callees_of_symbol": STORE + """SELECT s.name AS symbol, c.node_type AS type, c.name
        FROM (SELECT * FROM allnode WHERE name = 'order_1' AND node_type <> 'Unresolved') s
        JOIN uedge e ON e.source_uid = s.uid JOIN allnode c ON e.target_uid = c.uid WHERE e.edge_type = 'calls'""",
    "context_of_symbol": STORE + _context("name = 'Supplier#000000001'"),
    "context_first": STORE + _context("uid = (SELECT uid FROM allnode WHERE name = 'return' ORDER BY filepath, uid LIMIT 1)"),
    "resolve_init": """SELECT 'line' || l_orderkey || '_' || l_linenumber AS source_uid,
        'f/n' || s_nationkey || ':s' || s_suppkey AS target_uid, l_linenumber AS line
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "graph_round_trip": STORE + "SELECT source_uid, target_uid, edge_type, filepath, line FROM uedge",
    "node_properties": """SELECT '{"uid":"f/n' || c_nationkey || ':c' || c_custkey || '","name":"' || c_name
        || '","qualified_name":"c' || c_custkey || '","node_type":"Class","filepath":"f/n' || c_nationkey
        || '","start_line":' || (c_custkey + 1) || ',"end_line":' || (c_custkey + 1) || ',"docstring":"' || c_mktsegment
        || '"}' AS properties FROM customer""",
}




# -- files and extraction ---------------------------------------------------

_DOCFILES = """docfile AS (SELECT *, regexp_extract(filepath, '[^/]+$') AS name, lower(regexp_extract(filepath, '\\.[^.]+$')) AS ext
    FROM (SELECT (CASE source WHEN 'src1' THEN 'build' WHEN 'src2' THEN '.git' ELSE source END) || '/' || lang || '/'
        || doc_id || (CASE lang WHEN 'en' THEN '.java' WHEN 'fr' THEN '.PY' WHEN 'de' THEN '.py' ELSE '.txt' END)
        AS filepath, text FROM documents))"""
DOCFILES = _with(_DOCFILES)
_LINES = "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER)"


def _generated_node(uid, name, qualified, node_type, start, end, doc="NULL", sig="NULL", hashed=True, where="true"):
    return (f"SELECT {uid} AS uid, {name} AS name, {qualified} AS qualified_name, '{node_type}' AS node_type, "
            f"path AS filepath, {start} AS start_line, {end} AS end_line, CAST({doc} AS VARCHAR) AS docstring, "
            f"CAST({sig} AS VARCHAR) AS signature, {'hash' if hashed else 'CAST(NULL AS VARCHAR)'} AS file_hash "
            f"FROM src WHERE {where}")


def _generated_edge(source, target, edge_type, line="NULL", where="true"):
    return (f"SELECT {source} AS source_uid, {target} AS target_uid, '{edge_type}' AS edge_type, path AS filepath, "
            f"CAST({line} AS INTEGER) AS line, {target} AS raw_target FROM src WHERE {where}")


def _call(source, text, line, where="true"):
    return _generated_edge(source, f"'unresolved:' || {text}", "calls", line, where)


_C = "path || ':' || pkg || '.O' || o_orderkey"
_CTOR, _M = f"{_C} || '.O' || o_orderkey", f"{_C} || '.price' || o_orderkey"
_Q = "pkg || '.O' || o_orderkey"
_JAVA_NODES = "nodes AS (" + " UNION ALL ".join([
    _generated_node("path", "file", "file", "File", 1, 28),
    _generated_node(_C, "'O' || o_orderkey", _Q, "Class", 10, 27,
                    doc="'Order ' || o_orderkey || chr(10) || 'of customer ' || o_custkey || '.'"),
    _generated_node(_CTOR, "'O' || o_orderkey", f"{_Q} || '.O' || o_orderkey", "Constructor", 13, 16,
                    sig="'public O' || o_orderkey || '(long total)'"),
    _generated_node(_M, "'price' || o_orderkey", f"{_Q} || '.price' || o_orderkey", "Function", 18, 26,
                    sig="'@Override' || chr(10) || '    public long price' || o_orderkey || '(int qty, String... notes)'"),
    _generated_node(f"{_M} || ':branch@L21'", "'if_statement@L21'",
                    f"{_Q} || '.price' || o_orderkey || ':branch@L21'", "ConditionalBranch", 21, 24,
                    doc="'Condition: (qty > 0)'", hashed=False),
    _generated_node(f"{_M} || ':return@L25'", "'return'", f"{_Q} || '.price' || o_orderkey || ':return@L25'",
                    "ReturnStatement", 25, 25, hashed=False),
    _generated_node(f"{_M} || ':return@L23'", "'return'", f"{_Q} || '.price' || o_orderkey || ':return@L23'",
                    "ReturnStatement", 23, 23, hashed=False, where="o_orderstatus = 'F'"),
]) + ")"
_JAVA_EDGES = "edges AS (" + " UNION ALL ".join([
    _generated_edge("path", "'import:java.util.List'", "imports", 3),
    _generated_edge("path", "'import:shop.Prices'", "imports", 4),
    _generated_edge("path", _C, "contains"),
    _generated_edge(_C, "'unresolved:Base' || o_custkey", "extends", 10),
    _generated_edge(_C, "'unresolved:Priced'", "implements", 10),
    _generated_edge(_C, _CTOR, "contains"),
    _generated_edge(_C, _M, "contains"),
    _call(_CTOR, "'check'", 14),
    _generated_edge(_M, f"{_M} || ':branch@L21'", "has_branch", 21),
    _call(_M, "'log'", 22),
    _generated_edge(_M, f"{_M} || ':return@L23'", "returns", 23, "o_orderstatus = 'F'"),
    _call(_M, "'audit.check'", 23, "o_orderstatus <> 'F'"),
    _call(_M, "'Entry.<init>'", 23, "o_orderstatus <> 'F'"),
    _generated_edge(_M, f"{_M} || ':return@L25'", "returns", 25),
    _call(_M, "scaler", 25),
    _call(_M, "'price' || o_orderkey", 25),
]) + ")"


def _java_src(where="true", scaler="'helper.scale'", text=JAVA_TEXT):
    return (f"src AS (SELECT *, {scaler} AS scaler, 'shop.c' || o_custkey AS pkg, {JAVA_PATH} AS path, "
            f"'O' || o_orderkey || '.java' AS file, sha256({text}) AS hash FROM orders WHERE {where})")


JAVA = _with(_java_src(), _JAVA_NODES, _JAVA_EDGES)
_AFTER_TEXT = f"(CASE WHEN o_orderstatus = 'F' THEN replace({JAVA_TEXT}, 'helper.scale', 'helper.round') ELSE {JAVA_TEXT} END)"
JAVA_AFTER = _with(
    _java_src("o_orderstatus <> 'P'", "CASE WHEN o_orderstatus = 'F' THEN 'helper.round' ELSE 'helper.scale' END",
              _AFTER_TEXT), _JAVA_NODES, _JAVA_EDGES, _RESOLVED)

_PC = "path || ':' || path || ':Line'"
_PI, _PT, _PM = f"{_PC} || '.__init__'", f"{_PC} || '.total'", "path || ':' || path || '.main'"
_PYTHON_NODES = "nodes AS (" + " UNION ALL ".join([
    _generated_node("path", "file", "file", "File", 1, 21),
    _generated_node(_PC, "'Line'", "path || ':Line'", "Class", 5, 17, doc="'Part ' || l_partkey || '.'"),
    _generated_node(_PI, "'__init__'", "path || ':Line.__init__'", "Constructor", 8, 9,
                    sig="'def __init__(self, qty=' || CAST(l_quantity AS INT) || ')'"),
    _generated_node(_PT, "'total'", "path || ':Line.total'", "Function", 12, 17, sig="'def total(self)'"),
    _generated_node(_PM, "'main'", "path || '.main'", "Function", 19, 20, sig="'def main()'"),
    _generated_node(f"{_PT} || ':branch@L13'", "'if_statement@L13'", "path || ':Line.total:branch@L13'",
                    "ConditionalBranch", 13, 14, hashed=False),
    _generated_node(f"{_PT} || ':branch@L15'", "'for_statement@L15'", "path || ':Line.total:branch@L15'",
                    "ConditionalBranch", 15, 16, hashed=False),
    _generated_node(f"{_PT} || ':return@L14'", "'return'", "path || ':Line.total:return@L14'",
                    "ReturnStatement", 14, 14, hashed=False),
    _generated_node(f"{_PT} || ':return@L17'", "'return'", "path || ':Line.total:return@L17'",
                    "ReturnStatement", 17, 17, hashed=False, where="l_returnflag = 'R'"),
]) + ")"
_PYTHON_EDGES = "edges AS (" + " UNION ALL ".join([
    _generated_edge("path", "'import:os'", "imports", 2),
    _generated_edge("path", "'import:math'", "imports", 2),
    _generated_edge("path", "'import:.'", "imports", 3),
    _generated_edge("path", _PC, "contains"),
    _generated_edge("path", _PM, "contains"),
    _generated_edge(_PC, _PI, "contains"),
    _generated_edge(_PC, _PT, "contains"),
    _generated_edge(_PC, "'unresolved:base.Row'", "extends", 5),
    _generated_edge(_PT, f"{_PT} || ':branch@L13'", "has_branch", 13),
    _generated_edge(_PT, f"{_PT} || ':branch@L15'", "has_branch", 15),
    _generated_edge(_PT, f"{_PT} || ':return@L14'", "returns", 14),
    _generated_edge(_PT, f"{_PT} || ':return@L17'", "returns", 17, "l_returnflag = 'R'"),
    _call(_PT, "'price'", 14), _call(_PT, "'load'", 14), _call(_PT, "'self.rows'", 15), _call(_PT, "'keep'", 16),
    _call(_PT, "'refund'", 17, "l_returnflag = 'R'"), _call(_PT, "'self.close'", 17, "l_returnflag <> 'R'"),
    _call(_PM, "'Line().total'", 20),
]) + ")"
PYTHON = _with(
    f"src AS (SELECT *, {PYTHON_PATH} AS path, 'l' || l_orderkey || '_' || l_linenumber || '.py' AS file, "
    f"sha256({PYTHON_TEXT}) AS hash FROM lineitem)", _PYTHON_NODES, _PYTHON_EDGES)

FILES = {
    "file_scan_prune": DOCFILES + """SELECT filepath, name, ext FROM docfile
        WHERE NOT starts_with(filepath, 'build/') AND NOT starts_with(filepath, '.git/')""",
    "language_route": DOCFILES + """SELECT CASE ext WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' ELSE 'skipped' END
        AS language, count(*) AS n FROM docfile GROUP BY 1""",
    "content_hash": DOCFILES + "SELECT filepath, sha256(text) AS file_hash FROM docfile",
    "line_count": DOCFILES + f"SELECT filepath, {_LINES} AS n_lines FROM docfile",
    "file_nodes": DOCFILES + f"""SELECT filepath AS uid, name, name AS qualified_name, 'File' AS node_type, filepath,
        1 AS start_line, {_LINES} AS end_line, NULL AS docstring, NULL AS signature, sha256(text) AS file_hash
        FROM docfile""",
    "extract_java": JAVA + "SELECT * FROM nodes",
    "extract_java_edges": JAVA + "SELECT * EXCLUDE (raw_target) FROM edges",
    "extract_python": PYTHON + "SELECT * FROM nodes",
    "extract_python_edges": PYTHON + "SELECT * EXCLUDE (raw_target) FROM edges",
    "run_report": _with(_DOCFILES, _java_src(), _JAVA_NODES, _JAVA_EDGES) + """
        SELECT 'parsed' AS metric, (SELECT count(*) FROM orders) AS value
        UNION ALL SELECT 'skipped', (SELECT count(*) FROM documents) + (SELECT count(*) FROM supplier)
        UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
        UNION ALL SELECT 'errors', count(*) FROM supplier""",
    "extract_errors": """SELECT 'bad/O' || o_orderkey || '.java' AS filepath FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'bad/o' || o_orderkey || '.py' FROM orders WHERE o_orderstatus = 'P'""",
    "first_warnings": DOCFILES + """, w AS (SELECT 'nobody reads ' || filepath AS message FROM docfile WHERE ext = '.txt')
        (SELECT message FROM w ORDER BY message LIMIT 10) UNION ALL
        SELECT '... and ' || (count(*) - 10) || ' more' FROM w HAVING count(*) > 10""",
    "json_round_trip": JAVA + "SELECT * EXCLUDE (raw_target) FROM edges",
}

INCREMENTAL = {
    "diff_files": f"""SELECT {JAVA_PATH} AS filepath, CASE o_orderstatus WHEN 'P' THEN 'deleted' WHEN 'F' THEN 'changed'
        ELSE 'same' END AS status FROM orders""",
    "diff_files_added": f"""SELECT {JAVA_PATH} AS filepath, CASE o_orderstatus WHEN 'P' THEN 'added' WHEN 'F' THEN 'changed'
        ELSE 'same' END AS status FROM orders""",
    "vanished_paths": _with(_java_src("o_orderstatus <> 'P'"), _JAVA_NODES) + "SELECT uid, node_type FROM nodes",
    "two_runs": f"""SELECT {JAVA_PATH} AS filepath, sha256({JAVA_TEXT}) AS file_hash, 'left' AS side FROM orders
            WHERE o_orderstatus IN ('P', 'F')
        UNION ALL SELECT {JAVA_PATH}, sha256({_AFTER_TEXT}), 'right' FROM orders WHERE o_orderstatus = 'F'""",
    "maintain_batches": JAVA_AFTER + "SELECT * EXCLUDE (raw_target) FROM resolved",
    "maintain_nodes": JAVA_AFTER + "SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type",
    "compacted": JAVA_AFTER + "SELECT * EXCLUDE (raw_target) FROM resolved",
    "incremental_update": JAVA_AFTER + "SELECT * EXCLUDE (raw_target) FROM resolved",
    "incremental_nodes": JAVA_AFTER + "SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type",
    "mark_stale": JAVA + f"""SELECT node_type, coalesce(o_orderstatus IN ('P', 'F'), false) AS stale, count(*) AS n
        FROM nodes JOIN orders ON nodes.filepath = {JAVA_PATH} GROUP BY ALL""",
    "snapshot_diff": STORE + """, a AS (SELECT * FROM allnode WHERE NOT (node_type = 'Function' AND
            docstring IS NOT NULL AND docstring LIKE '%ECONOMY')),
        b AS (SELECT * REPLACE (CASE WHEN signature = 'order(P)' THEN 'order(F)' ELSE signature END AS signature)
            FROM allnode WHERE NOT (node_type = 'ConditionalBranch' AND docstring LIKE '%> 1)')),
        d AS (SELECT coalesce(b.uid, a.uid) AS uid, coalesce(b.node_type, a.node_type) AS node_type,
            coalesce(b.name, a.name) AS name, coalesce(b.filepath, a.filepath) AS filepath,
            CASE WHEN a.uid IS NULL THEN 'added' WHEN b.uid IS NULL THEN 'removed'
                 WHEN a.signature IS DISTINCT FROM b.signature THEN 'modified' END AS change
            FROM a FULL JOIN b ON a.uid = b.uid AND a.node_type = b.node_type)
        SELECT * FROM d WHERE change IS NOT NULL AND node_type IN ('Function', 'Constructor', 'ConditionalBranch')""",
}

# -- search -------------------------------------------------------------------

_DOCNODES = r"""docnode AS (SELECT 'doc:' || doc_id AS uid, 'doc_' || doc_id || ' ' || lang AS name,
        CASE lang WHEN 'en' THEN 'Function' WHEN 'fr' THEN 'Class' WHEN 'de' THEN 'Interface' ELSE 'Constructor' END
        AS type, source || '/' || lang || '/' || doc_id || '.py' AS filepath, text AS docstring,
        'read(' || source || ')' AS signature FROM documents)"""


def _postings(nodes):
    fields = " UNION ALL ".join(
        f"SELECT '{f}' AS field, uid, {f} AS text FROM {nodes} WHERE {f} IS NOT NULL"
        for f in ("name", "docstring", "signature", "filepath"))
    return rf"""word AS (SELECT field, uid, [x for x in regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+') if x <> '']
            AS words FROM ({fields})),
        stat AS (SELECT field, count(*) AS n_docs, avg(len(words)) AS avg_len FROM word WHERE len(words) > 0 GROUP BY field),
        posting AS (SELECT field, uid, term, dl, count(*) AS tf FROM
            (SELECT field, uid, len(words) AS dl, unnest(words) AS term FROM word) GROUP BY ALL)"""


def _bm25(words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT uid, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len)) AS part
        FROM posting JOIN (SELECT field, term, count(*) AS df FROM posting GROUP BY ALL) USING (field, term)
        JOIN stat USING (field) WHERE term IN ({listed})"""


def _wild(pattern):
    return f"SELECT DISTINCT uid, field, 1.0 AS part FROM posting WHERE regexp_full_match(term, '{pattern}')"


def _top(parts, k):
    body = " UNION ALL ".join(f"SELECT uid, part FROM ({p})" for p in parts)
    return f"SELECT uid, round(sum(part), 6) AS score FROM ({body}) GROUP BY uid ORDER BY score DESC, uid LIMIT {k}"


_SEARCH = _with(_DOCNODES, _postings("docnode"))
SEARCH = {
    "search_topk": _SEARCH + f"""SELECT type, name, filepath, signature, docstring, score, uid
        FROM ({_top([_bm25(['the', 'merge', 'src7', 'und', 'doc_12'])], 10)}) JOIN docnode USING (uid)""",
    "search_indexed": _SEARCH + _top([_bm25(["la", "queue", "und", "src3"])], 25),
    "search_wildcard": _SEARCH + _top([_wild("th.r.*"), _wild(".*mentent"), _wild("doc_1.*")], 50),
    "search_wildcard_path": _SEARCH + _top([_wild("py"), _wild("doc"), _wild("1.*"), _wild("src."), _wild("en")], 50),
    "search_fitting_terms": _SEARCH + "SELECT DISTINCT term FROM posting WHERE regexp_full_match(term, '.*ment.n.*')",
    "search_rare": _SEARCH + _top([_bm25(["doc_17", "the", "src3"])], 3),
    "search_vocabulary": _SEARCH + """SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
        FROM posting GROUP BY field, term""",
    "search_neighbours": STORE.rstrip() + ",\n" + "hitnode AS (SELECT * FROM allnode WHERE node_type IN "
        "('Class', 'Function', 'Interface', 'Constructor')),\n" + _postings("hitnode")
        + f""", hit AS ({_top([_bm25(['supplier', '000000001', 'ring'])], 10)})
        SELECT DISTINCT h.uid, 'caller' AS role, source_uid AS other_uid, n.name FROM hit h
            JOIN uedge e ON e.target_uid = h.uid AND edge_type = 'calls' JOIN allnode n ON n.uid = source_uid
        UNION SELECT DISTINCT h.uid, 'callee', target_uid, n.name FROM hit h
            JOIN uedge e ON e.source_uid = h.uid AND edge_type = 'calls' JOIN allnode n ON n.uid = target_uid""",
}

# -- changes --------------------------------------------------------------------

_CHANGES = """chg AS (SELECT ts, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'moved'
        WHEN 'click' THEN 'created' ELSE 'modified' END AS event_type,
        CASE WHEN user_id < 10 THEN '/repo/target/u' WHEN user_id < 20 THEN '/repo/.cache/u' ELSE '/repo/src/u' END
        || user_id || CASE WHEN value < 5 THEN '.md' WHEN value < 20 THEN '.py' ELSE '.Java' END AS src_path,
        '/repo/src/moved' || user_id || '.py' AS dest_path,
        event_type = 'view' AND user_id > 140 AS is_directory FROM events),
    side AS (SELECT ts, is_directory, CASE WHEN event_type IN ('created', 'modified') THEN 'changed' ELSE 'deleted' END AS kind,
            src_path AS path, event_type FROM chg
        UNION ALL SELECT ts, is_directory, 'changed', dest_path, event_type FROM chg WHERE event_type = 'moved'),
    rel AS (SELECT ts, kind, path FROM side WHERE NOT is_directory AND lower(path) SIMILAR TO '.*\\.(py|java)'
        AND NOT starts_with(path, '/repo/target/') AND NOT starts_with(path, '/repo/.cache/'))"""
CHG = _with(_CHANGES)
_KIND = "CASE WHEN bool_or(kind = 'deleted') THEN 'deleted' ELSE 'changed' END AS kind"
_FMT = "'%Y-%m-%d %H:%M:%S'"

CHANGES = {
    "changes_filter": CHG + "SELECT kind, path, count(*) AS n FROM rel GROUP BY ALL",
    "changes_moves": CHG + "SELECT kind, path, count(*) AS n FROM side WHERE event_type = 'moved' GROUP BY ALL",
    "changes_relative": CHG + "SELECT DISTINCT substr(path, 11) AS filepath FROM rel WHERE starts_with(path, '/repo/src/')",
    "changes_collapse": CHG + f"SELECT path, {_KIND} FROM rel GROUP BY path",
    "changes_coalesce": CHG + f"""SELECT strftime(date_trunc('hour', ts), {_FMT}) AS batch_start, path, {_KIND}
        FROM rel GROUP BY date_trunc('hour', ts), path""",
    "changes_debounce": CHG.replace("WITH", "WITH RECURSIVE", 1) + f""",
        r AS (SELECT *, regexp_extract(path, '[0-9]') AS root FROM rel),
        opened AS (SELECT root, min(ts) AS t FROM r GROUP BY root UNION ALL
            SELECT opened.root, min(r.ts) FROM opened JOIN r ON r.root = opened.root AND r.ts >= opened.t + INTERVAL 6 HOUR
            GROUP BY opened.root, opened.t)
        SELECT r.root, strftime(t, {_FMT}) AS batch_start, path, {_KIND} FROM r ASOF JOIN opened ON r.root = opened.root AND r.ts >= t
        GROUP BY r.root, t, path""",
    "changes_bursts": CHG + f""", gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first
            FROM rel WINDOW w AS (PARTITION BY path ORDER BY ts)),
        burst AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ts) AS b FROM gap)
        SELECT strftime(min(ts), {_FMT}) AS batch_start, path, {_KIND} FROM burst GROUP BY path, b""",
}

# -- domains ------------------------------------------------------------------------

_DOMAINS = """dom AS (SELECT 'Domain_' || n_nationkey AS uid, 'Domain ' || n_nationkey AS name, n_name AS summary FROM nation
        UNION ALL SELECT 'Domain_none', 'Domain none', 'no members'),
    mem AS (SELECT uid, name, node_type AS type, signature, 'Domain_' || substr(filepath, 4) AS domain_uid FROM allnode
        WHERE node_type IN ('Class', 'Function') AND filepath <> 'lib'),
    ctx AS (SELECT domain_uid, uid, '- ' || name || CASE WHEN coalesce(signature, '') <> '' THEN ': ' || signature ELSE '' END
        AS line FROM mem)"""
DOM = STORE.rstrip() + ",\n" + _DOMAINS + "\n"

DOMAINS = {
    "louvain_check": STORE + """SELECT count(*) AS grouped, count(DISTINCT uid) AS nodes, true AS no_worse FROM allnode
        WHERE node_type IN ('Class', 'Function', 'Interface')""",
    "named_domains": STORE + """, g AS (SELECT count(*) AS member_count, min(uid) AS first_uid FROM allnode
            WHERE node_type = 'Function' AND filepath <> 'lib' GROUP BY split_part(uid, '.', 1) HAVING count(*) >= 3),
        r AS (SELECT member_count, row_number() OVER (ORDER BY member_count DESC, first_uid) - 1 AS i FROM g)
        SELECT 'Domain_' || i AS uid, 'Domain ' || i AS name, member_count FROM r""",
    "domains_round_trip": DOM + """SELECT mem.uid, domain_uid, dom.name, dom.summary FROM mem JOIN dom ON dom.uid = domain_uid""",
    "domain_summary_fn": DOM + """, placed AS (SELECT *, CAST('0x' || md5(uid)[1:8] AS BIGINT) % parts AS part
            FROM ctx JOIN (SELECT domain_uid, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts FROM ctx GROUP BY 1)
            USING (domain_uid)),
        piece AS (SELECT domain_uid, part, sum(length(line) + 1) - 1 AS n FROM placed GROUP BY 1, 2),
        whole AS (SELECT domain_uid, string_agg(CASE WHEN domain_uid = 'Domain_7' THEN 'no summary of Domain_7: asked to fail'
            ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END, chr(10) ORDER BY part) AS summary FROM piece GROUP BY 1)
        SELECT uid, name, whole.summary, CAST(NULL AS BIGINT) AS member_count FROM dom LEFT JOIN whole ON uid = domain_uid""",
    "modularity_fixed": DOM + """, keep AS (SELECT uid FROM allnode WHERE node_type IN ('Class', 'Function', 'Interface')),
        pair AS (SELECT DISTINCT least(source_uid, target_uid) AS u, greatest(source_uid, target_uid) AS v FROM uedge
            WHERE edge_type IN ('calls', 'contains', 'implements', 'extends')
                AND source_uid IN (FROM keep) AND target_uid IN (FROM keep)),
        linked AS (SELECT a.domain_uid AS cu, b.domain_uid AS cv FROM pair JOIN mem a ON u = a.uid JOIN mem b ON v = b.uid),
        half AS (SELECT cu AS c, cu = cv AS inside FROM linked UNION ALL SELECT cv, cu = cv FROM linked),
        per AS (SELECT sum(inside::INT) AS i, count(*) AS tot FROM half GROUP BY c)
        SELECT round(sum(i) / sum(tot) - sum(tot * tot) / (sum(tot) * sum(tot)), 9) AS modularity FROM per""",
    "domain_listing": DOM + """SELECT dom.name, dom.summary, count(mem.uid) AS member_count FROM dom
        LEFT JOIN mem ON dom.uid = domain_uid GROUP BY dom.uid, dom.name, dom.summary""",
    "domain_detail": DOM + """SELECT dom.name AS domain, dom.summary, mem.type, mem.name FROM dom
        LEFT JOIN mem ON dom.uid = domain_uid""",
    "domain_of_symbol": DOM + """SELECT mem.name AS symbol, mem.uid, dom.name AS domain FROM mem
        JOIN dom ON dom.uid = domain_uid""",
    "domain_members": DOM + "SELECT uid, domain_uid, type, name, signature FROM mem",
    "domain_context": DOM + """, placed AS (SELECT *, CAST(CAST('0x' || md5(uid)[1:8] AS BIGINT) % parts AS INTEGER) AS part
            FROM ctx JOIN (SELECT domain_uid, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts FROM ctx GROUP BY 1)
            USING (domain_uid))
        SELECT domain_uid, part, string_agg(line, chr(10) ORDER BY uid) AS text FROM placed GROUP BY domain_uid, part""",
    "domain_summary": DOM + """SELECT uid, name, CASE WHEN text IS NOT NULL THEN 'Mock summary for ' || uid
            || '. (Set Gemini API key to generate real summaries). Contains:' || chr(10) || text[1:100] || '...' END
            AS summary, CAST(NULL AS BIGINT) AS member_count
        FROM dom LEFT JOIN (SELECT domain_uid, string_agg(line, chr(10) ORDER BY uid) AS text FROM ctx GROUP BY 1)
            ON uid = domain_uid""",
    "domain_subgraph": DOM + """, keep AS (SELECT uid FROM mem WHERE domain_uid = 'Domain_7')
        SELECT source_uid, edge_type, target_uid FROM uedge
        WHERE source_uid IN (FROM keep) AND target_uid IN (FROM keep)""",
    "community_sizes": DOM + """SELECT domain_uid AS community, count(*) AS member_count, min(uid) AS first_uid
        FROM mem GROUP BY 1 HAVING count(*) >= 3""",
    "changed_domains": DOM + """SELECT DISTINCT domain_uid, 'removed' AS status FROM mem WHERE domain_uid = 'Domain_3'
        UNION ALL SELECT DISTINCT domain_uid, 'changed' FROM mem WHERE domain_uid = 'Domain_4'""",
}

OTHER = {
    "page_placeholders": """WITH page AS (SELECT regexp_replace(url, '^https?://[^/]*|[?#].*$', '', 'g') AS uid, html FROM pages)
        SELECT DISTINCT t AS uid, 'Unresolved' AS node_type
        FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM page)
        WHERE t NOT IN (SELECT uid FROM page)""",
    "page_links": """WITH page AS (SELECT regexp_replace(url, '^https?://[^/]*|[?#].*$', '', 'g') AS uid, html FROM pages)
        SELECT DISTINCT uid AS source_uid, 'imports' AS edge_type,
        unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target_uid FROM page""",
    "conversation_tree_check": """SELECT 'conv' || conv_id || '.t' || turn AS uid, count(*) AS parents FROM conversations
        GROUP BY 1 HAVING count(*) <> 1 UNION ALL SELECT DISTINCT 'conv' || conv_id, 0 FROM conversations""",
    "page_of_symbols": STORE + """SELECT name, uid FROM allnode WHERE name IS NOT NULL AND node_type <> 'Unresolved'
        ORDER BY name, uid LIMIT 50 OFFSET 100""",
    "page_after_symbol": STORE + """SELECT name, uid FROM allnode WHERE name IS NOT NULL AND node_type <> 'Unresolved'
        AND (name > 'order_1' OR name = 'order_1' AND uid > 'f/n1') ORDER BY name, uid LIMIT 50""",
}


CORE |= {f"{name}_stored": CORE[name] for name in ("callers", "callers_of_symbol", "callees_of_symbol", "context_of_symbol")}
CORE["context_stored"] = CORE["code_context"]


def all_sql():
    return {**CORE, **FILES, **INCREMENTAL, **SEARCH, **CHANGES, **DOMAINS, **OTHER}
