"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from .functions.text import STOP_WORDS
from .testdata import PATH_SQL

SQL: dict[str, str] = {}

# The graph view of the testbed.
VIEW = """
cust AS (
  SELECT c_custkey, r_name AS job_id, concat('c', c_custkey) AS id,
         concat('src/', lower(translate(n_name, ' ', '_')), '/file_', c_custkey, '.py') AS path, CAST(floor(abs(c_acctbal) / 10) AS INTEGER) AS lines
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), pairs AS (
  SELECT DISTINCT cust.job_id, cust.id AS source_id, concat('s', l_suppkey) AS target_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey WHERE l_quantity >= 40
), items AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1
), classes AS (
  SELECT job_id, concat('o', o_orderkey) AS id, concat(CASE WHEN o_orderkey % 7 = 0 THEN 'order_' ELSE 'Order' END, o_orderkey) AS label, path AS file, cust.id AS file_id,
         CAST(trunc(o_totalprice / 500) AS INTEGER) AS lines, coalesce(n, 0) * 3 AS methods, o_orderstatus = 'P' AS is_abstract, o_orderpriority < '3' AS has_docstring
  FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN items ON o_orderkey = l_orderkey
), functions AS (
  SELECT job_id, concat('l', l_orderkey, '_', l_linenumber) AS id, CASE WHEN l_linenumber % 3 = 0 THEN concat('getItem', l_linenumber) ELSE concat('get_item_', l_partkey % 50) END AS label,
         path AS file, cust.id AS file_id, concat('o', o_orderkey) AS class_id, CAST(trunc(l_quantity * 2) AS INTEGER) AS lines, l_linenumber + 5 AS param_count, l_linestatus = 'O' AS is_async,
         l_orderkey % 20 AS cyclomatic, l_partkey % 7 AS nesting, l_suppkey % 20 AS calls, l_returnflag = 'N' AS has_docstring
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey
), files AS (
  SELECT job_id, id, path, 'python' AS language, lines, (SELECT count(*) FROM classes k WHERE k.file_id = cust.id) AS classes FROM cust
  UNION ALL
  SELECT DISTINCT job_id, concat('s', s_suppkey), concat('lib/shared/sup_', s_suppkey, '.ts'), 'typescript', CAST(floor(abs(s_acctbal) / 20) AS INTEGER), 0
  FROM pairs JOIN supplier ON target_id = concat('s', s_suppkey)
), edges AS (
  SELECT job_id, source_id, target_id, 'IMPORTS' AS relationship FROM pairs UNION ALL SELECT job_id, source_id, target_id, 'DEPENDS_ON' FROM pairs
  UNION ALL SELECT job_id, file_id, id, 'CONTAINS' FROM classes UNION ALL SELECT job_id, class_id, id, 'CONTAINS' FROM functions
), coupling AS (
  SELECT f.job_id, f.id, coalesce(o.n, 0) AS ce, coalesce(i.n, 0) AS ca
  FROM files f LEFT JOIN (SELECT job_id, source_id, count(*) AS n FROM pairs GROUP BY 1, 2) o ON o.job_id = f.job_id AND o.source_id = f.id
  LEFT JOIN (SELECT job_id, target_id, count(*) AS n FROM pairs GROUP BY 1, 2) i ON i.job_id = f.job_id AND i.target_id = f.id
)"""


def over_view(name: str, sql: str, more: str = "") -> None:
    SQL[name] = f"WITH {VIEW}{', ' + more if more else ''} {sql}"


over_view("coupling_metrics", "SELECT job_id, id, ce, ca, CASE WHEN ce + ca > 0 THEN ce / (ce + ca) END AS instability FROM coupling")
FANS = "fans AS (SELECT job_id, id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT job_id, source_id AS id, 0 AS i, 1 AS o FROM edges WHERE relationship <> 'CONTAINS' UNION ALL SELECT job_id, target_id, 1, 0 FROM edges WHERE relationship <> 'CONTAINS') GROUP BY 1, 2)"
over_view("fan_in_out_dup", "SELECT job_id, id, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out FROM fans", FANS)
over_view("top_fanout", "SELECT job_id, id, CAST(fan_out AS BIGINT) AS fan_out FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fan_out DESC, id DESC) AS rn FROM fans) WHERE rn = 1 AND fan_out >= 3", FANS)
over_view("node_type_counts", "SELECT job_id, 'File' AS node_type, count(*) AS n FROM files GROUP BY 1 UNION ALL SELECT job_id, 'Class', count(*) FROM classes GROUP BY 1 UNION ALL SELECT job_id, 'Function', count(*) FROM functions GROUP BY 1")
over_view("edge_type_counts", "SELECT job_id, relationship, count(*) AS n FROM edges GROUP BY 1, 2")
over_view("incident_edges", "SELECT * FROM edges WHERE source_id = 's7' OR target_id = 's7'")
over_view("owner_resolution", "SELECT job_id, file_id, count(*) AS n FROM functions GROUP BY 1, 2")
over_view("mixed_naming", "SELECT job_id, file AS path, CAST(sum(CASE WHEN regexp_matches(label, '[a-z][A-Z]') THEN 1 ELSE 0 END) AS BIGINT) AS camel, CAST(sum(CASE WHEN NOT regexp_matches(label, '[a-z][A-Z]') AND label LIKE '%\\_%' ESCAPE '\\' THEN 1 ELSE 0 END) AS BIGINT) AS snake FROM functions GROUP BY 1, 2")
over_view("line_percentiles", "SELECT job_id, quantile_cont(CAST(lines AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(lines AS DOUBLE), 0.5) AS median, round(avg(lines), 6) AS mean, max(lines) AS longest FROM functions WHERE lines > 0 GROUP BY 1")
P95 = "p AS (SELECT job_id, quantile_cont(CAST(lines AS DOUBLE), 0.95) AS p95, count(*) AS n_lines FROM functions WHERE lines > 0 GROUP BY 1)"
over_view("size_outliers", "SELECT f.job_id, f.id, f.lines FROM functions f JOIN p USING (job_id) WHERE f.lines >= p95 AND n_lines >= 20 AND f.lines > 60", P95)
over_view("top_k_per_group", "SELECT job_id, id, CAST(methods AS INTEGER) AS methods, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY methods DESC, id) AS rn FROM classes) WHERE rn <= 6")
CLAMP = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
L_, C_, P_, N_, K_ = CLAMP("(lines - 60) / 60.0::DOUBLE"), CLAMP("(cyclomatic - 10) / 10.0::DOUBLE"), CLAMP("(param_count - 7) / 7.0::DOUBLE"), CLAMP("(nesting - 3) / 3.0::DOUBLE"), CLAMP("(calls - 8) / 10.0::DOUBLE")
JUDGED = f"""{P95}, scored AS (
  SELECT f.*, coalesce(lines >= p95 AND n_lines >= 20 AND lines > 60, false) AS outlier,
         CASE WHEN cyclomatic > 0 THEN {L_} * 0.2::DOUBLE + {C_} * 0.3::DOUBLE ELSE {L_} * 0.5::DOUBLE END + ({P_} * 0.2::DOUBLE + {N_} * 0.15::DOUBLE + {K_} * 0.15::DOUBLE) AS composite
  FROM functions f LEFT JOIN p USING (job_id)
), judged AS (SELECT *, composite >= 0.55 - 1e-12 OR outlier AS is_god, param_count > 7 AS many_params FROM scored
), fns AS (SELECT *, NOT is_god AND (composite >= 0.35 - 1e-12 OR lines > 40) AS is_large FROM judged
), cp AS (SELECT job_id, quantile_cont(CAST(lines AS DOUBLE), 0.95) AS p95, count(*) AS n_lines FROM classes WHERE lines > 0 GROUP BY 1
), cls AS (SELECT *, NOT is_god AND methods > 12 AS is_large FROM (SELECT c.*, methods > 20 OR lines > 400 AS is_god FROM classes c))"""
over_view("god_function_scores", "SELECT job_id, id, round(composite, 6) AS composite, is_god, is_large, many_params FROM fns", JUDGED)
over_view(
    "issue_counts_complexity",
    """SELECT job_id, rule, severity, count(*) AS n FROM (
  SELECT job_id, CASE WHEN cyclomatic >= 15 THEN 'I1' WHEN cyclomatic >= 10 THEN 'I2' ELSE 'I3' END AS rule, CASE WHEN cyclomatic >= 15 THEN 'critical' WHEN cyclomatic >= 10 THEN 'high' ELSE 'medium' END AS severity FROM fns WHERE cyclomatic >= 5
  UNION ALL SELECT job_id, 'I4', 'high' FROM fns WHERE nesting >= 5 UNION ALL SELECT job_id, 'I5', 'high' FROM fns WHERE is_god UNION ALL SELECT job_id, 'I6', 'medium' FROM fns WHERE is_large
  UNION ALL SELECT job_id, 'I7', 'high' FROM fns WHERE many_params AND NOT is_god UNION ALL SELECT job_id, 'I8', 'high' FROM cls WHERE is_god UNION ALL SELECT job_id, 'I9', 'medium' FROM cls WHERE is_large) GROUP BY ALL""",
    JUDGED,
)
over_view("issue_counts_coupling", "SELECT job_id, rule, severity, count(*) AS n FROM (SELECT job_id, 'I10' AS rule, 'high' AS severity FROM coupling WHERE ce > 10 UNION ALL SELECT job_id, 'I11', 'medium' FROM coupling WHERE ce > 7 AND ce <= 10 UNION ALL SELECT job_id, 'I12', 'medium' FROM coupling WHERE ca > 20) GROUP BY ALL")
over_view("issue_counts_size", "SELECT job_id, rule, severity, count(*) AS n FROM (SELECT job_id, 'I13' AS rule, 'high' AS severity FROM files WHERE lines > 500 UNION ALL SELECT job_id, 'I14', 'low' FROM files WHERE lines > 300 AND lines <= 500 UNION ALL SELECT job_id, 'I15', 'medium' FROM files WHERE classes > 5) GROUP BY ALL")
over_view(
    "issue_groups",
    """SELECT job_id, file, count(*) AS n, CAST(min(r) AS INTEGER) AS worst FROM (
  SELECT job_id, path AS file, 1 AS r FROM files WHERE lines > 500 UNION ALL SELECT job_id, path, 3 FROM files WHERE lines > 300 AND lines <= 500 UNION ALL SELECT job_id, path, 2 FROM files WHERE classes > 5
  UNION ALL SELECT f.job_id, path, CASE WHEN ce > 10 THEN 1 ELSE 2 END FROM files f JOIN coupling c ON c.job_id = f.job_id AND c.id = f.id WHERE ce > 7
  UNION ALL SELECT f.job_id, path, 2 FROM files f JOIN coupling c ON c.job_id = f.job_id AND c.id = f.id WHERE ca > 20) GROUP BY 1, 2""",
)
over_view(
    "issue_ranks",
    """SELECT job_id, rule, severity, file_path, row_number() OVER (PARTITION BY job_id ORDER BY r, file_path, rule) AS place FROM (
  SELECT job_id, 'I13' AS rule, 'high' AS severity, 1 AS r, path AS file_path FROM files WHERE lines > 500 UNION ALL SELECT job_id, 'I14', 'low', 3, path FROM files WHERE lines > 300 AND lines <= 500
  UNION ALL SELECT job_id, 'I15', 'medium', 2, path FROM files WHERE classes > 5
  UNION ALL SELECT f.job_id, 'I10', 'high', 1, path FROM files f JOIN coupling c ON c.job_id = f.job_id AND c.id = f.id WHERE ce > 10
  UNION ALL SELECT f.job_id, 'I11', 'medium', 2, path FROM files f JOIN coupling c ON c.job_id = f.job_id AND c.id = f.id WHERE ce > 7 AND ce <= 10
  UNION ALL SELECT f.job_id, 'I12', 'medium', 2, path FROM files f JOIN coupling c ON c.job_id = f.job_id AND c.id = f.id WHERE ca > 20)""",
)
PUBLIC = "public AS (SELECT job_id, has_docstring FROM classes UNION ALL SELECT job_id, has_docstring FROM functions WHERE lines > 5)"
over_view("doc_coverage", "SELECT job_id, count(*) AS n_public, CAST(sum(CASE WHEN has_docstring THEN 0 ELSE 1 END) AS BIGINT) AS n_undocumented, round(1.0::DOUBLE - sum(CASE WHEN has_docstring THEN 0 ELSE 1 END) / greatest(1, count(*)), 6) AS coverage FROM public GROUP BY 1", PUBLIC)
over_view("worst_undocumented", "SELECT job_id, id, lines, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY lines DESC, id) AS rn FROM classes WHERE NOT has_docstring) WHERE rn <= 5")
over_view("canvas_layout", "SELECT job_id, id, CAST((i % 5) * 220 AS INTEGER) AS x, CAST((i // 5) * 120 AS INTEGER) AS y FROM (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY id) - 1 AS i FROM files)")
NAMES = "SELECT label, 'class' AS kind FROM classes UNION ALL SELECT label, 'method' FROM functions"
over_view(
    "naming_check",
    """SELECT kind, lang, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS bad FROM (
  SELECT kind, lang, CASE WHEN lang = 'unknown' THEN true WHEN kind = 'class' THEN regexp_full_match(label, '[A-Z][a-zA-Z0-9]*') OR (lang = 'python' AND regexp_full_match(label, '_[A-Z][a-zA-Z0-9]*'))
    WHEN lang = 'python' THEN regexp_full_match(label, '[a-z_][a-z0-9_]*') WHEN lang = 'java' THEN regexp_full_match(label, '[a-z][a-zA-Z0-9]*') ELSE regexp_full_match(label, '[a-zA-Z][a-zA-Z0-9]*') END AS ok
  FROM (SELECT label, kind FROM n), (VALUES ('python'), ('java'), ('typescript'), ('unknown')) v(lang)) GROUP BY 1, 2""",
    f"n AS ({NAMES})",
)
D1 = """f AS (SELECT job_id, count(*) AS fns, sum(is_god::INT) AS god, sum(is_large::INT) AS large, sum(many_params::INT) AS params FROM fns GROUP BY 1
), c AS (SELECT job_id, count(*) AS cls, sum(is_god::INT) AS god_cls, sum(is_abstract::INT) AS abstract, sum((NOT regexp_full_match(label, '[A-Z][a-zA-Z0-9]*'))::INT) AS bad_cls FROM cls GROUP BY 1
), k AS (SELECT job_id, count(*) AS files, sum((ce > 10)::INT) AS fanout, sum((ca > 20)::INT) AS hubs FROM coupling GROUP BY 1
), z AS (SELECT job_id, sum((lines > 500)::INT) AS oversized, count(DISTINCT split_part(path, '/', 1)) AS modules FROM files GROUP BY 1
), b AS (SELECT job_id, sum((NOT regexp_full_match(label, '[a-z_][a-z0-9_]*'))::INT) AS bad_fns FROM fns GROUP BY 1
), d AS (SELECT job_id, 1.0::DOUBLE - sum((NOT has_docstring)::INT) / greatest(1, count(*)) AS coverage FROM public GROUP BY 1
), dims AS (
  SELECT job_id, unnest([
    {'p': 0, 'dimension': 'Complexity', 's': trunc(100 - (god / fns * 50 + large / fns * 15 + god_cls / cls * 35 + params / fns * 20)), 'w': 0.22::DOUBLE},
    {'p': 1, 'dimension': 'Coupling', 's': trunc(100 - (fanout / files * 55 + hubs / files * 25)), 'w': 0.22::DOUBLE},
    {'p': 2, 'dimension': 'Size', 's': trunc(100 - oversized / files * 60), 'w': 0.15::DOUBLE},
    {'p': 3, 'dimension': 'Architecture', 's': 100 - (CASE WHEN files > 15 AND modules < 3 THEN 8 ELSE 0 END) + least(12, trunc(abstract / cls * 50)), 'w': 0.20::DOUBLE},
    {'p': 4, 'dimension': 'Documentation', 's': trunc(coverage * 100), 'w': 0.12::DOUBLE},
    {'p': 5, 'dimension': 'Naming', 's': trunc((1.0::DOUBLE - (bad_fns + bad_cls) / (fns + cls)) * 100), 'w': 0.09::DOUBLE}], recursive := true)
  FROM f JOIN c USING (job_id) JOIN k USING (job_id) JOIN z USING (job_id) JOIN b USING (job_id) JOIN d USING (job_id)
), sc AS (SELECT job_id, p, dimension, CAST(greatest(0, least(100, s)) AS INTEGER) AS score, w FROM dims)"""
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 65 THEN 'C' WHEN {0} >= 50 THEN 'D' ELSE 'F' END"
over_view("dimension_scores", f"SELECT job_id, dimension, score, {GRADE.format('score')} AS grade FROM sc", f"{JUDGED}, {PUBLIC}, {D1}")
over_view("overall_score", f"SELECT job_id, overall_score, {GRADE.format('overall_score')} AS overall_grade, weakest FROM (SELECT job_id, CAST(trunc(list_sum(list(score * w ORDER BY p))) AS INTEGER) AS overall_score, arg_min(dimension, score * 10 + p) AS weakest FROM sc GROUP BY 1)", f"{JUDGED}, {PUBLIC}, {D1}")

# -- paths ----------------------------------------------------------------------------------
REPO = f"WITH repo AS (SELECT lang AS job_id, {PATH_SQL} AS path, n_chars AS size, doc_id, source FROM documents)"
NAME, EXT = "split_part(path, '/', -1)", "CASE WHEN split_part(path, '/', -1) LIKE '%.%' THEN '.' || lower(split_part(path, '.', -1)) ELSE '' END"
CATEGORY = f"""CASE WHEN len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ('node_modules', 'vendor', 'venv', 'env', 'build', 'dist', '.github', 'docs', 'doc'))) > 0 THEN
    CASE list_filter(string_split(path, '/')[:-2], lambda x: x IN ('node_modules', 'vendor', 'venv', 'env', 'build', 'dist', '.github', 'docs', 'doc'))[1] WHEN 'node_modules' THEN 'vendor' WHEN 'vendor' THEN 'vendor' WHEN 'docs' THEN 'docs' WHEN 'doc' THEN 'docs' ELSE 'build' END
  WHEN {EXT} IN ('.png', '.jpg', '.pdf') THEN 'asset' WHEN {NAME} = 'package.json' OR (starts_with({NAME}, '.') AND {EXT} IN ('.yaml', '.yml', '.json', '.toml')) THEN 'config'
  WHEN {EXT} IN ('.md', '.rst', '.txt') THEN 'docs' WHEN regexp_matches(path, '(^|/)(migrations?/|alembic/)') OR regexp_matches({NAME}, '^\\d{{4,14}}[_\\-].+\\.(py|sql|rb)$') THEN 'migration'
  WHEN regexp_matches(path, '(^|/)(generated/|gen/|[^/]+_pb2\\.)') THEN 'generated' WHEN regexp_matches(path, '(?i)(^|/)(tests?/|unit/)') OR regexp_matches(path, '(?i)(^|/)(test_[^/]+|[^/]+_test)([^/]*)$') THEN 'test'
  WHEN {EXT} IN ('.py', '.java', '.ts', '.tsx', '.js', '.jsx') THEN 'source' ELSE 'unknown' END"""
SQL["file_classify"] = f"{REPO} SELECT doc_id, path, {CATEGORY} AS category FROM repo"
SQL["category_counts"] = f"""{REPO}, k AS (SELECT job_id, {CATEGORY} AS c FROM repo) SELECT job_id, count(*) AS total_files, count(*) FILTER (c = 'source') AS source_files, count(*) FILTER (c = 'test') AS test_files, count(*) FILTER (c = 'generated') AS generated_files,
  count(*) FILTER (c = 'vendor') AS vendor_files, count(*) FILTER (c IN ('config', 'docs')) AS config_files, count(*) FILTER (c = 'unknown') AS unsupported_files, 0 AS skipped_files, 1.0::DOUBLE AS coverage_pct FROM k GROUP BY 1"""
SQL["dominant_language"] = f"""{REPO}, l AS (SELECT job_id, CASE {EXT} WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' END AS language FROM repo)
  SELECT job_id, language AS dominant_language FROM (SELECT job_id, language, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, language) AS rn FROM l WHERE language IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""
SQL["layer_detection"] = f"""{REPO} SELECT doc_id, CASE WHEN regexp_matches(lower(path), '/(domain|models)[/.]') THEN 'Domain' WHEN regexp_matches(lower(path), '/(infrastructure|persistence)[/.]') THEN 'Infra' WHEN regexp_matches(lower(path), '/(presentation|routers)[/.]') THEN 'Presentation'
  WHEN regexp_matches(lower(path), '/(components|frontend|pages)[/.]') THEN 'Frontend' WHEN regexp_matches(lower(path), '/utils[/.]') THEN 'Shared' ELSE 'Other' END AS layer FROM repo"""
SQL["diagram_noise"] = f"""{REPO} SELECT doc_id, {NAME} IN ('index.js') OR path LIKE '%/build/%' OR regexp_matches(path, '(?i)(^|/)(tests?/|test_[^/]+\\.|[^/]+_test\\.[^/]+$)') OR regexp_matches({NAME}, '(?i)^(test_|.*_test$|conftest)') OR size = 0 AS noise FROM repo"""
SQL["module_enumeration"] = f"{REPO}, s AS (SELECT job_id, string_split(path, '/') AS p FROM repo) SELECT DISTINCT job_id, array_to_string(p[:i], '/') AS module FROM s, LATERAL (SELECT unnest(range(1, least(len(p) - 1, 4) + 1)) AS i)"
SQL["top_directories"] = f"{REPO} SELECT job_id, count(DISTINCT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) END) AS n_dirs FROM repo GROUP BY 1"
SQL["longest_prefix_parent"] = f"""{REPO}, s AS (SELECT DISTINCT job_id, path FROM repo), m AS (SELECT DISTINCT job_id, array_to_string(string_split(path, '/')[:i], '/') AS module FROM s, LATERAL (SELECT unnest(range(1, least(len(string_split(path, '/')) - 1, 2) + 1)) AS i))
  SELECT s.job_id, s.path AS file, arg_max(m.module, length(m.module)) AS module FROM s LEFT JOIN m ON m.job_id = s.job_id AND starts_with(s.path, m.module || '/') GROUP BY 1, 2"""
SQL["code_file_selection"] = f"{REPO} SELECT job_id, path, size FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY size DESC, path) AS rn FROM repo WHERE {EXT} IN ('.py', '.java', '.ts', '.tsx', '.js', '.jsx')) WHERE rn <= 25"
SQL["url_parts"] = "SELECT page_id, concat('owner', page_id % 9) AS owner, concat('repo', page_id) AS name FROM pages"
SQL["content_preview"] = "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents"
SQL["field_types"] = """WITH n AS (SELECT DISTINCT lower(translate(p_name, ' ', '_')) AS name FROM part UNION SELECT unnest(['user_id', 'id', 'created_at', 'email', 'page', 'is_on', 'price_list', 'image_url', 'title', 'birthdate']))
  SELECT name, CASE WHEN name LIKE '%\\_id' ESCAPE '\\' OR name = 'id' THEN 'String PK' WHEN name LIKE '%\\_at' ESCAPE '\\' OR regexp_matches(name, 'date|time') THEN 'DateTime' WHEN name LIKE '%email%' THEN 'String' WHEN regexp_matches(name, 'count|num|age') THEN 'Integer'
  WHEN regexp_matches(name, 'is_|has_|enabled') THEN 'Boolean' WHEN regexp_matches(name, 'price|amount|salary') THEN 'Decimal' WHEN regexp_matches(name, 'url|path|description') THEN 'Text' ELSE 'String' END AS type FROM n"""
SQL["import_resolution"] = """WITH f AS (SELECT concat('pkg/mod_', p_partkey % 7, '/util_', p_partkey, '.py') AS target, concat('util_', p_partkey) AS stem FROM part WHERE p_partkey % 3 = 0),
  a AS (SELECT concat('f', p_partkey) AS source, concat('pkg.util_', p_partkey * 3) AS module, concat('util_', p_partkey * 3) AS last FROM part),
  e AS (SELECT source, module, target FROM a JOIN f ON stem = last),
  l AS (SELECT source, module, target FROM a JOIN f ON ends_with(stem, module) OR ends_with(module, stem) WHERE source NOT IN (SELECT source FROM e))
  SELECT DISTINCT 'synthetic' AS job_id, source, module, target FROM (SELECT * FROM e UNION ALL SELECT * FROM l)"""

# -- graphs ---------------------------------------------------------------------------------
NATIONS = """w AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), e AS (SELECT x.n_name AS s, y.n_name AS t FROM w JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE a <> b AND w >= (SELECT quantile_cont(w, 0.8) FROM w))"""
SQL["scc_nation"] = f"""WITH RECURSIVE {NATIONS}, r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
  m AS (SELECT x.s AS member, min(y.s) AS scc FROM r x JOIN r y ON x.s = y.t AND x.t = y.s GROUP BY 1)
  SELECT 'nations' AS job_id, CAST(count(*) OVER (PARTITION BY scc) AS INTEGER) AS size, member FROM m"""
SQL["instability_avg"] = f"""WITH {NATIONS}, n AS (SELECT s AS id FROM e UNION SELECT t FROM e), c AS (SELECT id, (SELECT count(DISTINCT t) FROM e WHERE s = id) AS ce, (SELECT count(DISTINCT s) FROM e WHERE t = id) AS ca FROM n)
  SELECT 'nations' AS job_id, round(avg(ce / (ce + ca)), 6) AS avg_instability FROM c WHERE ce + ca > 0"""
SQL["inheritance_depth"] = """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_partkey // 2 AS parent, 1 AS depth FROM part WHERE p_partkey > 1 UNION ALL SELECT c.id, c.parent // 2, depth + 1 FROM c WHERE c.parent > 1)
  SELECT CAST(id AS VARCHAR) AS id, CAST(max(depth) AS INTEGER) AS depth FROM c GROUP BY 1"""

# The least node on any cycle, how far all nodes are from it, and the first by names of the shortest ways back.
SQL["first_cycle_steps"] = f"""WITH RECURSIVE {NATIONS}, r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
  root AS (SELECT min(s) AS root FROM r WHERE s = t), far AS (SELECT root AS node, 0 AS n FROM root UNION SELECT e.t, n + 1 FROM far JOIN e ON e.s = far.node WHERE n < 30),
  near AS (SELECT node, min(n) AS n FROM far GROUP BY 1), size AS (SELECT min(n) + 1 AS n FROM near JOIN e ON e.s = near.node JOIN root ON e.t = root),
  way AS (SELECT [root] AS path FROM root UNION ALL SELECT list_append(path, near.node) FROM way JOIN e ON e.s = path[-1] JOIN near ON near.node = e.t AND near.n = len(path) WHERE len(path) < (SELECT n FROM size)),
  found AS (SELECT list_append(path, root) AS cycle FROM way JOIN e ON e.s = path[-1] JOIN root ON e.t = root WHERE len(path) = (SELECT n FROM size) ORDER BY cycle LIMIT 1)
  SELECT 'nations' AS job_id, CAST(i - 1 AS INTEGER) AS place, cycle[i] AS node FROM found, LATERAL (SELECT unnest(range(1, len(cycle) + 1)) AS i)"""
SQL["click_chain_depth"] = """SELECT job_id, id, depth FROM (SELECT CAST(client_id AS VARCHAR) AS job_id, CAST(click_id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) - 1 AS INTEGER) AS depth
  FROM (SELECT DISTINCT client_id, ts, click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL)) WHERE depth > 0"""
SQL["single_parent_depth"] = """WITH RECURSIVE par AS (SELECT p_partkey AS k, (p_partkey * p_partkey + 1) % (SELECT max(p_partkey) FROM part) + 1 AS parent FROM part),
  w AS (SELECT k, parent AS there, [k] AS seen FROM par UNION ALL SELECT w.k, par.parent, list_append(seen, w.there) FROM w JOIN par ON par.k = w.there WHERE NOT list_contains(seen, w.there))
  SELECT CAST(k AS VARCHAR) AS id, max(CASE WHEN list_contains(seen, there) THEN len(seen) - 1 ELSE len(seen) END) AS depth FROM w GROUP BY 1"""

# -- store, jobs, search ----------------------------------------------------------------------
SQL["insert_if_absent"] = """SELECT DISTINCT o_custkey AS id, 'old' AS "from" FROM orders UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
SQL["upsert_last_wins"] = "SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN c_custkey IS NULL THEN 'old' ELSE 'new' END AS label, CASE WHEN o_custkey IS NULL THEN 'later' ELSE 'first' END AS made FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey"
SQL["insert_parties_if_absent"] = """SELECT s_suppkey AS id, 'supplier' AS "from" FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""
SQL["upsert_parties"] = "SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS label, CASE WHEN s_suppkey IS NULL THEN 'customer' ELSE 'supplier' END AS made FROM customer FULL JOIN supplier ON c_custkey = s_suppkey"
LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts AS moment, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status FROM events)"
LAST = "last AS (SELECT job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, seq DESC) AS rn FROM log) WHERE rn = 1)"
SQL["latest_state"] = f"WITH {LOG}, {LAST} SELECT job_id, status FROM last"
SQL["orphan_reset"] = f"WITH {LOG}, {LAST} SELECT CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, count(*) AS n, count(*) FILTER (status IN ('pending', 'running')) AS n_errors FROM last GROUP BY 1"
SQL["status_counts_zero_filled"] = f"WITH {LOG} SELECT s AS status, (SELECT count(*) FROM log WHERE log.status = s) AS n FROM (SELECT unnest(['pending', 'running', 'completed', 'failed', 'cancelled']) AS s)"
SQL["job_transitions"] = f"""WITH RECURSIVE {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY moment, seq) AS i FROM log),
  f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS i, 'pending' AS status, 0 AS accepted, 0 AS rejected FROM log
    UNION ALL SELECT f.job_id, o.i, CASE WHEN ok THEN o.status ELSE f.status END, accepted + ok::INT, rejected + (NOT ok)::INT
    FROM f JOIN o ON o.job_id = f.job_id AND o.i = f.i + 1, LATERAL (SELECT (f.status || '>' || o.status) IN ('pending>running', 'running>running', 'running>completed', 'completed>completed', 'pending>failed', 'running>failed', 'failed>failed', 'pending>cancelled', 'running>cancelled') AS ok))
  SELECT job_id, status, accepted, rejected FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i DESC) AS rn FROM f) WHERE rn = 1"""
SQL["memory_fold"] = """SELECT CAST(o_custkey AS VARCHAR) AS repo_url, count(*) AS analysis_count, CAST(floor(arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 10000) AS INTEGER) AS overall_score, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS headline, lpad(CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR), 12, '0') AS job_id FROM orders GROUP BY 1"""
WORDS = lambda words, parts: " + ".join(f"{w} * (CASE WHEN contains(lower({f}), '{k}') THEN 1 ELSE 0 END)" for k in words for f, w in parts)
SQL["keyword_search"] = f"""{REPO}, s AS (SELECT job_id, doc_id AS id, {WORDS(["order", "service", "test", "router"], [(NAME, 3), ("source", 2), ("path", 1)])} AS score FROM repo)
  SELECT job_id, id, CAST(score AS INTEGER) AS score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rn FROM s WHERE score > 0) WHERE rn <= 8"""
SQL["fact_search"] = f"WITH s AS (SELECT doc_id AS id, {WORDS(['src1', 'the', 'router'], [('source', 3), ('text', 2), (PATH_SQL, 1)])} AS score FROM documents) SELECT id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10"
SQL["context_text"] = f"""{REPO}, s AS (SELECT job_id, {NAME} AS label, source AS file, CAST(doc_id AS VARCHAR) AS id, {WORDS(["order", "service", "router"], [(NAME, 3), ("source", 2), ("path", 1)])} AS score FROM repo),
  r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rn FROM s WHERE score > 0)
  SELECT job_id, concat('## Relevant code context from the repository:', chr(10), chr(10), '### File nodes:', chr(10),
    string_agg(concat('- `', label, '`', CASE WHEN length(file) > 0 THEN concat(' in `', file, '`') ELSE '' END), chr(10) ORDER BY rn)) AS context FROM r WHERE rn <= 8 GROUP BY 1"""
STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL["indexed_facts"] = f"""WITH q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[?,]', '', 'g')), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([{STOPPED}], w))) AS w FROM benchmark),
  d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s, lower({PATH_SQL}) AS p FROM documents),
  s AS (SELECT item_id AS question, lang AS repo_url, doc_id AS id, sum(3 * contains(s, w)::INT + 2 * contains(t, w)::INT + contains(p, w)::INT) AS score FROM q, d GROUP BY ALL HAVING score > 0)
  SELECT question, repo_url, id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question, repo_url ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
SQL["streamed_job_states"] = SQL["job_transitions"]
SQL["chat_window"] = "SELECT conv_id AS session_id, turn AS id, role, CAST(rn AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn BETWEEN 2 AND 6"
SQL["intent_routing"] = "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'what|describe|explain') THEN 'context' WHEN regexp_matches(lower(text), 'how many|count|total') THEN 'counts' ELSE 'context' END AS intent FROM conversations WHERE role = 'user'"
SQL["page_braces"] = """SELECT page_id, CAST(coalesce(list_max(list_transform(range(1, length(b) + 1), lambda i: length(replace(b[1:i], '}', '')) - length(replace(b[1:i], '{', '')))), 0) AS INTEGER) AS depth, CAST(len(regexp_extract_all(html, '&&|\\|\\|')) AS INTEGER) AS tokens
  FROM (SELECT page_id, html, regexp_replace(html, '[^{}]', '', 'g') AS b FROM pages)"""
# Figures that follow from how the synthetic sources are made.
SQL["parse_metrics"] = """SELECT CASE p_partkey % 3 WHEN 0 THEN concat('pkg/mod_', p_partkey % 7, '/util_', p_partkey, '.py') WHEN 1 THEN concat('web/view_', p_partkey, '.ts') ELSE concat('java/acme/Item', p_partkey, '.java') END AS path,
  CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'java' END AS language, 1 AS classes, CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END AS imports,
  CAST(1 + p_size % 5 + 1 + CASE p_partkey % 3 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS cyclomatic, 1 AS nesting, 2 AS parameters FROM part"""
SQL["lint_flags"] = "SELECT 'duplicate_logic' AS pattern, 'medium' AS severity, 3 AS n WHERE (SELECT count(*) FROM part) >= 9 UNION ALL SELECT 'missing_docstrings', 'low', (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) + (SELECT count(*) FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 >= 4)"
SQL["duplicate_names"] = "SELECT CASE p_partkey % 3 WHEN 0 THEN 'get_part' WHEN 1 THEN 'load' ELSE 'size' END AS name, count(*) AS many FROM part GROUP BY 1 HAVING count(*) >= 3"
SQL["duplicate_messages"] = """SELECT 'synthetic' AS job_id, name AS symbol, 'medium' AS severity, concat('Function `', name, '` appears ', count(*), ' times.') AS message, 'Keep one definition in a shared module and import it.' AS fix
  FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'get_part' WHEN 1 THEN 'load' ELSE 'size' END AS name FROM part) GROUP BY 2 HAVING count(*) >= 3"""
SQL["graph_nodes"] = """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat('pkg/mod_', p_partkey % 7) WHEN 1 THEN 'web' ELSE 'java/acme' END AS dir FROM part)
  SELECT 'Repository' AS node_type, 1 AS n UNION ALL SELECT 'File', count(*) FROM p UNION ALL SELECT 'Class', count(*) FROM p UNION ALL SELECT 'Function', sum(CASE k % 3 WHEN 2 THEN 1 ELSE 2 END)::BIGINT FROM p
  UNION ALL SELECT 'Module', count(*) FROM (SELECT dir FROM p UNION SELECT split_part(dir, '/', 1) FROM p)"""
SQL["graph_edges"] = """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat('pkg/mod_', p_partkey % 7) WHEN 1 THEN 'web' ELSE 'java/acme' END AS dir FROM part),
  held AS (SELECT (SELECT count(*) FROM (SELECT dir FROM p UNION SELECT split_part(dir, '/', 1) FROM p)) + sum(CASE k % 3 WHEN 2 THEN 3 ELSE 4 END)::BIGINT AS n FROM p),
  used AS (SELECT count(*) AS n FROM p a JOIN p b ON b.k = a.k % 10 WHERE a.k % 3 = 0 AND b.k % 3 = 0 AND a.k <> b.k)
  SELECT 'CONTAINS' AS relationship, n FROM held UNION ALL SELECT 'IMPORTS', n FROM used UNION ALL SELECT 'DEPENDS_ON', n FROM used"""
SQL["lint_health"] = """WITH c AS (SELECT 0 AS high, CASE WHEN count(*) >= 9 THEN 3 ELSE 0 END AS medium, count_if(p_partkey % 3 <> 0) + count_if(p_partkey % 3 = 0 AND p_size % 5 >= 4) AS low FROM part)
  SELECT 'synthetic' AS job_id, high::BIGINT AS high, medium::BIGINT AS medium, low::BIGINT AS low, greatest(0, least(100, 100 - 8 * high - 4 * medium - low))::INTEGER AS score FROM c"""

# -- selectors --------------------------------------------------------------------------------
SQL["node_selectors"] = "SELECT 'Repository: ' || r_name AS display, true AS entry FROM region UNION ALL SELECT 'Module: ' || n_name, true FROM nation UNION ALL SELECT 'File: ' || c_name, false FROM customer"
over_view("dependency_edges", "SELECT job_id, relationship <> 'CONTAINS' AS dependency, count(*) AS n FROM edges GROUP BY 1, 2")
SQL["node_properties"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END::INT AS n, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR END AS lines FROM orders"
ISSUES = "i AS (SELECT o_orderkey, o_orderstatus AS job_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity, o_orderpriority AS category FROM orders)"
SQL["severity_counts"] = f"WITH {ISSUES} SELECT job_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info FROM i GROUP BY 1"
SQL["issue_choices"] = f"WITH {ISSUES} SELECT 'high' AS choice, o_orderkey FROM i WHERE job_id = 'F' AND severity IN ('critical', 'high') UNION ALL SELECT 'low', o_orderkey FROM i WHERE severity = 'low'"
SQL["issue_categories"] = f"WITH {ISSUES} SELECT job_id, string_agg(category, '|' ORDER BY category) AS categories FROM (SELECT DISTINCT job_id, category FROM i) GROUP BY 1"
SQL["issues_shown"] = f"WITH {ISSUES} SELECT o_orderkey, severity FROM i ORDER BY o_orderkey LIMIT 40"
SQL["evidence_shown"] = "SELECT o_orderkey, 'clerk=c,cust=' || o_custkey || ',status=' || o_orderstatus || ',priority=' || o_orderpriority || ',key=' || o_orderkey AS evidence FROM orders"
SQL["label_repeats"] = "SELECT c_custkey AS id, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS same_label FROM customer"
SQL["artifact_counts"] = "SELECT o_custkey::VARCHAR AS job_id, count(*) AS n FROM orders GROUP BY 1"
SQL["checked_tokens"] = "SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name) || '  part', '\\s+'), lambda w: length(w) > 2), '|') AS tokens FROM part"
SQL["report_gate"] = f"""WITH {LOG}, {LAST} SELECT c_custkey::VARCHAR AS job_id, CASE WHEN job_id IS NULL THEN 'missing' WHEN status <> 'completed' THEN 'not completed' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'no graph' ELSE 'ready' END AS verdict
  FROM customer LEFT JOIN last ON job_id = c_custkey::VARCHAR"""
