"""Pipeline exports as data (CAT1-CAT9, JN5, RTE4, AGG7, SRC12, PRJ11).

Each row of `part` renders one export document, so the catalog grows with the table: even keys in
the map layout (three steps, three links, two parameters), odd keys in the list layout (two steps).
"""

from pyspark.sql import functions as F

from millrace.catalog import exports, strip
from millrace.operators.aggregates import top_level_key_profile
from millrace.operators.graph import step_depth
from millrace.operators.routing import with_export_flag
from millrace.operators.sets import union
from millrace.plans.intake import catalog as build_catalog
from millrace.plans.intake import quarantine_names, steps_in_order
from millrace.session import cut_lineage, new_shared_dir
from millrace.sources.exports import read_pipeline_exports
from queries.registry import query, table

MAP_LAYOUT = """
{"class_fqid":"com-example-pipeline_9","instance_id":"P{k}","instance_version":1,
"link_map":{
"l3":{"src_view_id":"output1","dst_view_id":"input0","src_id":"a{k}","dst_id":"c{k}","isGoto":false},
"l1":{"src_view_id":"output0","dst_view_id":"input0","src_id":"a{k}","dst_id":"b{k}","isGoto":false},
"l2":{"src_view_id":"output0","dst_view_id":"input0","src_id":"b{k}","dst_id":"c{k}","isGoto":true}},
"link_serial":104,
"property_map":{"info":{"label":{"value":"{name} & co"}},"settings":{"param_table":{"value":[
{"capture":{"value":false},"key":{"value":"Brand"},"value":{"value":"{brand}"},"required":{"value":true},"data_type":{"value":"string"},"description":{"value":null}},
{"capture":{"value":false},"key":{"value":"Size"},"value":{"value":"{size}"},"required":{"value":false},"data_type":{"value":"string"},"description":{"value":"size"}}]}}},
"render_map":{"detail_map":{"a{k}":{"grid_x_int":1}}},
"snap_map":{
"c{k}":{"class_id":"com-example-mapper","instance_id":"c{k}","property_map":{"info":{"label":{"value":" To {type}"}},"settings":{"passThrough":{"value":false},"table":{"value":[{"x":1,"to":{"value":"$n"}}]}}}},
"a{k}":{"class_id":"com-example-simpleread","instance_id":"a{k}","view":{"x":5},"property_map":{"info":{"notes":{},"label":{"value":"File Reader"}},"settings":{"filePath":{"expression":true,"value":"_dir + '{name}'"},"retries":{"expression":false,"value":{size}}}}},
"b{k}":{"class_id":"com-example-csvparser","instance_id":"b{k}","property_map":{"view_serial":100,"settings":{"delimiter":{"expression":false,"value":"^"},"color":{"value":"red"}}}}}}
""".replace("\n", "")

LIST_LAYOUT = """
{"info":{"title":"{brand}"},"job_stats":{"n":{size}},"snaps":[
{"name":"Read {type}","class_id":"com-example-simpleread","instance_id":"r{k}","settings":{"retries":{"value":{size}}},"view":{"y":1}},
{"name":"Unknown","instance_id":"w{k}","property_map":{"settings":{"x":{"value":2}}}}]}
""".replace("\n", "")


def _filled(template):
    out = F.lit(template) if isinstance(template, str) else template
    fields = {"k": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}
    for mark, column in fields.items():
        out = F.replace(out, F.lit("{" + mark + "}"), F.col(column).cast("string"))
    return out


def _parts(spark, sf):
    """Rows of `part`, dealt out before they grow: a document has some forty times the bytes of its row. They are written,
    since Spark takes a filter on the documents, and with it their rendering, to the few tasks below a mere repartition."""
    return cut_lineage(table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "parts")


def export_files(spark, sf):
    """`path, text` of the rendered exports."""
    body = F.when(F.col("p_partkey") % 2 == 0, _filled(MAP_LAYOUT)).otherwise(_filled(LIST_LAYOUT))
    path = F.concat(F.lit("in/part_"), F.col("p_partkey").cast("string"), F.lit("_sanitized.json"))
    return _parts(spark, sf).select(path.alias("path"), body.alias("text"))


def docs_of(spark, sf, fields):
    return exports.parse_exports(export_files(spark, sf), fields=fields)


STEPS_SQL = """
SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, p_partkey, p_size, p_type, p_name, p_brand, s.*
FROM part, (VALUES (0, 0, 'c'), (0, 1, 'a'), (0, 2, 'b'), (1, 0, 'r'), (1, 1, 'w')) AS s(odd, position, mark)
WHERE p_partkey % 2 = odd
"""

NAMES_SQL = f"""
SELECT path, position, mark || p_partkey AS step_id,
       CASE mark WHEN 'c' THEN ' To ' || p_type WHEN 'a' THEN 'File Reader' WHEN 'b' THEN 'b' || p_partkey
                 WHEN 'r' THEN 'Read ' || p_type ELSE 'w' || p_partkey END AS name,
       CASE mark WHEN 'c' THEN 'com-example-mapper' WHEN 'a' THEN 'com-example-simpleread'
                 WHEN 'b' THEN 'com-example-csvparser' WHEN 'r' THEN 'com-example-simpleread' ELSE '' END AS class_id
FROM ({STEPS_SQL})
"""

LINKS_SQL = """
SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, l.link_id, l.s || p_partkey AS src_id, l.sv AS src_view_id,
       l.d || p_partkey AS dst_id, 'input0' AS dst_view_id, l.link_id = 'l2' AS is_goto
FROM part, (VALUES ('l1', 'a', 'output0', 'b'), ('l2', 'b', 'output0', 'c'), ('l3', 'a', 'output1', 'c')) AS l(link_id, s, sv, d)
WHERE p_partkey % 2 = 0
"""


SETTINGS_SQL = """CASE mark
  WHEN 'c' THEN '{"passThrough":{"value":false},"table":{"value":[{"to":{"value":"$n"},"x":1}]}}'
  WHEN 'a' THEN '{"filePath":{"expression":true,"value":"_dir + ' || chr(39) || p_name || chr(39) || '"},"retries":{"expression":false,"value":' || p_size || '}}'
  WHEN 'b' THEN '{"color":{"value":"red"},"delimiter":{"expression":false,"value":"^"}}'
  WHEN 'r' THEN '{"retries":{"value":' || p_size || '}}' ELSE '{"x":{"value":2}}' END"""


@query(NAMES_SQL.replace(" AS class_id\n", f" AS class_id, {SETTINGS_SQL} AS settings\n"))
def catalog_steps(spark, sf):
    """Minimised steps; settings as JSON with their keys in order."""
    steps = exports.minimised_steps(docs_of(spark, sf, exports.STEP_FIELDS))
    return steps.withColumn("settings", F.to_json("settings"))


@query(
    """
SELECT p_partkey AS path, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'id' || p_partkey
       WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Snap' END AS name
FROM part
"""
)
def catalog_step_names(spark, sf):
    """Own name; label; instance id; a label that is no object; nothing at all; a null label."""
    step = (
        F.when(F.col("p_size") % 6 == 0, F.lit('{"name":"{name}","property_map":{"info":{"label":{"value":"no"}}}}'))
        .when(F.col("p_size") % 6 == 1, F.lit('{"name":"Unknown","property_map":{"info":{"label":{"value":"{brand}"}}}}'))
        .when(F.col("p_size") % 6 == 2, F.lit('{"instance_id":"id{k}","property_map":{"info":{"label":{}}}}'))
        .when(F.col("p_size") % 6 == 3, F.lit('{"instance_id":"id{k}","property_map":{"info":{"label":"text"}}}'))
        .when(F.col("p_size") % 6 == 4, F.lit('{"property_map":{}}'))
        .otherwise(F.lit('{"instance_id":"id{k}","property_map":{"info":{"label":{"value":null}}}}'))
    )
    text = _filled(F.concat(F.lit('{"snaps":['), step, F.lit("]}")))
    files = _parts(spark, sf).select(F.col("p_partkey").alias("path"), text.alias("text"))
    docs = exports.parse_exports(files, fields=exports.STEP_FIELDS)
    return exports.minimised_steps(docs).select("path", "name")


@query(LINKS_SQL)
def catalog_links(spark, sf):
    return exports.links(docs_of(spark, sf, exports.LINK_FIELDS))


@query(
    """
SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, v.position, v.name,
       CASE v.name WHEN 'Brand' THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS value, 'string' AS data_type,
       CASE v.name WHEN 'Size' THEN 'size' END AS description, v.name = 'Brand' AS required, false AS capture
FROM part, (VALUES (0, 'Brand'), (1, 'Size')) AS v(position, name) WHERE p_partkey % 2 = 0
"""
)
def catalog_params(spark, sf):
    return exports.parameters(docs_of(spark, sf, exports.PARAMETER_FIELDS))


@query(
    f"""
SELECT path, position, mark || p_partkey AS step_id, v.setting, v.is_expression,
       CASE v.setting WHEN 'filePath' THEN '_dir + ''' || p_name || '''' WHEN 'retries' THEN CAST(p_size AS VARCHAR) ELSE v.value END AS value
FROM ({STEPS_SQL}) s JOIN (VALUES ('c', 'passThrough', false, 'false'),
  ('c', 'table', false, '[{{"to":{{"value":"$n"}},"x":1}}]'), ('a', 'filePath', true, NULL), ('a', 'retries', false, NULL),
  ('b', 'delimiter', false, '^'), ('b', 'color', false, 'red'), ('r', 'retries', false, NULL), ('w', 'x', false, '2'))
  AS v(step, setting, is_expression, value) ON s.mark = v.step
"""
)
def catalog_settings(spark, sf):
    return exports.settings_long(exports.minimised_steps(docs_of(spark, sf, exports.STEP_FIELDS)))


@query(
    f"""
SELECT path, position, mark || p_partkey AS step_id, v.place,
       CASE v.place WHEN 'filePath.value' THEN '_dir + ''' || p_name || '''' WHEN 'retries.value' THEN CAST(p_size AS VARCHAR) ELSE v.value END AS value
FROM ({STEPS_SQL}) s JOIN (VALUES ('c', 'passThrough.value', 'false'), ('c', 'table.value[0].to.value', '$n'),
  ('a', 'filePath.expression', 'true'), ('a', 'filePath.value', NULL), ('a', 'retries.expression', 'false'),
  ('a', 'retries.value', NULL), ('b', 'delimiter.expression', 'false'), ('b', 'delimiter.value', '^'),
  ('r', 'retries.value', NULL)) AS v(step, place, value) ON s.mark = v.step
"""
)
def catalog_inner_values(spark, sf):
    """Innermost settings without canvas keys; a step of which nothing is left has no row."""
    return strip.layout_free_values(exports.minimised_steps(docs_of(spark, sf, exports.STEP_FIELDS)))


@query("SELECT 'p' || p_partkey AS path, repeat('a.', 20) || 'value' AS place, p_name AS value FROM part")
def catalog_deep_values(spark, sf):
    """Settings nested twenty deep."""
    value = F.concat(F.lit('{"a":' * 20 + '{"value":"'), F.col("p_name"), F.lit('"}' + "}" * 20))
    text = F.concat(F.lit('{"snaps":[{"name":"s","settings":'), value, F.lit("}]}"))
    files = _parts(spark, sf).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), text.alias("text"))
    steps = exports.minimised_steps(exports.parse_exports(files, fields=exports.STEP_FIELDS))
    return strip.layout_free_values(steps).select("path", "place", "value")


@query(
    """
SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path,
       CASE p_partkey % 2 WHEN 0 THEN replace(p_name, ' ', '_') || '_co' ELSE replace(p_brand, '#', '_') END AS pipeline
FROM part
"""
)
def catalog_pipeline_names(spark, sf):
    return exports.pipeline_name(docs_of(spark, sf, exports.NAME_FIELDS))


@query("SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, 'part_' || p_partkey AS pipeline FROM part")
def catalog_names_from_files(spark, sf):
    """Exports whose label or title is empty are named by their file."""
    empty = F.regexp_replace(F.regexp_replace("text", '"value":"[^"]* & co"', '"value":""'), '"title":"[^"]*"', '"title":""')
    return exports.pipeline_name(exports.parse_exports(export_files(spark, sf).withColumn("text", empty)))


@query(
    """
SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, CASE p_partkey % 2 WHEN 0 THEN 'map' ELSE 'list' END AS layout,
       CASE p_partkey % 2 WHEN 0 THEN 3 ELSE 2 END::BIGINT AS n_steps,
       CASE p_partkey % 2 WHEN 0 THEN 'class_id,instance_id,property_map' ELSE 'name,class_id,instance_id,settings,view' END AS first_step_keys,
       CASE p_partkey % 2 WHEN 0 THEN 'info,settings' END AS property_keys
FROM part
"""
)
def catalog_layout(spark, sf):
    return exports.step_layout(export_files(spark, sf))


def _strip_sql() -> str:
    def sql_text(template):
        return "'" + template.replace("'", "''") + "'"

    slim_map = (
        MAP_LAYOUT.replace('"render_map":{"detail_map":{"a{k}":{"grid_x_int":1}}},', "")
        .replace('"view":{"x":5},', "")
        .replace('{"x":1,"to"', '{"to"')
        .replace(',"color":{"value":"red"}', "")
    )
    slim_list = LIST_LAYOUT.replace('"job_stats":{"n":{size}},', "").replace(',"view":{"y":1}', "")
    text = f"CASE p_partkey % 2 WHEN 0 THEN {sql_text(slim_map)} ELSE {sql_text(slim_list)} END"
    fields = {"k": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}
    for mark, column in fields.items():
        text = f"replace({text}, '{{{mark}}}', CAST({column} AS VARCHAR))"
    return f"SELECT 'in/part_' || p_partkey || '_sanitized.json' AS path, {text} AS text FROM part"


@query(_strip_sql())
def catalog_strip(spark, sf):
    return strip.strip_layout(export_files(spark, sf))


@query(
    f"""
WITH n AS ({NAMES_SQL}), l AS ({LINKS_SQL})
SELECT l.*, a.name AS src_name, a.class_id AS src_class, b.name AS dst_name, b.class_id AS dst_class
FROM l LEFT JOIN n a ON a.path = l.path AND a.step_id = l.src_id LEFT JOIN n b ON b.path = l.path AND b.step_id = l.dst_id
"""
)
def catalog_edges(spark, sf):
    links = exports.links(docs_of(spark, sf, exports.LINK_FIELDS))
    return exports.edges_with_steps(links, exports.minimised_steps(docs_of(spark, sf, exports.STEP_FIELDS)))


@query(
    f"""
SELECT n.*, CASE WHEN step_id[1] = 'a' THEN 0 WHEN step_id[1] = 'b' THEN 1 WHEN step_id[1] = 'c' THEN 2 ELSE 0 END AS depth,
       CASE class_id WHEN 'com-example-simpleread' THEN 'simpleread' WHEN 'com-example-csvparser' THEN 'csvparser'
                     WHEN 'com-example-mapper' THEN 'mapper' END AS kind
FROM ({NAMES_SQL.replace(" AS class_id", f" AS class_id, {SETTINGS_SQL} AS settings")}) n
"""
)
def catalog_steps_in_order(spark, sf):
    """Steps with their kind and their level along the links."""
    return steps_in_order(build_catalog(export_files(spark, sf))).withColumn("settings", F.to_json("settings"))


@query(
    """
WITH RECURSIVE edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION SELECT 'n' || c_nationkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
levels AS (
  SELECT DISTINCT src AS node, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges)
  UNION
  SELECT e.dst, l.level + 1 FROM levels l JOIN edges e ON e.src = l.node)
SELECT node AS step_id, 'all' AS pipeline, max(level) AS depth FROM levels GROUP BY node
"""
)
def catalog_depth(spark, sf):
    """One graph from the tables: regions, nations, customers, orders, with short cuts from nation to order."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")

    def edge(df, a, source, b, target):
        return df.select(
            F.lit("all").alias("pipeline"),
            F.concat(F.lit(a), F.col(source).cast("string")).alias("src_id"),
            F.concat(F.lit(b), F.col(target).cast("string")).alias("dst_id"),
        )

    links = union(
        edge(table(spark, sf, "nation"), "r", "n_regionkey", "n", "n_nationkey"),
        edge(customer, "n", "c_nationkey", "c", "c_custkey"),
        edge(orders, "c", "o_custkey", "o", "o_orderkey"),
        edge(orders.join(customer, orders.o_custkey == customer.c_custkey), "n", "c_nationkey", "o", "o_orderkey"),
    )
    return step_depth(links)


def mixed_files(spark, sf):
    """Exports, and texts that are none: objects, lists, scalars, cut and overlong texts, prose."""
    good = _filled(MAP_LAYOUT)
    case = F.col("p_size") % 9
    text = (
        F.when(case == 0, _filled('{"name":"{name}","steps":{size}}'))
        .when(case == 1, _filled('[{"snaps":[]}, {size}]'))
        .when(case == 2, F.col("p_size").cast("string"))
        .when(case == 3, F.left(good, F.length(good) - 1))
        .when(case == 4, F.concat(good, F.lit(" x")))
        .when(case == 5, F.concat(F.lit(" \n"), _filled('{"snaps":[],"snaps":[{"name":"{name}"}]}'), F.lit("\n")))
        .when(case == 6, F.lit(None).cast("string"))
        .when(case == 7, _filled("{'snaps':'{name}'}"))
        .otherwise(good)
    )
    parts = _parts(spark, sf).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), text.alias("text"))
    docs = table(spark, sf, "documents").select("doc_id", "text").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return parts.unionByName(docs)


@query(
    """
SELECT 'p' || p_partkey AS path, CASE WHEN p_size % 9 IN (5, 8) THEN 'valid' ELSE 'junk' END AS verdict FROM part
UNION ALL SELECT 'd' || doc_id, 'junk' FROM documents
"""
)
def intake_triage(spark, sf):
    verdict = F.when(F.col("is_export"), "valid").otherwise("junk")
    return with_export_flag(mixed_files(spark, sf)).select("path", verdict.alias("verdict"))


@query(
    """
SELECT 'q/f' || p_size || '.json' AS path, p_partkey,
       CASE WHEN n = 0 THEN 'f' || p_size || '.json' ELSE 'f' || p_size || '_' || n || '.json' END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part)
"""
)
def quarantined_names(spark, sf):
    """Junk files of equal names, in order of arrival."""
    path = F.concat(F.lit("q/f"), F.col("p_size").cast("string"), F.lit(".json"))
    junk = table(spark, sf, "part").select(path.alias("path"), "p_partkey")
    return quarantine_names(junk, ["p_partkey"]).select("path", "p_partkey", "unique_name")


@query(
    """
SELECT key, count(*) AS n_files
FROM (SELECT p_partkey, unnest(CASE p_partkey % 2
        WHEN 0 THEN ['class_fqid', 'instance_id', 'instance_version', 'link_map', 'link_serial', 'property_map', 'render_map', 'snap_map']
        ELSE ['info', 'job_stats', 'snaps'] END) AS key FROM part)
GROUP BY key
"""
)
def key_profile(spark, sf):
    return top_level_key_profile(export_files(spark, sf))


@query(
    """
SELECT p_partkey % 2 AS odd, count(*) AS files FROM part GROUP BY 1
"""
)
def read_export_files(spark, sf):
    """Exports written as files and read whole."""
    folder = new_shared_dir(spark, "exports")
    lines = export_files(spark, sf).select("text")
    lines.write.option("maxRecordsPerFile", 10_000).text(folder)
    # Each file holds many documents, one per line; cut them apart again after the whole-file scan.
    docs = read_pipeline_exports(spark, folder).select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    parsed = exports.parse_exports(docs.select(F.lit("x").alias("path"), "text"))
    odd = F.when(F.col("doc.snap_map").isNull(), 1).otherwise(0).cast("bigint").alias("odd")
    return parsed.groupBy(odd).agg(F.count(F.lit(1)).alias("files"))
