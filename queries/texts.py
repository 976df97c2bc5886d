"""Text work (SC11-SC18, SC21, JN4, AGG8, SNK12)."""

from pyspark.sql import functions as F

from millrace.functions import dates, paths, text
from millrace.functions.redaction import redacted_by_kind
from millrace.operators.aggregates import assemble
from millrace.operators.joins import classify_by_patterns, classify_by_substring
from millrace.operators.sets import union_positional
from millrace.sinks.writers import csv_format
from queries.registry import query, table


@query(
    """
SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS step,
       regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g') AS pipeline
FROM pages
"""
)
def clean_names(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.clean_step_name(url).alias("step"), text.clean_pipeline_name(url).alias("pipeline")
    )


@query(
    """
SELECT doc_id, source || '_' || doc_id || '_sanitized.tar.json' AS base, '.json' AS extension,
       source || '_' || doc_id || '_sanitized.tar' AS stem, source || '_' || doc_id AS without_mark,
       lang = 'en' AS is_working
FROM documents
"""
)
def path_parts(spark, sf):
    mark = F.when(F.col("lang") == "en", "temp_sanitized_").otherwise("in_")
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_sanitized"))
    path = F.concat(F.lit("/in/"), mark, F.lit("x/"), name, F.lit(".tar.json"))
    return table(spark, sf, "documents").select(
        "doc_id",
        paths.base_name(path).alias("base"),
        paths.extension(path).alias("extension"),
        paths.stem(path).alias("stem"),
        paths.without_suffix(name).alias("without_mark"),
        text.part_at(path, "/", 2).startswith(paths.WORKING_PREFIX).alias("is_working"),
    )


@query(
    """
SELECT p_partkey, CASE WHEN contains(k, 'ring') THEN 'ring' WHEN contains(k, 'plate') THEN 'plate'
                       WHEN contains(k, 'promo') THEN 'promo' WHEN contains(k, 'red') THEN 'red' END AS kind
FROM (SELECT p_partkey, lower(p_name || p_type) AS k FROM part)
"""
)
def classify_substring(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return classify_by_substring(parts, "p_name", "p_type", ["ring", "plate", "promo", "red"]).select("p_partkey", "kind")


@query(
    """
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS pattern FROM benchmark),
p AS (SELECT pattern, row_number() OVER (ORDER BY length(pattern) DESC, pattern) AS priority FROM w)
SELECT doc_id, (SELECT min_by(pattern, priority) FROM p WHERE contains(lower(text), pattern)) AS kind FROM documents
"""
)
def classify_by_pattern_table(spark, sf):
    """The longest word of any benchmark item that occurs in a document: thousands of patterns, looked up in the different words of all documents."""
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{6,}"), F.lit(0)))
    patterns = table(spark, sf, "benchmark").select(words.alias("word")).select(F.lower("word").alias("pattern")).distinct()
    patterns = patterns.select("pattern", F.struct(-F.length("pattern"), "pattern").alias("priority"), F.col("pattern").alias("kind"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return classify_by_patterns(docs, F.col("text"), patterns, "doc_id").select("doc_id", "kind")


WIDGET = "dbutils.widgets.get"


@query(
    f"""
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'mail.send(server={WIDGET}("Email_Server"), PORT = {WIDGET}("Email_Port"), user=' || email_user || ', password=' || email_password || ')'
  WHEN 1 THEN 'smb.connect(host={WIDGET}("SMB_Host"), share={WIDGET}("SMB_Share"), port={WIDGET}("SMB_Port"), user=' || smb_user || ', password=' || smb_password || ')'
  WHEN 2 THEN 'spark.read.option("password", ' || ftp_password || ').option( "user" ,' || ftp_user || '); ftp(Host={WIDGET}("FTP_Host"), port="x")'
  ELSE 'jdbc(password=' || replace(ftp_password, 'ftp', kind) || ', USER = ' || replace(ftp_user, 'ftp', kind) || ', port=1)' END
  || chr(10) || text AS code
FROM (SELECT *, CASE doc_id % 5 WHEN 3 THEN 'jdbc' ELSE 'unknown' END AS kind FROM documents), (SELECT
  'dbutils.secrets.get(scope="enterprise", key="email_user")' AS email_user,
  'dbutils.secrets.get(scope="enterprise", key="email_password")' AS email_password,
  'dbutils.secrets.get(scope="enterprise", key="smb_user")' AS smb_user,
  'dbutils.secrets.get(scope="enterprise", key="smb_password")' AS smb_password,
  'dbutils.secrets.get(scope="enterprise", key="ftp_user")' AS ftp_user,
  'dbutils.secrets.get(scope="enterprise", key="ftp_password")' AS ftp_password)
"""
)
def redact_secrets(spark, sf):
    """A code line with its own values in front of every whole text."""
    number = F.col("doc_id").cast("string")
    email = F.concat(
        F.lit('mail.send(server="mail'), number, F.lit('.example.org", PORT = 5'), number,
        F.lit(', user="u'), number, F.lit('", password="p'), number, F.lit('")'),
    )
    smb = F.concat(
        F.lit("smb.connect(host='h"), number, F.lit("', share=\"s"), number, F.lit("\", port='44"), number,
        F.lit("', user=\"u"), number, F.lit('", password="p'), number, F.lit('")'),
    )
    ftp = F.concat(
        F.lit('spark.read.option("password", "p'), number, F.lit('").option( "user" ,"u'), number,
        F.lit('"); ftp(Host="h'), number, F.lit('", port="x")'),
    )
    other = F.concat(F.lit('jdbc(password="p'), number, F.lit('", USER = "u'), number, F.lit('", port=1)'))
    case = F.col("doc_id") % 5
    kind = F.when(case == 0, "email").when(case == 1, "smb").when(case == 2, "ftp").when(case == 3, "jdbc")
    line = F.when(case == 0, email).when(case == 1, smb).when(case == 2, ftp).otherwise(other)
    code = F.concat(line, F.lit("\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "text").select("doc_id", redacted_by_kind(code, kind).alias("code"))


@query(
    """
SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'intro' || chr(10) || trim(text, ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END AS code
FROM conversations
"""
)
def extract_fence(spark, sf):
    """Replies with a fenced block, with two, without a language tag, and without a fence."""
    body, turn = F.col("text"), F.col("turn") % 4
    fence, tagged = "`" * 3, "`" * 3 + "python"
    reply = (
        F.when(turn == 0, F.concat(F.lit(f"Here it is:\n{tagged}\n"), body, F.lit(f"\n{fence}\nThat is all.")))
        .when(turn == 1, F.concat(F.lit(f"{tagged} "), body, F.lit(f"\n\n{fence} or {tagged}\nother()\n{fence}")))
        .when(turn == 2, F.concat(F.lit(f" intro\n{fence}"), body, F.lit(f"{fence}\n")))
        .otherwise(F.concat(F.lit("\n "), body, F.lit("\n")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", text.fenced_code(reply).alias("code"))


@query(
    """
SELECT doc_id, 1 AS cell_no, text AS cell FROM documents
UNION ALL SELECT doc_id, 2, 'lang = "' || lang || '"' || chr(10) || chr(10) || '    indented()' FROM documents
UNION ALL SELECT doc_id, 3, 'source = "' || source || '"' FROM documents
"""
)
def split_cells(spark, sf):
    """Scripts with whole texts as their first cell, blank cells, and marker lines with blanks around."""
    marker = text.CELL_MARKER
    script = F.concat(
        F.lit("\n \n"), F.col("text"), F.lit(f"\n\n{marker}\n\t\n  {marker}  \n"),
        F.lit('lang = "'), F.col("lang"), F.lit('"\n\n    indented()\n \n'),
        F.lit(f"{marker}\r\n"), F.lit('source = "'), F.col("source"), F.lit(f'"\n{marker}\n\n'),
    )
    cells = F.posexplode(text.cells(script)).alias("cell_no", "cell")
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source").select("doc_id", cells).withColumn("cell_no", F.col("cell_no") + 1)


@query("SELECT doc_id, text || chr(10) || 'lang: ' || lang AS cell FROM documents")
def assemble_cells(spark, sf):
    """Scripts cut into cells and put together again, without their marker lines."""
    script = F.concat("text", F.lit(f"\n\n{text.CELL_MARKER}\n\nlang: "), "lang", F.lit(f"\n{text.CELL_MARKER}\n"))
    cells = table(spark, sf, "documents").select("doc_id", "text", "lang").select(
        "doc_id", F.posexplode(text.cells(script)).alias("cell_no", "cell")
    )
    return assemble(cells, ["doc_id"], "cell_no", "cell")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS page FROM conversations GROUP BY conv_id")
def assemble_turns(spark, sf):
    pages = assemble(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")
    return pages.withColumnRenamed("text", "page")


@query("SELECT doc_id, rtrim(text, chr(10)) AS text FROM documents")
def lines_and_back(spark, sf):
    """Every text cut into lines and put together again."""
    lines = table(spark, sf, "documents").select("doc_id", "text").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "text"))
    return assemble(lines, ["doc_id"], "n", "text")


@query(
    """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
       '''', '&#x27;') AS escaped
FROM pages
"""
)
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_escaped(F.col("html")).alias("escaped"))


@query(
    """
SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
       '''', '&#x27;'), chr(10), '<br>') AS escaped
FROM documents
"""
)
def html_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").select("doc_id", text.html_lines(F.col("text")).alias("escaped"))


@query(
    """
SELECT 'key,label,size' AS line, true AS is_header
UNION ALL
SELECT p_partkey || ',' || '"' || p_name || ', 12"" ' || p_brand || '"' || ',' || CASE WHEN p_size > 25 THEN '' ELSE p_size::VARCHAR END, false
FROM part
""",
    name="csv_format",
)
def csv_format_with_header(spark, sf):
    """Separators and quotes inside fields, nulls, and a header row."""
    label = F.concat("p_name", F.lit(', 12" '), "p_brand")
    size = F.when(F.col("p_size") <= 25, F.col("p_size"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), label.alias("label"), size.alias("size"))
    return csv_format(rows, header=True)


@query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS yyyymm,
       strftime(o_orderdate + to_seconds(o_orderkey % 86400) - INTERVAL 5 HOUR, '%Y-%m-%d %I:%M:%S %p') AS executed_on
FROM orders
"""
)
def date_stamps(spark, sf):
    """Month folder names, and stamps in a fixed zone."""
    at = F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("yyyy-MM-dd"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.month_stamp(F.col("o_orderdate")).alias("yyyymm"),
        dates.message_stamp((at + seconds).cast("timestamp")).alias("executed_on"),
    )


@query("SELECT c_custkey || ',' || c_name || ',' || c_mktsegment AS line FROM customer UNION ALL SELECT s_suppkey || ',' || s_name || ',' FROM supplier")
def csv_format_rows(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string"))
    return csv_format(union_positional(customers, suppliers))
