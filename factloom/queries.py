"""The registered queries over the business and text tables, each with its DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dynamic
from .functions import text as tx
from .operators import derive, edits, graph, intervals, metrics, relations, similarity, substrings, trees
from .plans import incremental, packs, report, rules
from .sources import files, layout
from .sources.scratch import scratch_path, written
from .streaming import windows

#: Rule files that come with the library.
PACKS = Path(__file__).parent / "packs"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rules, severities and reports over documents -------------------------------------------------

TEXT_RULES = rules.Registry()
MOST_LINES = 8
LONG_HEX = r"[0-9a-f]{40}"


def document_facts(docs: DataFrame) -> DataFrame:
    """What the rules ask of a document, without its text: one scan of the texts serves all rules."""
    return docs.select(
        "doc_id", F.size(F.split("text", "\n", -1)).alias("lines"), F.col("text").rlike(LONG_HEX).alias("long_hex"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))


@TEXT_RULES.rule("max-lines", "quality", "A document has more lines than allowed")
def max_lines(facts: rules.Facts, options: dict) -> DataFrame:
    hit = facts["documents"].where(F.col("lines") > options.get("most", MOST_LINES))
    return hit.select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.concat(F.col("lines").cast("string"), F.lit(" lines — split it")).alias("message"))


@TEXT_RULES.rule("secret-format", "security", "A document has a key in a known format", sub_checks=2)
def secret_format(facts: rules.Facts, options: dict) -> DataFrame:
    hit = facts["documents"].where("long_hex")
    return hit.select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("40 hex digits — remove them").alias("message"))


@TEXT_RULES.rule("duplicate-text", "architecture", "Several documents have the same text")
def duplicate_text(facts: rules.Facts, options: dict) -> DataFrame:
    docs = facts["documents"].select("doc_id", "h")
    groups = relations.duplicates(docs, ["h"], "doc_id")
    return docs.join(groups, "h").where("doc_id <> first").select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.concat(F.lit("same text as "), F.col("first").cast("string"), F.lit(" — drop it")).alias("message"))


def _config(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    overrides = spark.createDataFrame([(0, "max-lines", "warning", None), (1, "duplicate-text", "off", ["99"])], "ord int, rule string, severity string, files array<string>")
    groups = spark.createDataFrame([(0, "all", "warning", ["max-lines", "duplicate-text"]), (1, "strict", "error", ["secret-format"]), (2, "all", "error", [])], "ord int, id string, severity string, rules array<string>")
    return overrides, groups


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides, groups = _config(spark)
    found = TEXT_RULES.diagnostics({"documents": written(document_facts(table(spark, sf_dir, "documents")), "document-facts")})
    active = rules.severities(TEXT_RULES.table(spark), overrides, groups)
    return rules.without_disabled(found, overrides).join(F.broadcast(active), "rule")  # one row a rule


FOUND = """
WITH h AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS first FROM h GROUP BY t HAVING count(*) > 1),
rules AS (SELECT * FROM (VALUES ('max-lines', 'quality', 1), ('secret-format', 'security', 2), ('duplicate-text', 'architecture', 1)) v(rule, category, sub_checks)),
found AS (
  SELECT 'max-lines' AS rule, 'warning' AS severity, CAST(doc_id AS VARCHAR) AS file, CAST(len(string_split(text, chr(10))) AS VARCHAR) || ' lines — split it' AS message FROM documents WHERE len(string_split(text, chr(10))) > 8
  UNION ALL SELECT 'secret-format', 'error', CAST(doc_id AS VARCHAR), '40 hex digits — remove them' FROM documents WHERE regexp_matches(text, '[0-9a-f]{40}')
  UNION ALL SELECT 'duplicate-text', 'error', CAST(doc_id AS VARCHAR), 'same text as ' || CAST(first AS VARCHAR) || ' — drop it' FROM h JOIN g ON h.t = g.t WHERE doc_id <> first AND NOT contains(CAST(doc_id AS VARCHAR), '99'))
"""


@query(FOUND + "SELECT rule, count(*) AS n, NOT bool_or(severity = 'error') AS warning_only FROM found GROUP BY rule")
def findings_by_rule(spark, sf_dir):
    return report.by_rule(diagnostics(spark, sf_dir))


@query(FOUND + "SELECT file, count(*) AS n, count(*) FILTER (severity = 'error') AS errors, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM found GROUP BY file")
def findings_by_file(spark, sf_dir):
    return report.by_file(diagnostics(spark, sf_dir)).withColumn("rules", F.array_join("rules", ","))


@query(FOUND + """SELECT category, (SELECT count(*) FROM documents) - count(DISTINCT file) FILTER (severity = 'error') AS clean,
round(100.0 * ((SELECT count(*) FROM documents) - count(DISTINCT file) FILTER (severity = 'error')) / (SELECT count(*) FROM documents), 1) AS pct
FROM rules LEFT JOIN found USING (rule) GROUP BY category""")
def category_scores(spark, sf_dir):
    return report.category_scores(diagnostics(spark, sf_dir), TEXT_RULES.table(spark), table(spark, sf_dir, "documents"))


@query(FOUND + """SELECT (SELECT count(*) FROM documents) - count(DISTINCT file) AS clean, round(100.0 * ((SELECT count(*) FROM documents) - count(DISTINCT file)) / (SELECT count(*) FROM documents), 1) AS pct
FROM found WHERE severity = 'error'""")
def clean_score(spark, sf_dir):
    return report.clean_score(diagnostics(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(FOUND + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, 4 AS sub_checks FROM found")
def result_totals(spark, sf_dir):
    return report.totals(diagnostics(spark, sf_dir), TEXT_RULES.table(spark))


COUNTED = "count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings"


@query(FOUND + f""", c AS (SELECT found.*, category FROM found JOIN rules USING (rule))
SELECT 'rule' AS level, rule AS key, {COUNTED} FROM c GROUP BY rule UNION ALL SELECT 'file', file, {COUNTED} FROM c GROUP BY file
UNION ALL SELECT 'category', category, {COUNTED} FROM c GROUP BY category UNION ALL SELECT 'all', NULL, {COUNTED} FROM c""")
def report_counts(spark, sf_dir):
    found, _ = report.evaluated(diagnostics(spark, sf_dir))
    return report.all_counts(found.join(F.broadcast(TEXT_RULES.table(spark).select("rule", "category")), "rule"))  # one row a rule


@query(FOUND + "SELECT count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found")
def observed_totals(spark, sf_dir):
    """The report's totals, counted while its findings were written."""
    _, counts = report.evaluated(diagnostics(spark, sf_dir))
    return spark.createDataFrame([tuple(counts[c] for c in ("findings", "errors", "warnings"))], "findings long, errors long, warnings long")


@query(FOUND + "SELECT file || ':1:1 ' || severity || ' ' || rule || ' ' || message AS value FROM found")
def report_lines(spark, sf_dir):
    return report.as_lines(diagnostics(spark, sf_dir))


@query(FOUND + """, k AS (SELECT trim(split_part(message, '—', 1)) AS issue_key FROM found)
SELECT issue_key, count(*) AS n, CAST(grouping(issue_key) AS INTEGER) AS is_all FROM k GROUP BY ROLLUP (issue_key)""")
def fix_all_rollup(spark, sf_dir):
    return report.issue_groups(diagnostics(spark, sf_dir), "message")


@query(FOUND + """, s AS (SELECT * FROM (VALUES ('error'), ('warning'), ('info'), ('off')) v(severity))
SELECT s.severity, count(found.rule) AS n FROM s LEFT JOIN found USING (severity) GROUP BY s.severity""")
def severity_histogram(spark, sf_dir):
    return report.histogram(diagnostics(spark, sf_dir), "severity", ["error", "warning", "info", "off"])


@query(FOUND + "SELECT rule, file, rank FROM (SELECT rule, file, row_number() OVER (PARTITION BY rule ORDER BY file) AS rank FROM found) WHERE rank <= 8")
def top8_per_rule(spark, sf_dir):
    return report.top_per_group(diagnostics(spark, sf_dir).select("rule", "file"), ["rule"], ["file"], 8)


@query(FOUND + ", t AS (SELECT rule, count(*) AS total FROM found GROUP BY rule) SELECT rule, total, round(100.0 * total / sum(total) OVER (), 1) AS pct FROM t")
def category_share(spark, sf_dir):
    return report.shares(diagnostics(spark, sf_dir).withColumn("one", F.lit(1)), "rule", "one")


# --- filters and text -------------------------------------------------------------------------------


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents WHERE len(string_split(text, chr(10))) > 8")
def max_lines_docs(spark, sf_dir):
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).where(F.col("lines") > MOST_LINES)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ')")
def restricted_names(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike("^(red|blue) ")).select("p_partkey", "p_name")


@query("SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, count(*) AS n FROM pages WHERE regexp_matches(url, '^[A-Za-z]+://') GROUP BY scheme")
def link_schemes(spark, sf_dir):
    pattern = "^([A-Za-z]+)://"
    hit = table(spark, sf_dir, "pages").where(F.col("url").rlike(pattern))
    return hit.select(F.lower(F.regexp_extract("url", pattern, 1)).alias("scheme")).groupBy("scheme").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, regexp_extract(text, '[>"''}]') AS entity FROM documents WHERE regexp_matches(text, '[>"''}]')""")
def unescaped_entities(spark, sf_dir):
    pattern = """[>"'}]"""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 0).alias("entity"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.html_escape(F.col("html")).cast("binary"), 256).alias("escaped"))


@query("""SELECT page_id, array_to_string(list_slice(p, greatest(len(p) - 2, 1), len(p)), '/') AS route FROM (
  SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?:/', ''), '[^/]*$', ''), '/'), lambda x: x <> '') AS p FROM pages)""")
def page_routes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", report.route(F.regexp_replace("url", "^https?:/", "")).alias("route"))


@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_name, CAST(0 AS BIGINT) AS h, 1 AS i FROM part
UNION ALL SELECT p_partkey, p_name, ((h * 31 + ascii(substr(p_name, i, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, i + 1 FROM c WHERE i <= length(p_name)),
d AS (SELECT p_partkey, h, abs(h) AS a FROM c WHERE i = length(p_name) + 1),
e AS (SELECT p_partkey, h, a // 36 AS a, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(a % 36 AS INTEGER) + 1, 1) AS s FROM d
UNION ALL SELECT p_partkey, h, a // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(a % 36 AS INTEGER) + 1, 1) || s FROM e WHERE a > 0)
SELECT p_partkey, CASE WHEN h < 0 THEN '-' ELSE '' END || s AS body_hash FROM e WHERE a = 0""")
def body_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.text_hash(F.col("p_name")).alias("body_hash"))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(props, '"[^"]*"|''[^'']*''|[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\\.[0-9]+)?')) AS t FROM events)
SELECT CASE WHEN left(t, 1) IN (chr(34), chr(39)) THEN '$STR' WHEN regexp_matches(t, '^[0-9]') THEN '$NUM' WHEN t IN ('true', 'false') THEN '$BOOL'
  WHEN t IN ('null', 'undefined') THEN '$NULL' ELSE '$ID' END AS token, count(*) AS n FROM t GROUP BY ALL""")
def token_kinds(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(F.explode(tx.normalised_tokens(F.col("props"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unused_parts(spark, sf_dir):
    parts, lines = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relations.uncovered(parts, lines, ["p_partkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_with_urgent_orders(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.covered(table(spark, sf_dir, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query("SELECT c_custkey, n AS uses FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) WHERE n < 2")
def rarely_called(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relations.use_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey").where("uses < 2")


@query("SELECT DISTINCT user_id FROM events e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.value > 90 AND p.user_id = e.user_id)")
def setups_without_cleanup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return relations.uncovered(events.where("event_type = 'signup'").select("user_id").distinct(), events.where("event_type = 'purchase' AND value > 90"), ["user_id"])


@query("SELECT sha256(coalesce(text, '')) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY h HAVING count(*) > 1")
def duplicate_text_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return relations.duplicates(docs, ["h"], "doc_id")


@query("SELECT p.p_partkey, p.p_brand, p.p_type, m.match FROM part p JOIN (SELECT p_brand, p_type, min(p_partkey) AS match FROM part WHERE p_size > 40 GROUP BY ALL) m ON p.p_brand = m.p_brand AND p.p_type = m.p_type WHERE p.p_size < 5")
def duplicated_constants(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return relations.first_match(part.where("p_size < 5").select("p_partkey", "p_brand", "p_type"), part.where("p_size > 40"), ["p_brand", "p_type"], "p_partkey")


@query("""WITH e AS (SELECT l_suppkey AS file, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), u AS (SELECT DISTINCT l_partkey AS symbol, l_suppkey AS use_file FROM lineitem WHERE l_returnflag <> 'N'),
d AS (SELECT s_suppkey AS file, CAST(s_nationkey AS BIGINT) AS use_file FROM supplier WHERE s_acctbal < 0)
SELECT file AS def_file, symbol AS name, use_file FROM e JOIN u USING (symbol) WHERE file <> use_file UNION SELECT file, symbol, use_file FROM e JOIN d USING (file)""")
def reference_index(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    exports = lines.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), F.col("l_partkey").alias("name")).distinct()
    uses = lines.where("l_returnflag <> 'N'").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("use_file")).distinct()
    dynamic = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").cast("long").alias("use_file"))
    return relations.references(exports, uses, dynamic)


# --- siblings ---------------------------------------------------------------------------------------


@query("SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE event_type = n")
def dead_writes(spark, sf_dir):
    return relations.repeated_next(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT user_id, event_id, ts, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM events) WHERE a = 1) WHERE k = 1""")
def first_unreachable(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return relations.first_after(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("""SELECT user_id, min(event_id) AS start, count(*) AS length FROM (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
WHERE event_type IN ('view', 'click') GROUP BY user_id, g HAVING count(*) >= 2""")
def await_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return relations.runs(events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click")).drop("island")


@query("SELECT doc_id, source, k AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def later_duplicates(spark, sf_dir):
    return relations.later_duplicates(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("doc_id", "source", "rank")


# --- what changed, and streams --------------------------------------------------------------------------


@query("""SELECT doc_id, rule, message, coalesce(lang <> 'fr' AND (lang <> 'es' OR text IS NOT DISTINCT FROM upper(text)), FALSE) AS reused FROM (
  SELECT doc_id, lang, text, 'max-lines' AS rule, CAST(len(string_split(text, chr(10))) AS VARCHAR) || ' lines — split it' AS message FROM documents WHERE len(string_split(text, chr(10))) > 8
  UNION ALL SELECT doc_id, lang, text, 'secret-format', '40 hex digits — remove them' FROM documents WHERE regexp_matches(text, '[0-9a-f]{40}'))""")
def rechecked_documents(spark, sf_dir):
    """Findings in all documents, after a first run over a state without the French ones and with the Spanish in capitals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    store = incremental.ResultStore(spark, scratch_path(spark, "rechecked"), "doc_id", "bigint", "rule string, message string")

    def check(rows: DataFrame) -> DataFrame:
        found = TEXT_RULES.only(("max-lines", "secret-format")).diagnostics({"documents": document_facts(rows)})
        return found.select(F.col("file").cast("long").alias("doc_id"), "rule", "message")

    store.update(docs.where("lang <> 'fr'").withColumn("text", F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))), ["text"], check)
    first = [r["part"] for r in store.manifest().select("part").distinct().collect()]
    store.update(docs, ["text"], check)
    return store.results().select("doc_id", "rule", "message", F.col("part").isin(first).alias("reused"))


def _slices(spark, sf_dir, n=4):
    """The events in ``n`` stretches of time, one after the other."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    low, high = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    of = F.least(F.floor((F.unix_micros("ts") - F.lit(low or 0)) * n / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(n - 1))
    return [events.where(of == i) for i in range(n)]


CLOSED = "SELECT (epoch_us(max(ts)) // 1000 - 86400000) * 1000 AS mark FROM events"


@query(f"""WITH w AS (SELECT epoch_us(ts) // 21600000000 * 21600 AS window_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL)
SELECT window_start, event_type, n, most FROM w WHERE (window_start + 21600) * 1000000 <= ({CLOSED})""")
def streamed_windows(spark, sf_dir):
    build = lambda events: windows.tumbling(events, "ts", "6 hours", "1 day", ["event_type"], [F.count("*").alias("n"), F.max("value").alias("most")])
    given = windows.replayed(spark, _slices(spark, sf_dir), build, scratch_path(spark, "streamed"))
    return given.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", "most")


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
SELECT user_id, min(t) AS session_start, max(t) + 21600000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(t) + 21600000000 <= ({CLOSED})""")
def streamed_sessions(spark, sf_dir):
    build = lambda events: windows.sessions(events, "ts", "6 hours", "1 day", ["user_id"], [F.count("*").alias("n")])
    given = windows.replayed(spark, _slices(spark, sf_dir), build, scratch_path(spark, "streamed"))
    return given.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


# --- rule packs, properties ---------------------------------------------------------------------------


@query(r"""WITH f AS (SELECT page_id, 'inline-script' AS rule, unnest(regexp_extract_all(html, '<script>')) AS hit FROM pages
UNION ALL SELECT page_id, 'image-without-text', unnest(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda x: NOT regexp_matches(x, '(?i)\salt\s*='))) FROM pages)
SELECT rule, count(*) AS n, count(DISTINCT page_id) AS pages FROM f GROUP BY rule""")
def pack_findings(spark, sf_dir):
    """The rule files of a folder over pages, through a table function."""
    rules_of = packs.pack(PACKS / "pages")
    found = packs.checked(spark, rules_of, table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query("""SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS typed, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k,
count(*) FILTER (json_extract(props, '$.none') IS NOT NULL) AS none FROM events GROUP BY event_type""")
def typed_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", dynamic.properties(F.col("props")).alias("v"))
    k = dynamic.typed(F.col("v"), "$.k", "int")
    counts = F.count("*").alias("n"), F.count(k).alias("typed"), F.sum(k).alias("k"), F.count(dynamic.typed(F.col("v"), "$.none", "string")).alias("none")
    return events.groupBy("event_type").agg(*counts)


# --- trees and intervals ----------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->|<[^>]*>|[^<]+|<')) AS token, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?-->|<[^>]*>|[^<]+|<'), 1) - 1 AS i FROM pages),
k AS (SELECT page_id, i, trim(regexp_replace(token, '[\x20\x09-\x0D]+', ' ', 'g')) AS flat, lower(regexp_extract(token, '^</?([A-Za-z][^\s/>]*)', 1)) AS name, token FROM t),
n AS (SELECT *, CASE WHEN NOT starts_with(token, '<') OR token = '<' THEN 'text' WHEN name = '' THEN 'none' WHEN starts_with(token, '</') THEN 'close' ELSE 'open' END AS kind FROM k),
s AS (SELECT *, CASE WHEN kind = 'close' THEN -1 WHEN kind = 'open' AND NOT suffix(token, '/>') AND name NOT IN ('area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') THEN 1 ELSE 0 END AS step
  FROM n WHERE kind <> 'none' AND NOT (kind = 'text' AND flat = '')),
d AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM s) WHERE kind <> 'close'),
e AS (SELECT a.page_id, a.i, any_value(a.depth) AS depth, any_value(a.name) AS tag, min(b.i) AS stop FROM d a LEFT JOIN d b ON a.page_id = b.page_id AND b.i > a.i AND b.depth <= a.depth WHERE a.kind = 'open' GROUP BY a.page_id, a.i),
f AS (SELECT e.page_id, e.i, any_value(e.tag) AS tag, count(*) AS size, string_agg((d.depth - e.depth) || d.kind || d.flat, chr(1) ORDER BY d.i) AS whole
  FROM e JOIN d ON d.page_id = e.page_id AND d.i >= e.i AND (e.stop IS NULL OR d.i < e.stop) GROUP BY e.page_id, e.i)
SELECT any_value(tag) AS tag, any_value(size) AS size, count(DISTINCT page_id) AS pages, count(*) AS occurrences, min(page_id) AS first_page, arg_min(i, (page_id, i)) AS first_node FROM f GROUP BY whole HAVING count(DISTINCT page_id) >= 3""")
def equal_subtrees(spark, sf_dir):
    return trees.equal_subtrees(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


@query("""WITH i AS (SELECT e.event_id AS error_id, e.user_id, e.ts AS a, min(p.ts) AS b FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts WHERE e.event_type = 'error' GROUP BY ALL)
SELECT i.user_id, error_id, event_id FROM i JOIN events e ON e.user_id = i.user_id AND e.ts > i.a AND e.ts < i.b""")
def events_before_recovery(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    day = 86_400_000_000
    known = intervals.next_match(events, ["user_id"], "at", F.col("event_type") == "purchase", day)
    spans = known.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("start"), F.col("next_at").alias("stop"))
    return intervals.contained(events.select("user_id", "event_id", "at"), spans, ["user_id"], "at", "start", "stop").select("user_id", "error_id", "event_id")


@query("""WITH w AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT w.o_orderkey, count(*) AS n FROM w JOIN orders o ON o.o_custkey = w.o_custkey AND CAST(o.o_orderdate AS DATE) > w.a AND CAST(o.o_orderdate AS DATE) < w.b GROUP BY w.o_orderkey""")
def orders_in_ship_windows(spark, sf_dir):
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("start"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(day("l_shipdate")).alias("stop"))
    points = orders.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("start").alias("at"))
    met = intervals.contained(points, orders.join(shipped, "o_orderkey"), ["o_custkey"], "at", "start", "stop")
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS pattern FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(html, '<a [^>]*>([^<]+)</a>', 1)) FROM pages)
SELECT pattern, count(*) AS docs, min(doc_id) AS first FROM p JOIN documents ON contains(text, pattern) GROUP BY pattern""")
def phrases_in_documents(spark, sf_dir):
    """Words of parts' names and texts of pages' links, where they stand in documents."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("pattern"))
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]+)</a>"), F.lit(1))).alias("pattern"))
    met = substrings.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", names.union(links).distinct(), "pattern")
    return met.groupBy("pattern").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


KIND_RULES = [("cheap-purchase", "purchase", 0.0, 5.0), ("dear-purchase", "purchase", 95.0, 1e9), ("odd-error", "error", 90.0, 1e9), ("no-such-kind", "refund", 0.0, 1e9)]


@query(f"SELECT rule, count(*) AS n FROM (VALUES {', '.join(map(str, KIND_RULES))}) r(rule, kind, low, high) JOIN events ON event_type = kind AND value >= low AND value < high GROUP BY rule")
def findings_by_kind(spark, sf_dir):
    """Rules that each visit one kind of event: kinds that no rule visits are not read."""
    laid = layout.laid_out(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", scratch_path(spark, "events-by-kind"))
    active = spark.createDataFrame(KIND_RULES, "rule string, kind string, low double, high double")
    met = layout.visited(laid, "event_type", active, "kind").where("value >= low AND value < high")
    return met.groupBy("rule").agg(F.count("*").alias("n"))


# --- metrics ----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'lines' AS metric, CAST(lines AS DOUBLE) AS value, 5.0::DOUBLE AS threshold FROM m WHERE lines > 5 UNION ALL SELECT l_orderkey, 'suppliers', suppliers, 4.0 FROM m WHERE suppliers > 4 UNION ALL SELECT l_orderkey, 'quantity', quantity, 45.0 FROM m WHERE quantity > 45""")
def order_complexity(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_quantity").alias("quantity"))
    return relations.thresholds(m, "l_orderkey", {"lines": (F.col("lines"), 5), "suppliers": (F.col("suppliers"), 4), "quantity": (F.col("quantity"), 45)})


@query("""SELECT l_orderkey AS owner, 1 + count(*) FILTER (l_returnflag IN ('R', 'A')) + count(*) FILTER (l_returnflag = 'X') AS cyclomatic, CAST(coalesce(sum(l_linenumber + 1) FILTER (l_returnflag IN ('R', 'A')), 0) AS BIGINT) AS cognitive,
coalesce(max(l_linenumber + 1) FILTER (l_returnflag IN ('R', 'A')), 0) AS max_nesting, count(*) FILTER (l_returnflag = 'N') AS helpers, count(*) FILTER (l_returnflag IN ('R', 'A')) AS branches, max(l_linenumber) - min(l_linenumber) + 1 AS lines FROM lineitem GROUP BY l_orderkey""")
def complexity_metrics(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("depth"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("end_line"))
    return metrics.complexity(nodes, "owner", ["R", "A"], ["X"], ["N"])


@query("""WITH u AS (SELECT l_suppkey, count(DISTINCT l_returnflag) AS used FROM lineitem GROUP BY l_suppkey), t AS (SELECT count(DISTINCT l_partkey) AS total, l_suppkey FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, used, total FROM u JOIN t USING (l_suppkey) WHERE used > 0 AND total >= 10 AND used < 0.25 * total""")
def usage_ratio(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("used"), F.count_distinct("l_partkey").alias("total"))
    return own.where("used > 0 AND total >= 10 AND used < 0.25 * total")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 3 AND count(*) FILTER (event_type = 'purchase') >= 2")
def state_clusters(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return own.where("errors >= 3 AND purchases >= 2")


TAGS = {"thing": "the", "starts": "^[A-E]", "ends": "[?!]$"}


@query("""WITH t AS (SELECT list_filter([CASE WHEN regexp_matches(text, '\\bthe\\b') THEN 'thing' END, CASE WHEN regexp_matches(text, '^[A-E]') THEN 'starts' END, CASE WHEN regexp_matches(text, '[?!]$') THEN 'ends' END], lambda x: x IS NOT NULL) AS tags FROM conversations),
s AS (SELECT * FROM t WHERE len(tags) > 0) SELECT tag, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s), 1) AS pct FROM (SELECT unnest(tags) AS tag FROM s) GROUP BY tag""")
def tag_coverage(spark, sf_dir):
    return metrics.coverage(metrics.tags(table(spark, sf_dir, "conversations").select("text"), "text", TAGS))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_shipdate::DATE)), ',') AS targets, count(*) AS statements FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def consumption_sets(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.to_date("l_shipdate").cast("string"))), ",").alias("targets"), F.count("*").alias("statements"))
    return own.where("statements >= 3")


@query("SELECT source, sum(n_chars) AS n_chars FROM documents GROUP BY source ORDER BY n_chars DESC, source LIMIT 5")
def top5_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n_chars")).orderBy(F.desc("n_chars"), "source").limit(5)


@query("WITH t AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) SELECT source, n, CAST(round(n / max(n) OVER () * 66) AS BIGINT) AS bar FROM t")
def source_bars(spark, sf_dir):
    return report.bars(table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def events_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"))


# --- similarity -------------------------------------------------------------------------------------

PAIRS = """
WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM w WHERE len(w) > 1),
r AS (SELECT min(doc_id) AS doc_id, s, len(s) AS n FROM s GROUP BY s),
g AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM r),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
j AS (SELECT a, b, common, common / (na + nb - common) AS jaccard FROM c)
"""


def _clones(spark, sf_dir, least):
    # texts are dealt by id: a file of one row group would be taken apart in one task
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", tx.word_bigrams(F.coalesce("text", F.lit(""))).alias("bigrams"))
    return similarity.similar_sets(docs, "doc_id", "bigrams", least)


@query(PAIRS + "SELECT a, b, common, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.92")
def syntactic_clones(spark, sf_dir):
    return _clones(spark, sf_dir, 0.92).withColumn("jaccard", F.round("jaccard", 6))


@query(PAIRS + "SELECT a, b, common, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.8 AND jaccard < 0.92")
def semantic_clones(spark, sf_dir):
    return _clones(spark, sf_dir, 0.8).where("jaccard < 0.92").withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH m AS (SELECT p_brand, list(DISTINCT p_type || ':' || CAST(p_size AS VARCHAR)) AS m FROM part GROUP BY p_brand)
SELECT a.p_brand AS a, b.p_brand AS b, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 6) AS jaccard FROM m a JOIN m b ON a.p_brand < b.p_brand WHERE len(list_intersect(a.m, b.m)) > 0""")
def member_similarity(spark, sf_dir):
    members = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(":", "p_type", F.col("p_size").cast("string")).alias("member")).distinct()
    sets = members.groupBy("p_brand").agg(F.collect_set("member").alias("m"))
    met = members.alias("x").join(members.alias("y"), (F.col("x.member") == F.col("y.member")) & (F.col("x.p_brand") < F.col("y.p_brand"))).select(F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b")).distinct()
    side = lambda k: sets.select(F.col("p_brand").alias(k), F.col("m").alias(f"{k}_m"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(tx.member_jaccard(F.col("a_m"), F.col("b_m")), 6).alias("jaccard"))


# --- graphs -----------------------------------------------------------------------------------------

STEPS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS dst FROM orders WHERE o_orderpriority = '1-URGENT') WHERE dst IS NOT NULL),
"""


def _edges(spark, sf_dir):
    """From each customer with an urgent order to the customer of the day's next one."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    following = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return urgent.select(F.col("o_custkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL").distinct()


def _customers(spark, sf_dir, condition):
    return table(spark, sf_dir, "customer").where(condition).select(F.col("c_custkey").alias("node"))


@query(STEPS + """r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def import_cycles(spark, sf_dir):
    return graph.components_of_cycles(_edges(spark, sf_dir))


@query(STEPS + """f AS (SELECT src, dst FROM e WHERE dst NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
p AS (SELECT c_custkey AS root, c_custkey AS node FROM customer WHERE c_nationkey = 0 UNION SELECT root, f.dst FROM p JOIN f ON p.node = f.src) SELECT root, node FROM p""")
def reachability(spark, sf_dir):
    return graph.reachable_pairs(_edges(spark, sf_dir), _customers(spark, sf_dir, "c_nationkey = 0"), _customers(spark, sf_dir, "c_mktsegment = 'BUILDING'"))


@query(STEPS + """p AS (SELECT c_custkey AS root, c_custkey AS node FROM customer WHERE c_nationkey = 1 UNION SELECT root, e.src FROM p JOIN e ON p.node = e.dst) SELECT root, node FROM p""")
def reverse_reachability(spark, sf_dir):
    return graph.reached_by(_edges(spark, sf_dir), _customers(spark, sf_dir, "c_nationkey = 1"))


@query(STEPS + """p AS (SELECT c_custkey AS root, c_custkey AS node FROM customer WHERE c_nationkey = 2 UNION SELECT root, e.dst FROM p JOIN e ON p.node = e.src)
SELECT node, root FROM p WHERE node IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def taint_to_sink(spark, sf_dir):
    return graph.tainted_sinks(_edges(spark, sf_dir), _customers(spark, sf_dir, "c_nationkey = 2"), _customers(spark, sf_dir, "c_mktsegment = 'MACHINERY'"))


def _trusted(rounds: int = 24) -> str:
    """Rounds written out: SQL's recursion has no "all". More than the tables need."""
    out = ["""line AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
ord AS MATERIALIZED (SELECT o_orderkey AS o, o_custkey AS c FROM orders),
near AS MATERIALIZED (SELECT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000),
s0 AS MATERIALIZED (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 9000)"""]
    for i in range(rounds):
        out.append(f"""o{i} AS MATERIALIZED (SELECT o FROM ord WHERE o NOT IN (SELECT o FROM line WHERE s NOT IN (SELECT s FROM s{i}))),
c{i} AS MATERIALIZED (SELECT DISTINCT c FROM ord JOIN o{i} USING (o)), s{i + 1} AS MATERIALIZED (SELECT s FROM s0 UNION SELECT s FROM near JOIN c{i} USING (c))""")
    last = rounds - 1
    return "WITH " + ", ".join(out) + f" SELECT 'order' AS kind, o AS id FROM o{last} UNION ALL SELECT 'customer', c FROM c{last} UNION ALL SELECT 'supplier', s FROM s{rounds}"


@query(_trusted())
def trusted_orders(spark, sf_dir):
    """An order is trusted if all its suppliers are, a customer if any of their orders is, and a supplier by its balance or
    if any rich customer of its nation is: a graph of "all" and "any" with cycles."""
    kinds = ["order", "customer", "supplier", "nation"]
    # numbers, not names: a half of the bytes. Ids beyond 2^61 are an error, not a clash
    named = lambda kind, c: F.col(c).cast("long") * 4 + kinds.index(kind)
    order, customer, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rich = customer.where("c_acctbal > 9000")
    nodes = order.select(named("order", "o_orderkey").alias("node"), F.lit(True).alias("every"))
    nodes = nodes.union(customer.select(named("customer", "c_custkey"), F.lit(False))).union(supplier.select(named("supplier", "s_suppkey"), F.lit(False)))
    nodes = nodes.union(rich.select(named("nation", "c_nationkey"), F.lit(False)).distinct())
    needs = table(spark, sf_dir, "lineitem").select(named("order", "l_orderkey").alias("node"), named("supplier", "l_suppkey").alias("needs"))
    needs = needs.union(order.select(named("customer", "o_custkey"), named("order", "o_orderkey")))
    # a supplier needs its nation, and that any of its rich customers: pairs of the two would grow with the square of the tables
    needs = needs.union(supplier.select(named("supplier", "s_suppkey"), named("nation", "s_nationkey"))).union(rich.select(named("nation", "c_nationkey"), named("customer", "c_custkey")))
    held = derive.derived(nodes, needs, supplier.where("s_acctbal > 9000").select(named("supplier", "s_suppkey").alias("node")))
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.expr("CAST(node & 3 AS INT) + 1"))
    return held.select(kind.alias("kind"), F.shiftright("node", 2).alias("id")).where("kind <> 'nation'")


# --- edits and scans --------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT l_orderkey, s, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, n DESC) AS k FROM (SELECT l_orderkey, CAST(l_partkey % 40 AS INTEGER) AS s, CAST(l_quantity % 9 AS INTEGER) AS n FROM lineitem)),
r AS (SELECT l_orderkey, s AS low, 1 AS k, 1 AS accepted FROM e WHERE k = 1
UNION ALL SELECT r.l_orderkey, CASE WHEN e.s + e.n <= low THEN e.s ELSE low END, r.k + 1, accepted + CASE WHEN e.s + e.n <= low THEN 1 ELSE 0 END FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.k = r.k + 1)
SELECT l_orderkey, CAST(max(k) AS INTEGER) AS proposed, CAST(max(accepted) AS INTEGER) AS accepted FROM r GROUP BY l_orderkey""")
def accepted_edits(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_quantity") % 9).cast("int").alias("length"), F.lit("").alias("new_text"))
    own = found.groupBy("l_orderkey").agg(F.collect_list(F.struct("start", "length", "new_text")).cast(edits.EDIT).alias("edits"))
    return own.select("l_orderkey", F.size("edits").alias("proposed"), F.size(edits.accepted(F.col("edits"))).alias("accepted"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'removed' WHEN lang = 'fr' THEN 'added' ELSE 'modified' END AS change FROM documents WHERE lang IN ('de', 'fr') OR (lang = 'es' AND text <> upper(text))")
def changed_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    after = docs.where("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text")))
    return files.changed(docs.where("lang <> 'fr'"), after, "doc_id", "text")


@query("SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def scan_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return files.together(events.where("event_type = 'error'").select("user_id"), events.where("event_type = 'purchase'").select("user_id"))


@query("""WITH p AS (SELECT page_id, split_part(url, '?', 1) AS path FROM pages)
SELECT page_id, path, regexp_matches(path, '/en/') OR (regexp_matches(path, '/[4-6][^/]*/?$') AND NOT regexp_matches(path, '/6[^/]*/?$')) OR suffix(path, '#top') AS ignored FROM p""")
def ignored_pages(spark, sf_dir):
    path = F.split_part("url", F.lit("?"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), files.ignored(path, ["en/", "[4-6]*", "!6*", "# a note", "*\\#top"]).alias("ignored"))


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'es') AND n_chars > 500")
def branch_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changes = docs.where("lang IN ('de', 'fr', 'es') AND n_chars > 500").select("doc_id")
    return files.branch(changes, docs.where("lang <> 'de'"), "doc_id")


@query("""WITH f AS (SELECT url, regexp_replace(split_part(split_part(url, '?', 1), '//', 2), '\\.', '/') AS file FROM pages)
SELECT DISTINCT file FROM f WHERE contains(url, '?') OR (starts_with(file, 'www/') AND suffix(file, '.html') AND NOT regexp_matches(file, '/en/'))""")
def listed_files(spark, sf_dir):
    address = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("//"), F.lit(2))
    host = F.substring_index(address, ".", 1)
    pages = table(spark, sf_dir, "pages").select("url", F.concat(host, F.lit("/"), F.substring(address, F.length(host) + 2, F.length(address))).alias("file"))
    return files.listed(pages.select("file"), pages.where(F.col("url").contains("?")), ["www"], ["html"], ["en/"])


@query(FOUND + """SELECT '{"files":' || (SELECT count(*) FROM documents) || ',"rules":3,"checks":4,"errors":' || count(*) FILTER (severity = 'error') || ',"warnings":' || count(*) FILTER (severity = 'warning') || '}' AS value FROM found""")
def json_report_head(spark, sf_dir):
    return report.json_head(diagnostics(spark, sf_dir), TEXT_RULES.table(spark), table(spark, sf_dir, "documents"))


@query(FOUND + """SELECT '<tr class="' || severity || '"><td>' || severity || '</td><td>' || rule || '</td><td>' || file || '</td><td>1</td><td>1</td><td>' || message || '</td></tr>' AS value FROM found""")
def html_rows(spark, sf_dir):
    return report.as_html(diagnostics(spark, sf_dir))
