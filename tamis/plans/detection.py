"""Queries of the detection side over documents, pages and literal fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import rules as R
from tamis.functions import text as T
from tamis.functions import validators as V
from tamis.operators import config as C
from tamis.operators import postfilter as PF
from tamis.operators import spans as S
from tamis.sources.files import spread

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_luhn(x: str) -> str:
    """Luhn over the digits of an SQL string."""
    d = f"list_reverse(list_transform(string_split({x}, ''), lambda c: CAST(c AS INT)))"
    return f"(list_sum(list_transform({d}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d < 5 THEN 2 * d ELSE 2 * d - 9 END)) % 10 = 0)"


def sql_spans(rules, columns: str = "doc_id, source", frm: str = "documents") -> str:
    """SQL rows of all matches: the columns, start, end, pii_type, text, score, priority, ord, detector."""
    parts = []
    for i, r in enumerate(rules):
        check = {"luhn": f"WHERE {_sql_luhn('m[i]')}", "iban": "WHERE false"}.get(r.check, "")
        parts.append(
            f"""SELECT {columns}, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s,
                m[i] AS txt, '{r.pii_type}' AS pii_type, CAST({r.score} AS DOUBLE) AS score, {R.PRIORITY[r.priority]} AS prio, {i} AS ord, '{r.source}' AS det
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {columns}, regexp_extract_all(text, {_quoted(r.pattern)}) AS m, string_split_regex(text, {_quoted(r.pattern)}) AS g FROM {frm}))
            {check}"""
        )
    return " UNION ALL ".join(f"({p})" for p in parts)


#: Spans of the rule detector; in these tables an overlap never has more than two members, so the better one stays.
SQL_REGEX = f"""raw AS ({sql_spans(R.REGEX_RULES)}),
    regex AS (SELECT a.*, s + length(txt) AS e FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE a.doc_id = b.doc_id AND b.s < a.s + length(a.txt) AND a.s < b.s + length(b.txt)
        AND (b.prio, b.score, -b.ord, -b.s) > (a.prio, a.score, -a.ord, -a.s)))"""
SQL_ENTITY = f"""eraw AS ({sql_spans(R.ENTITY_RULES)}),
    entity AS (SELECT a.*, s + length(txt) AS e FROM eraw a WHERE NOT EXISTS (SELECT 1 FROM eraw b WHERE a.doc_id = b.doc_id AND b.s < a.s + length(a.txt) AND a.s < b.s + length(b.txt)
        AND (b.prio, b.score, -b.ord, -b.s) > (a.prio, a.score, -a.ord, -a.s)))"""
#: Both detectors merged: the best score of equal spans, then the first and longest of each type.
SQL_MERGED = f"""{SQL_REGEX}, {SQL_ENTITY},
    every AS (SELECT *, 0 AS d FROM regex UNION ALL SELECT *, 1 AS d FROM entity),
    dedup AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, s, e, pii_type, txt ORDER BY score DESC, d, ord) = 1),
    merged AS (SELECT a.* FROM dedup a WHERE NOT EXISTS (SELECT 1 FROM dedup b WHERE a.doc_id = b.doc_id AND a.pii_type = b.pii_type AND b.s < a.e AND a.s < b.e
        AND (b.s, -b.e, -b.score, b.d) < (a.s, -a.e, -a.score, a.d)))"""


def sql_severity(x: str, configured: dict[str, str] | None = None) -> str:
    of = {t: s for s, types in R.SEVERITY.items() for t in types} | (configured or {})
    by = {s: ", ".join(_quoted(t) for t, v in of.items() if v == s) for s in ("HIGH", "MEDIUM")}
    return f"CASE WHEN upper(trim({x})) IN ({by['HIGH']}) THEN 'HIGH' WHEN upper(trim({x})) IN ({by['MEDIUM']}) THEN 'MEDIUM' ELSE 'LOW' END"


def regex_spans(spark, sf):
    return documents(spark, sf).withColumn("spans", S.detect(F.col("text")))


def merged_spans(spark, sf):
    d = documents(spark, sf)
    return d.withColumn("spans", S.merge(S.detect(F.col("text")), S.detect(F.col("text"), R.ENTITY_RULES)))


def each_span(d: DataFrame, *columns: str) -> DataFrame:
    """A row ``x`` for each span. The outer form keeps Spark from testing for empty lists below, where it would detect twice."""
    return d.select(*columns, F.explode_outer("spans").alias("x")).where("x is not null")


def exploded(d: DataFrame) -> DataFrame:
    own = [F.col(f"x.{c}") for c in ("start", "end", "pii_type", "text", "score")]
    return each_span(d, "doc_id", "source").select("doc_id", "source", *own, F.col("x.source").alias("detector"))


def _rows(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "start", "end", "pii_type", "text", "score")


_SQL_ROWS = 'SELECT doc_id, s AS start, CAST(e AS INT) AS "end", pii_type, txt AS text, score FROM'


@query(f"WITH {SQL_REGEX} SELECT source, {sql_severity('pii_type')} AS severity, count(*) AS n FROM regex GROUP BY ALL")
def severity_by_source(spark, sf):
    """Flagship: rule spans of every document, rated and counted by source."""
    return exploded(regex_spans(spark, sf)).groupBy("source", S.severity(F.col("pii_type")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_REGEX} {_SQL_ROWS} regex")
def det01_regex_spans(spark, sf):
    return _rows(exploded(regex_spans(spark, sf)))


@query(f"WITH {SQL_ENTITY} {_SQL_ROWS} entity")
def det04_entity_spans(spark, sf):
    return _rows(exploded(documents(spark, sf).withColumn("spans", S.detect(F.col("text"), R.ENTITY_RULES))))


@query(f"WITH {SQL_MERGED} {_SQL_ROWS} merged")
def mrg_merged_spans(spark, sf):
    return _rows(exploded(merged_spans(spark, sf)))


@query(f"WITH {SQL_MERGED} SELECT doc_id, pii_type, count(*) AS n FROM merged GROUP BY ALL")
def agg01_types_per_document(spark, sf):
    return exploded(merged_spans(spark, sf)).groupBy("doc_id", "pii_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SQL_MERGED}, sev AS (SELECT doc_id, {sql_severity('pii_type')} AS v FROM merged)
    SELECT doc_id, count(*) FILTER (WHERE v = 'HIGH') AS high, count(*) FILTER (WHERE v = 'MEDIUM') AS medium, count(*) FILTER (WHERE v = 'LOW') AS low, count(v) AS total,
        CASE WHEN bool_or(v = 'HIGH') THEN 'HIGH' WHEN bool_or(v = 'MEDIUM') THEN 'MEDIUM' WHEN bool_or(v = 'LOW') THEN 'LOW' END AS highest
    FROM documents LEFT JOIN sev USING (doc_id) GROUP BY doc_id"""
)
def agg02_severity_counts(spark, sf):
    d = merged_spans(spark, sf)
    return d.select("doc_id", S.severity_counts(F.col("spans")).alias("c"), S.highest_severity(F.col("spans")).alias("highest")).select("doc_id", "c.*", "highest")


@query(
    f"""WITH {SQL_MERGED}, n AS (SELECT 'raw' AS stage, count(*) AS n FROM every UNION ALL SELECT 'dedup', count(*) FROM dedup UNION ALL SELECT 'merged', count(*) FROM merged
        UNION ALL SELECT 'gate', count(*) FROM merged m WHERE {C.sql_gate('m')}) SELECT stage, n FROM n"""
)
def agg18_funnel(spark, sf):
    raw = F.concat(S.detect(F.col("text")), S.detect(F.col("text"), R.ENTITY_RULES))
    d = documents(spark, sf).withColumn("raw", raw).withColumn("dedup", S.merge_exact(F.col("raw"))).withColumn("merged", S.resolve_by_type(F.col("dedup")))
    d = d.withColumn("gate", C.gate(F.col("merged"), R.TYPE_CONFIG))
    stages = ("raw", "dedup", "merged", "gate")
    n = d.agg(*[F.coalesce(F.sum(F.size(s)), F.lit(0)).cast("long").alias(s) for s in stages])
    return n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages])).alias("x")).select("x.*")


@query(f"WITH {SQL_MERGED} SELECT doc_id, s AS start, pii_type, det AS source FROM merged m WHERE {C.sql_gate('m')}")
def flt01_gated_spans(spark, sf):
    d = merged_spans(spark, sf).withColumn("spans", C.gate(F.col("spans"), R.TYPE_CONFIG))
    return each_span(d, "doc_id").select("doc_id", "x.start", "x.pii_type", "x.source")


@query(f"WITH {SQL_MERGED} SELECT doc_id, s AS start, pii_type, det AS source FROM merged m WHERE {C.sql_gate('m')}")
def join01_gated_by_join(spark, sf):
    """The same gate as a join with the configuration table, for tables of many rows."""
    spans = each_span(merged_spans(spark, sf), "doc_id").select("doc_id", "x.*")
    return C.gate_join(spans, C.config_table(spark, R.TYPE_CONFIG)).select("doc_id", "start", "pii_type", "source")


@query(
    f"""WITH {SQL_REGEX}, o AS (SELECT doc_id, list(struct_pack(s := s, e := CAST(e AS INT), t := pii_type) ORDER BY s) AS l FROM regex GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN length(text) > 10000 THEN '{S.NOTICE}' WHEN l IS NULL THEN text ELSE
        array_to_string(list_transform(l, lambda x, i: substr(text, 1 + CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END, x.s - CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END) || '[' || x.t || ']'), '')
        || substr(text, 1 + l[len(l)].e) END AS masked
    FROM documents d LEFT JOIN o USING (doc_id)"""
)
def msk01_masked_documents(spark, sf):
    return regex_spans(spark, sf).select("doc_id", S.service_mask(F.col("text"), F.col("spans")).alias("masked"))


@query(
    f"""WITH {SQL_REGEX}, l AS (SELECT r.*, text, s - strpos(reverse(substr(text, 1, s)), chr(10)) + 1 AS nl, strpos(substr(text, CAST(e AS INT) + 1), chr(10)) AS after FROM regex r JOIN documents USING (doc_id))
    SELECT doc_id, s AS start, CASE WHEN strpos(substr(text, 1, s), chr(10)) = 0 THEN substr(text, 1, CASE WHEN after = 0 THEN length(text) ELSE CAST(e AS INT) + after - 1 END)
        ELSE substr(text, CAST(nl AS INT) + 1, CASE WHEN after = 0 THEN length(text) ELSE CAST(e AS INT) + after - 1 END - CAST(nl AS INT)) END AS context FROM l"""
)
def ctx02_line_contexts(spark, sf):
    d = each_span(regex_spans(spark, sf), "doc_id", "text")
    return d.select("doc_id", "x.start", S.sensitive_context(F.col("text"), F.col("x")).alias("context"))


@query(
    f"""WITH {SQL_REGEX} SELECT doc_id, s AS start, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE substr(text, a + 1, b - a) END AS context
    FROM (SELECT doc_id, s, text, s - length(regexp_extract(substr(text, 1, s), '[^\n]*$')) AS a, e + length(regexp_extract(substr(text, e + 1), '^[^\n]*')) AS b FROM regex JOIN documents USING (doc_id))"""
)
def ctx03_enriched(spark, sf):
    """Spans of every second document have a context already, which stays."""
    given = F.when(F.col("doc_id") % 2 == 0, "kept")
    spans = F.transform("spans", lambda s: s.withField("masked_context", F.lit(None).cast("string")).withField("sensitive_context", given))
    d = regex_spans(spark, sf).withColumn("spans", spans).withColumn("spans", S.enriched(F.col("text"), F.col("spans")))
    return each_span(d, "doc_id").select("doc_id", "x.start", F.col("x.sensitive_context").alias("context"))


@query(
    """SELECT * FROM (VALUES (0, 0, 0, 15), (1, 6, 3, 10), (2, 16, 13, 16), (3, 9, 6, 13), (4, 7, 2, 9)) AS t(id, place, a, b)"""
)
def txt04_html_lines(spark, sf):
    """Bounds of the line around a place of a page, and of plain texts."""
    rows = [(0, "plain <b>, text", 0), (1, "<p>one two</p><br/>", 6), (2, "<h1>a</h1><p>b c</P>d", 16), (3, "<div>\nab \U0001f600 cd<li>", 9), (4, "a\nb < c d", 7)]
    d = _values(spark, rows, "id int, text string, place int")
    return d.select("id", "place", S.line_start(F.col("text"), F.col("place")).alias("a"), S.line_end(F.col("text"), F.col("place")).alias("b"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'tab' WHEN 1 THEN 'empty' ELSE 'null' END AS kind, 0 AS spans FROM pages WHERE page_id % 4 <> 3")
def txt07_blank_pages(spark, sf):
    """Pages blanked in three ways, and some left as they are: blank ones are items without findings."""
    html = F.when(F.col("page_id") % 4 == 0, F.lit(" \t\n\u00a0\u2003")).when(F.col("page_id") % 4 == 1, "").when(F.col("page_id") % 4 == 3, F.col("html"))
    kind = F.element_at(F.array(F.lit("tab"), F.lit("empty"), F.lit("null"), F.lit("page")), (F.col("page_id") % 4 + 1).cast("int"))
    d = table(spark, sf, "pages").select("page_id", kind.alias("kind"), html.alias("html")).where(T.is_blank(F.col("html")))
    return d.select("page_id", "kind", F.coalesce(F.size(S.detect(F.col("html"))), F.lit(0)).alias("spans"))


@query(f"WITH {SQL_MERGED} SELECT DISTINCT pii_type, det AS source FROM every")
def set01_found_types(spark, sf):
    """Types found by either detector: the union of both, without repetitions."""
    d = documents(spark, sf)
    found = d.select(S.detect(F.col("text")).alias("spans")).unionByName(d.select(S.detect(F.col("text"), R.ENTITY_RULES).alias("spans")))
    return found.select(F.explode("spans").alias("x")).select("x.pii_type", "x.source").distinct()


@query()
def ctx01_masked_contexts(spark, sf):
    d = each_span(regex_spans(spark, sf), "doc_id", "text", "spans")
    return d.select("doc_id", "x.start", S.masked_context(F.col("text"), F.col("x"), F.col("spans")).alias("context"), S.masked_content(F.col("text"), F.col("spans"), 500).alias("preview"))


@query(f"WITH {SQL_REGEX} SELECT doc_id, s AS start, 'sha256=' || substr(sha256(txt), 1, 8) || ', length=' || length(txt) AS redacted FROM regex")
def ctx04_redacted_values(spark, sf):
    return exploded(regex_spans(spark, sf)).select("doc_id", "start", S.redact(F.col("text")).alias("redacted"))


@query(
    r"""SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s', '', 'g')) = '' THEN 'blank' WHEN length(text) < 50 THEN 'too_short'
        WHEN length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) / length(text) < 0.05 THEN 'low_alphanumeric'
        WHEN length(text) > 100 AND length(regexp_replace(text, '[^ ]', '', 'g')) / length(text) < 0.02 THEN 'insufficient_spacing'
        WHEN length(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', '', 'g')) / length(text) < 0.8 THEN 'control_characters'
        WHEN length(regexp_replace(text, '[\p{L}\p{Nd}\s]', '', 'g')) / length(text) > 0.4 THEN 'special_characters' END AS reason FROM documents"""
)
def qlt_text_quality(spark, sf):
    return documents(spark, sf).select("doc_id", T.quality_reason(F.col("text")).alias("reason"))


@query(
    "SELECT page_id, length(html) >= 10 AND contains(h, '<') AND contains(h, '>') AND ("
    + " OR ".join(f"contains(h, '{t}')" for t in T.SNIFFED_TAGS)
    + ") AS is_html FROM (SELECT *, lower(substr(html, 1, 1000)) AS h FROM pages)"
)
def txt02_html_sniff(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_html(F.col("html")).alias("is_html"))


@query()
def txt01_page_texts(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", T.clean(F.col("html")).alias("text"))


@query(
    """SELECT doc_id, CAST(greatest(0, pos - 100) AS INT) AS start, CAST(least(length(text), pos + 1000) AS INT) AS "end", sha256(substr(text, greatest(0, pos - 100) + 1, least(length(text), pos + 1000) - greatest(0, pos - 100))) AS chunk_sha256
    FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS pos FROM documents)"""
)
def chk01_char_chunks(spark, sf):
    d = documents(spark, sf).select("doc_id", F.explode(T.char_chunks(F.col("text"), 250, 25)).alias("c"))
    return d.select("doc_id", "c.start", "c.end", F.sha2("c.text", 256).alias("chunk_sha256"))


@query(
    r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS m, string_split_regex(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM documents WHERE text <> ''),
    w AS (SELECT *, len(m) AS n, unnest(range(0, CASE WHEN len(m) <= 256 THEN 1 ELSE CAST(ceil((len(m) - 256) / 224.0) AS BIGINT) + 1 END)) AS k FROM t)
    SELECT doc_id, CAST(CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(m[1:k * 224], '')) + length(array_to_string(g[1:k * 224 + 1], '')) END AS INT) AS start,
        CAST(CASE WHEN k * 224 + 256 >= n THEN length(text) ELSE length(array_to_string(m[1:k * 224 + 256], '')) + length(array_to_string(g[1:k * 224 + 256], '')) END AS INT) AS "end",
        CAST(least(256, n - k * 224) AS INT) AS tokens FROM w"""
)
def chk02_token_chunks(spark, sf):
    d = documents(spark, sf).select("doc_id", F.explode(T.token_chunks(F.col("text"), 256, 32)).alias("c"))
    return d.select("doc_id", "c.start", "c.end", "c.tokens")


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{10000}-\\x{10FFFF}]') AS non_bmp FROM documents")
def fn04_non_bmp(spark, sf):
    return documents(spark, sf).select("doc_id", T.has_non_bmp(F.col("text")).alias("non_bmp"))


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


#: Values with check digits made by the standards' rules; the last column says whether the post-filter keeps them.
FORMAT_CASES = (
    ("192.168.1.1", "IP_ADDRESS", True), ("10:30", "IP_ADDRESS", False), ("999.1.1.1", "IP_ADDRESS", False), ("1.2.3", "IP_ADDRESS", False), ("::1", "IP_ADDRESS", True), ("01.2.3.4", "IP_ADDRESS", False),
    ("00:1A:2B:3C:4D:5E", "MAC_ADDRESS", True), ("00:1A-2B:3C:4D:5E", "MAC_ADDRESS", False), ("GB82 WEST 1234 5698 7654 32", "IBAN", True), ("GB82 WEST 1234 5698 7654 33", "IBAN", False), ("XX12", "IBAN", True),
    ("4111 1111 1111 1111", "CARD_NUMBER", True), ("4111111111111112", "PAYMENT_CARD", False), ("4111111111111112", "CREDIT_CARD", True), ("7569217076985", "AVS_NUMBER", True), ("756 9217 0769 84", "AVS_NUMBER", False), ("756.9217.0769.85", "AVS_NUMBER", False),
    ("CHE-116.281.710 TVA", "TAX_ID", True), ("CHE-116.281.711", "TAX_ID", False), ("TX940039", "TAX_ID", True), ("DEUTDEFF", "BIC", True), ("DEUT1EFF", "SWIFT", False), ("DEUTDEFF500", "swift-bic", True),
    ("123e4567-e89b-12d3-a456-426614174000", "ID", False), ("123e4567-e89b-12d3-a456-426614174000", "API_KEY", True), ("MongoDB ObjectId 507f1f77bcf86cd799439011", "ID", False), ("David 507f1f77bcf86cd799439011", "ID", True),
    ("00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01", "API_KEY", False), ("v2.3.1-rc1", "PERSON_NAME", False), ("12.5.2024", "DATE", True), ("2024.05.16", "DATE", True), ("1.2.3", "IPV4", True), ("sk_live_0123", "VERSION", True),
    ("data:image/png;base64,AAAA", "X", False), ("abcdef12", "COMMIT", False), ("build-20240", "BUILD_NUMBER", False), ("release-1.4", "VERSION", False), ("", "IP_ADDRESS", True), (None, "IBAN", True), ("hello", None, True),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(k).lower()})" for i, (_, _, k) in enumerate(FORMAT_CASES)) + ") AS t(id, keep)")
def pf_format_rules(spark, sf):
    d = _values(spark, [(i, v, t) for i, (v, t, _) in enumerate(FORMAT_CASES)], "id int, value string, pii_type string")
    return d.select("id", PF.reject_reason(F.col("value"), F.col("pii_type")).isNull().alias("keep"))


@query(
    f"""WITH {SQL_MERGED}, n AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) + CASE WHEN doc_id % 400 <= 255 THEN 1 ELSE 0 END AS kept, CASE WHEN doc_id % 400 > 255 THEN 1 ELSE 0 END AS discarded FROM documents LEFT JOIN n USING (doc_id)"""
)
def pf00_split_spans(spark, sf):
    """Spans of every document, and an address made from its id that may be none, kept or discarded."""
    more = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("IP_ADDRESS").alias("pii_type"), F.concat(F.lit("10.0.0."), F.col("doc_id") % 400).alias("text"), F.lit(1.0).alias("score"), F.lit(R.REGEX).alias("source"), F.lit(3).alias("priority"), F.lit(0).alias("ord"))
    d = merged_spans(spark, sf).select("doc_id", PF.split(F.concat("spans", F.array(more.cast(S.SPAN)))).alias("x"))
    return d.select("doc_id", F.size("x.kept").cast("long").alias("kept"), F.size("x.discarded").cast("long").alias("discarded"))


@query(
    f"""WITH v AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4') AS card FROM orders)
    SELECT k AS o_orderkey, 'ip_address parse failed' AS reason, 'FALSE_POSITIVE' AS verdict, 1.0::DOUBLE AS confidence FROM v WHERE k % 400 > 255
    UNION ALL SELECT k, 'card_number luhn failed', 'FALSE_POSITIVE', 1.0 FROM v WHERE NOT {_sql_luhn('card')}
    UNION ALL SELECT k, 'mixed '':'' and ''-'' separators (not a MAC)', 'FALSE_POSITIVE', 1.0 FROM v WHERE k % 3 = 0
    UNION ALL SELECT k, 'technical artifact: uuid', 'FALSE_POSITIVE', 1.0 FROM v WHERE k % 2 = 0
    UNION ALL SELECT k, 'technical artifact: version string', 'FALSE_POSITIVE', 1.0 FROM v WHERE k % 60 NOT BETWEEN 1 AND 31
    UNION ALL SELECT k, 'swift_bic structure failed', 'FALSE_POSITIVE', 1.0 FROM v WHERE k % 5 = 1"""
)
def pf00_rejections(spark, sf):
    """What is said of values made from order numbers: addresses, cards, a mixed MAC, an id under two labels, dates or versions, bank codes."""
    k = F.col("o_orderkey")
    made = [
        ("IP_ADDRESS", F.concat(F.lit(" 10.0.0."), k % 400, F.lit("\t"))), ("CARD_NUMBER", F.lpad((k * 7919).cast("string"), 16, "4")), ("MAC_ADDRESS", F.when(k % 3 == 0, "00:1A-2B:3C:4D:5E").otherwise("00:1A:2B:3C:4D:5E")),
        ("ID", F.when(k % 2 == 0, "123e4567-e89b-12d3-a456-426614174000").otherwise("123e4567-e89b-12d3-a456")), ("API_KEY", F.lit("123e4567-e89b-12d3-a456-426614174000")), ("X", F.concat(k % 60, F.lit(".5.2024"))),
        ("BIC", F.when(k % 5 == 1, "DEUT1EFF").when(k % 5 == 2, "DEUT 1E FF").otherwise("DEUTDEFF")),
    ]
    span = lambda t, v: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(t).alias("pii_type"), v.cast("string").alias("text"), F.lit(1.0).alias("score"), F.lit(R.REGEX).alias("source"), F.lit(3).alias("priority"), F.lit(0).alias("ord"))
    d = table(spark, sf, "orders").select(k, F.explode(PF.split(F.array(*[span(t, v) for t, v in made]))["discarded"]).alias("x"))
    return d.select("o_orderkey", "x.reason", "x.verdict", "x.confidence")


LABEL_CASES = ("phoneNumber", "Full Name", "e-mail", "IBANCode", "__x__", "", "Already_normal", "A1B2")


@query("SELECT * FROM (VALUES ('phoneNumber', 'phone_number'), ('Full Name', 'full_name'), ('e-mail', 'e_mail'), ('IBANCode', 'ibancode'), ('__x__', 'x'), ('', ''), ('Already_normal', 'already_normal'), ('A1B2', 'a1_b2')) AS t(label, normal)")
def det07_normal_labels(spark, sf):
    return _values(spark, [(x,) for x in LABEL_CASES], "label string").select("label", T.normal_label(F.col("label")).alias("normal"))


@query("SELECT * FROM (VALUES ('a.PDF', 'pdf', true), ('x.tar.gz', 'gz', false), ('.txt', '', false), ('dot.', '', false), ('none', '', false), ('r.html', 'html', true)) AS t(name, ext, extractable)")
def txt05_extensions(spark, sf):
    d = _values(spark, [(x,) for x in ("a.PDF", "x.tar.gz", ".txt", "dot.", "none", "r.html")], "name string").withColumn("ext", T.extension(F.col("name")))
    return d.withColumn("extractable", T.is_extractable(F.col("ext")))


@query(f"SELECT o_orderkey, {_sql_luhn('lpad(CAST(o_orderkey * 7919 AS VARCHAR), 14, chr(52))')} AS valid FROM orders")
def det03_luhn(spark, sf):
    number = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 14, "4")
    return table(spark, sf, "orders").select("o_orderkey", V.luhn(number).alias("valid"))
