"""Registered queries of the document operators, each with the same question in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, diagnose, discover, heuristics, patterns, registry, resolve, rewrite, values, views
from ..operators.allowlist import Allowlist, composed, defined_term_forms, discover_defined_terms, filter_allowed, filter_removed
from ..sources import text as text_source
from . import anonymise as run
from . import detect as detection
from .oracle_shapes import RE2
from .presets import COUNTRIES, DEPTHS, LABELS, PII_CATEGORIES, VALUE_CATEGORIES, depth_selection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


#: Bytes of a table's files that stay as they are read, and that a task is to get at most of a larger one.
ONE_TASK, A_TASK = 200_000, 8_000_000


def dealt(rows: DataFrame) -> DataFrame:
    """A table by the hash of its first column over as many tasks as the session has or more, unless it is in as many files. A file may be
    one row group of a million rows, which one task would read and then scan alone, whatever the number of cores."""
    spark, size = rows.sparkSession, int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    if size <= ONE_TASK or len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")), size // A_TASK), rows.columns[0])


def source(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables it names, as both engines read it."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]
    for n in names:
        if re.search(rf"\b{n}\b", sql):
            dealt(spark.read.parquet(f"{sf_dir}/{n}.parquet")).createOrReplaceTempView(n)
    return spark.sql(sql)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


DOCS = "SELECT doc_id AS doc_ord, CAST(0 AS bigint) AS region_ord, text FROM documents"
PAGES = "SELECT page_id AS doc_ord, CAST(0 AS bigint) AS region_ord, concat(url, ' ', html) AS text FROM pages"
#: Near misses and edges of the shapes, one text for each key.
HARD = [
    "a+b@sub.domain.co.uk, user@localhost, @handle, x@y.z, é@ö.lu, a@b.co1 a@-.lu", "see www.nstar.lu/privacy. or https://u:p@h.t/x, www.txt www.a.b/c,d http:// (https://x.lu/y) wwwx.a.b xwww.a.b",
    "LU28 0019 4006 4475 0000; LU88 0055 6600 4321 6501 lu28 XLU280019400644750000 DE89370400440532013000x GB82 WEST 1234 5698 7654 32", "LU12345678 éLU12345678 LU1234 LU123456789 xLU12345678 LU12345678-LU87654321",
    "FR40303265045 FRXX123456789 FR4030326504 DE123456789 DE12345678 ESX1234567X ES12345678 GB123456789 GB123456789012 GB1234567890", "1893120105732 189312010573 18931201057321 x1893120105732y -1893120105732.",
    "+352 29 19 19 5 and 26 12 34 56, 00352621000111 +3521 +352-1-2 +352 1234 1234 1234 1234 1234 9", "+33 6 12 34 56 78; 0612345678 06 12 34 56 7 06-12-34-56-78 00 33 612345678 x0612345678",
    "+49 30 1234567 030 123456 0301234567890 +34 612 345 678 612345678 512345678 +44 20 7946 0958 07911 123456 0207 946 0958 7", "€1,500.00 and EUR 12 500 and 2M, 1.250,50 € $99 €1,5k 2.3M USD 12EUR5 £ 3 CHF1 000 100 $ 99",
    "2026-07-23, 23 juillet 2026, July 23, 2026, 1/2 23/07/2026 23.07.26 3rd March 2026 12026-07-23 2026-07-234 31 février 2026", "4532 0151 1283 0366 4532015112830366 4532015112830367 LU88 4532015112830366 4111-1111-1111-1111 378282246310005 12345678901234567890",
    "485 777 3457 485 777 3456 4857773456 485-777-3456 48577734560", "192.168.0.1 999.1.2.3 fe80::1 1.2.3.4.5 01.002.3.4 2001:db8::8a2e:370:7334 1:2:3:4:5:6:7:8 ::1 a::b:c", "00:1A:2B:3C:4D:5E 00:1A:2B:3C:4D 00-1a-2b-3c-4d-5e 00:1A:2B:3C:4D:5E:6F x00:1A:2B:3C:4D:5E",
    "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 0A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa bc1short", "postgres://u:p@host/db postgresql://x mysql://(y) mongodb+srv://z jdbc:oracle://w xredis://v redis://v jdbc://q",
    "12345678901 01234567890 123456789012 x12345678901", "BIC/SWIFT: BGLLLULL and TERMINATION bic code - DEUTDEFF500 SWIFT ABCDXXAA BIC ABCDEFGHIJK heading BNPAFRPP swift:BNPAFRPPX", "L-1855 L-185 L-18555 xL-1855 L-1855-2",
    "1, Avenue de l’Innovation, L-1855; 12, Tilleuls 12b, rue des Tilleuls Blancs Hauts Bas 7,place 8, Place d’Armes 12345, rue X", "12345678Z 12345678A 12345678z 123456789Z x12345678Z",
]
#: Shapes that the tables lack, made from keys by expressions that both engines read alike; good and bad ones.
MADE = {
    "iban": "SELECT s_suppkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('pay to LU', lpad(CAST(s_suppkey % 97 AS string), 2, '0'), ' 0019 4006 ', lpad(CAST(s_suppkey AS string), 4, '0'), ' 0000 today, or LU28 0019 4006 4475 0000') AS text FROM supplier",
    "vat": "SELECT c_custkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('VAT ', CASE c_custkey % 6 WHEN 0 THEN 'LU' WHEN 1 THEN 'FR40' WHEN 2 THEN 'DE1' WHEN 3 THEN 'ESX' WHEN 4 THEN 'GB1' ELSE 'xLU' END, lpad(CAST(c_custkey AS string), 8, '0'), CASE WHEN c_custkey % 6 = 1 THEN '5' ELSE '' END, ' end') AS text FROM customer",
    "numbers": "SELECT o_orderkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('a ', CAST(4000000000000000 + o_orderkey * 7919 AS string), ' b ', CAST(1800000000000 + o_orderkey AS string), ' c ', CAST(4000000000 + o_orderkey * 37 AS string), ' d ', CAST(12000000000 + o_orderkey AS string), ' e9 1234567890123456 f') AS text FROM orders",
    "phone": "SELECT c_custkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('tel ', CASE c_custkey % 6 WHEN 0 THEN '+352 ' WHEN 1 THEN '+33 6 ' WHEN 2 THEN '+49 30 ' WHEN 3 THEN '+34 6' WHEN 4 THEN '+44 20 ' ELSE '0' END, lpad(CAST(c_custkey % 100 AS string), 2, '1'), ' 34 56 78', CASE WHEN c_custkey % 5 = 0 THEN '99999' ELSE '' END, '; 06 12 34 56 78; 612 345 678; 0207 946 0958.') AS text FROM customer",
    "amount": "SELECT o_orderkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('sum EUR ', CAST(CAST(o_totalprice AS bigint) AS string), ' or ', CAST(o_orderkey % 900 AS string), '.50 € and $', CAST(o_orderkey % 9 AS string), 'k, plain 77') AS text FROM orders",
    "date": "SELECT o_orderkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('on ', CAST(CAST(o_orderdate AS date) AS string), ' or ', CAST(o_orderkey % 28 + 1 AS string), ' March 2026, ', CAST(o_orderkey % 28 + 1 AS string), '/07/2026; 2026') AS text FROM orders",
    "network": "SELECT p_partkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('at ', CAST(p_partkey % 300 AS string), '.1.2.', CAST(p_size AS string), ' and fe80::', CAST(p_partkey % 10 AS string), ' or 00:1A:2B:3C:4D:', lpad(CAST(p_partkey % 100 AS string), 2, '0'), ' via postgres://u:p@host/', CAST(p_partkey AS string), ' to bc1qw508d6qejxtdg4y5r3zarvary0c5xw7k', CAST(p_partkey % 9 + 1 AS string), ' x') AS text FROM part",
    "codes": "SELECT p_partkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat(CASE p_partkey % 3 WHEN 0 THEN 'project ' WHEN 1 THEN 'invoice no. ' ELSE 'see ' END, 'PRJ-', CAST(p_partkey % 50 + 1000 AS string), ' done') AS text FROM part",
    "bic": "SELECT s_suppkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat(CASE s_suppkey % 3 WHEN 0 THEN 'BIC/SWIFT: ' WHEN 1 THEN 'bic code - ' ELSE 'heading ' END, CASE s_suppkey % 4 WHEN 0 THEN 'BGLLLULL' WHEN 1 THEN 'DEUTDEFF500' WHEN 2 THEN 'ABCDXXAA' ELSE 'BNPAFRPP' END, ' TERMINATION') AS text FROM supplier",
    "nif": "SELECT c_custkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('NIF ', lpad(CAST(c_custkey AS string), 8, '0'), CASE WHEN c_custkey % 2 = 0 THEN substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(c_custkey % 23 + 1 AS int), 1) ELSE 'A' END, ' L-', lpad(CAST(c_custkey % 10000 AS string), 4, '0'), ' and ', CAST(c_custkey % 90 + 1 AS string), ', rue des Tilleuls Blancs') AS text FROM customer",
    "mail": "SELECT c_custkey AS doc_ord, CAST(0 AS bigint) AS region_ord, concat('write jean.muller', CAST(c_custkey % 7 AS string), '@mail.firm', CAST(c_custkey % 11 AS string), '.co.uk or info@gmail.com, see www.site', CAST(c_custkey % 5 AS string), '.public.lu/x. Firm', CAST(c_custkey % 11 AS string), ' and Jean Muller', CAST(c_custkey % 7 AS string), ' agree') AS text FROM customer",
    "hard": "SELECT n_nationkey AS doc_ord, CAST(0 AS bigint) AS region_ord, " + "CASE n_nationkey " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(HARD)) + " ELSE n_name END AS text FROM nation",
    "terms": "SELECT n_nationkey AS doc_ord, n_name AS name, concat('\"', n_name, ' Party\" means us; (the \"', n_name, ' Assembly\") and (\"Other\") or \"*Both*\" shall mean all') AS text FROM nation",
}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_DIGITS = "regexp_replace(original, '[^0-9]', '', 'g')"
_LUHN = f"(SELECT sum(CASE WHEN i % 2 = 0 THEN d ELSE CASE WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END END) % 10 = 0 FROM (SELECT i, CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS int), 1) AS int) AS d FROM range(0, length({_DIGITS})) t(i)))"
_IBAN = "(WITH RECURSIVE m(i, r) AS (SELECT 0, CAST(0 AS bigint) UNION ALL SELECT i + 1, CASE WHEN ascii(substr(y, CAST(i + 1 AS int), 1)) < 60 THEN (r * 10 + ascii(substr(y, CAST(i + 1 AS int), 1)) - 48) % 97 ELSE (r * 100 + ascii(substr(y, CAST(i + 1 AS int), 1)) - 55) % 97 END FROM m, (SELECT substr(replace(original, ' ', ''), 5) || substr(replace(original, ' ', ''), 1, 4) AS y) WHERE i < length(y)) SELECT r = 1 FROM m ORDER BY i DESC LIMIT 1)"
_PHONES = {
    "LU": f"length(regexp_replace({_DIGITS}, '^(?:00352|352)', '')) BETWEEN 4 AND 11",
    "FR": f"length(regexp_replace({_DIGITS}, '^33', '0')) = 10 AND starts_with(regexp_replace({_DIGITS}, '^33', '0'), '0')",
    "DE": f"length(regexp_replace({_DIGITS}, '^49', '0')) BETWEEN 10 AND 12 AND starts_with(regexp_replace({_DIGITS}, '^49', '0'), '0')",
    "ES": f"length(regexp_replace({_DIGITS}, '^34', '')) = 9 AND regexp_matches(regexp_replace({_DIGITS}, '^34', ''), '^[6789]')",
    "UK": f"length(regexp_replace({_DIGITS}, '^44', '0')) BETWEEN 10 AND 11 AND starts_with(regexp_replace({_DIGITS}, '^44', '0'), '0')",
}
_NHS = f"(SELECT CASE WHEN length({_DIGITS}) = 10 THEN (11 - sum((10 - i) * CAST(substr({_DIGITS}, CAST(i + 1 AS int), 1) AS int)) % 11) % 11 = CAST(substr({_DIGITS}, 10, 1) AS int) ELSE false END FROM range(0, 9) t(i))"
_CHECKS = {
    "credit_card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} AND NOT regexp_matches(before8, '\\b[A-Z]{{2}}[0-9]{{2}}[ ]?$')",
    "uk_nhs": _NHS,
    "bic": "length(original) IN (8, 11) AND substr(original, 5, 2) IN ('LU', 'DE', 'FR', 'IN', 'AT', 'ER') AND regexp_matches(before32, '(?i)\\b(?:bic|swift)(?:[ ]?code)?[ ]*[:/=,.\\-]*[ ]*$')",
    "es_nif": "upper(substr(original, 9, 1)) = substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(substr(original, 1, 8) AS int) % 23 + 1 AS int), 1)",
}


def scan_sql(sql: str, selection: dict[str, bool], country: str) -> str:
    """SQL for (doc_ord, start, category, original, confidence): what scan_patterns finds, by splitting on each pattern."""
    parts = []
    v4 = RE2[[c for c, _, _ in RE2].index("ip_address")]
    for row in RE2:
        category, countries, regex = row
        if not selection.get(category) or countries and country not in countries.split():
            continue
        grouped = regex.startswith("(?:^|[^0-9])")
        check = _CHECKS.get(category, "true")
        if category == "phone":
            check = _PHONES[country]
        if row is v4:
            check = "(SELECT bool_and(CAST(o AS int) <= 255) FROM (SELECT unnest(string_split(original, '.')) AS o))"
        score = f"CASE WHEN {_IBAN} THEN 1.0 ELSE 0.7 END" if category == "iban" else "1.0"
        whole = "substr(m[i], 2)" if grouped else "m[i]"
        whole = "CASE WHEN regexp_matches(m[i], '^[0-9]') THEN m[i] ELSE substr(m[i], 2) END" if grouped else whole
        parts.append(f"""SELECT doc_ord, category, original, CAST({score} AS double) AS confidence, start FROM (
            SELECT doc_ord, '{category}' AS category, {whole} AS original, {"start + length(m[i]) - length(" + whole + ")"} AS start,
                   substr(text, greatest(start - 7, 1), least(start, 8)) AS before8, substr(text, greatest(start - 31, 1), least(start, 32)) AS before32, following FROM (
              SELECT *, CAST((SELECT coalesce(sum(length(p[k])), 0) FROM range(1, i + 1) t(k)) + (SELECT coalesce(sum(length(m[k])), 0) FROM range(1, i) t(k)) AS bigint) AS start,
                     substr(concat(p[i + 1], coalesce(m[i + 1], '')), 1, 1) AS following FROM (
                SELECT doc_ord, text, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
                  SELECT doc_ord, text, regexp_extract_all(text, {_sql_text(regex)}) AS m, string_split_regex(text, {_sql_text(regex)}) AS p FROM ({sql}) s))))
            WHERE NOT regexp_matches(following, '^[0-9]') AND {check}""")
    return " UNION ALL ".join(parts)


def _preview(sql: str) -> str:
    return f"SELECT category, original, count(*) AS matches, count(DISTINCT doc_ord) AS documents, min(confidence) AS confidence FROM ({sql}) GROUP BY category, original"


def only(*categories: str) -> dict[str, bool]:
    return dict.fromkeys(categories, True)


def _scan(name: str, sql: str, categories: tuple[str, ...], country: str = "LU") -> None:
    @query(name, _preview(scan_sql(sql, only(*categories), country)))
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diagnose.preview_matches(patterns.scan_patterns(source(spark, sf_dir, sql), only(*categories), country))


_scan("preview_matches", DOCS, ("email", "ip_address", "credit_card", "matricule", "mac_address", "database_uri"))
_scan("scan_pages", PAGES, ("email", "url", "ip_address", "credit_card"))
_scan("scan_url", PAGES, ("url",))
_scan("scan_iban_mod97", MADE["iban"], ("iban",))
for _c in COUNTRIES:
    _scan(f"scan_vat_{_c.lower()}", MADE["vat"], ("vat",), _c)
    _scan(f"scan_phone_{_c.lower()}", MADE["phone"], ("phone",), _c)
_scan("scan_matricule", MADE["numbers"], ("matricule",))
_scan("scan_card_luhn", MADE["numbers"], ("credit_card",))
_scan("scan_nhs", MADE["numbers"], ("uk_nhs",), "UK")
_scan("scan_steuer_id", MADE["numbers"], ("de_steuer_id",), "DE")
_scan("scan_amount", MADE["amount"], ("amount",))
_scan("scan_date", MADE["date"], ("date",))
_scan("scan_ip", MADE["network"], ("ip_address",))
_scan("scan_mac", MADE["network"], ("mac_address",))
_scan("scan_database_uri", MADE["network"], ("database_uri",))
_scan("scan_crypto", MADE["network"], ("crypto",))
_scan("scan_bic", MADE["bic"], ("bic",))
_scan("scan_nif", MADE["nif"], ("es_nif",), "ES")
_scan("scan_postal", MADE["nif"], ("postal_code",))
_scan("scan_address", MADE["nif"], ("address",), "FR")
for _c in COUNTRIES:
    _scan(f"scan_hard_{_c.lower()}", MADE["hard"], tuple(PII_CATEGORIES), _c)
_scan("country_gate", MADE["vat"], ("vat", "es_nif", "matricule"), "ES")


@query("checksum_filter", _preview(f"SELECT * FROM ({scan_sql(MADE['iban'], only('iban'), 'LU')}) WHERE confidence = 1.0"))
def checksum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.preview_matches(resolve.reject_failed_checksums(patterns.scan_patterns(source(spark, sf_dir, MADE["iban"]), only("iban"))))


@query("allow_antijoin", _preview(f"SELECT * FROM ({scan_sql(MADE['mail'], only('email'), 'LU')}) WHERE lower(original) <> 'info@gmail.com' AND NOT regexp_matches(original, '(?i)muller3@')"))
def allow_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = Allowlist(["INFO@gmail.com", "regex:muller3@", "regex:("])
    return diagnose.preview_matches(patterns.scan_patterns(source(spark, sf_dir, MADE["mail"]), only("email")).where(~allow.matches("original")))


@query("span_places", f"SELECT doc_ord, category, original, CAST(start AS int) AS start FROM ({scan_sql(PAGES, only('email', 'url'), 'LU')})")
def span_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.scan_patterns(source(spark, sf_dir, PAGES), only("email", "url")).select("doc_ord", "category", "original", "start")


@query("custom_pattern", f"SELECT m AS original, count(*) AS matches FROM (SELECT unnest(regexp_extract_all(text, 'PRJ-[0-9]+')) AS m FROM ({MADE['codes']})) GROUP BY m")
def custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.scan_custom(source(spark, sf_dir, MADE["codes"]), ["PRJ-[0-9]+", "(broken", "(?=x)y"]).groupBy("original").agg(F.count("*").alias("matches"))


@query("pattern_samples", f"SELECT original FROM (SELECT m AS original, min(doc_ord) AS f FROM (SELECT doc_ord, unnest(regexp_extract_all(text, 'PRJ-[0-9]+')) AS m FROM ({MADE['codes']})) GROUP BY m) ORDER BY f LIMIT 20")
def pattern_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 distinct matches: a report of that size."""
    spans = patterns.scan_custom(source(spark, sf_dir, MADE["codes"]), ["PRJ-[0-9]+"])
    return spans.groupBy("original").agg(F.min(F.struct("doc_ord", "region_ord", "start")).alias("f")).orderBy("f").limit(20).select("original")


# mails and addresses in one text: disjoint categories, so chained counting in SQL is exact
_BOTH = only("email", "url")
_CLAIMS = scan_sql(MADE["mail"], _BOTH, "LU")
_FIRST = f"""SELECT category, lower(original) AS k, count(*) AS n, min(doc_ord * 10000000 + start) AS f, arg_min(original, doc_ord * 10000000 + start) AS original FROM ({_CLAIMS}) GROUP BY category, lower(original)"""
_NUMBERED = f"SELECT category, original, k, n, concat('[', CASE category WHEN 'email' THEN 'EMAIL' ELSE 'URL' END, '_', CAST(row_number() OVER (PARTITION BY category ORDER BY f) AS varchar), ']') AS placeholder FROM ({_FIRST})"


def _mail_run(spark: SparkSession, sf_dir: str) -> run.Result:
    return run.anonymise(source(spark, sf_dir, MADE["mail"]), run.Config(selection=_BOTH))


@query("registry_assign", f"SELECT category, original, placeholder, CAST(n AS bigint) AS count FROM ({_NUMBERED})")
def registry_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_run(spark, sf_dir).registry.select("category", "original", "placeholder", "count")


@query("mapping_export", f"SELECT original, placeholder, category, CAST(n AS bigint) AS count FROM ({_NUMBERED}) ORDER BY category, length(placeholder), placeholder")
def mapping_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.export(_mail_run(spark, sf_dir).registry)


@query("registry_rename_forget", f"""WITH f AS ({_FIRST}), old AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f) AS r FROM f WHERE f < 40000000),
    known AS (SELECT category, original, k, CASE WHEN category = 'email' AND r = 1 THEN 9 ELSE r END AS number, category = 'email' AND r = 1 AS overridden FROM old WHERE NOT (category = 'email' AND r = 2)),
    fresh AS (SELECT f.category, f.original, (SELECT count(*) FROM old WHERE old.category = f.category) + row_number() OVER (PARTITION BY f.category ORDER BY f.f) AS n FROM f WHERE f.k NOT IN (SELECT k FROM known)),
    everything AS (SELECT category, original, number, overridden FROM known UNION ALL SELECT category, original, CASE WHEN category = 'email' AND n >= 9 THEN n + 1 ELSE n END, false FROM fresh)
    SELECT original, concat('[', CASE category WHEN 'email' THEN 'EMAIL' ELSE 'URL' END, '_', CAST(number AS varchar), ']') AS placeholder, category, overridden FROM everything""")
def registry_rename_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overridden and a retired number, then a second run: both numbers stay free of new originals."""
    regions = source(spark, sf_dir, MADE["mail"])
    first = run.anonymise(regions.where("doc_ord <= 3"), run.Config(selection=_BOTH))
    name = first.registry.where("placeholder = '[EMAIL_1]'").first().original
    book = registry.set_placeholder(first.registry, registry.no_retired(spark), name, "[EMAIL_9]")
    gone = book.where("placeholder = '[EMAIL_2]'").first().original
    book, retired = registry.forget(book, registry.no_retired(spark), gone)
    return run.anonymise(regions, run.Config(selection=_BOTH), entries=book, retired=retired).registry.select("original", "placeholder", "category", "overridden")


@query("registry_entries", f"SELECT original, CAST(row_number() OVER (ORDER BY octet_length(encode(original)) DESC, category, length(placeholder), placeholder) AS bigint) AS place FROM ({_NUMBERED})")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest first (bytes). The places are numbered here only to be compared."""
    from ..operators.numbering import numbered

    rows = registry.entries(_mail_run(spark, sf_dir).registry).withColumn("_b", -F.octet_length("original")).withColumn("_l", F.length("placeholder"))
    return numbered(rows, ["_b", "category", "_l", "placeholder"], "place").select("original", (F.col("place") + 1).alias("place"))


@query("occurrence_spellings", f"SELECT c.doc_ord, n.placeholder, list(CASE WHEN c.original = n.original THEN '' ELSE c.original END ORDER BY c.start) AS spellings FROM ({_CLAIMS}) c JOIN ({_NUMBERED}) n ON n.k = lower(c.original) GROUP BY ALL HAVING bool_or(c.original <> n.original)")
def occurrence_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _mail_run(spark, sf_dir)
    return rewrite.occurrence_spellings(done.spans.where("kept"), done.registry)


@query("detected_categories", f"SELECT category FROM ({_CLAIMS}) GROUP BY category")
def detected_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.detected_categories(_mail_run(spark, sf_dir).documents)


@query("report_by_category", f"SELECT category, CAST(count(*) AS bigint) AS replaced FROM ({_CLAIMS}) GROUP BY category")
def report_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.counts_by_document(_mail_run(spark, sf_dir).documents).where("category IS NOT NULL AND doc_ord IS NOT NULL").groupBy("category").agg(F.sum("replaced").alias("replaced"))


@query("report_by_document", f"SELECT coalesce(doc_ord, -1) AS doc_ord, coalesce(category, 'all') AS category, CAST(count(*) AS bigint) AS replaced FROM ({_CLAIMS}) GROUP BY ROLLUP (doc_ord, category)")
def report_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.counts_by_document(_mail_run(spark, sf_dir).documents)
    return rows.select(F.coalesce("doc_ord", F.lit(-1).cast("long")).alias("doc_ord"), F.coalesce("category", F.lit("all")).alias("category"), "replaced")


@query("value_report", f"SELECT original, placeholder, category, CAST(n AS bigint) AS replaced FROM ({_NUMBERED})")
def value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _mail_run(spark, sf_dir)
    return diagnose.value_report(done.documents, done.registry)


def _numbered_sql(claims: str, labels: dict[str, str]) -> str:
    """SQL for (k, placeholder): originals numbered by category in the order in which they are first seen."""
    first = f"SELECT category, lower(original) AS k, min((doc_ord, start)) AS f FROM ({claims}) GROUP BY ALL"
    label = " ".join(f"WHEN '{c}' THEN '{x}'" for c, x in labels.items())
    return f"SELECT k, concat('[', CASE category {label} END, '_', CAST(row_number() OVER (PARTITION BY category ORDER BY f) AS varchar), ']') AS placeholder FROM ({first})"


def _spliced_sql(sql: str, claims: str, numbered: str) -> str:
    """SQL for (doc_ord, anonymised): the texts of ``sql`` with disjoint claims written over."""
    return f"""WITH n AS ({numbered}), s AS (SELECT c.doc_ord, c.start, c.original, n.placeholder FROM ({claims}) c JOIN n ON n.k = lower(c.original)),
    d AS (SELECT doc_ord, text FROM ({sql})),
    p AS (SELECT s.doc_ord, s.start, substr(d.text, CAST(coalesce(lag(s.start + length(s.original)) OVER w, 0) + 1 AS bigint), CAST(s.start - coalesce(lag(s.start + length(s.original)) OVER w, 0) AS bigint)) || s.placeholder AS piece,
          s.start + length(s.original) AS done FROM s JOIN d USING (doc_ord) WINDOW w AS (PARTITION BY s.doc_ord ORDER BY s.start))
    SELECT d.doc_ord, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(p.piece, '' ORDER BY p.start), '') || substr(any_value(d.text), CAST(coalesce(max(p.done), 0) + 1 AS bigint)) END AS anonymised FROM d LEFT JOIN p USING (doc_ord) GROUP BY d.doc_ord"""


@query("anonymise_text", _spliced_sql(MADE["mail"], _CLAIMS, _NUMBERED))
def anonymise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_run(spark, sf_dir).documents.select("doc_ord", "anonymised")


_DISJOINT = ("email", "mac_address")
_IN_DOCS = scan_sql(DOCS, only(*_DISJOINT), "LU")


@query("anonymise_documents_disjoint", _spliced_sql(DOCS, _IN_DOCS, _numbered_sql(_IN_DOCS, {"email": "EMAIL", "mac_address": "MAC"})))
def anonymise_documents_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over every document with categories that can't overlap."""
    return run.anonymise(source(spark, sf_dir, DOCS), run.Config(selection=only(*_DISJOINT))).documents.select("doc_ord", "anonymised")


@query("leak_check", f"SELECT doc_ord, lower(original) AS original FROM ({_CLAIMS}) WHERE doc_ord % 10 = 0 GROUP BY ALL")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document keeps its source text: just its originals must be told."""
    done = _mail_run(spark, sf_dir)
    planted = done.documents.withColumn("anonymised", F.when(F.col("doc_ord") % 10 == 0, F.col("text")).otherwise(F.col("anonymised")))
    return rewrite.leaks(planted, done.registry).select("doc_ord", F.lower("original").alias("original"))


@query("leak_free", "SELECT CAST(0 AS bigint) AS leaks")
def leak_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _mail_run(spark, sf_dir)
    return rewrite.leaks(done.documents, done.registry).agg(F.count("*").alias("leaks"))


@query("post_pass", f"SELECT doc_ord, regexp_replace(text, '(?i)\\bfirm3\\b', '[ENTITY_1]', 'g') AS anonymised FROM ({MADE['mail']})")
def post_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = registry.from_entries(spark, [("entity_names", "FIRM3", "[ENTITY_1]", 1)])
    return rewrite.post_pass(source(spark, sf_dir, MADE["mail"]).withColumn("anonymised", F.col("text")), book).select("doc_ord", "anonymised")


_CLAIMED = """SELECT c_custkey AS doc_ord, CAST(0 AS bigint) AS region_ord, 0 AS start, 7 AS end, concat('Name ', CAST(c_custkey % 40 AS string)) AS original, CAST(NULL AS string) AS main_text,
    CASE WHEN c_custkey % 3 = 0 THEN 'entity_names' WHEN c_custkey % 3 = 1 THEN 'person_names' ELSE 'brand_names' END AS category, 0.5D + (c_custkey % 5) / 10.0D AS confidence, true AS checksum_ok,
    CASE WHEN c_custkey % 7 = 0 THEN 'user_defined' ELSE 'rules_discovered' END AS match_class FROM customer"""


@query("unify_ownership", """WITH c AS (SELECT c_custkey % 40 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'entity_names' WHEN c_custkey % 3 = 1 THEN 'person_names' ELSE 'brand_names' END AS category,
      CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 3 END AS rank, 0.5 + (c_custkey % 5) / 10.0 AS confidence FROM customer)
    SELECT owner_key, category FROM (SELECT concat('name ', CAST(k AS varchar)) AS owner_key, category, row_number() OVER (PARTITION BY k ORDER BY rank, confidence DESC, category) AS r FROM c) WHERE r = 1""")
def unify_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, _CLAIMED)
    return resolve.unify_ownership(patterns.finished(rows)).select("owner_key", "category").distinct()


_RESOLVE = "SELECT l_orderkey AS doc_ord, CAST(0 AS bigint) AS region_ord, CAST(l_suppkey % 40 AS int) AS start, CAST(l_suppkey % 40 + l_quantity AS int) AS end, concat(CAST(l_partkey AS string), '-', CAST(l_linenumber AS string)) AS original, CAST(NULL AS string) AS main_text, concat('c', CAST(l_linenumber AS string)) AS category, 0.5D + l_discount AS confidence, true AS checksum_ok, CASE WHEN l_linenumber % 3 = 0 THEN 'built_in_pattern' WHEN l_linenumber % 3 = 1 THEN 'user_defined' ELSE 'rules_discovered' END AS match_class FROM lineitem"


@query("resolve_overlaps", """WITH RECURSIVE s AS (SELECT doc, r, s, e, o FROM (SELECT l_orderkey AS doc, CAST(l_suppkey % 40 AS int) AS s, CAST(l_suppkey % 40 + l_quantity AS int) AS e, concat(CAST(l_partkey AS varchar), '-', CAST(l_linenumber AS varchar)) AS o,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 3 = 1 THEN 2 ELSE 3 END, l_discount DESC, length(concat(CAST(l_partkey AS varchar), '-', CAST(l_linenumber AS varchar))) DESC, l_suppkey % 40, l_linenumber, CAST(l_suppkey % 40 + l_quantity AS int), concat(CAST(l_partkey AS varchar), '-', CAST(l_linenumber AS varchar))) AS r FROM lineitem)),
    k AS (SELECT doc, r, s, e, o, [struct_pack(a := s, b := e)] AS held, true AS kept FROM s WHERE r = 1
      UNION ALL SELECT s.doc, s.r, s.s, s.e, s.o, CASE WHEN len(list_filter(k.held, lambda x: s.s < x.b AND x.a < s.e)) > 0 THEN k.held ELSE list_append(k.held, struct_pack(a := s.s, b := s.e)) END, len(list_filter(k.held, lambda x: s.s < x.b AND x.a < s.e)) = 0 FROM k JOIN s ON s.doc = k.doc AND s.r = k.r + 1)
    SELECT doc AS doc_ord, o AS original, kept FROM k""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_overlaps(patterns.finished(source(spark, sf_dir, _RESOLVE))).select("doc_ord", "original", "kept")


@query("resolve_overlaps_native", f"SELECT doc_ord, original FROM ({ORACLE['resolve_overlaps']}) WHERE kept")
def resolve_overlaps_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_overlaps_native(patterns.finished(source(spark, sf_dir, _RESOLVE))).select("doc_ord", "original")


@query("overlap_warnings", f"SELECT DISTINCT concat('c', split_part(original, '-', 2)) AS category, original FROM ({ORACLE['resolve_overlaps']}) WHERE NOT kept ORDER BY category, original LIMIT 50")
def overlap_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.overlap_warnings(resolve.resolve_overlaps(patterns.finished(source(spark, sf_dir, _RESOLVE))))


def _values(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], values.VALUES)


_FIRMS = [("entity_names", f"Firm{i} S.A.", [], False, ["manual"], None) for i in range(11)]


@query("value_match", f"SELECT concat('Firm', CAST(i AS varchar), ' S.A.') AS main_text, m AS original, count(*) AS matches FROM (SELECT i, unnest(regexp_extract_all(text, concat('(?i)\\bfirm', CAST(i AS varchar), '\\b'))) AS m FROM ({MADE['mail']}), range(0, 11) t(i)) GROUP BY ALL")
def value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = values.detect_values(source(spark, sf_dir, MADE["mail"]), _values(spark, _FIRMS))
    return spans.groupBy("main_text", "original").agg(F.count("*").alias("matches"))


@query("term_count", f"SELECT t AS term, count(m) AS matches, count(DISTINCT CASE WHEN m IS NOT NULL THEN doc_ord END) AS documents FROM (SELECT t, doc_ord, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS m FROM (SELECT t, doc_ord, regexp_extract_all(text, concat('(?i)\\b', t, '\\b')) AS x FROM ({DOCS}), (VALUES ('the'), ('And'), ('not there')) v(t))) GROUP BY t")
def term_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.count_terms(source(spark, sf_dir, DOCS), ["the", "And", "not there"])


@query("spelling_expand", "SELECT * FROM (VALUES ('person_names', 'Jean de la Croix', 'Croix'), ('person_names', 'Jean de la Croix', 'J. de la Croix'), ('person_names', 'Jean de la Croix', 'J.de la Croix'), ('person_names', 'Jean de la Croix', 'Jean'), ('person_names', 'Jean de la Croix', 'Jean de la Croix'), ('person_names', 'Jean de la Croix', 'Jean-de-la-Croix'), ('person_names', 'Jean de la Croix', 'de la Croix'), ('entity_names', 'Alpine Trust S.A.', 'Alpine Trust'), ('entity_names', 'Alpine Trust S.A.', 'Alpine Trust S.A.'), ('other_names', 'Plan B SA', 'Plan B SA'), ('entity_names', 'Curated SA', 'Curated SA'), ('entity_names', 'Curated SA', 'Cur')) v(category, main_text, spelling)")
def spelling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("person_names", "Jean de la Croix", ["jean"], False, [], None), ("entity_names", "Alpine Trust S.A.", [], False, [], None), ("other_names", "Plan B SA", [], False, [], None), ("entity_names", "Curated SA", ["Cur", "ab"], True, [], None)]
    return values.spelling_rows(_values(spark, rows)).select("category", "main_text", "spelling")


_CLASH = [("entity_names", "Alpha SA", [], False, [], None), ("brand_names", "alpha sa", [], False, [], None), ("entity_names", "Beta", ["Gamma"], True, [], None), ("entity_names", "Delta", ["gamma"], True, [], None), ("country_names", "Luxembourg", [], False, [], None)]


@query("conflict_duplicate", "SELECT CAST(1 AS bigint) AS value_ord, 'alpha sa' AS main_text, 'brand_names' AS category, 'entity_names' AS other")
def conflict_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.duplicate_values(_values(spark, _CLASH))


@query("conflict_collision", "SELECT CAST(3 AS bigint) AS value_ord, 'gamma' AS spelling, 'Delta' AS main_text, 'Beta' AS other")
def conflict_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.spelling_collisions(_values(spark, _CLASH))


@query("conflict_allow", "SELECT CAST(4 AS bigint) AS value_ord, 'country_names' AS category, 'Luxembourg' AS main_text, 'drop_allow_term' AS resolution")
def conflict_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.allowlist_collisions(_values(spark, _CLASH), Allowlist(["luxembourg"]))


@query("filter_removed", "SELECT * FROM (VALUES ('Beta'), ('Delta'), ('Luxembourg')) v(main_text)")
def removed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("ALPHA SA", ["x"])], "main_text string, spellings array<string>")
    return filter_removed(_values(spark, _CLASH), gone).select("main_text")


@query("intersections", """WITH v AS (SELECT p_partkey AS doc, p_partkey % 20 AS k, CASE WHEN p_partkey % 20 < 12 THEN 5 ELSE 30 END AS s FROM part)
    SELECT 'entity_names' AS category, concat('V', CAST(k AS varchar)) AS main_text, count(*) AS occurrences, 'a@b.c' AS winners, array_to_string(list_slice(list_sort(list(doc)), 1, 3), ',') AS documents FROM v GROUP BY k HAVING bool_and(s = 5)""")
def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "CAST(0 AS bigint) AS region_ord, true AS checksum_ok, 0.9D AS confidence"
    v = source(spark, sf_dir, f"SELECT p_partkey AS doc_ord, {base}, CASE WHEN p_partkey % 20 < 12 THEN 5 ELSE 30 END AS start, CASE WHEN p_partkey % 20 < 12 THEN 9 ELSE 34 END AS end, 'entity_names' AS category, 'x' AS original, concat('V', CAST(p_partkey % 20 AS string)) AS main_text, 'user_defined' AS match_class FROM part")
    w = source(spark, sf_dir, f"SELECT p_partkey AS doc_ord, {base}, 0 AS start, 12 AS end, 'email' AS category, 'a@b.c' AS original, CAST(NULL AS string) AS main_text, 'built_in_pattern' AS match_class FROM part")
    rows = diagnose.intersections(patterns.finished(v), patterns.finished(w))
    return rows.select("category", "main_text", "occurrences", F.array_join("winners", ",").alias("winners"), F.array_join(F.transform("documents", lambda d: d.cast("string")), ",").alias("documents"))


@query("registry_restore", f"SELECT original, placeholder, category, CAST(regexp_extract(placeholder, '([0-9]+)\\]', 1) AS bigint) AS number FROM ({_NUMBERED})")
def registry_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry built again from its exported mapping."""
    mapping = registry.export(_mail_run(spark, sf_dir).registry)
    return registry.restored(mapping).select("original", "placeholder", "category", "number")


@query("defined_terms", "SELECT n_nationkey AS doc_ord, replace(t, '_', '') AS term, i AS idiom FROM (SELECT n_nationkey, concat(n_name, ' Party') AS t, 'means' AS i FROM nation UNION ALL SELECT n_nationkey, 'Both', 'means' FROM nation UNION ALL SELECT n_nationkey, concat(n_name, ' Assembly'), 'parenthetical' FROM nation)")
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_defined_terms(source(spark, sf_dir, MADE["terms"])).select("doc_ord", "term", "idiom")


@query("defined_term_forms", "SELECT n_name AS term, concat(n_name, CASE WHEN regexp_matches(lower(n_name), '(?:s|x|z|ch|sh)$') THEN 'es' WHEN regexp_matches(lower(n_name), '[^aeiou ]y$') THEN '' ELSE 's' END) AS plural FROM nation WHERE NOT regexp_matches(lower(n_name), '[^aeiou ]y$')")
def term_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "SELECT n_name AS term FROM nation").where("NOT lower(term) RLIKE '[^aeiou ]y$'")
    return rows.select("term", F.element_at(defined_term_forms(F.col("term")), 4).alias("plural"))


@query("codes", f"""SELECT main_text, CASE WHEN max(k) = 2 THEN 'project_names' ELSE 'identifier_names' END AS category, count(*) AS n, max(CASE WHEN k > 0 THEN 0.85 ELSE 0.7 END) AS confidence
    FROM (SELECT regexp_extract(text, 'PRJ-[0-9]+') AS main_text, CASE doc_ord % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS k FROM ({MADE["codes"]})) GROUP BY main_text""")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discover.detect_codes(source(spark, sf_dir, MADE["codes"]))
    rows = found.groupBy("main_text").agg(F.bool_or(F.col("category") == "project_names").alias("p"), F.sum("count").alias("n"), F.max("confidence").alias("confidence"))
    return rows.select("main_text", F.when(F.col("p"), "project_names").otherwise("identifier_names").alias("category"), "n", "confidence")


@query("signal_org_seeds", "SELECT concat('firm', CAST(c_custkey % 11 AS varchar)) AS folded, count(DISTINCT c_custkey) AS documents FROM customer GROUP BY c_custkey % 11")
def signal_org_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.email_organisation_seeds(source(spark, sf_dir, MADE["mail"])).select("folded", "documents")


@query("signal_person_seeds", "SELECT concat('jean muller', CAST(c_custkey % 7 AS varchar)) AS folded, count(DISTINCT c_custkey) AS documents FROM customer GROUP BY c_custkey % 7")
def signal_person_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.email_person_seeds(source(spark, sf_dir, MADE["mail"])).select("folded", "documents")


@query("signal_website_seeds", "SELECT concat('site', CAST(c_custkey % 5 AS varchar)) AS folded, count(DISTINCT c_custkey) AS documents FROM customer GROUP BY c_custkey % 5")
def signal_website_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.website_seeds(source(spark, sf_dir, MADE["mail"])).select("folded", "documents")


@query("signal_matches", "SELECT 'person_names' AS category, concat('Jean Muller', CAST(c_custkey % 7 AS varchar)) AS main_text, 'Jean' AS forms, count(*) AS n FROM customer GROUP BY c_custkey % 7 UNION ALL SELECT 'entity_names', concat('Firm', CAST(c_custkey % 11 AS varchar), ' and Jean Muller', CAST(c_custkey % 7 AS varchar)), '', count(*) FROM customer GROUP BY c_custkey % 11, c_custkey % 7")
def signal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with their bare forms, organisations to the end of their names."""
    docs = source(spark, sf_dir, MADE["mail"])
    found = discover.email_person_seeds(docs).unionByName(discover.email_organisation_seeds(docs))
    rows = discover.find_seeds(docs, found, discover.EMAIL)
    forms = F.array_join(F.filter("spellings", lambda x: ~x.startswith("Muller")), ",")
    return rows.select("category", "main_text", forms.alias("forms"), F.col("count").alias("n"))


@query("signal_bare_stems", "SELECT concat('Acme', CAST(k AS varchar), CASE WHEN k % 2 = 0 THEN ' Holdings' ELSE '' END) AS main_text, CASE WHEN k % 2 = 0 THEN n ELSE 2 * n END AS n FROM (SELECT s_suppkey % 6 AS k, count(*) AS n FROM supplier GROUP BY s_suppkey % 6)")
def signal_bare_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare organisation word goes where a longer name built on it stands."""
    docs = source(spark, sf_dir, "SELECT s_suppkey AS doc_ord, concat('ask x.y@acme', CAST(s_suppkey % 6 AS string), '.com; Acme', CAST(s_suppkey % 6 AS string), ' said so, Acme', CAST(s_suppkey % 6 AS string), CASE WHEN s_suppkey % 2 = 0 THEN ' Holdings' ELSE '' END, ' paid') AS text FROM supplier")
    return discover.find_seeds(docs, discover.email_organisation_seeds(docs), discover.EMAIL).select("main_text", F.col("count").alias("n"))


@query("evidence", "SELECT concat('firm', CAST(c_custkey % 11 AS varchar)) AS folded, 'email_domain' AS kind, 'email' AS signal_category, concat('jean.muller', CAST(c_custkey % 7 AS varchar), '@mail.firm', CAST(c_custkey % 11 AS varchar), '.co.uk') AS signal_text, array_to_string(list_slice(list_sort(list(c_custkey)), 1, 3), ',') AS documents FROM customer WHERE c_custkey % 7 < 3 GROUP BY c_custkey % 11, c_custkey % 7")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to a seed: three signals with three documents at most."""
    rows = discover.email_organisation_seeds(source(spark, sf_dir, MADE["mail"])).select("folded", F.explode("evidence").alias("e"))
    return rows.select("folded", "e.kind", "e.signal_category", "e.signal_text", F.array_join(F.transform("e.documents", lambda d: d.cast("string")), ",").alias("documents"))


_SUGGEST = "SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN concat('Unit', CAST(p_partkey % 30 AS string)) WHEN 1 THEN concat('UNIT', CAST(p_partkey % 30 AS string)) WHEN 2 THEN concat('Unit', CAST(p_partkey % 30 AS string), ' Group') ELSE concat('The Unit', CAST(p_partkey % 30 AS string), ' Group of ', CAST(p_partkey % 3 AS string)) END AS main_text, 'entity_names' AS category, CAST(p_size AS bigint) AS n FROM part"


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, _SUGGEST)
    return rows.select("ord", "main_text", "category", F.array().cast("array<string>").alias("spellings"), F.col("n").alias("count"), F.lit(0.5).alias("confidence"), F.array(F.lit("signal")).alias("methods"))


_MERGED = f"SELECT arg_min(main_text, ord) AS main_text, sum(n) AS n FROM ({_SUGGEST}) GROUP BY lower(main_text)"


@query("merge_suggestions", f"SELECT main_text, CAST(n AS bigint) AS n FROM ({_MERGED})")
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.merge_suggestions(_suggestions(spark, sf_dir)).select("main_text", F.col("count").alias("n"))


@query("family_fold", f"""WITH RECURSIVE m AS ({_MERGED}), e AS (SELECT a.main_text AS x, b.main_text AS y FROM m a JOIN m b ON length(a.main_text) < length(b.main_text) AND regexp_matches(lower(b.main_text), concat('\\b', lower(a.main_text), '\\b'))),
    u AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT main_text, main_text FROM m), r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
    c AS (SELECT x, min(y) AS c FROM r GROUP BY x), g AS (SELECT c.c, m.main_text, m.n FROM c JOIN m ON m.main_text = c.x)
    SELECT first(main_text ORDER BY length(main_text), n DESC, main_text) AS main_text, CAST(sum(n) AS bigint) AS n FROM g GROUP BY c""")
def family_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.fold_families(discover.merge_suggestions(_suggestions(spark, sf_dir))).select("main_text", F.col("count").alias("n"))


@query("categories", """SELECT * FROM (VALUES ('email', 'EMAIL', true), ('url', 'URL', true), ('iban', 'IBAN', true), ('vat', 'VAT', true), ('matricule', 'NATIONAL_ID', false), ('phone', 'PHONE', true),
    ('amount', 'AMOUNT', false), ('date', 'DATE', false), ('credit_card', 'CREDIT_CARD', true), ('uk_nhs', 'NHS', false), ('ip_address', 'IP', true), ('mac_address', 'MAC', true), ('crypto', 'CRYPTO', true),
    ('database_uri', 'DB_URI', true), ('de_steuer_id', 'DE_TAX_ID', false), ('es_nif', 'ES_NIF', false), ('bic', 'BIC', true), ('postal_code', 'POSTAL_CODE', false), ('address', 'ADDRESS', false),
    ('entity_names', 'ENTITY', true), ('project_names', 'PROJECT', true), ('product_names', 'PRODUCT', true), ('brand_names', 'BRAND', true), ('person_names', 'PERSON', true), ('identifier_names', 'ID', true),
    ('other_names', 'OTHER', false), ('custom_patterns', 'CUSTOM', true), ('country_names', 'COUNTRY', false), ('nationality_names', 'NATIONALITY', false), ('business_sector_names', 'BUSINESS_SECTOR', false)) v(category, label, standard_fr)""")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = depth_selection("standard", "FR")
    return spark.createDataFrame([(c, LABELS[c], on[c]) for c in PII_CATEGORIES + VALUE_CATEGORIES], "category string, label string, standard_fr boolean")


@query("presets", """SELECT * FROM (VALUES ('soft', 'LU', 12, 4), ('standard', 'LU', 12, 7), ('thorough', 'LU', 16, 11), ('soft', 'FR', 11, 4), ('standard', 'FR', 11, 7), ('thorough', 'FR', 15, 11), ('soft', 'DE', 12, 4), ('standard', 'DE', 12, 7), ('thorough', 'DE', 16, 11), ('soft', 'ES', 12, 4), ('standard', 'ES', 12, 7), ('thorough', 'ES', 16, 11), ('soft', 'UK', 12, 4), ('standard', 'UK', 12, 7), ('thorough', 'UK', 16, 11)) v(depth, country, n_patterns, n_names)""")
def preset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pattern and name categories each depth turns on, and that the depth is found again from its selection."""
    rows = []
    for c in COUNTRIES:
        for d in DEPTHS:
            on = depth_selection(d, c)
            rows.append((d, c, sum(on[x] for x in PII_CATEGORIES), sum(on[x] for x in VALUE_CATEGORIES)))
    return spark.createDataFrame(rows, "depth string, country string, n_patterns int, n_names int")


@query("match_classes", "SELECT * FROM (VALUES ('A B', 'user_defined', 0.95), ('C D', 'rules_discovered', 0.5), ('E F', 'local_llm_discovered', 0.95), ('G H', 'user_defined', 0.95), ('I J', 'rules_discovered', 0.7)) v(main_text, match_class, confidence)")
def match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest method decides the class; no score of its own means that of a declared value."""
    rows = [("other_names", "A B", [], True, ["manual", "signal"], None), ("other_names", "C D", [], True, ["local_llm", "signal"], 0.5), ("other_names", "E F", [], True, ["local_llm"], 0.0), ("other_names", "G H", [], True, [], None), ("other_names", "I J", [], True, ["heuristic"], 0.7)]
    return values.spelling_rows(_values(spark, rows)).select("main_text", "match_class", F.col("confidence").cast("decimal(3,2)").cast("double").alias("confidence"))


_OWNED = """SELECT concat('name ', CAST(k AS varchar)) AS owner_key, category, first_value(category) OVER (PARTITION BY k ORDER BY rank, confidence DESC, category) AS owner FROM (SELECT c_custkey % 40 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'entity_names' WHEN c_custkey % 3 = 1 THEN 'person_names' ELSE 'brand_names' END AS category,
      CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 3 END AS rank, 0.5 + (c_custkey % 5) / 10.0 AS confidence FROM customer)"""


@query("ownership_losses", f"SELECT DISTINCT owner AS category, category AS owned_from, owner_key FROM ({_OWNED}) WHERE owner <> category ORDER BY owner_key, owned_from LIMIT 50")
def ownership_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 50 rows: strings that changed hands."""
    rows = source(spark, sf_dir, _CLAIMED)
    return resolve.ownership_losses(resolve.unify_ownership(patterns.finished(rows)))


@query("grid_markdown", "SELECT n_regionkey AS doc_ord, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(n_nationkey AS varchar) || ' | ' || replace(n_name, '_', chr(92) || '|') || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation GROUP BY n_regionkey")
def grid_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = source(spark, sf_dir, "SELECT n_regionkey AS doc_ord, n_nationkey AS k, array(CAST(n_nationkey AS string), replace(n_name, '_', '|')) AS r FROM nation")
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]))
    return cells.groupBy("doc_ord").agg(grid.alias("grid")).select("doc_ord", text_source.grid_to_markdown(F.col("grid")).alias("markdown"))


@query("tables_written_back", "SELECT n_regionkey AS doc_ord, '| key | mail |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(n_nationkey AS varchar) || ' | [EMAIL_' || CAST(r AS varchar) || '] |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS r FROM nation) GROUP BY n_regionkey")
def tables_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region, anonymised cell by cell in the order of documents and rows, and written as a table again."""
    cells = source(spark, sf_dir, "SELECT n_regionkey AS doc_ord, n_nationkey AS k, array(CAST(n_nationkey AS string), concat('m', CAST(n_nationkey AS string), '@x.lu')) AS r FROM nation")
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("mail"))), F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]))
    documents = cells.groupBy("doc_ord").agg(grid.alias("grid")).withColumn("text", F.lit(None).cast("string"))
    done = run.anonymise(run.regions_of(documents), run.Config(selection=only("email")))
    return run.written_back(done.documents).select("doc_ord", F.col("anonymised").alias("markdown"))


@query("allow_composed", f"SELECT category, original, count(*) AS matches, count(DISTINCT doc_ord) AS documents, min(confidence) AS confidence FROM ({scan_sql(MADE['mail'], only('email', 'url'), 'LU')}) WHERE lower(original) NOT IN ('info@gmail.com') AND lower(original) NOT IN (SELECT concat('jean.muller', CAST(n_nationkey % 7 AS varchar), '@mail.firm', CAST(n_nationkey AS varchar), '.co.uk') FROM nation) AND lower(original) <> 'www.site1.public.lu/x' GROUP BY category, original")
def allow_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's terms, removed values and defined terms as one list, the latter two as tables."""
    removed = source(spark, sf_dir, "SELECT concat('Jean.Muller', CAST(n_nationkey % 7 AS string), '@mail.firm', CAST(n_nationkey AS string), '.co.uk') AS main_text, CAST(NULL AS array<string>) AS spellings FROM nation")
    defined = spark.createDataFrame([("WWW.site1.public.lu/x",)], "term string")
    allow = composed(["INFO@gmail.com"], removed, defined)
    return diagnose.preview_matches(filter_allowed(patterns.scan_patterns(source(spark, sf_dir, MADE["mail"]), only("email", "url")), allow))


@query("doc_units", "SELECT doc_id AS doc_ord, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS units FROM documents")
def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, DOCS).select("doc_ord", text_source.line_count(F.col("text")).cast("long").alias("units"))


@query("export_names", "SELECT n_nationkey AS doc_ord, concat(replace(n_name, '#', '_'), '.v2_anon.md') AS name FROM nation")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "SELECT n_nationkey AS doc_ord, concat(n_name, '.v2.docx') AS name FROM nation")
    return rows.select("doc_ord", text_source.export_name(F.col("name"), "md").alias("name"))


@query("chunk_units")
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.scan_chunks(chunks.units_of(source(spark, sf_dir, DOCS)), "faster", 8000)


@query("chunk_packs", """WITH RECURSIVE l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc, i, octet_length(encode(t)) AS b FROM l),
    k AS (SELECT doc, i, i AS start, b AS size FROM s WHERE i = 1 UNION ALL
      SELECT s.doc, s.i, CASE WHEN k.size + 1 + s.b <= 4000 THEN k.start ELSE s.i END, CASE WHEN k.size + 1 + s.b <= 4000 THEN k.size + 1 + s.b ELSE s.b END FROM k JOIN s ON s.doc = k.doc AND s.i = k.i + 1)
    SELECT doc AS doc_ord, CAST(start AS int) AS from_unit, CAST(max(i) AS int) AS to_unit, string_agg(t, chr(10) ORDER BY i) AS text FROM k JOIN l USING (doc, i) GROUP BY doc, start HAVING regexp_matches(string_agg(t, chr(10) ORDER BY i), '\\S')""")
def chunk_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed up to the level's size; no line is split here."""
    return chunks.scan_chunks(chunks.units_of(source(spark, sf_dir, DOCS)), "faster").select("doc_ord", "from_unit", "to_unit", "text")


@query("heuristic_names")
def heuristic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.suggestions(source(spark, sf_dir, DOCS))


@query("anonymise_documents")
def anonymise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over every document at the thorough depth."""
    return run.anonymise(source(spark, sf_dir, DOCS), run.Config(selection=depth_selection("thorough"))).documents.select("doc_ord", "anonymised")


@query("visible_suggestions", f"SELECT main_text, CAST(n AS bigint) AS n FROM ({_MERGED}) WHERE contains(lower(main_text), 'unit1')")
def visible_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.visible_suggestions(discover.merge_suggestions(_suggestions(spark, sf_dir)), "entity_names", "signal", " UNIT1")
    return rows.select("main_text", F.col("count").alias("n"))


@query("find_hits", f"SELECT doc_ord, CAST(len(regexp_extract_all(text, '(?i)the')) AS bigint) AS hits, CAST(least(len(regexp_extract_all(text, '(?i)the')), 2000) AS bigint) AS shown, CAST(len(regexp_extract_all(text, '(?i)the')) AS bigint) AS places FROM ({DOCS})")
def find_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, DOCS)
    return docs.select("doc_ord", views.count_hits("text", "The").cast("long").alias("hits"), F.size(views.find_hits("text", "The")).cast("long").alias("shown"), F.size(views.find_hits("text", "The", None)).cast("long").alias("places"))


@query("highlighted", f"SELECT n.placeholder, n.original, count(*) AS n, max(r) AS last FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord, lower(original) ORDER BY start) AS r FROM ({_CLAIMS})) c JOIN ({_NUMBERED}) n ON n.k = lower(c.original) GROUP BY ALL")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _mail_run(spark, sf_dir)
    return views.highlighted(done.documents, done.registry).groupBy("placeholder", "original").agg(F.count("*").alias("n"), F.max("nth").cast("long").alias("last"))


@query("value_places", f"SELECT c.doc_ord, CAST(c.start AS int) AS start, n.placeholder FROM ({_CLAIMS}) c JOIN ({_NUMBERED}) n ON n.k = lower(c.original)")
def value_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.value_places(source(spark, sf_dir, MADE["mail"]), _mail_run(spark, sf_dir).registry).select("doc_ord", "start", "placeholder")


@query("detect_suggestions")
def detect_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, DOCS).withColumn("name", F.lit("documents"))
    return detection.detect(docs).suggestions.select("main_text", "category", "spellings", "count", "confidence", "methods")
