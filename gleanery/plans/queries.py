"""The corpus operators as queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import DEFAULT_EXCLUDES, excluded, glob_regex
from gleanery.functions.wilson import adjust_for_design, auto_rate, format_ci, wilson_ci
from gleanery.operators.components import ensure_checkpoint_dir
from gleanery.operators import dedup, health, inventory, language, minhash, pii, sampling, semantic, simhash, text_quality
from gleanery.plans import corpus as C
from gleanery.plans.registry import query
from gleanery.report import tables
from gleanery.session import table

# --------------------------------------------------------------------- shared


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents corpus. One file is one split, so texts are dealt out before work on them."""
    frame = C.documents(table(spark, sf_dir, "documents"))
    return frame.repartition(spark.sparkContext.defaultParallelism) if frame.rdd.getNumPartitions() == 1 else frame


DOCS = "WITH docs AS (SELECT doc_id AS id, strlen(text)::BIGINT AS size, lang AS mime, source AS cluster, text FROM documents)"


def literal_rows(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


# ------------------------------------------------------------------ inventory


@query("type_distribution", f"""{DOCS} SELECT mime, count(*) AS n_files, sum(size)::BIGINT AS total_bytes, (sum(size) // count(*))::BIGINT AS avg_bytes,
  round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM docs GROUP BY mime""")
def type_distribution(spark, sf_dir):
    return inventory.type_distribution(C.documents(table(spark, sf_dir, "documents")))


EXT_SQL = """CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^\\.*[^.].*\\.[^.]+$') THEN lower(regexp_extract(path, '\\.[^./]+$')) ELSE '(no extension)' END"""
PATHS = "WITH files AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, strlen(html)::BIGINT AS size FROM pages)"


def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("size"))


@query("extension_counts", f"{PATHS} SELECT {EXT_SQL} AS extension, count(*) AS n_files FROM files GROUP BY 1")
def extension_counts(spark, sf_dir):
    return inventory.extension_counts(page_files(spark, sf_dir))


@query("dir_structure", f"""{PATHS}, per AS (SELECT CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, len(string_split(path, '/')) - 1 AS depth FROM files),
  d AS (SELECT CASE WHEN dir = '' THEN '.' ELSE dir END AS dir, count(*) AS n, max(depth) AS deep, sum(depth) AS s FROM per GROUP BY 1)
  SELECT count(*) AS n_dirs, sum(n)::BIGINT AS n_files, max(deep)::BIGINT AS max_depth, round(sum(s) / sum(n), 4)::DOUBLE AS avg_depth, max(n) AS max_breadth, round(avg(n), 4)::DOUBLE AS avg_breadth FROM d""")
def dir_structure(spark, sf_dir):
    return inventory.directory_structure(page_files(spark, sf_dir))


def _buckets_sql(value: str, source: str, buckets: list, total: bool) -> str:
    known = ", ".join(f"({k}, '{label}', {low}, {buckets[k + 1][1] if k + 1 < len(buckets) else 'NULL'})" for k, (label, low) in enumerate(buckets))
    more = f", coalesce(sum({value}), 0)::BIGINT AS total" if total else ""
    return f"SELECT b.k::INTEGER AS bucket_ord, b.label, count({value}) AS n{more} FROM (VALUES {known}) b(k, label, lo, hi) LEFT JOIN {source} ON {value} >= b.lo AND (b.hi IS NULL OR {value} < b.hi) GROUP BY 1, 2"


@query("size_histogram", f"{DOCS} {_buckets_sql('size', 'docs', inventory.SIZE_BUCKETS, True)}")
def size_histogram(spark, sf_dir):
    return inventory.size_histogram(C.documents(table(spark, sf_dir, "documents")))


@query("size_stats", f"{DOCS} SELECT count(size) AS n_files, min(size) AS min_bytes, max(size) AS max_bytes, trunc(median(size))::BIGINT AS median_bytes, round(avg(size), 2)::DOUBLE AS mean_bytes, sum(size)::BIGINT AS total_bytes FROM docs")
def size_stats(spark, sf_dir):
    return inventory.size_stats(C.documents(table(spark, sf_dir, "documents")))


NOW = "2024-06-30 00:00:00"


@query("age_histogram", f"WITH a AS (SELECT epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(o_orderdate::TIMESTAMP))::BIGINT AS age FROM orders) " + _buckets_sql("age", "a", inventory.AGE_BUCKETS, False))
def age_histogram(spark, sf_dir):
    return inventory.age_histogram(table(spark, sf_dir, "orders"), "o_orderdate", F.lit(NOW).cast("timestamp"))


@query("age_histogram_events", f"WITH a AS (SELECT epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts::TIMESTAMP))::BIGINT AS age FROM events) " + _buckets_sql("age", "a", inventory.AGE_BUCKETS, False))
def age_histogram_events(spark, sf_dir):
    return inventory.age_histogram(table(spark, sf_dir, "events"), "ts", F.lit(NOW).cast("timestamp"))


@query("age_range", "SELECT min(ts) AS oldest, max(ts) AS newest FROM events")
def age_range(spark, sf_dir):
    return inventory.age_range(table(spark, sf_dir, "events"), "ts")


GLOBS = [*DEFAULT_EXCLUDES, "*.pdf", "blog*", "[a-c]*", "*/1?"]


@query("exclude_filter", f"{PATHS} SELECT path FROM files WHERE NOT (" + " OR ".join(f"regexp_matches(path, '{glob_regex(g)}') OR len(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '{glob_regex(g)}'))) > 0" for g in GLOBS) + ")")
def exclude_filter(spark, sf_dir):
    return page_files(spark, sf_dir).where(~excluded(F.col("path"), GLOBS)).select("path")


MIME_NAMES = ["a/report.PDF", "notes.txt", "data.CSV", "x.tar.gz", ".bashrc", "dir/.hidden.json", "noext", "trailing.", "page.Html", "m.eml", "b.parquet", "a.b/c", "x.docx", "y.rs"]


def _mime_sql() -> str:
    from gleanery.sources.mime import BY_EXTENSION

    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_EXTENSION.items())
    return f"WITH f(path) AS (VALUES {literal_rows(MIME_NAMES)}) SELECT path, {EXT_SQL} AS extension, coalesce(CASE {EXT_SQL} {cases} END, 'application/octet-stream') AS mime FROM f"


@query("mime_by_extension", _mime_sql())
def mime_by_extension(spark, sf_dir):
    from gleanery.functions.paths import extension
    from gleanery.sources.mime import mime_of

    rows = spark.createDataFrame([(p,) for p in MIME_NAMES], "path string")
    return rows.select("path", extension(F.col("path")).alias("extension"), mime_of(F.col("path"), F.lit(None).cast("binary")).alias("mime"))


# ---------------------------------------------------------------------- dedup

HASHES = f"{DOCS}, h AS (SELECT id, size, sha256(text) AS hash FROM docs WHERE text IS NOT NULL), g AS (SELECT hash, size, count(*) AS n, min(id) AS first_id FROM h GROUP BY 1, 2)"


def hashes(spark, sf_dir):
    return dedup.hashed(C.documents(table(spark, sf_dir, "documents")))


@query("exact_dup_groups", f"{HASHES} SELECT hash, size, n, first_id, size * (n - 1) AS wasted_bytes FROM g WHERE n > 1")
def exact_dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(hashes(spark, sf_dir))


@query("exact_dup_members", f"{HASHES} SELECT h.id, h.hash, g.first_id FROM h JOIN g ON h.hash = g.hash AND g.n > 1")
def exact_dup_members(spark, sf_dir):
    return dedup.members(hashes(spark, sf_dir))


DEDUP_SQL = """SELECT coalesce(sum(n), 0)::BIGINT AS total_hashed, count(*) FILTER (n = 1) AS unique_files, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_files,
  coalesce(sum(size * (n - 1)) FILTER (n > 1), 0)::BIGINT AS duplicate_bytes, round(coalesce(100.0 * sum(n) FILTER (n > 1) / sum(n), 0), 4)::DOUBLE AS duplicate_pct FROM g"""


@query("dedup_summary", f"{HASHES} {DEDUP_SQL}")
def dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(hashes(spark, sf_dir))


@query("top_dup_groups", f"{HASHES} SELECT hash, size, n, first_id, size * (n - 1) AS wasted_bytes FROM g WHERE n > 1 ORDER BY wasted_bytes DESC, first_id LIMIT 10")
def top_dup_groups(spark, sf_dir):
    return dedup.top_groups(hashes(spark, sf_dir))


# --------------------------------------------------------------------- health

STATUS_SQL = "CASE WHEN text IS NULL THEN 'unreadable' WHEN size = 0 THEN 'empty' WHEN size <= 50 THEN 'near_empty' ELSE 'ok' END"


@query("text_health", f"{DOCS} SELECT id, {STATUS_SQL} AS status, coalesce(length(text) - length(replace(text, chr(65533), '')) > 0.1 * length(text), false) AS is_degraded FROM docs")
def text_health(spark, sf_dir):
    return health.text_health(C.documents(table(spark, sf_dir, "documents")))


@query("health_tally", f"""{DOCS}, s AS (SELECT {STATUS_SQL} AS status FROM docs) SELECT count(*) AS total_checked, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'empty') AS n_empty,
  count(*) FILTER (status = 'near_empty') AS n_near_empty, 0::BIGINT AS n_corrupt, 0::BIGINT AS n_encrypted, 0::BIGINT AS n_truncated, count(*) FILTER (status = 'unreadable') AS n_unreadable FROM s""")
def health_tally(spark, sf_dir):
    return health.health_tally(text_health(spark, sf_dir))


#: (path, mime, bytes as hex) and the status that the rules give them.
FILE_CASES = [
    ("empty.dat", "application/octet-stream", "", "empty"), ("tiny.dat", "application/octet-stream", "00" * 10, "near_empty"),
    ("png_as_pdf.pdf", "application/pdf", "89504e470d0a1a0a" + "00" * 60, "corrupt"), ("locked.pdf", "application/pdf", "255044462d" + "20" * 60 + b"/Encrypt".hex() + b"%%EOF".hex(), "encrypted_pdf"),
    ("cut.pdf", "application/pdf", "255044462d" + "20" * 80, "truncated"), ("good.pdf", "application/pdf", "255044462d" + "20" * 80 + b"%%EOF".hex(), "ok"),
    ("cut.jpg", "image/jpeg", "ffd8ffe0" + "00" * 80, "truncated"), ("good.jpg", "image/jpeg", "ffd8ffe0" + "00" * 80 + "ffd9", "ok"), ("good.gif", "image/gif", "474946383961" + "00" * 60, "ok"),
    ("cut.png", "image/png", "89504e47" + "00" * 80, "truncated"), ("good.png", "image/png", "89504e47" + "00" * 80 + b"IEND".hex(), "ok"), ("plain.txt", "text/plain", "61" * 60, "ok"),
]


@query("file_health", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}')" for p, _, _, s in FILE_CASES) + ") v(path, status)")
def file_health(spark, sf_dir):
    rows = spark.createDataFrame([(p, m, h) for p, m, h, _ in FILE_CASES], "path string, mime string, h string")
    files = rows.select("path", "mime", F.unhex("h").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    return health.file_health(files).select("path", "status")


# ------------------------------------------------------------------- sampling

DRAW = "md5('42|' || id::VARCHAR)"
TARGETS = f"""{DOCS}, p AS (SELECT mime, count(*) AS population FROM docs GROUP BY 1),
  t AS (SELECT mime, population, least(population, greatest(ceil(round(population * 0.1::DOUBLE, 9)), least(30, population)))::BIGINT AS target FROM p)"""


@query("stratified_targets", f"{TARGETS} SELECT * FROM t")
def stratified_targets(spark, sf_dir):
    return sampling.targets(docs(spark, sf_dir), 0.1)


@query("stratified_sample", f"{TARGETS}, r AS (SELECT id, mime, row_number() OVER (PARTITION BY mime ORDER BY {DRAW}, id) AS k FROM docs) SELECT id, mime FROM r JOIN t USING (mime) WHERE k <= target")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(docs(spark, sf_dir).select("id", "mime"), 0.1)


ALLOC = f"""{TARGETS}, c AS (SELECT mime, cluster, count(*) AS n FROM docs GROUP BY 1, 2),
  w AS (SELECT mime, cluster, n, target, least(greatest(1, round_even(n * 1.0::DOUBLE / population * target, 0)::BIGINT), n) AS want FROM c JOIN t USING (mime)),
  f AS (SELECT *, greatest(0, least(want, target - coalesce(sum(want) OVER (PARTITION BY mime ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS first FROM w),
  l AS (SELECT *, target - sum(first) OVER (PARTITION BY mime) AS rest, n - first AS room FROM f),
  a AS (SELECT mime, cluster, n, (first + greatest(0, least(room, rest - coalesce(sum(room) OVER (PARTITION BY mime ORDER BY n DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS alloc FROM l)"""


@query("dir_allocation", f"{ALLOC} SELECT * FROM a")
def dir_allocation(spark, sf_dir):
    return sampling.directory_allocation(docs(spark, sf_dir), 0.1)


@query("dir_allocated_sample", f"{ALLOC}, r AS (SELECT id, mime, cluster, row_number() OVER (PARTITION BY mime, cluster ORDER BY {DRAW}, id) AS k FROM docs) SELECT r.id, r.mime, r.cluster FROM r JOIN a USING (mime, cluster) WHERE k <= alloc")
def dir_allocated_sample(spark, sf_dir):
    return sampling.directory_sample(docs(spark, sf_dir).select("id", "mime", "cluster"), 0.1)


@query("auto_sampling_rate", "SELECT n, (CASE WHEN n <= 3000 THEN 1.0 ELSE 3000.0 / n END)::DOUBLE AS rate FROM (SELECT count(*) AS n FROM documents UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM events UNION ALL VALUES (0), (50000), (1000000))")
def auto_sampling_rate(spark, sf_dir):
    counts = None
    for name in ("documents", "lineitem", "events"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.unionByName(spark.createDataFrame([(0,), (50_000,), (1_000_000,)], "n long"))
    return counts.select("n", auto_rate(F.col("n")).alias("rate"))


DEFF = f"""{DOCS}, y AS (SELECT cluster, ln(1 + size::DOUBLE) AS v FROM docs), c AS (SELECT cluster, count(*) AS m, avg(v) AS mean, var_pop(v) * count(*) AS within FROM y GROUP BY 1),
  g AS (SELECT sum(m) AS n, count(*) AS k, sum(m * mean) / sum(m) AS grand, sum(within) AS ssw FROM c), b AS (SELECT sum(m * power(mean - grand, 2)) AS ssb FROM c, g),
  d AS (SELECT n, k, n / k::DOUBLE AS m, ssb / (k - 1) AS msb, ssw / (n - k) AS msw FROM g, b), rho AS (SELECT n::BIGINT AS n, k, m, greatest(0, (msb - msw) / (msb + (m - 1) * msw)) AS rho FROM d)"""


@query("design_effect", f"{DEFF} SELECT n, k, round(rho, 6)::DOUBLE AS rho, round(greatest(1, 1 + rho * (m - 1)), 6)::DOUBLE AS deff FROM rho")
def design_effect(spark, sf_dir):
    return sampling.design_effect(C.documents(table(spark, sf_dir, "documents"))).select("n", "k", F.round("rho", 6).alias("rho"), F.round("deff", 6).alias("deff"))


def wilson_sql(k: str, n: str, pop: str) -> tuple[str, str, str]:
    p, z2 = f"({k} / {n}::DOUBLE)", 1.96 * 1.96
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    spread = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n}::DOUBLE * {n})) / (1 + {z2} / {n}) * CASE WHEN {pop} > 1 THEN sqrt(({pop} - {n}) / ({pop} - 1)::DOUBLE) ELSE 1 END)"
    case = lambda x: f"CASE WHEN {n} <= 0 THEN 0 WHEN {n} >= {pop} THEN {p} ELSE {x} END"
    return case(p), case(f"greatest(0, {centre} - {spread})"), case(f"least(1, {centre} + {spread})")


CI_CASES = [(50, 100, 1000), (30, 100, 100), (0, 100, 1000), (0, 0, 100), (100, 100, 1000), (1, 7, 9), (3, 3000, 50000)]
_P, _LO, _HI = wilson_sql("k", "n", "pop")


@query("wilson_cases", f"""WITH v(k, n, pop) AS (VALUES {', '.join(map(str, CI_CASES))}), c AS (SELECT k::BIGINT AS k, n::BIGINT AS n, pop::BIGINT AS pop, {_P} AS p, {_LO} AS lo, {_HI} AS hi FROM v)
  SELECT k, n, pop, round(p, 6)::DOUBLE AS p, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi,
  round(CASE WHEN lo = hi THEN lo ELSE greatest(0, (lo + hi) / 2 - (hi - lo) / 2 * sqrt(2.5)) END, 6)::DOUBLE AS lo_deff, round(CASE WHEN lo = hi THEN hi ELSE least(1, (lo + hi) / 2 + (hi - lo) / 2 * sqrt(2.5)) END, 6)::DOUBLE AS hi_deff,
  CASE WHEN n >= pop THEN printf('%.1f%% (exact, N=%d)', p * 100, pop) ELSE printf('%.1f%% (CI: %.1f%% -- %.1f%%, n=%d)', p * 100, lo * 100, hi * 100, n) END AS shown FROM c""")
def wilson_cases(spark, sf_dir):
    rows = spark.createDataFrame(CI_CASES, "k long, n long, pop long")
    rows = rows.withColumn("ci", wilson_ci(F.col("k"), F.col("n"), F.col("pop"))).withColumn("wide", adjust_for_design(F.col("ci"), F.lit(2.5)))
    r = lambda c, name: F.round(c, 6).alias(name)
    return rows.select("k", "n", "pop", r("ci.p", "p"), r("ci.lo", "lo"), r("ci.hi", "hi"), r("wide.lo", "lo_deff"), r("wide.hi", "hi_deff"), format_ci(F.col("ci"), F.col("n"), F.col("pop")).alias("shown"))


# ------------------------------------------------------------------------ PII


def re2(regex: str) -> str:
    """The pattern for RE2: Unicode-aware classes, and no look-around (see ``RE2``)."""
    return regex.replace("'", "''")


#: Patterns with look-around for RE2: what may not stand before is matched as one more
#: character, and group 1 is the match. What may not follow a digit is a border (\\b).
_FREE = "(?:^|[^#\\p{L}\\p{N}_])"
LOOK_RE2 = {"phone": _FREE + "((?:\\+?1[-.\\s]?)?(?:\\(?\\d{3}\\)?[-.\\s]?)\\d{3}[-.\\s]?\\d{4}\\b)", "ssn": _FREE + "(\\d{3}-\\d{2}-\\d{4}\\b)"}


def count_sql(name: str, lines: str = "lines") -> str:
    """Accepted matches of one pattern in a list of lines."""
    found = f"flatten(list_transform({lines}, lambda x: regexp_extract_all(x, '{LOOK_RE2.get(name) or re2(pii.BY_NAME[name].regex)}'{', 1' if name in LOOK_RE2 else ''})))"
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    if name == "ssn":
        bad = ", ".join(f"'{x}'" for x in pii.TEST_SSNS)
        return f"len(list_filter({found}, lambda m: substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000' AND {d} NOT IN ({bad})))"
    if name == "credit_card":
        luhn = f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN {d}[i]::INTEGER ELSE ({d}[i]::INTEGER * 2) // 10 + ({d}[i]::INTEGER * 2) % 10 END)) % 10 = 0"
        return f"len(list_filter({found}, lambda m: length({d}) BETWEEN 13 AND 19 AND {luhn}))"
    if name == "iban":
        moved = "(substr(m, 5) || substr(m, 1, 4))"
        number = f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END)"
        return f"len(list_filter({found}, lambda m: length(m) >= 15 AND {number} = 1))"
    if name == "de_tax_id":
        each = f"list_transform(range(0, 10), lambda k: length({d}) - length(replace({d}, k::VARCHAR, '')))"
        return f"len(list_filter({found}, lambda m: length({d}) = 11 AND list_max({each}) <= 3 AND list_min({each}) = 0))"
    if name == "es_dni":
        return f"len(list_filter({found}, lambda m: m[9] = '{pii.DNI_LETTERS}'[(substr(m, 1, 8)::BIGINT % 23) + 1]))"
    return f"len({found})"


ALL_PATTERNS = list(pii.BY_NAME)


def pii_counts(spark, sf_dir, names=ALL_PATTERNS):
    return pii.count_matches(docs(spark, sf_dir), [pii.BY_NAME[n] for n in names])


def pii_counts_sql(names: list[str] = ALL_PATTERNS) -> str:
    per = ", ".join(f"{{'pattern': '{n}', 'n': {count_sql(n)}}}" for n in names)
    return f"{DOCS}, s AS (SELECT id, string_split(coalesce(text, ''), chr(10)) AS lines FROM docs), m AS (SELECT id, unnest([{per}], recursive := true) FROM s), c AS (SELECT id, pattern, n::BIGINT AS n FROM m WHERE n > 0)"


@query("pii_counts", f"{pii_counts_sql()} SELECT * FROM c")
def pii_counts_query(spark, sf_dir, names=ALL_PATTERNS):
    return pii_counts(spark, sf_dir, names)


@query("pii_matches_by_type", f"{pii_counts_sql()} SELECT pattern, sum(n)::BIGINT AS n_matches, count(*) AS n_files FROM c GROUP BY 1")
def pii_matches_by_type(spark, sf_dir, names=ALL_PATTERNS):
    return pii.type_rollup(pii_counts(spark, sf_dir, names))


@query("pii_file_rollup", f"{pii_counts_sql()} SELECT id, sum(n)::BIGINT AS n_matches, string_agg(pattern, ',' ORDER BY pattern) AS pii_types FROM c GROUP BY 1")
def pii_file_rollup(spark, sf_dir, names=ALL_PATTERNS):
    return pii.file_rollup(pii_counts(spark, sf_dir, names))


@query("pii_phone", f"{pii_counts_sql(['phone'])} SELECT * FROM c")
def pii_phone(spark, sf_dir):
    return pii_counts(spark, sf_dir, ["phone"])


@query("pii_conversations", f"WITH s AS (SELECT conv_id * 10000 + turn AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations), m AS (SELECT id, {count_sql('email')} AS n FROM s) SELECT id, 'email' AS pattern, n::BIGINT AS n FROM m WHERE n > 0")
def pii_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), "text")
    return pii.count_matches(turns, [pii.BY_NAME["email"]])


SSN_CASES = ["123-45-6789", "456-78-1234", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "123456789", "12-345-6789", "#123-45-6789", "x123-45-6789", "ssn 219-09-9999, 078-05-1120 and 321-54-9876.", "é123-45-6789"]


@query("pii_ssn", f"""WITH v(text) AS (VALUES {literal_rows(SSN_CASES)}), m AS (SELECT text AS id, {count_sql('ssn', '[text]')}::BIGINT AS n FROM v) SELECT id, 'ssn' AS pattern, n FROM m WHERE n > 0""")
def pii_ssn(spark, sf_dir):
    rows = spark.createDataFrame([(t, t) for t in SSN_CASES], "id string, text string")
    return pii.count_matches(rows, [pii.BY_NAME["ssn"]])


def _validator(name: str, cases: list[str]):
    sql = f"WITH v(text) AS (VALUES {literal_rows(cases)}), s AS (SELECT text AS id, [text] AS lines FROM v), m AS (SELECT id, {count_sql(name)} AS n FROM s) SELECT id, '{name}' AS pattern, n::BIGINT AS n FROM m WHERE n > 0"

    @query(f"pii_{name}_validate", sql)
    def run(spark, sf_dir):
        return pii.count_matches(spark.createDataFrame([(t, t) for t in cases], "id string, text string"), [pii.BY_NAME[name]])

    return run


_validator("iban", ["DE89370400440532013000", "GB29NWBK60161331926819", "DE00370400440532013000", "GB00NWBK60161331926819", "FR1420041010050500013M02606", "XX89370400440532013000", "IBAN: ES9121000418450200051332."])
_validator("de_tax_id", ["86095742719", "00000000000", "11111111111", "65929970489", "12345678901 and 86095742719"])
_validator("es_dni", ["12345678Z", "12345678A", "00000000T", "x 87654321X y"])
_validator("credit_card", ["4111111111111111", "5500000000000004", "340000000000009", "6011000000000004", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "1234567890123456"])

CONTEXT_CASES = [
    "Social Security Number: 123-45-6789", "Order reference: 123-45-6789", "It is 123-45-6789 here", "Please call 555-123-4567 now", "sku 555-123-4567", "host server at 10.0.0.1",
    "Contact: someone@example.com", "bank transfer to DE89370400440532013000",
]


@query("pii_confidence")
def pii_confidence(spark, sf_dir):
    rows = spark.createDataFrame([(t, t) for t in CONTEXT_CASES], "id string, text string")
    return pii.scored_matches(rows).select("id", "pattern", "line_no", "start", F.round("confidence", 4).alias("confidence"))


@query("pii_match_positions", f"""{DOCS}, l AS (SELECT id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM docs),
  m AS (SELECT id, line_no, line, regexp_extract_all(line, '{re2(pii.BY_NAME["email"].regex)}') AS f, string_split_regex(line, '{re2(pii.BY_NAME["email"].regex)}') AS b FROM l),
  e AS (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m WHERE len(f) > 0)
  SELECT id, line_no::INTEGER AS line_no, (list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0))::INTEGER AS start, length(f[k])::INTEGER AS n FROM e""")
def pii_match_positions(spark, sf_dir):
    return pii.matches(docs(spark, sf_dir), [pii.BY_NAME["email"]]).select("id", F.col("line_no").cast("int").alias("line_no"), F.col("start").cast("int").alias("start"), F.length("matched").alias("n"))


# ------------------------------------------------------------------- language

_SCRIPT_COUNTS = ", ".join(f"len(regexp_extract_all(t, '{language.script_class(n)}'))::BIGINT AS {language._column(n)}" for n in language.SCRIPTS)


@query("script_histogram", f"WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents) SELECT id, {_SCRIPT_COUNTS} FROM d")
def script_histogram(spark, sf_dir):
    return language.script_histogram(docs(spark, sf_dir))


def _detect_sql() -> str:
    names = list(language.SCRIPTS)
    n = {s: language._column(s) for s in names}
    top = f"greatest({', '.join(n.values())})"
    place = {s: f"CASE WHEN {n[s]} = top AND top > 0 THEN length(regexp_extract(t, '^(?s:.*?)({language.script_class(s)})')) END" for s in names}
    first = f"least({', '.join(place.values())})"
    pick = " ".join(f"WHEN {place[s]} = first THEN '{s}'" for s in names)
    votes = ", ".join("len(list_filter(words, lambda w: w IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in p.split(" ")) + ")))" for p in language.LATIN_PROFILES.values())
    latin = f"CASE WHEN list_max(v) < {language.MIN_WORDS} THEN '{language.LATIN_UNKNOWN}' " + " ".join(f"WHEN v[{k}] = list_max(v) THEN '{name}'" for k, name in enumerate(language.LATIN_PROFILES, 1)) + " END"
    other = "dominant"
    for s, (name, p) in language.OTHER_PROFILES.items():
        inside = ", ".join(f"'{x}'" for x in p.split(" "))
        other = f"CASE WHEN dominant = '{s}' THEN CASE WHEN len(list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{M}}]+'), lambda w: w IN ({inside}))) >= {language.MIN_WORDS} THEN '{name}' ELSE '{s}' END ELSE {other} END"
    return f"""WITH dd AS (SELECT doc_id AS id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
  dc AS (SELECT id, t, {_SCRIPT_COUNTS} FROM dd), ds AS (SELECT *, {top} AS top, {' + '.join(n.values())} AS total FROM dc), df AS (SELECT *, {first} AS first FROM ds), dg AS (SELECT *, CASE {pick} END AS dominant FROM df),
  dw AS (SELECT *, CASE WHEN dominant = 'Latin' THEN regexp_extract_all(lower(t), '[a-zA-Z\\x{{C0}}-\\x{{24F}}]+') ELSE []::VARCHAR[] END AS words FROM dg),
  dv AS (SELECT *, [{votes}] AS v FROM dw),
  det AS (SELECT id, CASE WHEN length(t) < 20 OR total = 0 THEN 'Unknown' WHEN top / total < 0.5 THEN 'Mixed Script' WHEN dominant IN ('CJK', 'Japanese Kana') THEN CASE WHEN n_japanese_kana > 0 THEN 'Japanese' WHEN n_hangul > 0 THEN 'Korean' ELSE 'CJK' END
    WHEN dominant = 'Hangul' THEN 'Korean' WHEN dominant = 'Latin' THEN {latin} ELSE {other} END AS language,
    CASE WHEN length(t) < 20 OR total = 0 THEN 'Unknown' WHEN top / total < 0.5 THEN 'Mixed Script' ELSE dominant END AS script FROM dv)"""


DETECT = _detect_sql()


def detected(spark, sf_dir):
    return language.detect(docs(spark, sf_dir))


def settled(df):
    """A narrow result that is read more than once, cut by a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@query("detect_language", f"{DETECT} SELECT * FROM det")
def detect_language(spark, sf_dir):
    return detected(spark, sf_dir).drop("latin_votes")


@query("stopword_scores", f"{DETECT} SELECT id, list_max(v)::INTEGER AS best, list_sum(v)::BIGINT AS total FROM dv")
def stopword_scores(spark, sf_dir):
    v = F.col("latin_votes")
    return detected(spark, sf_dir).select("id", F.array_max(v).alias("best"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("script_distribution", f"{DETECT} SELECT script, count(*) AS n_files FROM det GROUP BY 1")
def script_distribution(spark, sf_dir):
    return language.distribution(detected(spark, sf_dir), "script")


@query("language_vs_label", f"{DETECT} SELECT lang, language, count(*) AS n FROM det JOIN documents ON doc_id = id GROUP BY 1, 2")
def language_vs_label(spark, sf_dir):
    both = detected(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return both.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


PRIOR = f"""{DETECT}, per AS (SELECT language, count(*) AS n FROM det GROUP BY 1), best AS (SELECT language, n FROM per WHERE language NOT IN ('Unknown', 'Latin (Unknown)', 'Mixed Script') ORDER BY n DESC, language DESC LIMIT 1),
  prior AS (SELECT CASE WHEN n / (SELECT sum(n) FROM per) >= 0.5 THEN language END AS prior FROM best),
  cor AS (SELECT id, CASE WHEN language IN ('Unknown', 'Latin (Unknown)') THEN coalesce((SELECT prior FROM prior), language) ELSE language END AS language, script FROM det)"""


@query("corpus_prior_correction", f"{PRIOR} SELECT * FROM cor")
def corpus_prior_correction(spark, sf_dir):
    return language.correct_by_prior(settled(detected(spark, sf_dir))).drop("latin_votes")


def _ci_sql(deff: bool) -> str:
    p, lo, hi = wilson_sql("n_files", "(SELECT count(*) FROM cor)", "50000")
    if not deff:
        return f"{PRIOR}, x AS (SELECT language, count(*) AS n_files FROM cor GROUP BY 1) SELECT language, n_files, round(100 * {p}, 4)::DOUBLE AS pct, round(100 * {lo}, 4)::DOUBLE AS lo_pct, round(100 * {hi}, 4)::DOUBLE AS hi_pct FROM x"
    d = DEFF.removeprefix("WITH ")
    return f"""{PRIOR}, {d}, x AS (SELECT language, count(*) AS n_files FROM cor GROUP BY 1), ci AS (SELECT language, n_files, {p} AS p, {lo} AS lo, {hi} AS hi FROM x), e AS (SELECT greatest(1, 1 + rho * (m - 1)) AS deff FROM rho)
  SELECT language, n_files, round(100 * p, 4)::DOUBLE AS pct, round(100 * greatest(0, (lo + hi) / 2 - (hi - lo) / 2 * sqrt(deff)), 4)::DOUBLE AS lo_pct, round(100 * least(1, (lo + hi) / 2 + (hi - lo) / 2 * sqrt(deff)), 4)::DOUBLE AS hi_pct FROM ci, e"""


@query("lang_distribution_ci", _ci_sql(False))
def lang_distribution_ci(spark, sf_dir):
    """The corpus taken as a sample from 50 000 files."""
    found = language.distribution(language.correct_by_prior(settled(detected(spark, sf_dir))))
    whole = found.agg(F.sum("n_files").alias("whole"))
    return tables.rates_with_ci(found.crossJoin(F.broadcast(whole)), "language", "n_files", F.col("whole"), F.lit(50_000))  # one row


@query("lang_distribution_ci_deff", _ci_sql(True))
def lang_distribution_ci_deff(spark, sf_dir):
    found = language.distribution(language.correct_by_prior(settled(detected(spark, sf_dir))))
    whole = found.agg(F.sum("n_files").alias("whole"))
    deff = sampling.design_effect(C.documents(table(spark, sf_dir, "documents"))).select("deff")
    rows = found.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(deff))  # one row each
    rows = rows.withColumn("ci", adjust_for_design(wilson_ci(F.col("n_files"), F.col("whole"), F.lit(50_000)), F.col("deff")))
    r = lambda c, name: F.round(100 * F.col(c), 4).alias(name)
    return rows.select("language", "n_files", r("ci.p", "pct"), r("ci.lo", "lo_pct"), r("ci.hi", "hi_pct"))


# ------------------------------------------------------- mojibake, readability

DAMAGED = ["Le r\u00c3\u00a9sum\u00c3\u00a9 est pr\u00c3\u00aat \u00c3\u00a0 lire", "R\u00c3\u00a9sum\u00c3\u00a9 of qualific\u00c3\u00a9 people", "plain words that are fine", "it\u00e2\u20ac\u2122s a quote that broke", "lost \ufffd character in here", "a control \u0085 byte in the text"]
_FLAGS = {n: f"regexp_matches(t, '{r}')" for n, r in text_quality.DAMAGE.items()}


@query("mojibake_flags", f"""WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"({-1 - k}, '{t}')" for k, t in enumerate(DAMAGED))})),
  c AS (SELECT id, text AS t FROM d WHERE length(text) >= 20) SELECT id, {', '.join(f'{e} AS {n}' for n, e in _FLAGS.items())}, {' OR '.join(_FLAGS.values())} AS is_damaged FROM c""")
def mojibake_flags(spark, sf_dir):
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(DAMAGED)], "id long, text string")
    return text_quality.mojibake(docs(spark, sf_dir).select("id", "text").unionByName(more))


_W = "greatest(len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')), 1)"
_FLESCH = f"206.835 - 1.015 * ({_W} / greatest(len(regexp_extract_all(t, '[.!?]+')), 1)::DOUBLE) - 84.6 * (greatest(len(regexp_extract_all(lower(t), '[aeiouy\\x{{E0}}-\\x{{FF}}]+')), 1) / {_W}::DOUBLE)"
FLESCH = f"WITH d AS (SELECT doc_id AS id, text AS t FROM documents WHERE length(trim(text)) >= 200), f AS (SELECT id, ({_FLESCH})::DOUBLE AS flesch FROM d)"


@query("flesch_scores", f"{FLESCH} SELECT id, round(flesch, 4) AS flesch, flesch < 30 AS is_low_quality FROM f")
def flesch_scores(spark, sf_dir):
    return text_quality.readability(docs(spark, sf_dir)).select("id", F.round("flesch", 4).alias("flesch"), "is_low_quality")


@query("flesch_summary", f"{FLESCH} SELECT count(*) AS n_scored, round(avg(flesch), 1)::DOUBLE AS avg_flesch, count(*) FILTER (flesch < 30) AS n_low_quality FROM f")
def flesch_summary(spark, sf_dir):
    return text_quality.readability_summary(text_quality.readability(docs(spark, sf_dir)))


@query("html_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '[ \\t\\n\\r]*\\n[ \\t\\n\\r]*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def html_text(spark, sf_dir):
    stripped = F.regexp_replace(F.regexp_replace("html", "<[^>]+>", "\n"), "[ \\t\\n\\r]*\\n[ \\t\\n\\r]*", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(stripped, F.lit(" \t\n\r")).alias("text"))


# ------------------------------------------------------------ near duplicates

SHINGLES = f"""{DOCS}, w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM docs WHERE length(text) >= 50),
  s AS (SELECT id, CASE WHEN len(w) < 3 THEN w[i] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS shingle FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) < 3 THEN len(w) + 1 ELSE 0 END))) AS i FROM w))"""
_BITS = " || ".join(f"CASE WHEN sum(2 * ((h >> {k}) & 1)::INTEGER - 1) > 0 THEN '1' ELSE '0' END" for k in range(63, -1, -1))
FINGERPRINTS = f"""{SHINGLES}, k AS (SELECT id, ('0x' || substr(md5(shingle), 1, 16))::UBIGINT AS h FROM s), b AS (SELECT id, {_BITS} AS bits FROM k GROUP BY 1),
  fp AS (SELECT w.id, coalesce(('0b' || bits)::UBIGINT, 1) AS fp FROM w LEFT JOIN b USING (id))"""
LINKS = f"""{FINGERPRINTS}, c AS (SELECT fp, min(id) AS rep FROM fp GROUP BY 1), near AS (SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.fp, y.fp)::BIT) AS distance FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.fp, y.fp)::BIT) <= 5),
  lk AS (SELECT a, b, distance::INTEGER AS distance FROM near UNION ALL SELECT rep, id, 0 FROM fp JOIN c USING (fp) WHERE id <> rep)"""


@query("shingles", f"{SHINGLES} SELECT id, count(*) AS n, count(DISTINCT shingle) AS n_distinct, min(shingle) AS first FROM s GROUP BY 1")
def shingles(spark, sf_dir):
    return simhash.shingle_counts(docs(spark, sf_dir))


def prints(spark, sf_dir):
    return simhash.fingerprints(docs(spark, sf_dir))


@query("simhash_fp", f"{FINGERPRINTS} SELECT id, lower(lpad(to_hex(fp), 16, '0')) AS fp FROM fp")
def simhash_fp(spark, sf_dir):
    return prints(spark, sf_dir).select("id", simhash.hex16(F.col("fp")).alias("fp"))


_BITS2 = _BITS.replace("(h >>", "(h2 >>")


@query("simhash128_fp", f"""{SHINGLES}, k AS (SELECT id, ('0x' || substr(md5(shingle), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(shingle), 17, 16))::UBIGINT AS h2 FROM s), b AS (SELECT id, {_BITS} AS bits, {_BITS2} AS bits2 FROM k GROUP BY 1)
  SELECT w.id, lower(lpad(to_hex(coalesce(('0b' || bits)::UBIGINT, 0)), 16, '0')) || lower(lpad(to_hex(coalesce(('0b' || bits2)::UBIGINT, 1)), 16, '0')) AS fp FROM w LEFT JOIN b USING (id)""")
def simhash128_fp(spark, sf_dir):
    return simhash.fingerprints(docs(spark, sf_dir), 128).select("id", F.concat(simhash.hex16(F.col("fp")), simhash.hex16(F.col("fp_lo"))).alias("fp"))


@query("simhash_pairs", f"{LINKS} SELECT * FROM lk")
def simhash_pairs(spark, sf_dir):
    return simhash.pairs(prints(spark, sf_dir)).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("simhash_pairs_wide", f"""{FINGERPRINTS}, c AS (SELECT fp, min(id) AS rep FROM fp GROUP BY 1)
  SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.fp, y.fp)::BIT)::INTEGER AS distance FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.fp, y.fp)::BIT) <= 17 UNION ALL SELECT rep, id, 0 FROM fp JOIN c USING (fp) WHERE id <> rep""")
def simhash_pairs_wide(spark, sf_dir):
    """A threshold for which bands would be too narrow."""
    return simhash.pairs(prints(spark, sf_dir), 17).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("simhash128_pairs", f"""{SHINGLES}, k AS (SELECT id, ('0x' || substr(md5(shingle), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(shingle), 17, 16))::UBIGINT AS h2 FROM s), bb AS (SELECT id, {_BITS} AS bits, {_BITS2} AS bits2 FROM k GROUP BY 1),
  fp AS (SELECT w.id, coalesce(('0b' || bits)::UBIGINT, 0) AS hi, coalesce(('0b' || bits2)::UBIGINT, 1) AS lo FROM w LEFT JOIN bb USING (id)), c AS (SELECT hi, lo, min(id) AS rep FROM fp GROUP BY 1, 2)
  SELECT x.rep AS a, y.rep AS b, (bit_count(xor(x.hi, y.hi)::BIT) + bit_count(xor(x.lo, y.lo)::BIT))::INTEGER AS distance FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.hi, y.hi)::BIT) + bit_count(xor(x.lo, y.lo)::BIT) <= 10
  UNION ALL SELECT rep, id, 0 FROM fp JOIN c USING (hi, lo) WHERE id <> rep""")
def simhash128_pairs(spark, sf_dir):
    p = simhash.fingerprints(docs(spark, sf_dir), 128)
    return simhash.pairs(p, simhash.scaled_threshold(5, 128)).select("a", "b", F.col("distance").cast("int").alias("distance"))


CLUSTERS = LINKS.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, u AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), r AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), cl AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY 1)"""


@query("simhash_clusters", f"{CLUSTERS} SELECT * FROM cl")
def simhash_clusters(spark, sf_dir):
    return simhash.clusters(simhash.pairs(prints(spark, sf_dir)))


@query("neardup_summary", f"""{CLUSTERS}, m AS (SELECT cluster_id, count(*) AS n_members FROM cl GROUP BY 1), q AS (SELECT x.cluster_id, avg(bit_count(xor(f.fp, g.fp)::BIT)) AS d FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.id < y.id JOIN fp f ON f.id = x.id JOIN fp g ON g.id = y.id GROUP BY 1)
  SELECT cluster_id, n_members, round(1 - d / 64, 4)::DOUBLE AS similarity FROM m JOIN q USING (cluster_id)""")
def neardup_summary(spark, sf_dir):
    p = prints(spark, sf_dir).persist()
    return simhash.cluster_similarity(simhash.clusters(simhash.pairs(p)), p)


_SIG = ", ".join(f"min(({a} * h + {b}) % {minhash.PRIME})" for a, b in minhash.coefficients())
SIGS = f"{SHINGLES}, hh AS (SELECT id, (('0x' || substr(md5(shingle), 1, 8))::BIGINT % {minhash.PRIME})::BIGINT AS h FROM s), sg AS (SELECT id, [{_SIG}]::BIGINT[] AS sig FROM hh GROUP BY 1)"
_B, _R = minhash.band_shape()
CANDIDATES = f"""{SIGS}, cs AS (SELECT sig, min(id) AS rep FROM sg GROUP BY 1), bd AS (SELECT rep, sig, unnest(range(0, {_B})) AS band FROM cs), bk AS (SELECT rep, sig, band, array_to_string(sig[band * {_R} + 1 : band * {_R} + {_R}], ',') AS v FROM bd),
  np AS (SELECT DISTINCT x.rep AS a, y.rep AS b, len(list_filter(range(1, 129), lambda i: x.sig[i] = y.sig[i])) / 128.0::DOUBLE AS estimate FROM bk x JOIN bk y ON x.band = y.band AND x.v = y.v AND x.rep < y.rep),
  mp AS (SELECT * FROM np UNION ALL SELECT rep, id, 1.0::DOUBLE FROM sg JOIN cs USING (sig) WHERE id <> rep)"""


@query("minhash_sig", f"{SIGS} SELECT id, md5(array_to_string(sig, ',')) AS sig FROM sg")
def minhash_sig(spark, sf_dir):
    return minhash.signatures(docs(spark, sf_dir)).select("id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("sig"))


@query("minhash_pairs", f"{CANDIDATES} SELECT a, b, estimate FROM mp")
def minhash_pairs(spark, sf_dir):
    return minhash.candidate_pairs(minhash.signatures(docs(spark, sf_dir)))


MINHASH_CLUSTERS = CANDIDATES.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, u AS (SELECT a, b FROM mp UNION ALL SELECT b, a FROM mp), r AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), cl AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY 1)"""


@query("minhash_clusters", f"{MINHASH_CLUSTERS} SELECT * FROM cl")
def minhash_clusters(spark, sf_dir):
    return minhash.clusters(minhash.candidate_pairs(minhash.signatures(docs(spark, sf_dir))))


@query("minhash_cluster_similarity", f"""{MINHASH_CLUSTERS}, m AS (SELECT cluster_id, count(*) AS n_members FROM cl GROUP BY 1),
  q AS (SELECT x.cluster_id, sum(len(list_filter(range(1, 129), lambda i: f.sig[i] = g.sig[i]))) / (128.0::DOUBLE * count(*)) AS e FROM cl x JOIN cl y ON x.cluster_id = y.cluster_id AND x.id < y.id JOIN sg f ON f.id = x.id JOIN sg g ON g.id = y.id GROUP BY 1)
  SELECT cluster_id, n_members, round(e, 4)::DOUBLE AS similarity FROM m JOIN q USING (cluster_id)""")
def minhash_cluster_similarity(spark, sf_dir):
    sigs = minhash.signatures(docs(spark, sf_dir)).persist()  # narrow, and used twice
    return minhash.cluster_similarity(minhash.clusters(minhash.candidate_pairs(sigs)), sigs)


@query("jaccard_pairs", f"""{CANDIDATES}, ds AS (SELECT DISTINCT id, shingle FROM s), sz AS (SELECT id, count(*) AS n FROM ds GROUP BY 1),
  bo AS (SELECT a, b, count(*) AS both_n FROM mp JOIN ds x ON x.id = a JOIN ds y ON y.id = b AND y.shingle = x.shingle GROUP BY 1, 2)
  SELECT mp.a, mp.b, round(coalesce(both_n, 0) / (p.n + q.n - coalesce(both_n, 0))::DOUBLE, 6)::DOUBLE AS jaccard FROM mp JOIN sz p ON p.id = mp.a JOIN sz q ON q.id = mp.b LEFT JOIN bo ON bo.a = mp.a AND bo.b = mp.b""")
def jaccard_pairs(spark, sf_dir):
    d = docs(spark, sf_dir)
    return minhash.jaccard(d, minhash.candidate_pairs(minhash.signatures(d))).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


VECTORS = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS cosine FROM v x JOIN v y ON x.id < y.id), lk AS (SELECT a, b, cosine FROM p WHERE cosine >= 0.85)"


@query("semantic_pairs", f"{VECTORS} SELECT a, b, round(cosine, 6)::DOUBLE AS cosine FROM lk")
def semantic_pairs(spark, sf_dir):
    return semantic.similar_pairs(table(spark, sf_dir, "embeddings")).select("a", "b", F.round("cosine", 6).alias("cosine"))


LOOSE = VECTORS.replace("0.85", "0.35")


@query("semantic_pairs_loose", f"{LOOSE} SELECT a, b, round(cosine, 6)::DOUBLE AS cosine FROM lk")
def semantic_pairs_loose(spark, sf_dir):
    """The vectors of the table are far apart; at this threshold some pairs are found."""
    return semantic.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("semantic_components_loose", f"{LOOSE.replace('WITH v', 'WITH RECURSIVE v', 1)}, u AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), r AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY 1")
def semantic_components_loose(spark, sf_dir):
    return semantic.components(table(spark, sf_dir, "embeddings"), 0.35)


@query("semantic_components", f"{VECTORS.replace('WITH v', 'WITH RECURSIVE v', 1)}, u AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), r AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY 1")
def semantic_components(spark, sf_dir):
    return semantic.components(table(spark, sf_dir, "embeddings"))


# a vector is kept if no earlier kept one is near it: each step decides the next, as a list of those kept so far
GREEDY = """, nb AS (SELECT b AS id, list(a) AS earlier FROM lk GROUP BY 1), nd AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM lk UNION SELECT b FROM lk)),
  g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT nd.k, CASE WHEN list_has_any(coalesce(nb.earlier, []), g.kept) THEN g.kept ELSE list_append(g.kept, nd.id) END FROM g JOIN nd ON nd.k = g.k + 1 LEFT JOIN nb ON nb.id = nd.id),
  z AS (SELECT arg_max(kept, k) AS kept FROM g), ow AS (SELECT b AS id, min(a) AS cluster_id FROM lk, z WHERE list_contains(z.kept, a) AND NOT list_contains(z.kept, b) GROUP BY 1)
  SELECT id, cluster_id FROM ow UNION ALL SELECT DISTINCT cluster_id, cluster_id FROM ow"""


@query("semantic_clusters_loose", LOOSE.replace("WITH v", "WITH RECURSIVE v", 1) + GREEDY)
def semantic_clusters_loose(spark, sf_dir):
    return semantic.clusters(table(spark, sf_dir, "embeddings"), 0.35)


@query("semantic_clusters", VECTORS.replace("WITH v", "WITH RECURSIVE v", 1) + GREEDY)
def semantic_clusters(spark, sf_dir):
    return semantic.clusters(table(spark, sf_dir, "embeddings"))


# -------------------------------------------------------------------- reports


def _report_parts(spark, sf_dir, names, with_language=False):
    """The facts that rows hold themselves, and the members of duplicate groups."""
    c = docs(spark, sf_dir)
    return tables.row_facts(c, [pii.BY_NAME[n] for n in names], with_language), dedup.members(dedup.hashed(c))


_REPORT = (
    "WITH " + DETECT.removeprefix("WITH ") + ", " + HASHES.removeprefix("WITH ") + ", "
    + pii_counts_sql().removeprefix(DOCS + ", ").replace("s AS (SELECT", "ps AS (SELECT", 1).replace("FROM s)", "FROM ps)", 1).replace("m AS (SELECT", "pm AS (SELECT", 1).replace("FROM m WHERE", "FROM pm WHERE", 1).replace(", c AS (", ", pc AS (", 1)
    + f", pf AS (SELECT id, sum(n)::BIGINT AS n_matches, string_agg(pattern, ',' ORDER BY pattern) AS pii_types FROM pc GROUP BY 1), st AS (SELECT id, {STATUS_SQL} AS status FROM docs), dm AS (SELECT h.id, h.hash, g.first_id FROM h JOIN g ON h.hash = g.hash AND g.n > 1)"
)


def _file_sql(sep: str = ",") -> str:
    types = "coalesce(pii_types, '')" if sep == "," else "replace(coalesce(pii_types, ''), ',', ';')"
    return f"""{_REPORT} SELECT docs.id, size, mime AS mime_type, coalesce(hash, '') AS content_hash, hash IS NOT NULL AS is_duplicate, status AS health_status, pii_types IS NOT NULL AS has_pii, {types} AS pii_types, language, 'utf-8' AS encoding
  FROM docs LEFT JOIN dm USING (id) JOIN st USING (id) LEFT JOIN pf USING (id) JOIN det USING (id)"""


@query("file_report", _file_sql())
def file_report(spark, sf_dir, names=ALL_PATTERNS):
    return tables.file_rows(*_report_parts(spark, sf_dir, names, True))


@query("csv_report", _file_sql(";"))
def csv_report(spark, sf_dir, names=ALL_PATTERNS):
    return tables.csv_rows(file_report(spark, sf_dir, names))


CELLS = ["=1+1", "+x", "-3", "@a", "|b", "plain", "", "\ttab", "a=b"]


@query("csv_formula_guard", "WITH v(cell) AS (VALUES " + ", ".join(f"('{c}')" for c in CELLS) + ") SELECT cell, CASE WHEN cell <> '' AND contains('=+-@|' || chr(9) || chr(13), cell[1]) THEN '''' || cell ELSE cell END AS guarded FROM v")
def csv_formula_guard(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in CELLS], "cell string").select("cell", tables.guarded(F.col("cell")).alias("guarded"))


FINDINGS = f"""{_REPORT}, fi AS (SELECT id, 'FC004' AS rule_id, 'warning' AS level, 'Health status: ' || status AS message FROM st WHERE status <> 'ok'
  UNION ALL SELECT id, 'FC005', 'warning', printf('%d PII risk indicators: %s', n_matches, pii_types) FROM pf UNION ALL SELECT id, 'FC006', 'note', 'Exact duplicate of ' || first_id::VARCHAR FROM dm WHERE id <> first_id
  UNION ALL SELECT id, 'FC007', 'note', 'File contains encoding damage (mojibake)' FROM (SELECT id, text AS t FROM docs WHERE length(text) >= 20) WHERE {' OR '.join(_FLAGS.values())})"""


@query("sarif_findings", f"{FINDINGS} SELECT * FROM fi")
def sarif_findings(spark, sf_dir, names=ALL_PATTERNS):
    return tables.row_findings(*_report_parts(spark, sf_dir, names))


@query("junit_cases", f"{FINDINGS} SELECT docs.id, count(*) FILTER (rule_id IN ('FC001', 'FC002'))::BIGINT AS n_errors, count(*) FILTER (rule_id IN ('FC003', 'FC004', 'FC005', 'FC006'))::BIGINT AS n_failures FROM docs LEFT JOIN fi USING (id) GROUP BY 1")
def junit_cases(spark, sf_dir, names=ALL_PATTERNS):
    return tables.row_cases(*_report_parts(spark, sf_dir, names))


@query("gate", f"""{_REPORT}, x AS (SELECT 1 AS ord, 'duplicate' AS metric, (SELECT duplicate_pct / 100 FROM ({DEDUP_SQL})) AS rate, 0.1::DOUBLE AS threshold UNION ALL SELECT 2, 'corrupt', 0::DOUBLE, 0.01
  UNION ALL SELECT 3, 'pii', (SELECT count(*) FROM pf) / (SELECT count(*) FROM docs)::DOUBLE, 0.05) SELECT ord, metric, round(rate, 6)::DOUBLE AS rate, threshold::DOUBLE AS threshold, rate >= threshold AS breached FROM x""")
def gate(spark, sf_dir, names=ALL_PATTERNS):
    c = docs(spark, sf_dir)
    facts, _ = _report_parts(spark, sf_dir, names)
    out = tables.gate(dedup.dedup_summary(dedup.hashed(c)), facts.select("status"), facts.where("pii_types is not null"), c.agg(F.count(F.lit(1)).alias("n")))
    return out.withColumn("rate", F.round("rate", 6))


@query("top_types_with_other", """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
  SELECT k::INTEGER AS rank, source AS label, n FROM r WHERE k <= 5 UNION ALL SELECT 6, printf('Other (%d types)', count(*)), sum(n)::BIGINT FROM r WHERE k > 5 HAVING count(*) > 0""")
def top_types_with_other(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return tables.top_with_other(counts, "source", "n", 5)


SUMMARY_SQL = f"""{_REPORT} SELECT mime, count(*) AS n_files, sum(size)::BIGINT AS total_bytes, count(hash) AS n_duplicates, count(*) FILTER (status <> 'ok') AS n_unhealthy, count(pii_types) AS n_pii,
  count(*) FILTER (language IN ('Unknown', 'Latin (Unknown)', 'Mixed Script')) AS n_unclear_language FROM docs LEFT JOIN dm USING (id) JOIN st USING (id) LEFT JOIN pf USING (id) JOIN det USING (id) GROUP BY 1"""


@query("corpus_summary", SUMMARY_SQL)
def corpus_summary(spark, sf_dir, names=ALL_PATTERNS):
    """Health of the corpus by type: one report row a file, rolled up."""
    report = file_report(spark, sf_dir, names)
    vague = F.col("language").isin(language.UNKNOWN, language.LATIN_UNKNOWN, language.MIXED)
    return report.groupBy(F.col("mime_type").alias("mime")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("total_bytes"), F.count_if("is_duplicate").alias("n_duplicates"), F.count_if(F.col("health_status") != "ok").alias("n_unhealthy"),
        F.count_if("has_pii").alias("n_pii"), F.count_if(vague).alias("n_unclear_language"),
    )
