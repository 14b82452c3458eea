"""Queries over the driver's tables, one or more per operator, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.grammar import ORDER, base36, key_prefix, parse, preview, reason, strip_cr
from lineweave.functions.hashing import fnv1a64, unsigned_sum
from lineweave.functions.sizes import describe_size, parse_size
from lineweave.operators import order
from lineweave.operators.generate import SHARED, WORDS, draw, lines, repeated_share
from lineweave.operators.malformed import split_lenient
from lineweave.operators.verify import first_violation, multiset_diff
from lineweave.plans.resources import disk_decision, least_budget, merge_passes, plan_memory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ line relations

#: id and raw of each relation, in SQL that Spark and DuckDB share.
RELATIONS = {
    "part": "SELECT p_partkey AS id, concat(CAST(p_partkey AS STRING), '. ', p_name) AS raw FROM part",
    "event": "SELECT event_id AS id, concat(CAST(user_id AS STRING), '. ', event_type) AS raw FROM events",
    "customer": "SELECT c_custkey AS id, concat(CAST(c_custkey AS STRING), '. ', c_mktsegment) AS raw FROM customer",
    "twin": """SELECT p_partkey * 3 AS id, concat(CAST(p_partkey AS STRING), '. ', p_name) AS raw FROM part
        UNION ALL SELECT p_partkey * 3 + 1, concat('00', CAST(p_partkey AS STRING), '. ', p_name) FROM part
        UNION ALL SELECT p_partkey * 3 + 2, concat('+', CAST(p_partkey AS STRING), '. ', p_name) FROM part""",
    "dirty": """SELECT o_orderkey AS id, CASE o_orderkey % 8
        WHEN 0 THEN concat(CAST(o_orderkey AS STRING), ' no period') WHEN 1 THEN concat('x', CAST(o_orderkey AS STRING), '. letters')
        WHEN 2 THEN concat('+', CAST(o_orderkey AS STRING), '. ', o_orderpriority) WHEN 3 THEN concat(' ', CAST(o_orderkey AS STRING), ' . spaced')
        WHEN 4 THEN concat('99999999999999999999', CAST(o_orderkey AS STRING), '. far') WHEN 5 THEN ''
        ELSE concat(CAST(o_orderkey AS STRING), '. ', o_orderstatus) END AS raw FROM orders""",
}
TABLES = ("part", "events", "customer", "orders", "documents")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """id, raw (text), line (bytes), number, string_part of a derived relation."""
    names = {}
    sql = RELATIONS[name]
    for table in TABLES:
        if f"FROM {table}" in sql:
            names[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}")
    return parse(spark.sql(sql, **names).withColumn("line", F.col("raw").cast("binary")))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seg_no, raw, line, number, string_part: a line for each line of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "seg"))
    cut = cut.select("doc_id", (F.col("p") + 1).cast("long").alias("seg_no"), F.concat(F.col("doc_id").cast("string"), F.lit(". "), "seg").alias("raw"))
    return parse(cut.withColumn("line", F.col("raw").cast("binary")))


DOC_SQL = """SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, concat(doc_id, '. ', seg) AS raw FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS seg, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seg_no FROM documents)"""


def parsed_sql(source: str, keys: str = "id") -> str:
    """The grammar in SQL: number, sp of ``source`` (keys, raw)."""
    return rf"""(SELECT {keys}, raw, number, CASE WHEN number IS NULL THEN NULL WHEN substr(raw, length(field) + 2, 1) = ' '
  THEN substr(raw, length(field) + 3) ELSE substr(raw, length(field) + 2) END AS sp FROM (
  SELECT *, TRY_CAST(nullif(field, '') AS BIGINT) AS number FROM (
  SELECT *, regexp_extract(raw, '\A([+-]?[0-9]+)\.', 1) AS field FROM ({source}))))"""


def rank_sql(name: str) -> str:
    return f"SELECT id, number, raw, row_number() OVER (ORDER BY sp, number, raw, id) AS rank FROM {parsed_sql(RELATIONS[name])}"


# ------------------------------------------------------------------ parse and reject


@query(f"SELECT doc_id, seg_no, number, sp AS string_part FROM {parsed_sql(DOC_SQL, 'doc_id, seg_no')}")
def parse_number_string(spark, sf_dir):
    return doc_segments(spark, sf_dir).select("doc_id", "seg_no", "number", F.col("string_part").cast("string").alias("string_part"))


@query(f"SELECT id, number IS NOT NULL AS valid, number FROM {parsed_sql(RELATIONS['dirty'])}")
def parse_reject_report(spark, sf_dir):
    return relation(spark, sf_dir, "dirty").select("id", F.col("number").isNotNull().alias("valid"), "number")


_REASON_SQL = """CASE WHEN octet_length(encode(raw)) > 30 THEN 'too_long' WHEN position('.' IN raw) = 0 THEN 'no_separator'
  WHEN regexp_extract(raw, '\\A([+-]?[0-9]+)\\.', 1) = '' THEN 'bad_number' WHEN number IS NULL THEN 'out_of_range' END"""


@query(f"SELECT coalesce({_REASON_SQL}, 'valid') AS reason, count(*) AS n FROM {parsed_sql(RELATIONS['dirty'])} GROUP BY 1")
def malformed_by_reason(spark, sf_dir):
    return relation(spark, sf_dir, "dirty").groupBy(F.coalesce(reason("line", 30), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT id, line_no, byte_offset, raw AS preview FROM (
  SELECT *, row_number() OVER (ORDER BY id) AS line_no, CAST(coalesce(sum(octet_length(encode(raw)) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
  FROM {parsed_sql(RELATIONS["dirty"])}) WHERE number IS NULL ORDER BY id LIMIT 1"""
)
def first_malformed(spark, sf_dir):
    """Two aggregates, as for files: the least bad id, then what lies before it."""
    lines = relation(spark, sf_dir, "dirty")
    first = lines.where("number IS NULL").agg(F.min(F.struct("id", preview(F.col("line")).alias("preview"))).alias("m")).select("m.id", "m.preview")
    before = lines.select(F.col("id").alias("other"), F.octet_length("line").alias("size")).join(F.broadcast(first), F.col("other") < F.col("id"), "right")
    counted = before.groupBy("id", "preview").agg((F.count("other") + 1).alias("line_no"), F.coalesce(F.sum(F.col("size") + 1), F.lit(0)).cast("long").alias("byte_offset"))
    return counted.select("id", "line_no", "byte_offset", "preview")


@query(f"SELECT id, {_REASON_SQL} AS reason FROM {parsed_sql(RELATIONS['dirty'])} WHERE {_REASON_SQL} IS NOT NULL")
def quarantine(spark, sf_dir):
    return split_lenient(relation(spark, sf_dir, "dirty"), 30)[1].select("id", "reason")


@query(f"SELECT doc_id, seg_no, CAST(octet_length(encode(raw)) AS BIGINT) AS size FROM ({DOC_SQL}) WHERE octet_length(encode(raw)) > 500")
def line_length_limit(spark, sf_dir):
    return doc_segments(spark, sf_dir).where(F.octet_length("line") > 500).select("doc_id", "seg_no", F.octet_length("line").cast("long").alias("size"))


# ------------------------------------------------------------------ line ends and offsets

_CR = "CASE {id} % 4 WHEN 1 THEN {cr} WHEN 2 THEN concat({cr}, {cr}) ELSE '' END"


@query(
    f"""SELECT id, hex(encode(CASE WHEN right(r, 1) = chr(13) THEN substr(r, 1, length(r) - 1) ELSE r END)) AS line
FROM (SELECT id, concat(raw, {_CR.format(id="id", cr="chr(13)")}) AS r FROM ({RELATIONS["part"]}))"""
)
def cr_strip(spark, sf_dir):
    ended = relation(spark, sf_dir, "part").select("id", F.concat("raw", F.expr(_CR.format(id="id", cr="char(13)"))).cast("binary").alias("r"))
    return ended.select("id", F.hex(strip_cr(F.col("r"))).alias("line"))


@query(
    """SELECT id, CAST(seg_no AS BIGINT) AS seg_no, CASE WHEN right(seg, 1) = chr(13) THEN substr(seg, 1, length(seg) - 1) ELSE seg END AS line FROM (
  SELECT id, n, unnest(s) AS seg, unnest(range(1, len(s) + 1)) AS seg_no FROM (
    SELECT p_partkey AS id, string_split(concat('1. ', p_name, chr(13), chr(10), '2. ', p_brand, chr(10), CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(13) ELSE concat('3. ', p_type) END), chr(10)) AS s, 3 AS n FROM part))
WHERE NOT (seg_no = n AND seg IN ('', chr(13)))"""
)
def split_terminators(spark, sf_dir):
    """Mixed line ends; an empty rest after the last line feed, bare carriage return or not, is no line."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN char(13) ELSE concat('3. ', p_type) END")
    text = F.concat(F.lit("1. "), "p_name", F.lit("\r\n2. "), "p_brand", F.lit("\n"), tail)
    cut = part.select(F.col("p_partkey").alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("p", "seg"))
    cut = cut.where(~((F.col("p") == 2) & F.col("seg").isin("", "\r")))
    return cut.select("id", (F.col("p") + 1).cast("long").alias("seg_no"), strip_cr(F.col("seg").cast("binary")).cast("string").alias("line"))


@query(
    """SELECT doc_id, CAST(seg_no AS BIGINT) AS line_no, CAST(coalesce(sum(octet_length(encode(seg)) + 1) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS seg, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seg_no FROM documents)"""
)
def line_offsets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = F.transform(F.split("text", "\n", -1), lambda s: F.octet_length(s).cast("long") + 1)
    cut = docs.select("doc_id", F.posexplode(sizes).alias("p", "size"))
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("byte_offset"))


# ------------------------------------------------------------------ order


@query(f"SELECT doc_id, seg_no, number, md5(raw) AS line_md5, row_number() OVER (ORDER BY sp, number, raw, doc_id, seg_no) AS rank FROM {parsed_sql(DOC_SQL, 'doc_id, seg_no')}")
def sort_doc_lines_rank(spark, sf_dir):
    return order.ranked(doc_segments(spark, sf_dir), "doc_id", "seg_no").select("doc_id", "seg_no", "number", F.md5("line").alias("line_md5"), "rank")


def _rank(name: str) -> None:
    def f(spark, sf_dir):
        return order.ranked(relation(spark, sf_dir, name), "id").select("id", "number", "raw", "rank")

    f.__name__ = f"sort_{name}_lines_rank"
    query(rank_sql(name))(f)


for _name in ("part", "event", "customer", "twin"):
    _rank(_name)


@query(f"SELECT id, raw FROM (SELECT id, raw, row_number() OVER (ORDER BY sp, number, raw, id) AS r FROM {parsed_sql(RELATIONS['part'])}) WHERE r <= 100")
def topk_lines(spark, sf_dir):
    return relation(spark, sf_dir, "part").orderBy(*ORDER, "id").limit(100).select("id", "raw")


@query(f"SELECT id, raw FROM {parsed_sql(RELATIONS['part'])} WHERE sp >= 'b' AND sp < 'm'")
def key_range(spark, sf_dir):
    return order.between(relation(spark, sf_dir, "part"), F.lit(b"b"), F.lit(b"m")).select("id", "raw")


@query(f"SELECT id, rpad(left(hex(encode(sp)), 16), 16, '0') AS prefix FROM {parsed_sql(RELATIONS['customer'])}")
def key_prefix_hex(spark, sf_dir):
    return relation(spark, sf_dir, "customer").select("id", key_prefix(F.col("string_part")).alias("prefix"))


@query(
    f"""SELECT bucket, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM ({DOC_SQL})) AS share FROM (
  SELECT left(hex(encode(sp)), 2) AS bucket, count(*) AS n FROM {parsed_sql(DOC_SQL, "doc_id, seg_no")} GROUP BY 1)"""
)
def prefix_bucket_histogram(spark, sf_dir):
    lines = doc_segments(spark, sf_dir)
    counts = lines.groupBy(F.hex(F.substring("string_part", 1, 1)).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))  # one total row


# ------------------------------------------------------------------ hashes and verification

_FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(raw, ''), lambda c: CAST(ord(c) AS HUGEINT))), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)"


@query(f"SELECT id, CAST({_FNV} AS VARCHAR) AS hash FROM ({RELATIONS['part']})")
def fnv1a_line_hash(spark, sf_dir):
    h = fnv1a64("line")
    unsigned = F.pmod(h.cast("decimal(38,0)"), F.lit(Decimal(2**64)).cast("decimal(38,0)"))
    return relation(spark, sf_dir, "part").select("id", unsigned.cast("decimal(20,0)").cast("string").alias("hash"))


@query(f"SELECT CAST(sum({_FNV}) % 18446744073709551616 AS VARCHAR) AS hash FROM ({RELATIONS['event']})")
def content_hash_sum(spark, sf_dir):
    return relation(spark, sf_dir, "event").select(fnv1a64("line").alias("h")).agg(unsigned_sum(F.col("h")).cast("string").alias("hash"))


@query(f"SELECT count(*) AS line_count, CAST(sum(octet_length(encode(raw)) + 1) AS BIGINT) AS byte_count, CAST(sum({_FNV}) % 18446744073709551616 AS VARCHAR) AS hash FROM ({RELATIONS['twin']})")
def file_scan_report(spark, sf_dir):
    hashed = relation(spark, sf_dir, "twin").select(F.octet_length("line").alias("size"), fnv1a64("line").alias("h"))
    return hashed.agg(F.count("*").alias("line_count"), F.sum(F.col("size") + 1).alias("byte_count"), unsigned_sum(F.col("h")).cast("string").alias("hash"))


def _placed(lines: DataFrame, at: str) -> DataFrame:
    """Lines as a file's records: splits of 1,000 by the column ``at``."""
    return lines.withColumn("block", F.floor((F.col(at) - 1) / 1000)).withColumn("seq", F.col(at))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def verify_order_ok(spark, sf_dir):
    ranked = order.ranked(relation(spark, sf_dir, "event"), "id")
    return first_violation(_placed(ranked, "rank")).agg(F.count("*").alias("violations"))


@query(
    f"""WITH r AS (SELECT raw, sp, number, row_number() OVER (ORDER BY sp, number, raw, id) AS rank FROM {parsed_sql(RELATIONS["part"])}),
p AS (SELECT raw, sp, number, CASE rank WHEN 70 THEN 71 WHEN 71 THEN 70 WHEN 120 THEN 123 WHEN 123 THEN 120 ELSE rank END AS pos FROM r),
l AS (SELECT pos, raw, lag(raw) OVER w AS before, lag(raw) OVER w IS NOT NULL AND (sp, number, raw) < (lag(sp) OVER w, lag(number) OVER w, lag(raw) OVER w) AS bad FROM p WINDOW w AS (ORDER BY pos))
SELECT pos AS line_no, before, raw AS line FROM l WHERE bad ORDER BY pos LIMIT 1"""
)
def verify_first_violation(spark, sf_dir):
    ranked = order.ranked(relation(spark, sf_dir, "part"), "id")
    swapped = ranked.withColumn("at", F.expr("CASE rank WHEN 70 THEN 71 WHEN 71 THEN 70 WHEN 120 THEN 123 WHEN 123 THEN 120 ELSE rank END"))
    found = first_violation(_placed(swapped, "at"))
    return found.select(F.col("seq").alias("line_no"), F.col("before").cast("string").alias("before"), F.col("line").cast("string").alias("line"))


#: A result with one change: none, a line dropped, a line doubled in place of the next, two lines
#: swapped, the last line end gone (so that the last line is none).
_VARIANTS = ("sorted", "dropped", "doubled", "swapped", "open")


@query(
    f"""WITH r AS (SELECT raw, sp, number, row_number() OVER (ORDER BY sp, number, raw, id) AS rank FROM {parsed_sql(RELATIONS["part"])}),
v AS (SELECT variant, CASE WHEN variant = 'swapped' AND rank IN (10, 11) THEN 21 - rank ELSE rank END AS pos,
  CASE WHEN variant = 'doubled' AND rank = 11 THEN 10 ELSE rank END AS take FROM r, (VALUES ('sorted'), ('dropped'), ('doubled'), ('swapped'), ('open')) t(variant)
  WHERE NOT (variant = 'dropped' AND rank = 11) AND NOT (variant = 'open' AND rank = (SELECT max(rank) FROM r))),
j AS (SELECT v.variant, v.pos, r.raw, r.sp, r.number FROM v JOIN r ON r.rank = v.take),
l AS (SELECT variant, raw, lag(raw) OVER w IS NOT NULL AND (sp, number, raw) < (lag(sp) OVER w, lag(number) OVER w, lag(raw) OVER w) AS bad FROM j WINDOW w AS (PARTITION BY variant ORDER BY pos)),
s AS (SELECT variant, bool_or(bad) AS bad, count(*) AS n, sum({_FNV}) % 18446744073709551616 AS h FROM l GROUP BY 1),
o AS (SELECT count(*) AS n, sum({_FNV}) % 18446744073709551616 AS h FROM r)
SELECT variant, CASE WHEN bad THEN 'OrderViolation' WHEN variant = 'open' THEN 'OutputNotTerminated' WHEN s.n <> o.n THEN 'CountMismatch' WHEN s.h <> o.h THEN 'HashMismatch' ELSE 'Verified' END AS outcome FROM s, o"""
)
def verify_outcome(spark, sf_dir):
    r = order.ranked(relation(spark, sf_dir, "part"), "id").select("line", "number", "string_part", "rank")
    v = r.select("rank", F.explode(F.array(*map(F.lit, _VARIANTS))).alias("variant")).where("NOT (variant = 'dropped' AND rank = 11)")
    v = v.select("variant", F.expr("CASE WHEN variant = 'swapped' AND rank IN (10, 11) THEN 21 - rank ELSE rank END AS at"), F.expr("CASE WHEN variant = 'doubled' AND rank = 11 THEN 10 ELSE rank END AS take"))
    j = v.join(r, v["take"] == r["rank"]).select("variant", "at", "line", F.struct(*ORDER).alias("key"))
    lagged = j.withColumn("bad", F.lag("key").over(Window.partitionBy("variant").orderBy("at")) > F.col("key")).withColumn("h", fnv1a64("line"))
    last = lagged.groupBy("variant").agg(F.max("at").alias("last"))
    lagged = lagged.join(F.broadcast(last), "variant").where("NOT (variant = 'open' AND at = last)")  # a row per variant
    s = lagged.groupBy("variant").agg(F.max("bad").alias("bad"), F.count("*").alias("n"), unsigned_sum(F.col("h")).alias("h"))
    o = r.select(fnv1a64("line").alias("h")).agg(F.count("*").alias("n0"), unsigned_sum(F.col("h")).alias("h0"))
    outcome = F.when(F.col("bad"), "OrderViolation").when(F.col("variant") == "open", "OutputNotTerminated").when(F.col("n") != F.col("n0"), "CountMismatch").when(F.col("h") != F.col("h0"), "HashMismatch").otherwise("Verified")
    return s.crossJoin(F.broadcast(o)).select("variant", outcome.alias("outcome"))  # one row of totals


@query(
    f"""WITH a AS (SELECT raw FROM ({RELATIONS["event"]}) WHERE id % 5 < 4), b AS (SELECT raw FROM ({RELATIONS["event"]}) WHERE id % 5 > 0)
SELECT raw AS line, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT raw, 1 AS n FROM a UNION ALL SELECT raw, -1 FROM b) GROUP BY 1 HAVING sum(n) <> 0"""
)
def multiset_difference(spark, sf_dir):
    lines = relation(spark, sf_dir, "event")
    found = multiset_diff(lines.where("id % 5 < 4"), lines.where("id % 5 > 0"))
    return found.select(F.col("line").cast("string").alias("line"), "surplus")


# ------------------------------------------------------------------ repeats and ranges


@query(
    f"""SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_lines, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS share
FROM (SELECT sp, count(*) AS n FROM {parsed_sql(RELATIONS["part"])} GROUP BY 1)"""
)
def duplicate_share(spark, sf_dir):
    return repeated_share(relation(spark, sf_dir, "part"))


@query(f"SELECT sp AS string_part, count(*) AS n FROM {parsed_sql(RELATIONS['part'])} GROUP BY 1 ORDER BY n DESC, sp LIMIT 20")
def dup_groups_top(spark, sf_dir):
    counts = relation(spark, sf_dir, "part").groupBy("string_part").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "string_part").limit(20).select(F.col("string_part").cast("string").alias("string_part"), "n")


_RANKED_PART = f"(SELECT raw, sp, number, row_number() OVER (ORDER BY sp, number, raw) AS rank, count(*) OVER () AS n FROM {parsed_sql(RELATIONS['part'])})"


@query(f"SELECT CAST(k AS INTEGER) AS slice, rank, raw AS line FROM {_RANKED_PART} JOIN (SELECT unnest(range(1, 8)) AS k) ON rank = k * n // 8 + 1")
def range_splitters(spark, sf_dir):
    return order.splitters(relation(spark, sf_dir, "part"), 8).select("slice", "rank", F.col("line").cast("string").alias("line"))


def _sliced(spark, sf_dir) -> DataFrame:
    ranked = order.ranked(relation(spark, sf_dir, "part"))
    total = ranked.agg(F.count("*").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("slice", F.expr("CAST((rank - 1) * 8 DIV total AS INT)"))  # one total row


@query(
    f"""WITH s AS (SELECT raw, row_number() OVER (ORDER BY sp, number, raw) - 1 AS r, count(*) OVER () AS n FROM (
  SELECT DISTINCT raw, sp, number FROM {parsed_sql(RELATIONS["twin"])} ORDER BY md5(raw), raw LIMIT 500))
SELECT CAST(k AS INTEGER) AS slice, raw AS line FROM s JOIN (SELECT unnest(range(1, 8)) AS k) ON r = k * n // 8"""
)
def sampled_range_splitters(spark, sf_dir):
    return order.sampled_splitters(relation(spark, sf_dir, "twin"), 8, 500).select("slice", F.col("line").cast("string").alias("line"))


@query("SELECT p_partkey AS id, CAST(list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: CAST(p_partkey AS BIGINT) // CAST(2 ** i AS BIGINT) % 2)), lambda a, b: a * 2 + b) AS BIGINT) AS reversed FROM part")
def bit_reversal(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    low = F.col("p_partkey") % 4096
    return part.select(F.col("p_partkey").alias("id"), order.bit_reversed(low, 12).alias("reversed"))


_SLICES = f"""(SELECT CAST((rank - 1) * 8 // n AS INTEGER) AS slice, count(*) AS rows, CAST(sum(octet_length(encode(raw)) + 1) AS BIGINT) AS slice_bytes,
  min((sp, number, raw)) AS first_key, max((sp, number, raw)) AS last_key FROM {_RANKED_PART} GROUP BY 1)"""


@query(
    f"""SELECT slice, rows, slice_bytes, CAST(coalesce(sum(slice_bytes) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS output_offset FROM {_SLICES}"""
)
def range_slice_stats(spark, sf_dir):
    return order.slice_stats(_sliced(spark, sf_dir)).select("slice", "rows", "slice_bytes", "output_offset")


@query(f"SELECT max(slice_bytes) / min(slice_bytes) AS imbalance, count(*) AS non_empty FROM {_SLICES}")
def slice_imbalance(spark, sf_dir):
    stats = order.slice_stats(_sliced(spark, sf_dir))
    return stats.agg((F.max("slice_bytes") / F.min("slice_bytes")).alias("imbalance"), F.count("*").alias("non_empty"))


@query(f"SELECT slice, before <= first_key AS ordered FROM (SELECT slice, first_key, lag(last_key) OVER (ORDER BY slice) AS before FROM {_SLICES}) WHERE before IS NOT NULL")
def slice_order_check(spark, sf_dir):
    stats = order.slice_stats(_sliced(spark, sf_dir)).withColumn("before", F.lag("last_key").over(Window.orderBy("slice")))
    return stats.where("before IS NOT NULL").select("slice", (F.col("before") <= F.col("first_key")).alias("ordered"))


@query("SELECT CAST(1 AS BIGINT) AS non_empty, count(*) AS rows FROM events")
def hot_key_slices(spark, sf_dir):
    """A relation of one key: its lines stay together, in one slice of eight."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("7. same").cast("binary").alias("line"))
    return order.slice_stats(order.ranges(parse(events), 8)).agg(F.count("*").alias("non_empty"), F.sum("rows").alias("rows"))


# ------------------------------------------------------------------ planners and scalars

_MERGES = [(5, 8), (8, 8), (9, 8), (3, 2), (100, 4), (186, 2048), (617, 2048), (1, 2)]


@query(
    f"""WITH RECURSIVE g(runs, fan_in) AS (VALUES {", ".join(map(str, _MERGES))}),
p AS (SELECT runs, fan_in, 0 AS pass, runs AS before, 0 AS groups, 0 AS carried FROM g
  UNION ALL SELECT runs, fan_in, pass + 1, CASE WHEN pass = 0 THEN before ELSE groups + carried END,
    ((CASE WHEN pass = 0 THEN before ELSE groups + carried END) - (CASE WHEN (CASE WHEN pass = 0 THEN before ELSE groups + carried END) % fan_in = 1 THEN 1 ELSE 0 END) + fan_in - 1) // fan_in,
    CASE WHEN (CASE WHEN pass = 0 THEN before ELSE groups + carried END) % fan_in = 1 THEN 1 ELSE 0 END
  FROM p WHERE (CASE WHEN pass = 0 THEN before ELSE groups + carried END) > 1)
SELECT CAST(runs AS BIGINT) AS runs, CAST(fan_in AS BIGINT) AS fan_in, CAST(pass AS BIGINT) AS pass, CAST(groups AS BIGINT) AS groups, CAST(carried AS BIGINT) AS carried FROM p WHERE pass > 0"""
)
def merge_plan_passes(spark, sf_dir):
    rows = [(n, f, k, len(g), len(c)) for n, f in _MERGES for k, (g, c) in enumerate(merge_passes(n, f), 1)]
    return spark.createDataFrame(rows, "runs long, fan_in long, pass long, groups long, carried long")


_BUDGETS = [(4 << 30, 16, 65536), (1 << 30, 16, 65536), (16 << 20, 4, 4096), (64 << 20, 4, 4096), (4698304, 71, 64), (1324423, 20, 256), (8 << 30, 8, 65536)]


@query(
    f"""WITH b(budget, p, max_line) AS (VALUES {", ".join(f"(CAST({a} AS BIGINT), {p}, {m})" for a, p, m in _BUDGETS)}),
w AS (SELECT *, max_line + 2 AS w0, least(32, max_line) AS m FROM b),
n AS (SELECT w.*, k, budget - k * 1048576 - CASE WHEN k > 1 THEN 2048 * (k + 1) * 8 ELSE 0 END AS room FROM w, (SELECT unnest(range(1, 9)) AS k) WHERE k = 1 OR k <= p),
v AS (SELECT *, greatest(0, (room - k * 2048 * 44) * m // (k * 2048 * (2 * m + 32))) AS widest FROM n),
c AS (SELECT budget, p, max_line, w0, m, max(CASE WHEN k = 1 OR widest >= w0 THEN k END) AS workers FROM v GROUP BY ALL),
d AS (SELECT c.*, v.room, greatest(c.w0, least(widest, 4194304)) AS win FROM c JOIN v ON v.budget = c.budget AND v.p = c.p AND v.max_line = c.max_line AND v.k = c.workers)
SELECT budget, CAST(p AS BIGINT) AS parallelism, CAST(max_line AS BIGINT) AS max_line, CAST(least(2147483591, (budget - p * 65536) * m // ((p + 2) * (m + 32) + m)) AS BIGINT) AS chunk,
  CAST(least(2048, room // (workers * (2 * win + win // m * 32 + 44))) AS BIGINT) AS fan_in, CAST(win AS BIGINT) AS read_window, CAST(workers AS BIGINT) AS workers FROM d"""
)
def memory_plan_vectors(spark, sf_dir):
    plans = [(b, p, m, plan_memory(b, p, m)) for b, p, m in _BUDGETS]
    rows = [(b, p, m, x.chunk, x.fan_in, x.window, x.workers) for b, p, m, x in plans]
    return spark.createDataFrame(rows, "budget long, parallelism long, max_line long, chunk long, fan_in long, read_window long, workers long")


@query(
    f"""WITH b(budget, p, max_line) AS (VALUES {", ".join(f"(CAST({a} AS BIGINT), {p}, {m})" for a, p, m in _BUDGETS)}),
c AS (SELECT DISTINCT p, max_line, max_line + 2 AS w0, least(32, max_line) AS m FROM b),
d AS (SELECT *, 2 * w0 + w0 // m * 32 + 44 AS cursor_, (p + 2) * (m + 32) + m AS unit_ FROM c)
SELECT CAST(p AS BIGINT) AS parallelism, CAST(max_line AS BIGINT) AS max_line,
  CAST(greatest(p * 65536 + ((w0 + 1) * unit_ + m - 1) // m, 1048576 + 2 * cursor_) AS BIGINT) AS budget FROM d"""
)
def least_budgets(spark, sf_dir):
    rows = sorted({(p, m, least_budget(p, m)) for _, p, m in _BUDGETS})
    return spark.createDataFrame(rows, "parallelism long, max_line long, budget long")


_PHASES = f"""(SELECT budget, parallelism AS p, max_line, chunk, fan_in, read_window AS w, workers AS k, least(32, max_line) AS m FROM ({ORACLES["memory_plan_vectors"]}))"""


@query(
    f"""SELECT budget, p AS parallelism, max_line, CAST((p + 2) * (chunk + chunk // m * 32) + chunk + p * 65536 AS BIGINT) AS phase_one,
  CAST(k * fan_in * (2 * w + w // m * 32) + k * 1048576 + k * fan_in * 44 + CASE WHEN k > 1 THEN fan_in * (k + 1) * 8 ELSE 0 END AS BIGINT) AS phase_two FROM {_PHASES}"""
)
def plan_worst_cases(spark, sf_dir):
    rows = [(b, p, m, x.phase_one, x.phase_two) for b, p, m in _BUDGETS if (x := plan_memory(b, p, m))]
    return spark.createDataFrame(rows, "budget long, parallelism long, max_line long, phase_one long, phase_two long")


_DISKS = [(k, n, f) for k in ("temp", "same", "output") for n in (0, 1000, 1 << 30, 2**62) for f in (None, 2000, 1 << 31, (1 << 31) + (1 << 20))]


@query(
    f"""WITH c(kind, input_bytes, free) AS (VALUES {", ".join(f"('{k}', CAST({n} AS BIGINT), CAST({'NULL' if f is None else f} AS BIGINT))" for k, n, f in _DISKS)}),
r AS (SELECT *, CAST(least(9223372036854775807, CAST(input_bytes AS HUGEINT) * CASE kind WHEN 'output' THEN 1 ELSE 2 END + CASE kind WHEN 'temp' THEN 0 ELSE 1048576 END) AS BIGINT) AS required FROM c)
SELECT kind, input_bytes, free, CASE WHEN free IS NULL THEN 'Unknown' WHEN free >= required THEN 'Sufficient' ELSE 'Insufficient' END AS outcome, required, coalesce(free, -1) AS available FROM r"""
)
def capacity_decisions(spark, sf_dir):
    rows = [(k, n, f, *disk_decision(k, n, f)) for k, n, f in _DISKS]
    return spark.createDataFrame(rows, "kind string, input_bytes long, free long, outcome string, required long, available long")


_SIZES = [0, 1, 1023, 1024, 1536, 10240, 104858, 1048524, 1048576, 1073741824, 5 << 30, 21474836456]


@query(
    f"""SELECT CAST(n AS BIGINT) AS bytes, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN round(n / 1024, 1) < 1024 THEN concat(printf('%.1f', n / 1024), ' KiB')
  WHEN round(n / 1048576, 1) < 1024 THEN concat(printf('%.1f', n / 1048576), ' MiB') ELSE concat(printf('%.1f', n / 1073741824), ' GiB') END AS shown
FROM (SELECT unnest({_SIZES}) AS n)"""
)
def byte_size_describe(spark, sf_dir):
    return spark.createDataFrame([(n, describe_size(n)) for n in _SIZES], "bytes long, shown string")


#: Texts that are sizes, and some that are none.
_LITERALS = ["0", "7", "7B", "12b", "3KiB", "3kib", "64MIB", "5GiB", "", "B", "-1", "1 KiB", "1.5KiB", "KiB", "9223372036854775807", "9223372036854775808", "8589934592GiB", "0x10"]


@query(
    f"""SELECT shown, CASE WHEN n IS NULL OR n * f > 9223372036854775807 THEN NULL ELSE CAST(n * f AS BIGINT) END AS bytes FROM (
  SELECT shown, TRY_CAST(nullif(regexp_extract(shown, '^([0-9]+)(?i:B|KiB|MiB|GiB)?$', 1), '') AS HUGEINT) AS n,
    CASE lower(regexp_extract(shown, '[A-Za-z]*$')) WHEN 'kib' THEN 1024 WHEN 'mib' THEN 1048576 WHEN 'gib' THEN 1073741824 ELSE 1 END AS f
  FROM (SELECT unnest({_LITERALS}) AS shown))"""
)
def byte_size_parse(spark, sf_dir):
    return spark.createDataFrame([(x, parse_size(x)) for x in _LITERALS], "shown string, bytes long")


@query("SELECT event_id AS id, lower(to_base(event_id, 36)) AS token FROM events")
def base36_tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), base36(F.col("event_id")).alias("token"))


_DRAW = "CAST(concat('0x', substr(md5(concat('42:', event_id, ':{p}')), 1, 15)) AS BIGINT) % {m}"


@query(
    f"""SELECT event_id AS id, {_DRAW.format(p="share", m=100)} < 10 AS shared, {_DRAW.format(p="slot", m=64)} AS slot, {_DRAW.format(p="digits", m=19)} + 1 AS digits FROM events"""
)
def generated_draws(spark, sf_dir):
    """The generator's seeded draws, from an id alone."""
    events, key = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return events.select(key.alias("id"), (draw(42, key, "share", 100) < 10).alias("shared"), draw(42, key, "slot", 64).alias("slot"), (draw(42, key, "digits", 19) + 1).alias("digits"))


def _cut(digest: str, at: int, width: int, modulus: int) -> str:
    return f"CAST(concat('0x', substr({digest}, {at}, {width})) AS BIGINT) % {modulus}"


_VOCABULARY = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
_PICKED = "[" + ", ".join(f"v[{_cut('c', 8 * i + 1, 8, len(WORDS))} + 1]" for i in range(4)) + "]"
_SHARED_PART = f"(SELECT k, concat(array_to_string(list_slice({_PICKED}, 1, least({_cut('c', 25, 8, 4)} + 1, 4)), ' '), ' s') AS part FROM (SELECT k, {_VOCABULARY} AS v, md5(concat('42:', k, ':part')) AS c FROM (SELECT unnest(range(0, {SHARED})) AS k)))"


@query(
    f"""WITH i AS (SELECT id, {_VOCABULARY} AS v, md5(concat('42:', id, ':line')) AS a, md5(concat('42:', id, ':number')) AS b, md5(concat('42:', id, ':words')) AS c FROM (SELECT unnest(range(0, 3000)) AS id)),
d AS (SELECT id, {_cut("a", 1, 8, 1_000_000)} < 250000 OR id < 2 AS shared, CASE WHEN id < 2 THEN 0 ELSE {_cut("a", 9, 8, SHARED)} END AS slot,
  left(lpad(concat({_cut("b", 1, 15, 10**9)}, lpad(CAST({_cut("b", 16, 15, 10**10)} AS VARCHAR), 10, '0')), 19, '1'), CAST({_cut("a", 17, 8, 19)} + 1 AS INTEGER)) AS wide,
  concat(array_to_string(list_slice({_PICKED}, 1, {_cut("a", 25, 8, 4)} + 1), ' '), ' ', lower(to_base(id, 36))) AS own FROM i),
t AS (SELECT id, coalesce(TRY_CAST(ltrim(wide, '0') AS BIGINT), 0) AS number, CASE WHEN shared THEN part ELSE own END AS string_part FROM d JOIN {_SHARED_PART} ON k = slot)
SELECT id, number, string_part, concat(number, '. ', string_part) AS line FROM t"""
)
def generated_lines(spark, sf_dir):
    """The generator's lines themselves, each from its id alone."""
    return lines(spark, 3000, 42, 0.25).select("id", "number", "string_part", F.col("line").cast("string").alias("line"))
