"""Queries of exact time arithmetic over the sales and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import exact_time as X
from framewright.session import read_table


def _fields(name: str, r) -> list:
    return [r["num"].alias(f"{name}_num"), r["den"].alias(f"{name}_den")]


def rational_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduce, multiply, divide, add, invert, round and print rationals."""
    t = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.rational(F.round(F.col("l_extendedprice") * 100).cast("long") - 3000000, F.col("l_quantity").cast("long") * 12 - 300).alias("a"),
        X.rational(F.col("l_partkey") - 1000, (F.col("l_suppkey") + 1) * 8).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    t = t.withColumns({"p": X.multiply(a, b), "q": X.divide(a, b), "s": X.add(a, b), "i": X.inverse(b), "v": X.after_pulldown(a)})
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_fields("a", a), *_fields("p", F.col("p")), *_fields("q", F.col("q")), *_fields("s", F.col("s")),
        *_fields("i", F.col("i")), *_fields("v", F.col("v")), X.round_half_away(a).alias("rounded"), X.argument(a).alias("arg"),
    )





def _red(n: str, d: str) -> tuple[str, str]:
    g = f"greatest(abs(gcd(CAST({n} AS HUGEINT), CAST({d} AS HUGEINT))), 1)"
    sign = f"CASE WHEN {d} < 0 THEN -1 ELSE 1 END"
    return (f"CASE WHEN {d} <> 0 THEN CAST(({n}) // {g} * {sign} AS BIGINT) END", f"CASE WHEN {d} <> 0 THEN CAST(({d}) // {g} * {sign} AS BIGINT) END")


def _rational_sql() -> str:
    a = _red("an", "ad")
    b = _red("bn", "bd")
    cols = {"p": ("a_num::HUGEINT * b_num", "a_den::HUGEINT * b_den"), "q": ("a_num::HUGEINT * b_den", "a_den::HUGEINT * b_num"), "s": ("a_num::HUGEINT * b_den + b_num::HUGEINT * a_den", "a_den::HUGEINT * b_den"), "i": ("b_den::HUGEINT", "b_num::HUGEINT"), "v": ("a_num::HUGEINT * 4", "a_den::HUGEINT * 5")}
    more = ", ".join(f"{_red(*v)[0]} AS {k}_num, {_red(*v)[1]} AS {k}_den" for k, v in cols.items())
    return f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) - 3000000 AS an, CAST(l_quantity AS BIGINT) * 12 - 300 AS ad,
  l_partkey - 1000 AS bn, (l_suppkey + 1) * 8 AS bd FROM lineitem),
r AS (SELECT *, {a[0]} AS a_num, {a[1]} AS a_den, {b[0]} AS b_num, {b[1]} AS b_den FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a_num, a_den, {more},
  CAST(sign(a_num) * ((abs(a_num) + a_den // 2) // a_den) AS BIGINT) AS rounded,
  CASE WHEN a_den IN (0, 1) THEN greatest(a_num, 1)::VARCHAR ELSE greatest(a_num, 1) || '/' || a_den END AS arg
FROM r"""


def rational_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rational, rate, ratio and decimal texts, junk and zero denominators included."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    texts = part.select(
        "p_partkey",
        F.when(k % 11 == 0, F.lit("n/a")).when(k % 7 == 0, F.concat(k.cast("string"), F.lit("/0"))).when(k % 5 == 0, k.cast("string")).otherwise(F.concat((k * 1000).cast("string"), F.lit("/"), (F.col("p_size") * 1001).cast("string"))).alias("rate"),
        F.when(k % 13 == 0, F.lit("16x9")).otherwise(F.concat(k.cast("string"), F.lit(":"), (F.col("p_size") - 10).cast("string"))).alias("ratio"),
        F.concat(F.when(k % 3 == 0, "-").otherwise(""), k.cast("string"), F.lit("."), F.lpad((F.col("p_size") * 7).cast("string"), 4, "0"), F.when(k % 4 == 0, "e2").when(k % 4 == 1, "E-3").otherwise("")).alias("decimal"),
    )
    t = texts.withColumns({"r": X.parse(F.col("rate")), "f": X.parse_frame_rate(F.col("rate")), "c": X.parse_ratio_colon(F.col("ratio")), "d": X.from_decimal(F.col("decimal"))})
    return t.select("p_partkey", "rate", "ratio", "decimal", *[x for n in "rfcd" for x in _fields(n, F.col(n))])


def _text_sql() -> str:
    r, c, d = _red("rn", "rd"), _red("cn", "cd"), _red("dn", "dd")
    return f"""
WITH t AS (SELECT p_partkey, p_partkey AS k,
  CASE WHEN p_partkey % 11 = 0 THEN 'n/a' WHEN p_partkey % 7 = 0 THEN p_partkey || '/0' WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR ELSE (p_partkey * 1000) || '/' || (p_size * 1001) END AS rate,
  CASE WHEN p_partkey % 13 = 0 THEN '16x9' ELSE p_partkey || ':' || (p_size - 10) END AS ratio,
  (CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END) || p_partkey || '.' || lpad((p_size * 7)::VARCHAR, 4, '0') || CASE p_partkey % 4 WHEN 0 THEN 'e2' WHEN 1 THEN 'E-3' ELSE '' END AS "decimal"
  FROM part),
u AS (SELECT *, TRY_CAST(string_split(rate, '/')[1] AS BIGINT) AS rn, CASE WHEN rate LIKE '%/%' THEN TRY_CAST(string_split(rate, '/')[2] AS BIGINT) ELSE 1 END AS rd,
  TRY_CAST(string_split(ratio, ':')[1] AS BIGINT) AS cn, TRY_CAST(string_split(ratio, ':')[2] AS BIGINT) AS cd,
  regexp_extract("decimal", '^(-?)(\\d+)\\.(\\d+)([eE](-?\\d+))?$', ['sign', 'i', 'f', 'x', 'e']) AS m FROM t),
v AS (SELECT *, CAST(m.i || m.f AS HUGEINT) * (CASE m.sign WHEN '-' THEN -1 ELSE 1 END) * (CASE WHEN m.e = '2' THEN 100 ELSE 1 END) AS dn,
  CAST(10 AS HUGEINT) * 1000 * (CASE WHEN m.e = '-3' THEN 1000 ELSE 1 END) AS dd FROM u),
w AS (SELECT *, {r[0]} AS r_num, {r[1]} AS r_den, {c[0]} AS c_num, {c[1]} AS c_den, {d[0]} AS d_num, {d[1]} AS d_den FROM v)
SELECT p_partkey, rate, ratio, "decimal", r_num, CASE WHEN r_num IS NULL THEN NULL ELSE r_den END AS r_den, nullif(r_num, 0) AS f_num, CASE WHEN r_num <> 0 THEN r_den END AS f_den, c_num,
  CASE WHEN c_num IS NULL THEN NULL ELSE c_den END AS c_den, d_num, d_den FROM w"""


TB = ((1, 90000), (1001, 24000), (1, 1000))


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants in timebases: conversion, offsets, order, containment and texts."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    tbs = [F.struct(F.lit(n).cast("long").alias("num"), F.lit(d).cast("long").alias("den")) for n, d in TB]
    pts = F.col("event_id") * 3333 - F.col("cents") * 77
    s = X.seconds(pts, tbs[0])
    sd = X.seconds_double(pts, tbs[0])
    to = X.convert(pts, tbs[0], tbs[1])
    delta = X.rational(F.col("cents") - 500, F.lit(48))
    return e.select(
        "event_id", pts.alias("pts"), s["num"].alias("s_num"), s["den"].alias("s_den"), to.alias("film_pts"), X.convert(to, tbs[1], tbs[0]).alias("back_pts"),
        X.from_seconds(F.col("cents") / 64, tbs[2]).alias("ms_pts"), X.offset(pts, tbs[0], delta).alias("moved"), X.compare(pts, tbs[0], F.col("user_id") * 40, tbs[2]).alias("ordered"),
        X.format_hms(F.call_function("div", pts, F.lit(90).cast("long")) / 1000).alias("hms"), X.six_decimals(F.round(F.col("cents") / 64, 6)).alias("six"),
        X.contains(F.col("user_id") * 100, F.col("user_id") * 100 + 2000, F.col("cents")).alias("inside"), X.duration(F.col("cents") / 4, F.col("user_id") / 2).alias("span"),
        X.frame_at(F.col("cents") / 64, F.lit(23.976)).alias("frame"), X.human_duration(F.col("cents") * 3 / 2).alias("took"), X.human_duration(F.col("cents") * 3 / 2, colons=True).alias("clock"),
    )


def _timestamps_sql() -> str:
    s = _red("pts", "90000")
    moved = "(sign(cents - 500) * ((abs((cents - 500)::HUGEINT * 1875) + 0)))"
    return f"""
WITH e AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
p AS (SELECT *, event_id * 3333 - cents * 77 AS pts FROM e),
q AS (SELECT *, CAST(pts::HUGEINT * 4 // 15015 AS BIGINT) AS film_pts, pts // 90 AS ms, cents * 3 // 2 AS t FROM p)
SELECT event_id, pts, {s[0]} AS s_num, {s[1]} AS s_den, film_pts, CAST(film_pts::HUGEINT * 15015 // 4 AS BIGINT) AS back_pts,
  CAST(round(cents / 64 * 1000) AS BIGINT) AS ms_pts, CAST(pts + {moved} AS BIGINT) AS moved,
  CASE WHEN pts * 1000 < user_id * 40 * 90000 THEN -1 WHEN pts * 1000 > user_id * 40 * 90000 THEN 1 ELSE 0 END AS ordered,
  CASE WHEN ms < 0 THEN '--:--:--.---' ELSE printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) END AS hms,
  printf('%.6f', round(cents / 64, 6)) AS six, user_id * 100 <= cents AND cents < user_id * 100 + 2000 AS inside, greatest(user_id / 2 - cents / 4, 0.0) AS span,
  CAST(greatest(round(cents / 64 * 23.976::DOUBLE), 0) AS BIGINT) AS frame,
  CASE WHEN t >= 3600 THEN printf('%dh%02dm%02ds', t // 3600, t // 60 % 60, t % 60) WHEN t >= 60 THEN printf('%dm%02ds', t // 60 % 60, t % 60) ELSE printf('%ds', t) END AS took,
  CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60 % 60, t % 60) END AS clock
FROM q"""


def approximations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-denominator approximations of prices and of film rates."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_retailprice") - 950.0) / (F.col("p_size") + 1) / 7).alias("v"))
    r = X.approximate(F.col("v"), 1001)
    return part.select("p_partkey", r["num"].alias("num"), r["den"].alias("den"))


APPROXIMATIONS = """
WITH RECURSIVE v AS (SELECT p_partkey, (p_retailprice - 950.0::DOUBLE) / (p_size + 1) / 7 AS v FROM part),
s(p_partkey, i, x, p0, q0, p1, q1, bn, bd, live) AS (
  SELECT p_partkey, 0, abs(v), 0::HUGEINT, 1::HUGEINT, 1::HUGEINT, 0::HUGEINT, 0::HUGEINT, 1::HUGEINT, true FROM v
  UNION ALL
  SELECT p_partkey, i + 1, CASE WHEN x - floor(x) <= 2.220446049250313e-16 THEN x ELSE 1.0::DOUBLE / (x - floor(x)) END, p1, q1, p2, q2, p2, q2, x - floor(x) > 2.220446049250313e-16
  FROM (SELECT *, floor(x)::HUGEINT * p1 + p0 AS p2, floor(x)::HUGEINT * q1 + q0 AS q2 FROM s WHERE live AND i < 64 AND x < 9e18) WHERE q2 > 0 AND q2 <= 1001),
l AS (SELECT p_partkey, arg_max(bn, i) AS bn, arg_max(bd, i) AS bd FROM s GROUP BY p_partkey)
SELECT p_partkey, CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * bn // gcd(bn, bd) AS BIGINT) AS num, CAST(bd // gcd(bn, bd) AS BIGINT) AS den FROM l JOIN v USING (p_partkey)"""


def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job identities of parts as films, and option fingerprints."""
    p = read_table(spark, sf_dir, "part")
    source = F.concat(F.lit("/films/"), F.col("p_name"), F.lit("."), F.col("p_partkey").cast("string"), F.lit(".mkv"))
    options = X.fingerprint(F.struct(F.col("p_brand").alias("profile"), F.col("p_size").alias("scale")), F.col("p_type"))
    return p.select("p_partkey", X.job_id(source, F.concat(F.lit("/out/"), F.col("p_type")), options).alias("job_id"), F.length(options).alias("n_options"))


JOB_IDS = r"""
WITH p AS (SELECT p_partkey, p_name, '/films/' || p_name || '.' || p_partkey || '.mkv' AS src, '/out/' || p_type AS dst,
  '{"profile":"' || p_brand || '","scale":' || p_size || '}' || chr(1) || p_type AS opt FROM part),
b AS (SELECT *, list_transform(range(1, strlen(src) + strlen(dst) + strlen(opt) + 3), lambda i: CAST(ord(substr(src || chr(2) || dst || chr(2) || opt, i, 1)) AS UHUGEINT)) AS bytes FROM p),
h AS (SELECT *, list_reduce(list_transform(list_zip(bytes, range(1, len(bytes) + 1)), lambda x: CASE WHEN x[2] IN (strlen(src) + 1, strlen(src) + strlen(dst) + 2) THEN 0::UHUGEINT ELSE x[1] END),
  lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM b)
SELECT p_partkey, 'cli-' || left(regexp_replace(p_name || '.' || p_partkey, '[^A-Za-z0-9_-]', '', 'g'), 32) || '-' || lpad(lower(to_hex(h)), 16, '0') AS job_id,
  CAST(length(opt) AS INT) AS n_options FROM h"""

QUERIES = {"time_rationals": rational_arithmetic, "time_texts": rational_text, "time_instants": timestamps, "time_approximation": approximations, "time_job_ids": job_ids}
ORACLES = {"time_rationals": _rational_sql(), "time_texts": _text_sql(), "time_instants": _timestamps_sql(), "time_approximation": APPROXIMATIONS, "time_job_ids": JOB_IDS}
