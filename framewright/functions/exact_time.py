"""Exact rational time: (num, den) structs of reduced longs, and instants in a timebase.

A rational is struct<num: bigint, den: bigint> with den > 0, the sign in num and zero as 0/1.
128-bit intermediates are DECIMAL(38,0); what does not fit a long is NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
_WIDE = "decimal(38,0)"


def _wide(c: Column) -> Column:
    return c.cast(_WIDE)


def to_long(c: Column) -> Column:
    """A wide integer as a long, NULL outside its range."""
    return F.when(c.between(F.lit(LONG_MIN).cast(_WIDE), F.lit(LONG_MAX).cast(_WIDE)), c.cast("long"))


@F.arrow_udf(T.LongType())
def long_gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    """Greatest common divisor of two longs. Spark has no gcd, and a fold by Euclid's rule in
    expressions is interpreted 93 times a row; this is one vectorised call a batch."""
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    g = np.gcd(pc.fill_null(a, 0).to_numpy(zero_copy_only=False), pc.fill_null(b, 0).to_numpy(zero_copy_only=False))
    return pc.if_else(known, pa.array(g, pa.int64()), pa.scalar(None, pa.int64()))


@F.arrow_udf(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))
def _reduce(num: pa.Array, den: pa.Array) -> pa.Array:
    known = pc.and_(pc.is_valid(num), pc.is_valid(den)).to_numpy(zero_copy_only=False)
    n, d = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (num, den))
    known = known & (d != 0)
    g = np.where(known, np.gcd(n, d), 1) * np.where(d < 0, -1, 1)
    return pa.StructArray.from_arrays([pa.array(n // g, pa.int64()), pa.array(d // g, pa.int64())], ["num", "den"], mask=pa.array(~known))


def rational(num: Column, den: Column) -> Column:
    """num/den reduced; NULL where den is 0 or either is NULL."""
    return _reduce(num.cast("long"), den.cast("long"))


def parse(s: Column) -> Column:
    """"n/d" or "n"; NULL for junk and for den 0."""
    t = F.trim(s)
    m = F.regexp_extract(t, r"^([+-]?\d+)(?:/([+-]?\d+))?$", 1)
    d = F.regexp_extract(t, r"^([+-]?\d+)(?:/([+-]?\d+))?$", 2)
    return rational(F.nullif(m, F.lit("")).try_cast("long"), F.coalesce(F.nullif(d, F.lit("")), F.lit("1")).try_cast("long"))


def parse_frame_rate(s: Column) -> Column:
    """A rational that is not zero, else NULL."""
    r = parse(s)
    return F.when(r["num"] != 0, r)


def parse_ratio_colon(s: Column) -> Column:
    """"40:33" as a rational; NULL for junk and for den 0."""
    m = F.regexp_extract(s, r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", 1)
    d = F.regexp_extract(s, r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*$", 2)
    return rational(F.nullif(m, F.lit("")).try_cast("long"), F.nullif(d, F.lit("")).try_cast("long"))


def from_decimal(s: Column) -> Column:
    """Exact decimal text with optional exponent; NULL for junk and where a long overflows."""
    pattern = r"^\s*([-+]*)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?\s*$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    digits = F.concat(part(2), part(3))
    exponent = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0))
    power = lambda n: F.when(n.between(0, 18), F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long"))
    value = digits.try_cast("long") * F.when(part(1).startswith("-"), -1).otherwise(1)
    num = to_long(_wide(value) * _wide(power(F.greatest(exponent, F.lit(0)))))
    den = to_long(_wide(power(F.length(part(3)))) * _wide(power(F.greatest(-exponent, F.lit(0)))))
    return F.when(digits != "", rational(num, den))


def multiply(a: Column, b: Column) -> Column:
    """Product with cross cancellation; NULL on overflow."""
    g1 = F.greatest(long_gcd(a["num"], b["den"]), F.lit(1).cast("long"))
    g2 = F.greatest(long_gcd(b["num"], a["den"]), F.lit(1).cast("long"))
    div = lambda x, y: F.call_function("div", x, y)
    return rational(F.try_multiply(div(a["num"], g1), div(b["num"], g2)), F.try_multiply(div(a["den"], g2), div(b["den"], g1)))


def inverse(a: Column) -> Column:
    return rational(a["den"], F.nullif(a["num"], F.lit(0).cast("long")))


def divide(a: Column, b: Column) -> Column:
    """Quotient; NULL by zero and on overflow."""
    return F.when(b["num"] != 0, multiply(a, inverse(b)))


def add(a: Column, b: Column) -> Column:
    """Sum through wide intermediates; NULL where the unreduced sum passes a long."""
    n = _wide(a["num"]) * _wide(b["den"]) + _wide(b["num"]) * _wide(a["den"])
    return rational(to_long(_wide(n)), to_long(_wide(_wide(a["den"]) * _wide(b["den"]))))


def round_half_away(a: Column) -> Column:
    """Nearest integer, halves away from zero."""
    n = F.call_function("div", _wide(F.abs(_wide(a["num"])) + _wide(F.call_function("div", a["den"], F.lit(2)))), _wide(a["den"]))
    return (n * F.signum(a["num"]).cast("int")).cast("long")


def approximate(v: Column, max_den: int) -> Column:
    """The last continued-fraction convergent whose denominator is at most max_den (64 steps)."""
    z = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    start = F.struct(F.abs(v).alias("x"), z.alias("p0"), one.alias("q0"), one.alias("p1"), z.alias("q1"), z.alias("bn"), one.alias("bd"), F.lit(False).alias("stop"))

    def step(s: Column, _: Column) -> Column:
        a = F.when(s["x"] < 9.2e18, F.floor(s["x"]).cast("long"))
        p, q = F.try_add(F.try_multiply(a, s["p1"]), s["p0"]), F.try_add(F.try_multiply(a, s["q1"]), s["q0"])
        bad = s["stop"] | p.isNull() | q.isNull() | (q <= 0) | (q > max_den)
        rem = s["x"] - F.floor(s["x"])
        ends = rem <= 2.220446049250313e-16
        names = ("x", "p0", "q0", "p1", "q1", "bn", "bd")
        stopped = F.struct(*[s[n].alias(n) for n in names], F.lit(True).alias("stop"))
        nxt = F.when(ends, s["x"]).otherwise(F.try_divide(F.lit(1.0), rem))
        return F.when(F.coalesce(bad, F.lit(True)), stopped).otherwise(
            F.struct(nxt.alias("x"), s["p1"].alias("p0"), s["q1"].alias("q0"), p.alias("p1"), q.alias("q1"), p.alias("bn"), q.alias("bd"), ends.alias("stop"))
        )

    best = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)
    sign = F.when(v < 0, -1).otherwise(1)
    known = F.lit(max_den > 0) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(known, rational(best["bn"] * sign, best["bd"])).otherwise(F.struct(z.alias("num"), one.alias("den")))


# Instants: pts (long) in a timebase tb (rational).


def seconds(pts: Column, tb: Column) -> Column:
    """Exact seconds of an instant."""
    return multiply(rational(pts, F.lit(1)), tb)


def seconds_double(pts: Column, tb: Column) -> Column:
    return pts.cast("double") * tb["num"].cast("double") / tb["den"].cast("double")


def convert(pts: Column, tb: Column, to: Column) -> Column:
    """The same instant's pts in another timebase, truncated toward zero."""
    ratio = divide(tb, to)
    return to_long(_wide(F.call_function("div", _wide(_wide(pts) * _wide(ratio["num"])), _wide(ratio["den"]))))


def from_seconds(s: Column, tb: Column) -> Column:
    """Nearest pts (halves away from zero); 0 where seconds are not finite."""
    v = F.round(s * tb["den"] / tb["num"])
    return F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")), v.cast("long")).otherwise(F.lit(0).cast("long"))


def offset(pts: Column, tb: Column, delta: Column) -> Column:
    """pts moved by an exact number of seconds, saturating."""
    d = F.coalesce(round_half_away(divide(delta, tb)), F.lit(0).cast("long"))
    edge = F.when(d > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
    return F.coalesce(F.try_add(pts, d), edge)


def compare(p1: Column, tb1: Column, p2: Column, tb2: Column) -> Column:
    """-1, 0 or 1, exactly, across timebases."""
    left = _wide(p1) * _wide(tb1["num"] * tb2["den"])
    right = _wide(p2) * _wide(tb2["num"] * tb1["den"])
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def format_hms(s: Column) -> Column:
    """HH:MM:SS.mmm of seconds; dashes for negative and not finite."""
    ok = s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s < float("inf"))
    ms = F.round(s * 1000).cast("long")
    div = lambda n: F.call_function("div", ms, F.lit(n).cast("long"))
    return F.when(ok, F.format_string("%02d:%02d:%02d.%03d", div(3_600_000), div(60_000) % 60, div(1000) % 60, ms % 1000)).otherwise("--:--:--.---")


def six_decimals(s: Column) -> Column:
    return F.format_string("%.6f", s)


def contains(start: Column, end: Column, t: Column) -> Column:
    """Half-open [start, end)."""
    return (start <= t) & (t < end)


def duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def frame_at(s: Column, fps: Column) -> Column:
    """Frame index at a time: the nearest, at least 0."""
    return F.greatest(F.round(s * fps), F.lit(0.0)).cast("long")


def argument(r: Column) -> Column:
    """"n" for whole rates, else "n/d"; the numerator is at least 1."""
    n = F.greatest(r["num"], F.lit(1).cast("long")).cast("string")
    return F.when(r["den"].isin(0, 1), n).otherwise(F.concat(n, F.lit("/"), r["den"].cast("string")))


def after_pulldown(fps: Column) -> Column:
    """4/5 of a rate, exactly."""
    return F.coalesce(multiply(fps, F.struct(F.lit(4).cast("long").alias("num"), F.lit(5).cast("long").alias("den"))), fps)


def human_duration(s: Column, colons: bool = False) -> Column:
    """1h02m03s, 2m03s or 3s; with colons 1:02:03 or 2:03."""
    t = F.floor(s).cast("long")
    div = lambda a, n: F.call_function("div", a, F.lit(n).cast("long"))
    h, m, r = div(t, 3600), div(t, 60) % 60, t % 60
    if colons:
        return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def fnv1a64(data: Column) -> Column:
    """FNV-1a of a binary column as 16 hex digits; 64-bit wrap by 32-bit halves."""
    mask, prime = F.lit(0xFFFFFFFF).cast("long"), F.lit(0x1B3).cast("long")
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    text = F.hex(data)

    def step(s: Column, i: Column) -> Column:
        byte = F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        lo = s["lo"].bitwiseXOR(byte)
        low = lo * prime
        hi = s["hi"] * prime + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(places, start, step)
    return F.lower(F.concat(F.lpad(F.hex(end["hi"]), 8, "0"), F.lpad(F.hex(end["lo"]), 8, "0")))


def job_id(source: Column, target: Column, options: Column) -> Column:
    """"cli-", the source's stem (its first 32 letters, digits, - and _) if any is left, and the hash
    of source, output and options with NUL between."""
    zero = F.unhex(F.lit("00"))
    h = fnv1a64(F.concat(source.cast("binary"), zero, F.coalesce(target, F.lit("")).cast("binary"), zero, options.cast("binary")))
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1), r"[^A-Za-z0-9_-]", "")
    stem = F.substring(stem, 1, 32)
    return F.concat(F.lit("cli-"), F.when(stem != "", F.concat(stem, F.lit("-"))).otherwise(""), h)


def fingerprint(profile: Column, *extras: Column) -> Column:
    """Profile as JSON and further options, with U+0001 between."""
    return F.concat_ws("\u0001", F.to_json(profile), *extras)
