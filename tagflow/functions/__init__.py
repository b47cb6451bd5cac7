"""Column functions that step bodies use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower case of A to Z alone (F1)."""
    return F.translate(s, UPPER, LOWER)


def words(s: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def count_overlapping(s: Column, word: str) -> Column:
    """Occurrences of ``word``, overlapping ones too (A3)."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in word)
    return F.regexp_count(s, F.lit(f"(?={quoted})")).cast("long")


def last_place(s: Column, sub: Column) -> Column:
    """The 1-based place of the last occurrence, 0 if none."""
    return F.when(F.instr(F.reverse(s), F.reverse(sub)) > 0, F.length(s) - F.instr(F.reverse(s), F.reverse(sub)) - F.length(sub) + 2).otherwise(0)


# The coefficients of the polynomial approximation of the normal distribution.
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_STEP, NORMAL_SCALE = 0.2316419, 0.39894228040143270286


def normal_cdf(x: Column) -> Column:
    """The cumulative normal distribution by its five-term polynomial."""
    k = 1 / (1 + NORMAL_STEP * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(NORMAL):
        poly = (poly + c) * k
    upper = 1 - NORMAL_SCALE * F.exp(-x * x / 2) * poly
    return F.when(x < 0, 1 - upper).otherwise(upper)


def option_price(spot: Column, strike: Column, rate: Column, volatility: Column, years: Column, is_put: Column) -> Column:
    """The price of a European option (Q19)."""
    root = volatility * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + volatility * volatility / 2) * years) / root
    d2 = d1 - root
    later = strike * F.exp(-rate * years)
    call = spot * normal_cdf(d1) - later * normal_cdf(d2)
    put = later * (1 - normal_cdf(d2)) - spot * (1 - normal_cdf(d1))
    return F.when(is_put, put).otherwise(call)


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_abs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])
