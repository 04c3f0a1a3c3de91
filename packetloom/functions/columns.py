"""Small Column builders shared by the operators. Everything here stays JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

FLAG_FIN, FLAG_SYN, FLAG_RST, FLAG_PSH, FLAG_ACK, FLAG_URG, FLAG_ECE, FLAG_CWR = (
    0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40, 0x80)


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_flag(flags: Column | str, mask: int) -> Column:
    """True when any bit of ``mask`` is set; an absent flag byte counts as 0."""
    return F.coalesce(c(flags), F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def div(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """``num / den`` where ``den`` is positive, else ``otherwise`` (NULL by default)."""
    out = F.when(den > 0, num.cast("double") / den)
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def bucket(ts: Column | str, seconds: int) -> Column:
    return F.floor(c(ts) / F.lit(seconds)).cast("bigint")


def set_size(col: Column) -> Column:
    """Distinct count of a domain with a fixed bound (ports, windows, protocols) without expanding the rows.

    The set is merged map-side and never outgrows the domain; unbounded domains (peers) must not use it.
    """
    return F.size(F.collect_set(col)).cast("bigint")


def joined_set(col: Column, sep: str = ",") -> Column:
    """Sorted distinct values of a bounded domain, as one string."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def tags(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def tag_string(*pairs: tuple[Column, str], sep: str = ",") -> Column:
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for cond, name in pairs])


def choose(*pairs: tuple[Column, object], default: object = None) -> Column:
    """Ordered ``when`` chain: the first condition that holds wins."""
    def as_col(value):
        return value if isinstance(value, Column) else F.lit(value)
    chain = reduce(lambda acc, p: (F if acc is None else acc).when(p[0], as_col(p[1])), pairs, None)
    return chain.otherwise(as_col(default))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and SHA-256 over the ``:``-joined parts; a NULL part and a ``:`` inside a part keep texts apart."""
    plain = lambda p: F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    text = F.concat_ws(":", *[F.coalesce(plain(p), F.lit("\\N")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.sha2(text, 256))


def r(col: Column, digits: int = 6) -> Column:
    """Round half up; the nudge settles decimal ties the same way whatever the last binary digit is."""
    return F.round(col.cast("double") + F.lit(1e-9), digits) + F.lit(0.0)


def private_ip(ip: Column | str) -> Column:
    """RFC 1918 and loopback test on the text form of an IPv4 address."""
    return F.coalesce(c(ip).rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit(False))


def subnet_24(ip: Column | str) -> Column:
    parts = F.split(c(ip), r"\.")
    return F.when(F.size(parts) == 4,
                  F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0/24"))).otherwise(F.lit("other"))
