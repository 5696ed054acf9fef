"""Predicates that let a URL, a response or a record through."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import psl
from gossamer.functions import text as tx
from gossamer.functions import url as ur

# Extensions that are not followed by default.
DENIED = (
    ".3g2 .3gp .7z .apk .arj .avi .axd .bmp .csv .deb .dll .doc .drv .eot .exe .flv .gif .gifv .gz .h264 .ico .iso .jar .jpeg .jpg .lock .m4a .m4v .map .mkv .mov .mp3 .mp4 .mpeg .mpg .msi "
    ".ogg .ogm .ogv .otf .pdf .pkg .png .ppt .psd .rar .rm .rpm .svg .swf .sys .tar.gz .tar .tif .tiff .ttf .txt .vob .wav .webm .webp .wmv .woff .woff2 .xcf .xls .xlsx .zip"
).split()


@dataclass(frozen=True)
class Scope:
    """URL rules and a host rule.

    ``field`` is rdn (default), dn, fqdn, or a pattern the host must match.
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    field: str = "rdn"
    off: bool = False

    def __post_init__(self) -> None:
        for p in (*self.include, *self.exclude):
            tx.check_pattern(p)
        if self.field not in ("rdn", "dn", "fqdn"):
            tx.check_pattern(self.field)


def _any(u: Column, patterns: tuple[str, ...]) -> Column:
    return tx.search(u, "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def host_in_scope(host: Column, root: Column, field: str = "rdn") -> Column:
    """fqdn and IP hosts by equality; rdn by suffix, without a dot before it; dn by the label within the host.

    An empty label matches every host; an empty registrable domain matches none.
    """
    host, root = F.lower(host), F.lower(root)
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.startswith("[")
    if field == "rdn":
        r = psl.rdn(root)
        rule = F.when(r == "", host == root).otherwise(host.endswith(r))
    elif field == "dn":
        rule = F.contains(host, psl.dn(root))
    elif field == "fqdn":
        rule = host == root
    else:
        rule = tx.search(host, field)
    return F.when(ip, host == root).otherwise(rule)


def in_scope(u: Column, root_host: Column, scope: Scope = Scope()) -> Column:
    """URL rules (an exclusion wins) and the host rule, both needed; null is out."""
    if scope.off:
        return F.lit(True)
    ok = host_in_scope(ur.hostname(u), root_host, scope.field)
    if scope.exclude:
        ok = ok & ~_any(u, scope.exclude)
    if scope.include:
        ok = ok & _any(u, scope.include)
    return F.coalesce(ok, F.lit(False))


def extension(u: Column) -> Column:
    """Last extension of the path in lower case; of the whole URL where the path is empty; '' for none."""
    where = F.when(ur.raw_path(u) == "", F.regexp_replace(u, r"(?s)[?#].*\z", "")).otherwise(ur.raw_path(u))
    return F.lower(F.regexp_extract(where, r"(\.[^./]*)\z", 1))


def normal_extension(e: str) -> str:
    """Lower case with a leading dot."""
    e = e.lower()
    return e if e.startswith(".") else "." + e


def extension_allowed(u: Column, match: tuple[str, ...] = (), deny: tuple[str, ...] = (), defaults: bool = True) -> Column:
    """A match list alone decides where there is one; otherwise what is not denied passes."""
    ext = extension(u)
    if match:
        return F.coalesce(ext.isin([normal_extension(x) for x in match]), F.lit(False))
    banned = sorted({normal_extension(x) for x in deny} | (set(DENIED) if defaults else set()))
    return F.coalesce(~ext.isin(banned), F.lit(True)) if banned else F.lit(True)


def is_redirect(status: Column) -> Column:
    return F.coalesce(status.between(300, 399), F.lit(False))


def has_response(df: DataFrame) -> Column:
    return F.col("response").isNotNull() & F.col("response.raw").isNotNull()


def capped(body: Column, size: int = 4 * 1024 * 1024) -> Column:
    """The first bytes of a body; a character cut in two goes."""
    return F.when(F.octet_length(body) <= size, body).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(body, "utf-8"), 1, size).cast("string")), r"\x{fffd}+$", ""))


PRIVATE = tuple("10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 0.0.0.0/8 100.64.0.0/10 ::1/128 fc00::/7 fe80::/10".split())


def excluded_host(host: Column, rules: tuple[str, ...]) -> Column:
    """Rules: private-ips, an address or network, a :port is ignored, any other text is a pattern; cdn does nothing."""
    nets: list = []
    patterns: list[str] = []
    for r in rules:
        if r == "cdn":
            continue
        for x in PRIVATE if r == "private-ips" else (r,):
            try:
                nets.append(ipaddress.ip_network(x, strict=False))
            except ValueError:
                patterns.append(tx.check_pattern(x))

    @F.pandas_udf("boolean")
    def inside(s: pd.Series) -> pd.Series:
        def one(h: str | None) -> bool:
            try:
                ip = ipaddress.ip_address((h or "").strip("[]"))
            except ValueError:
                return False
            return any(ip.version == n.version and ip in n for n in nets)

        known = {h: one(h) for h in s.unique()}
        return s.map(known).fillna(False).astype(bool)

    out = inside(host) if nets else F.lit(False)
    return out | _any(host, tuple(patterns)) if patterns else out


def asn_networks(table: DataFrame, number: str) -> tuple[str, ...]:
    """The networks of an autonomous system ('AS' and digits) in a table (asn, network) of your own, as rules for ``excluded_host``."""
    digits = number.upper().removeprefix("AS")
    return tuple(r.network for r in table.filter(F.regexp_replace(F.upper(F.col("asn").cast("string")), "^AS", "") == digits).select("network").distinct().orderBy("network").collect())  # one system's networks


def excluded_url(u: Column, rules: tuple[str, ...], asn: DataFrame | None = None) -> Column:
    """Rules of ``excluded_host`` for the url's host, ':8080' for its port, and 'AS64500' for an autonomous system of the table ``asn``."""
    hosts: list[str] = []
    ports: list[str] = []
    for r in rules:
        if re.fullmatch(r":\d+", r):
            ports.append(r[1:])
        elif re.fullmatch(r"(?i)as\d+", r):
            if asn is None:
                raise ValueError(f"{r} needs a table of autonomous systems")
            hosts += asn_networks(asn, r)
        else:
            hosts.append(r)
    out = excluded_host(ur.hostname(u), tuple(hosts)) if hosts else F.lit(False)
    return out | ur.port(u).isin(ports) if ports else out


def expand_network(cidr: str) -> list[str]:
    """All addresses of a network, for seeds (at most 65,536)."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.num_addresses > 65_536:
        raise ValueError(f"{cidr} holds too many addresses to list")
    return [str(a) for a in net]


def unique_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; ties go by all columns given.  Null keys are one key."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


def first_content(df: DataFrame, body: str = "body", order: str = "response_id") -> DataFrame:
    """Adds content_hash (md5 of the bytes) and is_first: whether a row is the first with its content.

    Null bodies have no hash and are always first.
    """
    hashed = df.withColumn("content_hash", F.md5(F.encode(F.col(body), "utf-8")))
    lead = hashed.filter("content_hash is not null").groupBy("content_hash").agg(F.min(order).alias("__lead"))
    j = hashed.join(lead, "content_hash", "left")
    return j.withColumn("is_first", F.col("content_hash").isNull() | (F.col(order) == F.col("__lead"))).drop("__lead")
