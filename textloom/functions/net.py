"""E-mail addresses, IP addresses, block lists and file names."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import ColumnOrName, _c
from .udf import kernel

_ATOM = r"[A-Za-z0-9_!#$%&'*+\-~/^`|{}]+"
EMAIL = rf"""(?:"[^"\f\n\r\t\x0B\x08]+"|{_ATOM}(?:\.{_ATOM})*)@(?:[A-Za-z0-9\-]+\.)+[A-Za-z\-]{{2,}}"""
EMAIL_WHOLE = rf"\A{EMAIL}\z"


def is_email(c: ColumnOrName) -> Column:
    return _c(c).rlike(EMAIL_WHOLE)


def extract_emails(c: ColumnOrName) -> Column:
    """Addresses in a text, lower-cased, distinct and sorted."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), _c(c), F.lit(" ")), F.lit(rf"[^a-zA-Z0-9.@+\-]({EMAIL})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


IPV4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z"


def ip_to_long(c: ColumnOrName) -> Column:
    """An IPv4 address as a number; other text: null."""
    byte = lambda i: F.split_part(_c(c), F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(_c(c).rlike(IPV4), byte(1) * 16777216 + byte(2) * 65536 + byte(3) * 256 + byte(4))


def long_to_ip(c: ColumnOrName) -> Column:
    return F.concat_ws(".", *(F.shiftrightunsigned(_c(c), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def _packed(ip: str | None) -> bytes | None:
    try:
        return ipaddress.ip_address(ip.strip()).packed if ip else None
    except ValueError:
        return None


ip_to_bytes = kernel(_packed, T.BinaryType())


def _canonical(ip: str | None) -> str | None:
    try:
        return str(ipaddress.ip_address(ip.strip())) if ip else None
    except ValueError:
        return None


ip_to_text = kernel(_canonical)


def _v6(packed: Column, network: ipaddress.IPv6Network) -> Column:
    bits = F.hex(packed)
    whole, rest = network.prefixlen // 4, network.prefixlen % 4
    start = network.network_address.packed.hex().upper()
    out = F.substring(bits, 1, whole) == start[:whole] if whole else F.lit(True)
    if rest:
        digit = F.conv(F.substring(bits, whole + 1, 1), 16, 10).cast("int")
        out &= F.shiftright(digit, 4 - rest) == int(start[whole], 16) >> (4 - rest)
    return (F.length(packed) == 16) & out


_LOCAL = ("127.0.0.0/8", "10.0.0.0/8", "192.168.0.0/16", "169.254.0.0/16", "172.16.0.0/12", "100.64.0.0/22", "::1/128", "fd00::/8", "fe80::/10")


def _in_networks(c: ColumnOrName, networks: list[str]) -> Column:
    value, packed, out = ip_to_long(c), None, F.lit(False)
    for text in networks:
        network = ipaddress.ip_network(text, strict=False)
        if network.version == 4:
            low, high = int(network.network_address), int(network.broadcast_address)
            out |= F.coalesce(value.between(low, high), F.lit(False))
        else:
            packed = ip_to_bytes(_c(c)) if packed is None else packed
            here = _v6(packed, network)
            if text == "fe80::/10":  # up to fecf only
                here = (F.length(packed) == 16) & F.substring(F.hex(packed), 1, 4).between("FE80", "FECF")
            out |= F.coalesce(here, F.lit(False))
    return out


def is_local(c: ColumnOrName) -> Column:
    """Loopback, private, link-local and shared addresses, of both versions."""
    return _in_networks(c, list(_LOCAL))


def is_local_v4(c: ColumnOrName) -> Column:
    """is_local for IPv4, without Python."""
    return _in_networks(c, [n for n in _LOCAL if ":" not in n])


def is_local_name(names: DataFrame, resolved: DataFrame, name_col: str = "name") -> DataFrame:
    """names with is_local: whether the name, or an address that it resolves to, is local.

    resolved: (name, ip), what a resolver said; a name without an answer that is no address itself
    is not local.
    """
    own = resolved.select(F.col("name").alias("_name"), is_local("ip").alias("_local")).groupBy("_name").agg(F.max("_local").alias("_local"))
    out = names.join(own, names[name_col] == own["_name"], "left")
    return out.select(*(names[c] for c in names.columns), (F.coalesce("_local", F.lit(False)) | is_local(names[name_col]) | F.coalesce(names[name_col] == "localhost", F.lit(False))).alias("is_local"))


def ip_match(c: ColumnOrName, allowed: str) -> Column:
    """Whether an address is in a comma-separated list of addresses, networks, `local`, `any` and `none`."""
    out, networks = F.lit(False), []
    for item in (x.strip() for x in allowed.split(",")):
        if item in ("any", "*"):
            out = F.lit(True)
        elif item == "local":
            networks += _LOCAL
        elif item and item != "none":
            networks.append(item)
    return out | _in_networks(c, networks)


def reverse_ip(c: ColumnOrName) -> Column:
    """An IPv4 address' bytes, or an IPv6 address' digits, last first, a dot behind each: the name that DNS lists use."""
    v4 = F.concat(F.array_join(F.reverse(F.split(_c(c), r"\.")), "."), F.lit("."))
    v6 = F.regexp_replace(F.reverse(F.lower(F.hex(ip_to_bytes(_c(c))))), "(.)", "$1.")
    return F.when(_c(c).rlike(IPV4), v4).otherwise(v6)


#: Lists that are asked by default.
BLOCK_LISTS = ("zen.spamhaus.org", "dnsbl.sorbs.net")
ALLOW_LISTS = ("list.dnswl.org", "swl.spamhaus.org")


def block_status(ips: DataFrame, answers: DataFrame, ip_col: str = "ip", allow: tuple[str, ...] = ALLOW_LISTS) -> DataFrame:
    """ips with status (`allowed`, `blocked`, `notlisted`) and the lists that block, by a join with DNS answers.

    answers: (ip, list, answer); only answers 127.0.x.y with y other than 255 count.  An allow list
    overrules all block lists.
    """
    real = answers.where(F.col("answer").rlike(r"\A127\.0\.[0-9]+\.[0-9]+\z") & ~F.col("answer").endswith(".255"))
    per = real.groupBy(F.col("ip").alias("_ip")).agg(F.array_sort(F.collect_set(F.when(~F.col("list").isin(*allow), F.col("list")))).alias("_lists"), F.max(F.col("list").isin(*allow)).alias("_allowed"))
    out = ips.join(per, ips[ip_col] == per["_ip"], "left")
    status = F.when(F.coalesce("_allowed", F.lit(False)), "allowed").when(F.size(F.coalesce("_lists", F.array().cast("array<string>"))) > 0, "blocked").otherwise("notlisted")
    return out.select(*(ips[c] for c in ips.columns), status.alias("status"), F.when(status == "blocked", F.col("_lists")).alias("lists"))


def os_escape(c: ColumnOrName) -> Column:
    """A backslash before every character that a Unix shell could act on."""
    return F.regexp_replace(_c(c), r"([^A-Za-z0-9_.+/\-])", r"\\$1")


def _quoted(name: str | None) -> str | None:
    marked = {"\\\\": "\\\\", "\\'": "\\\\\\'", "'": "\\'"}
    return None if name is None else "'" + re.sub(r"\\\\|\\'|'", lambda m: marked[m[0]], name) + "'"


#: In single quotes; quotes inside, and backslashes before them, get a backslash.
os_filename = kernel(_quoted)
