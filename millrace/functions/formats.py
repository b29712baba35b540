"""Format checks as boolean Columns; null in, null out."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of formats. Those without $ match a beginning.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[\d]{8,15}$"
URL = r"^https?://(?:[-\w.])+(?::[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:[\w.])*)?)?"
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
IBAN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+"
POSTAL_CODE = {"ID": r"^\d{5}", "US": r"^\d{5}(-\d{4})?", "GB": r"^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}", "CA": r"^[A-Z]\d[A-Z] \d[A-Z]\d"}
SOCIAL_SECURITY = {"US": r"^\d{3}-\d{2}-\d{4}", "": r"^\d{9,11}"}
PASSPORT = {"ID": r"^[A-Z]\d{7}", "US": r"^[A-Z0-9]{6,9}", "GB": r"^[0-9]{9}"}
LICENSE_PLATE = {"ID": r"^[A-Z]{1,2} \d{1,4} [A-Z]{1,3}", "US": r"^[A-Z0-9]{2,8}", "": r"^[A-Z0-9\s]{2,10}"}
# The pattern library.
PATTERNS = {
    "email": EMAIL,
    "phone_simple": r"^\+?[\d\s\-\(\)]{7,15}$",
    "url": r"^https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "mac_address": r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "social_security": r"^\d{3}-?\d{2}-?\d{4}$",
    "postal_code_us": r"^\d{5}(-\d{4})?$",
    "postal_code_uk": r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$",
    "isbn": r"^(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}$|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}$|97[89][0-9]{10}$|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}$)(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]$",
    "hex_color": r"^#(?:[0-9a-fA-F]{3}){1,2}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "slug": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "username": r"^[a-zA-Z0-9_]{3,20}$",
    "password_strong": r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)(?=.*[@$!%*?&])[A-Za-z\d@$!%*?&]{8,}$",
}


def matches(c: Column, pattern: str) -> Column:
    """The pattern matches from the beginning."""
    return c.rlike(f"^(?:{pattern})")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\-\(\)]", "")


def is_ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.coalesce(F.forall(parts, lambda p: F.coalesce(p.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(p).try_cast("int").between(0, 255), F.lit(False))), F.lit(False))


def is_credit_card(c: Column) -> Column:
    plain = F.regexp_replace(c, r"[\s\-]", "")
    return F.when(plain.rlike(r"^\d{13,19}$"), F.call_function("luhn_check", plain)).otherwise(c.isNull() & F.lit(None) | F.lit(False))


def is_iban(c: Column) -> Column:
    plain = F.regexp_replace(F.upper(c), r"\s", "")
    return plain.rlike(IBAN) & F.length(plain).between(15, 34)


def parsed_date(c: Column, formats: tuple[str, ...] = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy")) -> Column:
    """The date by the first format that takes it."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats))


def parsed_datetime(c: Column, formats: tuple[str, ...] = ("yyyy-M-d H:m:s", "d/M/yyyy H:m:s")) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def _by_country(table: dict[str, str], other: str, raised: bool = False) -> Callable[..., Column]:
    def check(c: Column, country: str = "ID") -> Column:
        return (F.upper(c) if raised else c).rlike(table.get(country, other))

    return check


#: Checks by the name that a rule uses.
FORMATS: dict[str, Callable[..., Column]] = {
    "email": lambda c: c.rlike(EMAIL),
    "phone": lambda c: digits_only(c).rlike(PHONE),
    "date": lambda c: parsed_date(c).isNotNull(),
    "datetime": lambda c: parsed_datetime(c).isNotNull(),
    "url": lambda c: c.rlike(URL),
    "ipv4": is_ipv4,
    "ipv6": lambda c: c.rlike(IPV6),
    "uuid": lambda c: c.rlike(UUID),
    "credit_card": is_credit_card,
    "iban": is_iban,
    "postal_code": _by_country(POSTAL_CODE, POSTAL_CODE["ID"]),
    "social_security": lambda c, country="US": c.rlike(SOCIAL_SECURITY.get(country, SOCIAL_SECURITY[""])),
    "passport": _by_country(PASSPORT, PASSPORT["US"], raised=True),
    "license_plate": _by_country(LICENSE_PLATE, LICENSE_PLATE[""], raised=True),
}


def email_parts(c: Column) -> Column:
    """The local part and the domain, in lower case, of a valid address; null else."""
    ok = c.rlike(EMAIL)
    return F.when(ok, F.struct(F.substring_index(c, "@", 1).alias("local"), F.lower(F.substring_index(c, "@", -1)).alias("domain")))


def url_parts(c: Column) -> Column:
    """Scheme, host, path, query and fragment of a URL; null where it can't be parsed."""
    part = lambda name: F.try_parse_url(c, F.lit(name))
    return F.struct(*(part(n.upper() if n != "fragment" else "REF").alias(n) for n in ("protocol", "host", "path", "query", "fragment")))


# Networks by the registries of special-purpose addresses.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC_IN_PRIVATE_V4 = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_V4 = ("100.64.0.0/10",)
PRIVATE_V6 = ("::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_IN_PRIVATE_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
RESERVED_V6 = ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")
MAPPED_V4 = "00000000000000000000ffff"


def _within(hexed: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address in hexadecimal lies in one of the networks."""
    known = [ipaddress.ip_network(n) for n in networks]
    return reduce(lambda a, b: a | b, (hexed.between(n[0].packed.hex(), n[-1].packed.hex()) for n in known))


def ipv4_hex(c: Column) -> Column:
    """Eight hexadecimal digits of a dotted address; null for what isn't one."""
    octets = F.transform(F.split(c, r"\."), lambda p: p.try_cast("int"))
    valid = c.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & F.forall(octets, lambda o: o <= 255)
    return F.when(valid, F.lower(F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o), 2, "0")), "")))


def ipv6_hex(c: Column) -> Column:
    """32 hexadecimal digits of an address in any of its forms; null for what isn't one."""
    tail = ipv4_hex(F.regexp_extract(c, r":(\d+\.\d+\.\d+\.\d+)$", 1))
    plain = F.lower(F.when(tail.isNotNull(), F.concat(F.regexp_replace(c, r"[^:]*$", ""), F.left(tail, F.lit(4)), F.lit(":"), F.right(tail, F.lit(4)))).otherwise(c))
    halves = F.split(plain, "::")
    part = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    left, right = part(0), part(1)
    given = F.size(left) + F.size(right)
    whole = F.when(plain.contains("::"), (given <= 7) & (F.size(halves) == 2)).otherwise(given == 8)
    shaped = plain.rlike("^[0-9a-f:]+$") & ~plain.rlike("[0-9a-f]{5}|:::|^:[^:]|[^:]:$")
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)
    return F.when(shaped & whole, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def ip_properties(c: Column) -> Column:
    """Version of an IPv4 or IPv6 address, what kind of network it belongs to, and its full form; null for what isn't one.

    An IPv4 address mapped into IPv6 is private, global or a loop back as that address is.
    """
    t = F.trim(c)
    four, six = ipv4_hex(t), ipv6_hex(t)
    inner = F.coalesce(four, F.when(F.left(six, F.lit(24)) == MAPPED_V4, F.right(six, F.lit(8))))
    private4 = _within(inner, PRIVATE_V4) & ~_within(inner, PUBLIC_IN_PRIVATE_V4)
    private6 = _within(six, PRIVATE_V6) & ~_within(six, PUBLIC_IN_PRIVATE_V6)
    is_private = F.coalesce(private4, private6)
    found = F.struct(
        F.when(four.isNotNull(), 4).otherwise(6).alias("version"),
        is_private.alias("is_private"),
        F.coalesce(~private4 & ~_within(inner, SHARED_V4), ~private6).alias("is_global"),
        F.coalesce(_within(inner, ("127.0.0.0/8",)), six == "1".rjust(32, "0")).alias("is_loopback"),
        F.coalesce(_within(four, ("224.0.0.0/4",)), _within(six, ("ff00::/8",))).alias("is_multicast"),
        F.coalesce(_within(four, ("169.254.0.0/16",)), _within(six, ("fe80::/10",))).alias("is_link_local"),
        F.coalesce(_within(four, ("240.0.0.0/4",)), _within(six, RESERVED_V6)).alias("is_reserved"),
        F.coalesce(F.when(four.isNotNull(), t), F.regexp_replace(six, "(.{4})(?=.)", "$1:")).alias("exploded"),
    )
    return F.when(four.isNotNull() | six.isNotNull(), found)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value; the parser stops after a first value, so its end is looked at, too."""
    t = F.trim(c)
    closed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    plain = t.rlike(r'^("([^"\\]|\\.)*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)$')
    return F.when(c.isNotNull(), F.try_parse_json(t).isNotNull() & (closed | plain))
