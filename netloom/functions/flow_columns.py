"""Scalar expressions of flow telemetry, all built-in functions: buckets, addresses, visibility, protocols, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMEZONE = "America/Los_Angeles"
FIVE_MINUTES = 300
#: Seconds of the fixed-width granularities; days follow the local calendar.
WIDTHS = {"5m": 300, "30m": 1800, "1h": 3600}
GRANULARITIES = ("5m", "30m", "1h", "1d")
VISIBILITIES = ("literal", "anonymized")
#: Names and aliases of IP protocols that records may carry in place of numbers: the common table /etc/protocols up to 255 and the
#: reference's fallback, fixed here so that results don't depend on the machine. IPIP is 94, as in that table (the fallback, for
#: machines without one, says 4).
PROTOCOLS = {
    "HOPOPT": 0, "IP": 0, "ICMP": 1, "IGMP": 2, "GGP": 3, "IP-ENCAP": 4, "IPENCAP": 4, "ST": 5, "TCP": 6, "EGP": 8, "IGP": 9,
    "PUP": 12, "UDP": 17, "HMP": 20, "XNS-IDP": 22, "RDP": 27, "ISO-TP4": 29, "DCCP": 33, "XTP": 36, "DDP": 37, "IDPR-CMTP": 38,
    "IPV6": 41, "IPV6-ROUTE": 43, "IPV6-FRAG": 44, "IDRP": 45, "RSVP": 46, "GRE": 47, "ESP": 50, "IPSEC-ESP": 50, "AH": 51,
    "IPSEC-AH": 51, "SKIP": 57, "ICMP6": 58, "ICMPV6": 58, "IPV6-ICMP": 58, "IPV6-NONXT": 59, "IPV6-OPTS": 60, "CPHB": 73,
    "RSPF": 73, "VMTP": 81, "EIGRP": 88, "OSPF": 89, "OSPFIGP": 89, "AX.25": 93, "IPIP": 94, "ETHERIP": 97, "ENCAP": 98,
    "PIM": 103, "IPCOMP": 108, "VRRP": 112, "L2TP": 115, "ISIS": 124, "SCTP": 132, "FC": 133, "MOBILITY-HEADER": 135,
    "UDPLITE": 136, "MPLS-IN-IP": 137, "MANET": 138, "HIP": 139, "SHIM6": 140, "WESP": 141, "ROHC": 142, "ETHERNET": 143,
}
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Dotted text without leading zeros, as a capture has it, and with them, as a mapped CSV may have it.
IPV4_STRICT = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
IPV4 = rf"^0*{_OCTET}(\.0*{_OCTET}){{3}}$"


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one ::, of which the last two may be dotted."""
    group, dotted = "[0-9A-Fa-f]{1,4}", rf"{_OCTET}(\.{_OCTET}){{3}}"
    tail = lambda n: f"({group}(:{group}){{0,{n - 1}}}|({group}:){{0,{n - 2}}}{dotted})?" if n >= 2 else f"({group})?" if n == 1 else ""
    forms = [f"({group}:){{7}}{group}", f"({group}:){{6}}{dotted}", f"::{tail(7)}"]
    forms += [f"({group}:){{{n}}}:{tail(7 - n)}" for n in range(1, 8)]
    return "^(" + "|".join(forms) + ")$"


IPV6 = _ipv6_pattern()


def epoch_of(ts: str | Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone, in any session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(c).cast("long") * 3600 + F.minute(c) * 60 + F.second(c)


def clock(seconds: Column) -> Column:
    """The UTC wall clock of epoch seconds, as a timestamp without zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def floor_to(seconds: Column, width: int) -> Column:
    """The bucket start, towards minus infinity."""
    return seconds - F.pmod(seconds, F.lit(width))


def bucket_start(seconds: Column, granularity: str, tz: str = TIMEZONE) -> Column:
    """The start of the bucket in local time; both folds of a repeated hour stay apart."""
    if granularity == "5m":
        return floor_to(seconds, FIVE_MINUTES)
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), clock(seconds))
    if granularity == "1d":
        return epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), F.to_date(local).cast("timestamp_ntz")))
    return seconds - F.pmod(epoch_of(local), F.lit(WIDTHS[granularity]))


def bucket_end(start: Column, granularity: str, tz: str = TIMEZONE) -> Column:
    """Start and width; a day ends at the next local midnight."""
    if granularity != "1d":
        return start + WIDTHS[granularity]
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), clock(start))
    return epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), F.date_add(F.to_date(local), 1).cast("timestamp_ntz")))


def visibility(tos: Column, bit: int) -> Column:
    """Bit 2 tells whether the source is anonymized, bit 1 whether the destination is."""
    return F.when(tos.cast("long").bitwiseAND(bit) != 0, "anonymized").otherwise("literal")


def protocol_class(protocol: Column) -> Column:
    return F.when(protocol == 6, "tcp").when(protocol == 17, "udp").when(protocol.isin(1, 58), "icmp").otherwise("other")


def protocol_number(text: Column, more: dict[str, int] | None = None) -> Column:
    """A name or a number; blank is 0, what is neither is null. more: names laid over PROTOCOLS, in any case."""
    names = PROTOCOLS | {k.upper(): v for k, v in (more or {}).items()}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    upper = F.upper(F.trim(text))
    return F.when(F.coalesce(upper, F.lit("")) == "", 0).otherwise(F.coalesce(F.try_element_at(known, upper), upper.try_cast("int")))


def resolve_duration(explicit_seconds: Column, start_ms: Column, end_ms: Column) -> Column:
    """Explicit seconds win, else end - start if both are there, else null."""
    return F.coalesce((explicit_seconds.try_cast("decimal(38,6)") * 1000).cast("long"), end_ms - start_ms)


def resolve_port(text: Column, protocol: Column) -> Column:
    """A capture's port: ICMP's dotted type.code counts as port 0; blank is null, other dotted forms are invalid (null)."""
    dotted = text.rlike(r"^\d{1,3}\.\d{1,3}$") & protocol.isin(1, 58)
    parts = F.split(text, r"\.")
    in_range = (F.get(parts, F.lit(0)).try_cast("int") <= 255) & (F.get(parts, F.lit(1)).try_cast("int") <= 255)
    return F.when(dotted & in_range, 0).otherwise(text.try_cast("int"))


def present_ttl(ttl: Column) -> Column:
    """0 says that the capture has no value."""
    return F.nullif(ttl, F.lit(0))


def ipv4_text(u32: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftright(u32, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(text: Column) -> Column:
    """The address as an unsigned number, null if it isn't IPv4."""
    parts = F.split(text, r"\.")
    number = sum(F.get(parts, F.lit(k)).try_cast("long") * (1 << (24 - 8 * k)) for k in range(4))
    return F.when(text.rlike(IPV4), number)


def ip_version(text: Column, strict: bool = False) -> Column:
    """4 or 6 by form, null for neither."""
    return F.when(text.rlike(IPV4_STRICT if strict else IPV4), 4).when(text.rlike(IPV6), 6)


def ip_digits(text: Column) -> Column:
    """The address as 32 hexadecimal digits (8 for IPv4), which sort as the addresses do; null if it is none."""
    hex4 = lambda number: F.lpad(F.lower(F.hex(number)), 4, "0")
    octets = F.split(F.regexp_extract(text, r"([^:]*)$", 1), r"\.")
    octet = lambda k: F.get(octets, F.lit(k)).try_cast("int")
    dotted = F.concat_ws(":", hex4(octet(0) * 256 + octet(1)), hex4(octet(2) * 256 + octet(3)))
    groups = F.when(text.contains("."), F.concat(F.regexp_replace(text, r"[^:]*$", ""), dotted)).otherwise(text)
    sides = F.split(groups, "::")
    of = lambda k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    padded = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    left, right = of(0), of(1)
    zeros = F.repeat(F.lit("0000"), 8 - F.size(left) - F.size(right))
    return F.when(text.rlike(IPV4), F.lpad(F.lower(F.hex(ipv4_number(text))), 8, "0")).when(text.rlike(IPV6), F.concat(padded(left), zeros, padded(right)))
