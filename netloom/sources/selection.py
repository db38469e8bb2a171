"""Which flows a product is about: an address prefix and visibilities, checked and put into predicates."""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C

_KEYS = {"version", "kind", "ip_prefix", "src_visibility", "dst_visibility"}


@dataclass(frozen=True)
class Selection:
    """ip_prefix: source or destination is in the network; visibilities: literal, anonymized or none for any."""

    ip_prefix: str | None = None
    src_visibility: str | None = None
    dst_visibility: str | None = None

    def __post_init__(self):
        if self.ip_prefix:
            object.__setattr__(self, "ip_prefix", str(ipaddress.ip_network(self.ip_prefix, strict=False)))  # host bits go
        for v in (self.src_visibility, self.dst_visibility):
            if v is not None and v not in C.VISIBILITIES:
                raise ValueError(f"a visibility is one of {C.VISIBILITIES}, not {v!r}")

    @classmethod
    def from_payload(cls, payload: Mapping | None) -> Selection:
        """The selection of a JSON object, checked; none selects all."""
        if payload is None:
            return cls()
        if not isinstance(payload, Mapping):
            raise ValueError("a selection must be an object")
        if unknown := set(payload) - _KEYS:
            raise ValueError(f"unknown keys of a selection: {sorted(unknown)}")
        if payload.get("version", 1) != 1:
            raise ValueError("the selection's version must be 1")
        if payload.get("kind") not in (None, "all", "flows"):
            raise ValueError("the selection's kind must be all or flows")
        given = {k: payload.get(k) or None for k in ("ip_prefix", "src_visibility", "dst_visibility")}
        if payload.get("kind") == "all" and any(given.values()):
            raise ValueError("a selection of all has no criteria")
        return cls(**given)

    @property
    def unrestricted(self) -> bool:
        return self == Selection()

    def payload(self) -> dict:
        """The normal form, which names the product."""
        if self.unrestricted:
            return {"version": 1, "kind": "all"}
        return {"version": 1, "kind": "flows", "ip_prefix": self.ip_prefix, "src_visibility": self.src_visibility, "dst_visibility": self.dst_visibility}

    def select(self, flows: DataFrame) -> DataFrame:
        """The flows that match. A prefix becomes two comparisons a side: of numbers for IPv4, of hexadecimal digits for IPv6."""
        out = flows
        if self.ip_prefix:
            net = ipaddress.ip_network(self.ip_prefix)
            low, high = int(net.network_address), int(net.broadcast_address)
            if net.version == 4:
                on = F.col("src_u32").between(low, high) | F.col("dst_u32").between(low, high)
            else:
                digits = lambda c: C.ip_digits(F.col(c)).between(f"{low:032x}", f"{high:032x}")
                on = digits("src_ip") | digits("dst_ip")
            out = out.where((F.col("ip_version") == net.version) & on)
        if self.src_visibility:
            out = out.where(C.visibility(F.col("src_tos"), 2) == self.src_visibility)
        return out.where(C.visibility(F.col("src_tos"), 1) == self.dst_visibility) if self.dst_visibility else out
