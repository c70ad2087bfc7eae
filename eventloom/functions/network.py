"""Addresses, hosts and the environment."""

from __future__ import annotations

import ipaddress
import os
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, BINARY, BOOL, INT, STRING, Typed, const, first_error

from .codecs import as_bytes
from .convert import fail
from .registry import arrow, fn, need_const

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def number(c: Column) -> Column:
    """An IPv4 address as a number."""
    return F.aggregate(F.transform(F.split(c, "[.]"), lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)])


@fn("ip_aton", "value:str")
def ip_aton(ctx, value: Typed):
    good = value.col.rlike(V4)
    return Typed(INT, F.when(good, number(value.col)), fail(~good, "unable to parse IPv4 address: invalid IPv4 address syntax"))


@fn("ip_ntoa", "value:int")
def ip_ntoa(ctx, value: Typed):
    good = value.col.between(0, 2**32 - 1)
    return Typed(STRING, F.when(good, dotted(value.col)), fail(~good, "cannot convert to bytes, integer does not fit in u32"))


@fn("is_ipv4", "value:str")
def is_ipv4(ctx, value: Typed):
    return Typed(BOOL, value.col.rlike(V4), value.err)


H = "[0-9a-fA-F]{1,4}"
V4_TAIL = V4.strip("^$")
V6 = "^(?:" + "|".join([f"(?:{H}:){{7}}{H}", f"(?:{H}:){{1,7}}:", f"(?:{H}:){{6}}{V4_TAIL}", *[f"(?:{H}:){{1,{n}}}(?::{H}){{1,{7 - n}}}" for n in range(6, 0, -1)], f":(?::{H}){{1,7}}", "::", *[f"(?:{H}:){{1,{n}}}(?::{H}){{0,{5 - n}}}:{V4_TAIL}" for n in range(5, 0, -1)], f"::(?:{H}:){{0,5}}{V4_TAIL}"]) + ")$"


@fn("is_ipv6", "value:str")
def is_ipv6(ctx, value: Typed):
    return Typed(BOOL, value.col.rlike(V6), value.err)


@fn("ip_cidr_contains", "cidr:str/arr, value:str")
def ip_cidr_contains(ctx, cidr: Typed, value: Typed):
    nets = None
    if cidr.is_const:
        nets = [ipaddress.ip_network(c, strict=False) for c in ([cidr.const] if isinstance(cidr.const, str) else cidr.const)]
    if nets is not None and all(n.version == 4 for n in nets):
        n, good = number(value.col), value.col.rlike(V4)
        inside = F.lit(False)
        for net in nets:
            inside = inside | n.between(int(net.network_address), int(net.broadcast_address))
        six = value.col.rlike(V6)
        return Typed(BOOL, F.when(good, inside).when(six, False), fail(~good & ~six, "unable to parse IP address"))

    def run(c, v):
        ip = ipaddress.ip_address(v)
        return any(ip in ipaddress.ip_network(x, strict=False) for x in ([c] if isinstance(c, str) else c))

    return arrow(run, BOOL, cidr, value)


@fn("ip_subnet", "value:str, subnet:str")
def ip_subnet(ctx, value: Typed, subnet: Typed):
    def run(v, s):
        ip = ipaddress.ip_address(v)
        bits = 32 if ip.version == 4 else 128
        if s.startswith("/"):
            n = int(s[1:])
            if not 0 <= n <= bits:
                raise ValueError("subnet cannot be greater than 32 for ipv4 and 128 for ipv6")
            mask = ((1 << n) - 1) << (bits - n)
        else:
            other = ipaddress.ip_address(s)
            if other.version != ip.version:
                raise ValueError("attempting to mask with an address of the other family")
            mask = int(other)
        return str(type(ip)(int(ip) & mask))

    if subnet.is_const and subnet.const.startswith("/") and subnet.const[1:].isdigit() and int(subnet.const[1:]) <= 32:
        n = int(subnet.const[1:])
        mask = ((1 << n) - 1) << (32 - n)
        other = arrow(run, STRING, Typed(STRING, F.when(~value.col.rlike(V4), value.col)), subnet)
        return Typed(STRING, F.when(value.col.rlike(V4), dotted(number(value.col).bitwiseAND(F.lit(mask).cast("bigint")))).otherwise(other.col), F.when(~value.col.rlike(V4), other.err))
    return arrow(run, STRING, value, subnet)


@fn("ip_to_ipv6", "value:str")
def ip_to_ipv6(ctx, value: Typed):
    four, six = value.col.rlike(V4), value.col.rlike(V6)
    return Typed(STRING, F.when(four, F.concat(F.lit("::ffff:"), value.col)).when(six, value.col), fail(~four & ~six, "unable to parse IP address"))


@fn("ipv6_to_ipv4", "value:str")
def ipv6_to_ipv4(ctx, value: Typed):
    def run(v):
        ip = ipaddress.ip_address(v)
        if ip.version == 4:
            return v
        n = int(ip)
        if ip.ipv4_mapped is not None or n >> 32 == 0:
            return str(ipaddress.IPv4Address(n & 0xFFFFFFFF))
        raise ValueError(f"IPV6 address {v} is not compatible with IPV4")

    return arrow(run, STRING, value)


@fn("ip_pton", "value:str")
def ip_pton(ctx, value: Typed):
    return arrow(lambda v: ipaddress.ip_address(v).packed, BINARY, value)


@fn("ip_ntop", "value:str")
def ip_ntop(ctx, value: Typed):
    def run(b):
        if len(b) not in (4, 16):
            raise ValueError(f"IP value must be of length 4 or 16, got {len(b)}")
        return str(ipaddress.ip_address(bytes(b)))

    return arrow(run, STRING, as_bytes(value))


def ip_bytes(v: str) -> tuple[bytes, bool]:
    ip = ipaddress.ip_address(v)
    return (b"\0" * 10 + b"\xff\xff" + ip.packed, True) if ip.version == 4 else (ip.packed, False)


def ip_text(b: bytes) -> str:
    return str(ipaddress.IPv4Address(b[12:])) if b[:12] == b"\0" * 10 + b"\xff\xff" else str(ipaddress.IPv6Address(b))


def prefix_crypt(v: str, key: bytes, seal: bool) -> str:
    """Prefix-preserving: each bit is flipped by a bit that the bits before it give."""
    from .crypto import AES, xor

    one, two = AES(key[:16]), AES(key[16:])
    data, four = ip_bytes(v)
    start = 96 if four else 0
    out = bytearray(data if start else b"\0" * 16)
    padded = 1 << 96 | 0xFFFF if start else 1  # the bits before, led by a one
    for bit in range(start, 128):
        block = (padded & ((1 << 128) - 1)).to_bytes(16, "big")
        mask = xor(one.encrypt(block), two.encrypt(block))[15] & 1
        spot, shift = bit // 8, 7 - bit % 8
        old = data[spot] >> shift & 1
        new = old ^ mask
        out[spot] = out[spot] & ~(1 << shift) | new << shift
        padded = padded << 1 | (old if seal else new)
    return ip_text(bytes(out))


for _name, _seal in (("encrypt_ip", True), ("decrypt_ip", False)):

    def _make(name=_name, seal=_seal):
        @fn(name, "ip:str, key:str, mode:str")
        def lower(ctx, ip: Typed, key: Typed, mode: Typed):
            how = need_const(mode, "mode")
            if how not in ("aes128", "pfx"):
                raise CompileError(403, f"invalid enum variant: {how}")

            def run(v, k):
                from .crypto import AES

                k = bytes(k)
                if len(k) != (16 if how == "aes128" else 32):
                    raise ValueError(f"{how} mode requires a {16 if how == 'aes128' else 32}-byte key (got {len(k)} bytes)")
                if how == "pfx":
                    return prefix_crypt(v, k, seal)
                b, _ = ip_bytes(v)
                return ip_text(AES(k).encrypt(b) if seal else AES(k).decrypt(b))

            return arrow(run, STRING, ip, as_bytes(key))

    _make()


@fn("community_id", "source_ip:str, destination_ip:str, protocol:int, source_port?:int, destination_port?:int, seed?:int=0")
def community_id(ctx, source_ip: Typed, destination_ip: Typed, protocol: Typed, source_port: Typed | None, destination_port: Typed | None, seed: Typed):
    if (source_port is None) != (destination_port is None):
        raise CompileError(402, "src port and dst port should be both set or not set")
    ports = source_port is not None

    def run(a, b, proto, *rest):
        import base64
        import hashlib
        import struct

        *pq, s = rest
        x, y = ipaddress.ip_address(a).packed, ipaddress.ip_address(b).packed
        p, q = (int(pq[0]), int(pq[1])) if ports else (0, 0)
        one_way = False
        # Message types of ICMP and ICMPv6 that answer one another
        pairs = {1: {8: 0, 0: 8, 13: 14, 14: 13, 15: 16, 16: 15, 17: 18, 18: 17, 10: 9, 9: 10}, 58: {128: 129, 129: 128, 133: 134, 134: 133, 135: 136, 136: 135, 130: 131, 131: 130, 144: 145, 145: 144}}
        if proto in pairs and ports:
            if p in pairs[proto]:
                q = pairs[proto][p]
            else:
                one_way = True
        if proto in (6, 17, 132) and not ports:
            raise ValueError("src port and dst port should be set when protocol is tcp/udp/sctp")
        if not one_way and (x, p) > (y, q):
            x, y, p, q = y, x, q, p
        data = struct.pack(">H", int(s)) + x + y + bytes([int(proto), 0]) + (struct.pack(">HH", p, q) if ports else b"")
        return "1:" + base64.b64encode(hashlib.sha1(data).digest()).decode()

    more = [source_port, destination_port] if ports else []
    return arrow(run, STRING, source_ip, destination_ip, protocol, *more, seed)


@fn("get_env_var", "name:str")
def get_env_var(ctx, name: Typed):
    got = os.environ.get(need_const(name, "name"))
    return Typed(STRING, F.lit(got).cast("string"), F.lit("environment variable not found") if got is None else F.when(F.lit(False), F.lit("")))


@fn("get_hostname", "")
def get_hostname(ctx):
    return Typed(STRING, F.lit(socket.gethostname()), F.when(F.lit(False), F.lit("")), nullable=False)


@fn("get_timezone_name", "")
def get_timezone_name(ctx):
    return Typed(STRING, F.current_timezone(), F.when(F.lit(False), F.lit("")), nullable=False)


#: Functions that reach out of the cluster run only with this set in the session.
GATE = "spark.eventloom.network"


def gated(ctx, name: str) -> None:
    if ctx.df.sparkSession.conf.get(GATE, "off") != "on":
        raise CompileError(402, f"{name} reaches the network; set {GATE}=on to allow it")


@fn("dns_lookup", "value:str, qtype?:str=A, class?:str=IN, options?:obj")
def dns_lookup(ctx, value: Typed, qtype: Typed, class_: Typed, options: Typed | None):
    """Addresses alone (A and AAAA), by the system's resolver."""
    gated(ctx, "dns_lookup")
    family = {"A": socket.AF_INET, "AAAA": socket.AF_INET6}.get(qtype.const)
    if family is None:
        raise CompileError(402, f"query type {qtype.const} isn't supported")

    def run(v):
        import json

        found = sorted({x[4][0] for x in socket.getaddrinfo(v, None, family)})
        return json.dumps({"question": [{"domainName": v, "questionType": qtype.const, "class": "IN"}], "answers": [{"domainName": v, "rData": a, "recordType": qtype.const} for a in found]})

    return arrow(run, ANY, value)


@fn("reverse_dns", "value:str")
def reverse_dns(ctx, value: Typed):
    gated(ctx, "reverse_dns")
    return arrow(lambda v: socket.gethostbyaddr(str(ipaddress.ip_address(v)))[0], STRING, value)


@fn("http_request", "url:str, method?:str=get, headers?:obj, body?:str, http_proxy?:str, https_proxy?:str, redact_headers?:bool=true")
def http_request(ctx, url: Typed, method: Typed, headers: Typed | None, body: Typed | None, http_proxy: Typed | None, https_proxy: Typed | None, redact_headers: Typed):
    gated(ctx, "http_request")
    fixed = dict(need_const(headers, "headers") or {})
    data = need_const(body, "body")

    def run(u):
        import urllib.request

        request = urllib.request.Request(u, method=method.const.upper(), headers=fixed, data=data.encode() if data else None)
        with urllib.request.urlopen(request, timeout=10) as r:
            return r.read().decode("utf-8", "replace")

    return arrow(run, STRING, url)
