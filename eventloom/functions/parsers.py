"""Parsers of log lines and text formats. Fixed layouts are regular expressions in Catalyst; grammars are Arrow nodes."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError
from eventloom.plans.typed import ANY, FLOAT, INT, NULL, STRING, TIME, Kind, Typed, array_of, const, first_error, map_of, object_kind, object_of

from .convert import fail, parsed_time
from .patterns import translated
from .registry import arrow, fn, need_const

OPT = r"(?:-|{})"


#: What parts the groups of a matched line, as none of its own characters does.
MARK = "\u0001"


def groups_of(ctx, value: Typed, java: str, count: int) -> tuple[Column, list[Column]]:
    """Whether an anchored pattern matches, and its groups ("" where they are missing), by one match a row.

    The line is replaced by its groups with marks between them and then split. A line that has the mark itself is matched group by group."""
    spread = MARK + MARK.join(f"${g}" for g in range(1, count + 1)) + MARK
    once = F.split(F.regexp_replace(value.col, F.lit(java), F.lit(spread)), MARK)
    slowly = F.when(F.rlike(value.col, F.lit(java)), F.array(F.lit(""), *[F.regexp_extract(value.col, java, g) for g in range(1, count + 1)]))
    cells = ctx.hoisted(Typed(array_of(STRING), F.when(F.contains(value.col, F.lit(MARK)), slowly).otherwise(once))).col
    hit = F.coalesce(F.size(cells) > 1, F.lit(False))
    return hit, [F.get(cells, F.lit(g)) for g in range(count + 1)]


def laid_out(ctx, value: Typed, pattern: str, fields: dict[str, tuple[int, str]], message: str, formats: dict[str, str] | None = None) -> Typed:
    """An object of the groups of one anchored pattern; - and a missing group are null. Kinds: str int flt or ts."""
    hit, groups = groups_of(ctx, value, translated(pattern).java, re.compile(pattern).groups)
    parts, bad = {}, F.when(~hit & value.col.isNotNull(), F.lit(message))
    for name, (group, kind) in fields.items():
        raw = groups[group]
        text = F.when(hit & ~raw.isin("", "-"), raw)
        if kind == "int":
            parts[name] = Typed(INT, text.try_cast("bigint"))
        elif kind == "flt":
            parts[name] = Typed(FLOAT, text.try_cast("double"))
        elif kind == "ts":
            t = parsed_time(text, formats["ts"], None)
            parts[name] = Typed(TIME, t)
            bad = F.coalesce(bad, F.when(text.isNotNull() & t.isNull(), F.concat(F.lit("failed parsing timestamp "), text)))
        else:
            parts[name] = Typed(STRING, text)
    kind = object_kind(parts)
    whole = F.when(bad.isNull(), F.struct(*[v.col.alias(n) for n, v in sorted(parts.items())]))
    return Typed(kind, whole, first_error(value.err, bad))


# The layouts of access and error logs.
CLF_TIME = "%d/%b/%Y:%H:%M:%S %z"
COMMON = r'^\s*(-|\S+)\s+(-|\S+)\s+(-|.+?)\s+(?:-|\[(-|[^\[\]]*)\])\s+(?:-|"(-|(\w+)\s+(.*?)(?:\s+(\S+))?)\s*")\s+(-|\d+)\s+(-|\d+)\s*'
COMMON_FIELDS = {"host": (1, "str"), "identity": (2, "str"), "user": (3, "str"), "timestamp": (4, "ts"), "message": (5, "str"), "method": (6, "str"), "path": (7, "str"), "protocol": (8, "str"), "status": (9, "int"), "size": (10, "int")}
COMBINED = COMMON + r'(?:"(-|.*?)")\s+(?:"(-|.*?)")\s*$'
COMBINED_FIELDS = COMMON_FIELDS | {"referrer": (11, "str"), "agent": (12, "str")}
APACHE_ERROR = r"^\s*\[(-|.+?)\]\s+\[(?:(-|.+?):)?(-|.+?)\]\s+\[pid\s+(-|\d+)(?::tid\s+(-|\d+))?\](?:\s+\[client\s+(-|.+?):(-|\d+)\])?\s+(-|.+?)\s*$"
NGINX_COMBINED = r'^\s*(-|\S+)\s+-\s+(-|.+?)\s+\[(-|.+?)\]\s+"(-|.+?)"\s+(-|\d+)\s+(-|\d+)\s+"(-|.+?)"\s+"(-|.+?)"(?:\s+"(-|.+?)")?\s*$'
NGINX_ERROR = r'^\s*(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#(\d+):(?:\s+\*(\d+))?\s+(.+?)(?:,\s+excess:\s+([\d.]+)\s+by\s+zone\s+"(.+?)")?(?:,\s+client:\s+(.+?))?(?:,\s+server:\s+(.+?))?(?:,\s+request:\s+"(.+?)")?(?:,\s+upstream:\s+"(.+?)")?(?:,\s+host:\s+"(.+?)")?(?:,\s+refer+er:\s+"(.+?)")?\s*$'
NGINX_INGRESS = r'^\s*(-|\S+)\s+-\s+(-|\S+)\s+\[(-|.+?)\]\s+"(-|.+?)"\s+(-|\d+)\s+(-|\d+)\s+"(-|.+?)"\s+"(-|.+?)"\s+(-|\d+)\s+(-|\d+\.\d+)\s+\[(-|.+?)\]\s+\[(-|.*?)\]\s+(-|\S+)\s+(-|\d+)\s+(-|\d+\.\d+)\s+(-|\d+)\s+(-|\S+)\s*$'
NGINX_MAIN = r'^\s*(-|\S+)\s+-\s+(-|\S+)\s+\[(-|.+?)\]\s+"(-|.+?)"\s+(-|\d+)\s+(-|\d+)\s+"(-|.+?)"\s+"(-|.+?)"\s+"(-|.+?)"\s*$'


@fn("parse_common_log", "value:str, timestamp_format?:str")
def parse_common_log(ctx, value: Typed, timestamp_format: Typed | None):
    return laid_out(ctx, value, COMMON + "$", COMMON_FIELDS, "failed parsing common log line", {"ts": need_const(timestamp_format, "timestamp_format") or CLF_TIME})


@fn("parse_apache_log", "value:str, format:str, timestamp_format?:str")
def parse_apache_log(ctx, value: Typed, format: Typed, timestamp_format: Typed | None):
    name, own = need_const(format, "format"), need_const(timestamp_format, "timestamp_format")
    if name == "error":
        fields = {"timestamp": (1, "ts"), "module": (2, "str"), "severity": (3, "str"), "pid": (4, "int"), "thread": (5, "str"), "client": (6, "str"), "port": (7, "int"), "message": (8, "str")}
        return laid_out(ctx, value, APACHE_ERROR, fields, "failed parsing log line", {"ts": own or "%a %b %d %H:%M:%S%.6f %Y"})
    if name not in ("common", "combined"):
        raise CompileError(403, f"invalid enum variant: {name}")
    pattern, fields = (COMMON + "$", COMMON_FIELDS) if name == "common" else (COMBINED, COMBINED_FIELDS)
    return laid_out(ctx, value, pattern, fields, "failed parsing log line", {"ts": own or CLF_TIME})


@fn("parse_nginx_log", "value:str, format:str, timestamp_format?:str")
def parse_nginx_log(ctx, value: Typed, format: Typed, timestamp_format: Typed | None):
    name, own = need_const(format, "format"), need_const(timestamp_format, "timestamp_format")
    line = {"client": (1, "str"), "user": (2, "str"), "timestamp": (3, "ts"), "request": (4, "str"), "status": (5, "int"), "size": (6, "int"), "referer": (7, "str"), "agent": (8, "str"), "compression": (9, "str")}
    error = {"timestamp": (1, "ts"), "severity": (2, "str"), "pid": (3, "int"), "tid": (4, "int"), "cid": (5, "int"), "message": (6, "str"), "excess": (7, "flt"), "zone": (8, "str"), "client": (9, "str"), "server": (10, "str"), "request": (11, "str"), "upstream": (12, "str"), "host": (13, "str"), "referer": (14, "str")}
    head = {"remote_addr": (1, "str"), "remote_user": (2, "str"), "timestamp": (3, "ts"), "request": (4, "str"), "status": (5, "int"), "body_bytes_size": (6, "int"), "http_referer": (7, "str"), "http_user_agent": (8, "str")}
    ingress = head | {"request_length": (9, "int"), "request_time": (10, "flt"), "proxy_upstream_name": (11, "str"), "proxy_alternative_upstream_name": (12, "str"), "upstream_addr": (13, "str"), "upstream_response_length": (14, "int"), "upstream_response_time": (15, "flt"), "upstream_status": (16, "int"), "req_id": (17, "str")}
    layouts = {"combined": (NGINX_COMBINED, line, CLF_TIME), "error": (NGINX_ERROR, error, "%Y/%m/%d %H:%M:%S"), "ingress_upstreaminfo": (NGINX_INGRESS, ingress, CLF_TIME), "main": (NGINX_MAIN, head | {"http_x_forwarded_for": (9, "str")}, CLF_TIME)}
    if name not in layouts:
        raise CompileError(403, f"invalid enum variant: {name}")
    pattern, fields, ts = layouts[name]
    return laid_out(ctx, value, pattern, fields, "failed parsing log line", {"ts": own or ts})


LEVEL_NAMES = {"I": "info", "W": "warning", "E": "error", "F": "fatal"}


def glog_like(ctx, value: Typed, pattern: str, stamp) -> Typed:
    hit, groups = groups_of(ctx, value, translated(pattern).java, 6)
    g = lambda i: F.when(hit, groups[i])
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_NAMES.items() for x in kv]), g(1))
    parts = {"level": Typed(STRING, level), "timestamp": Typed(TIME, stamp(g(2))), "id": Typed(INT, g(3).try_cast("bigint")), "file": Typed(STRING, g(4)), "line": Typed(INT, g(5).try_cast("bigint")), "message": Typed(STRING, g(6))}
    bad = fail(~hit, "failed parsing log line")
    return Typed(object_kind(parts), F.when(hit, F.struct(*[v.col.alias(n) for n, v in sorted(parts.items())])), first_error(value.err, bad))


@fn("parse_glog", "value:str")
def parse_glog(ctx, value: Typed):
    return glog_like(ctx, value, r"^\s*([IWEF])(\d{4}\d{2}\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(.+?):(\d+)\]\s*(.*?)\s*$", lambda c: parsed_time(F.regexp_replace(c, r"\s+", " "), "%Y%m%d %H:%M:%S%.6f", None))


@fn("parse_klog", "value:str")
def parse_klog(ctx, value: Typed):
    def stamp(c):
        # a December line read in January is last year's
        year = F.year(F.current_date()) - F.when(c.startswith("12") & (F.month(F.current_date()) == 1), 1).otherwise(0)
        return parsed_time(F.concat(year.cast("string"), F.regexp_replace(c, r"\s+", " ")), "%Y%m%d %H:%M:%S%.6f", None)

    return glog_like(ctx, value, r"^\s*([IWEF])(\d{2}\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(.+?):(\d+)\]\s*(.*?)\s*$", stamp)


FACILITY = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITY = "emerg alert crit err warning notice info debug".split()


SYSLOG_PRIORITY = re.compile(r"<(\d{1,3})>").match
SYSLOG_5424 = re.compile(r"(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\"\\]++|\"(?:[^\"\\]++|\\.)*\"|\\.)*\])+) ?(.*)$", re.S).match
SYSLOG_3164 = re.compile(r"(?:(\w{3}\s+\d{1,2}\s+(?:\d{4}\s+)?\d\d:\d\d:\d\d)|(\d{4}-\d\d-\d\dT\S+))\s+(?:(\S+)\s+)?(?:([^\s:\[]+)(?:\[(\d+)\])?:\s*)?(.*)$", re.S).match
SYSLOG_ITEM = re.compile(r'\[([^\s\]="]+)((?: [^\s=\]"]+="(?:[^"\\]|\\.)*")*)\s*\]').finditer
SYSLOG_PARAM = re.compile(r'([^\s=\]"]+)="((?:[^"\\]|\\.)*)"').findall
json_encoded = json.JSONEncoder().encode


def utc_text(stamp: str) -> str:
    return datetime.fromisoformat(stamp.replace("Z", "+00:00")).astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def syslog(v: str) -> str:
    """RFC 5424 and RFC 3164 lines as JSON text."""
    out: dict = {}
    m = SYSLOG_PRIORITY(v)
    rest = v[m.end() :] if m else v
    if m:
        pri = int(m[1])
        out |= {"facility": FACILITY[pri // 8]} if pri // 8 < 24 else {}
        out["severity"] = SEVERITY[pri % 8]
    nil = lambda s: None if s == "-" else s
    n = SYSLOG_5424(rest)
    if n:
        out["version"] = int(n[1])
        stamp, out["hostname"], out["appname"], pid, out["msgid"] = nil(n[2]), nil(n[3]), nil(n[4]), nil(n[5]), nil(n[6])
        if stamp:
            out["timestamp"] = utc_text(stamp)
        if pid is not None:
            out["procid"] = int(pid) if pid.isdigit() else pid
        if n[7] != "-":
            for item in SYSLOG_ITEM(n[7]):
                out[item[1]] = {k: re.sub(r"\\([\"\\\]])", r"\1", x) if "\\" in x else x for k, x in SYSLOG_PARAM(item[2])}
        out["message"] = n[8].removeprefix("\ufeff")
    else:
        t = SYSLOG_3164(rest)
        if t:
            if t[1]:
                now = datetime.now(timezone.utc)
                text = " ".join(t[1].split())
                stamp = datetime.strptime(text, "%b %d %Y %H:%M:%S") if len(text.split()) == 4 else datetime.strptime(f"{now.year} {text}", "%Y %b %d %H:%M:%S")
                if len(text.split()) == 3 and stamp.month == 12 and now.month == 1:
                    stamp = stamp.replace(year=now.year - 1)
                out["timestamp"] = stamp.isoformat() + "Z"
            else:
                out["timestamp"] = utc_text(t[2])
            out |= {k: x for k, x in (("hostname", t[3]), ("appname", t[4])) if x}
            if t[5]:
                out["procid"] = int(t[5])
            out["message"] = t[6]
        elif m:
            out["message"] = rest.strip()
        else:
            raise ValueError("unable to parse input as valid syslog message")
    return json_encoded({k: x for k, x in out.items() if x is not None})


@fn("parse_syslog", "value:str")
def parse_syslog(ctx, value: Typed):
    return arrow(syslog, ANY, value)


@fn("parse_linux_authorization", "value:str")
def parse_linux_authorization(ctx, value: Typed):
    return arrow(syslog, ANY, value)


@fn("parse_regex", "value:str, pattern:re, numeric_groups?:bool=false")
def parse_regex(ctx, value: Typed, pattern: Typed, numeric_groups: Typed):
    p = translated(need_const(pattern, "pattern"))
    hit = F.rlike(value.col, F.lit(p.java))
    groups = dict(p.names)
    if numeric_groups.const:
        groups |= {str(i): i for i in range(p.groups + 1)}
    # a group that took no part gives null: an empty match is told from it by a second look at what surrounds it
    col = lambda g: F.when(hit, F.nullif(F.regexp_extract(value.col, p.java, g), F.lit("")) if g and optional(pattern.const, g) else F.regexp_extract(value.col, p.java, g))
    parts = {n: Typed(STRING, col(g)) for n, g in groups.items()}
    kind = object_kind(parts)
    return Typed(kind, F.when(hit, F.struct(*[v.col.alias(n) for n, v in sorted(parts.items())])) if parts else None, first_error(value.err, fail(~hit, "could not find any pattern matches")), parts=None if parts else {})


def optional(pattern: str, group: int) -> bool:
    """Whether a group can be left out of a match: it stands under ?, *, {0 or an alternative."""
    import re

    depth, starts, n = [], {}, 0
    i, in_class = 0, False
    spans = {}
    alts: list[list[int]] = []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            capture = not pattern.startswith("(?", i) or bool(re.match(r"\(\?P?<[A-Za-z_]", pattern[i:]))
            n += capture
            depth.append((n if capture else 0, i))
        elif c == ")" and depth:
            g, start = depth.pop()
            after = pattern[i + 1 : i + 3]
            spans[start] = (i, g, after[:1] in ("?", "*") or after == "{0")
            if g:
                starts[g] = start
        i += 1
    if group not in starts:
        return False
    start = starts[group]
    if "|" in re.sub(r"\[[^\]]*\]|\\.", "", pattern):
        return True
    return any(s <= start < e and maybe for s, (e, _, maybe) in spans.items())


@fn("parse_regex_all", "value:str, pattern:re, numeric_groups?:bool=false")
def parse_regex_all(ctx, value: Typed, pattern: Typed, numeric_groups: Typed):
    p = translated(need_const(pattern, "pattern"))
    groups = dict(p.names)
    if numeric_groups.const:
        groups |= {str(i): i for i in range(p.groups + 1)}
    names = sorted(groups)
    arrays = [F.regexp_extract_all(value.col, F.lit(p.java if p.groups else f"({p.java})"), F.lit(groups[n])) for n in names]
    kind = Kind("object", fields=tuple((n, STRING) for n in names))
    if not names:
        return Typed(array_of(STRING), F.array().cast("array<string>"), F.when(F.lit(False), F.lit("")))
    count = F.size(arrays[0])
    col = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(*[(F.nullif(F.get(a, i), F.lit("")) if optional(pattern.const, groups[n]) else F.get(a, i)).alias(n) for n, a in zip(names, arrays, strict=True)]))).otherwise(F.array().cast(array_of(kind).sql()))
    return Typed(array_of(kind), col, first_error(value.err, F.when(F.lit(False), F.lit(""))))


@fn("parse_json", "value:str, max_depth?:int, lossy?:bool=true")
def parse_json(ctx, value: Typed, max_depth: Typed | None, lossy: Typed):
    depth = need_const(max_depth, "max_depth")
    if depth is not None:
        if not 1 <= depth <= 128:
            raise CompileError(402, "max_depth value should be greater than 0 and less than 128")

        def cut(v):
            def walk(x, d):
                if d == 0 and isinstance(x, (dict, list)):
                    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)
                if isinstance(x, dict):
                    return {k: walk(y, d - 1) for k, y in x.items()}
                return [walk(y, d - 1) for y in x] if isinstance(x, list) else x

            return json.dumps(walk(json.loads(v), depth))

        return arrow(cut, ANY, value)
    got = F.try_parse_json(F.regexp_replace(value.col, "^\ufeff", ""))
    return Typed(ANY, got, first_error(value.err, fail(got.isNull() & value.col.isNotNull(), "unable to parse json: ", value.col)))


@fn("parse_aws_cloudwatch_log_subscription_message", "value:str")
def parse_aws_cloudwatch_log_subscription_message(ctx, value: Typed):
    shape = "owner string, messageType string, logGroup string, logStream string, subscriptionFilters array<string>, logEvents array<struct<id:string,timestamp:bigint,message:string>>"
    j = F.from_json(value.col, shape)
    event = object_of(id=STRING, message=STRING, timestamp=TIME)
    events = F.transform(j["logEvents"], lambda e: F.struct(e["id"].alias("id"), e["message"].alias("message"), F.timestamp_millis(e["timestamp"]).alias("timestamp")))
    parts = {"owner": Typed(STRING, j["owner"]), "message_type": Typed(STRING, j["messageType"]), "log_group": Typed(STRING, j["logGroup"]), "log_stream": Typed(STRING, j["logStream"]), "subscription_filters": Typed(array_of(STRING), j["subscriptionFilters"]), "log_events": Typed(array_of(event), events)}
    bad = fail(j["messageType"].isNull() | j["owner"].isNull() | j["logEvents"].isNull(), "unable to parse message")
    return Typed(object_kind(parts), F.when(bad.isNull(), F.struct(*[v.col.alias(n) for n, v in sorted(parts.items())])), bad)


# The fields of a flow log, in their default order and as a whole; those that are integers.
VPC_DEFAULT = "version account_id interface_id srcaddr dstaddr srcport dstport protocol packets bytes start end action log_status"
VPC_INT = {"bytes", "dstport", "encryption_status", "end", "packets", "protocol", "srcport", "start", "tcp_flags", "traffic_path", "version"}


@fn("parse_aws_vpc_flow_log", "value:str, format?:str")
def parse_aws_vpc_flow_log(ctx, value: Typed, format: Typed | None):
    keys = (need_const(format, "format") or VPC_DEFAULT).replace("-", "_").split()
    if len(set(keys)) != len(keys):
        raise CompileError(402, "duplicate key in format")
    cells = F.split(value.col, " ")
    parts, bad = {}, fail(F.size(cells) != len(keys), "failed to parse value: wrong number of fields")
    for i, k in enumerate(keys):
        text = F.nullif(F.get(cells, F.lit(i)), F.lit("-"))
        parts[k] = Typed(INT, text.try_cast("bigint")) if k in VPC_INT else Typed(STRING, text)
        if k in VPC_INT:
            bad = F.coalesce(bad, fail(text.isNotNull() & text.try_cast("bigint").isNull(), f"failed to parse value as i64 (key: `{k}`): `", text, "`"))
    return Typed(object_kind(parts), F.when(bad.isNull(), F.struct(*[v.col.alias(n) for n, v in sorted(parts.items())])), first_error(value.err, bad))


# The fields of a load balancer's line, in order.
ALB = "type timestamp elb client target request_processing_time target_processing_time response_processing_time elb_status_code target_status_code received_bytes sent_bytes request user_agent ssl_cipher ssl_protocol target_group_arn trace_id domain_name chosen_cert_arn matched_rule_priority request_creation_time actions_executed redirect_url error_reason target_port_list target_status_code_list classification classification_reason".split()


@fn("parse_aws_alb_log", "value:str, strict_mode?:bool=true")
def parse_aws_alb_log(ctx, value: Typed, strict_mode: Typed):
    strict = strict_mode.const

    def run(v):
        import re

        cells = [a if a is not None and not b else b for a, b in re.findall(r'"((?:[^"\\]|\\.)*)"|([^\s"]+)', v)]
        cells = [re.sub(r"\\(.)", r"\1", c) if "\\" in c else c for c in cells]
        if len(cells) < len(ALB) - 2 or strict and len(cells) > len(ALB) + 1:
            raise ValueError("Log should be fully consumed" if len(cells) > len(ALB) else "failed parsing log line")
        row = dict(zip(ALB, cells, strict=False))
        out = {k: None if x == "-" else x for k, x in row.items()}
        for k in ("request_processing_time", "target_processing_time", "response_processing_time"):
            out[k] = float(row[k])
        for k in ("received_bytes", "sent_bytes"):
            out[k] = int(row[k])
        out["client_host"] = out.pop("client")
        out["target_host"] = out.pop("target")
        parts = (row["request"] + "  ").split(" ")
        out["request_method"], out["request_url"], out["request_protocol"] = parts[0], parts[1], parts[2]
        del out["request"]
        out["traceability_id"] = cells[len(ALB)] if len(cells) > len(ALB) else None
        return json.dumps(out)

    return arrow(run, ANY, value)


@fn("parse_tokens", "value:str")
def parse_tokens(ctx, value: Typed):
    p = r'"((?:\\"|[^"])*)"|\[((?:\\\]|[^\]])*)\]|([^\s"\[]\S*)'
    whole = F.regexp_extract_all(value.col, F.lit(p), F.lit(0))
    quoted, boxed, bare = (F.regexp_extract_all(value.col, F.lit(p), F.lit(i)) for i in (1, 2, 3))
    unquote = lambda c: F.regexp_replace(c, r'\\(["\]])', "$1")
    text = lambda w, i: F.when(w.startswith('"'), unquote(F.get(quoted, i))).when(w.startswith("["), unquote(F.get(boxed, i))).otherwise(F.get(bare, i))
    return Typed(array_of(STRING), F.transform(whole, lambda w, i: F.when(~text(w, i).isin("", "-"), text(w, i))), F.when(F.lit(False), F.lit("")))


@fn("parse_csv", "value:str, delimiter?:str=,")
def parse_csv(ctx, value: Typed, delimiter: Typed | None):
    d = need_const(delimiter, "delimiter") or ","
    if len(d.encode()) != 1:
        raise CompileError(402, "delimiter must be a single character")

    def run(v):
        import csv
        import io

        return next(iter(csv.reader(io.StringIO(v, newline=""), delimiter=d)), [])

    return arrow(run, array_of(STRING), value)


def key_values(v: str, kv: str, field: str, strict: bool, alone: bool) -> list[tuple[str, object]]:
    """Pairs of a key-value line, in order."""
    out, i, n = [], 0, len(v)

    def blanks(i):
        while i < n and v[i].isspace() and not v.startswith(field, i) and not v.startswith(kv, i):
            i += 1
        return i

    def quoted(i):
        q = v[i]
        j, text = i + 1, []
        while j < n and v[j] != q:
            if v[j] == "\\" and j + 1 < n:
                text.append({"n": "\n", "t": "\t", "r": "\r"}.get(v[j + 1], v[j + 1] if v[j + 1] in "\\\"'" else v[j : j + 2]))
                j += 2
            else:
                text.append(v[j])
                j += 1
        return ("".join(text), j + 1) if j < n else None

    while i < n:
        if not strict:
            i = blanks(i)
        while v.startswith(field, i) and i < n:
            i += len(field)
            if not strict:
                i = blanks(i)
        if i >= n:
            break
        got = quoted(i) if v[i] in "\"'" else None
        if got:
            key, i = got
        else:
            j = i
            while j < n and not v.startswith(kv, j) and not v.startswith(field, j) and (kv != " " or True):
                j += 1
            key, i = v[i:j], j
        key = key if strict else key.strip()
        k = i if strict else blanks(i)
        if v.startswith(kv, k) and k < n:
            i = k + len(kv)
            if not strict:
                i = blanks(i)
            got = quoted(i) if i < n and v[i] in "\"'" else None
            if got and (got[1] >= n or v.startswith(field, got[1]) or v[got[1]].isspace()):
                val, i = got
            else:
                j = v.find(field, i)
                j = n if j < 0 else j
                val, i = v[i:j], j
                val = val if strict else val.strip()
            out.append((key, val))
        elif alone:
            out.append((key, True))
        else:
            raise ValueError("could not parse value as key value pairs")
    if not out or any(k == "" for k, _ in out):
        raise ValueError("could not parse value as key value pairs")
    return out


def gathered(pairs) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            out[k] = [*out[k], v] if isinstance(out[k], list) else [out[k], v]
        else:
            out[k] = v
    return out


@fn("parse_key_value", "value:str, key_value_delimiter?:str==, field_delimiter?:str, whitespace?:str=lenient, accept_standalone_key?:bool=true")
def parse_key_value(ctx, value: Typed, key_value_delimiter: Typed | None, field_delimiter: Typed | None, whitespace: Typed, accept_standalone_key: Typed):
    kv = need_const(key_value_delimiter, "key_value_delimiter") or "="
    field = need_const(field_delimiter, "field_delimiter") or " "
    if whitespace.const not in ("lenient", "strict"):
        raise CompileError(403, f"invalid enum variant: {whitespace.const}")
    strict, alone = whitespace.const == "strict", accept_standalone_key.const
    return arrow(lambda v: json.dumps(gathered(key_values(v, kv, field, strict, alone))), ANY, value)


@fn("parse_logfmt", "value:str")
def parse_logfmt(ctx, value: Typed):
    return arrow(lambda v: json.dumps(gathered(key_values(v, "=", " ", False, True))), ANY, value)


@fn("parse_query_string", "value:str")
def parse_query_string(ctx, value: Typed):
    def run(v):
        from urllib.parse import parse_qsl

        return json.dumps(gathered(parse_qsl(v.removeprefix("?"), keep_blank_values=True, encoding="utf-8", errors="replace")))

    out = arrow(run, ANY, value)
    return out.with_err(value.err)


PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


@fn("parse_url", "value:str, default_known_ports?:bool=false")
def parse_url(ctx, value: Typed, default_known_ports: Typed):
    known = default_known_ports.const

    def run(v):
        from urllib.parse import parse_qsl, urlsplit

        u = urlsplit(v.strip())
        if not u.scheme:
            raise ValueError("unable to parse url: relative URL without a base")
        host = u.hostname or ""
        if u.scheme in PORTS and not host:
            raise ValueError("unable to parse url: empty host")
        if not host.isascii():
            host = host.encode("idna").decode()
        port = u.port
        if port is not None and PORTS.get(u.scheme) == port and not known:
            port = None
        return json.dumps({"scheme": u.scheme, "username": u.username or "", "password": u.password or "", "host": host, "port": port or (PORTS.get(u.scheme) if known else None), "path": u.path or ("/" if u.scheme in PORTS else ""), "fragment": u.fragment or None, "query": dict(parse_qsl(u.query, keep_blank_values=True))})

    shape = "scheme string, username string, password string, host string, port bigint, path string, fragment string, query map<string,string>"
    out = arrow(run, STRING, value)
    kind = object_of(fragment=STRING, host=STRING, password=STRING, path=STRING, port=INT, query=map_of(STRING), scheme=STRING, username=STRING)
    j = F.from_json(out.col, shape)
    return Typed(kind, F.when(out.col.isNotNull(), F.struct(*[j[n].alias(n) for n, _ in kind.fields])), out.err)


CEF_HEAD = ["cefVersion", "deviceVendor", "deviceProduct", "deviceVersion", "deviceEventClassId", "name", "severity"]


@fn("parse_cef", "value:str, translate_custom_fields?:bool=false, strict?:bool=true")
def parse_cef(ctx, value: Typed, translate_custom_fields: Typed, strict: Typed):
    custom = translate_custom_fields.const

    def run(v):
        import re

        m = re.search(r"CEF:(\d+)\|", v)
        cells = re.split(r"(?<!\\)\|", v[m.start() + 4 :], maxsplit=7) if m else []
        if len(cells) < 7:
            raise ValueError("Could not parse value as CEF")
        out = {k: re.sub(r"\\([|\\])", r"\1", c.strip()) for k, c in zip(CEF_HEAD, cells, strict=False)}
        text = cells[7].strip() if len(cells) > 7 else ""
        keys = list(re.finditer(r"(?:^|(?<=\s))([A-Za-z0-9_.\[\]]+)(?<!\\)=", text))
        if text and not keys:
            raise ValueError("Could not parse value as CEF")
        for a, b in zip(keys, [*keys[1:], None], strict=True):
            raw = text[a.end() : b.start() if b else len(text)].strip()
            out[a[1]] = re.sub(r"\\(.)", lambda x: {"n": "\n", "r": "\r"}.get(x[1], x[1]), raw)
        if custom:
            for k in [k for k in out if k.endswith("Label") and k[:-5] in out]:
                out[out.pop(k)] = out.pop(k[:-5])
        return out

    return arrow(lambda v: json.dumps(run(v)), ANY, value)


@fn("parse_influxdb", "value:str")
def parse_influxdb(ctx, value: Typed):
    def run(v):
        import re
        from datetime import datetime, timezone

        out = []
        for line in filter(None, map(str.strip, v.splitlines())):
            if line.startswith("#"):
                continue
            parts = re.findall(r'(?:\\.|"(?:\\.|[^"\\])*"|[^\s\\"])+', line)
            if len(parts) not in (2, 3):
                raise ValueError("failed to parse line protocol")
            clean = lambda x: re.sub(r"\\([,= \\])", r"\1", x)
            head, *tags = re.split(r"(?<!\\),", parts[0])
            tags = dict(map(clean, re.split(r"(?<!\\)=", t, maxsplit=1)) for t in tags)
            stamp = None
            if len(parts) == 3:
                stamp = datetime.fromtimestamp(int(parts[2]) / 1e9, timezone.utc).isoformat().replace("+00:00", "Z")
            for f in re.split(r'(?<!\\),(?=(?:[^"]*"[^"]*")*[^"]*$)', parts[1]):
                k, x = re.split(r"(?<!\\)=", f, maxsplit=1)
                if x.startswith('"'):
                    raise ValueError("string fields are not supported")
                number = {"t": 1.0, "T": 1.0, "true": 1.0, "True": 1.0, "TRUE": 1.0, "f": 0.0, "F": 0.0, "false": 0.0, "False": 0.0, "FALSE": 0.0}.get(x)
                number = float(x.rstrip("iu")) if number is None else number
                out.append({"name": f"{clean(head)}_{clean(k)}", "tags": tags or None, "timestamp": stamp, "kind": "absolute", "gauge": {"value": number}})
        return json.dumps(out)

    shape = "array<struct<gauge:struct<value:double>,kind:string,name:string,tags:map<string,string>,timestamp:timestamp>>"
    got = arrow(run, STRING, value)
    kind = array_of(object_of(gauge=object_of(value=FLOAT), kind=STRING, name=STRING, tags=map_of(STRING), timestamp=TIME))
    return Typed(kind, F.from_json(got.col, shape), got.err)


@fn("parse_xml", "value:str, trim?:bool=true, include_attr?:bool=true, attr_prefix?:str=@, text_key?:str=text, always_use_text_key?:bool=false, parse_bool?:bool=true, parse_null?:bool=true, parse_number?:bool=true")
def parse_xml(ctx, value: Typed, **options: Typed):
    o = {k: v.const for k, v in options.items()}
    return arrow(lambda v: json.dumps(xml_value(v, o)), ANY, value)


XML_DEFAULTS = {"trim": True, "include_attr": True, "attr_prefix": "@", "text_key": "text", "always_use_text_key": False, "parse_bool": True, "parse_null": True, "parse_number": True}


def xml_value(text: str, o: dict):
    import re
    import xml.etree.ElementTree as ET

    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("unable to parse xml: document types aren't read")

    def scalar(s):
        if o["parse_bool"] and s in ("true", "false"):
            return s == "true"
        if o["parse_null"] and s in ("", "null"):
            return None
        if o["parse_number"] and re.fullmatch(r"-?\d+", s) and -(2**63) <= int(s) < 2**63:
            return int(s)
        if o["parse_number"] and re.fullmatch(r"-?\d+\.\d*(?:[eE][+-]?\d+)?|-?\d+[eE][+-]?\d+", s):
            return float(s)
        return s

    def name(tag):
        return tag.rsplit("}", 1)[-1]

    def value_of(e):
        out: dict = {}
        if o["include_attr"]:
            out |= {o["attr_prefix"] + name(k): scalar(v) for k, v in e.attrib.items()}
        words = [e.text or "", *[c.tail or "" for c in e]]
        text = "".join(w.strip() if o["trim"] else w for w in words)
        children = gathered((name(c.tag), value_of(c)) for c in e)
        if not out and not children and not o["always_use_text_key"]:
            return scalar(text)
        out |= children
        if text.strip() or not children and o["always_use_text_key"]:
            out[o["text_key"]] = scalar(text)
        return out

    root = ET.fromstring(text)
    return {name(root.tag): value_of(root)}


def yaml_value(text: str):
    """A common part of YAML: block and flow maps and lists, scalars, quoted text, | and > blocks, comments."""
    import re

    def scalar(s):
        s = s.strip()
        if s in ("", "~", "null", "Null", "NULL"):
            return None
        if s in ("true", "True", "TRUE"):
            return True
        if s in ("false", "False", "FALSE"):
            return False
        if s[0] == '"' and s[-1] == '"' and len(s) > 1:
            return json.loads(s)
        if s[0] == "'" and s[-1] == "'" and len(s) > 1:
            return s[1:-1].replace("''", "'")
        if s[0] in "[{":
            v, rest = flow(s)
            if rest.strip():
                raise ValueError("unable to parse yaml")
            return v
        if re.fullmatch(r"[-+]?\d+", s):
            return int(s)
        if re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+", s):
            return int(s, 0)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][-+]?\d+)?", s):
            return float(s)
        if s[0] in "&*!%@`":
            raise ValueError("unable to parse yaml: anchors and tags aren't read")
        return s

    def flow(s):
        s = s.lstrip()
        if s[:1] == "[":
            out, s = [], s[1:].lstrip()
            while s[:1] != "]":
                v, s = flow(s)
                out.append(v)
                s = s.lstrip()
                if s[:1] == ",":
                    s = s[1:].lstrip()
                elif s[:1] != "]":
                    raise ValueError("unable to parse yaml")
            return out, s[1:]
        if s[:1] == "{":
            out, s = {}, s[1:].lstrip()
            while s[:1] != "}":
                k, s = flow_scalar(s, ":,}")
                s = s.lstrip()
                v = None
                if s[:1] == ":":
                    v, s = flow(s[1:])
                out[str(k)] = v
                s = s.lstrip()
                if s[:1] == ",":
                    s = s[1:].lstrip()
                elif s[:1] != "}":
                    raise ValueError("unable to parse yaml")
            return out, s[1:]
        return flow_scalar(s, ",]}")

    def flow_scalar(s, stops):
        m = re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", s)
        if m:
            return scalar(m[0]), s[m.end() :]
        m = re.match(rf"[^{re.escape(stops)}\[\]{{}}]*", s)
        if not m or not m[0].strip():
            raise ValueError("unable to parse yaml")
        return scalar(m[0]), s[m.end() :]

    def bare(line):
        return re.sub(r"(^|\s)#.*$", "", line) if not re.search(r"[\"'].*#.*[\"']", line) else line

    raw = [x for x in text.split("\n") if not re.match(r"^(---|\.\.\.|%.*)\s*$", x)]
    lines = [(len(x) - len(x.lstrip()), x) for x in raw]
    at = 0

    def skip():
        nonlocal at
        while at < len(lines) and not bare(lines[at][1]).strip():
            at += 1

    KEY = re.compile(r"^(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\[\]{},\"'#&*!|>%@`-][^:#]*?|-?[^\s:#-][^:#]*?)\s*:(?:\s+(.*))?$")

    def literal(mark, indent):
        nonlocal at
        body = []
        while at < len(lines) and (not lines[at][1].strip() or lines[at][0] > indent):
            body.append(lines[at][1])
            at += 1
        pad = min((len(b) - len(b.lstrip()) for b in body if b.strip()), default=0)
        body = [b[pad:] for b in body]
        while body and not body[-1].strip():
            body.pop()
        text = "\n".join(body) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(body))
        return text if "-" in mark else text + "\n"

    def block(indent):
        nonlocal at
        skip()
        if at >= len(lines):
            return None
        line = bare(lines[at][1]).strip()
        if line.startswith("- ") or line == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and (bare(lines[at][1]).strip().startswith("- ") or bare(lines[at][1]).strip() == "-"):
                rest = lines[at][1].strip()[1:]
                inner = indent + 1 + len(rest) - len(rest.lstrip())
                if not bare(rest).strip():
                    at += 1
                    skip()
                    out.append(block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
                else:
                    lines[at] = (inner, " " * inner + rest.strip())
                    out.append(block(inner))
                skip()
            return out
        if KEY.match(line):
            out = {}
            while at < len(lines) and lines[at][0] == indent and (m := KEY.match(bare(lines[at][1]).strip())):
                key, rest = m[1], (m[2] or "").strip()
                key = str(scalar(key)) if key[0] in "\"'" else key
                at += 1
                if re.fullmatch(r"[|>][-+]?", rest):
                    out[key] = literal(rest, indent)
                elif rest:
                    while rest[0] in "[{" and rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and at < len(lines):
                        rest += " " + bare(lines[at][1]).strip()
                        at += 1
                    out[key] = scalar(rest)
                else:
                    skip()
                    deeper = at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].strip().startswith("- "))
                    out[key] = block(lines[at][0]) if deeper else None
                skip()
            return out
        at += 1
        words = [line]
        while at < len(lines) and lines[at][0] >= indent and bare(lines[at][1]).strip():
            words.append(bare(lines[at][1]).strip())
            at += 1
        return scalar(" ".join(words))

    skip()
    out = block(lines[at][0]) if at < len(lines) else None
    skip()
    if at < len(lines):
        raise ValueError("unable to parse yaml")
    return out


@fn("parse_yaml", "value:str")
def parse_yaml(ctx, value: Typed):
    return arrow(lambda v: json.dumps(yaml_value(v)), ANY, value)


def ruby_value(text: str):
    import re

    at = 0

    def blank():
        nonlocal at
        at += len(re.match(r"\s*", text[at:])[0])

    def one():
        nonlocal at
        blank()
        c = text[at : at + 1]
        if c == "{":
            at += 1
            out = {}
            blank()
            while text[at : at + 1] != "}":
                m = re.match(r"([A-Za-z_]\w*[?!]?):(?!:)\s*", text[at:])
                if m:
                    key, at = m[1], at + m.end()
                else:
                    key = one()
                    m = re.match(r"\s*(=>|:)\s*", text[at:])
                    if not m:
                        raise ValueError("could not parse ruby hash")
                    at += m.end()
                out[key if isinstance(key, str) else json.dumps(key)] = one()
                blank()
                if text[at : at + 1] == ",":
                    at += 1
                    blank()
                elif text[at : at + 1] != "}":
                    raise ValueError("could not parse ruby hash")
            at += 1
            return out
        if c == "[":
            at += 1
            out = []
            blank()
            while text[at : at + 1] != "]":
                out.append(one())
                blank()
                if text[at : at + 1] == ",":
                    at += 1
                    blank()
                elif text[at : at + 1] != "]":
                    raise ValueError("could not parse ruby hash")
            at += 1
            return out
        m = re.match(r":?\"((?:[^\"\\]|\\.)*)\"|:?'((?:[^'\\]|\\.)*)'", text[at:], re.S)
        if m:
            at += m.end()
            return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[1] if m[1] is not None else m[2])
        m = re.match(r":([A-Za-z_]\w*[?!=]?)|(nil|true|false)\b|(-?\d+\.\d+(?:[eE][+-]?\d+)?)|(-?\d+)", text[at:])
        if not m:
            raise ValueError("could not parse ruby hash")
        at += m.end()
        if m[1]:
            return m[1]
        if m[2]:
            return {"nil": None, "true": True, "false": False}[m[2]]
        return float(m[3]) if m[3] else int(m[4])

    blank()
    if text[at : at + 1] != "{":
        raise ValueError("could not parse ruby hash")
    out = one()
    blank()
    if at < len(text):
        raise ValueError("could not parse ruby hash")
    return out


@fn("parse_ruby_hash", "value:str")
def parse_ruby_hash(ctx, value: Typed):
    return arrow(lambda v: json.dumps(ruby_value(v)), ANY, value)


# A small set of public suffixes with more than one label; psl names a whole list.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp com.br co.nz co.za co.in com.cn com.mx com.tr co.kr com.sg com.hk github.io".split()


@fn("parse_etld", "value:str, plus_parts?:int=0, psl?:str")
def parse_etld(ctx, value: Typed, plus_parts: Typed, psl: Typed | None):
    rules, whole = set(SUFFIXES), False
    if psl is not None:
        with open(need_const(psl, "psl")) as f:
            rules, whole = {x.strip() for x in f if x.strip() and not x.startswith("//")}, True
    plus = max(0, plus_parts.const)

    def run(v):
        labels = v.lower().split(".")
        n, known = 1, not whole or labels[-1] in rules
        for k in range(1, len(labels) + 1):
            tail = ".".join(labels[-k:])
            if "!" + tail in rules:
                n, known = k - 1, True
                break
            if tail in rules or k > 1 and ".".join(["*", *labels[-k + 1 :]]) in rules:
                n, known = k, True
        return json.dumps({"etld": ".".join(labels[-n:]), "etld_plus": ".".join(labels[-min(len(labels), n + plus) :]), "known_suffix": known})

    got = arrow(run, STRING, value)
    j = F.from_json(got.col, "etld string, etld_plus string, known_suffix boolean")
    from eventloom.plans.typed import BOOL

    return Typed(object_of(etld=STRING, etld_plus=STRING, known_suffix=BOOL), j, got.err)


# Marks of browsers, systems and devices in user agents, in the order they are looked for.
BROWSERS = [("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"(?:OPR|Opera)[/ ]([\d.]+)"), ("Samsung Internet", r"SamsungBrowser/([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([\d.]+)"), ("Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"), ("Internet Explorer", r"(?:MSIE |Trident/.*rv:)([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari/"), ("curl", r"curl/([\d.]+)"), ("Wget", r"Wget/([\d.]+)")]
SYSTEMS = [("Windows 10", r"Windows NT 10\.0", "NT 10.0"), ("Windows 8.1", r"Windows NT 6\.3", "NT 6.3"), ("Windows 7", r"Windows NT 6\.1", "NT 6.1"), ("Windows XP", r"Windows NT 5\.1", "NT 5.1"), ("Android", r"Android ?([\d.]*)", None), ("iPad", r"iPad.*OS ([\d_]+)", None), ("iPhone", r"iPhone.*OS ([\d_]+)", None), ("Mac OSX", r"Mac OS X ([\d_.]+)", None), ("ChromeOS", r"CrOS \S+ ([\d.]+)", None), ("Linux", r"Linux", None)]


@fn("parse_user_agent", "value:str, mode?:str=fast")
def parse_user_agent(ctx, value: Typed, mode: Typed):
    if mode.const not in ("fast", "reliable", "enriched"):
        raise CompileError(403, f"invalid enum variant: {mode.const}")
    rich = mode.const == "enriched"

    def run(v):
        import re

        browser = next(((n, m[1]) for n, p in BROWSERS if (m := re.search(p, v))), (None, None))
        system = next(((n, fixed or (m[1].replace("_", ".") if m.groups() and m[1] else None)) for n, p, fixed in SYSTEMS if (m := re.search(p, v))), (None, None))
        crawler = re.search(r"[Bb]ot\b|[Ss]pider|[Cc]rawl", v)
        phone = re.search(r"iPhone|iPad|iPod|Android|Mobile", v)
        category = "crawler" if crawler else "smartphone" if phone else "pc" if system[0] else None
        out = {"browser": {"family": browser[0], "version": browser[1]}, "os": {"family": system[0], "version": system[1]}, "device": {"category": category}}
        if rich:
            for k in ("browser", "os"):
                cells = ((out[k]["version"] or "").removeprefix("NT ").split(".") + [None] * 4)[:4]
                out[k] |= dict(zip(("major", "minor", "patch", "patch_minor"), (c or None for c in cells), strict=True))
            out["device"] |= {"family": system[0] if phone else None, "brand": "Apple" if re.search("iPhone|iPad|Mac OS X", v) else None, "model": next(iter(re.findall("iPhone|iPad", v)), None)}
        return json.dumps(out)

    out = arrow(run, ANY, value)
    return out.with_err(value.err)


def cbor_value(data: bytes):
    import base64
    import struct

    at = 0

    def take(n):
        nonlocal at
        if at + n > len(data):
            raise ValueError("unable to parse cbor: too short")
        at += n
        return data[at - n : at]

    def one():
        nonlocal at
        head = take(1)[0]
        major, low = head >> 5, head & 31
        if low < 24:
            n = low
        elif low in (24, 25, 26, 27):
            n = int.from_bytes(take(1 << (low - 24)), "big")
        elif low == 31:
            n = None
        else:
            raise ValueError("unable to parse cbor")
        more = lambda: n is None and data[at : at + 1] != b"\xff"
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            if n is None:
                parts = []
                while more():
                    parts.append(one())
                at += 1
                return "".join(parts)
            raw = take(n)
            return raw.decode("utf-8", "replace")
        if major == 4:
            out = []
            while more() if n is None else len(out) < n:
                out.append(one())
            at += n is None
            return out
        if major == 5:
            out = {}
            k = 0
            while more() if n is None else k < n:
                key = one()
                out[key if isinstance(key, str) else json.dumps(key)] = one()
                k += 1
            at += n is None
            return out
        if major == 6:
            return one()
        if low in (25, 26, 27):
            raw = n.to_bytes(1 << (low - 24), "big")
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], raw)[0]
        return {20: False, 21: True, 22: None, 23: None}.get(low)

    out = one()
    if at != len(data):
        raise ValueError("unable to parse cbor: trailing data")
    return out


@fn("parse_cbor", "value:str")
def parse_cbor(ctx, value: Typed):
    from .codecs import as_bytes

    return arrow(lambda b: json.dumps(cbor_value(bytes(b))), ANY, as_bytes(value))
