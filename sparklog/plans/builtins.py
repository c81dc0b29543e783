"""The built-in templates, in the order in which detection tries them."""

from __future__ import annotations

from functools import cache

from .template import Template, TemplateError, parse

#: Name, description, entry patterns, field attributes.
DEFINITIONS = [
    ("plain", "any text, one field a line", ["%{message}"], {"message": "type=string"}),
    ("syslog", "classic syslog without a year", ["%{timestamp} %{host} %{proc}: %{message}"], {"timestamp": 'type=timestamp format="%b %e %H:%M:%S"', "host": "type=word", "proc": "type=word", "message": "type=string"}),
    ("syslog-iso", "syslog with ISO timestamps", ["%{timestamp} %{host} %{proc}: %{message}"], {"timestamp": 'type=timestamp format="%Y-%m-%dT%H:%M:%S.%f%z"', "host": "type=word", "proc": "type=word", "message": "type=string"}),
    ("dmesg", "kernel ring buffer", ["[%{time}] %{message}"], {"time": "type=float unit=s", "message": "type=string"}),
    ("serilog", ".NET Serilog files", ["%{timestamp} [%{level}]: %{message}", "%{timestamp} [%{level}] %{message}"], {"timestamp": 'type=timestamp format="%Y-%m-%d %H:%M:%S.%f%z%Z"', "level": "type=enum values=VRB|DBG|INF|WRN|ERR|FTL", "message": "type=string"}),
    ("python", "Python logging", ["%{timestamp} - %{logger} - %{level} - %{message}"], {"timestamp": 'type=timestamp format="%Y-%m-%d %H:%M:%S,%f"', "logger": "type=word", "level": "type=enum values=DEBUG|INFO|WARNING|ERROR|CRITICAL", "message": "type=string"}),
    ("macos", "macOS log show", ["%{timestamp} %{thread} %{type} %{activity} %{pid} %{ttl} %{process}: %{message}"], {"timestamp": 'type=timestamp format="%Y-%m-%d %H:%M:%S.%f%z"', "thread": "type=word", "type": "type=enum values=Default|Info|Debug|Error|Fault severity=yes", "activity": "type=word", "pid": "type=int", "ttl": "type=int", "process": "type=word", "message": "type=string"}),
    ("apache", "Apache access log", ['%{host} %{ident} %{user} [%{timestamp}] "%{request}" %{status} %{size}'], {"host": "type=word", "ident": "type=word", "user": "type=word", "timestamp": 'type=timestamp format="%d/%b/%Y:%H:%M:%S %z"', "request": "type=string", "status": "type=int", "size": "type=word unit=bytes"}),
]

#: Colours of the built-ins' fields, by name.
COLORS = {
    "timestamp": "#8A8A8A", "time": "#8A8A8A", "host": "#5FAFD7", "proc": "#00AFAF", "process": "#00AFAF", "logger": "#00AFAF",
    "thread": "#626262", "activity": "#626262", "pid": "#626262", "ttl": "#626262", "ident": "#626262", "user": "#626262", "size": "#626262",
}


@cache
def all_builtins() -> dict[str, Template]:
    out = {}
    for name, description, entries, fields in DEFINITIONS:
        text = [f"name: {name}", f"description: {description}", *(f"entry: {e}" for e in entries), *(f"field {k}: {v}" + (f" color={COLORS[k]}" if k in COLORS else "") for k, v in fields.items())]
        out[name] = parse("\n".join(text))
    return out


def builtin(name: str) -> Template:
    """A built-in template; the case of its name is ignored."""
    try:
        return all_builtins()[name.lower()]
    except KeyError:
        raise TemplateError(f"there is no template {name!r}") from None
