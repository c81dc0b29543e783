"""The compiled patterns, in Python and through Spark, against the character walker."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklog.operators.parse import parse_rows
from sparklog.plans import pattern
from sparklog.plans.builtins import all_builtins
from sparklog.plans.template import parse

from .walker import match

SAMPLES = {
    "syslog": "Jun  1 19:18:23 myhost sshd[41]: Accepted key for u",
    "syslog-iso": "2026-06-01T19:18:23.5+02:00 h proc: text: more",
    "dmesg": "[   12.345678] usb 1-1: new device",
    "serilog": "2026-06-01 19:18:23.123 +02:00 [ERR]: db down",
    "python": "2026-06-01 19:18:23,123 - app.db - WARNING - pool - gone",
    "macos": "2026-06-01 19:18:23.123456+0200 0x16b3   Default   0x0   501  0  kernel: en0: up",
    "apache": '1.2.3.4 - bob [10/Oct/2026:13:55:36 -0700] "GET /a b HTTP/1.1" 200 -',
}
CUSTOM = {
    "A 7 1.5e3 x": "name: v\nentry: A %{id:int} %{v:float} %{k:word}\nentry: B %{id:int} %{k:word}\n",
    "10% [a b] = c": "name: p\nentry: %{n:int}%% [%{m}] = %{w:word}\n",
    "a | x | y": "name: s\nentry: %{a:word} | %{b}\n",
    "3/Feb/26 11:05 PM z": 'name: t\nentry: %{t} %{z:word}\nfield t: format="%e/%b/%y %I:%M %p"\n',
    "060 WARN: x": 'name: j\nentry: %{d} %{l}: %{m}\nfield d: format="%j"\nfield l: values=WARN|WARNING|W\n',
    "x " + "y" * 70 + " z": "name: long\nentry: %{a} " + "y" * 70 + " %{b:word}\n",
    "k k=v": "name: dup\nentry: %{a:word} %{a:word}=%{b}\n",
}
CASES = [(all_builtins()[k], v) for k, v in SAMPLES.items()] + [(parse(t), v) for v, t in CUSTOM.items()]


def mutate(line: str, r: random.Random) -> str:
    for _ in range(r.randrange(3)):
        i = r.randrange(len(line) + 1)
        what = r.randrange(3)
        c = r.choice(' \t[]|:-=.,%"0159aAeEzZ+_Ñ\r')
        line = line[:i] + c + line[i:] if what == 0 else line[:i] + line[i + 1 :] if what == 1 else line[:i] + c + line[i + 1 :]
    return line.replace("\n", " ")


@pytest.mark.parametrize("k", range(len(CASES)))
def test_samples_match(k):
    template, line = CASES[k]
    assert match(template, line) is not None
    assert pattern.match(template, line) == match(template, line)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(range(len(CASES))), st.integers(0, 10**9))
def test_python_regex_equals_walker(k, seed):
    template, line = CASES[k]
    line = mutate(line, random.Random(seed))
    assert pattern.match(template, line) == match(template, line)


def test_spark_equals_walker(spark):
    r = random.Random(5)
    for template, line in CASES:
        lines = list(dict.fromkeys(mutate(line, r) for _ in range(300)))
        df = spark.createDataFrame([("p", 0, i, x) for i, x in enumerate(lines, 1)], "path string, block long, lineno long, raw string")
        for row in parse_rows(df, template).collect():
            want = match(template, row.raw)
            assert row.matched == (want is not None), (template.name, row.raw)
            assert row.f.asDict() == (want or {f.name: "" for f in template.fields}), (template.name, row.raw)
