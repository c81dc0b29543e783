import pytest

from sparklog.functions.color import rgb_to_256
from sparklog.plans import pattern
from sparklog.plans.builtins import all_builtins, builtin
from sparklog.plans.template import MAX_FIELDS, TemplateError, load, parse, parse_color
from sparklog.plans.template import LogIOError


def test_builtins_round_trip():
    for name, t in all_builtins().items():
        assert parse(t.to_lxt()) == t
        assert builtin(name.upper()) is t


def test_definition():
    t = parse('# a comment\nname: app\ndescription: my app\n\nentry: %{at} %{lvl} 100%% %{n:INTEGER}\nfield at: format="%H:%M" unit=s, color=#abc\nfield lvl: values="W|WARN,ERR"\n')
    assert [f.type for f in t.fields] == ["timestamp", "enum", "int"]
    assert t.fields[1].values == ("WARN", "ERR", "W")
    assert t.fields[0].color == 0xAABBCC and t.fields[0].unit == "s"
    assert t.severity == 1
    assert t.schema()["f"].dataType["lvl"].metadata["values"] == ["WARN", "ERR", "W"]
    assert pattern.match(t, "12:30 WARN 100% -7") == {"at": "12:30", "lvl": "WARN", "n": "-7"}
    assert pattern.match(t, "12:30 WARNX 100% 7") is None


def test_defaults():
    t = parse("entry: %{a:timestamp} %{b}")
    assert (t.name, t.fields[0].format, t.severity) == ("custom", "%Y-%m-%d %H:%M:%S", None)


@pytest.mark.parametrize(
    "text",
    [
        "name: x", "entry:", "entry: %{a", "entry: %{}", "entry: %{a:nope}", "what: 1\nentry: %{a}", "no colon\nentry: %{a}",
        "entry: %{a}\nfield a: color=#12", "entry: %{a}\nfield a: nope=1", "entry: %{a}\nfield a: type", "entry: %{a}\nfield a: unit=\"x",
        "entry: %{a}\nfield a: type=int # a comment", "entry: %{a}\n" * 5, "entry: " + " ".join(f"%{{f{i}}}" for i in range(MAX_FIELDS + 1)),
        "entry: %{a}\nfield a: values=" + "|".join(f"v{i}" for i in range(25)), "entry: %{" + "a" * 96 + "}", "name: " + "x" * 600 + "\nentry: %{a}",
        "entry: " + " ".join(["%{a:word}"] * 30),
    ],
)
def test_errors(text):
    with pytest.raises(TemplateError):
        parse(text)


def test_files(tmp_path):
    (tmp_path / "a.lxt").write_text("entry: %{a}\n")
    assert load(str(tmp_path / "a.lxt")).fields[0].name == "a"
    with pytest.raises(LogIOError):
        load(str(tmp_path / "b.lxt"))
    with pytest.raises(TemplateError):
        builtin("nope")


def test_colors():
    assert [rgb_to_256(parse_color(x)) for x in ("#5FAFD7", "F00", "#000000", "ffffff", "8A8A8A")] == [74, 196, 16, 231, 245]
    assert parse_color("#12345") == parse_color("red") == -1
