import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refscan.functions.phpser import leaves_of


def dump(x):
    """Serializes ints, strings, None, bools, floats and lists or dicts of them."""
    if x is None:
        return "N;"
    if isinstance(x, bool):
        return f"b:{int(x)};"
    if isinstance(x, int):
        return f"i:{x};"
    if isinstance(x, float):
        return f"d:{x!r};"
    if isinstance(x, str):
        return f's:{len(x.encode())}:"{x}";'
    pairs = enumerate(x) if isinstance(x, list) else x.items()
    return f"a:{len(x)}:{{{''.join(dump(k) + dump(v) for k, v in pairs)}}}"


def want(x):
    if isinstance(x, (list, dict)):
        return [leaf for v in (x if isinstance(x, list) else x.values()) for leaf in want(v)]
    if isinstance(x, str):
        return [("string", x)]
    return [("int", str(x))] if isinstance(x, int) and not isinstance(x, bool) else []


scalars = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=12) | st.floats(allow_nan=False, allow_infinity=False)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abé\"};", max_size=4) | st.integers(0, 99), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_round_trip(x):
    got = leaves_of(dump(x))
    assert got["ok"] and got["container"] == isinstance(x, (list, dict))
    assert [(leaf["kind"], leaf["value"]) for leaf in got["leaves"]] == want(x)


@pytest.mark.parametrize(
    ("text", "leaves"),
    [
        ("plain 123", ["plain 123"]),
        ("", [""]),
        ('a:1:{i:123;s:1:"x";}', ["x"]),  # a key isn't a leaf
        ('O:8:"stdClass":1:{s:2:"id";i:123;}', ["123"]),
        ('O:1:"A":2:{s:4:"\0A\0x";i:1;s:1:"y";i:2;}', ["2"]),  # private properties can't be seen
        ('a:1:{i:0;a:1:{i:0;s:3:"123";}}', ["123"]),
    ],
)
def test_leaves(text, leaves):
    got = leaves_of(text)
    assert got["ok"] and [x["value"] for x in got["leaves"]] == leaves


@pytest.mark.parametrize("text", ['a:2:{i:0;i:1;}', 's:9:"abc";', "i:1x;", 'a:1:{i:0;i:1;}x;', 'a:1:{N;i:1;}', "a:-1:{}", 'O:1:"A":1:{i:0;}'])
def test_unreadable(text):
    assert leaves_of(text) == {"ok": False, "container": False, "leaves": []}


def test_deep_nesting():
    text = "a:1:{i:0;" * 5000 + "i:7;" + "}" * 5000
    assert leaves_of(text)["leaves"] == [{"kind": "int", "value": "7"}]
