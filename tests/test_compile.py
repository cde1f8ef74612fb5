import pytest

from assay.plans.query import compile_query

CASES = {
    "malware beacon": "malware & beacon",
    "error|warn": "error ; warn",
    "beacon -test": "beacon & !test",
    "eventid:4624 user:administrator": "eventid/4624 & user/administrator",
    'command:"powershell -enc"': "command/powershell -enc",
    "a b|c": "a & b ; c",
    "com:WS01|WS02|WS03": "com/ws01 ; com/ws02 ; com/ws03",
    "com:x|-y": "com/x ; !com/y",
    "com:a|b c": "com/a ; com/b & c",
    "a:x|b:y z": "a/x ; b/y & a/z",
    "-EventID:4624": "!eventid/4624",
    "--x": "!-x",
    "-": "-",
    '-"x y"': "- & x y",
    '-col:"x y"': "-col/x y",
    '"-keyword"': "-keyword",
    'data:"hoge:fuga"': "data/hoge:fuga",
    'a:b:"x y"': "a:b/x y",
    "http://x": "http///x",
    'foo"bar baz"': "foo & bar baz",
    '"open phrase': "open phrase",
    "A OR b": "a & or & b",
    "a | | b": "a ; b",
    "||a||b||": "a ; b",
    "col: term": "col/(empty) & term",
    'col: "x y" z': "col/x y & z",
    '"a|b" c': "a|b & c",
    "x:1|y:2|z": "x/1 ; y/2 ; y/z",
    "a|b": "a ; b",
    "x:1 q|r": "x/1 & q ; r",
}


@pytest.mark.parametrize("text,want", CASES.items())
def test_compile(text, want):
    assert str(compile_query(text)) == want


@pytest.mark.parametrize("text", ["", "   ", "col:", 'col:""', "|", '"  "', "-col:", "a:|b:"])
def test_blank(text):
    assert compile_query(text).blank
