"""Tokens of drawings and back: each kind of element, what closes by itself, and forms that come round to themselves."""

import random
import xml.etree.ElementTree as ET

import pytest

from quarry.operators import codec

PATH = "[<|START_OF_SVG|>][<|path|>][<|d=|>] [<|moveto_abs|>]63.6 118.8 [<|curveto_rel|>] -27.9 0 -58 -17.5 -58 -55.9 [<|smooth_curveto_rel|>] 30.1 -55.9 58 -55.9 [<|close_path|>][<|fill=|>]#fde030[<|/path|>][<|END_OF_SVG|>]"


def test_a_path_of_tokens():
    root = ET.fromstring(codec.decode(PATH))
    (path,) = root
    assert path.attrib == {"d": "M 63.6 118.8 c -27.9 0 -58 -17.5 -58 -55.9 s 30.1 -55.9 58 -55.9 z", "fill": "#fde030"}
    assert root.get("viewBox") == "0 0 512 512" and root.get("width") == "512"


@pytest.mark.parametrize("tag", [*codec.SHAPES, "path", "text", "tspan", "g", "defs", "clipPath"])
def test_every_tag_opens_and_closes(tag):
    tokens = codec.encode(f'<svg><{tag} id="a_b"/><rect/></svg>')
    assert tokens.count(f"[<|{codec.OPEN.get(tag, tag)}|>]") == 1 + (tag == "rect")
    root = ET.fromstring(codec.decode(tokens))
    assert [e.tag.rpartition("}")[2] for e in root] == [tag, "rect"]
    assert root[0].get("id") == (None if tag in ("defs", "path") else "a_b")


@pytest.mark.parametrize("tag", codec.GRADIENTS)
def test_gradients_keep_their_attributes(tag):
    text = f'<svg><defs><{tag} id="g" offset="5%"><stop stop-color="red"/></{tag}></defs></svg>'
    plain, full = codec.encode(text), codec.encode(text, stops=True)
    assert "[<|offset=|>]5%" in plain and "[<|stop-color=|>]red" not in plain
    assert "[<|stop-color=|>]red" in full


@pytest.mark.parametrize("cmd", sorted(codec.COMMANDS))
def test_every_command(cmd):
    args = {"M": 2, "L": 2, "T": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "A": 7, "Z": 0}[cmd.upper()]
    numbers = "5 5 0 1 0 9 9.5" if cmd in "Aa" else " ".join(str(k + 1.5) for k in range(args))
    tokens = codec.path_tokens(f"M0 0{cmd}{numbers}")
    assert tokens == f"[<|moveto_abs|>]0 0[<|{codec.COMMANDS[cmd]}|>]{numbers}"


def test_not_well_formed_and_empty():
    assert codec.encode("<svg><g></svg>") == codec.encode("") == codec.encode(None) == ""
    assert ET.fromstring(codec.decode("")).tag.endswith("svg")
    assert ET.fromstring(codec.decode("no tokens [<|rect|>")).tag.endswith("svg")


def test_switches():
    text = '<svg><g stroke="red" id="k"><rect width="5px" height="50%"/></g><circle r="1.25" gradientUnits="x"/></svg>'
    assert "START_OF_GROUP" not in codec.encode(text, groups=False)
    assert codec.encode(text, inherit=False).count("stroke=") == 1 and codec.encode(text).count("stroke=") == 2
    assert codec.encode(text, path_only=True).count("=|>]") == 2
    assert "[<|rect|>]" not in codec.encode(text, ignore_tags=["rect"])
    assert codec.encode(text).endswith("[<|width=|>]5[<|height=|>]50[<|/rect|>][<|END_OF_GROUP|>][<|circle|>][<|r=|>]1.2[<|/circle|>][<|END_OF_SVG|>]")


def test_spaces_flag():
    tokens = "[<|START_OF_SVG|>][<|text|>][<|id=|>]a_b[<|text-content=|>]c_d[<|/text|>][<|END_OF_SVG|>]"
    assert 'id="a_b"' in codec.decode(tokens) and 'id="a b"' in codec.decode(tokens, spaces=True)


def shapes(r):
    out = []
    for _ in range(r.randint(1, 6)):
        paint = r.choice(["", 'fill="red"', 'stroke="#00f"', 'style="fill: blue; opacity: 0.5"'])
        n = lambda: f"{r.uniform(-9, 900):.3f}"  # noqa: E731, B023
        out.append(
            r.choice(
                [
                    f'<rect x="{n()}" width="{n()}" {paint}/>',
                    f'<circle r="{n()}" {paint}/>',
                    f'<path d="M{n()} {n()}C{n()},{n()} 1 2 3,4Z" {paint}/>',
                    f'<text x="{n()}" {paint}>a &lt; b_{r.randint(0, 9)}<tspan dy="1em">c</tspan> d</text>',
                    f'<g class="k_{r.randint(0, 9)}" {paint}><line x2="{n()}"/></g>',
                ]
            )
        )
    return "<svg width='512' height='512' viewBox='0 0 512 512'>" + "".join(out) + "</svg>"


def test_what_was_decoded_encodes_to_itself():
    r = random.Random(6)
    for _ in range(200):
        once = codec.encode(codec.decode(codec.encode(shapes(r))))
        assert codec.encode(codec.decode(once)) == once


def test_replacements_prefer_the_longest():
    assert codec.replaced("abcab", {"ab": "1", "abc": "2", "1": "3"}) == "21"
    assert codec.replaced("x", {}) == "x"


def test_columns(spark):
    df = spark.createDataFrame([(1, "<svg/>", "x"), (2, None, None), (3, "<svg", "y")], "id int, svg string, tokens string")
    got = {r.id: r.tokens for r in codec.encoded(df, "svg").collect()}
    assert got == {1: "[<|START_OF_SVG|>][<|END_OF_SVG|>]", 2: None, 3: ""}
