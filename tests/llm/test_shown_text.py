"""Text that a screen shows although rules, drawings or forms are around it."""

import pytest

from briefloom.llm import htmltext


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<style>@media print{.nav{display:none}}</style><i class=nav>x</i> z", "x z"),
        ("<style>@media (max-width:600px){.side{display:none} p{color:red}} .ad{display:none}</style><i class=side>x</i><i class=ad>y</i> z", "x z"),
        ("<style>@media screen{.a{display:none}} @media print, all{.b{display:none}}@media{.c{display:none}}</style><i class=a>x</i><i class=b>y</i><i class=c>w</i>z", "z"),
        ("<style>@media screen and (max-width:9px){.a{display:none}}@supports(display:grid){.b{display:none}}</style><i class=a>x</i><i class=b>y</i>", "xy"),
        ("<style media=print>.a{display:none}</style><style media=screen>.b{display:none}</style><i class=a>x</i><i class=b>y</i>", "x"),
        ("<style>@import 'x';/* .a{display:none} */ .b::before{content:'}'} .c{color:red;display:none}</style><i class=a>x</i><i class=b>y</i><i class=c>w</i>", "xy"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then", "if x=1 then"),
        ("a<svg><title>t</title><path d='M0'/><defs><text>no</text></defs><g><text>one<tspan>two</tspan></text><text>three</text></g></svg>b", "a onetwo three b"),
        ("<svg>" + "<path d=''/>" * 300 + "<text>deep</text></svg> after", "deep after"),
        ("<svg><foreignObject><p>in</p></foreignObject><g><p>out</p>", "in\n\nout"),
        ("<svg><title/><text>x</text></svg>y", "x y"),
        ("<pre>a <svg><g><text>b</text></g></svg></pre>", "a b"),
        ("<table><form>lost<div>block</div><tr><td>a</td></tr></form></table>", "lost\nblock\n\na"),
        ("<table><tr><form><td>a</td><p>para</p></form></tr></table>z", "para\n\na\n\nz"),
    ],
)
def test_shown(html, text):
    assert htmltext.visible_text(html) == text
