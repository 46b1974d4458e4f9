import pytest

from scoreloom.llm.html_text import extract_text, rendered

CASES = [
    (None, ""), ("", ""), ("plain   text\n here", "plain text here"),
    ("<head><title>t</title><style>p{}</style></head><p>one<p>two<b>x</b> y", "one\n\ntwox y"),
    ("<script>var t='</p>'</script><div>a</div><div>b</div>", "a\nb"),
    ("<div hidden>no</div><p style='color:red; display:none'>no</p><span style='visibility: hidden'>no</span>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>name<th>n<tr><td>x<td>1<tr><td>longer<td>22</table>", "name    n\nx       1\nlonger  22"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td colspan=2>wide cell</table>", "r  a\n   b\nwide cell"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>\n x\n  y</pre>z", " x\n  y\n\nz"), ("&lt;b&gt; &amp; &eacute;", "<b> & é"),
    ("<p>a</div></p><blockquote>q<p>r</blockquote>", "a\n\n> q\n>\n> r"), ("x<b", "x"), ("1 < 2 <", "1 < 2 <"), ("<!-- x -->y<!-- open", "y"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendering(html, text):
    assert rendered(html) == text


DRAWN = [
    ("a <math><semantics><mrow><mi>x</mi> <mo>=</mo>\n<mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>tex</annotation></semantics></math> b", "a x=1/2 b"),
    ("<math display=block><mtable><mtr><mtd><mn>10</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math>z", "10  2\n3   4\nz"),
    ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs>stray<g><text>one <tspan>two</tspan></text><path/><text x=1>three</text></g></svg>four", "one two three four"),
    ("<svg><text display=none>no</text><text><tspan x=0>a</tspan><tspan x=0>b</tspan></text><title/><text><![CDATA[1 < 2]]></text></svg>", "a b 1 < 2"),
    ("<svg><switch><foreignObject><div>html</div></foreignObject><text>fallback</text></switch></svg>", "html"),
    ("<svg><path><p>out of an open drawing", "out of an open drawing"), ("<math><mi>x<p>out", "x\n\nout"),
    ("<select><option>a<option selected>b<option>c</select>", "b"), ("in <select><option disabled>a<option>b</select>now", "in b now"),
    ("<select><option hidden selected>pick<option>b</select>", "pick"), ("<select><optgroup label=g disabled><option>a<optgroup label=h><option label=L>b</select>", "L"),
    ("<select multiple><optgroup label=g><option>a<option hidden>b<optgroup label=h><option>c</select>z", "g\na\nh\nc\nz"),
    ("<select size=3><option>a<option>b</select>", "a\nb"), ("<select><option>a<input>shown", "a shown"), ("<select hidden><option>a</select>z", "z"),
]


@pytest.mark.parametrize("html,text", DRAWN)
def test_formulas_drawings_and_selects(html, text):
    assert rendered(html) == text


def test_depth_and_length():
    assert rendered("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(rendered("<p>word</p>" * 20000)) == 4 * 20000 + 2 * 19999


DEEP = [
    ("a<script>no</script><style>no</style><div hidden>no<b>no</b></div><p style='display:none'>no<i>no</i></p><b>b</b>", "ab"),
    ("<p>a</p>b<div>c</div>d", "a\n\nb\nc\nd"), ("a<select><option>b<option selected>c</select>d", "a c d"),
    ("<svg><title>no</title><g><text>a</text><text>b</text></g></svg>c <math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "a b c 1/2"),
]


@pytest.mark.parametrize("html,text", DEEP)
def test_deep_content(html, text):
    assert rendered(html) == rendered("<div>" * 400 + html + "</div>" * 400) == text


def test_end_tags_of_deep_elements():
    assert rendered("x<div hidden>" + "<div>" * 400 + "no" + "</div>" * 400 + "no</div>y") == "xy"
    assert rendered("<svg>" + "<g>" * 400 + "<text>a</text><title>no</title>" + "</g>" * 400 + "<text>b</text></svg>c") == "a b c"
    assert rendered("<ul><li>" * 400 + "a").endswith("a")
    assert rendered("<table><tr><td>" * 400 + "a") == "a"
    assert rendered("<svg><foreignobject><select><option>" * 400 + "a") is not None


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (1, None, "t"), (None, "<li>b", "t")], "page_id long, html string, text string")
    assert sorted((tuple(r) for r in extract_text(pages).collect()), key=str) == sorted([(1, "a", 1), (1, "", 0), (None, "b", 1)], key=str)
    assert extract_text(pages.where("false")).count() == 0
