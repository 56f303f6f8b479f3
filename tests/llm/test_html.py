import html as H
import re

from tessera.llm import html as X
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_query_keeps_exactly_the_visible_characters(spark):
    """Brute force for these pages: drop head, scripts, styles and comments by pattern, then all tags and white space."""
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op5_html_text"](spark, SMALL).collect()
    assert len(rows) == len(raw)
    for r in rows:
        page = re.sub(r"(?is)<head\b.*?</head>|<!--.*?-->|<(script|style)\b.*?</\1>", " ", raw[r["page_id"]])
        want = re.sub(r"\s", "", H.unescape(re.sub(r"<[^>]*>", " ", page)))
        got = re.sub(r"\s", "", re.sub(r"(?m)^ *(- |\d+\. )", "", r["text"]))
        assert got == want


def test_blocks_lists_and_inline():
    t = X.visible_text
    assert t("<h1>T</h1><p>a <b>b</b>c<p>d<div>e</div>f") == "T\n\na bc\n\nd\n\ne\nf"
    assert t("<ul><li>one<li>two<ol start=3><li>x</li><li>y</ol><li>three</ul>end") == "- one\n- two\n  3. x\n  4. y\n- three\n\nend"
    assert t("a  \n b<br>c<br><br>d") == "a b\nc\n\nd"
    assert t("<pre>x  y\n  z</pre>q") == "x  y\n  z\n\nq"
    assert t("<p>&lt;tag&gt; &amp; &eacute;&#x4e2d;") == "<tag> & é中"
    assert t("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>") == "k\nv\nk2\nv2"


def test_tables_line_up():
    t = X.visible_text("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>all of it<tr><td>b<td><ul><li>x<li>y</ul></table>z")
    assert t == "Name       N\nlong name  1\nall of it\nb          - x - y\n\nz"
    assert X.visible_text("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>") == "a b c  d"


def test_visibility():
    t = X.visible_text
    assert t("<title>no</title><p hidden>no</p><p style='display:none'>no<b>no</b></p>yes<script>no</script>") == "yes"
    assert t("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>") == "yes"
    assert t("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>") == "s\nt\nu"
    assert t("<input type=hidden value=no><input type=submit value=Go><template>no</template>") == "Go"


def test_self_closing_svg_and_math_hide_nothing_after_them():
    t = X.visible_text
    for icon in ("<svg class='icon'/>", "<svg class=icon/>", "<svg />", "<math/>", "<svg><path d='M0 0'/><g/></svg>", "<svg><style/><title/></svg>"):
        assert t(f"<body><div>{icon}a<p>b</p></div>c</body>") == "a\n\nb\n\nc", icon
    assert t("<div><svg><path d='M0 0'>loose<p>b</div>c") == "b\n\nc"
    assert t("<svg><title>Icon</svg>c") == "c"
    assert t("<div/>a") == "a"


def test_a_head_without_end_tags():
    t = X.visible_text
    assert t("<html><head><title>t</title><p>text") == "text"
    assert t("<html><head><title>t</title><meta charset=utf-8>\n text <b>more</b>") == "text more"
    assert t("<head><script>no</script><style>no</style><noscript><p>no</p></noscript><link href=x><svg/>text") == "text"
    assert t("<head><head><title>t</title>text") == "text"
    assert t("<html><head><title>t</title></head><body>text") == t("<html><head><title>t</title><body>text") == "text"


def test_svg_text_is_shown():
    t = X.visible_text
    assert t("a<svg>no<g><text>one <tspan>two</tspan></text><text><![CDATA[three]]></text></g><defs><text>no</text></defs></svg>b") == "a one two three b"
    assert t("<p>a<svg><title>no</title><desc>no</desc><foreignObject><div>x</div><p>y</foreignObject>no</svg>b") == "a\nx\n\ny\n\nb"
    assert t("<svg hidden><text>no</text></svg><svg><text visibility=x style='display:none'>no</text></svg>") == ""
    assert t("<svg><switch><foreignObject><b>x</b></foreignObject><text>not supported</text></switch></svg>") == "x"


def test_values_of_inputs():
    for kind in ("text", "email", "tel", "url", "number", "date", "month", "week", "time", "datetime-local", "search", "submit", "reset", "button", "EMAIL", "unknown"):
        assert X.visible_text(f"<input type={kind} value=v1>") == "v1", kind
    for kind in ("hidden", "password", "checkbox", "radio", "file", "image", "range", "color"):
        assert X.visible_text(f"<input type={kind} value=v1>") == "", kind


def test_edges(spark):
    deep = "<div>" * 20000 + "x" + "</b></div>" * 100
    rows = [(1, "u", None, "old"), (2, "u", "", "old"), (3, "u", "<", "old"), (4, "u", deep, "old"), (5, "u", "plain", None), (5, "u", "plain", None),
            (6, "u", "word " * 100000, None), (7, "u", "</p></div><p", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = X.extract(frame)
    assert out.columns == ["page_id", "url", "text"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[4] == "x" and got[5] == "plain" and len(got[6]) == 499999
    assert X.extract(frame.limit(0)).count() == 0
