import json

import pytest

from specstrata.extract import modules as m
from specstrata.extract.algorithms import algorithms
from specstrata.extract.css import css
from specstrata.extract.cssgrammar import GrammarError, parse_value
from specstrata.extract.dom import parse_html
from specstrata.extract.events import events
from specstrata.extract.table import extract, idl_reports, items, select_modules
from specstrata.extract.webidl import IdlError, idl_report, member_names, parse_idl


def page(html, **spec):
    return m.Page(html, {"url": "https://a.example/x/", "shortname": "x", "title": None} | spec)


def test_tree_repairs():
    doc = parse_html("<table><tr><td>a<td>b<tr><td>c</table><p>x<b>y<br><p>z</b><ul><li>1<li>2</ul>")
    assert [len(tr.select("td")) for tr in doc.select("tr")] == [2, 1]
    assert len(doc.select("ul > li")) == 2 and len(doc.select("p")) == 2
    assert parse_html("<td>open<p>x").first("p") is not None


def test_selectors():
    doc = parse_html('<div id=a class="x y"><p data-k="v w">1</p><p>2</p><span><i>3</i></span></div>')
    for selector, n in (("div.x.y > p", 2), ("#a p:first-child", 1), ("p + p", 1), ("p:not([data-k])", 1), ("[data-k^=v]", 1), ("[data-k$='w']", 1), ("[data-k*=' ']", 1), ("span:has(i)", 1), (":is(p, i)", 3), ("p:nth-child(2)", 1), ("span:has(> i), p:last-child", 1)):
        assert len(doc.select(selector)) == n, selector


def test_simple_modules():
    p = page("<title> A\n b </title><meta name=generator content='Bikeshed 1'><meta name=revision content='" + "a1" * 20 + "'><div class=head><h2>Draft, 3 May 2024</h2></div>")
    assert (m.title(p), m.generator(p), m.revision(p), m.last_modified(p)) == ("A b", "bikeshed", "a1" * 20, "3 May 2024")
    assert m.title(page("", title="T")) == "T" and m.title(page("")) == "[No title found for https://a.example/x/]"


def test_links_and_ids():
    p = page('<a href="https://B.example">1</a><a href="https://b.example/#z">2</a><a href="https://b.example/#y">2</a><a data-link-type=dfn href="https://b.example/c#q">3</a><a href="/rel#n">4</a><del><a href="https://no.example/">5</a></del>')
    assert m.links(p) == {"rawlinks": {"https://b.example/": ["z", "y"]}, "autolinks": {"https://b.example/c": ["q"]}}
    p = page('<p id="a b"></p><a name=n></a><i id=respec-x></i><section data-page="https://a.example/x/2"><b id=c></b></section><a id=m name=m></a>')
    assert m.ids(p) == ["https://a.example/x/#a%20b", "https://a.example/x/2#c", "https://a.example/x/#m", "https://a.example/x/#n"]


def test_headings_and_outline():
    p = page("<h1 id=t>Title</h1><section id=s><h2 id=h>2.1. Model</h2><p id=p>x</p><h3>3 Deep</h3><p id=q></p></section><h2><a name=n>Old</a></h2>")
    assert m.headings(p)[1] == {"id": "s", "href": "https://a.example/x/#s", "title": "Model", "number": "2.1", "alternateIds": ["h"], "level": 2}
    assert [h["title"] for h in m.headings(p)] == ["Title", "Model", "Old"]
    assert p.headings_by_id["https://a.example/x/#p"]["title"] == "Model" and p.headings_by_id["https://a.example/x/#q"] == {"href": "https://a.example/x/", "title": "Deep", "number": "3"}
    assert [s["title"] for s in m.outline(p)] == ["Title", "2.1. Model", "3 Deep", "Old"]


def test_references():
    dl = "<dl><dt>[A B]<dd><a href='#local'>x</a><a href='https://a.example'>A</a><dt>[B]<dd>non-normative<dt>[]<dd>none</dl>"
    other = "<dl><dt>[C]<dd>c</dl>"
    made = "<meta name=generator content='{}'>".format
    want = {"normative": [{"name": "AB", "url": "https://a.example/"}], "informative": [{"name": "B"}, {"name": "C"}]}
    assert m.references(page(made("Bikeshed") + "<h2 id=normative>N</h2>" + dl + "<h2 id=informative>I</h2>" + other)) == want
    assert m.references(page(made("ReSpec") + "<section id=normative-references><h2>N</h2>" + dl + "</section><section id=informative-references>" + other + "</section>")) == want
    assert m.references(page(made("ReSpec") + "<h2 id=normative>N</h2>" + dl)) is None
    by_name = m.references(page("<h2>A.1 Normative References</h2><p>x" + other + "<h2>2 normative  references</h2><p>y" + dl + "<h2>Informative references</h2><ul><li>[1] <a href='rel'>One</a><ul><li><a href=no>no</a></ul><li>Two <ul><li>no</ul></ul><h2>End</h2>" + dl))
    assert by_name == {"normative": [{"name": "AB", "url": "https://a.example/"}, {"name": "B"}], "informative": [{"name": "One", "url": "rel"}, {"name": "Two"}]}
    parts = m.references(page("<h2>9 References</h2><h3>Normative</h3>" + other + "<h3>Informative</h3><ul><li>X</ul><h2>More</h2>" + dl))
    assert parts == {"normative": [{"name": "C"}], "informative": [{"name": "X"}]}
    assert m.references(page("<h2>References</h2>" + dl)) == {"normative": [{"name": "AB", "url": "https://a.example/"}], "informative": [{"name": "B"}]}
    clauses = m.references(page("<emu-clause id=sec-references-normative><h1>N</h1><p>ONE 1, <i>Title</i></p><p>TWO. <a href='https://t.example/'>t</a></p><p>Just words, no more</p></emu-clause>"))
    assert clauses == {"normative": [{"name": "ONE 1"}, {"name": "TWO", "url": "https://t.example/"}], "informative": []}
    assert m.references(page("<p>none")) is None


def test_elements_of_all_forms():
    p = page("<h4 id=h>The <dfn id=v>video</dfn> and <dfn id=a>audio</dfn> elements</h4><dl class=element><dt>Categories:<dd>x<dt>DOM interface:<dd>Use HTMLThing, as is</dl><h4>Core concepts</h4><dl class=element><dt>x<dd>y</dl>")
    assert m.elements(p) == [{"name": n, "href": f"https://a.example/x/#{i}", "interface": "HTMLThing"} for n, i in (("video", "v"), ("audio", "a"))]
    p = page("<section id=s><div class=element-summary><div class=element-name>‘circle’</div><dl><dt>DOM Interfaces:<dd>SVGCircle</dl></div></section><table class=definition-table><tr><td><dfn id=f>feBlur</dfn><tr><th>DOM Interfaces<td>FE</table>")
    assert m.elements(p) == [{"name": "circle", "href": "https://a.example/x/#s", "interface": "SVGCircle"}, {"name": "feBlur", "href": "https://a.example/x/#f", "interface": "FE"}]
    two = "<dfn id=e data-dfn-type=element>b</dfn><dfn data-dfn-type=interface>HTMLbElement</dfn><dfn data-dfn-type=interface>HTMLBElement</dfn>"
    assert m.elements(page(two)) == [{"name": "b", "href": "https://a.example/x/#e"}] and m.elements(page(two, shortname="mathml-core"))[0]["interface"] == "MathMLElement"
    with pytest.raises(ValueError):
        m.elements(page("<dl class=element><dt>x</dl>"))


def test_code_blocks():
    p = page("<pre class=idl>\n  interface A {\n    attribute long b;\n  };\n</pre><div class=note><pre class=idl>no</pre></div><pre class='idl exclude'>no</pre><pre><code class=idl>enum E {};</code></pre>")
    assert m.idl(p) == "interface A {\n  attribute long b;\n};\n\nenum E {};"
    p = page("<pre class='cddl' data-cddl-module='l,r'>a = 1</pre><pre class='cddl'>b = 2</pre>")
    assert m.cddl(p) == [{"name": "all", "cddl": "a = 1\n\nb = 2"}, {"name": "l", "cddl": "a = 1\n\nb = 2"}, {"name": "r", "cddl": "a = 1\n\nb = 2"}]


def test_definitions():
    p = page("<h2 id=h>H</h2><dfn id=a data-dfn-type=method data-dfn-for='X, Y(a, b)' data-lt='f()|g()'>f</dfn><dfn id=b data-dfn-type=method data-dfn-for='Y(a, b),X' data-lt='g()|f()'>f</dfn><div class=note><dfn id=c>t</dfn></div><dfn id=d data-lt=''>no</dfn><dfn id=e data-dfn-type=nope>no</dfn><dl class=domintro><dt>x . <a id=i href='#a'>f</a>()</dt><dt><dfn id=z data-noexport>z</dfn><a id=no href='#a'>f</a></dt></dl><dfn id=o><a href='https://o.example/'>o</a></dfn>")
    got = m.dfns(p)
    assert [d["id"] for d in got] == ["a", "c", "z"]
    assert got[0]["for"] == ["X", "Y(a, b)"] and got[0]["linkingText"] == ["f()", "g()"] and got[0]["access"] == "public" and got[0]["heading"]["title"] == "H" and [(x["id"], x["name"], x["heading"]["title"]) for x in got[0]["links"]] == [("i", "x . f()", "H")]
    assert got[1]["informative"] and got[1]["access"] == "private" and got[1]["definedIn"] == "note"


def test_elements_and_events():
    p = page("<dfn id=e data-dfn-type=element>video</dfn><dfn data-dfn-type=interface>HTMLVideoElement</dfn>")
    assert m.elements(p) == [{"name": "video", "href": "https://a.example/x/#e", "interface": "HTMLVideoElement"}]
    p = page("<table><thead><tr><th>Event name<th>Interface<th>Target<tbody><tr><td><dfn id=l data-dfn-type=event>load</dfn><td><code>Event</code><td>Window, Doc</table><table class=event-definition><tr><th>Type<td><b>go</b><tr><th>Bubbles<td>Yes</table><pre class=idl>interface A { attribute EventHandler onstop; };</pre>")
    got = {e["type"]: e for e in events(p)}
    assert got["load"]["interface"] == "Event" and got["load"]["targets"] == ["Window", "Doc"] and got["go"]["bubbles"] is True and "stop" not in got


def test_algorithms():
    p = page("<p>To <dfn id=r>run</dfn>:</p><ol><li>Let x be 1.<li>If so:<ol><li>Return x.</ol></ol><ol><li>apples</ol>")
    got = algorithms(p)
    assert len(got) == 1 and got[0]["name"] == "run" and got[0]["steps"][1]["steps"][0]["html"] == "Return x."


def test_css():
    html = "<table class=propdef><tr><th>Name:<td><dfn id=w>width</dfn><tr><th>Value:<td>auto | <a>&lt;length&gt;</a><tr><th>Initial:<td>−1</table><table class=propdef><tr><th>Name:<td>width<tr><th>New values:<td>fit</table>"
    html += "<dfn data-dfn-type=at-rule id=r>@media</dfn><table class=descdef><tr><th>Name:<td>range<tr><th>For:<td>@media<tr><th>Value:<td>a</table><dfn data-dfn-type=type id=t>&lt;len&gt;</dfn><dfn data-dfn-type=value data-dfn-for='width, &lt;len&gt;' id=v>full</dfn><pre class=prod>&lt;len> = a | b\n&lt;lost> = c</pre>"
    got = css(page(html))
    assert got["properties"][0]["value"] == "auto | <length> | fit" and got["properties"][0]["initial"] == "-1"
    assert got["atrules"][0]["descriptors"][0]["name"] == "range"
    assert got["values"][0]["value"] == "a | b" and got["values"][0]["values"][0]["name"] == "full"
    assert [w["name"] for w in got["warnings"]] == ["<lost>"]


def test_css_of_older_form_and_values_from_text():
    old = "<div class=propdef><dl><dt><dfn id=c>'cue'</dfn>, <a name=d>'cues'</a><dd><table><tr><td><em>Value:</em><td>a | b<tr><td><em>New values:</em><td>c</table></dl></div><div class=descdef><dl><dt id=r>'range'<dd><table><tr><td>For:<td>@page</table></dl></div>"
    got = css(page(old))
    assert [(x["name"], x["href"][-2:], x["value"], x["newValues"]) for x in got["properties"]] == [("cue", "#c", "a | b", "c"), ("cues", "#d", "a | b", "c")]
    assert got["atrules"] == [{"name": "@page", "descriptors": [{"name": "range", "href": "https://a.example/x/#r", "for": "@page"}]}]
    text = "<p><dfn data-dfn-type=type id=t>&lt;pos></dfn> = left | <a>right</a></p><p>The <dfn data-dfn-type=function id=f data-lt='fit()|fit(a, b)'>fit(a, b)</dfn> call.</p><dl><dt><dfn data-dfn-type=value data-dfn-for='&lt;pos>, top' id=v>wide</dfn><dd>As it <sup>1</sup> is.<div class=note>no</div></dl>"
    text += "<pre>&lt;size> = <dfn data-dfn-type=type id=s>&lt;size></dfn></pre><p><dfn data-dfn-type=selector data-export id=e>:open</dfn> and <dfn data-dfn-type=selector data-export id=g>>></dfn></p><p><dfn data-dfn-type=property>word-wrap</dfn> is a <a href='#legacy-name-alias'>alias</a> of <a data-link-type=property>overflow-wrap</a></p>"
    got = css(page(text))
    values = {x["name"]: x for x in got["values"]}
    assert values["<pos>"]["value"] == "left | right" and values["fit()"]["value"] == "fit(a, b)" and values["<pos>"]["values"] == [{"name": "wide", "prose": "As it is.", "href": "https://a.example/x/#v", "type": "value", "value": "wide"}]
    assert values["<size>"]["value"] == "<size>" and [x["value"] for x in got["selectors"]] == [":open", "'>' '>'"]
    assert got["properties"] == [{"name": "word-wrap", "href": "https://a.example/x/#", "legacyAliasOf": "overflow-wrap"}] and [(w["msg"], w["for"]) for w in got["warnings"]] == [("Dangling value", "top")]
    round_ = "<p><dfn data-dfn-type=type data-dfn-for='&lt;b>' id=a>&lt;a></dfn></p><p><dfn data-dfn-type=type data-dfn-for='&lt;a>' id=b>&lt;b></dfn></p>"
    assert css(page(round_))["values"] == []


def test_events_in_prose_and_lists():
    fire = "https://dom.spec.whatwg.org/#concept-event-fire"
    p = page(
        f"<p id=p>First <a href='{fire}'>fire an event</a> named <code><a href='#e'>go</a></code>, not cancelable, then <a href='{fire}'>fire an event</a> named \"halt\" using <code>HaltEvent</code> with the bubbles and cancelable attributes set to true, or <a href='{fire}'>fire an event</a> named eventName.</p>"
        "<p id=q><a href='https://w3c.github.io/ServiceWorker/#fire-functional-event'>Fire functional event</a> push</p><div class=note><a href='" + fire + "'>fire an event</a> named no</div>"
        "<h3>The <code>MoveEvent</code></h3><dl><dt><dfn id=e data-dfn-type=event data-dfn-for=A>go</dfn></dt><dd><ul><li>Bubbles: Yes</li><li>Cancelable: no</li></ul></dd></dl><pre class=idl>interface B { attribute EventHandler onhalt; attribute EventHandler onstop; };</pre>"
    )
    got = {e["type"]: e for e in events(p)}
    assert set(got) == {"go", "halt", "push", "stop"}
    assert got["go"] == {"type": "go", "src": {"format": "fire an event phrasing", "href": "https://a.example/x/#p"}, "href": "https://a.example/x/#e", "targets": ["A"], "interface": "MoveEvent", "cancelable": False, "bubbles": True}
    assert got["halt"]["interface"] == "HaltEvent" and got["halt"]["bubbles"] and got["halt"]["cancelable"] and got["halt"]["targets"] == ["B"]
    assert got["push"]["interface"] == "ExtendableEvent" and got["stop"] == {"type": "stop", "targets": ["B"], "src": {"format": "IDL eventHandler"}}
    far = events(page("<table class=def id=d><tr><th>Type<td>nav<tr><th>Bubbles<td>Yes<tr><th>Cancelable<td>No</table><table><thead><tr><th>Event<th>Bubbles<tbody><tr><td><a href='https://b.example/#o'>out</a><td>Yes</table>"))
    assert [(e["type"], e["bubbles"], e.get("isExtension", False)) for e in far] == [("nav", True, False), ("out", True, True)]
    assert events(page("<table><tr><th>Event<th>x<tr><td><code>a</code><td>b</table>", shortname="dom")) == []


def test_algorithms_of_all_forms():
    p = page(
        "<div class=algorithm data-algorithm='do it' data-algorithm-for=Box id=box><p>To do:</p><ol><li>Acknowledge.<li>Which?<dl class=switch><dt>one<dd>Return <a href='#one'>1</a>.<dt>two<dd><ol><li>Return 2.</ol></dl></ol></div>"
        "<p>To <dfn data-export data-dfn-type=dfn id=s>sum up</dfn>, add.</p><div class=toc><ol><li>Let go</ol></div><div class=note><ol><li>Let go</ol></div><ol><li>pears</ol>"
        "<ul><li>The <dfn id=n data-dfn-for='A, B'>next</dfn> steps: <ol><li>Otherwise, x<ol><li>plums</ol><ol><li>In parallel, y</ol><ol><li>run these steps</ol></ol></ul>"
    )
    a, b, c = algorithms(p)
    assert a["name"] == "Box/do it" and a["href"].endswith("#box") and a["rationale"] == ".algorithm" and a["html"] == "To do:"
    cases = a["steps"][1]["steps"][0]
    assert cases["operation"] == "switch" and cases["steps"][0] == {"case": "one", "html": 'Return <a href="https://a.example/x/#one">1</a>.'} and cases["steps"][1]["steps"][0]["html"] == "Return 2."
    assert b["name"] == "sum up" and b["rationale"] == "To <dfn>" and "steps" not in b
    assert c["name"] == "A/next" and c["rationale"] == "in parallel" and c["steps"][0]["ignored"] == ["plums"] and len(c["steps"][0]["additional"]) == 1
    assert algorithms(page("<emu-clause id=x><h1>X</h1><ol><li>Let x.</ol></emu-clause>")) == []


def dfn_rows(html, shortname):
    return [(d["id"], d["type"], "|".join(d["linkingText"]), ",".join(d["for"]), d["access"]) for d in m.dfns(page(html, shortname=shortname))]


def test_definitions_with_markup_of_their_own():
    assert dfn_rows("<h3 id=h>The <dfn>a</dfn> element</h3><h3 id=k data-lt=x>The <dfn>b</dfn></h3>", "html") == [("h", "dfn", "a", "", "public"), ("k", "dfn", "x", "", "public")]
    css2 = "<a name=p class=propdef-title><span class=index-def title=\"'top'|top::definition of\">'top'</span></a><span class=index-def title=\"&lt;len>, definition of\"><a name=l class=value-def>len</a></span><span class=index-def>none</span>"
    assert dfn_rows(css2, "CSS2") == [("p", "property", "top", "", "public"), ("l", "type", "<len>", "", "public")]
    rfc = "<pre class=newpage>Contents Appendix D.  Standard Prelude</pre><pre class=newpage><a id=appendix-D>Appendix D</a>.  Standard Prelude\n   any = #\n   uint = #0\n</pre><pre class=newpage>   nint = #1\n  Figure 14: CDDL Prelude\n   more = 1</pre>"
    assert [r[:4] for r in dfn_rows(rfc, "rfc8610")] == [("appendix-D", "cddl-type", "any|uint|nint|more", "")] and dfn_rows("<pre class=newpage>x</pre>", "rfc8610") == []
    gl = "<pre class=idl>interface mixin Base { attribute long size; undefined draw(long a, long b); undefined draw(long a); };</pre><p class=attribute-name><a id=DOM-Ctx-size>size</a></p><dl><dt class=idl-code><a name=D2>void draw</a>(long x,\n long y)</dt><dt class=idl-code><a name=D9>void gone</a>(long x)</dt></dl>"
    assert [r[:4] for r in dfn_rows(gl, "webgl1")] == [("DOM-Ctx-size", "attribute", "size", "Base"), ("D2", "method", "draw(x, y)", "Base")]
    svg = "<pre class=idl>interface Shape { attribute long r; undefined move(); };</pre><h2 id=LinkElement>link</h2><dl class=attrdef><dt><dfn id=RAttr>r</dfn></dl><section data-page='https://a.example/x/attindex.html'><table><tr><th><span class=attr-name><a href='x.html#RAttr'>r</a></span><td>circle</table></section><b id=__svg__Shape__r>r</b><b id=__svg__Shape__move>move</b><h3 id=InterfaceShape>Shape</h3><dl><dt id=QAttr><span class=adef>q</span></dl>"
    assert [r[:4] for r in dfn_rows(svg, "SVG2")] == [("LinkElement", "element", "link", ""), ("RAttr", "element-attr", "r", "circle"), ("__svg__Shape__r", "attribute", "r", "Shape"), ("__svg__Shape__move", "method", "move", "Shape"), ("InterfaceShape", "interface", "Shape", ""), ("QAttr", "element-attr", "q", "")]


def test_definitions_of_the_script_language():
    clause = "<emu-clause id={}><h1>{}</h1>{}</emu-clause>".format
    body = "".join(clause(*x) for x in [
        ("sec-map-objects", "24.1 Map Objects", "<emu-clause id=sec-map-constructor></emu-clause>"), ("sec-math-objects", "The Math Object", ""), ("sec-promise-objects", "Promise Objects", ""), ("sec-native-error-types-used-in-this-standard-rangeerror", "RangeError", ""), ("sec-fundamental-objects", "Fundamental Objects", ""),
        ("sec-map.prototype.get", "24.1.3 Map.prototype.get ( key )", ""), ("sec-get-map.prototype.size", "get Map.prototype.size", ""), ("sec-map.prototype.constructor", "Map.prototype.constructor", ""), ("sec-json.parse", "JSON.parse ( text [ , reviver ] )", ""), ("sec-math.pi", "Math.PI", ""), ("sec-map-iterable", "Map ( iterable )", ""), ("sec-toint32", "ToInt32 ( argument )", ""), ("sec-decodeuri", "decodeURI ( u )", ""), ("sec-long", "Some words here", ""),
        ("sec-records", "Global Environment Records", clause("sec-hasbinding", "HasBinding ( N )", "")),
    ])
    body += "<figure><figcaption>Abstract Methods of <emu-xref>Environment Records</emu-xref></figcaption><table><tbody><tr><td>HasBinding(N)<td>x</table></figure><emu-eqn id=eqn-day aoid=Day>Day(t)</emu-eqn><emu-eqn id=eqn-ms aoid=ms>ms = 1</emu-eqn><emu-clause id=sec-state><figure><figcaption>Table 1: Additional State Components for Contexts</figcaption><table><tr><td>Generator<td>y</table></figure></emu-clause>"
    body += "<emu-grammar type=definition><emu-production id=prod-If name=IfStatement>If :</emu-production></emu-grammar><emu-clause id=sec-w><h1>Words</h1><p><dfn>thing</dfn> <dfn id=sym>@@iterator</dfn> <dfn id=in>%Math%</dfn> <dfn variants=realms>realm</dfn></p></emu-clause><emu-annex legacy><dfn id=old>old</dfn></emu-annex>"
    got = {r[2]: r for r in dfn_rows(body, "ecmascript")}
    want = {
        "Map": ("interface", ""), "Math": ("namespace", ""), "Promise": ("namespace", ""), "RangeError": ("exception", ""), "get(key)": ("method", "Map"), "size": ("attribute", "Map"), "parse(text, reviver)": ("method", "JSON"), "PI": ("const", "Math"), "Map(iterable)": ("constructor", "Map"),
        "ToInt32(argument)": ("abstract-op", ""), "decodeURI(u)": ("method", "globalThis"), "HasBinding(N)": ("abstract-op", "Global Environment Records"), "Day": ("abstract-op", ""), "Generator": ("dfn", "Contexts"), "IfStatement": ("grammar", ""), "thing": ("dfn", "ECMAScript"), "@@iterator": ("const", ""), "%Math%": ("namespace", ""), "realm|realms": ("dfn", "ECMAScript"), "old": ("dfn", ""),
    }
    assert {k: (v[1], v[3]) for k, v in got.items()} == want
    assert got["Promise"][4] == "private" and got["thing"][0] == "sec-w" and got["IfStatement"][4] == "private"
    ids = page(body, shortname="ecmascript").headings_by_id
    assert ids["https://a.example/x/#sec-map-objects"] == {"id": "sec-map-objects", "href": "https://a.example/x/#sec-map-objects", "title": "Map Objects", "number": "24.1"}


def test_many_definitions_take_linear_time():
    import time

    html = "".join(f"<section id=s{i}><h2 id=h{i}>{i} Head</h2><p>A <dfn id=d{i}>term {i}</dfn> is <span data-defines='#d{i}'>a <b class=x>thing</b> <a href='#h'>x</a><img src=x></span></p></section>" for i in range(2000))
    began = time.time()
    got = m.dfns(page(html))
    assert len(got) == 2000 and time.time() - began < 5 and got[7]["htmlProse"] == 'a <b>thing</b> <a href="https://a.example/x/#h">x</a>'


def test_dates_of_documents():
    assert m.last_modified(page("<p>", last_modified="Fri, 02 Dec 2022 19:48:49 GMT")) == "2 December 2022" == m.last_modified(page("", last_modified="2022-12-02T01:00:00Z"))
    assert m.last_modified(page("")) is None and m.last_modified(page("", last_modified="soon")) is None


def test_value_grammar():
    key = lambda name: {"type": "keyword", "name": name}
    assert parse_value("a b | c") == {"oneOf": [{"type": "array", "items": [key("a"), key("b")]}, key("c")]}
    assert parse_value("a || b | c && d") == {"allOf": [{"anyOf": [key("a"), {"oneOf": [key("b"), key("c")]}]}, key("d")]}
    assert parse_value("<integer [1,∞]>#{2,4}") == {"separator": ",", "type": "array", "items": {"type": "primitive", "name": "integer", "range": ["1", "∞"]}, "minItems": 2, "maxItems": 4}
    assert parse_value("[ a || b ]? && f( <x> )") == {"allOf": [{"type": "array", "items": {"anyOf": [key("a"), key("b")]}, "maxItems": 1}, {"type": "function", "name": "f", "arguments": [{"type": "valuespace", "name": "x"}]}]}
    assert parse_value("a |b")["oneOf"] == [key("a"), key("b")] and parse_value("<'width'>+") == {"type": "array", "items": {"type": "propertyref", "name": "width"}, "minItems": 1}
    assert parse_value("<x>? / '+' , y*") == {"type": "array", "items": [{"type": "valuespace", "name": "x", "optional": True}, {"type": "string", "content": "/"}, {"type": "string", "content": "+"}, {"type": "string", "content": ","}, {"type": "array", "items": key("y")}]}
    for bad in ("", "a |", "[ a", "f( a", "a ]", "a!", "a{x}", "3a"):
        with pytest.raises(GrammarError):
            parse_value(bad)


IDL = """
[Exposed=(Window,Worker), Global=Window] interface A : B { constructor(optional C c = {}); readonly attribute FrozenArray<D> d; const long X = 1; undefined f(DOMString s, E... es); undefined f(); iterable<F, (G or sequence<H>)>; static Promise<undefined> s(); stringifier; };
partial dictionary P { required Q q; unsigned long long n = 5; };
A includes M; interface mixin M { attribute any z; }; enum En { "x", "y" }; callback Cb = R (S s); typedef (T or DOMString)? U; namespace N {}; [Exposed=*] interface Z { getter any (unsigned long i); };
"""


def test_interface_definitions():
    r = idl_report(IDL)
    assert set(r.idl_names) == {"A", "M", "En", "Cb", "U", "N", "Z"} and set(r.extended) == {"P", "A"}
    assert r.external == ["B", "C", "D", "E", "F", "G", "H", "P", "Q", "R", "S", "T"] and r.dependencies["A"][-1] == "M"
    assert r.globals == {"Window": ["A"]} and r.constructors == {"Window": ["A"], "Worker": ["A"]} and r.functions == {"*": ["Z"]}
    a = parse_idl(IDL)[0]["members"]
    assert member_names(a[3], 0)[0] == "f!overload-0(s, es)" and "f(s, ...es)" in member_names(a[3], 0)
    assert idl_report("interface A { attribute B[] x; };").has_obsolete
    for bad in ("interface {", "interface A { long };", "nonsense", "enum A {"):
        with pytest.raises(IdlError):
            idl_report(bad)


def test_tables(spark):
    rows = [("https://a.example/", "a", None, "<title>T</title><h1 id=x>H</h1><pre class=idl>interface I {};</pre>"), ("https://b.example/", "b", "B", None)]
    got = extract(spark.createDataFrame(rows, "url string, shortname string, title string, html string"), None, {"n": lambda p: len(p.html)})
    assert [(r["title"], r["error"], r["n"]) for r in got.orderBy("url").collect()] == [("T", None, str(len(rows[0][3]))), ("B", None, "0")]
    assert items(got, "headings").select("shortname", "title", "level").collect() == [("a", "H", 1)]
    assert json.loads(idl_reports(got.where("idl <> ''")).first()["report"])["idl_names"]["I"]["type"] == "interface"
    boom = extract(spark.createDataFrame(rows[:1], "url string, shortname string, title string, html string"), ["title"], {"bad": lambda p: 1 / 0}).first()
    assert boom["error"].startswith("ZeroDivisionError") and boom["title"] is None
    assert select_modules(["title", "core"])[0] == "title" and select_modules(["extractDfns", "src/x/get-lastmodified-date.mjs", "css"]) == ["dfns", "date", "css"]
    with pytest.raises(ValueError):
        select_modules(["nope"])
