import pytest
from pyspark.sql import functions as F

from gossamer.operators import custom_fields as cf
from gossamer.operators import extract, forms
from gossamer.operators.extract import Flags, markup_links

PAGE = "https://maze.example/html/body/xyz/"
ONE = [
    ("<a href=/a>", ("/a", "a", "href")),
    ("<a ping=/p>", ("/p", "a", "ping")),
    ('<body background="/bg"></body>', ("/bg", "body", "background")),
    ('<blockquote cite="/c"></blockquote>', ("/c", "blockquote", "cite")),
    ('<map><area ping="/ap" href="#"></map>', ("/ap", "area", "ping")),
    ('<audio src="/s"></audio>', ("/s", "audio", "src")),
    ('<audio controls><source src="/ss"></audio>', ("/ss", "audio", "source")),
    ('<img dynsrc="/d">', ("/d", "img", "dynsrc")),
    ('<img alt="" src="#" longdesc="/l">', ("/l", "img", "longdesc")),
    ('<img lowsrc="/lo">', ("/lo", "img", "lowsrc")),
    ('<img src="/i">', ("/i", "img", "src")),
    ('<object data="/od"></object>', ("/od", "src", "data")),
    ('<object codebase="/oc"></object>', ("/oc", "src", "codebase")),
    ('<object><param name="ref" value="/pv"></param></object>', ("/pv", "src", "param-value")),
    ('<svg><image xlink:href="/x"/></svg>', ("/x", "svg", "image-href")),
    ('<svg><script xlink:href="/xs"></script></svg>', ("/xs", "svg", "script-href")),
    ('<table background="/tb"></table>', ("/tb", "table", "background")),
    ('<table><tr><td background="/td"></td></tr></table>', ("/td", "table", "td-background")),
    ('<video src="/v"></video>', ("/v", "video", "src")),
    ('<video poster="/vp"></video>', ("/vp", "video", "poster")),
    ('<video><track src="/vt"></video>', ("/vt", "video", "track-src")),
    ('<applet archive="/ar"></applet>', ("/ar", "applet", "archive")),
    ('<applet codebase="/cb"></applet>', ("/cb", "applet", "codebase")),
    ('<link href="/li">', ("/li", "link", "href")),
    ('<base href="/ba">', ("/ba", "base", "href")),
    ('<html manifest="/m"></html>', ("/m", "html", "manifest")),
    ('<!DOCTYPE html SYSTEM "/dt"><p>', ("/dt", "html", "doctype")),
    ('<import implementation="/im">', ("/im", "import", "implementation")),
    ('<embed src="/e">', ("/e", "embed", "src")),
    ('<frameset><frame src="/f"></frameset>', ("/f", "frame", "src")),
    ('<iframe src="/if"></iframe>', ("/if", "iframe", "src")),
    ('<iframe srcdoc="<a href=\'/if/doc.html\'>"></iframe>', ("/if/doc.html", "iframe", "srcdoc")),
    ('<input type="IMAGE" src="/in">', ("/in", "input-image", "src")),
    ('<isindex action="/is">', ("/is", "isindex", "action")),
    ('<script src="/sc"></script>', ("/sc", "script", "src")),
    ('<button formaction="/fa"></button>', ("/fa", "button", "formaction")),
    ('<meta http-equiv="refresh" content="3; url= /meta/page.html ">', ("/meta/page.html", "meta", "refresh")),
]


@pytest.mark.parametrize("html,want", ONE)
def test_one_link(html, want):
    assert want in [x[:3] for x in markup_links(html)]


def test_srcsets_and_data_images():
    assert [x[0] for x in markup_links('<img srcset="/1.found 1x, /2.found 2x">')] == ["/1.found", "/2.found"]
    assert markup_links('<img src="data:x" srcset="/1 1x">') == []
    assert [x[:3] for x in markup_links('<audio><source srcset="/1 1x, /2 2x"></audio>')] == [("/1", "audio", "sourcesrcset"), ("/2", "audio", "sourcesrcset")]


def test_htmx_gives_one_link_per_attribute():
    got = markup_links('<button hx-get="/g" hx-post="/p" hx-delete="/no"></button><div hx-put="/u" hx-patch="/a">')
    assert [(x[0], x[2], x[3]) for x in got] == [("/g", "hx-get", "GET"), ("/p", "hx-post", "POST"), ("/u", "hx-put", "PUT"), ("/a", "hx-patch", "PATCH")]


def test_comments_scripts_and_broken_markup_hold_no_links():
    assert markup_links('<!-- <a href="/no"> --><script>var t="<a href=\'/no\'>";</script><style><a href=/no></style><a href="/yes">') == [("/yes", "a", "href", "GET", None)]
    assert markup_links("<a href='/x") == [] and markup_links("< a href=/x>") == [] and markup_links("") == []
    assert [x[0] for x in markup_links("<a href=/1><a\nhref=/2 /><A HREF='/3&amp;x'>")] == ["/1", "/2", "/3&x"]


def test_script_text_only_when_asked():
    html = "<script>var e='/test/content.do';</script>"
    assert markup_links(html) == []
    assert markup_links(html, Flags(scripts=True)) == [("/test/content.do", "script", "text", "GET", None)]


def test_page_links(spark):
    headers = {"Content-Location": "/cl", "Link": '</li>; rel="x"', "Location": "http://other.example/lo", "Refresh": "9; url=/re"}
    pages = spark.createDataFrame([(PAGE, headers, '<a href="/x"><a href="#f">'), ("https://maze.example/app.js", None, "var e='/test/body.do';"), (PAGE + "n", None, None), (None, None, "<a href=/q>")], "url string, headers map<string,string>, body string")
    got = {(r.source, r.url, r.tag, r.attribute) for r in extract.page_links(pages, Flags(scripts=True)).collect()}
    want = {
        (PAGE, "https://maze.example/cl", "header", "content-location"),
        (PAGE, "https://maze.example/li", "header", "link"),
        (PAGE, "http://other.example/lo", "header", "location"),
        (PAGE, "https://maze.example/re", "header", "refresh"),
        (PAGE, "https://maze.example/x", "a", "href"),
        (PAGE, "", "a", "href"),
        ("https://maze.example/app.js", "https://maze.example/test/body.do", "js", "regex"),
        ("https://maze.example/app.js", "https://maze.example/test/body.do", "html", "regex"),
    }
    assert got == want
    assert not extract.page_links(pages, Flags(redirects=False)).filter("attribute = 'location'").count()


def test_user_extractor(spark):
    pages = spark.createDataFrame([(PAGE, "go:/x")], "url string, body string")
    assert [r.url for r in extract.user_links(pages, lambda u, b: [(b[3:], "go", "x")]).collect()] == ["https://maze.example/x"]


FORMS = """<html><body><form method="POST" action="/test"><input type="text" name="firstname"><textarea name=textarea1></textarea><select name=select1></select><input type=text /></form>
<form method=post action=https://abs.example.com></form><form action=//prel.example.com></form><form action=\\\\unc.example.com></form><form action=/root_rel></form><form action=rel_path></form><form></form></body></html>"""


def test_form_shapes():
    got = [forms.shape(f, "https://example.com/path") for f in forms.parse(FORMS)]
    assert [g["action"] for g in got] == ["https://example.com/test", "https://abs.example.com", "//prel.example.com", "\\\\unc.example.com", "https://example.com/root_rel", "https://example.com/path/rel_path", "https://example.com/path"]
    assert [g["method"] for g in got] == ["POST", "POST", "GET", "GET", "GET", "GET", "GET"]
    assert got[0]["parameters"] == ["firstname", "textarea1", "select1"] and got[0]["enctype"] == forms.URLENCODED and got[2]["enctype"] == ""


FILL = """<form action="/"><input type="text" name="first"><input type="Password" name="pw"><input type="radio" name="color" value="red"><input type="radio" name="color" value="green">
<input type="checkbox" name="sport" value="tennis"><input type="color" name="up" value="#a52a2a"><input type="number" name="num" min="50" max="80"><input type="tel" name="tel"><input type="email" name="mail">
<select name="food"><option value="pizza"><option value="pasta" selected></select><select name="land"><option value="in"><option value="us"></select><textarea name="msg">x</textarea><input type="submit" value="go"></form>"""


def test_form_fill():
    f = forms.FormFill(password="pass", placeholder="here", email="m@x.example")
    got = forms.suggestions(forms.parse(FILL)[0], f)
    assert got == {"first": "here", "pw": "here", "color": "green", "sport": "tennis", "up": "#a52a2a", "num": "51", "tel": "pass", "mail": "m@x.example", "food": "pasta", "land": "in", "msg": "here"}


def test_filled_forms():
    get = forms.filled_forms('<form action="/g"><input name=a value=1><input name=b value=2></form>', PAGE)
    assert get == [("https://maze.example/g?a=1&b=2", "form", "action", "GET", None)]
    post = forms.filled_forms('<form action="/p" method=post enctype="multipart/form-data"><input name=a value=1></form>', PAGE)
    assert post[0][:4] == ("https://maze.example/p", "form", "action", "POST") and 'name="a"' in post[0][4]


def test_page_forms(spark):
    df = spark.createDataFrame([("https://example.com/path", FORMS), ("u", None)], "url string, body string")
    got = {r.url: r.forms for r in forms.page_forms(df).collect()}
    assert len(got["https://example.com/path"]) == 7 and got["u"] == []


def test_custom_fields(spark):
    pages = spark.createDataFrame([("u", {"Server": "ECS (dcb/7F84)"}, "write to a@b.example or a@b.example"), ("v", None, None)], "url string, headers map<string,string>, body string")
    own = (cf.CustomField("email", (cf.tx.EMAIL,), "body"), cf.CustomField("server", ("server: ECS",), "header"), cf.CustomField("any", ("ECS",)))
    got = {r.url: r.custom_fields for r in cf.evaluate(pages, own).collect()}
    assert got == {"u": {"email": ["a@b.example", "a@b.example"], "server": ["server: ECS"], "any": ["ECS"]}, "v": {}}
    for bad in (cf.CustomField("a b", ("x",)), cf.CustomField("url", ("x",)), cf.CustomField("x", ("x",), "nowhere")):
        with pytest.raises(ValueError):
            cf.validate((bad,))
    with pytest.raises(Exception):
        cf.validate((cf.CustomField("x", ("(",)),))
