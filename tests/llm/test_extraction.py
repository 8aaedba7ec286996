import pyarrow as pa
import pytest

from fleetlens.llm import extraction as x
from fleetlens.llm.htmlblocks import blocks

SF_DIR = "/root/testdata/sf0.001"


def texts(page):
    return [t for t, _, _ in blocks(page)]


@pytest.mark.parametrize("page,want", [
    ("<p>One  &amp;\n two<p>Three<br>four</p>tail", ["One & two", "Three four", "tail"]),
    ("<ul><li>a<li>b <b>c</b></ul>", ["a", "b c"]),
    ("<style>p{}</style><script>var t='</p>';</script><!-- <p>no</p> --><div>yes</div>", ["yes"]),
    ("<p title='a>b'>x</p><p title=\"q>y</p>", ["x", "y"]),
    ("text &lt;b&gt; &eacute;&#8212;&#x41;", ["text <b> é—A"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<p>a</p><script>never closed <p>b</p>", ["a"]),
    ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
    ("", []), ("<>< p", ["<>< p"]), ("a < b", ["a < b"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    (a, path, linked), (b, other, _) = blocks('<main class="Content wide"><p><a href=x>link</a> text</p></main><footer id=f1>end</footer>')
    assert (a, linked) == ("link text", 4) and path[0] == ("main", "main.content", ".content", "main.wide", ".wide") and path[1] == ("p",)
    assert b == "end" and other == (("footer", "footer.f", ".f"),)


def test_deep_and_long_pages_are_read_whole():
    page = "<div>" * 3000 + "<p>deep</p>" + "<p>more</p>" * 3000
    assert len(blocks(page)) == 3001


def test_gradients_of_the_labeller():
    import numpy as np

    rng, net = np.random.default_rng(0), x.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = [rng.normal(size=(n, x.PATH_DIM + x.WORD_DIM + x.SHAPE_DIM)) for n in (4, 2)]
    data, mask = x.padded(pages)
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        s = np.clip(net.scores(data, mask), 1e-7, 1 - 1e-7)
        return -(mask * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / mask.sum()

    grads = net.gradients(data, mask, y)
    for name in ("xf", "hb", "cf", "o", "hf", "xb"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-3
        up = loss()
        net.p[name][at] = before - 1e-3
        assert np.isclose((up - loss()) / 2e-3, grads[name][at], rtol=0.05), name
        net.p[name][at] = before


@pytest.fixture(scope="module")
def labeller(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("html").collect()]
    return x.Labeller().train(x.training_pages(pages))


def test_main_text_without_the_rest(labeller):
    page = """<html><head><title>T</title></head><body><header><div>Site name</div><nav><a href=x>Home</a> <a href=y>About</a></nav></header>
    <div class="cookie-notice">We use cookies.</div><main><article><h1>The title &amp; more</h1>
    <p>First   paragraph of the story, which is long enough to say something.<p>Second one with <b>bold</b> text, and a little more of it.
    <blockquote><p>Quoted words stand here, for good measure.</p></blockquote></article>
    <section class="comments"><div class="comment"><p>I disagree with this, it is all wrong.</p></div></section></main>
    <aside class="sidebar"><ul><li>One</li></ul></aside><form><p>Email</p><button>Go</button></form><footer>&copy; 2020 all</footer></body></html>"""
    batch = pa.RecordBatch.from_pydict({"html": [page, None, "", "<nav><ul><li>menu</li></ul></nav>"]})
    got = next(iter(x.extractor(labeller, [])([batch]))).column("text").to_pylist()
    assert got[0].startswith("The title & more\n\nFirst paragraph of the story, which is long enough to say something.\n\nSecond one with bold text")
    assert not any(w in got[0] for w in ("Site name", "Home", "cookies", "disagree", "Email", "2020"))
    assert got[1:] == ["", "", ""]


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (900, "u", ""), (900, "u", "")], pages.schema)
    got = {(r.page_id, r.text) for r in x.main_text(pages.unionByName(odd)).collect()}
    want = {(r.page_id, "\n\n".join(t for t, p, _ in blocks(r.html) if not x.marked(p))) for r in pages.collect()}
    assert len(got & want) >= 0.98 * len(want)
    assert {(None, ""), (900, "")} <= got
    assert x.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<p>Energy <math>E = mc</math> holds</p>", ["Energy E = mc holds"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b</p><p>c</p>", ["a x=12 b", "c"]),
    ('<p>see <svg width="3"/> here <svg><g><text>label</text></g></svg> ok</p><div>next</div>', ["see here label ok", "next"]),
    ('<p>x <object data="f">fallback <b>text</b></object> y</p>', ["x fallback text y"]),
    ("<p>v <video><source src=x>no video</video> <canvas>no canvas</canvas> w</p>", ["v no video no canvas w"]),
    ("<noscript>No scripts here</noscript><p>z</p>", ["No scripts here", "z"]),
    ("<p>a <math><mi>q b</p><p>c</p></math><div>d</div>", ["a q b", "c", "d"]),
    ("<div><svg><g><text>open</div><p>rest", ["open", "rest"]),
    ("<svg><title>t</title><style>p{}</style><g/><text>kept</text></svg><script>var a='<p>x</p>'</script><p>k</p>", ["kept", "k"]),
])
def test_formulas_and_media_stay_in_their_block(page, want):
    assert texts(page) == want
