import random
import re
import xml.etree.ElementTree as ET

import pytest

from loreforge.llm import main_text as M

LONG = "Some words of the first paragraph, and more of them. They go on, as sentences do; then they end."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a &amp; b &lt;c&gt;&nbsp;d<br>e  f</p>", "a & b <c> d e f"),
        ("<nav><a href=x>Home</a></nav>", ""),
        (f"<article><h1>T</h1><p><b>{LONG}<br><p>x.</article><footer>f</footer>", f"T\n\n{LONG}\n\nx."),
        (f"<body><header>Site</header><main><header><h1>T</h1></header><p>{LONG}</p><form>q <input></form><aside>s</aside></main>", f"T\n\n{LONG}"),
        (f'<div class="page-with-sidebar"><div id=content><h2>T</h2><p>{LONG}<p>{LONG}</div><div class="sidebar"><p>{LONG}</div></div>', f"T\n\n{LONG}\n\n{LONG}"),
        (f'<article><p>{LONG}</p><section id="comments"><article class="comment"><p>{LONG}</p></article></section></article>', LONG),
        (f'<script>var t="</p><p>no";</script><style>p{{}}</style><!-- <p>no --><article><p>{LONG}</article>', LONG),
        (f'<article><ul><li>one<li>two</ul><div class="ad">buy</div><div class=cookie-notice>ok?</div><p>{LONG}', f"one\n\ntwo\n\n{LONG}"),
        (f"<div><p>{LONG}</p><p>1 < 2 and <3</p></div>", f"{LONG}\n\n1 < 2 and <3"),
        (f"<article><p>{LONG}</p><p>unfinished <a href='x", f"{LONG}\n\nunfinished"),
        (f"<table><tr><td>{LONG}<td>b<tr><td>c</table>", f"{LONG}\n\nb\n\nc"),
    ],
)
def test_pages(page, text):
    assert M.main_text(page) == text


def test_sample_pages(spark, sf):
    got = {r.page_id: r for r in M.op8_path_ratios(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = [" ".join(M.html.unescape(re.sub(r"<br>|<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li|div)>", inner)]
        r = got[p.page_id]
        assert r.text == "\n\n".join(filter(None, want))
        assert (r.url, r.n_chars) == (p.url, len(r.text))


def test_long_and_broken_pages():
    assert M.main_text("< " * 20000 + "x").endswith("< x")
    assert M.main_text("<div>" * 5000 + LONG) == LONG
    assert M.main_text("<p>" + "a " * 100000).startswith("a a")
    assert M.main_text("<a b='" * 2000 + "x") == ""


def test_no_pages(spark, no_documents):
    assert M.extract(no_documents, ["doc_id"], "text").collect() == []


# ---- the ratios


def made_page(rng, marked):
    """A well-formed page of neutral class names: a menu, short boxes, and an article within a box."""
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 9)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(n)) + "."
    box = lambda i: f'<div class="k{i}">{prose(1)[:40]}</div>'
    body = [f"<h2>{word()} {word()}</h2>"]
    for _ in range(rng.randint(3, 9)):
        body.append(rng.choice([f"<p>{prose(rng.randint(2, 6))}</p>", f"<h3>{word()}</h3><p>{prose(4)}</p>", f"<p><a>{word()}</a> {prose(3)}</p>"]))
    menu = "".join(f"<li><a>{word()}</a></li>" for _ in range(rng.randint(3, 8)))
    tag = "article" if marked else "section"
    return f'<html><body><nav><ul>{menu}</ul></nav><div class="m"><ul>{menu}</ul></div>{box(1)}<div class="w"><{tag}>{"".join(body)}</{tag}></div>{box(2)}</body></html>', re.findall(r"<(?:p|h2|h3)>(.*?)</", re.sub("</?a>", "", "".join(body)))


def brute(page):
    """(text, score) of every block, each ratio summed anew over all blocks of the page."""
    blocks = []

    def walk(e, chain, owner):
        chain = (*chain, (e.tag, e.get("class", "")))
        text = " ".join("".join(e.itertext()).split()) if all(c.tag == "a" for c in e) else ""
        if text:
            blocks.append((chain, text, sum(len(a.text) for a in e), owner))
            return
        for c in e:
            walk(c, chain, e)

    walk(ET.fromstring(page), (), None)
    out_of = lambda chain: any(t == "nav" for t, _ in chain)
    inside = lambda chain: any(t == "article" for t, _ in chain)

    def own(prefix):
        on = [b for b in blocks if b[0][: len(prefix)] == prefix and not out_of(b[0])]
        return (sum(len(t) - k for _, t, k, _ in on) / len(on), sum(len(re.findall("[.,;:!?]", t)) for _, t, _, _ in on) / len(on)) if on else (0, 0)

    def ratios(prefix):
        mine, up = own(prefix), prefix[:-1]
        if up and up[-1][0] not in ("html", "body"):
            mine = tuple((x + 0.7 * y) / 1.7 for x, y in zip(mine, ratios(up), strict=True))
        if inside(prefix):
            article = prefix[: [t for t, _ in prefix].index("article") + 1]
            mine = tuple(map(max, mine, own(article)))
        return mine

    value = [ratios(b[0]) for b in blocks]
    for i in reversed(range(len(blocks) - 1)):
        if blocks[i][0][-1][0] in ("h2", "h3"):
            value[i] = tuple(map(max, value[i], value[i + 1]))
    fused = []
    for i, b in enumerate(blocks):
        near = [value[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j][3] is b[3]]
        length, marks = ((x + 0.25 * sum(n[k] for n in near)) / (1 + 0.25 * len(near)) for k, x in enumerate(value[i]))
        fused.append((0 if out_of(b[0]) else 4 if inside(b[0]) else 1) * (length * (1 + marks)) ** 0.5)
    paths = {b[0] for b in blocks}
    mean = {p: sum(f for f, b in zip(fused, blocks, strict=True) if b[0] == p) / sum(b[0] == p for b in blocks) for p in paths}
    return [(b[1], mean[b[0]]) for b in blocks]


@pytest.mark.parametrize("marked", [True, False])
def test_scores_equal_brute_force(marked):
    rng = random.Random(11)
    whole = 0
    for _ in range(60):
        page, article = made_page(rng, marked)
        want = brute(page)
        read = M.Reader(page)
        M._settle(read.elements)
        got = M.path_scores(read.elements, read.blocks)
        assert [b.text for b in read.blocks] == [t for t, _ in want] and got == pytest.approx([s for _, s in want])
        shown = [(t, s) for t, s in want if s > 0]
        cut = M.SHARE * sum(len(t) * s for t, s in shown) / sum(len(t) for t, _ in shown)
        assert M.main_text(page) == "\n\n".join(t for t, s in shown if s >= cut)
        whole += M.main_text(page) == "\n\n".join(article)
    assert whole >= (60 if marked else 50)


@pytest.mark.parametrize("other", [lambda s: 1.0, lambda s: 1 / (1 + s)])
def test_scores_select_the_text(monkeypatch, other):
    """With constant or inverted scores nearly every page gives another text."""
    rng = random.Random(12)
    pages = [made_page(rng, i % 2 == 0)[0] for i in range(40)]
    before, scores = [M.main_text(p) for p in pages], M.path_scores
    monkeypatch.setattr(M, "path_scores", lambda e, b: [other(s) for s in scores(e, b)])
    assert sum(M.main_text(p) != t for p, t in zip(pages, before, strict=True)) >= 38


def test_clashing_columns_and_repeated_rows(spark):
    page = f"<article><p>{LONG}</article>"
    df = spark.createDataFrame([(1, page, "a", 5, "k"), (1, page, "a", 5, "k"), (None, None, None, None, None)], "page_id bigint, html string, text string, n_chars int, k0 string")
    got = M.extract(df, ["page_id", "k0"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "k", LONG, len(LONG))] * 2 + [(None, None, "", 0)], key=str)
