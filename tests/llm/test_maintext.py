"""Main text of pages: markup cases, alignment and nearest pages against plain versions."""

import html
import random
import re
import time

import pytest

from limnos.llm import maintext
from limnos.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, html string, text string, host string, path string, gone int, lines string"
SF = "/root/testdata/sf0.001"


def found(spark, rows, parts=None):
    pages = spark.createDataFrame([(*r, "x", "y", "z", 1, "w") for r in rows], SCHEMA)
    pages = pages.repartition(parts) if parts else pages
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in maintext.main_text(pages).collect()), key=repr)


def text(page):
    lines = maintext.page_lines(page)
    best = max((k for _, k in lines if k != maintext.BOILERPLATE), default=None)
    return "\n\n".join(t for t, k in lines if k == best)


CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<p>a<b>b</b>c<br>d</p>", "abc d"),
    ("<div>x &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &nbsp; y &am &amp</div>", "x <b> &amp; ééé y &am &"),
    ("<title>t</title><body>x</body>", "x"), ("<head><title>t</title><meta charset=x><p>x", "x"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><script>unclosed <p>y", "x"),
    ("<!-- <p>no</p> --><p>x</p><!-- open <p>y", "x"), ("<p title='a>b' class=\"c>d\">x</p>", "x"), ("<p title=\"open>x</p><p>y</p>", "x\n\ny"),
    ("a < b <3 c", "a < b <3 c"), ("<p>x</p", "x"), ("<P>X</P><ARTICLE><P>Y</P></ARTICLE>", "Y"),
    ("<nav>m</nav><header>h</header><main><p>x</p><aside>s</aside></main><footer>f</footer>", "x"),
    ("<main><p>intro</p><article><h1>t</h1><p>x</p></article></main>", "t\n\nx"),
    ("<article><header><h1>t</h1><p>by me</p></header><p>x</p><footer>f</footer><form>g</form><div class='share-bar'>s</div></article>", "t\n\nx"),
    ("<article><p>x</p></article><section id=comments><article><p>first!</p></article></section>", "x"),
    ("<div class='has-sidebar'><article>x</article><div class=sidebar>s</div></div>", "x"),
    ("<body class='sidebar menu'><div class=cookie-notice>c</div><div class='ad'>a</div><div class=adverb>x</div></body>", "x"),
    ("<form id=aspnet><article>x</article><input value=v></form>", "x"), ("<div hidden>h</div><div style='display: none'>n</div><div aria-hidden=true>a</div>x", "x"),
    ("<div role=navigation>n</div><div role=main>x</div>", "x"), ("<article>one</article><p>between</p><article>two</article>", "one\n\ntwo"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><th>f</table>", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
    ("<ul class=menu><li>m</ul><dl><dt>a<dd>b</dl>", "a\n\nb"), ("<article><p>x <span class=ad>buy</span> y</p></article>", "x\n\ny"),
    ("<article><p>a</p><noscript>n</noscript><textarea>t <p>u</textarea><select><option>o</select><button>b</button><p>z</p></article>", "a\n\nz"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_markup(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", ["<" * 200_000, "<a " * 100_000, "<p x=\"" * 100_000, "<a b='>" * 100_000, "<!--" * 100_000, "<b>" * 100_000 + "<li>x</li>" * 20_000,
                                  "&" * 300_000, "<textarea>" * 50_000, "<div><p>" * 50_000, "<p>word " * 200_000])
def test_odd_long_pages_take_linear_time(page):
    start = time.time()
    maintext.page_lines(page)
    assert time.time() - start < 20


def plain_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(n))] for n in (45, 70))
        places = maintext.common_lines(a, b)
        rest = iter(b)
        assert len(places) == plain_length(a, b) and places == sorted(set(places)) and all(a[i] in rest for i in places)


def test_many_repeated_lines():
    rng = random.Random(2)
    a, b = ([rng.choice("ab") if rng.random() < 0.5 else rng.randrange(9000) for _ in range(12_000)] for _ in range(2))
    places = maintext.common_lines(a, b)
    rest = iter(b)
    assert len(places) > 3_000 and all(a[i] in rest for i in places)


def site(rng, hosts, pages):
    """Pages without declared articles: template lines, own lines, quotes and copies."""
    rows = []
    for h in range(hosts):
        top, bottom = [f"menu {h} {i}" for i in range(4)], [f"imprint {h}"]
        for p in range(pages):
            own = [f"own line {h} {p} {i} {rng.random()}" for i in range(rng.randrange(1, 6))]
            page = "".join(f"<div>{x}</div>" for x in [*top, *own, *bottom])
            rows.append((len(rows), f"https://Host{h}.example.com/{rng.choice('abc')}/{rng.randrange(500)}?q=1", page))
    return rows


def wanted(rows):
    """Plain version of pairing and deletion, for pages whose markup says nothing."""
    parsed = []
    for page_id, url, page in rows:
        lines = [t for t, _ in maintext.page_lines(page)]
        m = re.match(r"[a-z]+://([^/?#]+)([^?#]*)", (url or "").lower())
        parsed.append((page_id, url, m and m[1], m and re.match(r"[A-Za-z]+://[^/?#]+([^?#]*)", url)[1], lines))
    out = []
    hashed = {t: maintext.xxhash.xxh3_64_intdigest(t.encode()) for *_, lines in parsed for t in lines}

    def signature(lines):
        import numpy as np
        packed = np.array([hashed[t] for t in lines], np.uint64).tobytes() + bytes(len(lines))
        return tuple(np.array([maintext.xxhash.xxh3_64_intdigest(packed), maintext.xxhash.xxh64_intdigest(packed, 5)], np.uint64).view(np.int64).tolist())

    for page_id, url, host, _, lines in parsed:
        kept = lines
        if host:
            pages = {}
            for _, _, h, path, other in parsed:
                if h == host:
                    key = signature(other)
                    pages[key] = (min(path, pages[key][0]) if key in pages else path, other)
            order = sorted((path, key) for key, (path, _) in pages.items())
            at = next(i for i, (_, key) in enumerate(order) if key == signature(lines))
            near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            common = lambda p: next((i for i, (x, y) in enumerate(zip(p, order[at][0], strict=False)) if x != y), min(len(p), len(order[at][0])))  # noqa: E731, B023
            for path, key in sorted(near, key=lambda n: -common(n[0])):
                gone = set(maintext.common_lines(lines, pages[key][1]))
                left = [t for i, t in enumerate(lines) if i not in gone]
                if gone and 10 * sum(map(len, left)) >= sum(map(len, lines)):
                    kept = left
                    break
        body = "\n\n".join(kept)
        out.append((page_id, url, body, len(body)))
    return sorted(out, key=repr)


def test_differencing_matches_plain_version(spark):
    rows = site(random.Random(5), 6, 25)
    rows += [(900 + i, f"http://host1.example.com/a/{i}", rows[3][2]) for i in range(30)] + [(990, None, rows[0][2]), (991, "no url", rows[0][2]), (992, "http://host2.example.com", "")]
    rows += [rows[10]] * 5 + [(995, "http://alone.example.org/x", "<p>alone</p>"), (996, "http://host1.example.com/a/7", "")]
    want = wanted(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, 11) == want
    clean = [r for r in want if r[0] < 150]
    assert sum("menu" in r[2] for r in clean) == 0 and all("own line" in r[2] for r in clean)


def test_copies_and_declared_articles_stay(spark):
    body = "".join(f"<p>Sentence {i} of the only article.</p>" for i in range(12))
    rows = [(i, f"http://a.org/{i}", f"<div>menu</div><div>{body}</div>") for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i}", f"<div>menu</div><article>{body}<p>{i}</p></article>") for i in range(10)]
    rows += [(200 + i, f"http://c.org/{i}", f"<div>menu</div>{body}<p>nearly the same {i}</p>") for i in range(10)]
    want = "\n\n".join(f"Sentence {i} of the only article." for i in range(12))
    by_id = {r[0]: r[2] for r in found(spark, rows)}
    assert all(by_id[i] == "menu\n\n" + want for i in range(40))
    assert all(by_id[100 + i] == f"{want}\n\n{i}" for i in range(10))
    assert all(by_id[200 + i] == f"menu\n\n{want}\n\nnearly the same {i}" for i in range(10))


def test_empty_table(spark):
    assert found(spark, []) == []


def test_query(spark):
    """Every page of the test tables holds one article of headings and paragraphs."""
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    result = QUERIES["op11_main_text"](spark, SF).collect()
    assert len(result) == len(rows)
    for r in result:
        body = re.search(r"(?s)<article>(.*?)</article>", rows[r.page_id].html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, want, len(want))
