"""HTML extraction, URL filters and WARC archives."""

import gzip
import hashlib
import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from palimpsest.llm import extract, urlfilter, warc

ARTICLE = "<h1>T&amp;t</h1><p>a <b>b</b>c&nbsp;d<br>e<p>x<ul><li>1<li>2</ul>"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><header>H</header><nav>menu</nav><main><article>{ARTICLE}</article></main><aside>s</aside><footer>f</footer>", "T&t a bc d e x 1 2"),
        ("<article><p>one</p><div class='ad-box'>buy</div><form>f</form><div id=comments><p>c</p></div><script>var t='</p>';</script><p>two</p></article>", "one two"),
        ("plain &lt;b> <3 text &unknown; &#233;", "plain <b> <3 text &unknown; é"),
        ("<div class='cookie-notice'>x</div><div role=navigation>y</div><p hidden>z</p><div class='content with-sidebar'>kept</div>", "kept"),
        ("<p>unclosed <b attr='a>b'>x", "unclosed x"),
        ("<article><p>a</p></article><p>outside</p><article>b</article>", "a b"),
        ("", ""),
        (None, ""),
        ("<style>p{}</style><!-- c --><title>t</title>", ""),
    ],
)
def test_main_text(spark, html, text):
    row = extract.extract(spark.createDataFrame([(1, "http://a.example/x", html, 0)], "page_id long, url string, html string, host int")).first()
    assert (row["text"], row["n_chars"]) == (text, len(text))


def test_templates(spark):
    """A box that recurs over a host's pages goes; copies of one page do not make its text a template."""
    page = lambda k: f"<div><div>Read our best stories</div><p>Story number {k} is here.</p></div>"
    rows = [(k, "http://one.example/", page(k)) for k in range(8)] + [(k, "http://two.example/", page(99)) for k in range(10, 20)] + [(30, None, page(5))]
    found = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story number 3 is here." and found[12] == found[19] == "Read our best stories Story number 99 is here." and found[30].startswith("Read our")


class Tree(HTMLParser):
    """The subtrees of a well-formed page by the standard library's parser, as nested tuples."""

    def __init__(self, page):
        super().__init__()
        self.open, self.all = [["page"]], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open.append([tag])

    def handle_endtag(self, tag):
        done = tuple(self.open.pop())
        self.open[-1].append(done)
        self.all.append(done)

    def handle_data(self, data):
        self.open[-1].append(data)


def site(rnd, host, pages):
    """(url, html, article text, recurring boxes) of a host whose boxes no rule knows."""
    menu = "<section><ul>" + "".join(f"<li>m{rnd.randrange(99)}</li>" for _ in range(4)) + "</ul></section>"
    box = f"<div><p>Word of {host}</p><p>Write to us</p></div>"
    for k in range(pages):
        paras = [f"Story {host} {k} {j} {rnd.random()}" for j in range(rnd.randint(1, 4))]
        body = [f"<p>{p}</p>" for p in paras]
        body.insert(rnd.randint(0, len(body)), box)
        yield f"http://{host}/{k}", f"<html><body>{menu}<div>{''.join(body)}</div></body></html>", " ".join(paras)


def test_counts_per_host(spark):
    """Against subtrees counted by the standard library's parser."""
    rnd, pages = random.Random(7), []
    for host, many in (("a.example", 12), ("b.example", 6), ("c.example", 4)):
        pages += site(rnd, host, many)
    count, size = Counter(), Counter(u.split("/")[2] for u, _, _ in pages)
    for url, html, _ in pages:
        count.update((url.split("/")[2], t) for t in set(Tree(html).all))
    rows = [(k, u, h) for k, (u, h, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r for r in extract.extract(df).collect()}
    off = {r["page_id"]: r["text"] for r in extract.extract(df, min_pages=1000).collect()}
    for k, (url, html, text) in enumerate(pages):
        host = url.split("/")[2]
        often = [t for t in Tree(html).all if count[host, t] >= 5 and 2 * count[host, t] >= size[host]]
        assert found[k]["n_templates"] == len(often)
        assert (found[k]["text"] == text) == (size[host] >= 5) and off[k] != text and (found[k]["text"] == off[k]) == (size[host] < 5)


def test_templates_of_real_hosts(spark):
    """Menus that a host repeats are found by counting, before any rule sees them."""
    rows = extract.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert rows.agg({"n_templates": "sum"}).first()[0] > 0


def test_hard_pages(spark):
    """Deep nesting, long texts, repeated rows and null ids."""
    deep, long = "<div>" * 20_000 + "deep", "<p>" + "word " * 400_000
    rows = [(1, "u", deep), (2, "u", long), (None, "u", "<p>x"), (3, "u", "<p>y"), (3, "u", "<p>y"), (4, "u", "<b class='ad'>no</b>yes<b>!</b>"), (5, "u", "a<span class=ad>no<div>no</span>b"), (6, "u", "<head><meta x><body>text")]
    found = [(r["page_id"], r["text"]) for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(found, key=str) == sorted([(1, "deep"), (2, ("word " * 400_000).strip()), (None, "x"), (3, "y"), (3, "y"), (4, "yes!"), (5, "ab"), (6, "text")], key=str)


def test_extract_empty(spark):
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


URLS = ["http://A.Example.NET/en/1?x", "http://net/", "http://example.net/en", "https://www.example.com/de/x#t", "http://example.com/dex/", "http://a.org/fr/", "http://a.org?x=/fr/", "no scheme", None, "x://", "http://notnet/", "http://example.net", "ftp://b.net/q://z"]
ALLOW, BLOCK = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]


def plain(url):
    """Longest rule by trying them all."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rules in (("allow", ALLOW), ("block", BLOCK)):
        for rule in rules:
            h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (h.count("."), len(p)) > best[0]):
                best = ((h.count("."), len(p)), rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("most", [100, 0])
def test_rules(spark, most):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, rule int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, ALLOW, BLOCK, max_rules=most).collect()}
    assert found == {i: plain(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge(pages.limit(0), ALLOW, BLOCK).count() == 0


def test_partial_segments():
    trie = urlfilter.Trie(["a.com/en"], ["a.com/", "a.com/en/x"])
    assert trie.match("b.a.com", "/english/") == ("a.com/en", "allow") and trie.match("a.com", "/en/xy") == ("a.com/en/x", "block")
    assert trie.match("a.com", "/de") == ("a.com/", "block") and trie.match("com", "/de") is None


def test_roundtrip(spark):
    rnd = random.Random(5)
    big = "".join(rnd.choice("abc é日\n") for _ in range(60_000))
    rows = [(1, "http://a/", big, "z"), (2, "http://b/", big, "z"), (3, None, None, "z"), (4, "http://d/\nx", "small", "z"), (5, "u", "small", "z"), (None, "u", big, "z"), (6, "u", "", "z"), (7, "u", big + "x", "z"), (7, "u", big + "x", "z")]
    found = warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string, kind string")).collect()
    assert len(found) == len(rows) and all(r["status"] == "complete" for r in found)
    top = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 1000:
            top[h] = max(i or 0, top.get(h, 0))
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if top.get(h, i) != i else "response", top[h] if top.get(h, i) != i else None) for i, _, h, _ in rows]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(([r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]] for r in found), key=key) == sorted(map(list, want), key=key)
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives(spark, tmp_path):
    """Missing and repeated segments, wrong lengths and digests are told, not raised."""
    digest = hashlib.sha1(b"x" * 5000).hexdigest()
    make = lambda name, d=digest: [r + "\n" for r in warc.records(name, "u", b"x" * 5000, d, None, 0, 1000)]
    lost, twice, wrong, fine = make(1), make(2), make(3, "0" * 40), make(4)
    length = [r.replace("Segment-Total-Length: ", "Segment-Total-Length: 1") for r in make(5)]
    every = lost[:2] + lost[3:] + twice + twice[1:2] + wrong + fine[::-1] + length
    (tmp_path / "a.gz").write_bytes(gzip.compress("".join(every).encode()))
    found = {r["page_id"]: r["status"] for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert found == {1: "missing or repeated segment", 2: "missing or repeated segment", 3: "wrong digest", 4: "complete", 5: "wrong total length"}


def test_framing():
    data = "aé日".encode() * 999
    assert warc.unframed(warc.framed(data, 64)) == data and warc.unframed(warc.framed(b"")) == b""
    assert warc.unframed(b"zz\r\n") is None and warc.unframed(b"5\r\nabc\r\n") is None


@pytest.mark.parametrize("most", [100, 0])
def test_rules_without_a_host_and_long_paths(spark, most):
    """The trie and the joins agree on entries that fit every host, on very long paths and on repeated rows."""
    long = "http://a.example.org/en/" + "x" * 20_000
    urls = ["http://b.net/en/1", "http://net/de/", long, long, "http://c.org/", "no scheme"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, ["/en/", "example.org/en/xx"], ["net/", "/"], max_rules=most).collect()}
    assert found == {0: ("net/", "block"), 1: ("net/", "block"), 2: ("example.org/en/xx", "allow"), 3: ("example.org/en/xx", "allow"), 4: ("/", "block"), 5: (None, "allow")}


def test_damaged_archives(spark, tmp_path):
    """A record cut short is told, what stands before it is read, and nothing fails."""
    whole = b"".join((r + "\n").encode() for k in range(3) for r in warc.records(k, "http://a/", b"text %d" % k, hashlib.sha1(b"text %d" % k).hexdigest(), None, k, 1 << 14))
    for name, data in (("cut", whole[:-12]), ("head", whole + b"WARC/1.1\r\nWARC-Type: resp"), ("odd", whole + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n")):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    (tmp_path / "torn.gz").write_bytes(gzip.compress(whole)[:-20])
    found = warc.read(spark, f"file://{tmp_path}").collect()
    assert sum(r["status"] == "complete" for r in found) >= 2 + 3 + 3 and sum(r["status"] == "cut short" for r in found) >= 2


def test_many_pages_of_one_payload(spark):
    """All but the last of many equal pages revisit it, wherever they are."""
    big = "payload " * 200
    rows = [(k, f"http://h{k}/", big) for k in range(300)]
    found = warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == {(k, "response" if k == 299 else "revisit", None if k == 299 else 299) for k in range(300)}
    assert all(r["payload_bytes"] == len(big) and r["status"] == "complete" for r in found)


def archived(*bodies):
    """Records of pages 0, 1, ... as bytes."""
    return [b"".join((r + "\n").encode() for r in warc.records(k, "http://a/", b, hashlib.sha1(b).hexdigest(), None, k, 1 << 20)) for k, b in enumerate(bodies)]


def test_damaged_archives_keep_their_whole_records(spark, tmp_path):
    """Members, plain files, trailing bytes, holes: every record that is whole is read, and each gap is told."""
    rnd = random.Random(5)
    five = archived(*(bytes(rnd.choice(b"abcdefgh \n") for _ in range(3000)) for _ in range(5)))
    packed = [gzip.compress(r) for r in five]
    hole = bytearray(packed[2])
    hole[len(hole) // 2 : len(hole) // 2 + 40] = b"\x00" * 40
    cases = {
        "whole": (packed, [0, 1, 2, 3, 4], 0), "cut": ([*packed[:4], packed[4][:-6]], [0, 1, 2, 3], 1), "hole": ([*packed[:2], bytes(hole), *packed[3:]], [0, 1, 3, 4], 1),
        "trailing": ([*packed, b"\x00" * 100], [0, 1, 2, 3, 4], 1), "plain": (five, [0, 1, 2, 3, 4], 0), "plain_hole": ([five[0], b"junk\r\n\r\n", *five[1:]], [0, 1, 2, 3, 4], 1),
        "one_member": ([gzip.compress(b"".join(five))], [0, 1, 2, 3, 4], 0), "nothing": ([b""], [], 0), "no_archive": ([b"\x1f\x8b\x08nothing"], [], 1),
    }
    for name, (parts, pages, gaps) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(b"".join(parts))
        rows = warc.read(spark, f"file://{tmp_path / name}").collect()
        # the last record of a cut member has all its bytes but the checksum, or is told as cut short
        good = sorted(r["page_id"] for r in rows if r["status"] == "complete")
        assert [p for p in good if p in pages] == pages and len(good) <= len(pages) + (name == "cut"), name
        assert sum(r["status"] == "damaged" for r in rows) == gaps, name


def test_large_archives_are_refused_with_a_status(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MAX_ARCHIVE", 1000)
    (tmp_path / "small.warc").write_bytes(archived(b"x" * 10)[0])
    (tmp_path / "large.warc").write_bytes(archived(b"y" * 5000)[0])
    assert sorted(r["status"] for r in warc.read(spark, f"file://{tmp_path}").collect()) == ["complete", "too large"]


@pytest.mark.parametrize("name", "share-holders legal-news search-results header-image comment-on-policy social-history notice-of-award menu-engineering has-sidebar".split())
def test_names_that_only_begin_like_junk(name):
    blocks, kinds, _ = extract.parse(f"<article><p>one</p><div class='{name}'><p>two</p></div><section id={name}>three</section></article>")
    assert extract.main_blocks(blocks, kinds) == ["one", "two", "three"]


@pytest.mark.parametrize("name", "ad-box ad-300x250 comment-list comments_area comment-thread share-buttons site-footer main-nav nav-links sidebar-left related-posts cookie-notice-text user-comments page-header newsletter-signup widget-2 post-share".split())
def test_names_of_junk(name):
    blocks, kinds, _ = extract.parse(f"<article><p>one</p><div class='{name}'><p>two</p></div><section id={name}>three</section></article>")
    assert extract.main_blocks(blocks, kinds) == ["one"]


def test_a_page_in_a_form(spark):
    page = "<body><form action=/><div class=menu>m</div><div><h1>head</h1><p>text</p><input><select><option>o</select></div></form></body>"
    rows = extract.extract(spark.createDataFrame([(1, "http://a/", page), (2, "http://a/", "<form><label>x</label></form><p>text</p>")], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {1: "head text", 2: "text"}
