import random
from collections import defaultdict

from geolattice.llm import html_extract as H

PAGES = "page_id long, url string, html string, host string, block int, text string"


def brute(rows, width):
    """Words of each page that lie in no string of `width` words found on two pages of its host."""
    seen = defaultdict(set)
    for key, host, text in rows:
        w = text.split()
        for i in range(len(w) - width + 1):
            seen[(host, *w[i : i + width])].add(key)
    out = []
    for _, host, text in rows:
        w = text.split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if len(seen[(host, *w[i : i + width])]) > 1:
                gone[i : i + width] = [True] * width
        out.append(" ".join(x for x, g in zip(w, gone) if not g))
    return out


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1, "clash") for i, u, h in rows], PAGES)


def corpus(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 14))) for _ in range(4)]
    out = []
    for k in range(40):
        body = " ".join(rng.choice([rng.choice(shared), " ".join(rng.choice("ijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 5)))
        out.append((k, f"http://{rng.choice(['a.org', 'A.org', 'b.net'])}/p/{k}", f"<p>{body}</p>"))
    return out


def expected(rows, width):
    key = [(i, "a.org" if "a.org" in u.lower() else "b.net", H.plain(h)) for i, u, h in rows]
    return dict(zip((r[0] for r in rows), brute(key, width)))


def test_same_as_brute_force(spark):
    rows = corpus(1)
    got = {r["page_id"]: r["text"] for r in H.unique_text(pages(spark, rows), 4).collect()}
    assert got == expected(rows, 4)


def test_blocks_of_a_large_host_give_the_same(spark):
    rows = corpus(2)
    whole = {r["page_id"]: (r["text"], r["n_kept"]) for r in H.unique_text(pages(spark, rows), 4).collect()}
    split = {r["page_id"]: (r["text"], r["n_kept"]) for r in H.unique_text(pages(spark, rows), 4, block_chars=500).collect()}
    assert split == whole and {k: v[0] for k, v in whole.items()} == expected(rows, 4)


def test_packed_fingerprints():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        for top in (1 << 8, 1 << 40, (1 << 64) - 1):
            x = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (H.unpacked(H.packed(x)) == x).all()


def test_markup():
    page = '<html><head><title>T</title><script>var t="</p>";x(0);</script></head><!-- ad --><body><p>a <b>b</b>c &amp; d<br>e<div title="x>y">f</div><style>p{}</style>g</body>'
    assert H.plain(page) == "a bc & d e f g"
    assert H.plain("<p>never closed <script> gone") == "never closed"
    assert H.plain("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_elements_that_hide_their_text():
    assert H.plain('<p>one <svg class="i"/> two three</p><p>rest</p>') == "one two three rest"
    assert H.plain('<p>one <svg a=">"><path d="m1"/><text>no</text></svg> two</p>') == "one two"
    assert H.plain("<title-card>hello</title-card> x <scripted>y</scripted>") == "hello x y"
    for name in ("svg", "iframe", "title", "noscript", "template", "textarea"):
        assert H.plain(f"a <{name} w=1> b <p>c</p>") == "a b c"
        assert H.plain(f"a <{name} w=1> b <p>c</p></{name.upper()} > d<{name}>e") == "a d e"
    for name in ("script", "STYLE"):
        assert H.plain(f"a <{name}>b") == "a" and H.plain(f"a<{name} src='x'>b</{name.lower()}>c") == "a c"
    assert H.plain("a<!-- <p>b --> c <!-- d") == "a c" and H.plain('a <script type="x>b</script> c') == "a c"
    many = "<svg>" * 20_000 + "<iframe>" * 20_000 + "end"
    assert H.plain(many) == "end"  # in linear time


def test_odd_rows(spark):
    long = "<p>" + " ".join(str(k) for k in range(200_000)) + "</p>"
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://a.org/", "<p>w x y z</p>"), (3, "http://a.org/", "<p>w x y z</p>"), (None, "http://a.org/x", "<i></i>"), (4, "http://c.org/", long), (5, "http://a.org/2", "<p>w x y z q</p>")]
    got = sorted((str(r["page_id"]), r["host"], r["text"][:20], r["n_kept"]) for r in H.unique_text(pages(spark, rows), 3).collect())
    assert got == [("1", "", "", 0), ("2", "", "", 0), ("3", "a.org", "", 0), ("3", "a.org", "", 0), ("4", "c.org", "0 1 2 3 4 5 6 7 8 9 ", 200_000), ("5", "a.org", "q", 1), ("None", "a.org", "", 0)]


def test_repeated_rows_are_one_page(spark):
    rows = [(3, "http://a.org/", "<p>w x y z</p>")] * 2
    assert [r["text"] for r in H.unique_text(pages(spark, rows), 3).collect()] == ["w x y z"] * 2


def test_empty_table(spark):
    assert H.unique_text(pages(spark, []), 3).count() == 0


def test_streams_shorter_than_the_width():
    import numpy as np

    for n in range(1, 12):
        assert H.windows(np.arange(n, dtype=np.int32)[::-1].copy(), 10).tolist() == list(range(n))[::-1]
