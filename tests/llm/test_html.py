"""HTML extraction on small pages with known main text."""

import random
import time

from ctxloom.llm import html_extract as h

BODY = "The quick story is about a fox and the dog that it met in the wood on the way to town, and of what they did."


def test_boilerplate_goes_and_text_stays():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>no</p>";</script></head><body>
    <header><a href="/">Home</a> Site</header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies and other things on this site to do what we want with it, please accept it all now.</div>
    <article><h1>A &amp; B&nbsp;&#x41;</h1><p>{BODY}<br>line  two\n\t three<p>Short one.</p><ul><li>item</li></ul>
    <div class="advert">Buy this</div><aside>Related things</aside><form>Name <input></form>
    <blockquote>“Quoted” &lt;b&gt;</blockquote><section id="comments"><p>{BODY}</p></section></article>
    <div id="sidebar"><p>{BODY}</p></div><footer>&copy; 2020</footer></body></html>"""
    assert h.main_text(page) == f"A & B A {BODY} line two three Short one. item “Quoted” <b>"


def test_pages_without_a_marked_region():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Short head</h2><p>{BODY}</p><p>Tail.</p></div><div><a href=3>Next page of many</a></div>"
    assert h.main_text(page) == f"Short head {BODY} Tail."


def test_second_pass_takes_the_nearest_label():
    found = h.blocks(f"<div><p>{BODY}</p><p>near good</p></div><div><p><a href=1>link link link link link link link link link</a></p><p>near bad</p></div>")
    assert [b["label"] for b in found][:2] == ["good", "good"] and found[2]["label"] == "bad"


def test_broken_and_odd_pages(spark):
    pages = [None, "", "   ", "plain text only", "<p>open", "<article><p>a<p>b", "<article>x</article></div></div>", "<!-- never closed <p>x", "<article><p>a &lt;p&gt; &#0; &unknown; &#128512;</article>", "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "<article><p>" + "word " * 100000 + "</article>"]
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)] + [(None, "u", pages[5])], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars", "2 as block")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert len(got) == len(pages) + 1
    assert [got[i].text for i in range(8)] == ["", "", "", "plain text only", "open", "a b", "x", ""]
    assert got[8].text.startswith("a <p>") and got[8].text.endswith("&unknown; 😀") and got[9].text == "deep" and got[10].n_chars == 499999
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[None].text == "a b"
    assert h.extract_blocks(df).where("page_id = 5").count() == 2
    assert h.extract(df.limit(0)).count() == 0


LINKS = "<ul><li><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></li></ul>"


def test_stop_words_decide_inside_a_marked_region():
    prose, none = "the fox and the dog of a town met " * 5, "qx vuz brel " * 14
    page = lambda block: f"<article><p>{BODY}</p>{LINKS}<p>{block}</p>{LINKS}</article>"
    assert h.main_text(page(prose)).endswith("of a town met") and "qx" not in h.main_text(page(none))
    found = h.blocks(page(none))
    assert [b["label"] for b in found] == ["good", "bad", "bad", "bad"] and h._first_pass(found[2]) == ""
    assert "qx" in h.main_text(f"<article><p>{BODY}</p><p>{none}</p></article>")  # inherits from the prose beside it
    assert "qx" in h.main_text(f"<article><p>{none}</p></article>")


def test_names_say_so_as_a_whole():
    page = lambda name: f'<article><p>{BODY}</p><div class="{name}"><p>Tail of it.</p></div></article>'
    for name in ("legal-history", "form-of-address", "alert-systems", "related_work", "searchEngines", "commentary", "bannerman story"):
        assert h.main_text(page(name)) == f"{BODY} Tail of it.", name
    for name in ("related-posts", "cookie-notice", "advert", "ad-300x250", "x commentList", "newsletter_signup", "social share"):
        assert h.main_text(page(name)) == BODY, name


def test_no_markup_in_texts():
    assert h.main_text("<article><p title=\"it's>bad</p><p>good</p></article>") == "bad good"
    assert h.main_text("<article><p title=it's>bad</p><a href='x>y'>z</a></article>") == "bad z"
    assert h.main_text('<article><p data-x="<b>q</b>">in</p><p title="a > b" id=c>out</article>') == "in out"
    assert h.main_text("<article><p>1 < 2 and <3</p><p>x<a href=\"http://") == "1 < 2 and <3 x"
    assert h.main_text("<article><p>a &#" + "9" * 5000 + "; b") == "a � b"


def test_large_malformed_pages_take_time_in_proportion():
    n = 1_000_000
    pages = ['<p title="it\'s>bad</p>' * (n // 22), "<button>x" * (n // 9), "<" * n, "<a b" * (n // 4), "<a" * (n // 2), "<article><p>x</p>" + "</a" * (n // 3), "<span>" * (n // 12) + "<hr>" * (n // 8), "<div>" * (n // 12) + "</p></ul>" * (n // 12), "<button></button" * (n // 16), "<!--" * (n // 4), "<a x='" * (n // 6)]
    for page in pages:
        began = time.process_time()
        assert "<p" not in h.main_text(page) and time.process_time() - began < 6, page[:20]


def test_passes_equal_brute_force():
    rng = random.Random(3)
    kinds = [lambda: BODY, lambda: "qx vuz " * rng.randrange(1, 30), lambda: "of a town " * rng.randrange(1, 5), lambda: "<a href=1>go on</a> <a href=2>here</a>", lambda: "<a href=1>alone</a>", lambda: "x"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            wrap = rng.choice(["<div>{}</div>", "<article>{}</article>", "<div class=advert>{}</div>", "<nav>{}</nav>", "{}"])
            parts.append(wrap.format("".join(f"<{t}>{rng.choice(kinds)()}</{t}>" for t in (rng.choice(["p", "h2", "div"]) for _ in range(rng.randrange(1, 6))))))
        out = h.blocks("".join(parts))
        marked, first = any(b["main"] and not b["bad"] for b in out), []
        for b in out:
            if b["bad"] or (marked and not b["main"]):
                first.append("bad")
            elif b["links"] > 0.4:
                first.append("" if b["main"] and b["n_links"] == 1 else "bad")
            elif b["words"] >= 25:
                first.append("good" if b["stops"] >= 0.12 else "")
            else:
                first.append("good" if b["words"] >= 8 and b["stops"] >= 0.25 else "")
        for i, b in enumerate(out):
            label = first[i]
            if not label:
                decided = [j for j in range(len(out)) if first[j]]
                near = [j for j in decided if out[j]["region"] == b["region"]] or ([] if b["main"] else decided)
                gap = min((abs(j - i) for j in near), default=0)
                ends = sorted(j for j in near if abs(j - i) == gap)
                label = "good" if not ends or b["main"] and any(first[j] == "good" for j in ends) else first[ends[-1 if b["heading"] else 0]]
            assert b["label"] == label, ("".join(parts), i)
