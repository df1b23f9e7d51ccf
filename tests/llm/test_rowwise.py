"""Operators that work row by row: BPE, license scans, URL filters, HTML extraction, quality, decontamination."""

import hashlib
import os
import random
import struct
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontaminate, html_extract, license_scan, quality, token_counts, url_filter
from tidemark.llm.words import shingles, word_hashes

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\t", "<|endoftext|>", "a<|endoftext|><|startoftext|> b", "ΑΣ ΣΑΣ.", "İstanbul", "don't 'RE", "\x1c\x1d a\x00b", "漢字かな", "é x", "ab" * 3000]
DOCS = "doc_id long, text string, n_tokens string, id string, label string"


@pytest.fixture(scope="module")
def word():
    with open(WORD, encoding="utf-8") as f:
        return bpe.WordBpe(f.read()), Tokenizer.from_file(WORD)


def docs(spark, texts, repeat=1):
    return spark.createDataFrame([(i, t, "clash", "clash", None) for i, t in enumerate(texts) for _ in range(repeat)], DOCS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcABC 's\n.,<|>")), max_size=60))
def test_words_encode_as_the_library(word, text):
    own, library = word
    ids = library.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert struct.pack(f"<{len(ids)}I", *ids) == packed
    assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_the_tree_finds_the_least_key_after_updates():
    rng = random.Random(4)
    keys = [rng.randrange(1000) << 32 | i for i in range(1000)]
    tree = bpe.PairTree(list(keys))
    for _ in range(3000):
        i = rng.randrange(1000)
        keys[i] = rng.choice([bpe.NONE, rng.randrange(1000) << 32 | i])
        tree.update(i, keys[i])
        assert tree.root() == min(keys)


def test_one_node_and_many_merge_alike(word):
    own = word[0].bpe
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("aeiouthnsr") for _ in range(rng.randint(2, bpe.FAN))).encode()
        ids = own.merge(text)
        fan, bpe.FAN = bpe.FAN, 2
        try:
            assert own.merge(text) == ids
        finally:
            bpe.FAN = fan


def test_encode_decode_rows(spark, word):
    texts = [*ODD, *ODD]
    out = bpe.encode_decode(docs(spark, texts, 2), WORD).collect()
    assert len(out) == 2 * len(texts)
    for r in out:
        ids = word[1].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and r["decoded"] == word[1].decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs(spark, []), WORD).count() == 0


def test_token_counts_rows(spark):
    library = Tokenizer.from_file(BYTE)
    texts = [*ODD, "the " * 9000, "ontheofing zzqx " * 40]
    out = token_counts.token_counts(docs(spark, texts, 3), BYTE).collect()
    assert len(out) == 3 * len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert token_counts.token_counts(docs(spark, []), BYTE).count() == 0


def test_url_rules(spark):
    from tidemark.llm.queries import URL_RULES

    urls = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no-scheme.net/x": ("", "", None, "allow"),
        "http://A.NET/x?y#z": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "https://m.Example.net/en/1": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "https://m.example.net/EN/1": ("m.example.net", "/EN/1", "net/", "block"),
        "https://www.example.com/de/?q": ("www.example.com", "/de/", "example.com/de/", "block"),
        "https://www.example.com/de": ("www.example.com", "/de", None, "allow"),
        "ftp://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://É.org?/fr/": ("É.org", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash", "clash", 1) for i, u in enumerate(urls) for _ in range(2)], "page_id long, url string, host string, rule string, hits int")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for blocks in (1, 64):
        out = url_filter.filter_urls(pages, rules, blocks=blocks).collect()
        assert sorted(map(tuple, out)) == sorted((i, *v) for i, v in enumerate(urls.values()) for _ in range(2)) or sorted(map(str, out)) == sorted(str(type(out[0])(*[i, *v])) for i, v in enumerate(urls.values()) for _ in range(2))
    nothing = url_filter.filter_urls(pages, rules.limit(0)).collect()
    assert len(nothing) == 2 * len(urls) and all(r["rule"] is None and r["verdict"] == "allow" for r in nothing)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    rules = sorted({(".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 2)))): rng.choice(["allow", "block"]) for _ in range(12)}.items())
    pages = [(i, f"http://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice('xy') for _ in range(rng.randint(0, 3)))}") for i in range(400)]

    def judge(url):
        host, _, path = url[7:].partition("/")
        fit = [(len(h + p), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return (max(fit)[1:]) if fit else (None, "allow")

    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")).collect()
    lengths = {i: [len(h + p) for (h, p), _ in rules if (u[7:].partition("/")[0] == h or u[7:].partition("/")[0].endswith("." + h)) and ("/" + u[7:].partition("/")[2]).startswith(p)] for i, u in pages}
    for r in out:
        rule, verdict = judge(pages[r["page_id"]][1])
        if lengths[r["page_id"]].count(max(lengths[r["page_id"]], default=0)) <= 1:
            assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_url_rules_of_any_length(spark):
    long = "/" + "a" * 30
    rules = [("a.b", long[:n], v) for n, v in ((2, "block"), (8, "allow"), (9, "block"), (20, "allow"), (31, "block"))]
    pages = [(n, f"http://x.a.b{long[:n]}?q") for n in (1, 2, 8, 15, 20, 31, 31)] + [(99, "http://a.b" + long[:10] + "b" * 30)]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), max_path=8).collect()
    found = sorted((r["page_id"], len(r["rule"] or ""), r["verdict"]) for r in out)
    assert found == [(1, 0, "allow"), (2, 5, "block"), (8, 11, "allow"), (15, 12, "block"), (20, 23, "allow"), (31, 34, "block"), (31, 34, "block"), (99, 12, "block")]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<footer>&copy; x</footer></body></html>"


LONG = "Some words of the main text, long enough to count. " * 3


def test_html_cases():
    plain = f"<article><h1>A &amp; B</h1><p><b>One\n  two.<br><p>{LONG}</p></article>"
    extracted = html_extract.Page(page(plain)).extracted([])
    assert extracted == f"A & B\nOne two.\n{LONG.strip()}"
    noisy = f"""<div class="cookie-notice"><p>We use cookies {LONG}</p></div><div id=main-content class='post post-12'><h1>T</h1><p>{LONG}</p><script>var a = "</p>";</script>
    <form><p>Subscribe now {LONG}</p></form><div class="AdBanner"><p>Buy {LONG}</p></div><p>Second {LONG}<img src="x>y"></p><ul><li>point</ul></div>
    <div class=sidebar><p>{LONG}{LONG}{LONG}</div><section class=comments><p>{LONG}{LONG}</section>"""
    assert html_extract.Page(page(noisy)).extracted([]) == f"T\n{LONG.strip()}\nSecond {LONG.strip()}\npoint"
    inside = f"""<div class="page layout--with-sidebar"><div class="post"><div class="post-header"><h1>T</h1></div><p>{LONG}<span class="advert">Buy <span>it</span> now</span>More.</p><p>End <em hidden>secret</p>
    <p>Last <a href="/x" class="share">Share</a>word.</p><cookie-notice>We use cookies</cookie-notice><pre>x = 1 <span class="comment"># one</span></pre><video controls>No video</video></div></div>"""
    assert html_extract.Page(page(inside)).extracted([]) == f"T\n{LONG}More.\nEnd\nLast word.\nx = 1 # one"
    for odd in (None, "", "<", "<p", "<b class=ad>", "text only", "<!-- open", "<script>x", "</div></p>", "<p>a<p>b</i></p>"):
        html_extract.Page(odd).extracted(["html>body"])
    assert html_extract.Page("text only").extracted([]) == "text only"
    assert html_extract.Page("<p>a<p>b</i></p>").extracted([]) == "a\nb"
    assert html_extract.Page("<div>" * 3000 + "deep").extracted([]) == "deep"


def test_html_whole_articles():
    many, body = LONG.strip(), f"<p>{LONG}</p>" * 14
    text = "\n".join([many] * 14)
    for start, end in (("<div class=post>", "</div>"), ("<article>", "</article>")):
        for inner in ("<div class=body>", "<div><div>"):
            html = page(f"<div id=root>{start}<h1>Title of it</h1>{inner}{body}</div></div>{end}</div><div class=extra><p>{LONG}</p></div>")
            assert html_extract.Page(html).extracted([]) == f"Title of it\n{text}"
    html = page(f"<div id=root><div class=one>{f'<p>{LONG}</p>' * 8}</div><ul><li><a href='/x'>Other page of this site</a></li></ul><div class=two>{f'<p>{LONG}</p>' * 2}</div></div>")
    assert html_extract.Page(html).extracted([]) == "\n".join([many] * 10)
    html = page(f"<table><tr><td><h1>Title of it</h1></td></tr><tr><td><div>{body}</div></td></tr></table>")
    assert html_extract.Page(html).extracted([]) == f"Title of it\n{text}"


def test_html_wrapped_in_noise():
    text = f"Title\n{LONG.strip()}"
    body = f"<h1>Title</h1><p>{LONG}</p>"
    wraps = [("<form id=aspnetForm><input name=q><select><option>One</select>", "<button>Go</button></form>"), ("<div class='widget Blog'>", "</div>"), ("<form><div class=widgets><div class='elementor-widget-container'>", "</div></div></form>")]
    wraps += [("<div class='sponsored page'>", "</div>"), ("<div class='sponsored post'>", "</div><div>Other</div>"), ("<main><form>", "</form></main>"), ("<promo-page>", "</promo-page>")]
    for start, end in wraps:
        for inner in (body, f"<div class=post>{body}</div>"):
            assert html_extract.Page(page(start + inner + end)).extracted([]) == text, start
    parts = "".join(f"<div class=elementor-widget>{x}</div>" for x in ("<h1>Title</h1>", f"<p>{LONG}</p>", f"<p>{LONG}</p>"))
    for start in ("<div>", "<div class=post><p></p>"):
        assert html_extract.Page(page(f"{start}{parts}</div>")).extracted([]) == f"{text}\n{LONG.strip()}"
    assert html_extract.Page(page(f"<div class=post><header><h1>Title</h1></header><p>{LONG}</p></div>")).extracted([]) == text
    # What is longer than the text stays out where it is not around it.
    for noise in (f"<form><p>Subscribe {LONG * 3}</p></form>", f"<div class=widget><p>{LONG * 3}</p></div>", f"<div class=comments><p>{LONG * 3}</p></div>", f"<div class='post-comments'><p>{LONG * 3}</p></div>"):
        assert html_extract.Page(page(f"<article>{body}</article>{noise}")).extracted([]) == text
        assert html_extract.Page(page(f"<div class=post>{body}</div>{noise}")).extracted([]) == text
    assert html_extract.Page(page(f"<div class=ad>{LONG}</div>")).extracted([]) == ""


def test_html_names_that_only_look_like_noise():
    text = f"Title\n{LONG.strip()}"
    for start, end in (("<article class='post category-advertising'>", "</article>"), ("<div class='post tag-social'>", "</div>"), ("<div class='tag-social category-ads'>", "</div>"), ("<article class='advertising'>", "</article>"), ("<main class='search'>", "</main>"), ("<div class='promo'>", "</div>")):
        assert html_extract.Page(page(f"{start}<h1>Title</h1><p>{LONG}</p>{end}")).extracted([]) == text, start
    # Unclosed media hold nothing; closed ones are left out.
    assert html_extract.Page(page(f"<article><h1>Title</h1><video src=x><p>{LONG}</p></article>")).extracted([]) == text
    assert html_extract.Page(page(f"<article><h1>Title</h1><svg><svg><text>a</text></svg><text>b</text></svg><video>No video</video><p>{LONG}</p></article>")).extracted([]) == text
    assert html_extract.Page(page(f"<div class=post><h1>Title</h1><div class=entry><p>{LONG}</p></div></div>")).extracted([]) == text
    # More comments than text stay out, also as articles.
    comments = f"<div id=comments>{f'<article class=comment><p>{LONG}</p></article>' * 9}</div>"
    assert html_extract.Page(page(f"<article><h1>Title</h1><p>{LONG}</p></article>{comments}")).extracted([]) == text
    assert html_extract.Page(page(f"<main><h1>Title</h1><p>{LONG}</p>{comments}</main>")).extracted([]) == text


def test_html_of_usual_systems():
    text, more = LONG.strip(), f"<p>{LONG * 4}</p>"
    blog = f"""<html><body class="post-template single has-sidebar"><div id="page"><a class="skip-link" href="#c">Skip</a><header id="masthead" class="site-header"><p>My blog</p><nav>Home</nav></header>
    <div class="content-area"><main class="site-main"><article class="post-1 post type-post hentry category-news tag-social"><header class="entry-header"><h1 class="entry-title">Title</h1></header><div class="entry-content"><p>{LONG}</p>
    <div class="sharedaddy sd-sharing-enabled"><h3>Share this</h3></div><div id="jp-relatedposts" class="jp-relatedposts">Related</div></div><footer>Filed</footer></article><nav class="post-navigation">Next</nav>
    <div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body">{more}</article></li></ol><div class="comment-respond"><form>Reply</form></div></div></main></div>
    <aside class="widget-area"><section class="widget">{more}</section></aside></div><footer class="site-footer">Powered</footer></body></html>"""
    assert html_extract.Page(blog).extracted([]) == f"Title\n{text}"
    widgets = f'<div class="content"><div class="main section"><div class="widget Blog"><div class="hfeed"><div class="post hentry"><h3 class="post-title">Title</h3><div class="post-body">{LONG}<br><br>end</div></div></div><div class="comments">{more}</div></div></div><div class="sidebar"><div class="widget">{more}</div></div></div>'
    assert html_extract.Page(page(widgets)).extracted([]) == f"Title\n{text} end"
    app = f'<div id="app"><div class="layout-header">Menu</div><div class="article-page"><div class="article-page__header"><h1>Title</h1></div><div class="article-page__body"><p>{LONG}</p><div class="ad-slot">Ad</div></div></div><div class="newsletter-signup"><p>{LONG}</p></div></div>'
    assert html_extract.Page(page(app)).extracted([]) == f"Title\n{text}"


HOSTILE = {
    "deep": "<div>", "classes": "<div class='a b-1'>", "quotes": '<a "', "values": '<a b="', "declarations": "<!", "ends": "</", "stray": "<", "open tags": "<a ", "comments": "<!-- ", "svg": "<svg><svg></svg>", "videos": "<video>",
    "noise": "<span class=ad>", "in noise": "<span class=ad><p>x", "spans": "<div class=ad><span>", "forms": "<form><p>x", "lists": "<ul><li>a", "links": "<a href=x>b", "tables": "<table><tr><td>", "references": "&amp", "names": "<a" + "b" * 50, "equals": "= ", "attributes": "<a b='c\" ", "scripts": "<script>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_takes_time_in_proportion(name):
    for tail in ("", ">", "<p>end</p>"):
        html = HOSTILE[name] * (1_000_000 // len(HOSTILE[name])) + tail
        began = time.process_time()
        found = html_extract.Page(html)
        found.extracted([found.best()[0] or "p"])
        assert time.process_time() - began < 6, tail


def test_html_deep_pages_take_little_memory():
    tracemalloc.start()
    assert html_extract.Page("<div class=x>" * 100_000 + "deep").extracted([]) == "deep"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000


def test_host_votes_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        host = rng.choice(["a.com", "b.com", "c.com", *[f"h{j}.com" for j in range(60)]])
        kind = rng.choice(["story", "story", "other", f"rare{i}"])
        rows.append((i, f"http://{host}/{i}", page(f"<div class={kind}><p>{LONG * rng.randint(1, 2)}</p></div><div class=extra><p>{'Many more words. ' * rng.randint(0, 25)}</p></div>")))
    wanted, polls = {}, {}
    for _, url, html in rows:
        path, score = html_extract.Page(html).best()
        own = polls.setdefault(url.split("/")[2], {}).setdefault(path, [0, 0.0])
        own[0] += 1
        own[1] += score
    for i, url, html in rows:
        poll = polls[url.split("/")[2]]
        total = sum(n for n, _ in poll.values())
        winners = sorted((p for p, (n, _) in poll.items() if n >= 0.05 * total), key=lambda p: (-poll[p][0], -poll[p][1], p))
        wanted[i] = html_extract.Page(html).extracted(winners)
    assert any(wanted[i] != html_extract.Page(html).extracted([]) for i, _, html in rows)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == wanted
    hot, html_extract.HOT = html_extract.HOT, 0.1
    try:
        assert {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()} == wanted
    finally:
        html_extract.HOT = hot


def test_hosts_vote(spark):
    usual = f'<div class="story s-1"><p>{LONG}</p><p>{LONG}</p></div><div class="extra"><p>{LONG}</p></div>'
    odd = f'<div class="story s-9"><p>Short.</p></div><div class="extra"><p>{LONG}</p><p>{LONG}</p></div>'
    rows = [(i, f"http://a.com/{i}", page(usual)) for i in range(9)] + [(9, "http://A.com/9", page(odd)), (10, None, page(usual)), (11, "http://b.com", None), (9, "http://A.com/9", page(odd))]
    out = html_extract.extract(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, host int")).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == 13 and by[9]["text"] == "Short." and by[9]["n_chars"] == 6 and by[11]["text"] == "" and by[0]["text"] == f"{LONG.strip()}\n{LONG.strip()}"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(spark):
    lines = {
        "Released under the MIT License.": [("MIT", None, [], [])],
        "x\nLicensed under the Apache License, Version 2.0.\ny": [("Apache-2.0", "2.0", [], [])],
        "This work is licensed under the GNU General Public License, version 3.": [("GPL-3", "3", [], [])],
        "licensed under   CC BY-NC 4.0": [("CC-BY-NC-4.0", "4.0", [], [])],
        "Licensed under CC BY 4.0.": [("CC-BY-4.0", "4.0", [], [])],
        "This fine work is licensed under the GNU General Public License, version 2.": [("GPL-2", "2", [], ["fine"])],
        "The license of the driver was lost in the rain and nobody had a copy of it.": [],
    }
    out = license_scan.scan(docs(spark, [*lines, None, "", "nothing here"], 2)).collect()
    for i, wanted in enumerate(lines.values()):
        own = sorted((r["license"], r["version"], r["missing"], r["added"]) for r in out if r["doc_id"] == i)
        assert own == sorted(wanted * 2, key=str), (i, own)
    assert not [r for r in out if r["doc_id"] >= len(lines)]
    both = "\n".join([*["words"] * 3, "Released under the MIT License.", "more", "Licensed under CC BY-SA 3.0.", *["words"] * 5, "This work is licensed under the GNU General Public License, version 2."])
    found = [(r["first_line"], r["license"]) for r in license_scan.scan(docs(spark, [both])).collect()]
    assert (3, "MIT") in found and (11, "GPL-2") in found and any(x[1].startswith("CC-BY-SA") for x in found)
    assert license_scan.scan(docs(spark, [])).count() == 0


def licenses_of(text):
    scanner = license_scan.Scanner()
    return [(at[r[0]], r[2].replace("#", r[3] or ""), r[6], r[7]) for written, at in scanner.blocks(text) for r in sorted(scanner.confirmed(written), key=lambda r: r[:3])]


def test_licenses_in_lines_of_any_length():
    rng = random.Random(5)
    legal = " ".join(t[2] for t in license_scan.TEMPLATES).replace("#", "2.0").split()
    for n in (100, 1000, 20_000):
        for pool in ("river stone of the license under copyright morning is and".split(), legal):
            own = [rng.choice(pool) for _ in range(n)]
            own[n // 2 : n // 2] = "Released under the MIT License.".split()
            own[n // 4 : n // 4] = "This work is licensed under the GNU General Public License, version 3.".split()
            found = licenses_of(" ".join(own))
            assert (0, "MIT", [], []) in found and (0, "GPL-3", [], []) in found
    # A full text: license wording on most of its lines, the notice at its end.
    full = [f"{i}. The license grants {' '.join(rng.choice(legal) for _ in range(9))}" for i in range(600)]
    assert (600, "GPL-2", [], []) in licenses_of("\n".join([*full, "This work is licensed under the GNU General Public License, version 2."]))


def test_licenses_beside_each_other():
    far = "In this town nobody had a copy of the old map, and so the people of the river went on without one for many a year, until a stranger came with a box of papers that no one could read at all in those days."
    assert licenses_of(f"{far} This book is licensed under the GNU General Public License, version 3.") == [(0, "GPL-3", ["work"], ["book"])]
    gpl = "This work is licensed under a GNU General Public License, version 2."
    assert licenses_of(f"Released under the MIT License.\n{gpl}") == [(0, "MIT", [], []), (1, "GPL-2", ["the"], ["a"])]
    assert [x[1] for x in licenses_of("Licensed under CC BY 3.0.\nLicensed under CC BY 4.0. Licensed under CC BY 4.0.")] == ["CC-BY-3.0", "CC-BY-4.0", "CC-BY-4.0"]
    assert [x[:2] for x in licenses_of(f"{gpl}\n\n{gpl.replace('2', '3')}")] == [(0, "GPL-2"), (2, "GPL-3")]
    # What overlaps a better result is not one.
    assert licenses_of("This work is licensed under the GNU Affero General Public License, version 3.") == [(0, "AGPL-3", [], [])]


def test_licenses_on_wrapped_lines():
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    assert licenses_of(f"x\n{mpl}") == [(1, "MPL-2.0", [], [])]
    gpl = license_scan.TEMPLATES[6][2].replace("#", "3").replace(" it under", "\nit under").replace("published by ", "published by\n").replace("or (at", "or\n\n(at")
    assert licenses_of(f"Released under the MIT License.\n{gpl}\nx") == [(0, "MIT", [], []), (1, "GPL-3", [], [])]
    narrow = license_scan.TEMPLATES[6][2].replace("#", "3").replace(" ", "\n")
    assert licenses_of(f"x\n{narrow}\nx") == [(1, "GPL-3", [], [])]


def test_licenses_that_others_contain():
    def names(text):
        return [(x[1], x[2], x[3]) for x in licenses_of(text)]

    for terms in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        assert names(f"Licensed under CC {terms} 4.0.") == names(f"Licensed under CC {terms.replace('-', ' ')} 4.0") == [(f"CC-{terms}-4.0", [], [])]
    for wording in ("{} License, version 3.", "{} License, v. 3."):
        assert names("This work is licensed under the GNU Lesser " + wording.format("General Public"))[0][0] == "LGPL-3"
        assert names("This work is licensed under the GNU Affero " + wording.format("General Public"))[0][0] == "AGPL-3"
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert names(header.format("Affero ")) == [("AGPL-3", [], [])] and names(header.format("")) == [("GPL-3", [], [])]
    assert [x[0] for x in names(header.format("Lesser "))] in ([], ["LGPL-3"])
    assert names("Released under the Apache License.") == []  # not MIT with another name
    assert names("SPDX-License-Identifier: GPL-3.0-or-later") == [("GPL-3.0-or-later", [], [])]
    three = next(t[2] for t in license_scan.TEMPLATES if t[1] == "BSD-3-Clause")
    two = next(t[2] for t in license_scan.TEMPLATES if t[1] == "BSD-2-Clause")
    assert names(three.replace(" ", "\n")) == [("BSD-3-Clause", [], [])] and names(two) == [("BSD-2-Clause", [], [])]


def least_differences(wanted, own):
    """(missing and added words, missing words) of the best alignment, word by word; None without one."""
    from functools import lru_cache

    most = max(m for m in range(len(wanted)) if len(wanted) - m >= 0.8 * len(wanted) - 1e-9 or not m)

    @lru_cache(None)
    def rest(i, j, m):
        if i == len(wanted):
            return (0, 0)
        found = [(10**6, 0)]
        if j < len(own) and own[j] == wanted[i]:
            found.append(rest(i + 1, j + 1, m))
        if m < most and wanted[i] not in license_scan.NAMES:
            a, b = rest(i + 1, j, m + 1)
            found.append((a + 1, b + 1))
        if j < len(own) and (own[j] not in license_scan.QUALIFIERS or own[j] in wanted):
            a, b = rest(i, j + 1, m)
            found.append((a + 1, b))
        return min(found)

    return min((rest(0, j, 0) for j in range(len(own) + 1)), default=None)


def test_licenses_against_brute_force():
    rng = random.Random(12)
    templates = [t for t in license_scan.TEMPLATES if 4 < len(t[2].split()) <= 25]
    scanner = license_scan.Scanner(templates, rank=-9.0)
    filler = "river stone of the morning is under quiet and no one had a map".split()
    n = 0
    for _ in range(60):
        family, name, text = rng.choice(templates)
        own = text.replace("#", rng.choice(["2.0", "3", "4.0"])).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([["word"], [], [own[at], "extra"], [own[at], "lesser"]])
        paragraph = [rng.choice(filler) for _ in range(rng.randrange(30))] + own + [rng.choice(filler) for _ in range(rng.randrange(30))]
        wrapped = "".join(w + rng.choice([" ", " ", "\n"]) for w in paragraph)
        bare = license_scan.words(wrapped)
        every = [(least_differences(license_scan.words(t[2]), bare), t) for t in templates]
        best = min(((d[0] / len(license_scan.words(t[2])), -len(license_scan.words(t[2])) + d[1]) for d, t in every if d[0] <= 1.2 * len(license_scan.words(t[2]))), default=None)
        found = [r for w, _ in scanner.blocks(wrapped) for r in scanner.confirmed(w)]
        if best is None:
            assert not found, wrapped
            continue
        n += 1
        first = min(((len(r[6]) + len(r[7])) / round((len(license_scan.words(" ".join(w[r[0] : r[1]]))) - len(r[7])) / r[5]), -(len(license_scan.words(" ".join(w[r[0] : r[1]]))) - len(r[7]))) for w, _ in scanner.blocks(wrapped) for r in scanner.confirmed(w))
        assert first == pytest.approx(best), (wrapped, found)
    assert n > 30


def test_licenses_are_ranked_before_they_are_aligned(monkeypatch):
    """Compression chooses what is aligned: nothing below ``rank``, and the template that saves the most first."""
    asked, align = [], license_scan.aligned
    monkeypatch.setattr(license_scan, "aligned", lambda wanted, *rest: asked.append(len(wanted)) or align(wanted, *rest))
    written = "Released under the MIT License. This work is licensed under the GNU Affero General Public License, version 3.".split()
    assert list(license_scan.Scanner(rank=9.0).confirmed(written)) == [] and asked == []
    scanner = license_scan.Scanner()
    assert [r[2] for r in scanner.confirmed(written)] == ["AGPL-#", "MIT"]
    names = [t[1] for t in scanner.templates]
    both = [max((n for n, name in enumerate(names) if name == x), key=lambda n: scanner.ranked(n, written, 0, len(written))) for x in ("AGPL-#", "MIT")]
    assert asked[0] == len(max((scanner.ranked(n, written, 0, len(written)), scanner.templates[n][2]) for n in both)[1])
    # Text around a notice hides what the template saves of it; pieces of the window show it.
    far = [*"the river of stone went on its way by the mill and under seven old bridges".split()] * 60
    notice = "Licensed under CC BY-NC 4.0.".split()
    n = next(i for i, t in enumerate(license_scan.TEMPLATES) if t[2] == "Licensed under CC BY-NC #.")
    assert scanner.ranked(n, far, 0, len(far)) < scanner.rank <= scanner.ranked(n, [*far, *notice, *far], 0, 2 * len(far) + len(notice))


def test_licenses_odd_rows(spark):
    rows = spark.createDataFrame([(1, "Released under the MIT License.", "x", "y"), (None, "Released under the MIT License.", "x", "y"), (1, "Released under the MIT License.", "x", "y")], "doc_id int, text string, license string, block string")
    out = license_scan.scan(rows).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["block"]) for r in out) == [(0, "MIT", "Released under the MIT License.")] + [(1, "MIT", "Released under the MIT License.")] * 2
    long = "the license of stone " * 60_000 + "Released under the MIT License. " + "x" * 2_000_000
    assert [r["license"] for r in license_scan.scan(docs(spark, [long])).collect()] == ["MIT"]


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("water river stone field under over quiet morning".split()) for _ in range(40))
    bad = lambda: " ".join(rng.choice("WIN!! $$$ CLICK### cash*** now%%%".split()) for _ in range(40))
    rows = [(i, (bad() if i % 4 == 0 else good()), "clash", "clash", None) for i in range(400)] + [(400, None, "", "", None), (401, "", "", "", None)]
    table = spark.createDataFrame(rows, DOCS.replace("n_tokens", "score").replace("label string", "held_out string"))
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    out = {r["doc_id"]: r for r in quality.score(table, model).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [r for i, r in out.items() if r["held_out"] and i < 400]
    assert 60 < len(held) < 140 and all(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert out[400]["score"] == out[401]["score"]
    flipped = labels.withColumn("quality", (1 - labels.quality)).filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").unionByName(labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    assert np.array_equal(quality.fit(table, flipped).weight, model.weight)
    assert quality.fit(table, labels.limit(0)).score("x") == 0.5
    assert quality.keep(table, model).columns == table.columns
    assert quality.score(table.limit(0), model).count() == 0


def test_quality_on_the_held_out_fold(spark):
    from tidemark.llm.queries import op10_quality, table

    labels = table(spark, "/root/testdata/sf0.01", "labels")
    joined = op10_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in joined) / len(joined) > 0.95


def brute_containment(texts, items):
    sets = [set(shingles(t).tolist()) for t in texts]
    for i, s in enumerate(sets):
        for j, t in items:
            q = set(shingles(t).tolist())
            if q and len(q & s) / len(q) >= 0.8 - 1e-12:
                yield i, j, len(q & s), len(q)


def test_decontamination_is_exact(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(j, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 20, 40])))) for j in range(40)] + [(40, None), (41, ""), (42, "?!")]
    texts = []
    for _ in range(150):
        words = [word() for _ in range(rng.randint(0, 300))]
        for _, t in rng.sample(items[:40], 3):
            own = t.split()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = own
        texts.append(" ".join(words).upper())
    texts += [None, "", "x"]
    wanted = sorted(brute_containment(texts, items))
    table = spark.createDataFrame(items, "item_id long, text string")
    for bound in (4_000_000, 100):
        out = decontaminate.contaminated(docs(spark, texts), table, index_bound=bound)
        assert sorted(tuple(r)[:4] for r in out.collect()) == wanted and len(wanted) > 50
        clean = decontaminate.clean(docs(spark, texts, 2), table, index_bound=bound)
        assert clean.columns == docs(spark, []).columns
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i in range(len(texts)) if i not in {w[0] for w in wanted} for _ in range(2))
    assert decontaminate.contaminated(docs(spark, texts), table.limit(0)).count() == 0 and decontaminate.contaminated(docs(spark, []), table).count() == 0


def test_decontamination_finds_short_items(spark):
    items = spark.createDataFrame([(1, "Blue whale!"), (2, "one"), (3, "four words are here"), (4, "a b c d e f"), (5, ""), (6, None)], "item_id long, text string")
    far = "The answer to this long question is of course "
    texts = [far + "the blue whale, as all know.", "blue whale", far + "blue or whale", "FOUR words are here " + far, "one", "x a b c d e f y", "blue", "", None]
    wanted = [(0, 1), (1, 1), (3, 3), (4, 2), (5, 4)]
    for bound in (4_000_000, 1):
        out = decontaminate.contaminated(docs(spark, texts), items, index_bound=bound, short_items=True).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in out) == wanted and all(r["containment"] == 1 for r in out)
        clean = decontaminate.clean(docs(spark, texts), items, index_bound=bound, short_items=True)
        assert sorted(r["doc_id"] for r in clean.collect()) == [2, 6, 7, 8]


def test_word_hashes_tell_words_apart():
    rng = random.Random(6)
    data = " ".join("".join(rng.choice("abéß0") for _ in range(rng.randint(1, 6))) for _ in range(5000)).encode()
    hashes, first, last = word_hashes(data)
    words = data.split()
    assert [data[a:b] for a, b in zip(first, last, strict=True)] == words
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_decontamination_takes_any_ids_and_names(spark):
    texts = ["x " * 200_000 + "the quick brown fox jumps over the dog", "nothing of it", None]
    for kind in ("smallint", "double", "binary", "string", "date"):
        cast = "date_add(date'2020-01-01', id)" if kind == "date" else "cast(cast(id as string) as binary)" if kind == "binary" else f"cast(id as {kind})"
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr(f"{cast} AS id", "text", "1 AS doc", "2 AS item", "3 AS n_found")
        items = spark.createDataFrame([(7, "The quick brown fox jumps over the dog"), (None, "nothing else")], "id int, text string").selectExpr(f"{cast} AS id", "text", "4 AS doc_key")
        for bound in (4_000_000, 1):
            out = decontaminate.contaminated(rows, items, id_col="id", item_id="id", index_bound=bound)
            assert out.columns == ["id", "item_id", "n_found", "n_shingles", "containment"] and out.schema["item_id"].dataType.simpleString() == kind
            assert [(r["n_found"], r["containment"]) for r in out.collect()] == [(4, 1.0)]
            assert decontaminate.clean(rows, items, item_id="id", index_bound=bound).count() == 2


def test_token_counts_in_many_runs(spark, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ontheofing zzqx the of blorptang qwrtz".split()) for _ in range(rng.randint(0, 60))) for _ in range(90)]
    for name, value in (("RUN", 4), ("DISTINCT", 5), ("HELD", 40), ("TOGETHER", 1)):
        monkeypatch.setattr(token_counts, name, value)
    for table in (docs(spark, texts), docs(spark, texts).repartition(7)):
        out = token_counts.token_counts(table, BYTE).collect()
        assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]


def test_url_filter_fits_its_list(spark):
    rules = spark.createDataFrame([(f"h{i}.com", f"/p{i % 7}/", "block") for i in range(10_000)], "host string, path string, verdict string")
    keys = rules.selectExpr("concat(host, path) AS key")
    set_bits = url_filter.bloom_words(keys, "key", 4096).selectExpr("aggregate(words, 0, (s, w) -> s + bit_count(w)) AS n").first()["n"]
    assert set_bits / (64 * 4096) < 0.3
    pages = spark.createDataFrame([(1, "http://a.h9.com/p2/x"), (2, "http://h9.com/p3/x"), (None, "http://h10.com/p3/"), (3, "http://" + "a." * 8000 + "h9.com/p2/")], "page_id int, url string")
    began = time.perf_counter()
    out = sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect())
    assert out == [(0, "h10.com/p3/", "block"), (1, "h9.com/p2/", "block"), (2, None, "allow"), (3, "h9.com/p2/", "block")]
    assert time.perf_counter() - began < 30


def test_quality_n_grams_are_of_characters():
    for text in ("привет мир", "漢字かな交じり文", "abc defgh"):
        padded, n = f" {text} ", 0
        for size in quality.GRAMS:
            n += sum(not any(c in " " for c in padded[i + 1 : i + size - 1]) for i in range(len(padded) - size + 1))
        words = len(text.split())
        assert sum(map(len, quality.features(text))) == n + words + (words - 1)
    assert sum(map(len, quality.features("ab" * 1_500_000))) > 8_000_000


def test_long_texts_row_by_row(spark, word):
    long = "the river and " * 40_000 + "x" * 300_000
    table = docs(spark, [long])
    row = bpe.encode_decode(table, WORD, keep_ids=False, keep_decoded=False).first()
    assert row["n_tokens"] == len(word[1].encode(long, add_special_tokens=False).ids)
    assert token_counts.token_counts(table, BYTE).first()["n_tokens"] == len(Tokenizer.from_file(BYTE).encode(long, add_special_tokens=False).ids)
    model = quality.train(["good words here", "BAD!!! words $$$"], [1, 0])
    assert 0 <= quality.score(table, model).first()["score"] <= 1
