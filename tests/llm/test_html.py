"""Main text against a plain version on generated pages, and that every block goes through the measures."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tidemark.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"
LETTERS = "abcdefghijklmnoprstuvwxyz"
FILL = {
    "en": "the of and to a in is it that was for on are with as at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fi": "ja on ei se että oli hän mutta niin kuin ovat myös joka sen tai ole".split(),
}


class Tree(HTMLParser):
    """Blocks with the marks of all they lie in, from a tree of well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text, self.link = [], [], [], 0
        self.feed(page)
        self.cut()

    def cut(self):
        text = " ".join("".join(t for t, _ in self.text).split())
        if text:
            linked = sum(len(" ".join(t.split())) for t, x in self.text if x)
            tags = [t for t, _, _ in self.open if t in html.BLOCK]
            self.found.append({"text": text, "linked": linked, "heading": bool(tags) and tags[-1] in html.HEADINGS, "in": list(self.open)})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append((" ", False))
        elif tag in html.BLOCK:
            self.cut()
        self.open += [(tag, dict(attrs).get("class") or "", object())] if tag != "br" else []

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.cut()
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.text.append((data, any(t == "a" for t, _, _ in self.open)))


def slow_text(page):
    found = Tree(page).found
    for b in found:
        b["inside"] = b["vague"] = False
        b["part"] = b["talk"] = None
        for tag, name, node in b["in"]:
            article = tag in ("article", "main") or name in ("post", "entry")
            away = tag in ("nav", "aside", "footer", "form") or tag == "header" and not b["inside"] or name in ("ad", "sidebar", "newsletter")
            b["talk"] = node if name == "comments" else b["talk"]
            b["part"] = b["part"] or (node if away and not article else None)
            b["vague"] |= name in ("promo", "byline")
            b["inside"] |= article
        words = re.findall(r"[^\W\d_]+", b["text"].lower())
        han = sum("一" <= c <= "鿿" for c in b["text"])
        n = len(b["text"])
        b["size"] = n + 2 * han if 2 * han > n else n
        b["stops"] = min(1, 3 * sum(c in "的了是在和有不這我他們就也都與為而及之於以被把这们与为于" for c in b["text"]) / han) if 2 * han > n else sum(w in html.STOP_WORDS for w in words) / max(1, len(words))
        b["links"] = b["linked"] / n
    known = any(b["size"] >= 70 and b["links"] <= 0.33 and b["stops"] >= 0.15 for b in found)
    for b in found:
        stops = b["stops"] if known else 1
        if b["links"] > 0.33:
            b["first"] = "bad"
        elif b["size"] < 70:
            b["first"] = "open"
        elif stops < 0.15:
            b["first"] = "bad"
        else:
            b["first"] = "good" if stops >= 0.25 and b["size"] > 200 else "near"
    begun, told = False, {None: False}
    for b in found:
        b["comment"] = told.setdefault(b["talk"], begun)
        if not b["comment"] and b["part"] is None:
            begun |= b["first"] in ("good", "near") or b["inside"] and not b["vague"] and not b["heading"]
    total = lambda some: sum(b["size"] for b in some)
    long = [b for b in found if b["first"] == "good" and not b["comment"]]
    marked = any(b["inside"] and not b["part"] and not b["comment"] for b in found)
    for b in found:
        mine = [x for x in long if x["part"] is b["part"]]
        b["out"] = b["comment"] or b["part"] is not None and not (not marked and mine and 2 * total(mine) > total(long))
    running = [b for b in found if b["first"] in ("good", "near") and not b["out"]]
    article = any(b["inside"] and not b["out"] for b in found) and 2 * total(b for b in running if b["inside"]) >= total(running)
    for b in found:
        b["label"] = b["first"]
        if article and b["first"] == "bad":
            b["label"] = "open"
        if b["vague"] and b["first"] in ("open", "near", *(["bad"] if article else [])) and b["part"] is None:
            b["label"] = "bad"
        if article and (not b["inside"] or b["links"] > 0.8 and b["size"] < 200 and not b["heading"]):
            b["label"] = "bad"
        if b["out"]:
            b["label"] = "bad"
    some = [b for b in found if b["inside"]] if article else found

    def nearest(k, step, labels):
        j = k + step
        while 0 <= j < len(some):
            if labels[j] in ("good", "bad"):
                return labels[j], abs(j - k)
            j += step
        return "", 10**9

    labels = [b["label"] for b in some]
    if article:
        labels = ["good" if x == "near" else x for x in labels]
        for k, b in enumerate(some):
            ends = {nearest(k, -1, labels)[0], nearest(k, 1, labels)[0]}
            b["label"] = labels[k] if labels[k] != "open" else "bad" if ends == {"bad"} and not b["heading"] else "good"
        for b, after in zip(found, found[1:], strict=False):
            if b["heading"] and b["first"] == "open" and not (b["out"] or b["part"] or b["vague"] or b["inside"]) and after["inside"] and after["label"] == "good":
                b["label"] = "good"
    else:
        first = list(labels)
        for k, x in enumerate(first):
            if x == "near":
                labels[k] = "good" if "good" not in first or "good" in (nearest(k, -1, first)[0], nearest(k, 1, first)[0]) else "bad"
        for k, b in enumerate(some):
            b["label"] = labels[k]
            if labels[k] == "open":
                (x, i), (y, j) = nearest(k, -1, labels), nearest(k, 1, labels)
                b["label"] = "good" if b["heading"] and y == "good" else x if i <= j else y
    return "\n".join(b["text"] for b in found if b["label"] == "good")


def sentence(r, lang, n, stops):
    if lang == "zh":
        return "".join(r.choice("的了是在和不") if r.random() < stops / 2 else chr(r.randint(0x4E10, 0x9F00)) for _ in range(n * 3)) + "。"
    return " ".join(r.choice(FILL[lang]) if r.random() < stops else "".join(r.choices(LETTERS, k=r.randint(4, 9))) for _ in range(n))


def page(r, lang):
    def leaf():
        text = sentence(r, lang, r.choice([2, 6, 15, 45, 70]), r.choice([0.0, 0.2, 0.45, 0.5]))
        if r.random() < 0.2:
            text = "".join(f"<a href=x>{w}</a> " for w in text.split())
        elif r.random() < 0.2:
            text = f"<b>{text}</b><br>a &amp; b <a href='y'>more</a>"
        tag = r.choice(["p", "p", "p", "div", "h2", "li"])
        return f"<{tag}>{text}</{tag}>"

    def part(depth):
        inner = "".join(leaf() if depth > 2 or r.random() < 0.7 else part(depth + 1) for _ in range(r.randint(1, 5)))
        tag, name = r.choice([("div", ""), ("section", ""), ("article", ""), ("nav", ""), ("aside", ""), ("form", ""), ("header", ""), ("div", "ad"), ("div", "promo"), ("div", "post"), ("div", "comments"), ("div", "newsletter"), ("div", "byline")])
        return f"<{tag} class='{name}'>{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"

    return "<html><body>" + "".join(part(0) for _ in range(r.randint(1, 6))) + "</body></html>"


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es", "fi", "zh"])
def test_plain_version(lang):
    r = random.Random(lang)
    some = 0
    for _ in range(400):
        p = page(r, lang)
        assert html.main_text(p) == slow_text(p), p
        some += html.main_text(p) != ""
    assert some > 200


def test_measures_see_every_block(spark):
    """On the pages table every block has a class by density, length and links, and neighbours decide many."""
    seen = Counter()
    for row in spark.read.parquet(PAGES).select("html").collect():
        for b in html.classified(html.blocks(row["html"] or "")):
            assert b.first == html.first_pass(*html.measures(b)) or b.first in ("good", "near")
            seen[b.first, b.label] += 1
    assert all(seen[x] > 50 for x in [("good", "good"), ("near", "good"), ("open", "good"), ("open", "bad"), ("bad", "bad")]), seen


LONG = "This is the first part of a story that goes on for a while and has all of the words that a text in this language has, so that it is long enough to be decided by itself, which takes about two hundred letters in all."


def test_two_passes():
    p = f"<html><body><div class='menu'><a href=x>Home</a> <a href=y>News</a></div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div><a href=z>More of this kind of thing</a></div><footer>&copy; 2020</footer></body></html>"
    assert html.main_text(p).split("\n") == ["Title", LONG, "Short.", LONG]
    marked = "<main><h2>A &amp; B</h2><p>one<br>two  three</p><ul><li>x<li>y</ul><section class='comments'><p>I think so too</p></section></main><aside>no</aside>"
    assert html.main_text(marked).split("\n") == ["A & B", "one two three", "x", "y"]


def test_marks_are_weighed():
    # a vague name doesn't take long running text out, nor does a small card the article
    assert html.main_text(f"<article><p>{LONG}</p><div class='promo-text'><p>{LONG}</p></div></article>").split("\n") == [LONG, LONG]
    assert LONG in html.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='post'><p>A card.</p></div>")
    # a form around the whole page is no form
    assert html.main_text(f"<form><div><a href=x>menu</a></div><p>{LONG}</p><p>{LONG}</p></form>").split("\n") == [LONG, LONG]
    # comments that are longer than the article, adverts and notices in it
    assert html.main_text(f"<article><p>{LONG}</p><div class='comments'>{f'<p>{LONG} x</p>' * 5}</div><div class='ad'>{LONG} buy</div><div class='cookie-notice'>{LONG} ok</div></article>") == LONG


def test_other_languages():
    italian = "Questa parte della storia racconta che il viaggio non era finito e che per tornare a casa ci voleva ancora un giorno di cammino, come tutti sapevano da tempo, e la notte era ormai vicina per gli uomini e le donne del paese che aspettavano."
    finnish = "Tämä tarinan osa kertoo siitä, miten pitkä matka oli vasta alussa ja miten kaikki tiesivät, että kotiin oli vielä päivän kävelymatka, vaikka ilta oli jo lähellä ja kylän väki odotti heitä kovasti, kuten se oli odottanut jo monta pitkää viikkoa."
    chinese = "這是一個關於旅行的故事，他們在路上走了很久，終於看到了村子的燈火，大家都很高興，因為家裡的人在等著他們，而且晚飯也已經準備好了，桌上有熱湯和米飯。" * 2
    for text in (italian, finnish, chinese):
        assert html.main_text(f"<div><a href=x>menu</a> <a href=y>more</a></div><div><p>{text}</p></div>") == text


def test_long_page_is_linear():
    assert len(html.main_text("<div>" * 3000 + f"<p>{LONG}</p>" * 3000).split("\n")) == 3000


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='single single-post comments-open'><p>{LONG}</p></body>",
        f"<html class='has-comments'><body><article class='post has-comments comments-open'><h1>T</h1><p>{LONG}</p></article></body>",
        f"<div id='page' class='comments-closed'><nav>a b c</nav><p>{LONG}</p></div>",
        f"<div class='entry reply-enabled'><p>{LONG}</p></div>",
        f"<body class='comments-open'><main><p>{LONG}</p></main><div id='comments'><p>{LONG} I think so.</p></div><div class='comment-list'><p>{LONG} No.</p></div></body>",
        f"<div id='page' class='comments-open'><p>{LONG}</p><section class='comments'><form>{LONG}</form><p>{LONG} So it is.</p></section></div>",
        f"<article><p>Short.</p><p>{LONG}</p><div class='comments'>{f'<p>{LONG} x</p>' * 5}</div></article>",
    ],
)
def test_a_state_in_a_class_is_no_comment(page):
    assert [b for b in html.main_text(page).split("\n") if b not in ("T", "Short.")] == [LONG]


def test_pages_that_measures_decide():
    """Without a mark, or with one that is wrong, classes and neighbours decide: the same article in all its wrappings."""
    card, links = "<p>Just a short note.</p>", "<div>" + "".join(f"<a href=x{i}>Another long title of a story {i}</a> " for i in range(9)) + "</div>"
    body = f"<p>{LONG}</p><p>A short one.</p><p>{LONG}</p>"
    for wrap in ("<div>{}</div>", "<div class='footer'>{}</div>", "<section id='sidebar'>{}</section>", "<div class='comments-open'>{}</div>"):
        for marked in (f"<div class='post'>{card}</div>", f"<div class='content'>{card}</div>"):
            got = html.main_text(links + wrap.format(body) + (marked if wrap == "<div>{}</div>" else "") + links)
            assert got.split("\n")[:3] == [LONG, "A short one.", LONG] and "Another" not in got


@pytest.mark.parametrize("page", ["<title>" * 30000, "<b>" * 30000 + "</i>" * 30000, "<b>" * 20000 + "<p></p>" * 20000, "<script>" * 30000, "<a href=x>" * 30000 + "</p>" * 30000, "<div>" * 30000 + "</span>" * 30000])
def test_stray_and_unclosed_tags_are_linear(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 5
