"""Main text of pages that were labelled by hand: what is article is upper case, what is not is lower case."""

import random

from telesift.llm import pages

WORDS = "river stone light water house green time long small first other under paper field night".split()


def say(n, seed, upper=True):
    rng = random.Random(seed)
    out = " ".join(rng.choice(WORDS) for _ in range(n))
    return out.upper() if upper else out


MENU = "<nav><ul><li><a href=/a>home page</a><li><a href=/b>other things</a><li><a href=/c>about us</a></ul></nav>"
FOOT = "<footer><p>copyright by nobody</p><a href=/x>terms of use</a></footer>"


def labelled():
    paras = lambda k, n, s=0: "".join(f"<p>{say(n, s + i)}</p>" for i in range(k))
    return [
        f"<p>{say(80, 1)}</p>",
        f"<html><body><h1>RIVER STONE</h1>{paras(3, 60)}</body></html>",
        f"<body>{MENU}<div class=text>{paras(4, 44)}</div>{FOOT}",
        f"<body>{MENU}<div id=wrap>{say(90, 2)}<br>{say(40, 3)}</div>{FOOT}",
        f"<article class='post promo-story'><h2>STONE LIGHT</h2>{paras(2, 60)}</article>{FOOT}",
        f"<div class='content social-history'>{paras(2, 60)}</div><div class=sidebar><p>{say(30, 9, False)}</p></div>",
        f"<body>{MENU}<article><h1>LIGHT WATER HOUSE</h1>{paras(5, 70)}<ul><li>{say(9, 4)}</li><li>{say(8, 5)}</li></ul></article><section class=comments><p>{say(45, 6, False)}</p></section>{FOOT}",
        f"<header><a href=/>site name</a><p>{say(6, 7, False)}</p></header><main>{paras(6, 25)}<blockquote>{say(20, 8)}</blockquote></main><aside><p>{say(50, 10, False)}</p></aside>",
        f"<table><tr><td><a href=x>home page</a></td><td>{say(120, 11)}</td></tr></table>",
        f"<body>{''.join(f'<p>{say(14, 20 + i)}</p>' for i in range(9))}{FOOT}",
        f"<div id=cookie-notice><p>{say(25, 12, False)}</p></div><div class=ad>{say(8, 13, False)}</div><article>{paras(3, 50)}<form><p>{say(5, 14, False)}</p><input></form></article>",
        f"<article><p>{say(900, 15)}</p></article><div class='related-posts'><h3>more to read</h3><ul><li><a href=/1>{say(6, 16, False)}</a></li></ul></div>",
    ]


def test_labelled_pages():
    every = labelled()
    right = kept = there = 0
    for page, text in zip(every, pages.main_texts(every, pages.fitted()), strict=True):
        words = text.split()
        wanted = [w for w in " ".join(b[0] for b in pages.text_blocks(page)).split() if w.isupper()]
        good = sum(w.isupper() for w in words)
        right, kept, there = right + good, kept + len(words), there + len(wanted)
        assert good >= 0.9 * len(wanted), page[:80]
    assert right >= 0.98 * kept and right >= 0.98 * there
