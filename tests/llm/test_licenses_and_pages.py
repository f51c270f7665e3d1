import random
import re

import pytest

from foliant.llm.licenses import BASE, LEAST, Index, scan, words_of
from foliant.llm.main_text import content_lines, extract, main_text, smoothed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_are_the_contracts():
    for t in ("", "MIT License.", "Ünï-çödé 1_2 漢字", "a\x00b\x7fc@d[e{f`g", " x İ"):
        assert [w.decode() for w in words_of(t)] == WORD.findall(lower(t))


def test_every_base_place_is_found(spark, edge, empty):
    rng = random.Random(16)
    vocab = "gnu general public license apache cc by mit nc version the with".split()
    pairs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    pairs += [(900, "Licensed under CC BY-NC 4.0."), (901, "released under the MIT-License!"), (902, None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    for i, t in pairs:
        w = WORD.findall(lower(t))
        hits = sorted((k, label) for phrase, label in BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert "cc-by-nc" in got[900].labels.split(",") and got[901].base_labels == "mit"
    assert scan(edge).count() == 12 and scan(empty).count() == 0


def brute_matches(index, words):
    """Every template at every place."""
    base, found = [], {}
    for k, t in enumerate(index.templates):
        for start in range(-len(t.words), len(words)):
            if any(start + at < 0 or words[start + at : start + at + len(key)] != key for at, key in t.keys):
                continue
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
            if t.base:
                base.append((start, k))
            elif share < LEAST and sum(len(key) for _, key in t.keys) / len(t.words) < LEAST / 1.5:
                continue
            found[t.label] = max(1.0 if t.base else share, found.get(t.label, 0.0))
    return sorted(base), found


def test_labels_and_scores_equal_brute_force():
    rng = random.Random(17)
    index = Index.of()
    vocab = sorted({w for t in index.templates for w in t.words}) + [b"other", b"word"]
    found = set()
    for k in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            notice = list(rng.choice(index.templates).words)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                notice[rng.randrange(len(notice))] = rng.choice(vocab)
            if k % 5 == 0 and len(notice) > 3:
                del notice[rng.randrange(len(notice))]
            words[rng.randint(0, len(words)) : 0] = notice
        got = index.scan(words)
        assert got == brute_matches(index, words)
        found |= got[1].keys()
    assert len(found) > 12


def test_long_notices_need_their_key_phrases():
    index = Index.of()
    notice = next(n for n in index.templates if n.label == "mit" and len(n.words) > 20)
    words = list(notice.words)
    assert index.scan(words)[1]["mit"] == 1.0
    words[60 % len(words)] = b"changed"
    assert "mit" in index.scan(words)[1]
    gone = [b"x" if w == b"restriction" else w for w in notice.words]
    assert "mit" not in index.scan(gone)[1]
    assert 0 < index.idf[b"license"] < index.idf[b"sublicense"]


ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  para\n graph.<br>Still it.<p>Second one.</p><aside>Side</aside><div class='comments'><p>Nice!</p></div></article>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=ad>Buy now</div>{ARTICLE}<footer>&copy; me</footer></body></html>", "Title & more\nFirst para graph. Still it.\nSecond one."),
        ("<body><div class='ad'><p>Unclosed advert<article><p>Body text.</article>", "Body text."),
        ("<body><header><h1>Site</h1></header><main><p>One.</p><form><p>Name <input></p></form><p hidden>No</p><p>Two.</p></main><div>Contact</div></body>", "One.\nTwo."),
        ("<ul><li>a b<li>c d</ul><table><tr><td>x<td>y</table>" * 1, "a b\nc d\nx\ny"),
        ("<p>a&nbsp;&lt;b&gt; &#233;<!-- no --></p><script>x", "a <b> é"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_ratios_find_the_content_without_an_article():
    body = "<p>" + "A long sentence of real prose that goes on for a while. " * 6 + "</p>"
    menu = "<div>" + "".join(f"<a href='/{i}'>Link {i}</a> " for i in range(20)) + "</div>"
    html = f"<body>{menu}<div id=c><h2>Head</h2>{body}<p>Short.</p>{body}</div><div><a href=x>more</a> <a href=y>etc</a></div></body>"
    assert main_text(html).startswith("Head\nA long") and "Link" not in main_text(html) and "Short." in main_text(html) and "etc" not in main_text(html)


def test_smoothing_keeps_constants():
    assert smoothed([2.0] * 7) == pytest.approx([2.0] * 7)
    assert smoothed([0, 0, 9, 0, 0])[2] == max(smoothed([0, 0, 9, 0, 0]))
    assert content_lines([], {}) == []


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def made_page(rng, outer, inner, names):
    """(html, text): an article of a heading, paragraphs and a list in ``inner`` elements, amid what isn't content."""
    lines = [sentence(rng, 6)] + [sentence(rng, rng.randint(25, 60)) for _ in range(rng.randint(2, 5))] + [sentence(rng, rng.randint(2, 5)) for _ in range(3)] + [sentence(rng, 40)]
    paragraphs, listed = lines[1:-4], lines[-4:-1]
    body = f"<h1>{lines[0]}</h1>" + "".join(f"<{inner}>{p}</{inner}>" for p in paragraphs) + "<ul>" + "".join(f"<li>{x}" for x in listed) + f"</ul><p>{lines[-1]}"
    marked = lambda kind, text: f'<div class="{kind}">{text}</div>' if names else f"<div>{text}</div>"
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{sentence(rng, 2)}</a></li>' for k in range(6)) + "</ul>"
    more = [marked("ad", sentence(rng, 6)), marked("cookie-notice", f"{sentence(rng, 4)} <button>OK</button>"), f"<form><p>{sentence(rng, 30)}</p><input></form>"]
    rng.shuffle(more)
    end = marked("footer", f"&copy; {sentence(rng, 5)}")
    return f"<html><head><title>x</title><script>var a = '<p>{sentence(rng, 50)}</p>';</script></head><body>{marked('menu', menu)}{''.join(more[:2])}<{outer}>{body}</{outer}>{more[2]}{end}</body></html>", "\n".join(lines)


@pytest.mark.parametrize("outer, names, least", [("article", True, 40), ("article", False, 40), ("div", True, 40), ("div", False, 38)])
def test_made_pages(outer, names, least):
    """With and without an article element, and with and without telling class names."""
    rng = random.Random(18)
    pages = [made_page(rng, outer, rng.choice(["p", "div"]), names) for _ in range(40)]
    assert sum(main_text(html) == text for html, text in pages) >= least


def test_pages(spark):
    pairs = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, None), (2, "v", "<p>" + "word " * 200_000, "y")]
    df = spark.createDataFrame(pairs, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 5 * 200_000 - 1
    assert extract(df.limit(0)).count() == 0
