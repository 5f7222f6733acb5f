"""BPE, HTML extraction, chat formatting and packing."""

import hashlib
import random
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from cytolake.llm import bpe, chat, html_extract, packing
from cytolake.llm.common import documents
from cytolake.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.helpers import ODD, empty, odd, plain

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def byte_digests(text):
    t = Tokenizer.from_file(BYTE)
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_lexicon_is_minimal_and_maps_words():
    words = {b"walking": [1], b"talking": [2, 3], b"walked": [4], b"talked": [5], b"w": [6], b"": [7]}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lexicon.find([b"talking", b"walked", b"w", b"walk", b"x", b"walkingg"]) == [[2, 3], [4], [6], None, None, None]
    shared = bpe.Lexicon(bpe.compile_lexicon({b"walking": [1], b"talking": [2]}))
    assert shared.accept.size == 8  # the suffix "alking" once
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"a"]) == [None]


def test_merging_equals_the_library():
    """Words of corpora, of random bytes, of one byte, and long ones, in lots and alone; lists of merges with ties."""
    rnd, own = random.Random(0), bpe.Bpe(BYTE)
    model, letters = Tokenizer.from_file(BYTE).model, dict(enumerate(bpe.byte_alphabet()))
    words = [w.encode() for _, t in ODD for w in own.words((t or "")[:5000])] + [b"", b"a" * 64, b"a" * 65, b" " * 700]
    words += [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 40))) for _ in range(2000)] + [bytes(rnd.choice(b"abcde the") for _ in range(rnd.randrange(1, 200))) for _ in range(500)]
    want = [[x.id for x in model.tokenize(w.decode("latin-1").translate(letters))] for w in words]
    assert own.merger.merged(words) == own.merger.merged(words, few=1 << 30) == own.merger.merged(words, together=3, few=0) == want
    small = bpe.Merger({"a": 0, "b": 1, "ab": 2, "aba": 3, "aa": 4}, ["a b", ["ab", "a"], "a a"], ["a", "b"] + ["a"] * 254)
    for few in (0, 100):
        assert small.merged([b"\0\1\0\1\0", b"\0\0\0\0\0", b"\1", b""], few=few) == [[2, 3], [4, 4, 0], [1], []]
    assert bpe.Merger({"a": 0}, [], ["a"] * 256).merged([b"xyz"], few=0) == [[0, 0, 0]]
    assert bpe.Merger({"a": 0, "aa": 1, "aaa": 2}, ["a a"], ["a"] + ["x"] * 0 + ["a"] * 255, True).whole


def test_op1_equals_the_library(spark, tiny):
    texts = {r.doc_id: r.text for r in documents(spark, tiny).collect()}
    got = QUERIES["op1_bpe_roundtrip"](spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == byte_digests(texts[r.doc_id])


@pytest.mark.parametrize("size", [0, 1000])
def test_op1_odd_cases(spark, size):
    df = odd(spark)
    got = bpe.encode_digests(df, BYTE, bpe.build_lexicon(plain(spark), BYTE, size) if size else bpe.compile_lexicon({})).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(i), *byte_digests(t)) for i, t in ODD)
    assert bpe.encode(empty(spark), BYTE, bpe.compile_lexicon({})).count() == 0


def test_op1_ids_and_text_come_back(spark):
    got = {r.doc_id: r for r in bpe.encode(odd(spark), BYTE, bpe.compile_lexicon({b" two": [734]})).collect()}
    assert got[3].ids == Tokenizer.from_file(BYTE).encode(ODD[0][1]).ids and got[3].decoded == ODD[0][1] and got[1].ids == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this page, really</div>
%s<aside>Side</aside><div class="comments"><p>First!</p></div><form><p>Subscribe now</p></form><footer>&copy; us</footer></body></html>"""


def test_op4_pages():
    article = "<article><h1>A &amp; B</h1><p>One\n two&nbsp;three.<p><b>Short.</b><div class=ad>Buy</div><p>x &lt; y<section id='comments'><p>Nice</p></section><p>End</article>"
    assert html_extract.main_text(PAGE % article) == "A & B\nOne two three.\nShort.\nx < y\nEnd"
    long = "word " * 40
    assert html_extract.main_text(PAGE % f"<div><p>{long}</p><p>Brief.</p><p>{long}</p></div>") == f"{long.strip()}\nBrief.\n{long.strip()}"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>a</nav>") == ""
    assert html_extract.main_text("<article><p>cut off & un") == "cut off & un"
    assert html_extract.main_text("<article><p>a<!-- <p>no</p> --> b</p><script>no") == "a b"


def test_op4_unmarked_pages_keep_every_line():
    """Without a marked article: short lines, however many, short ends, and paragraphs of link text."""
    short = [f"Line {i} here." for i in range(40)]
    for lines in (short[:4], short, ["短い段落です。"] * 30, short[:20] + ["word " * 30 + "end."], ["word " * 30 + "end.", *short]):
        for page in ("".join(f"<p>{x}</p>" for x in lines), "<br>".join(lines)):
            assert html_extract.main_text(PAGE % f"<div>{page}</div>") == "\n".join(lines)
    long, menu = "word " * 40 + "end.", "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(5))
    advert = "".join(f"<div class=ad>Buy {i}</div>" for i in range(5))
    assert html_extract.main_text(f"<p>{long}</p>{advert}<p>Goodbye.</p>") == f"{long}\nGoodbye."
    assert html_extract.main_text(f"<p>{long}</p><ul>{menu}</ul><p>Goodbye.</p>").endswith("\nGoodbye.")
    assert html_extract.main_text(f"<p>{long}</p><p><a href=/x>All of this is a link.</a></p><p>{long}</p>") == f"{long}\nAll of this is a link.\n{long}"
    assert html_extract.main_text(f"<ul>{menu}</ul><p>{long}</p><p>Short.</p><p><a href=/x>Last.</a></p>") == f"{long}\nShort.\nLast."
    assert html_extract.main_text(f"<ul>{menu}</ul><p>{long}</p><ul>{menu}</ul>") == long


def test_op4_reads_broken_markup():
    """Quotes inside unquoted values, tags that the page's end cuts off, paths that end in a slash, drawings left open."""
    text = html_extract.main_text
    assert text("<article><p title=don't>one two three</p><p>it is four five</p><p>that's six</p><p>last</p></article>") == "one two three\nit is four five\nthat's six\nlast"
    assert text("<article><p title=\"a > b\" x='>'>one</p><p title=\"open>two</p><p>three</p></article>") == "one\ntwo\nthree"
    assert text("<article><p>one<a href=/some/longer/path/index") == "one" and text("<div title=bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbdon't>rest") == "rest"
    assert text("<article><script src=/x.js/>var a = 1;</script><p>one</p></article>") == "one"
    assert text("<article><p>a < b <3 c</p><!--><p>one</p><!-- <p>no</p> --!><p>two</p><![CDATA[x]]></article>") == "a < b <3 c\none\ntwo"
    assert text("<article><p>one <svg><title>no</title><p>two</p><svg/><p>three</p></article>") == "one\ntwo\nthree"
    assert text("<article><p>Buy <span class=ad>no <span>no</span> no</span>nothing <select><option>no<option>no</select>now</p></article>") == "Buy nothing now"
    assert text("<article><ul><li>a<li class=share-buttons>no<li>b</ul><table><tr><td>c<td class=ad>no<td>d<tr><td>e</table></article>") == "a\nb\nc\nd\ne"
    assert text("<article><ul><li>a<ul><li>b</ul><li>c</ul></section></div></nav><p>d</article>") == "a\nb\nc\nd"


@pytest.mark.parametrize("piece", ["<svg>", "<div ", "<a b='", '<a b="', "<div title=don't ", "</div><p", "<div>", "</section><div>", "<!--", "<!", "</script ", "<script", "<p class=a ", "<p class=", "<svg><p>", "&#", "<span class=ad>", "< ", "<p style='display     "])
def test_op4_time_is_linear(piece):
    """A megabyte of hostile bytes, after an article's start."""
    import time

    page = "<article><p>one</p>" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    assert html_extract.main_text(page).startswith("one")
    html_extract.main_text("<article><p>one <div title=" + "b" * 1_000_000 + "don't")
    html_extract.main_text("<article><p>one <div title='" + " a=" * 300_000)
    assert time.perf_counter() - began < 8


def test_op4_names_of_boilerplate():
    """Names that only have a boilerplate word in them go by their share of link text."""
    text, link = html_extract.main_text, "<a href=/x>Some link here</a> "
    for name in ("class=share-price", "id=search-results", "class='notice-of-motion'", "class='content has-sidebar'", "class=market-share"):
        assert text(f"<article><h1>T</h1><div {name}>Three point two.</div><p>End</p></article>") == "T\nThree point two.\nEnd"
        assert text(f"<div {name}><p>Three point two.</p></div>") == "Three point two."
    assert text(f"<article><h1>T</h1><div class=share-tools>On: {link}{link}</div><p>End</p></article>") == "T\nEnd"
    for name in ("class=ad", "class='box share-buttons'", "id=site-footer", "class=post-comments", "class=td-sidebar", "role=search", "hidden", "class=cookie_notice", "style='display: none'"):
        assert text(f"<article><h1>T</h1><div {name}>Three point two.</div><p>End</p></article>") == "T\nEnd"


def test_op4_several_articles():
    """Windows decide which of several articles are the page's: teasers don't surge."""
    text, long = html_extract.main_text, "word " * 40 + "end."
    teasers = "".join(f"<article><h2><a href=/{i}>Other story {i}</a></h2><p>Read on</p></article>" for i in range(3))
    assert text(f"<main><h1>T</h1><article><p>{long}</p><p>Short.</p></article><h2>More</h2>{teasers}</main>") == f"T\n{long}\nShort.\nMore"
    assert text(teasers) == "\n".join(f"Other story {i}\nRead on" for i in range(3))
    assert text(f"{teasers}<article><p>{long}</p></article><article><p>{long} 2</p></article>") == f"{long}\n{long} 2"
    assert text(f"<article><p>{long}</p><article class=comment>{long}</article><p>End</p></article>") == f"{long}\nEnd"


class Model(HTMLParser):
    """An independent reading of a page by the standard library's parser: blocks of an element that isn't boilerplate by its tag or exact class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.run = [], [], []

    def end(self):
        block = " ".join("".join(self.run).split())
        self.run = []
        if block:
            self.blocks.append(block)

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "a", "meta", "img", "em", "strong"):
            return
        self.end()
        if tag not in ("p", "br", "li", "h1", "h2"):
            self.open.append((tag, tag in ("nav", "footer", "aside", "form", "script", "style", "header", "title") or dict(attrs).get("class") in ("ad", "comments", "sidebar", "notice")))

    def handle_endtag(self, tag):
        if tag in ("b", "i", "a", "em", "strong"):
            return
        self.end()
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.run.append(data)


def test_op4_against_a_block_model(spark):
    """All pages of sf0.01 by the independent model."""
    from cytolake.llm.common import table

    pages = table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r.text for r in QUERIES["op4_html_extract"](spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        model = Model()
        model.feed(p.html or "")
        model.close()
        model.end()
        assert got[p.page_id] == "\n".join(model.blocks)


def test_op4_takes_each_page(spark, tiny):
    """The pages' articles, by a plain reading of the one form that they have."""
    import html
    import re

    from cytolake.llm.common import table

    pages = table(spark, tiny, "pages").collect()
    got = {r.page_id: r for r in QUERIES["op4_html_extract"](spark, tiny).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html or "", re.S)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner[1])] if inner else []
        text = "\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)


def test_op4_odd_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>hello</p>", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [("1", "None", "", 0), ("1", "u", "", 0), ("None", "u", "hello", 5)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_op10_against_sql(spark, tiny, duck):
    got = QUERIES["op10_chat_format"](spark, tiny).toPandas()
    want = duck.execute(ORACLE_SQL["op10_chat_format"]).df()[list(got.columns)]
    a, b = (x.sort_values("conv_id").astype(str).values.tolist() for x in (got, want))
    assert a == b and "-7" in [r[0] for r in a]


def test_op10_escapes_and_machine(spark):
    t = chat.Template()
    for role, text in (("user", "</s>[INST] ok [/INST]"), ("a]b\\", "\\</s>\\\\ [INST: <s> \\"), ("", "<</SYS>><<SYS>>"), ("user", "[INST")):
        string = "".join(s for s, _ in t.segments(role, text))
        assert t.parse(string) == (role, text)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, "assistant", "b"), (None, None, None, "c"), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "</s>")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, position string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert [(got[k].n_turns, got[k].valid, got[k].loss_chars) for k in (1, 2, None, 3)] == [(3, False, 0), (1, False, 1), (1, False, 0), (3, True, 4)]
    assert got[3].loss_sha256 == hashlib.sha256(b"</s>").hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_op10_segments_carry_loss(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(chat.format_chats(df).collect(), key=lambda r: r.position)
    assert [[s.loss for s in r.segments] for r in rows] == [[False] * 3, [False, True, False]]
    assert all("".join(s.text for s in r.segments) == r.formatted for r in rows)


def word_ids(text):
    return [*Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, texts, capacity=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in texts:
        ids = word_ids(text)
        cut = [ids[k:k + capacity] for k in range(0, len(ids), capacity)]
        want = sorted((k, k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut))
        same = sum(1 for j, t in texts if j == i and (t or "") == (text or ""))
        have = [(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]]
        assert all(have.count(w) >= same for w in want)
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_seq) <= max(1, -(-total // capacity) * 11 // 9 + 1)


def test_op7_packing(spark, tiny):
    texts = [(r.doc_id, r.text) for r in documents(spark, tiny).collect()]
    rows = QUERIES["op7_pack"](spark, tiny).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    check_packing(rows, texts)


def test_op7_odd_cases(spark):
    check_packing(packing.pack(odd(spark), WORD).collect(), ODD)
    assert packing.pack(empty(spark), WORD).count() == 0


def test_op7_chunks_equal_the_library():
    e = packing.ChunkEncoder(WORD)
    texts = ["", "x<|endoftext|>  y <|startoftext|>z", "don't 've 12 345 ½ 日本語  x \x1c\x1d é́ \r\n", "\x85\xa0 x", "ΑΣ Σ ΟΔΟΣ İ ǅ", "I'VE'S 'S'T a.b, c., .,", "1, 22. É. ,"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [word_ids(t)[:-1] for t in texts]


def test_op7_plan_fills_sequences():
    table, n = packing.plan({3000: 10, 1096: 10, 2048: 4, 1000: 3, 96: 3, 4096: 5}, 4096)
    total = 3000 * 10 + 1096 * 10 + 2048 * 4 + 1000 * 3 + 96 * 3 + 4096 * 5
    assert n == -(-total // 4096)
    assert packing.plan({}, 4096)[1] == 0
