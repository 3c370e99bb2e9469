"""Operators that work on one row: extraction, quality rules, encoding, attribution."""

import base64
import collections
import hashlib
import html
import random
import re
import time

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from plotfield.llm import byte_bpe, html_extract, quality_rules, token_attribution

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n", "a", "it's we'll  \t x", "ÄÖ ß é漢字 🙂🙂 ", "<|endoftext|> ▁ Ġx", "naïve café", "1234567 890", "x" * 30_000, "ab " * 20_000,
       "a b c a b c a b c", "one two three\none two three\n\none two three", "tail  \n ", "\x0b\x0c\r mixed\x0bblanks"]


def random_texts(n, seed=3):
    pick = random.Random(seed)
    words = ["the", "of", "and", "Alpha", "beta,", "gamma.", "#x", "|", "été", "don't", "x1", "!!"]
    return ["".join(pick.choice(words) + pick.choice([" ", " ", "\n", "  "]) for _ in range(pick.randrange(0, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *random_texts(40), None]


@pytest.fixture
def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(frame, texts):
    got = {r.doc_id: r for r in quality_rules.judged(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(t or ""), (i, t and t[:40])
        assert not (r.base_failed and r.kept)


def test_quality_wide_windows_go_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 3)
    texts = random_texts(20, 5)
    got = {r.doc_id: r for r in quality_rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].n_repeat_words == measures(t)[4] for i, t in enumerate(texts))


def test_quality_plan_is_native(frame):
    plan = quality_rules.judged(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_filter_measures_once(frame, texts):
    """The filter does not copy the measures: no more splits than in the plan of the verdicts."""
    splits = lambda df: df._jdf.queryExecution().executedPlan().toString().count("split(")
    filtered, judged = quality_rules.quality_rules(frame), quality_rules.judged(frame)
    assert 0 < splits(filtered) <= splits(judged)
    assert {r.doc_id for r in filtered.collect()} == {r.doc_id for r in judged.where("kept").collect()}


def test_quality_rules_name_their_reason(spark):
    junk = " | ".join(["thing"] * 3 + [f"word{i}" for i in range(80)])
    fine = " ".join(f"the word{i} of a kind{i}" for i in range(40))
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame([(1, junk), (2, fine)], "doc_id long, text string")).collect()}
    assert got[2].kept and got[2].reasons == []
    assert not got[1].kept and "symbols" in got[1].reasons
    strict = [quality_rules.Rule("too_long", "n_words", high=100)]
    assert quality_rules.judged(spark.createDataFrame([(2, fine)], "doc_id long, text string"), strict).first().reasons == ["too_long"]


def encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_rank_library_and_round_trips(frame, texts):
    own = encoding()
    encoded = byte_bpe.bpe_encode(frame)
    for r in byte_bpe.bpe_decode(encoded).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
    for r in byte_bpe.bpe_digests(frame).collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_forgets_without_a_trace(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    bpe, own = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), encoding()
    for t in random_texts(10):
        assert bpe.encode([t])[0].tolist() == own.encode_ordinary(t)


def test_model_needs_consecutive_ranks():
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({b"a": 0, b"b": 2})
    assert len(set(byte_bpe.byte_characters())) == 256


def test_bpe_of_other_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    assert ranks[base64.b64decode(base64.b64encode(b"a"))] == ranks[b"a"]
    text = "Ein längerer Text, été 漢字"
    ids = byte_bpe.bpe_encode(spark.createDataFrame([(text,)], "text string"), path=path).first().ids
    assert ids == tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def slow_sections(text, rule):
    """Sections by a walk over characters."""
    own, starts = encoding(), [0]
    for line in text.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    ids, counts, crossing, at = own.encode_ordinary(text), collections.Counter(), collections.Counter(), 0
    character = [k for k, c in enumerate(text) for _ in c.encode()]
    section = lambda k: sum(s <= k for s in starts) - 1
    for i in ids:
        span = character[at: at + len(own.decode_single_token_bytes(i))]
        at += len(span)
        chars = sorted(set(span))
        votes = collections.Counter(map(section, chars))
        owner = {"first": section(chars[0]), "last": section(chars[-1]), "most": min(votes, key=lambda s: (-votes[s], s))}[rule]
        counts[owner] += 1
        crossing[owner] += len(votes) > 1
    return [(k, counts[k], crossing[k]) for k in range(len(starts))]


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_sections_by_rule(spark, rule):
    texts = [*[t for t in ODD if len(t) < 1000], *random_texts(8, 7), "a\n\n\n\nb\n \n  c", "\n\n\n\n\n\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in token_attribution.section_tokens(frame, "doc_id", rule=rule).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.section, r.n_tokens, r.n_crossing))
    for i, t in enumerate(texts):
        assert got[i] == slow_sections(t, rule), (i, t[:30])


def test_fields_add_up_to_the_whole(spark):
    frame = spark.createDataFrame([(1, "user", "hello there\n friend"), (2, None, None), (3, "", "x")], "k long, role string, text string")
    got = token_attribution.section_tokens(frame, "k", ["role", "text"], separator=": ").orderBy("k", "section").collect()
    own = encoding()
    for k, whole in ((1, "user: hello there\n friend"), (2, ": "), (3, ": x")):
        rows = [r for r in got if r.k == k]
        assert [r.section for r in rows] == [0, 1]
        assert sum(r.n_tokens for r in rows) == len(own.encode_ordinary(whole))
        assert sum(r.n_chars for r in rows) == len(whole)
    with pytest.raises(ValueError):
        token_attribution.section_tokens(frame, "k", rule="any")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body class="page sidebar-right">
<header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use the cookies of this and that site for you and for us.</p></div>
<main><article><header><h1>A title &amp; more</h1></header><p>The first of the paragraphs is<br>long enough to be told by <b>its</b> words.
<p>Short.</p><aside>See also the other one of these stories in the paper.</aside><ul><li>Point</li><li>Other&nbsp;point</li></ul>
<form><input name=q><button>Go</button></form><p>a &lt; b &#233; &#x41;</p><!-- no <p>text</p> --></article>
<section id="comments"><p>I think that this is the best of all the articles that I have read.</p></section></main>
<div class="ad">Buy the thing that is on the page for a price of it.</div><footer><p>The end of the page is not in the text.</p></footer></body>"""


def test_page_of_all_kinds():
    assert html_extract.main_text(PAGE) == "A title & more The first of the paragraphs is long enough to be told by its words. Short. Point Other point a < b é A"


def test_pages_without_article():
    long = "The first of the paragraphs is long enough to be told by its words."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><p>{long}</p><p>Brief.</p></div><footer>f</footer></body>"
    assert html_extract.main_text(page) == f"{long} Brief."
    assert html_extract.main_text("plain text of the page that is not in any tag at all") == "plain text of the page that is not in any tag at all"
    assert html_extract.main_text("<article><p>cut <b") == "cut"
    assert html_extract.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert html_extract.main_text("<nav>only</nav>") == ""


def test_names_of_parts():
    long = "The first of the paragraphs is long enough to be told by its words."
    page = (f'<div class="site-header"><p>{long} 1</p></div><div class="content has-sidebar no-comments"><p>{long}</p>'
            f'<div class="entry-header">Also of this</div></div><div class="left-sidebar"><p>{long} 2</p></div>'
            f'<ol class="comment-list"><li>{long} 3</li></ol><p hidden>{long} 4</p><div style="display: none">{long} 5</div>')
    assert html_extract.main_text(page) == f"{long} Also of this"


def test_open_blocks_follow_their_neighbours():
    block = lambda label, part=0: (html_extract.Block("x", 0, False, part, False, False), label)
    rows = [block(True), block(None), block(None), block(False), block(None, 1)]
    assert html_extract.second_pass([b for b, _ in rows], [x for _, x in rows]) == [True, True, False, False, False]


def test_extraction_as_an_operator(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, None), (3, "v", "", 1)], "page_id long, url string, html string, n_chars long")
    got = html_extract.extract_text(frame).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(got[0].text)), (1, len(got[0].text)), (2, 0), (3, 0)]
    assert html.unescape("&amp;") in got[0].text and F is not None


PAGES = {
    '<article><div title="the hidden valley"><p>A walk in the valley of the sun is what we want to do.</p></div></article>': "A walk in the valley of the sun is what we want to do.",
    '<article><p>A walk in the valley of the sun is what we want to do.</p><section id="related-work"><h2 id="search-for-gold">Search</h2>'
    '<p>The work that is related to this is in the text of the book.</p></section><p><a href=x>One whole link in the article</a></p>'
    '<div class="comments"><p>I think that this is the best of the articles in it</p></div><div class="share-buttons">Tell your friends of it</div></article>':
        "A walk in the valley of the sun is what we want to do. Search The work that is related to this is in the text of the book. One whole link in the article",
    f"<div class=post><p>{'The body of the page is in this div and it is long. ' * 10}</p></div><article><p>Card of another.</p></article>":
        ("The body of the page is in this div and it is long. " * 10).strip() + " Card of another.",
    '<body><nav><a href=1>首页</a></nav><div><p>今天天气很好我们一起去公园散步看到了很多美丽的花朵</p></div></body>': "今天天气很好我们一起去公园散步看到了很多美丽的花朵",
    '<body><div><h1>Привет</h1><p>Сегодня мы пошли гулять в большой парк и увидели там много красивых цветов</p></div></body>':
        "Привет Сегодня мы пошли гулять в большой парк и увидели там много красивых цветов",
    '<article><p>The text of the page is in this part of it.</p><p hidden>Not the text that is to be seen by you.</p><p aria-hidden="true">Nor is this the text of it.</p></article>':
        "The text of the page is in this part of it.",
}


@pytest.mark.parametrize("page", PAGES)
def test_ordinary_articles_stay_whole(page):
    assert html_extract.main_text(page) == PAGES[page]


@pytest.mark.parametrize("page", ["<span>" * 20_000 + "x" + "</p>" * 20_000, "<b>" + "<div>" * 20_000 + "y" + "</b>" * 20_000,
                                  "<div>" + "<span>" * 100_000 + "<p>a</p>" * 20_000 + "</i>" * 20_000])
def test_unclosed_tags_take_linear_time(page):
    """Seconds where walks over the whole stack for every tag would take minutes."""
    start = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - start < 10
