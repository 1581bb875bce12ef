"""Substring dedup, language, tokens, quality, page text and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from acoustics_spark.llm import html, language, quality, sharding, substrings, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket long, grp string, unit string, n int"
ODD = [None, "", "   ", "word", "x" * 5000, "é " * 3000, "a\x0bb\x0cc\x1fd", "same", "same"]


def table(spark, texts, ids=None, langs=None, sources=None):
    k = range(len(texts))
    ids, langs, sources = ids or list(k), langs or ["en"] * len(texts), sources or ["s"] * len(texts)
    return spark.createDataFrame([(ids[i], texts[i], langs[i], sources[i], 1, 7, "clash", "clash", 3) for i in k], DOCS)


def slow_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(seed, length, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(length // 3)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, length // 2)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            cut = p[a : a + rng.randint(length // 2, len(p))]
            if rng.random() < 0.5 and cut:
                i = rng.randrange(len(cut))
                cut = cut[:i] + "Z" + cut[i + 1 :]
            parts += [cut, word()]
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[1], texts[1], "ab" * length, "z" * 3 * length, "ab" * length + "c", *ODD]


@pytest.mark.parametrize(("length", "slab", "places"), [(40, None, None), (61, None, 3), (100, 150, None)])
def test_repeats_match_brute_force(spark, monkeypatch, length, slab, places):
    monkeypatch.setattr(substrings, "SLAB", slab or substrings.SLAB)
    monkeypatch.setattr("acoustics_spark.llm.likely.PLACES", places or 1 << 24)
    texts = repeating_texts(length, length)
    ids = [*range(len(texts) - 3), 1, None, None]
    got = substrings.remove_repeats(table(spark, texts, ids).repartition(3), length).collect()
    want = slow_repeats(texts, length)
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got])) == sorted(str((i, *w)) for i, w in zip(ids, want))
    assert 20 < sum(w[1] > 0 for w in want) and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert all(r.n_chars == sum(x & 0xC0 != 0x80 for x in r.kept) for r in got)


def test_repeats_of_400_bytes_in_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, slow_repeats([r.text for r in rows], 400))}
    got = substrings.remove_repeats(docs, with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_kept_text_without_repeated_passages_of_400_bytes(spark, tmp_path):
    words = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    under, over, tail = words(1000, 60), words(2000, 80), "".join(f"{i:03d}" for i in range(133))
    assert len(under) < 400 < len(over) and len(tail) == 399
    texts = ["Aé " + under + " B", "C " + under + " D", "Eñ" + over + "F", "G" + over + "ü", "é" + tail, "\u0129" + tail, None, "K", "L" * 500]
    table(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(substrings.op1_substrings(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == [*texts[:2], "EñF", "Gü", "\ufffd", "\ufffd", "", "K", ""]
    assert [r.n_removed for r in rows] == [0, 0, len(over), len(over), 400, 400, 0, 0, 500]
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows if "\ufffd" not in r.text)
    assert rows[4].kept_sha256 == hashlib.sha256(b"\xc3").hexdigest() and rows[5].kept_sha256 == hashlib.sha256(b"\xc4").hexdigest()


def test_sampled_places_are_a_matter_of_content():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 5, 500).astype(np.uint64) << np.uint64(40)
    got = substrings.leftmost_least(keys, 7)
    assert got.tolist() == [i + int(np.argmin(keys[i : i + 7])) for i in range(494)]


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    model = language.train(docs)
    got = language.identify(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and set(model.members) == {"germanic", "romance"}
    hidden = docs.withColumn("lang", language.F.when(~language.held_out(docs["doc_id"]), docs["lang"]))
    assert [r.lang_pred for r in language.identify(docs, language.train(hidden)).orderBy("doc_id").collect()] == [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)]


def test_language_of_odd_texts_and_models(spark):
    odd = table(spark, [*ODD, "123 456 ½ Ⅷ!?"])
    by = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, language.train(odd)).collect()}
    assert by[0] == by[1] == by[2] == by[len(ODD)] == ("und", 0.0) and by[3][0] == "en"
    assert language.train(table(spark, [])) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    langs = ["en", "de", "xx", None] * 6
    texts = [{"en": "the of and thing", "de": "der und schöne ßa", "xx": "qqq kkk zzz", None: "what is this"}[x] + f" {i}" for i, x in enumerate(langs)]
    got = language.identify(table(spark, texts, langs=langs), language.train(table(spark, texts, langs=langs))).collect()
    assert all(r.lang_pred == langs[r.doc_id] for r in got if langs[r.doc_id])


def test_svm_separates_and_balances():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (200, 5)), rng.normal(-1, 0.3, (9, 5))]).astype(np.float32)
    y = np.array([1.0] * 200 + [-1.0] * 9)
    w = language.linear_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).all()


def slow_tokens(text, scores):
    text = tokens.SPACE + text.replace(" ", tokens.SPACE) if text else ""
    worst, best = min(scores.values()) - 10, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(max(0, end - 16), end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            found.append((best[-1][0] + worst, best[-1][1] - len(text[end - 1].encode())))
        best.append(max(found))
    return -best[-1][1]


def test_token_counts_match_whole_text_dynamic_programming(spark, sf):
    scores = tokens.piece_scores()
    assert max(map(len, scores)) <= 16
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if len(t) < 600][:60]
    texts += [t or "" for t in ODD if not t or len(t) < 100] + ["  two   spaces ", "中文 字 😀", "y" * 200, "▁ odd▁▁x"]
    for most in (50, 400_000):
        got = {r.doc_id: r for r in tokens.token_counts(table(spark, texts), most_nodes=most).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == [slow_tokens(t, scores) for t in texts]
    got = {r.doc_id: r for r in tokens.token_counts(table(spark, ODD)).collect()}
    assert (got[0].n_tokens, got[1].n_tokens, got[0].n_chars) == (0, 0, 0) and got[4].n_chars == 5000
    assert tokens.token_counts(table(spark, [])).count() == 0


def test_trie_shares_prefixes():
    t = tokens.Trie({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -2.0})
    assert [t.count(w) for w in ("abc", "abb", "ab", "é", "aé")] == [2, 2, 1, 2, 3]
    assert len(t.best) == 1 + 4 + 1 + 1


def slow_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_counts_match_brute_force(spark, sf):
    rng = random.Random(4)
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:120] + ODD
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(80)] + ["a\r\nb\na\r\n\n \nb", "😀# é|\x0b%", "# " * 30, "\x85\xa0 x"]
    got = {r.doc_id: r for r in quality.quality(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_quality(t), repr(t)
        assert not (r.kept and r.base_failed)


def slow_distances(x, steps=quality.STEPS):
    """The estimator in numpy, from its description."""
    floor = np.diag([(f * quality.SCALE) ** 2 for f in quality.FLOORS.values()])
    mean = np.median(x, 0)
    off = np.median(np.abs(np.round(x - mean)), 0)
    cov = np.diag((1.4826 * off) ** 2) + floor
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        far = np.round(np.log2(1 + d) * 64)
        near = x[far <= np.percentile(far, 50)]
        mean = near.mean(0)
        cov = quality.CONSISTENCY * np.cov(near.T, bias=True) + floor
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_robust_distances_match_numpy_and_reject_outliers(spark):
    rng = random.Random(9)
    words = ["thing", "of", "other", "and", "when", "it", "houses", "a", "reading"]
    make = lambda: " ".join(rng.choices(words, k=rng.randint(30, 200)))
    texts = [make() for _ in range(150)] + [make().replace(" ", "### ") for _ in range(40)] + [" ".join("x" * 14 + str(rng.random()) for _ in range(60)) for _ in range(9)]
    sources = [None if i % 2 else "s" for i in range(len(texts))]
    docs = table(spark, texts, sources=sources)
    got = {r.doc_id: r for r in quality.quality(docs, min_rows=30).collect()}
    rows = {r.doc_id: [r[f"x{i}"] for i in range(4)] for r in quality.with_counts(docs).select("doc_id", *quality._features()).collect()}
    for parity in (0, 1):
        own = [i for i in range(len(texts)) if i % 2 == parity and not got[i].base_failed]
        want = slow_distances(np.array([rows[i] for i in own], float))
        assert np.allclose([got[i].distance for i in own], want, rtol=1e-6)
    assert [got[i].kept for i in range(len(texts))] == [i < 150 and not got[i].base_failed for i in range(len(texts))]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() > 100
    assert quality.quality(table(spark, [])).count() == 0 and quality.keep_good(table(spark, [])).count() == 0


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) == len(good) > 100 and sum(bad) <= 0.1 * len(bad)


def test_quality_plan_stays_in_the_engine(spark, sf, capsys):
    quality.op5_quality(spark, sf).explain()
    sharding.op10_sharding(spark, sf).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><!-- <p>no</p> -->
<div class="page with-sidebar"><article class="post"><header class="entry-header"><h1>A &amp; B</h1></header>
<p><b>First  <i>part</i> of
 it.<br><p>Second&nbsp;one &lt;here&gt; with <a href="u">a link</a>.</p><ul><li>One<li>Two</ul>
<div class="advert">Buy</div><form><p>Mail us</p></form><aside>Side</aside><p>Last</article>
<section class="comments"><article class="comment"><p>Reader says a very long thing that is longer than all else on this page, really.</p></article></section></div>
<footer>&copy; us</footer></body></html>"""


def test_page_text():
    assert html.extract(PAGE) == "A & B\nFirst part of it.\nSecond one <here> with a link.\nOne\nTwo\nLast"


def test_unmarked_pages_go_by_density():
    body = "".join(f"<p>{'A longer sentence with many words in it. ' * 5}</p>" for _ in range(4))
    links = "".join(f"<li><a href=/{i}>Go to {i}</a></li>" for i in range(9))
    source = f"<body><div><ul>{links}</ul></div><div><div><h2>Head line</h2>{body}</div></div><div><span>Tiny</span></div></body>"
    got = html.extract(source).split("\n")
    assert got == ["Head line", *[("A longer sentence with many words in it. " * 5).strip()] * 4]
    assert html.extract("just text") == "just text" and html.extract("<p>one") == "one"


S = "Words of a sentence that go on for a while, and then some more."
PARAGRAPHS = "".join(f"<p>{S} {i}</p>" for i in range(3))
LINES = "\n".join(f"{S} {i}" for i in range(3))
NAV = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>Other</a></li></ul></nav>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f'<body><div id="header"><h1>Site</h1></div>{NAV}<div id="content"><h1>Head</h1>{PARAGRAPHS}</div><div class="sidebar">{PARAGRAPHS}</div><div id="comments">{PARAGRAPHS}</div></body>', f"Head\n{LINES}"),
        (f"<body>{NAV}<div class=post><h1>Head</h1><p>{S}</p></div><div class=ad>Buy this {S}</div><footer>{S}</footer></body>", f"Head\n{S}"),
        (f"<body><header>Site</header><main><h1>Head</h1><section><h2>A</h2>{PARAGRAPHS}</section><section><p>B</p></section><aside>{S}</aside></main></body>", f"Head\nA\n{LINES}\nB"),
        (f"<body><div><p>{S}</p><p>{S}</p></div><div>{PARAGRAPHS}</div></body>", f"{S}\n{S}\n{LINES}"),
        (f'<body><div><h1>Head</h1><div class="body">{PARAGRAPHS}</div></div></body>', f"Head\n{LINES}"),
        (f"<table><tr><td><a href=1>L1</a><br><a href=2>L2</a><br><a href=3>L3</a></td><td><h1>Head</h1>{PARAGRAPHS}</td></tr></table>", f"Head\n{LINES}"),
        (f"<article><p>a<button>Click</button> b<textarea>t</textarea></p><form><p>{S}</p></form></article>", "a b"),
        ("<article><p>H<sub>2</sub>O <!-- c -->&lt;b&gt; &#8364;&nbsp;end</p><div>text <p>in</p> tail</div></article>", "H2O <b> € end\ntext\nin\ntail"),
        (f'<article><h1>T</h1>{PARAGRAPHS}<div class="comment-list"><p>{S}</p></div><ul class="share-buttons"><li>Share</ul><div class="cookie-banner">{S}</div></article>', f"T\n{LINES}"),
    ],
)
def test_kinds_of_pages(source, text):
    assert html.extract(source) == text


LINKS = "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li><li><a href=3>Source three</a></li></ul>"
LONG = "".join(f"<p>{S} {S} {i}</p>" for i in range(5))
LONG_LINES = "\n".join(f"{S} {S} {i}" for i in range(5))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f'<body>{NAV}<article class="login-guide"><h1>T</h1>{PARAGRAPHS}</article></body>', f"T\n{LINES}"),
        (f'<body>{NAV}<article class="login"><h1>T</h1>{PARAGRAPHS}</article></body>', f"T\n{LINES}"),
        (f'<body>{NAV}<article class="post type-post tag-social-media">{PARAGRAPHS}</article></body>', LINES),
        (f"<body><article><h1>T</h1>{PARAGRAPHS}{LINKS}</article></body>", f"T\n{LINES}\nSource one\nSource two\nSource three"),
        (f"<body><main><article><h1>T</h1>{LONG}</article><article>{PARAGRAPHS}</article></main></body>", f"T\n{LONG_LINES}\n{LINES}"),
        (f"<body>{NAV}<article><h1>T</h1>{LONG}</article><article>{PARAGRAPHS}</article><footer>{S}</footer></body>", f"T\n{LONG_LINES}\n{LINES}"),
        (f'<body><div id="content"><h1>T</h1><p>{S}</p><div class="social-history">{PARAGRAPHS}</div></div></body>', f"T\n{S}\n{LINES}"),
        (f'<body><article><h1>T</h1><p class="notice-board">{S}</p><p>{S}</p></article></body>', f"T\n{S}\n{S}"),
        (f'<body><div class="content has-sidebar"><h1>T</h1>{PARAGRAPHS}<section id="discussion"><h2>D</h2>{PARAGRAPHS}</section><section id="related-work"><p>{S}</p></section></div></body>', f"T\n{LINES}\nD\n{LINES}\n{S}"),
        (f"<body><main><h1>T</h1>{LONG}<article class=teaser><p>Next</p></article></main></body>", f"T\n{LONG_LINES}\nNext"),
        (f"<body><div class=content><h1>T</h1>{LONG}</div><div><article><p>Next thing</p></article></div></body>", f"T\n{LONG_LINES}"),
        (f"<body><h1>T</h1><article>{PARAGRAPHS}</article></body>", f"T\n{LINES}"),
        (f"<body><main><h1>T</h1><article>{LONG}</article>{LINKS}</main></body>", f"T\n{LONG_LINES}"),
        (f"<body><form id=aspnet><header>Site</header><div id=main><h1>T</h1>{PARAGRAPHS}</div></form></body>", f"T\n{LINES}"),
        (f'<body>{NAV}<div class="ad">{S} {S}</div><article><h1>One</h1></article><div class="comments">{LONG}</div><footer>x</footer></body>', "One"),
        (f'<body>{NAV}<div class="ad">{S}</div><article><h1></h1></article></body>', ""),
        (f'<body><div id="comments">{PARAGRAPHS}</div></body>', LINES),
        (f'<body><div class="post">{LONG}<div class="post-footer">By me</div><div class="post-header"><p>Kicker</p></div><div id="ad-300x250">Buy</div><div class="siteNotice">N</div></div></body>', f"{LONG_LINES}\nKicker"),
    ],
)
def test_names_and_marks_do_not_outweigh_text(source, text):
    assert html.extract(source) == text


def test_a_long_page():
    paragraphs = [f"{S} {i}" for i in range(20_000)]
    source = f"<body>{NAV}<div>{''.join(f'<div class=sharing><div>{x}</div></div><div><p>{p}</p></div>' for x, p in zip('ab' * 10_000, paragraphs))}</div></body>"
    assert html.extract(source) == "\n".join(paragraphs)


def test_formulas_and_controls_in_sentences_stay():
    text = "A sentence of the main text that is long enough to matter here, with words."
    page = f"<body><form><label>Name</label><button>Go</button></form><article><p>{text} <math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math></p><xmp>a <b> &amp;</xmp><p>Tick <label>yes</label>.</p><div><label>Buy</label></div></article></body>"
    assert html.extract(page) == f"{text} x=\na <b> &amp;\nTick yes."


def test_sections_of_one_class_and_a_heading_of_its_own_block_stay():
    text = "A sentence of the main text that is long enough to matter here, with words."
    page = f"<body><div><h1>T</h1></div><div class=sec><p>{text}</p><p>{text}</p></div><div class=sec><p>{text}</p><p>{text}</p><p>{text}</p></div><div class='sec'><p>Short end.</p></div><div class=footer>foot</div></body>"
    assert html.extract(page) == "\n".join(["T", *[text] * 5, "Short end."])



def slow_text(tree):
    """The text that composite text density chooses of a tree of (tag, children), a child being a tree or a string; ``a``
    is the only inline element."""
    import math

    def count(node, link=False):  # characters, tags, link characters, link tags
        tag, kids = node
        c, t, lc, lt = 0, 0, 0, 0
        for k in kids:
            if isinstance(k, str):
                size = len(k.replace(" ", ""))
                c, lc = c + size, lc + size * (link or tag == "a")
            else:
                own = count(k, link or tag == "a")
                c, lc, lt, t = c + own[0], lc + own[2], lt + own[3] + (k[0] == "a"), t + own[1] + 1
        return c, t, lc, lt

    whole = count(tree)

    def dense(node):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        inner = 1 / max(lc / c, 0.05) / max(lt / max(t, 1), 0.05) + 1
        return c / max(t, 1) * math.log(inner) / math.log(math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e) + 1)

    blocks = lambda node: [b for k in node[1] if not isinstance(k, str) for b in ([k] if k[0] != "a" else blocks(k))]
    total = lambda node: sum(map(dense, blocks(node)))

    def every(node, path=()):
        yield node, path
        for b in blocks(node):
            yield from every(b, (*path, node))

    best = lambda node: max(every(node), key=lambda x: total(x[0]))[0]  # noqa: E731  the first of equals
    top, path = max(every(tree), key=lambda x: total(x[0]))
    least = min(map(dense, [top, *path]))
    chosen = [top]
    for up in path:
        for b in blocks(up):
            c, _, lc, _ = count(b)
            if b is not top and not any(b is p for p in path) and dense(b) >= least and not lc >= 0.7 * c > 0:
                chosen.append(best(b) if blocks(best(b)) else b)
    out: list[str] = []

    def lines(node, kept):
        kept = kept or any(node is x for x in chosen)
        run = ""
        for k in node[1]:
            if isinstance(k, str) or k[0] == "a":
                run += k if isinstance(k, str) else "".join(k[1])
            else:
                out.extend([" ".join(run.split())] * (kept and bool(run.strip())))
                run = ""
                lines(k, kept)
        out.extend([" ".join(run.split())] * (kept and bool(run.strip())))

    lines(tree, False)
    return "\n".join(out)


def test_density_equals_a_slow_version():
    import random

    r = random.Random(6)
    words = lambda: " ".join("w" * r.randint(1, 9) for _ in range(r.choice([1, 2, 8, 40])))

    def grow(depth):
        kids = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            kids.append(("a", [words()]) if kind < 0.2 else words() if kind < 0.4 or depth > 4 else (r.choice(["div", "section", "blockquote"]), grow(depth + 1)))
        return kids

    show = lambda node: node if isinstance(node, str) else f"<{node[0]}>{''.join(map(show, node[1]))}</{node[0]}>"
    seen = 0
    for _ in range(400):
        tree = ("body", [(r.choice(["div", "section"]), grow(0)) for _ in range(r.randint(2, 5))])
        want = slow_text(tree)
        assert html.extract(show(tree)) == want, show(tree)
        seen += len(re.sub(r"\s", "", want)) < len(re.sub(r"\s|<[^>]*>", "", show(tree)))
    assert seen > 50


@pytest.mark.parametrize("source", [None, "", "<", "<<<>>>", "<p", "<!--", "<script>x", "<a href='", "</div></p>", "<div>" * 3000, "<table><tr><td>", "&", "<p>&#x110000;&bogus;", "\x00<p>a"])
def test_broken_pages(source):
    assert isinstance(html.extract(source), str)


def test_pages_query(spark, sf):
    got = html.op6_html(spark, sf).collect()
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in got:
        article = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(html.entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, n_chars int")
    assert [(r.text, r.n_chars) for r in html.main_text(odd).collect()] == [("", 0)] * 3


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_shards_are_even_and_keep_texts_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.op10_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    sizes = check_shards(rows, 16)
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * min(sizes.values())
    where, group = defaultdict(set), Counter()
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
        group[texts[r.doc_id]] += r.size
    assert all(len(s) == 1 or group[t] > sum(sizes.values()) / 16 / 8 for t, s in where.items())
    assert sum(len(s) > 1 for s in where.values()) < 5


def test_shards_of_a_hot_text_nulls_and_nothing(spark):
    texts = [*ODD, *["hot text " * 20] * 900, *[f"text {i}" for i in range(600)]]
    ids = [None] * 300 + list(range(len(texts) - 300))
    rows = sharding.shard(table(spark, texts, ids), 4, 8).collect()
    assert len(rows) == len(texts)
    sizes = check_shards(rows, 4)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.shard(table(spark, [])).count() == 0
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_written_shards(spark, tmp_path):
    docs = table(spark, [f"text {i}" for i in range(40)])
    sharding.write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 40 and back.select("shard").distinct().count() == 4
    texts = [*(f"text {i}" for i in range(20)), *["same"] * 6, None, None, "", "a", "b"]
    ids = [*range(20), 7, 7, 7, None, None, 7, 8, 8, 8, 30, 30]
    sharding.write_shards(table(spark, texts, ids), f"{tmp_path}/t", 4)
    back = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/t").collect()]
    assert Counter(back) == Counter(zip(ids, texts))
