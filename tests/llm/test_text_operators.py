"""Quality, language, BPE, pages, licences: brute force, round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import html as html_lib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe, fertility, htmltext, langid, licences, queries, scripts

BPE = public_tokenizers.path("byte_bpe_50k.json")


# BPE


@pytest.fixture(scope="module")
def pair():
    return bpe.ByteBPE(BPE), Tokenizer.from_file(BPE)


TEXTS = ["", " ", "a", "Hello, world!", "  two  spaces\n\n\ttab ", "don't we'll I've", "naïve café – 漢字かな 한국어 😀", "<|endoftext|>x<|endoftext|><|endof", "\x00\x1c\x85 　 ", "՘࢏ա", "1234 ٣٤ Ⅷ²", "x" * 3000, "ab" * 2000 + " the", "'S 'sé"]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(pair, text):
    own, lib = pair
    ids = own.encode(text.encode())
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_bpe_on_random_texts(pair):
    own, lib = pair
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x250)] + ["the", " and", "ing", "\n\n", "  ", "漢", "😀", "\U000e0041", "<|endoftext|>", "'re"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text.encode()) == e.ids
        assert own.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    small, large = bpe.ByteBPE(BPE), bpe.ByteBPE(BPE)
    text = " ".join(f"word{i % 7} other{i}" for i in range(200)).encode()
    assert small.encode(text) == large.encode(text)


def test_bpe_frames(spark):
    rows = [(1, "Hello <|endoftext|>"), (2, None), (2, ""), (3, "é" * 50), (3, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    got = bpe.round_trip(df, BPE).collect()
    lib = Tokenizer.from_file(BPE)
    for (key, text), r in zip(rows, got, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert tuple(r) == (key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    coded = bpe.encode(df.select("doc_id", "text"), BPE)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "restored"] and coded.where("not restored").count() == 0
    assert [r["text"] for r in bpe.decode(coded, BPE).collect()] == [t or "" for _, t in rows]
    assert bpe.round_trip(df.where("false"), BPE).count() == 0 and bpe.encode(df.select("doc_id", "text").where("false"), BPE).count() == 0


# quality


def base_values(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


QUALITY_TEXTS = [None, "", "  \n ", "one", "a b c a b c", "x\ny\nx\n\n \n \nx", "a b c d a b c", "é ü # $ %%", "w " * 60, "a\x0bb\x0cc", "p q r s p q r s t", "中文 字 <b> & | *"]


def test_base_values(spark):
    rng = random.Random(2)
    texts = QUALITY_TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "kept": F.lit("clash")})
    got = {r["doc_id"]: r for r in fertility.quality(df, queries.FERTILITY).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, symbols, dup, repeated = base_values(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated), t
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["base_failed"] and r["kept"])
    assert fertility.quality(df.where("false"), queries.FERTILITY).count() == 0


def prose(rng, n, syllables=("the", "an", "er", "ing", "ed", "on", "re", "st", "at", "or")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_bands_reject_what_is_unlike_the_language(spark):
    rng = random.Random(3)
    good = [prose(rng, rng.randrange(60, 400)) for _ in range(300)]
    bad = [" ".join(f"{w}{rng.choice(['###', '$$$', '%%%'])}" for w in prose(rng, 200).split()) for _ in range(10)] + [" | ".join(prose(rng, 150).split()) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: r["kept"] for r in fertility.quality(df, queries.FERTILITY).collect()}
    assert sum(got[i] for i in range(300)) >= 298 and not any(got[i] for i in range(300, 320))
    alone = fertility.quality(df.where("doc_id < 20"), queries.FERTILITY)
    assert alone.where("kept").count() == 20


def plain_measures(text):
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.FERTILITY[0])
    with open(queries.FERTILITY[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("plain", pat_str=queries.FERTILITY[2], mergeable_ranks=ranks, special_tokens={})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tokens = [i for w in words for i in pieces.encode(w)]
    in_bytes = sum(len(own.encode_ordinary(" " + w)) for w in words)
    chars, m = sum(map(len, words)), len(tokens)
    same = sum(c * (c - 1) for c in Counter(tokens).values())
    return {
        "chars_per_token": chars / m, "bytes_chars_per_token": chars / in_bytes, "tokens_per_word": m / len(words),
        "byte_share": sum(map(pieces.is_byte, tokens)) / m, "token_entropy": math.log2(m * (m - 1) / max(same, 1)),
    }


def test_measures_and_bands_against_a_plain_version(spark):
    rng = random.Random(12)
    rows = [(prose(rng, rng.randrange(50, 300)), "xx") for _ in range(120)]
    rows += [(prose(rng, rng.randrange(50, 300), ("ka", "\u010de", "zo", "mi")), "yy") for _ in range(12)]  # a rare language
    rows += [("\u0436\u0443\u043a " * 3 + prose(rng, 60, ("\u0431\u0430", "\u0434\u043e", "\u0442\u0438", "\u043b\u044e")), None) for _ in range(5)]  # a rare script, no language
    rows += [(" ".join(w + "\U00012000" * 2 for w in prose(rng, 80).split()), "xx"), (" ".join(prose(rng, 90).upper()), "xx"), (" ".join(w + "%%%" for w in prose(rng, 100).split()), "yy")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.quality(df.repartition(5), queries.FERTILITY).collect()}
    plain = [plain_measures(t) for t, _ in rows]
    for i, p in enumerate(plain):
        assert all(abs(got[i][k] - v) < 1e-9 for k, v in p.items()), i
    good = [i for i in got if not got[i]["base_failed"]]

    def quartiles(ids, m, to, apart):
        to = [to[1] + apart * (x - to[1]) for x in to]
        if not ids:
            return to
        values = sorted(math.floor(plain[i][m] / 0.001 + 0.5) for i in ids)
        own = [0.001 * next(v for k, v in enumerate(values, 1) if k >= p * len(values)) for p in (0.25, 0.5, 0.75)]
        weight = 25**2 / (len(ids) ** 2 + 25**2)
        return [x + weight * (y - x) for x, y in zip(own, to)]

    for i in good:
        reasons = []
        for m, (low, high, least) in fertility.BANDS.items():
            q = quartiles(good, m, fertility.PRIOR[m], 1)
            q = quartiles([j for j in good if got[j]["script"] == got[i]["script"]], m, q, 8)
            q = quartiles([j for j in good if rows[j][1] == rows[i][1] is not None], m, q, 3)
            spread = math.sqrt(1 + 200 / got[i]["n_words"])
            x = plain[i][m]
            if x < q[1] - max(low * (q[2] - q[0]), least) * spread or x > q[1] + max(high * (q[2] - q[0]), least) * spread:
                reasons.append(m)
        assert got[i]["reasons"] == reasons and got[i]["kept"] == (not reasons), (i, reasons)
    assert "byte_share" in got[137]["reasons"] and not got[138]["kept"]
    assert sum(got[i]["kept"] for i in range(137)) >= 135


def test_very_long_and_broken_texts_are_measured(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(1, bytearray(prose(rng, 200_000).encode()), "xx"), (2, bytearray(b"ab\xff\xfe cd \xe2\x82 " * 40), "xx")], "doc_id long, b binary, lang string")
    df = df.select("doc_id", F.col("b").cast("string").alias("text"), "lang")
    got = {r["doc_id"]: r for r in fertility.quality(df, queries.FERTILITY).collect()}
    assert got[1]["n_words"] == 200_000 and got[2]["n_words"] == 120 and got[2]["word_chars"] == 40 * (4 + 2 + 1)
    assert {r["doc_id"] for r in langid.identify(df, langid.train(df)).collect()} == {1, 2}
    coded = {r["doc_id"]: r for r in bpe.encode(df.where("doc_id = 2"), queries.BYTE_BPE).collect()}
    assert coded[2]["n_tokens"] > 0 and not coded[2]["restored"]
    assert htmltext.extract(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))).count() == 2


# languages

SYLLABLES = {"aa": ("the", "ing", "and", "wh", "ly", "ed"), "bb": ("ción", "que", "los", "ñ", "ado", "es"), "cc": ("ich", "sch", "ung", "der", "ein", "ß")}


def language_rows(n=240, seed=4):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randrange(20, 120), SYLLABLES[lang]), lang) for i, lang in ((i, sorted(SYLLABLES)[i % 3]) for i in range(n))]


def test_held_out_accuracy_and_spans(spark):
    rows = language_rows()
    rng = random.Random(5)
    mixed = prose(rng, 40, SYLLABLES["aa"]) + " " + prose(rng, 80, SYLLABLES["bb"])
    extra = [(1000, mixed, None), (1001, None, "aa"), (1002, "", "aa"), (1003, "123 ... 456", "bb"), (1004, "Русский текст совсем", None), (1000, mixed, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "t": F.lit(1)})
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [s["lang"] for s in got[1000]["spans"]] == ["aa", "bb"] and abs(got[1000]["spans"][1]["first_word"] - 40) <= 3
    assert got[1000]["lang_pred"] == "bb" and got[1000]["score"] < 0.95
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[1004]["lang_pred"] in SYLLABLES
    assert langid.identify(docs, model).count() == len(rows) + len(extra)
    assert langid.identify(docs.where("false"), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    r = langid.identify(docs, langid.train(docs)).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_marks_belong_to_their_words(spark):
    assert langid.runs_of("हिन्दी भाषा, ภาษาไทย! Café cafe\u0301 \u0301 x2") == ["हिन्दी", "भाषा", "ภาษาไทย", "café", "cafe\u0301", "\u0301", "x"]
    assert langid.runs_of("ab" * 40) == ["ab" * 16, "ab" * 16, "ab" * 8]
    hindi, marathi = "यह हिन्दी भाषा में लिखा गया है और बहुत छोटा है", "हे मराठी भाषेत लिहिले आहे आणि फार लहान आहे"
    rows = [(i, hindi, "hi") for i in range(30)] + [(100 + i, marathi, "mr") for i in range(30)] + [(200, "\u0301\u0302", None), (201, "भाषेत आहे आणि लहान", None), (202, "यह भाषा बहुत छोटा है", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["spans"]) for r in langid.identify(df, langid.train(df.where("lang is not null"))).collect()}
    assert got[200] == ("und", []) and got[201][0] == "mr" and got[202][0] == "hi"
    assert [(s["first_word"], s["last_word"]) for s in got[202][1]] == [(0, 4)]


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "\u00bd \u00b2 \u2460 \u2167"), (1, "\u00bd the ing wh"), (2, " ".join(["the\u00b2"] * 3))], "doc_id long, text string")
    model = langid.train(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert (got[0]["lang_pred"], got[0]["score"], got[0]["spans"]) == ("und", 0.0, [])
    assert [(s["lang"], s["first_word"], s["last_word"]) for s in got[1]["spans"]] == [("aa", 0, 2)] and got[2]["lang_pred"] == "aa"


def test_rare_languages_among_many_are_learned(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03}": tuple("".join(rng.choice(letters) for _ in range(3)) for _ in range(6)) for i in range(230)}
    rows = [(len(own) * k + i, prose(rng, 40, own[v]), v) for i, v in enumerate(own) for k in range(3 if i % 2 else 1)]
    rows += [(100_000 + i, prose(rng, 200, own["l000"]), "l000") for i in range(300)]  # one holds a third of all words and more
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(own)
    fresh = spark.createDataFrame([(i, prose(rng, 25, own[v])) for i, v in enumerate(own)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(fresh, model).collect()}
    assert sum(got[i] == v for i, v in enumerate(own)) >= 228


def test_a_very_long_text_and_rows_without_keys(spark):
    docs = spark.createDataFrame([(None, t, v) for _, t, v in language_rows()], "doc_id long, text string, lang string")
    model = langid.train(docs, sample_rows=20)
    rng = random.Random(2)
    texts = spark.createDataFrame([(None, prose(rng, 150_000, SYLLABLES["cc"])), (None, prose(rng, 30, SYLLABLES["bb"]))], "doc_id long, text string")
    assert sorted(r["lang_pred"] for r in langid.identify(texts, model).collect()) == ["bb", "cc"]


def test_viterbi_against_dynamic_programming():
    import numpy as np

    rng = np.random.default_rng(6)
    lengths = np.array([1, 7, 3, 20, 1])
    scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    start, penalty = np.zeros(3), 1.5
    got = langid.viterbi(scores, lengths, start, penalty)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value, back = s[0].astype(float), []
        for t in range(1, n):
            step = value[:, None] - penalty * (1 - np.eye(3))
            back.append(step.argmax(0))
            value = step.max(0) + s[t]
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        total = lambda p: sum(s[t, p[t]] for t in range(n)) - penalty * sum(p[t] != p[t - 1] for t in range(1, n))
        assert abs(total(path) - total(list(got[at : at + n]))) < 1e-4
        at += n


def test_scripts():
    assert [scripts.word_script(w) for w in ("1abc", "Ж", "漢字", "...", "é", "ᏣᎳᎩ")] == ["latin", "cyrillic", "han", None, "latin", "other"]


# pages

ARTICLE = "<article><h1>Title</h1><p>First paragraph with <b>bold</b> words &amp; more.</p><p>Short.</p></article>"
CASES = {
    "": "",
    "plain &lt;b&gt; text": "plain <b> text",
    f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>menu</li></ul></nav>{ARTICLE}<footer>&copy; 2020</footer></body></html>": "Title\nFirst paragraph with bold words & more.\nShort.",
    f"<script>var a='<article>no</article>';</script>{ARTICLE}<aside>side</aside>": "Title\nFirst paragraph with bold words & more.\nShort.",
    "<article><p>one</p><div class='ad-box'>buy <p>now</p></div><p>two<br>three&nbsp;four</p><section class='comments'><article><p>nice</p></article></section></article>": "one\ntwo three four",
    "<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>Body</p></article>": "Head\nBody",
    "<nav><ul><li>menu<article><p>unclosed menu</p></article>": "unclosed menu",
    "<article><p>never closed<p>second": "never closed\nsecond",
    "<article><!-- <p>hidden</p> --><p a='x>y'>shown</p></article>": "shown",
    "<div id='cookie-notice'>We use cookies</div><div class='content'><p>" + "long text " * 20 + "</p><p>end.</p></div><div class='sidebar'>links</div>": ("long text " * 20).strip() + "\nend.",
    "<article><form><label>name</label><input></form><p>kept</p></article>": "kept",
}


@pytest.mark.parametrize("page", list(CASES))
def test_main_text(page):
    assert htmltext.main_text(page) == CASES[page]


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.extract(pages.withColumns({"text": F.lit("clash"), "n_chars": F.lit(0)})).collect()}
    for r in pages.collect():
        article = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = (" ".join(html_lib.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1|article)>", article))
        text = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]


def article_of(page):
    blocks = re.split("</?(?:p|h1|article)>", page[page.index("<article>") : page.index("</article>")])
    plain = (" ".join(html_lib.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_pages_without_marks_or_furniture(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    unmarked = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    assert [htmltext.main_text(p) for p in unmarked] == [article_of(p) for p in pages]
    # menus that only their links give away, and no advert
    bare = [re.sub(r'<div class="ad">.*?</div>', "", re.sub(r"<(/?)(nav|ul)\b", r"<\1div", p), flags=re.S) for p in unmarked]
    assert [htmltext.main_text(p) for p in bare] == [article_of(p) for p in pages]


def plain_runs(sizes, surge):
    """Runs between at least WINDOW zeros, with a window that reaches the surge, without zeros at the ends."""
    runs, own = [], []
    for i, n in enumerate([*sizes, *[0] * htmltext.WINDOW]):
        own.append(i)
        if n == 0 and len(own) >= htmltext.WINDOW and not any(i < len(sizes) and sizes[i] for i in own[-htmltext.WINDOW :]):
            full = [i for i in own if i < len(sizes) and sizes[i]]
            if full and any(sum(sizes[j : j + htmltext.WINDOW]) >= surge for j in range(full[0], full[-1] + 1)):
                runs.append((full[0], full[-1] + 1))
            own = []
    return runs


def test_surges_and_dives_against_a_plain_version():
    rng = random.Random(4)
    for _ in range(2000):
        sizes = [rng.choice([0, 0, 0, 3, 20, 150, 700]) for _ in range(rng.randrange(0, 30))]
        peak = max((sum(sizes[i : i + htmltext.WINDOW]) for i in range(len(sizes))), default=0)
        surge = min(htmltext.SURGE, htmltext.SURGE_SHARE * peak)
        assert htmltext.between_dives(sizes) == (plain_runs(sizes, surge) if peak else [])


LINKS = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(5))
BODY = "<h1>Title</h1><p>Short one.</p><p>Short two.</p><p>" + "x" * 300 + "</p><table><tbody><tr><td>cell</td></tr></tbody></table></div></div><div><p>The end.</p>"


def test_short_blocks_of_an_unmarked_page(monkeypatch):
    page = f"<div>A small site</div><ul>{LINKS}</ul><div>{BODY}</div><ul>{LINKS}</ul><div>Imprint and contact</div>"
    text = "Title\nShort one.\nShort two.\n" + "x" * 300 + "\ncell\nThe end."
    assert htmltext.main_text(page) == text
    with monkeypatch.context() as m:  # the thresholds decide
        m.setattr(htmltext, "SURGE", 15)
        assert htmltext.main_text(page) == f"A small site\n{text}\nImprint and contact".replace("A small site\n", "")
        m.setattr(htmltext, "SURGE", 10)
        assert htmltext.main_text(page) == f"A small site\n{text}\nImprint and contact"
    with monkeypatch.context() as m:
        m.setattr(htmltext, "WINDOW", 6)
        assert "link 0" in htmltext.main_text(page)


TEXT = "".join(f"<p>Paragraph {i} {'of a long text ' * 25}</p>" for i in range(3))
PLAIN = "\n".join(" ".join(p.split()) for p in re.findall("<p>(.*?)</p>", TEXT))


@pytest.mark.parametrize("around", [
    '<div class="content no-sidebar">{}</div>', '<article class="post tag-search category-social">{}</article>', '<div id="search-page-main">{}</div>', '<article><section id="related-work">{}</section></article>',
    '<div class="search">{}</div>', '<form id="aspnetForm"><div class="site-wrapper">{}</div></form>', '<div class="overlay"><div class="modal"><div class="popup-content">{}</div></div></div>',
    '<div class="comments">{}</div>', '<div hidden>{}</div>', '<article><div class="social widget">{}</div></article>', '<div role="dialog">{}</div><div class="cookie-notice">We use cookies</div>',
    '<div class="ad">Buy now</div><div class="sidebar">{}</div><div class="footer-links">some words</div>', "<div class='ad'>" * 30 + "{}" + "</div>" * 30,
])
def test_names_alone_take_no_article(around):
    assert htmltext.main_text(f"<html><body><nav><a>menu</a></nav>{around.format(TEXT)}<footer>imprint</footer></body></html>") == PLAIN


@pytest.mark.parametrize("beside", [
    f"<article>{TEXT}</article><div class='comments'>{'<p>nice words</p>' * 400}</div>", f"<article>{TEXT}<div class='comments'>{'<p>nice words</p>' * 400}</div></article>",
    f"<article>{TEXT}</article><div class='sidebar'>{'<p>many more words</p>' * 400}</div>", f"<div class='content'>{TEXT}</div><div class='ad-box'>{'<p>buy now</p>' * 400}</div>",
    f"<article>{TEXT}<form><p>{'label ' * 100}</p></form></article>", f"<div>{TEXT}</div><ul class='related-posts'>{'<li>other</li>' * 20}</ul>",
])
def test_long_company_is_stripped(beside):
    assert htmltext.main_text(beside) == PLAIN


def test_teasers_in_articles_do_not_hide_the_body():
    body = "<p>" + "y" * 900 + "</p>"
    assert htmltext.main_text(f"<div>{body}</div><article><a>More</a></article>") == "y" * 900


def test_page_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<p>" + "x" * 100_000), (2, "u", "<p>" + "x" * 100_000), (None, "u", "<<<>&#0;&bogus;")], "page_id long, url string, html string")
    got = htmltext.extract(df).collect()
    assert [r["n_chars"] for r in got[:4]] == [0, 0, 100_000, 100_000] and len(got) == 5
    assert htmltext.extract(df.where("false")).count() == 0


def test_long_line_of_quotes():
    assert htmltext.main_text("<a title=\"" * 2000) is not None


# licences


def plain_windows(text, named=licences.TEMPLATES):
    """Matching windows at all places where a bigram of a template lies, then the best of every chain of overlaps, twice."""
    grams = lambda t: set(zip(t, t[1:]))
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = []
    for name, template in sorted(named.items()):
        t = re.sub(r"[\W_]+", " ", template.lower()).split()
        hits = {p - o for p in range(len(words) - 1) for o in range(len(t) - 1) if words[p : p + 2] == t[o : o + 2]}
        for s in {max(min(h, len(words) - len(t)), 0) for h in hits}:
            w = words[s : s + len(t)]
            shared, size = len(grams(w) & grams(t)), len(grams(w)) + len(grams(t))
            if shared and 200 * shared >= 80 * size:
                found.append((s, s + len(w) - 1, name, 2 * shared / size, shared, len(grams(w))))

    def best(windows):
        chains, end = [], -1
        for w in sorted(windows):
            if not chains or w[0] > end:
                chains.append([])
            chains[-1].append(w)
            end = max(end, w[1])
        return [min(c, key=lambda w: (-w[4], -w[3], w[0], w[2])) for c in chains]

    return best([w for name in named for w in best([f for f in found if f[2] == name])])


def test_licences_against_brute_force(spark):
    mit = licences.TEMPLATES["mit/notice"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rng = random.Random(6)
    edited = " ".join(rng.choice(["foo", "bar"]) if rng.random() < 0.05 else w for w in licences.TEMPLATES["bsd/disclaimer"].split())
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + licences.TEMPLATES["apache-2.0/notice"].split("LICENSE-2.0 ")[1]
    texts = [None, "", "x", "Released under the MIT License.", "Released under MIT License", "Intro\nLicensed under CC BY-NC 4.0.\nmore words here", "preamble text\n\n" + wrapped + "\n\nafter", wrapped.upper(), "All rights reserved. " * 3, "ALL RIGHTS RESERVED", "word " * 5000, "Licensed under the BSD 3-Clause License.\nLicensed under the BSD 3-Clause License."]
    texts += ["Copyright (c) 2021 Foo. Released under the MIT License. See LICENSE for details.", "One says that " + edited + " and then goes on. All rights reserved by all.", "/*\n" + apache + "\n*/", prose(rng, 30_000) + " Released under the MIT License. " + prose(rng, 100)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])], "doc_id long, text string").withColumns({"license": F.lit("clash"), "row": F.lit(1), "w": F.lit("x")})
    order = lambda rows: sorted(rows, key=repr)
    got = order((r["doc_id"], r["first_word"], r["last_word"], r["license"], r["dice"], r["n_shared"], r["n_bigrams"]) for r in licences.scan(df).collect())
    expected = [(i, *w) for i, t in [*enumerate(texts), (3, texts[3]), (None, texts[3])] for w in plain_windows(t or "")]
    assert got == order(expected) and len(got) > 14
    found = {i: {w[2] for w in plain_windows(texts[i])} for i in (12, 13, 14, 15)}
    assert found == {12: {"mit/line"}, 13: {"bsd/disclaimer", "all-rights-reserved"}, 14: {"apache-2.0/notice"}, 15: {"mit/line"}}
    assert licences.scan(df.where("false")).count() == 0
