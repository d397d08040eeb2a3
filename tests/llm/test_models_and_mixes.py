import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from profileloom.llm.components import connected_components
from profileloom.llm import html_extract as HE
from profileloom.llm import jaccard
from profileloom.llm.html_extract import extract_text, parse_page, parsed_pages, style_tree, unimportant
from profileloom.llm.language_id import identify_languages, learn
from profileloom.llm.mixture import mix_sources, mixed_texts, row_key
from profileloom.llm.queries import MODEL_PATH, URL_RULES
from profileloom.llm.sentencepiece_codec import Codec, SentencePiece, Vocabulary, encode_documents, read_vocabulary
from profileloom.llm.simhash import bit_planes, fingerprint_links, first_of_near_copies, within_radius
from profileloom.llm.url_filter import judge_urls
from pyspark.sql import functions as F
from text_rows import ascii_lower


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_urls(spark):
    urls = ["http://A.Example.COM/en/77?x", "https://example.com/en/8", "com/en/", None, "x://com/en/", "https://xcom/en/", "http://b.net/de/1#t", "http://example.net/de/81", "http://example.net/de", "ftp://o.org/es/", "http://u@h.org:80/es/", "://", "http://example.com?u=http://q.org/es/"]
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[0], "h", "r")] * 2, "page_id long, url string, host string, rule string")
    rows = rows.union(spark.createDataFrame([(2**53 + 1, "http://a.com/" + "en/" * 5000, "h", "r")], rows.schema)).coalesce(1)

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in URL_RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.action if best else "allow"

    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows, URL_RULES).collect())
    assert got == Counter((r.page_id, *brute(r.url)) for r in rows.collect())
    assert judge_urls(rows.limit(0), URL_RULES).collect() == []


def brute_phrases(text, word):
    """Phrases of the greedy parse of a word into longest parts of a text; a code point it lacks is one."""
    n = 0
    while word:
        k = 1
        while k < len(word) and word[: k + 1] in text:
            k += 1
        word, n = word[k:], n + 1
    return n


def test_cross_parsing_by_brute_force(monkeypatch):
    import math
    import random

    from profileloom.llm import language_id as L

    texts = {"x": " abc abx abcd the theatre ", "y": " dcba xba bca ette eht é "}
    model = L.LanguageModel(texts)
    rng = random.Random(3)
    words = ["abc abx", "The theatre, 12 abcd!", "zz Zab", "É é ½ ② x", "a", *("".join(rng.choice("abcdtheé xyzß.") for _ in range(200)) for _ in range(20)), "12 ½ ² ①", ""]
    for piece in (4096, 7):
        monkeypatch.setattr(L, "PIECE", piece)
        for text, (lang, score) in zip(words, model.predict(words), strict=True):
            run = L.running_text(text)
            if not run:
                assert (lang, score) == ("und", 0.0)
                continue
            line, pieces = f" {run} ", []
            while line:
                end = len(line) if len(line) <= piece else max((k + 1 for k in range(1, piece) if line[k] == " "), default=piece)
                pieces.append(line[:end])
                line = line[end:]
            n = sum(map(len, pieces))
            assert n == len(run) + 2
            want = sorted((sum(brute_phrases(t, p) for p in pieces) * math.log2(len(t)) / n, k) for k, t in texts.items())
            assert lang == want[0][1] and abs(score - (want[1][0] - want[0][0]) / want[1][0]) < 1e-12


def test_languages(spark, sf_dir, docs, no_docs):
    got = identify_languages(real(spark, sf_dir)).collect()
    truth = {r.doc_id: r for r in real(spark, sf_dir).collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in judged) >= 0.95 * len(judged)
    rows = identify_languages(docs).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 11, 20)} == {"und"}
    assert identify_languages(no_docs).collect() == []
    assert {r.lang_pred for r in identify_languages(docs.where("lang is null")).collect()} == {"und"}
    assert set(learn(docs)) <= {"en", "fr", "de"}
    assert all(len(t) <= 40_000 + 40 for t in learn(real(spark, sf_dir)).values())


def water(sizes, weights, total, limit):
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    rest = total
    while free and rest > 1e-9:
        w = sum(weights[s] for s in free)
        for s in free:
            target[s] += rest * weights[s] / w
        rest = 0.0
        for s in list(free):
            if target[s] >= limit * sizes[s]:
                rest += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("which", ["real", "docs"])
def test_mixture(spark, sf_dir, docs, which):
    df = real(spark, sf_dir) if which == "real" else docs
    block = 128 if which == "real" else 4
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    got = mix_sources(df, block=block).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in got) == Counter((i, n, sizes[s], round(target[s], 4)) for i, s, n in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.round_1 + r.round_2
        taken[r.source_size, round(r.target, 4)] += r.taken
    for s in order:
        assert abs(taken[sizes[s], round(target[s], 4)] - sum(target[x] for x in order if (sizes[x], round(target[x], 4)) == (sizes[s], round(target[s], 4)))) <= 1
    again = mix_sources(df.repartition(3), block=block).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_small_sources_give_their_targets(spark):
    """Sources far under a block beside a large one: each gives its target, to the word."""
    rows = [(k, f"{'w ' * 5}{k}", f"s{k}") for k in range(30)] + [(100 + k, "word " * 400, "large") for k in range(50)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.doc_id if r.doc_id < 100 else 100] += r.taken
        target[r.doc_id if r.doc_id < 100 else 100] = r.target
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in target) and len(target) == 31


def test_mix_by_brute_force(spark, docs):
    """Sources as long rows of words by the hash of the row; each gives the first words of its row, round after round."""
    block = 4
    for df in (docs, docs.union(docs.where("doc_id in (1, 9) or doc_id is null"))):
        keyed = df.select("doc_id", "source", F.xxhash64(row_key(), F.lit(42)).alias("h"), row_key().alias("row"), F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")).alias("n")).collect()
        sizes = Counter()
        for r in keyed:
            sizes[r.source] += r.n
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        target = water(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
        want = Counter()
        buckets = 256
        for s in order:
            line = sorted((r.h % buckets, r.h, r.row, r.doc_id, r.n) for r in keyed if r.source == s)
            give, at = round(target[s]), 0
            for _, _, _, i, n in line:
                rounds = [max(0, min(n, give - k * sizes[s] - at)) for k in range(2)]
                want[i, n, *rounds] += 1
                at += n
        assert Counter((r.doc_id, r["size"], r.round_1, r.round_2) for r in mix_sources(df, block=block).collect()) == want


def test_mixed_texts(spark, docs, no_docs):
    out, plan = mixed_texts(docs, block=4), mix_sources(docs, block=4)
    assert out.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in plan.collect())
    assert mix_sources(no_docs).collect() == [] and mixed_texts(no_docs).collect() == []


def page(k, body, lang="en"):
    return f"<html><head><title>t{k} &amp; x</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='has-sidebar'>{body}</body></html>"


def test_html(spark):
    site = "<header><h2>Site</h2></header><nav><a>Home</a></nav><div id='main-nav'>Menu</div><div class='cookie-notice'>We use cookies</div>"
    foot = "<div class='sidebar'>Side</div><div class='box'>Follow us all day</div><section id='comments'><article class='comment'><p>Nice!</p></article></section><form><p>Mail</p></form><footer>&copy; x</footer>"
    rows = []
    for k in range(30):
        rows.append((k, f"http://plain.org/{k}", page(k, f"{site}<div class='content'><h1>Title {k}</h1><p><b>Text  of\n page {k}<br>second &lt;line&gt; {k * 7}<p>More words {k}&nbsp;end</div>{foot}")))
    rows += [
        (100, "http://one.org/", page(0, f"{site}<article><header><h1>Head</h1></header><p>Body <i>text</i></p><ul><li>one<li>two</ul></article>{foot}")),
        (101, None, None),
        (102, "nourl", ""),
        (103, "http://plain.org/x", "just text & no markup <"),
        (None, "http://a.org", "<p>a<p>b<!-- c <p>d"),
        (104, "http://a.org", "<p hidden>x</p><div role=main><p>In</p></div><p>Out</p><script>never closed <p>z"),
    ]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, low int")
    got = {r.page_id: r for r in extract_text(df).collect()}
    for k in range(30):
        assert got[k].text == f"Title {k}\nText of page {k} second <line> {k * 7}\nMore words {k} end"
    assert got[100].text == "Head\nBody text\none\ntwo"
    assert got[101].text == got[102].text == "" and got[103].text == "just text & no markup <"
    assert got[None].text == "a\nb" and got[104].text == "In" and got[100].n_chars == len(got[100].text)
    assert extract_text(df.limit(0)).collect() == []


def brute_tree(rows):
    """Importance of element and content nodes, from the pages' nodes and blocks, by recursion."""
    import math

    styles, held, up, leaf, size, done = defaultdict(dict), defaultdict(set), {}, defaultdict(lambda: True), {}, {}
    for r in rows:
        for n in r.nodes:
            styles[n.path][r.sign] = min(n.style, styles[n.path].get(r.sign, n.style))
            up[n.path], leaf[n.path] = n.up, leaf[n.path] and n.leaf
        for b in r.blocks:
            held[b.path, b.content].add(r.sign)
            size[b.content] = len(b.text.encode())
    contents = {}
    for (p, c), signs in held.items():
        m = len(styles[p])
        contents[c] = m, 1 - math.log(len(signs)) / math.log(m) if m > 1 else 1.0

    def weigh(p):
        parts = [(len(s) * size[c], contents[c][1]) for (q, c), s in held.items() if q == p] + [weigh(q) for q, u in up.items() if u == p]
        weight = sum(w for w, _ in parts)
        mean = sum(w * i for w, i in parts) / weight if weight else 1.0
        m, uses = len(styles[p]), Counter(styles[p].values())
        shape = -sum(k / m * math.log(k / m, m) for k in uses.values()) if m > 1 else 1.0
        kept = 0.9 ** len(uses)
        done[p] = m, mean if leaf[p] else (1 - kept) * shape + kept * mean
        return weight, done[p][1]

    for p, u in up.items():
        if u is None:
            weigh(p)
    return done, contents


def test_style_tree_by_brute_force(spark, monkeypatch):
    """Sites without article or telling names: the tree finds what they repeat, and a side branch with a changing part."""
    rows = []
    for k in range(12):
        side = f"<div class='left'><p>Our friends and partners, all of them named here at length</p><p>More of the same, every day</p><p>{k}</p></div>"
        main = "".join(f"<p>Paragraph {j} of the story {k} is told only here</p>" for j in range(1 + k % 3))
        rows.append((k, f"http://only.tree/{k}", f"<body><div class='top'>The same line on top</div>{side}<div class='mid'>{main}<p>All rights are kept</p></div></body>"))
    rows += [(50 + k, f"http://two.pages/{k}", f"<body><div>Same</div><div>Other {k}</div></body>") for k in range(2)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    parsed = parsed_pages(df)
    elements, contents = style_tree(parsed)
    want_elements, want_contents = brute_tree(parsed.collect())
    near = lambda xs: {k: (m, round(i, 9)) for k, (m, i) in xs.items()}
    assert near({r.path: (r.pages, r.importance) for r in elements.collect()}) == near(want_elements)
    assert near({r.content: (r.pages, r.importance) for r in contents.collect()}) == near(want_contents)
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    for k in range(12):
        assert got[k] == "\n".join(f"Paragraph {j} of the story {k} is told only here" for j in range(1 + k % 3))
    assert got[50] == "Same\nOther 0"
    monkeypatch.setattr(HE, "BROADCAST_NODES", 0)
    assert {r.page_id: r.text for r in extract_text(df).collect()} == got
    assert unimportant(elements, contents).count() > 0


@pytest.mark.parametrize("part", ["<div>", "<a '", "<a '>'", "<p><b><i>", "<b><i></b>", "<!-- ", "<script>", "</div>", "<", "<ul><li><span>", '<a b="', "<table><tr><td></p>", "<head>", "<a b=c "])
def test_pages_of_broken_markup_are_parsed_in_linear_time(part):
    import time

    def took(size):
        began = time.process_time()
        parse_page(part * (size // len(part)) + "<p>end")
        return time.process_time() - began

    assert took(800_000) < 9 * took(200_000) + 0.2


def test_html_repeats_and_long_pages(spark):
    """Repeated rows give repeated results, and whole texts come through, however long."""
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "http://a.b/1", f"<article><p>{long}</p></article>")] * 3 + [(None, None, "<p>x &amp; y</p>")] * 2
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter({(1, long): 3, (None, "x & y"): 2})


def test_html_on_pages(spark, sf_dir):
    got = {r.page_id: r.text for r in extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        words = re.sub(r"<[^>]*>", " ", inner)
        import html

        assert got[r.page_id].split() == html.unescape(words).split()


def test_codec_equals_the_library(spark, sf_dir, docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    codec = Codec(read_vocabulary(MODEL_PATH))
    texts = [r.text for r in real(spark, sf_dir).collect()] + ["", " ", "  a   b  ", "①x\x00é", "a" * 500, "=" * 77 + " " * 99, "日本語のテキスト、العربية, Ελληνικά 😀👍🏽", "tab\tand\nline\r\n"]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == model.encode(t) and codec.decode(ids) == t
    got = encode_documents(docs, MODEL_PATH).collect()
    want = Counter((r.doc_id, tuple(model.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    model_columns = SentencePiece(spark, MODEL_PATH)
    back = model_columns.decode(model_columns.encode(docs.select("doc_id", "text"), "text", "ids"), "ids", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in back) and len(back) == docs.count()
    assert all(r.n_tokens == len(r.ids) for r in got) and encode_documents(no_docs, MODEL_PATH).collect() == []


def test_few_texts_reach_a_worker_at_once(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, stages, seen = spark.conf.get(name), dict(corpus_pipeline.STAGES), {}
    many = docs.select("doc_id", "text").crossJoin(spark.range(2500 // docs.count() + 1).select()).coalesce(1)
    try:
        for had in ("10000", "0", "7"):
            for stage in ("language_id", "simhash_near_dedup", "sentencepiece"):
                spark.conf.set(name, had)
                out = stages[stage](spark, docs, "")
                sizes = many.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
                assert max(r.n for r in sizes) == (7 if had == "7" else corpus_pipeline.TEXTS_AT_ONCE) and sum(r.n for r in sizes) == many.count()
            seen[had] = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in out.collect())
    finally:
        spark.conf.set(name, before)
    assert seen["7"] == seen["0"] == seen["10000"] and sum(seen["7"].values()) == docs.count()
    # the text doesn't come back from the workers, and ids are kept in two bytes each
    assert SentencePiece(spark, MODEL_PATH).round_trip(docs.select("doc_id", "text", "source"), "text", "ids", "sha").columns == ["doc_id", "source", "ids", "sha"]
    codec = Codec(read_vocabulary(MODEL_PATH))
    assert len(codec.encode("a longer text")) == sum(map(len, codec.kept.values())) // 2 > 0


def test_texts_are_shuffled_once_and_shuffles_go(spark, docs):
    name, stages = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", dict(corpus_pipeline.STAGES)
    before = spark.conf.get(name)
    try:
        for stage in stages:
            spark.conf.set(name, "false")
            stages[stage](spark, docs, "")
            assert spark.conf.get(name) == "true"
    finally:
        spark.conf.set(name, before)
    kept = spark.createDataFrame([(i, hashlib.sha256(ascii_lower(t or "").encode()).hexdigest()) for i, t in ((12, docs.where("doc_id = 12").first().text), (None, "a row without id and with some words"), (4, None), (0, "a row without id and with some words"))], "doc_id long, text_sha256 string").repartition(3)
    out = corpus_pipeline._only(docs.repartition(3), kept)
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_doc" in line]
    assert len(shuffles) == 2 and all("ENSURE_REQUIREMENTS" in line for line in shuffles)  # of texts, and of what is kept
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in docs.where("doc_id = 12 AND text LIKE 'AKIA%' OR doc_id IS NULL OR doc_id = 4").distinct().collect())


def test_unigram_takes_the_best_sum():
    pieces, scores = ["<unk>", "▁", "a", "b", "ab", "▁a", "bab", "abab"], [0.0, -2.0, -3.0, -3.0, -4.0, -4.5, -3.5, -20.0]
    codec = Codec(Vocabulary(pieces, scores, [False] + [True] * 7, [], 0, False))

    def best(text):
        if not text:
            return 0.0, ()
        return max(((s := best(text[len(p) :]))[0] + scores[i], (i, *s[1])) for i, p in enumerate(pieces[1:], 1) if text.startswith(p))

    for t in ("a", "abab", "babab", "bbabaab"):
        assert tuple(codec.encode(t)) == best("▁" + t)[1]
    assert 0 in codec.encode("axb")


def test_bit_slices():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 128, dtype=np.uint64)
    fps[1], fps[70] = fps[0] ^ np.uint64(7), fps[0] ^ np.uint64(15)
    planes = bit_planes(fps)
    hits = within_radius(planes, np.array([0, 1, 1]), fps[[0, 0, 70]], 3)
    for k, (w, q) in enumerate(((0, 0), (1, 0), (1, 70))):
        want = sum(1 << j for j in range(64) if int(fps[64 * w + j] ^ fps[q]).bit_count() <= 3)
        assert int(hits[k]) == want


def test_links_in_a_large_bucket(spark, monkeypatch):
    from profileloom.llm import simhash

    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 24, (150, 2))} | {int(x) for x in rng.integers(-(2**63), 2**63, 300)})
    got = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in connected_components(got).collect()}
    want = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert {f: roots.get(f, f) for f in fps} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (21, 20), (None, 4)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 141), 100)}
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_pipeline(spark, sf_dir, docs):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null and doc_id <> 12")
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
        kept = {r.doc_id for r in at.collect()}
        if k == 0:
            assert kept == {1, 2, 5, 6, 7, 8, 9, 10, 13, 14}
        if k == 1:
            assert kept == {2, 5, 7, 8, 9, 10, 13, 14}
        if k == 2:
            assert kept == {2, 5, 7, 8, 9, 10, 13, 14}  # 7 and 8 repeat a line and share just over half of their different shingles
    assert {"doc_id", "ids"} <= set(at.columns)


def test_near_stage_misses_no_pair(spark, sf_dir):
    """Near copies are those of 5-word Jaccard similarity 0.8, by brute force; SimHash within 3 bits alone misses most of them."""
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text or "") for r in real(spark, sf_dir).collect()]
    for n in (4, 6, 8, 9, 12, 30, 77, 200, 1500):
        for copy in range(6):
            words = [f"w{rng.integers(10_000)}" for _ in range(n + 4)]
            edited = list(words)
            for _ in range(max(1, n // (48 + 4 * copy))):
                edited[rng.integers(len(edited))] = "edit"
            rows += [(10**6 + len(rows), " ".join(words)), (10**6 + len(rows) + 1, " ".join(edited)), (10**6 + len(rows) + 2, " ".join([*words, *["tail"] * (n // 5)]))]
    # a long chain of near copies, of which the ends have little in common
    chain = [f"c{k}" for k in range(400)]
    rows += [(2 * 10**6 + k, " ".join(chain[8 * k : 8 * k + 120])) for k in range(30)]

    def shingles(text):
        words = ascii_lower(text).split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def alike(x, y):
        return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, sf_dir).collect())
    assert got == sorted(least.values())
    assert len(got) < len(rows) - 60


def test_stages_keep_one_of_repeated_rows(spark, sf_dir, docs):
    """Rows without id, whole-row repeats and other texts of a kept id: one row for each distinct text."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    none = [(None, f"text {k} of a row that has no id at all, as others", "en", "a", 1) for k in (1, 2, 3, 3)]
    more = [(12, "The Same id with an other text, 😀 token=😀 secret=\"abcdefgh\"", "en", "a", 1), (40, "a row without id and with some words", "en", "a", 1)]
    docs = docs.union(spark.createDataFrame(none + more, docs.schema))
    best = {}
    for r in docs.collect():
        key = ascii_lower(r.text or "")
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    exact = corpus_pipeline.exact_stage(spark, docs, sf_dir)
    assert Counter((-1 if r.doc_id is None else r.doc_id, ascii_lower(r.text or "")) for r in exact.collect()) == Counter((i, t) for t, i in best.items())
    repeated = exact.union(exact).union(docs.where("doc_id = 12"))
    near = corpus_pipeline.near_stage(spark, repeated, sf_dir).collect()
    texts = Counter(ascii_lower(r.text or "") for r in near)
    assert max(texts.values()) == 1 and sum(r.doc_id is None for r in near) == 3
    assert {r.doc_id for r in near} == {None, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 40}


def test_html_names_in_articles_titles_beside_them_and_deep_nesting(spark):
    """Names that only contain a word of noise don't count, nor does depth; an article without title has the one beside it."""
    inner = "<section id='discussion'><h2>Discussion</h2><p>We discuss</p></section><p class='social-studies'>Studies</p><p id='search-algorithms'>Search</p><p>Let <math><mi>x</mi></math> be</p><noscript>Plain</noscript>"
    rows = [
        (1, "http://n.org/1", f"<body><nav>Menu</nav><article>{inner}<div class='share-buttons'>Share</div><div id='comments'><p>Nice</p></div></article></body>"),
        (2, "http://n.org/2", "<body><article><p>In</p></article>" + "<div>" * 300 + "<nav>" * 300 + "Menu" + "</nav>" * 300 + "</div>" * 300 + "</body>"),
        (3, "http://n.org/3", "<body><header><h1>Site</h1></header><div class='top'><h1>Title</h1><p>Date</p></div><article><p>In</p></article></body>"),
        (4, "http://n.org/4", "<body><h1>Other</h1><article><h1>Title</h1><p>In</p></article></body>"),
        (5, "http://n.org/5", "<div>" * 5000 + "Deep" + "</div>" * 5000),
        (6, "http://n.org/6", "<div class='site-footer'>Foot</div><div class='adam'>Text</div><p hidden>Shown later</p>"),
    ]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Discussion\nWe discuss\nStudies\nSearch\nLet x be\nPlain"
    assert got[2] == "In" and got[3] == "Title\nIn" and got[4] == "Title\nIn"
    assert got[5] == "Deep" and got[6] == "Text\nShown later"


def test_points_decide_the_order_of_the_mix(spark, monkeypatch):
    """By place, every stretch of the mix has the sources in the proportions of their targets; other points, another order."""
    from profileloom.llm import mixture as MX

    rows = [(k, f"w{k} " * 40, "abc"[k % 3]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def placed():
        plan = mix_sources(df, block=40).collect()
        return plan, sorted((p, "abc"[r.doc_id % 3]) for r in plan for p in (r.place_1, r.place_2) if p is not None)

    plan, line = placed()
    assert all((r.place_1 is None) == (r.round_1 == 0) and (r.place_2 is None) == (r.round_2 == 0) for r in plan)
    share = {"abc"[r.doc_id % 3]: r.target for r in plan}
    for n in (50, 200, 500, len(line)):
        seen = Counter(s for _, s in line[:n])
        assert all(abs(seen[s] - n * share[s] / sum(share.values())) <= 4 for s in share)
    got = [(r.doc_id, r.text) for r in mixed_texts(df, block=40).collect()]
    place = {(r.doc_id, k): p for r in plan for k, p in enumerate((r.place_1, r.place_2)) if p is not None}
    assert len(got) == len(place) and [i for i, _ in got] == [i for (i, _), p in sorted(place.items(), key=lambda x: x[1])]
    monkeypatch.setattr(MX, "STEP", 1)
    other, _ = placed()
    assert {(r.doc_id, r.taken) for r in other} == {(r.doc_id, r.taken) for r in plan}
    assert {(r.doc_id, r.place_1) for r in other} != {(r.doc_id, r.place_1) for r in plan}


def test_stages_keep_columns_of_any_name_and_type(spark, sf_dir):
    from pyspark.sql import functions as F

    import corpus_pipeline

    names = ("_id", "_sha", "_key", "_doc", "_rank", "_row", "_n", "_copy", "_take", "_place", "__doc_kept")
    rows = [(k, f"text of {k} with some words", "en", "a", *range(len(names)), {"k": k}) for k in (1, 1, 2)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'{n} int' for n in names)}, tags map<string,int>")
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2}
        assert out.where(F.col("tags")["k"] == F.col("doc_id")).count() == out.count()


def test_large_groups_of_texts_less_alike_are_compared_in_blocks(spark, monkeypatch):
    """Edits of one text that are hardly near copies of each other: no pair for each two of them, and the same groups as by brute force."""
    rng, m = random.Random(5), 120
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(m):
        words = list(base)
        for at in rng.sample(range(150), 2 + i % 3):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    monkeypatch.setattr(jaccard, "LARGE", 4, raising=False)
    monkeypatch.setattr(jaccard, "LEAST_SHARED", 2, raising=False)
    seen, confirmed = [], jaccard._confirmed
    monkeypatch.setattr(jaccard, "_confirmed", lambda pairs, *rest: (seen.append(pairs.count()), confirmed(pairs, *rest))[1])
    kept = {r.doc_id for r in first_of_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert seen[-1] < m * m / 8, seen
    sets, root = [set(jaccard.shingle_set(t).tolist()) for t in texts], list(range(m))
    for a, b in itertools.combinations(range(m), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert kept == set(root) and 1 < len(kept) < m


@pytest.mark.parametrize("columns", [5, 8192])
def test_block_links_join_what_brute_force_joins(monkeypatch, columns):
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    for n_low, n_high in ((30, 40), (0, 5), (3, 0), (1, 1)):
        made = [np.unique(rng.choice(30, rng.integers(0, 30))).astype(np.uint64) for _ in range(n_low + n_high)]
        a, b = jaccard.block_links(made[:n_low], made[n_low:])
        root, by_links = np.arange(n_low + n_high), np.arange(n_low + n_high)
        for i, j in itertools.product(range(n_low), range(n_low, n_low + n_high)):
            x, y = set(made[i].tolist()), set(made[j].tolist())
            if 5 * len(x & y) >= 4 * len(x | y):
                root[root == root[j]] = root[i]
        for i, j in zip(a, b, strict=True):
            assert by_links[i] != by_links[j]  # a forest
            by_links[by_links == by_links[j]] = by_links[i]
        assert len({*zip(root.tolist(), by_links.tolist(), strict=True)}) == len(set(root.tolist())) == len(set(by_links.tolist()))


def test_mixed_texts_shuffles_texts_twice_at_most(spark):
    df = spark.createDataFrame([(1, "a", "a b c", 5), (1, "a", "a b c", None), (1, "a", "a b c", 5), (2, None, "d e", 1)], "doc_id long, source string, text string, more int")
    out = mixed_texts(df)
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange\b", part.strip()) and re.search(r"\btext#", part)]
    assert len(moved) <= 2, plan
    shares = mix_sources(df).where("doc_id = 1").agg({"round_1": "sum", "round_2": "sum"}).first()
    assert sum(len(r.text.split()) for r in out.where("doc_id = 1").collect()) == sum(shares)


def test_blocks_send_few_sets_and_leave_no_tables(spark, monkeypatch):
    """Sets go only to blocks where a fingerprint is near theirs, no near copy is missed, and tables of buckets are emptied."""
    monkeypatch.setattr(jaccard, "LARGE", 4)
    monkeypatch.setattr(jaccard, "LEAST_SHARED", 1)
    rnd, common = random.Random(5), " ".join(f"common{k}" for k in range(14))
    texts = [f"{common} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:6]]
    sent, tables, within, keep = [], [], jaccard._within_blocks, jaccard.stored
    monkeypatch.setattr(jaccard, "_within_blocks", lambda candidates, sets: (sent.append(candidates.count()), within(candidates, sets))[1])
    monkeypatch.setattr(jaccard, "stored", lambda df: (tables.append(keep(df)), tables[-1])[1])
    rows, links = jaccard.near_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, lambda fps: fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    node = {r.doc_id: r.node for r in rows.collect()}
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert all(roots[node[k]] == roots[node[40 + k]] for k in range(6)) and len(set(roots.values())) == 6 and len(roots) == 12
    assert sum(sent) < 20
    left = [t for t in tables if spark.read.parquet(t.inputFiles()[0].rpartition("/")[0]).count()]
    assert [t.columns for t in left] == [rows.columns]
    sides = [np.array(x) for x in ([100, 100, 9], [0, 0, 0], [0, 0, 0], [1, 2, 3])]
    sides = [sides[0], *(x.astype(np.uint64) for x in sides[1:3]), sides[3]]
    far = [np.array([100, 7]), np.array([2**47 - 1, 0], np.uint64), np.zeros(2, np.uint64), np.array([1, 4])]
    assert [x.tolist() for x in jaccard.alike(sides, sides)] == [[True, True, False]] * 2 and [x.tolist() for x in jaccard.alike(sides, far)] == [[False, False, False], [False, False]]
