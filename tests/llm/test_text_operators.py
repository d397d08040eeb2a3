import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from text_rows import ROWS, ascii_lower
from profileloom.llm.exact_dedup import exact_duplicates
from profileloom.llm.license_scan import TEMPLATES, scan_licenses
from profileloom.llm.multiset_hash import PARAGRAPH, as_hex, combined, document_fingerprints, fingerprint_lanes
from profileloom.llm.secret_scan import BASE, KINDS, scan_ledger, scan_secrets
from profileloom.llm.simhash import near_duplicates
from pyspark.sql import functions as F


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=[False, True], ids=["cold", "hot"])
def hot(request, monkeypatch):
    """With hot, every key that occurs twice takes the way of keys with a large share of the rows."""
    from profileloom.llm import common

    if request.param:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    return request.param


def test_hot_hashes(spark):
    from profileloom.llm.common import hot_hashes

    rows = spark.range(10_000).selectExpr("if(id < 4000, 7, id) AS k")
    assert hot_hashes(rows, ["k"]) == [rows.where("k = 7").selectExpr("xxhash64(k)").first()[0]]
    assert hot_hashes(rows.limit(0), ["k"]) == []


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_duplicates(spark, sf_dir, docs, block, hot):
    for df in (docs,) if hot or block == 16 else (docs, real(spark, sf_dir)):
        rows = pairs(df)
        groups = defaultdict(list)
        for i, t in rows:
            groups[ascii_lower(t)].append(i)
        got = exact_duplicates(df, block).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by_sha[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by_sha.keys())


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, sf_dir, docs, hot):
    for df in (docs,) if hot else (docs, real(spark, sf_dir)):
        rows = [(i, brute_fingerprint(t)) for i, t in pairs(df)]
        root = list(range(len(rows)))

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for a in range(len(rows)):
            for b in range(a):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                    root[find(a)] = find(b)
        least = defaultdict(list)
        for k, (i, _) in enumerate(rows):
            least[find(k)].append(i)
        want = Counter((i, f"{fp:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, fp) in enumerate(rows))
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect())
        assert got == want


def test_licenses_by_brute_force(spark, sf_dir, docs):
    import math

    mit = next(t.text for t in TEMPLATES if t.label == "mit" and not t.base)
    more = spark.createDataFrame([(1, f"x, {mit.upper()}; the MIT-License."), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of nothing"), (3, "license apache license apache apache license cc by cc by sa"), (4, "public license general gnu")], "doc_id long, text string")
    for df in (docs, real(spark, sf_dir), more):
        texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))) for i, t in pairs(df)]
        known = {w for t in TEMPLATES for w in t.mandatory}
        idf = {w: math.log((1 + len(texts)) / (1 + sum(w in set(words) for _, words in texts))) for w in known}
        want = Counter()
        for i, words in texts:
            at, labels, base_labels, places, share = [], set(), set(), 0.0, 0.0
            for template in TEMPLATES:
                p, text = template.mandatory, template.words
                hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
                rare = sorted(set(p), key=lambda w: (-idf[w], w))[:2]
                share = max(share, sum(w in words for w in rare) / len(rare))
                for k in hits:
                    labels.add(template.label)
                    begin = k - template.lead
                    places = max(places, sum(0 <= begin + j < len(words) and words[begin + j] == w for j, w in enumerate(text)) / len(text))
                if hits and template.base:
                    at += hits
                    base_labels.add(template.label)
            score = 0.5 + places / 2 if labels else share / 2
            want[i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 9)] += 1
        got = scan_licenses(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got) == want
    assert {r.doc_id: r.labels for r in scan_licenses(more).collect()} == {1: "mit", 2: "mit", 3: "apache,cc-by,cc-by-sa", 4: ""}


def brute_secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign":
            pattern, group = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1
        flags = re.I | re.A if kind == "assign" else re.A
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark, sf_dir, docs, hot):
    more = spark.createDataFrame([(100, "token= \"ab\" token=token: abcdef api-key: zz apikey='abc.def=='"), (101, "-----BEGIN RSA PRIVATE KEY-----\nabc+/=\n-----END RSA PRIVATE KEY----- https://me:pass1@h/ " + "f" * 24 + "g" + "0" * 23)], "doc_id long, text string")
    for df in (docs, real(spark, sf_dir), more):
        want = Counter()
        for i, t in pairs(df):
            found = brute_secrets(t)
            base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found if kind in BASE)
            n = Counter(kind for *_, kind, _ in found)
            want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)] += 1
        got = scan_secrets(df).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans_text) for r in got) == want


def test_many_secrets_in_one_text(spark):
    """A hundred thousand matches in one text: places stay right, and time grows with the matches, not their square."""
    import time

    def took(n):
        text = "token=abcdef " * n
        began = time.time()
        r = scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        last = f"assign:{13 * (n - 1)}:{13 * n - 1}"
        assert r.n_assign == n and r.spans_text.endswith(last) and r.spans_text.count(",") == n - 1
        return time.time() - began

    took(1000)
    assert took(100_000) < 20 * took(10_000) + 5


def test_secret_ledger(spark, docs):
    old = scan_ledger(docs.where("doc_id < 12"))
    old = spark.createDataFrame(old.collect(), old.schema)
    assert sorted(scan_ledger(docs, old).collect()) == sorted(scan_ledger(docs).collect())
    assert scan_ledger(docs.where("doc_id < 12"), old).count() == old.count()
    assert sorted(scan_secrets(docs, old).collect(), key=str) == sorted(scan_secrets(docs).collect(), key=str)


def test_document_fingerprints(spark, sf_dir, docs):
    for df in (docs, real(spark, sf_dir)):
        got = document_fingerprints(df).collect()
        rows = pairs(df)
        keys = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
        follow = {k: keys[(n + 1) % len(keys)] for n, k in enumerate(keys)}
        want = Counter()
        for k in rows:
            n = len(k[1])
            edited = k[1][: n - n // 2] + follow[k][1][: n // 2]
            want[k[0], n, hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        text_of = Counter((r.doc_id, r.fingerprint) for r in got)
        assert sum(text_of.values()) == len(rows)
    long = [r for r in got if r.n_chars > 1500]
    mean = lambda xs: sum(xs) / len(xs)
    assert mean([r.near_edited for r in long]) > 0.3 > mean([r.near_next for r in long])


def test_fingerprints_by_brute_force(spark, sf_dir, docs):
    """Lanes, hex, likeness of the edited and the next text, from the definition; 1,000 repeats among them."""
    from profileloom.llm.multiset_hash import LANES

    def seeded(k, unit):
        seed = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)  # Spark hashes an int as four bytes
        return xxhash.xxh64_intdigest(unit.encode(), seed)

    def lanes(text):
        sums = [0] * LANES
        for unit, n in Counter(re.findall(PARAGRAPH, text)).items():
            for k in range(LANES):
                sums[k] += n * ((seeded(k // 8, unit) >> (8 * (k % 8)) & 255) - 128)
        return sums

    def like(a, b):
        apart, both = sum((x - y) ** 2 for x, y in zip(a, b)), sum(x * x for x in a) + sum(y * y for y in b)
        return 1.0 if not apart else max(0.0, min(1.0, 1 - apart / both))

    more = spark.createDataFrame([(1, "Again.\n" * 1000 + "End."), (2, "Again.\n" * 500), (3, "Other. " * 70_000), (None, "Lone. Row."), (None, None), (9, "")], "doc_id long, text string")
    for df in (docs, more):
        rows = pairs(df)
        keys = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
        follow = {k: keys[(n + 1) % len(keys)] for n, k in enumerate(keys)}
        want = Counter()
        for i, text in rows:
            n, after = len(text), follow[i, text][1]
            a, b, c = (lanes(t) for t in (text, text[: n - n // 2] + after[: n // 2], after))
            hexes = ["".join(f"{x % 65536:04x}" for x in v) for v in (a, b)]
            want[i, *hexes, round(like(a, b), 9), round(like(a, c), 9)] += 1
        got = document_fingerprints(df).collect()
        assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_fingerprint_arithmetic(spark):
    rows = spark.createDataFrame([(1, "One here. Two there.\nThree"), (2, "Two there.\nOne here. Three"), (3, "One here."), (4, " Two there.\nThree"), (5, "")], "id long, text string")
    assert [len(x) for x in re.findall(PARAGRAPH, "One here. Two")] == [9, 4]
    lanes = {r.id: r for r in fingerprint_lanes(rows, ["id"]).collect()}
    assert lanes[5].lanes == [0] * 64
    both = spark.createDataFrame([(lanes[3].lanes, lanes[4].lanes, lanes[1].lanes)], "a array<short>, b array<short>, whole array<short>")
    r = both.select(combined(F.col("a"), F.col("b")).alias("sum"), combined(F.col("whole"), F.col("a"), -1).alias("rest"), as_hex(F.col("whole")).alias("hex")).first()
    assert r["sum"] == lanes[1].lanes and r["rest"] == lanes[4].lanes and len(r["hex"]) == 256


def test_empty_tables(no_docs):
    for operator in (exact_duplicates, near_duplicates, scan_licenses, scan_secrets, document_fingerprints):
        assert operator(no_docs).collect() == []


def test_rows_are_stated():
    assert any(i is None for i, *_ in ROWS) and any(t is None for _, t, *_ in ROWS)


def test_remembered():
    from profileloom.llm.common import Remembered

    asked = []
    kept = Remembered(lambda k: asked.append(k) or k * 2, 3)
    assert [kept[k] for k in (1, 2, 3, 1, 4, 1, 5, 6, 7, 1, 8, 9, 2)] == [2, 4, 6, 2, 8, 2, 10, 12, 14, 2, 16, 18, 4]
    assert asked.count(1) == 1 and asked.count(2) == 2 and len(kept) <= 3


def test_likeness_of_many_repeats(spark):
    """Half the repeats share most of their squared counts; other paragraphs share none, however often they are repeated."""
    line, other = "one line, again and again\n", "quite an other one\n"
    rows = [(1, line * 10_000), (2, line * 5_000), (3, other * 10_000), (4, other * 10_000)]
    got = {r.doc_id: r for r in document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(got[1].near_next - 0.8) < 1e-9 and got[3].near_next == 1
    assert got[2].near_next < 0.4 and got[4].near_next < 0.4
    assert len(got[1].fingerprint) == 256
