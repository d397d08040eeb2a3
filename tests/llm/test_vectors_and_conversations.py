"""The operators on vectors and conversations against brute force."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from profileloom.llm import conversation_repair as R
from profileloom.llm import hard_negatives as H
from profileloom.llm import neighbour_graph as N
from profileloom.llm import queries as Q
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double, node long, x string, q long, rows string, block long, v string"
MORE = (1, 2.0, 3, "x", 4, "r", 5, "v")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if y is None else float(y) for y in e], g, *MORE) for i, e, g in rows], VECTORS)


# nearest neighbours


def brute_nearest(table, is_query, k):
    """Equal ids are one row; the exact answers."""
    rows = {}
    for i, e, _ in table:
        if i is not None and e is not None and all(y is not None and math.isfinite(y) for y in e) and any(e):
            e = [float(np.float32(y)) for y in e]
            rows[i] = min(rows.get(i, e), e)
    size = max(map(len, rows.values()), default=0)
    ids = sorted(rows)
    x = np.array([rows[i] + [0.0] * (size - len(rows[i])) for i in ids]).reshape(len(ids), size)
    out = {}
    for at, i in enumerate(ids):
        if is_query(i):
            s = x @ x[at]
            order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def recall(found, true, k):
    """Shares of the answers whose score is among the best k."""
    hits = total = 0
    for q, best in true.items():
        least = min((s for _, s in best), default=0) - 1e-12
        hits += sum(s >= least for _, s in found.get(q, []))
        total += len(best)
    return hits / max(total, 1)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_of_few_rows_are_exact(spark):
    rng = random.Random(3)
    table = [(i, [rng.gauss(0, 1) for _ in range(5)], 1) for i in range(60)]
    table += [(100 + i, [1.0, 0.5, 0.0], 2) for i in range(40)]  # shorter, and equal
    table += [(200, None, 1), (201, [0.0] * 5, 1), (202, [1.0, None, 1, 1, 1], 1), (203, [math.nan] + [1.0] * 4, 1), (204, [math.inf] + [1.0] * 4, 1), (None, [1.0] * 5, 1), (205, [], 1)]
    table += [table[0], (60, [9e30, 1, 1, 1, 1], None), (60, [9e30, 1, 1, 1, 1], None)]
    found = answers(N.nearest_neighbours(vectors(spark, table), F.col("vec_id") % 20 == 0))
    true = brute_nearest(table, lambda i: i % 20 == 0, 20)
    assert found.keys() == true.keys()
    for q, best in true.items():
        assert [i for i, _ in found[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in found[q]], [s for _, s in best], rtol=1e-12)


def test_nearest_of_none_and_one(spark):
    assert N.nearest_neighbours(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert N.nearest_neighbours(vectors(spark, [(20, [1.0, 2.0], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    assert answers(N.nearest_neighbours(vectors(spark, [(20, [1.0, 2.0], 1), (3, [-1.0, 0.0], 1)]), F.col("vec_id") % 20 == 0)) == {20: [(3, -1.0)]}
    with pytest.raises(ValueError):
        N.nearest_neighbours(vectors(spark, []), F.lit(True), k=N.DEGREE)


def test_recall_of_clusters_copies_and_random_directions(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    tight = centres[0] + rng.standard_normal((400, 24)) * 0.01  # more near copies than a beam holds
    loose = centres[rng.integers(0, 30, 1200)] + rng.standard_normal((1200, 24)) * 0.5
    far = rng.standard_normal((900, 24)) * rng.lognormal(0, 1, 900)[:, None]  # lengths differ, so some are near to everyone
    copies = np.repeat(centres[1][None], 500, axis=0)
    x = np.concatenate([tight, loose, far, copies]).astype(np.float32)
    table = [(i, e.tolist(), 1) for i, e in enumerate(x)]
    random.Random(2).shuffle(table)
    found = answers(N.nearest_neighbours(vectors(spark, table), F.col("vec_id") % 20 == 0))
    true = brute_nearest(table, lambda i: i % 20 == 0, 20)
    assert found.keys() == true.keys() and all(len(v) == 20 for v in found.values())
    assert recall(found, true, 20) > 0.97


def test_recall_of_the_registered_query(spark, sf_dir):
    table = [(r.vec_id, list(r.embedding), r.label) for r in Q.load(spark, sf_dir, "embeddings").collect()]
    found = answers(Q.op11_nearest_neighbours(spark, sf_dir))
    true = brute_nearest(table, lambda i: i % 20 == 0, 20)
    assert found.keys() == true.keys()
    assert recall(found, true, 20) >= 0.95
    exact = {(q, i): s for q, best in true.items() for i, s in best}
    assert all(abs(exact.get((q, i), s) - s) < 1e-12 for q, best in found.items() for i, s in best)


# hard negatives


def brute_negatives(table, is_anchor):
    rows = {}
    for i, e, g in table:
        if i is not None and g is not None and e is not None and all(y is not None and math.isfinite(y) for y in e):
            e = (g, [float(np.float32(y)) for y in e])
            rows[i] = min(rows.get(i, e), e)
    v = {i: (g, [math.floor(256 * y) for y in e]) for i, (g, e) in rows.items()}
    out = set()
    for a in filter(is_anchor, v):
        s = sorted(((-sum(x * y for x, y in zip(v[a][1], v[b][1], strict=False)), b) for b in v if b != a))
        for p, pid in [t for t in s if v[t[1]][0] == v[a][0]][:5]:
            good = [(-n, nid) for n, nid in s if v[nid][0] != v[a][0] and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(a, pid, r + 1, nid, -p, n) for r, (n, nid) in enumerate(good)}
    return out


def mined(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 3)
    monkeypatch.setattr(H, "ROWS", 40)
    monkeypatch.setattr(H, "STEP", 16)
    rng = random.Random(5)
    table = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(rng.choice([9, 11, 11, 11]))], rng.randrange(3)) for i in range(300)]
    table += [(1000 + i, table[0][1], i % 2) for i in range(120)]  # ties
    table += [(400, None, 1), (401, [None] * 11, 1), (402, [math.nan] * 11, 1), (403, table[1][1], None), (None, table[1][1], 1), (404, [], 1), (405, [300.5] * 11, 2), (410, [-70000.25] * 11, 2), table[3], (5, table[9][1], 1)]
    rows = H.with_components(vectors(spark, table))
    got = mined(H.hard_negatives(rows, F.col("vec_id") % 10 == 0))
    assert got == brute_negatives(table, lambda i: i % 10 == 0) and got


def test_negatives_of_no_rows(spark):
    assert mined(H.hard_negatives(H.with_components(vectors(spark, [])), F.lit(True))) == set()
    assert mined(H.hard_negatives(H.with_components(vectors(spark, [(1, [1.0], 1), (2, [2.0], 1)])), F.lit(True))) == set()


def test_scores_by_tables():
    rng = np.random.default_rng(0)
    for size in (1, 200, 1 << 40):
        a, r = rng.integers(-size, size, (7, 16)), rng.integers(-size, size, (300, 16))
        planes, bits = H.bit_planes(r)
        assert planes.shape == (bits, 2, 300)
        assert np.array_equal(H.scores(H._narrow(H.subset_sums(a), planes), planes), r @ a.T)


def test_registered_negatives(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    cursor = connection.execute(Q.OP12_SQL)
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert mined(Q.op12_hard_negatives(spark, sf_dir)) == {tuple(r[i] for i in at) for r in cursor.fetchall()}


# conversations


def brute_edits(codes):
    """(cost, audit): all cheapest edits are listed, the ASCII-least is taken."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, ("",))] if i == len(codes) and state in (R.START, R.ASSISTANT) else []
        follow = {R.START: R.USER, R.SYSTEM: R.USER, R.USER: R.ASSISTANT, R.ASSISTANT: R.USER}[state]
        if inserted < 3:
            cost, edits = best(i, follow, inserted + 1)
            options.append((cost + 3, tuple("I" + e for e in edits)))
        if i < len(codes):
            more = 3 if codes[i].isupper() else 0
            cost, edits = best(i + 1, state, 0)
            options.append((cost + 4, tuple("D" + e for e in edits)))
            role = {"s": R.SYSTEM, "u": R.USER, "a": R.ASSISTANT}.get(codes[i].lower())
            if codes[i] != "x":
                if role == follow or (role == R.SYSTEM and state == R.START):
                    cost, edits = best(i + 1, role, 0)
                    options.append((cost + more, tuple("K" + e for e in edits)))
                cost, edits = best(i + 1, follow, 0)
                options.append((cost + 3 + more, tuple("R" + e for e in edits)))
        least = min((c for c, _ in options), default=R.FAR)
        return least, tuple(e for c, edits in options if c == least for e in edits)

    cost, edits = best(0, R.START, 0)
    return cost, min(edits)


def digest_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def brute_conversations(rows):
    """Results by conv_id of rows (conv_id, turn, role, text), damage included."""
    space = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest_of(r[1], r[2])))
        turns = {t for t, _, _ in kept if t is not None}
        seen, faults, codes = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            letter = role[:1] if role[:1] and role[:1] in "sua" else "o"
            codes += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = brute_edits(codes)
        lines, last, left = [], None, iter(kept)
        for edit in audit:
            follow = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(follow + ":")
                last = follow[0]
                continue
            _, role, text = next(left)
            if edit != "D":
                role = role if edit == "K" else follow
                lines.append(f"{role}:{text}")
                last = role[0]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, at long, piece long, code string, fault string, digest string, conv string, audit string, letter string, n int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", "f", "d", "v", "a", "l", 3) for r in rows], CONVERSATIONS)


def odd_conversations():
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"]
    texts = ["Hello there.", "And so on", "Is it?  \n", "", " \t", None, "Yes!", "é😀", "😀.", "."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 8, 9])):
            row = (conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Line {rng.randrange(9)}.")
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


def by_conversation(df):
    got = {}
    for r in df.collect():
        assert r.conv_id not in got
        got[r.conv_id] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
    return got


@pytest.mark.parametrize("piece", [2, 4096])
def test_repairs_of_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    rows = odd_conversations()
    assert by_conversation(R.repair_damaged(conversations(spark, rows))) == brute_conversations(rows)


def test_repair_of_no_rows_and_of_none_left(spark):
    assert R.repair_damaged(conversations(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert by_conversation(R.repair_damaged(conversations(spark, [(gone, 0, "user", "Hi.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_by_halves():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice(R.CODES) for _ in range(rng.randint(0, 9)))
        assert R.repair(codes) == brute_edits(codes)


def test_a_long_conversation(spark, monkeypatch):
    """Pieces of one conversation give what it gives as a whole."""
    monkeypatch.setattr(R, "PIECE", 64)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(1500)}" + rng.choice([".", ".", ""])) for t in range(3000)]
    got = R.repair_damaged(conversations(spark, rows)).collect()[0]
    faults = sorted(R.faulty_rows(R.damage(conversations(spark, rows))).collect(), key=lambda r: r.at)
    assert (got.cost, got.audit) == R.repair("".join(r.code for r in faults))
    assert got.duplicate == sum(r.fault == "duplicate" for r in faults) > 300


def test_registered_repair(spark, sf_dir):
    rows = [tuple(r) for r in Q.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert by_conversation(Q.op13_conversation_repair(spark, sf_dir)) == brute_conversations(rows)
