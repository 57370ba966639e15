"""Packing, leaks and repetition against brute force and on awkward input."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
import regex

from pointspark.llm import leakage, packing, repetition, words

D = "doc_id long, text string, repo string, item_id long, n_words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "r", 1, "clash") for i, t in enumerate(texts)] + [(None, "x", None, None, None)], D)


def test_hashed_words():
    h, begins = words.hashed([b"The cat, the CAT2 cat", b"", b"cat"])
    assert begins.tolist() == [0, 5, 5, 6] and len(set(h.tolist())) == 2 and h[1] == h[3] == h[4] == h[5]
    a, _ = words.hashed([words.lowered("Größe ÉTÉ x²y")])
    b, _ = words.hashed([words.lowered("größe été X Y")])
    assert a.tolist() == b.tolist() and len(a) == 4


def repeated(text, k=8):
    w = regex.findall(r"\p{L}+", (text or "").lower())
    seen, hit = set(), [False] * len(w)
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        if g in seen:
            hit[i : i + k] = [True] * k
        seen.add(g)
    return len(w), sum(hit)


def test_repeated_share(spark):
    r = random.Random(1)
    pool = ["alpha", "Beta", "gamma", "été", "Δelta"]
    texts = [" ".join(r.choice(pool[: r.randint(1, 5)]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    texts += [None, "", "12 34", "a " * 39, "One two three four five six seven eight.\r\n" * 6, "ab­cd " * 30, "word " * 50_000, "same same"]
    got = {q["doc_id"]: (q["n_words"], q["n_repeated"]) for q in repetition.repeated_share(docs(spark, texts)).collect()}
    assert got == {i: repeated(t) for i, t in enumerate(texts)}
    assert repetition.repeated_share(docs(spark, []).where("doc_id >= 0")).count() == 0


def test_line_frequency(spark):
    common = "This line is in many files\n"
    rows = [(i, common * 2 + f"own line number of file {chr(97 + i)}\n", "r" if i < 12 else None, 1, "") for i in range(14)] + [(20, None, "r", 1, ""), (21, "", "q", 1, ""), (22, common, "q", 1, "")]
    got = {q["doc_id"]: q for q in repetition.line_frequency(spark.createDataFrame(rows, D), limit=5).collect()}
    assert got[0]["n_lines"] == 3 and got[0]["n_removed"] == 2 and got[0]["depleted"]
    assert got[12]["n_removed"] == 0 and got[22]["n_removed"] == 0 and got[20]["kept_share"] == 1.0 and len(got) == 17


def test_short_lines_count_and_the_rest_is_kept(spark):
    rows = [(i, f" Fix {i}\r\n\r\nmerge\n", "r", 1, "") for i in range(7)]
    rows += [(10, "MERGE\rown Line \n\n\tfix  9\nend", "r", 1, ""), (11, "merge\n", "q", 1, ""), (12, " \n\n", "r", 1, ""), (13, None, "r", 1, "")]
    got = {q["doc_id"]: q for q in repetition.line_frequency(spark.createDataFrame(rows, D), limit=5).collect()}
    assert len(got) == 11
    assert all((got[i]["n_lines"], got[i]["n_removed"], got[i]["kept_share"], got[i]["depleted"], got[i]["kept_text"]) == (2, 2, 0.0, True, "\r\n") for i in range(7))
    assert (got[10]["n_lines"], got[10]["n_removed"], got[10]["depleted"], got[10]["kept_text"]) == (4, 2, False, "own Line \n\nend")
    assert got[11]["kept_text"] == "merge\n" and got[12]["kept_text"] == " \n\n" and got[13]["kept_text"] is None
    assert [(got[i]["n_lines"], got[i]["kept_share"]) for i in (11, 12, 13)] == [(1, 1.0), (0, 1.0), (0, 1.0)]


def best(c, items):
    items = sorted(items, reverse=True)
    top = [len(items)]

    def go(i, bins):
        if len(bins) >= top[0]:
            return
        if i == len(items):
            top[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(c - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return top[0]


def test_reduction_keeps_the_best_packing():
    r = random.Random(5)
    for _ in range(200):
        c = r.randint(8, 30)
        items = [r.randint(1, c) for _ in range(r.randint(0, 9))]
        fixed, rest = packing.dominance_reduction(c, Counter(items))
        left = [s for s, n in rest.items() for _ in range(n)]
        assert Counter(x for f, n in fixed for x in f for _ in range(n)) + Counter(left) == Counter(items)
        assert sum(n for _, n in fixed) + best(c, left) == best(c, items)
        p = packing.plan(c, Counter(items))
        assert all(sum(f) <= c for f, _ in p) and Counter(x for f, n in p for x in f for _ in range(n)) == Counter(items)


def test_pack(spark):
    r = random.Random(6)
    texts = [" ".join("word%d" % r.randint(0, 9) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "x y " * 400, "<|endoftext|>"]
    specs = spark.createDataFrame([(1, 16), (2, 100), (2, 50), (3, None), (None, 9), (4, 0)], "spec_id int, capacity_tokens int")
    rows = packing.pack(docs(spark, texts), specs).collect()
    n = {q["doc_id"]: q["n_tokens"] for q in packing.token_counts(docs(spark, texts)).collect()}
    for spec, cap in ((1, 16), (2, 100)):
        mine = [q for q in rows if q["spec_id"] == spec]
        load, pieces = Counter(), {}
        for q in mine:
            load[q["container_id"]] += q["n_tokens"]
            pieces.setdefault(q["doc_id"], []).append((q["piece"], q["start"], q["n_tokens"]))
        assert max(load.values()) <= cap and set(pieces) == set(n)
        for d, ps in pieces.items():
            ps.sort()
            assert len(ps) == 1 or n[d] > cap
            at = 0
            for _, start, k in ps:
                assert start == at
                at += k
            assert at == n[d]
        assert len(load) <= -(-sum(n.values()) // cap) * 1.1 + 2
    assert {q["spec_id"] for q in rows} == {1, 2}
    f = packing.fill_report(packing.pack(docs(spark, texts), specs), specs).orderBy("spec_id").collect()
    assert [q["spec_id"] for q in f] == [1, 2] and all(0 <= q["unused_share"] < 0.1 for q in f)
    assert packing.pack(docs(spark, []), specs).count() == 0


def passage(seed, n=60):
    r = random.Random(seed)
    return [r.choice("amber baker cooper dyer envoy ferry glazier herald inkwell jetty kettle lantern mortar nursery oarlock pantry quill rudder".split()) + r.choice(["", "s", "ed"]) for _ in range(n)]


def test_leaks(spark):
    p, q, short = passage(1), passage(2), passage(3, 9)
    items = [(1, "s", "do", " ".join(p), "amber"), (2, "s", "do", " ".join(q), None), (3, "s", "do", None, None), (4, "s", "do", " ".join(short), ""), (1, "s", "do", " ".join(p), "amber"), (None, "s", "do", " ".join(p), "")]
    filler = "commit of the usual kind which says nothing at all " * 5
    edited = list(p[5:45])
    for k in (6, 15, 24, 33):
        edited[k] = "zzz"
    too_much = list(p[:60])
    for k in range(3, 60, 5):
        too_much[k] = "zzz"
    shuffled = p[:]
    random.Random(9).shuffle(shuffled)
    texts = {
        "run of 12": (filler + " ".join(p[10:22]) + " " + filler, {1}),
        "run of 11": (filler + " ".join(p[10:21]) + " end " + filler, set()),
        "edits": (filler + " ".join(edited), {1}),
        "too many edits": (filler + " ".join(too_much), set()),
        "shuffled": (" ".join(shuffled), set()),
        "dropped": (" ".join(w for k, w in enumerate(q[:50]) if k % 10 != 4), {2}),
        "added": (" ".join(w + (" thing" if k % 9 == 4 else "") for k, w in enumerate(q[:50])), {2}),
        "both": (" ".join(p[:20]) + "\n" + filler + " ".join(q[30:50]), {1, 2}),
        "case and marks": ("+// " + "\n+// ".join(" ".join(f"**{w.upper()}**" for w in p[k : k + 4]) for k in range(0, 40, 4)), {1}),
        "broken words": ("> " + " ".join(w if k % 3 else w[:2] + "-\n> " + w[2:] for k, w in enumerate(p[:40])), {1}),
        "soft hyphens": (" ".join(w[:3] + "­​⁠" + w[3:] for w in p[:30]), {1}),
        "full width": (" ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in p[:30]), {1}),
        "json": ('{"text": "' + " \\n ".join(p[:30]) + '"}', {1}),
        "entities and tags": (" ".join(f"<b>{w}</b>" if k % 2 else "".join(f"&#{ord(c)};" for c in w) for k, w in enumerate(p[:30])), {1}),
        "all of the short one": (" ".join(short), set()),
        "empty": ("", set()),
        "very long": (filler * 2000 + " ".join(q) + filler, {2}),
    }
    names = list(texts)
    df = docs(spark, [texts[k][0] for k in names] + [None])
    it = spark.createDataFrame(items, "item_id long, suite string, instruction string, passage string, answer string")
    got = {}
    for r in leakage.leaks(df, it).collect():
        got.setdefault(names[r["doc_id"]], set()).add(r["item_id"])
    assert got == {k: v for k, (_, v) in texts.items() if v}
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


def test_answers(spark):
    """The answer counts where its words follow each other in the stretch, also words that no passage has."""
    p, q = passage(1), passage(2)
    items = [(1, "s", "do", " ".join(p), "zebra"), (2, "s", "do", " ".join(q), "blue whale"), (3, "s", "do", " ".join(passage(5)), None)]
    texts = [" ".join(p[:20]) + " unheard ofwords " + " ".join(p[20:40]), " ".join(p[:30]) + " Zebra!", " ".join(q[:30]) + " whale blue", " ".join(q[:30]) + " the BLUE-whale it was", " ".join(passage(5))]
    it = spark.createDataFrame(items, "item_id long, suite string, instruction string, passage string, answer string")
    got = {(r["doc_id"], r["item_id"]): r["answer"] for r in leakage.leaks(docs(spark, texts), it).collect()}
    assert got == {(0, 1): False, (1, 1): True, (2, 2): False, (3, 2): True, (4, 3): False}


def test_latent_search_by_itself(spark):
    """Candidates come from the cosine alone: all leaks are among them, most other pairs are not, and a limit of 1 leaves none."""
    items = [(k, "s", "do", " ".join(passage(k + 10)), "") for k in range(20)]
    it = spark.createDataFrame(items, "item_id long, suite string, instruction string, passage string, answer string")
    r = random.Random(3)
    texts = []
    for k in range(20):
        w = passage(k + 10)[10:50]
        for j in range(4, 40, 9):
            w[j] = "zzz"
        texts.append("some words in front " + " ".join(w) + " and behind " + " ".join(r.sample(passage(k + 50), 20)))
    df = docs(spark, texts)
    found = {(q["doc_id"], q["item_id"]) for q in leakage.leaks(df, it, check=False).collect()}
    assert found >= {(k, k) for k in range(20)} and len(found) < 200  # of 400 pairs
    assert {(q["doc_id"], q["item_id"]) for q in leakage.leaks(df, it).collect()} == {(k, k) for k in range(20)}
    assert leakage.leaks(df, it, cosine=1.01).count() == 0


def test_sparse_rows_match_a_dense_matrix():
    r = np.random.default_rng(2)
    idf = np.r_[r.uniform(0.1, 3, 40), 0.0]
    rows = [r.integers(-1, 41, r.integers(0, 30)) for _ in range(50)]
    dense = np.zeros((50, 41))
    for k, w in enumerate(rows):
        for t in w[w >= 0]:
            dense[k, t] += 1
    dense = np.log1p(dense) * idf
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    a, q, y = leakage.Rows(rows, idf), r.normal(size=(41, 5)), r.normal(size=(50, 5))
    out = np.zeros((41, 5))
    a.back(y, out)
    assert np.allclose(a.times(q), dense @ q) and np.allclose(out, dense.T @ y)


def test_items_in_blocks(spark, monkeypatch):
    ps = [passage(20 + k) for k in range(5)]
    it = spark.createDataFrame([(k, " ".join(p), "") for k, p in enumerate(ps)], "item_id long, passage string, answer string")
    df = docs(spark, [" ".join(p[3:33]) for p in ps])
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 2)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it).collect()} == {(k, k) for k in range(5)}


def test_near_copy_against_plain_edit_distance():
    r = np.random.default_rng(8)

    def plain(p, t):
        for s in range(len(p) - leakage.LONG + 1):
            row = [0] * (len(t) + 1)
            for k, w in enumerate(p[s:], 1):
                new = [k]
                for j in range(1, len(t) + 1):
                    new.append(min(row[j - 1] + (t[j - 1] != w), row[j] + 1, new[j - 1] + 1))
                row = new
                if k >= leakage.LONG and min(row) * leakage.EDITS <= k:
                    return True
        return False

    for _ in range(40):
        p = r.integers(0, 9, 42)
        t = p[r.integers(0, 5) : 42 - r.integers(0, 5)].copy()
        t[r.integers(0, len(t), r.integers(2, 7))] = 99
        assert leakage._near_copy(p, t) == plain(p, t)


def test_time_columns_are_no_obstacle(spark):
    df = spark.createDataFrame([(1, "a b", dt.datetime(2025, 1, 1))], "doc_id long, text string, committed_at timestamp")
    assert repetition.repeated_share(df).first()["n_words"] == 2
