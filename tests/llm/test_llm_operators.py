"""Defined cases of every operator, and comparison with brute force or a round trip."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinloom.llm import common, components, decontam, kneser_ney, langid, line_dedup, minhash, packing, suffix_dedup, tokens, topk, url_filter, wavelet
from clinloom.llm.common import materialize

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("l", "n", "rt", "s", "m")]
DOCS = "doc_id long, text string, score double, host string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use too."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.5, "h") for i, t in zip(ids, texts)], DOCS).repartition(3)


ODD = [None, "", " ", "\n\n", "a", "Ünï çödé — ’x’ 漢字 😀", "tab\there  two\x0b\x0c\r", "x" * 5000]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 130)]
    e = spark.createDataFrame(path + star + [(7, 7), (None, 3), (5, None), (500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {400: 400, 500: 400}
    assert components.connected_components(e.limit(0)).count() == 0


def test_components_of_few_edges_close_in_one_task(spark, monkeypatch):
    rng = random.Random(4)
    nodes = rng.sample(range(10**6), 400)
    trees = [(nodes[i], nodes[i + 1]) for i in range(0, 250)] + [(nodes[rng.randint(252, i - 1)], nodes[i]) for i in range(253, 400)]
    e = spark.createDataFrame(trees, "a long, b long")
    want = {x: min(part) for part in (nodes[:251], nodes[252:]) for x in part}
    by_rounds, from_some = ({r.node: r.component for r in components.connected_components(e, few=few).collect()} for few in (0, 60))
    assert by_rounds == from_some == want
    written, store = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: written.append(df) or store(df))
    assert {r.node: r.component for r in components.connected_components(e).collect()} == want
    assert len(written) == 1  # the edges; rounds would write three tables each


# --- 9


def test_url_rules(spark):
    urls = ["http://a.COM/en/1", "https://www.example.com/en/77?x", "http://example.com/en/6", "ftp://x.net/de/", "http://b.example.net/de/81#t", "http://xcom/en/", "nothing", None, "http://o.org/es/?q", "http://o.org?/es/", "http://u@h.com:80/en/", "://com/en/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    want = ["block", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "block"]
    for bound in (10, 1):
        got = url_filter.url_filter(df, url_filter.RULES, max_broadcast=bound).orderBy("page_id").collect()
        assert [r.verdict for r in got] == want
        assert got[1].rule == "example.com/en/7" and got[1].host == "www.example.com" and got[1].path == "/en/77" and got[7].host == got[7].path == "" and got[7].rule is None
    assert url_filter.url_filter(df.limit(0), url_filter.RULES).count() == 0


def test_trie_against_all_rules():
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", ""]
    paths = ["/", "/e", "/en", "/en/", "/en/7", "/en/7/x", "", "e"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:-1] for p in paths if rng.random() < 0.6]
    trie = url_filter.build_trie(rules)
    for h in hosts + ["c.b.a.com", "acom", "y.x.net"]:
        for p in paths + ["/en/77", "/en/7/xy", "/e/n"]:
            fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
            assert url_filter.lookup(trie, h, p) == max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)


# --- 6


@pytest.mark.parametrize("block", [3, 4096])
def test_topk_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]  # one common vector
    rows += [(400, None), (401, [float("nan")] * 8), (402, [1.0, None] * 4), (403, []), (404, [1.0, 2.0]), (405, [3.0, -2.0]), (None, rows[0][1]), (406, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = materialize(topk.build_index(df))
    q = topk.quantize(df.where("vec_id % 20 = 0 OR vec_id = 404"), "embedding", 64.0).select(F.col("vec_id").alias("query_id"), F.col("_q").alias("q"))
    got = defaultdict(list)
    for r in topk.search(index, q, 20, query_block=block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for i in [k for k in ok if k % 20 == 0 or k == 404]:
        best = sorted((-int(ok[i] @ v), j) for j, v in ok.items() if j != i and len(v) == len(ok[i]))[:20]
        assert got.pop(i) == [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert not got and topk.search(index, q.limit(0)).count() == 0


def test_topk_of_repeated_queries(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int").repartition(2)
    index = materialize(topk.build_index(df))
    q = topk.quantize(df.where("vec_id = 20"), "embedding", 64.0).select(F.col("vec_id").alias("query_id"), F.col("_q").alias("q"))
    assert sorted(tuple(r) for r in topk.search(index, q, 2).collect()) == [(20, 1, 1, 4096), (20, 2, 2, 2048)]
    # two vectors under one id are two queries
    two = q.unionAll(spark.createDataFrame([(20, [0, 64])], "query_id long, q array<long>"))
    assert sorted(tuple(r) for r in topk.search(index, two, 1).collect()) == [(20, 1, 1, 4096), (20, 1, 3, 4096)]
    assert topk.search(topk.build_index(df.limit(0)), q, 2).count() == 0


# --- 1


def test_language_id(spark):
    rng = random.Random(1)
    make = {"aa": lambda: " ".join(rng.choice(["the", "ing", "oath", "when"]) for _ in range(60)), "bb": lambda: " ".join(rng.choice(["ção", "ñandú", "él", "qué"]) for _ in range(60))}
    rows = [(i, make[k](), k) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows + [(500, None, "aa"), (501, "the", None)], "doc_id long, text string, lang string").withColumn("_h", F.col("doc_id"))
    model = langid.train(df.where("doc_id < 80 OR doc_id > 499"))
    new = spark.createDataFrame([(i, t, "x", 9.0) for i, t in enumerate([make["aa"](), make["bb"](), None, "", "123 !?", make["aa"]() * 300, make["aa"]()])], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(new, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["aa", "bb", "und", "und", "und", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and got[2].score == 0
    held = langid.identify(df.where("doc_id BETWEEN 80 AND 119"), model)
    assert held.where("lang = lang_pred").count() >= 38
    assert langid.train(df.limit(0)) is None and {r.lang_pred for r in langid.identify(new, None).collect()} == {"und"}


def test_language_network_against_plain_loops():
    rng = np.random.default_rng(3)
    m = langid.ByteCnn(["a", "b", "c"], seed=5)
    x = rng.integers(0, 256, (7, 40), dtype=np.uint8)
    want = np.zeros((7, len(langid.WIDTHS) * langid.FILTERS))
    for n in range(7):
        for k, w in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                want[n, k * langid.FILTERS + f] = max(0.0, max(sum(m.conv[k][j, x[n, i + j], f] for j in range(w)) for i in range(40 - w + 1)) + m.bias[k][f])
    assert np.allclose(m.features(x), want, atol=1e-5)
    z = want @ m.out + m.out_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(m.probabilities(x, step=3), e / e.sum(axis=1, keepdims=True), atol=1e-5)


def test_language_scores_do_not_depend_on_the_batch():
    rng = random.Random(2)
    m = langid.ByteCnn(["a", "b"], seed=1)
    texts = [prose(rng, rng.randint(1, 400)) for _ in range(30)] + [None, "", "12 ?"]
    one = [langid.predict_texts(m, [t])[0] for t in texts]
    for batch in (3, 4096):
        got = langid.predict_texts(m, texts, batch=batch)
        assert [g[0] for g in got] == [o[0] for o in one] and np.allclose([g[1] for g in got], [o[1] for o in one], atol=1e-5)
    assert langid.predict_texts(m, []) == []


def test_language_stage(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "ing", "oath"]) for _ in range(40)), "aa", 1, "r") for i in range(30)] + [(30, None, "aa", 2, None), (31, "12", None, 3, "r"), (None, "the oath the ing", None, 4, "r"), (0, "", "aa", 5, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    got = langid.language_stage(spark, df, "")
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == sorted([*map(str, range(30)), "None"])
    assert got.where("doc_id = 3").first().score == 1
    assert langid.language_stage(spark, df.limit(0), "").count() == 0


def test_language_stage_sends_a_text_once(spark, monkeypatch):
    sent, identify = [], langid.identify
    monkeypatch.setattr(langid, "identify", lambda df, *a, **k: sent.append(df.dtypes) or identify(df, *a, **k))
    # more rows than a piece of a batch: the struct's pieces begin where the batch's do
    rows = [(i, None if i % 7 == 0 else "the oath " * 9 if i % 2 else "qué ñandú " * 9, "aa" if i % 2 else "bb") for i in range(4100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = langid.language_stage(spark, df, "").collect()
    assert sent == [[("row", "struct<doc_id:bigint,text:string,lang:string>")]]
    assert sorted(tuple(r) for r in got) == [r for r in rows if r[1]]


def test_workers_keep_for_one_operator():
    common.kept("tokens")["file"] = object()
    assert common.kept("tokens")  # a further task of the same operator
    assert common.kept("langid") == {} and common.kept("tokens") == {}


# --- 2


def words_of(line):
    return line.strip(" ").split(" ")


def brute_lines(docs):
    """Lines, in order of document and place, that an earlier line equals or is within one word's edit of."""

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    seen, gone = [], set()
    for d in sorted(docs):
        for p, line in enumerate((docs[d] or "").split("\n")):
            w = words_of(line)
            if len(w) < line_dedup.MIN_WORDS:
                continue
            if any(near(w, s) for s in seen):
                gone.add((d, p))
            seen.append(w)
    return gone


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(7)
    base = [prose(rng, n) for n in (5, 6, 7, 12, 30, 4, 5)]
    lines = list(base)
    for b in base:
        for _ in range(8):
            w = b.split(" ")
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                op = rng.random()
                w = w[:k] + w[k + 1 :] if op < 0.3 else w[:k] + [rng.choice(WORDS)] + w[k + (op < 0.7) :]
            lines.append(rng.choice(["", " "]) + " ".join(w))
    rng.shuffle(lines)
    docs = {i: "\n".join(lines[4 * i : 4 * i + 4]) for i in range(len(lines) // 4 + 1)} | {90 + i: t for i, t in enumerate(ODD)} | {200: docs_long(rng)}
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, list(docs.values()), list(docs))).collect()}
    gone = brute_lines(docs)
    assert gone
    for d, t in docs.items():
        keep = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
        assert got[d].text == keep, d
        assert got[d].n_removed == sum(x == d for x, _ in gone)
    assert got[90].score == 0.5


def docs_long(rng):
    one = prose(rng, 3000)
    return one + "\n" + one.replace(" ", " extra ", 1) + "\n" + one


def test_line_dedup_defined_cases(spark):
    line = "one two three four five six"
    df = frame(spark, [line, line, line, "short one", None], [2, 2, None, 5, 6])
    got = line_dedup.line_dedup(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("2", line), ("2", line), ("None", ""), ("5", "short one"), ("6", None)], key=lambda x: (x[0], str(x[1])))
    assert [r.emptied for r in got if r.doc_id is None] == [True]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_leaves_columns_of_its_working_names(spark):
    names = ["ord", "dkey", "gone", "pos", "f", "h1", "line", "_lines", "_others", "a.b"]
    line = "one two three four five six"
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate([line, line + "\nown", "x"])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = line_dedup.line_dedup(df).orderBy("doc_id").collect()
    assert [tuple(r)[:-3] for r in got] == [rows[0], (1, "own", *rows[1][2:]), rows[2]]
    assert line_dedup.line_stage(spark, df, "").columns == df.columns


def test_line_stage_keeps_what_is_left(spark):
    line = "one two three four five six"
    texts = [line, line, line + "\nown text", line + "\n \n", None, "", " \n", "漢字の行\n" + line]
    got = {r.doc_id: r.text for r in line_dedup.line_stage(spark, frame(spark, texts), "").collect()}
    assert got == {0: line, 2: "own text", 4: None, 5: "", 6: " \n", 7: "漢字の行"}


def test_short_lines_go_where_they_repeat(spark):
    texts = ["All rights reserved.\n\nfirst\none two three four five", " All rights reserved. \n\nsecond", "漢字の行\nAll rights reserved", "漢字の行\n\n漢字の行\nthird", "All rights reserved.\n "]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, texts), short=True).collect()}
    assert [got[i].text for i in range(5)] == [texts[0], "\nsecond", texts[2], "\nthird", " "]
    assert [got[i].n_removed for i in range(5)] == [0, 1, 0, 2, 1] and [got[i].emptied for i in range(5)] == [False] * 4 + [True]
    assert {r.doc_id: r.text for r in line_dedup.line_stage(spark, frame(spark, texts), "").collect()} == {0: texts[0], 1: "\nsecond", 2: texts[2], 3: "\nthird"}


# --- 4


def brute_groups(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: (len(s[d]), find(d)) for d in docs}


def test_new_parts_are_merged_side_by_side(monkeypatch):
    rng = random.Random(3)
    signs = "ab'sZé0 9\n.,!-_ñ你中́٣’\U00010400\tTrRe\u0558\u058b"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a ", "a\n", "a" * 32, " " + "a" * 32, "aaaa " * 9, *ODD]
    enc = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"))
    library = [tokens._bytes(enc.library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert enc.encode(texts) == library == enc.encode(texts)
    assert not enc.merges.kinds[0x558] and enc.merges.kinds[ord("é")] and not enc.merges.kinds[ord("'")]
    enc.clear()
    asked = []
    monkeypatch.setattr(enc, "_encode", lambda t: asked.append(t))
    monkeypatch.setattr(enc, "_part", lambda *a: asked.append(a))
    enc.encode([" ".join(f"{rng.choice(WORDS)}é{i}," for i in range(500))])
    assert not asked  # before, each new word went by itself


def test_stars_end_where_they_leave_their_members(spark, monkeypatch):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(100))  # alike, but not so much that they are linked
    docs = spark.createDataFrame([(i, common + " " + " ".join(f"w{rng.random()}" for _ in range(20))) for i in range(60)], "doc_id long, text string")
    calls, blocks, confirm, links = [], [], minhash.confirm, minhash._block_links
    monkeypatch.setattr(minhash, "confirm", lambda *a: calls.append(1) or confirm(*a))
    monkeypatch.setattr(minhash, "_block_links", lambda *a: blocks.append(1) or links(*a))
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())
    assert len(calls) == 2 and len(blocks) == 1  # the smallest members, one round; then blocks


@pytest.mark.parametrize("options", [{}, {"stars": 1, "block": 4}])
def test_minhash_against_all_pairs(spark, options):
    rng = random.Random(11)
    docs = {}
    for n in (60, 150):
        base = prose(rng, n).split(" ")
        for _ in range(30):  # a crowd: some pairs link, others share most words but do not
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 18))):
                w[rng.randrange(n)] = rng.choice(WORDS)
            docs[len(docs)] = " ".join(w)
    docs |= {100 + i: t for i, t in enumerate([*ODD, "A b c", "a B c", prose(rng, 4000)])}
    docs[150] = docs[110].upper()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, list(docs.values()), list(docs)).select("doc_id", "text"), **options).collect()}
    assert got == brute_groups(docs)


def test_minhash_defined_cases(spark):
    t = prose(random.Random(2), 30)
    df = frame(spark, [t, t, t, "", None, t], [3, 3, 4, 8, 9, None])
    kept = minhash.dedup(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "8", "9", "None"] and kept.columns == df.columns
    assert minhash.near_duplicates(df.select("doc_id", "text").limit(0)).count() == 0


def test_texts_of_one_doc_id_are_judged_apart(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60), prose(rng, 60)
    near = lambda t: t + " tail"
    assert len(minhash.shingles(a)) == 56

    def judged(rows):
        df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
        out = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df.select("doc_id", "text")).collect())
        return out, sorted((r.doc_id, r.text) for r in minhash.dedup(df).collect())

    out, kept = judged([(1, a), (5, a), (5, b)])
    assert out == [(1, 1, True), (5, 1, False), (5, 5, True)] and kept == sorted([(1, a), (5, b)])
    out, kept = judged([(3, near(a)), (5, a), (5, b), (8, near(b))])
    assert out == [(3, 3, True), (5, 3, False), (5, 5, True), (8, 5, False)] and kept == sorted([(3, near(a)), (5, b)])
    # clashing and dotted columns pass through
    odd = frame(spark, [a, a, b], [1, 5, 5]).withColumns({"h": F.lit(1), "g.h": F.lit(2), "least": F.lit(3), "component_id": F.lit(4)})
    left = minhash.dedup(odd)
    assert left.columns == odd.columns and sorted((r[0], r[4], r[5], r[6], r[7]) for r in left.collect()) == [(1, 1, 2, 3, 4), (5, 1, 2, 3, 4)]


def test_near_duplicate_stage_takes_a_similarity_of_four_fifths(spark):
    w = [f"w{i}" for i in range(94)]  # 90 shingles; each changed word far from others costs five
    a, b, c = list(w), list(w), list(w)
    b[10], b[30] = "x", "y"  # 80 of 100: J = 0.80
    c[10], c[30], c[50] = "p", "q", "r"  # 75 of 105 with a: J = 0.71
    docs = frame(spark, [" ".join(x) for x in (a, b, c)])
    assert sorted(r.doc_id for r in minhash.near_duplicate_stage(spark, docs, "").collect()) == [0, 2]
    assert minhash.dedup(docs, 85).count() == 3
    j = 0.8
    assert (1 - j**minhash.ROWS) ** minhash.BANDS < 1e-7
    q = j + (1 - j) / 16
    assert 6 * (q * (1 - q) / minhash.PERMS) ** 0.5 / (15 / 16) <= minhash.SLACK


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        b = np.r_[a[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share), dtype=np.uint64)]
        true = share / (2 - share)
        x, y = (minhash.packed(minhash.minima(np.unique(v))).view(np.uint64) for v in (a, b))
        lanes = [(int(x[i]) >> (4 * k)) & 15 == (int(y[i]) >> (4 * k)) & 15 for i in range(len(x)) for k in range(16)]
        assert abs((np.mean(lanes) - 1 / 16) / (15 / 16) - true) < 0.2


# --- 7


def test_decontamination_against_scanning(spark):
    rng = random.Random(13)
    items = {i: prose(rng, n) for i, n in enumerate([40, 14, 13, 5, 1, 30])} | {6: "", 7: None, 10: "!!"}
    docs = {}
    for i in range(25):
        t = prose(rng, rng.randint(0, 200)).split(" ")
        if i % 2:
            w = items[i % 6].split(" ")
            k = rng.randrange(len(t) + 1)
            cut = rng.randrange(max(1, len(w) - 13))
            t[k:k] = w[cut : cut + rng.randint(10, 40)]
        docs[i] = "; ".join(" ".join(t).upper().split(" ")) if i % 3 else " ".join(t)
    docs |= {100 + i: t for i, t in enumerate([*ODD, items[0], items[4]])}
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    want = {}
    for d, t in docs.items():
        w, hit, by = low(t), set(), set()
        for i, x in items.items():
            v = low(x)
            n = min(13, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    by.add(str(i))
        want[d] = (len(w), len(hit), len(by), hashlib.sha256(",".join(sorted(by)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    df = frame(spark, list(docs.values()), list(docs))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    index = materialize(decontam.build_index(df, shard_words=300))
    for chars in (1 << 20, 60):
        got = {r.doc_id: tuple(r)[1:] for r in decontam.judge(decontam.search(index, bench, block_chars=chars)).collect()}
        assert got == want
    clean = decontam.decontaminate(df, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, v in want.items() if not v[4]} and clean.columns == df.columns
    assert decontam.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_decontamination_follows_the_row(spark):
    rng = random.Random(41)
    item, clean = prose(rng, 30), prose(rng, 60)
    rows = [(None, item, "a"), (None, clean, "b"), (7, item, "c"), (7, clean, "d"), (7, item, "e"), (8, None, "f"), (None, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string").repartition(3)
    bench = spark.createDataFrame([(None, item), ("x", item), ("x", None)], "item_id string, text string")
    got = decontam.decontaminate(df, bench)
    assert sorted(r.text_key for r in got.collect()) == ["b", "d", "f", "g"] and got.columns == df.columns
    verdicts = decontam.contamination(df, bench).collect()
    assert len(verdicts) == 7 and {r.n_items for r in verdicts} == {0, 1} and sum(r.contaminated for r in verdicts) == 3


def test_proximity():
    from clinloom.llm.common import ALNUM_WORD, text_words

    w = text_words("a b x c a b y y y c", ALNUM_WORD)
    order = np.argsort(w, kind="stable")
    s = w[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    shard = decontam.Shard([1], np.array([len(w)], "<i8").tobytes(), s[first].tobytes(), np.r_[first, len(s)].astype("<u4").tobytes(), order.astype("<u4").tobytes())
    q = text_words("a b c", ALNUM_WORD)
    assert [x.tolist() for x in shard.proximity(q, 1)] == [[0], [3]]
    assert [x.tolist() for x in shard.proximity(q, 3)] == [[0, 4], [3, 9]]


# --- 3, 5


@pytest.fixture(scope="module")
def byte_path():
    return tokens.public_path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = tokens.Encoder(tokens.public_path(name))
    rng = random.Random(1)
    letters = "aAbB éÉß'’.,!\n\t  0٣²½́̈İΣςﬁ漢字😀\xa0 -_$<|>s'tll"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t or "" for t in ODD] + [" a", "a ", "\na", "a\n", "a \n b", "a\n\nb"]
    for _ in range(2):  # new, then known
        assert e.encode(texts) == [np.array(x.ids, dtype="<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_a_fresh_library(name):
    from tokenizers import Tokenizer

    path = tokens.public_path(name)
    fresh, e = Tokenizer.from_file(path), tokens.Encoder(path)
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert added
    texts = [x for t in added for x in (f"a {t} b", t, f"one{t}two", f"{t}\n{t}", t.upper(), f"a {t[:-1]} b", f"x {t[:2]} y")] + ["a b c", "plain text"]
    for path_ in ("/root/testdata/sf0.01/documents.parquet",):
        import pyarrow.parquet as pq

        texts += [t or "" for t in pq.read_table(path_, columns=["text"])["text"].to_pylist()]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in fresh.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [e.encode(texts[i : i + 200]) for i in range(0, len(texts), 200)] == [want[i : i + 200] for i in range(0, len(texts), 200)]


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "hash_words", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    e = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"))
    texts = ["abc def", "abd xyz", "abc", "", "q w", "zz abc"]
    for _ in range(2):
        assert e.encode(texts) == [np.array(x.ids, dtype="<u4").tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(spark):
    rng = random.Random(17)
    texts = [prose(rng, rng.choice([1, 5, 40, 300, 900])) for _ in range(80)] + ODD + [prose(rng, 9000), ODD[1]]
    df = frame(spark, texts)
    enc = tokens.Encoder(tokens.public_path("word_bpe_49k.json"))
    want = {i: enc.encode([t])[0] + np.array([1], "<u4").tobytes() for i, t in enumerate(texts)}
    rows = packing.pack_documents(df).collect()
    parts, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        chunk = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(chunk) == 4 * r.length and zlib.crc32(chunk) == r.ids_crc32
        parts[r.doc_id][r.piece] = (r.start, r.length)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        p = [parts[i][k] for k in range(len(parts[i]))]
        assert [s for s, _ in p] == [4096 * k for k in range(len(p))] and sum(n for _, n in p) == len(ids) // 4
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    # no packing takes fewer than the volume, or than the pieces over half a sequence
    least = max(-(-sum(map(len, want.values())) // 4 // 4096), sum(r.length > 2048 for r in rows))
    assert len(seqs) <= least + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("hist,most", [({3: 5, 7: 5}, 5), ({10: 4}, 4), ({6: 3, 5: 3, 4: 3}, 5), ({1: 1}, 1)])
def test_plans_cover_everything(hist, most):
    p = packing.plan(hist, 10)
    used = defaultdict(int)
    for s, m in p:
        assert sum(x * k for x, k in s.items()) <= 10
        for x, k in s.items():
            used[x] += k * m
    assert dict(used) == hist and sum(m for _, m in p) <= most


def test_prices_are_those_of_all_sets():
    rng = np.random.default_rng(8)
    for _ in range(5):
        lengths = np.sort(rng.choice(np.arange(2, 12), 4, replace=False))
        value = rng.random(4)
        want = [0.0] * 16
        for c in range(16):
            want[c] = max([want[c - 1] if c else 0.0] + [want[c - x] + v for x, v in zip(lengths.tolist(), value) if x <= c])
        assert np.allclose(packing.price(lengths, value, 15), want)


def test_program_bounds_and_meets_the_fewest_sequences():
    rng = np.random.default_rng(0)
    for draw, over in ((rng.lognormal(6, 1.2, 3000), 1), (rng.integers(1, 4097, 3000), 60), (rng.integers(1200, 2401, 3000), 120)):
        hist = defaultdict(int)
        for x in np.clip(draw.astype(int), 1, 4096).tolist():
            hist[x] += 1
        p = packing.plan_with_bound(dict(hist))
        used = defaultdict(int)
        for s, m in p.sets:
            assert m > 0 and sum(x * k for x, k in s.items()) <= 4096
            for x, k in s.items():
                used[x] += k * m
        assert used == hist
        n = sum(m for _, m in p.sets)
        # never fewer than any bound, and few more
        assert n >= p.bound >= sum(x * k for x, k in hist.items()) / 4096 - 1e-6 and n <= np.ceil(p.bound) + over


def best_fit_decreasing(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        n += i == len(rooms)
        room = capacity if i == len(rooms) else rooms.pop(i)
        bisect.insort(rooms, room - x)
    return n


@pytest.mark.parametrize(
    "draw,fewer",
    [
        (lambda g: g.lognormal(6, 1.2, 3000).astype(int).clip(1, 4096), 0),
        (lambda g: g.integers(1, 4097, 1500), 0),
        (lambda g: g.integers(1200, 2401, 20000), 150),  # best-fit decreasing takes 9298
        (lambda g: g.integers(1, 60, 4000), 0),
        (lambda g: np.full(100, 4096), 0),
    ],
)
def test_program_covers_every_length_and_is_no_longer_than_best_fit(draw, fewer):
    drawn = draw(np.random.default_rng(0)).tolist()
    hist = Counter(drawn)
    lengths = np.array(sorted(hist))
    n = np.array([hist[x] for x in lengths.tolist()])
    greedy = best_fit_decreasing(drawn, 4096)
    programs = packing.solve(lengths, n, 4096, rounds=3)
    assert sum(programs[0].columns.values()) == greedy
    for p in programs:
        got = np.zeros(len(lengths))
        for key, z in p.columns.items():
            assert z > 0 and sum(int(lengths[i]) * k for i, k in key) <= 4096
            for i, k in key:
                got[i] += z * k
        assert (got >= n - 1e-6).all() and sum(p.columns.values()) >= p.bound - 1e-6
    p = packing.plan_with_bound(dict(hist))
    total = sum(m for _, m in p.sets)
    assert total <= greedy - fewer and p.from_program >= 0.9 * total and p.bound - 1e-6 <= p.fractional <= total + 1e-6
    used = Counter()
    for s, m in p.sets:
        used.update({x: k * m for x, k in s.items()})
    assert used == hist


def test_bound_is_one_of_the_program():
    rng = random.Random(12)
    for _ in range(30):
        hist = {x: rng.randint(1, 3) for x in rng.sample(range(1, 11), 3)}
        items = sorted((x for x, k in hist.items() for _ in range(k)), reverse=True)

        def fewest(rest, bins):
            if not rest:
                return len(bins)
            best = fewest(rest[1:], [*bins, 10 - rest[0]])
            for i, room in enumerate(bins):
                if room >= rest[0] and room not in bins[:i]:
                    best = min(best, fewest(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1 :]]))
            return best

        p = packing.plan_with_bound(hist, 10)
        assert p.bound <= fewest(items, []) + 1e-9 <= sum(m for _, m in p.sets) + 2e-9


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (513, 900), (3000, 70_000)):
        ids = rng.integers(0, top, n)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, [None, 5], [n // 2, n - n // 2]).to_bytes())
        assert (w.decode() == ids).all() and w.null.tolist() == [True, False]
        assert [w.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
        for t in [*set(ids[:5].tolist()), 10**6]:
            assert w.occurrences(t) == np.flatnonzero(ids == t).tolist()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"something else")


def test_token_files(spark, byte_path, tmp_path):
    rng = random.Random(19)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(40)] + ODD
    ids = [*range(100, 140), *range(len(ODD))]
    df = frame(spark, texts + ["again"], ids + [7])
    path = f"file://{tmp_path}/files"
    wavelet.write_shards(df, path, byte_path, 2, shard_tokens=500)
    files = wavelet.open_shards(spark, path)
    got = sorted(wavelet.read_documents(files).collect(), key=lambda r: r.start)
    enc = tokens.Encoder(byte_path)
    want = defaultdict(list)
    for i, t in zip(ids + [7], texts + ["again"]):
        want[i].append(enc.encode([t])[0] + np.array([2], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted(ids + [7])
    at, crc = 0, defaultdict(list)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        crc[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in crc.items()} == {k: sorted((len(x) // 4, zlib.crc32(x)) for x in v) for k, v in want.items()}
    assert wavelet.token_counts(files, [2]).first().n == len(got)
    assert wavelet.find_token(files, 2).count() == len(got)


# --- 8


def test_repeats_against_all_windows(spark):
    rng = random.Random(23)
    p = [prose(rng, n).split(" ") for n in (50, 49, 70, 120)]
    docs = {i: prose(rng, rng.randint(0, 150)).split(" ") for i in range(20)}
    for i in range(20):
        k = rng.randrange(len(docs[i]) + 1)
        docs[i][k:k] = p[i % 4]
    docs[30] = p[2] + prose(rng, 3).split(" ") + p[2]
    docs[31] = ["w"] * 200
    text = {i: " ".join(w) for i, w in docs.items()} | {40 + i: t for i, t in enumerate(ODD)} | {60: " ".join(docs[0]), 61: " ".join(docs[3]).upper()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) if i != 45 else ["x"] for i, t in text.items()}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    want = set()
    for i, w in words.items():
        hit = {k + j for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        for k in sorted(hit):
            if k - 1 not in hit:
                n = next(m for m in range(1, len(w) + 1) if k + m not in hit)
                want.add((i, k, n))
    df = frame(spark, list(text.values()), list(text))
    for chunk in (suffix_dedup.CHUNK, 2):
        assert {tuple(r) for r in suffix_dedup.repeated_passages(df, chunk=chunk).collect()} == want and want
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0
    same = frame(spark, [text[30], text[30], None], [1, 1, None])
    assert suffix_dedup.repeated_passages(same).count() == 0


def test_matches_extended_word_by_word():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n, passage = int(rng.integers(1, 30)), 8
        left, right = rng.integers(0, 5, n), rng.integers(4, 9, n)
        after = np.where(np.arange(8) < right[:, None], rng.integers(1, 3, (n, 8)) if rng.random() < 0.5 else 1 + (rng.random((n, 8)) < 0.1), 0)
        before = np.where(np.arange(4) < left[:, None], 1 + (rng.random((n, 4)) < 0.2), 0)
        doc = rng.integers(0, 4, n)
        by = np.lexsort(after.T[::-1])
        after, before, doc, left, right = (np.ascontiguousarray(a[by]) for a in (after.astype(">u8"), before.astype(">u8"), doc, left, right))
        most, least = suffix_dedup.extend_matches(after, before, doc, left, right, passage)
        for i in range(n):
            want = [k for k in range(5) if left[i] >= k and right[i] >= passage - k and any(doc[j] != doc[i] and left[j] >= k and right[j] >= passage - k and (after[i, : passage - k] == after[j, : passage - k]).all() and (before[i, :k] == before[j, :k]).all() for j in range(n))]
            assert (most[i], least[i]) == ((max(want), min(want)) if want else (-1, -1))


def test_pieces_of_sorted_rows():
    rng = random.Random(5)
    for _ in range(100):
        values = sorted(rng.choices(range(rng.choice([1, 3, 40])), k=rng.randint(0, 60)))
        cuts = sorted(rng.choices(range(len(values) + 1), k=4))
        batches = [pa.RecordBatch.from_pydict({"v": pa.array(values[a:b], pa.int64())}) for a, b in zip([0, *cuts], [*cuts, len(values)]) if b > a]
        pieces = list(suffix_dedup._chunks(iter(batches), lambda t: t["v"].to_numpy(), 4))
        got = [t["v"].to_pylist() for t, _, _ in pieces]
        assert sum(got, []) == values
        for k, (v, (_, first, last)) in enumerate(zip(got, pieces)):
            assert first if not k or got[k - 1][-1] == v[0] else True
            assert last if k == len(got) - 1 or got[k + 1][0] == v[-1] else True


# --- 10


def test_distinct_ngrams_are_sorted_a_few_times(monkeypatch):
    rng, sizes, plain = random.Random(3), [], kneser_ney._only_distinct
    texts = ["".join(rng.choice("abcdefghij") for _ in range(3000)) for _ in range(300)]
    z = kneser_ney.zstandard.compress
    batches = [pa.RecordBatch.from_pydict({"z": pa.array([z(t.encode()), None, z(b"")], pa.binary())}) for t in texts]
    monkeypatch.setattr(kneser_ney, "WAITING", 1000)
    monkeypatch.setattr(kneser_ney, "_only_distinct", lambda lists: sizes.append(sum(map(len, lists))) or plain(lists))
    got = kneser_ney._distinct(batches)
    every = np.concatenate([kneser_ney.grams(t) for t in texts])
    assert np.array_equal(got, np.unique(every))
    assert sum(sizes) < 8 * len(every)  # merging with every batch: some 150 times
    bits = np.arange(len(got)) / 7
    flat = np.r_[every[:200_000], every[:3]]
    assert np.array_equal(kneser_ney._looked_up(flat, got, bits), bits[np.searchsorted(got, flat)]) and len(kneser_ney._looked_up(every[:0], got, bits)) == 0
    assert len(kneser_ney._distinct([])) == 0 and [len(x) for x in kneser_ney._by_shard(got[:0])] == [0, kneser_ney.SHARDS + 1]


def brute_kneser_ney(texts):
    """Probability of a last byte after any bytes, straight from the definition."""
    n = kneser_ney.ORDER
    counts = [defaultdict(int) for _ in range(n + 1)]
    for t in texts:
        b = b"\n" * (n - 1) + t.encode()
        for i in range(len(b) - n + 1):
            counts[n][b[i : i + n]] += 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    disc = {}
    for k in range(1, n + 1):
        m = [sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] and m[1] else None
        disc[k] = (0.5, 0.5, 0.5) if y is None else (max(0, min(1 - 2 * y * m[1] / m[0], 1)), max(0, min(2 - 3 * y * m[2] / m[1], 2)), max(0, min(3 - 4 * y * m[3] / m[2], 3)) if m[2] else 1.5)

    def prob(g):
        if not g:
            return 1 / 256
        k, less = len(g), prob(g[1:])
        mine = [c for x, c in counts[k].items() if x[:-1] == g[:-1]]
        d = lambda c: disc[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - d(c) if c else 0) + sum(map(d, mine)) * less) / sum(mine) if mine else less

    return prob


def brute_bits(prob, text):
    n = kneser_ney.ORDER
    b = b"\n" * (n - 1) + text.encode()
    return np.mean([-np.log2(max(prob(b[j : j + n]), 1e-12)) for j in range(len(b) - n + 1)])


def test_kneser_ney_against_the_definition(spark):
    texts = ["ab abc abba", "abc, cab!", "ba ba", "Zebra é 12"]
    model, prob = kneser_ney.train(spark.createDataFrame([(t,) for t in texts + [None, ""]], "text string")), brute_kneser_ney(texts)
    for g in (b"ab", b"zz", b"b ", "é".encode()):
        assert model.low[int.from_bytes(g, "big")] == pytest.approx(prob(g), rel=1e-9)
    q = np.sort(np.concatenate([kneser_ney.grams("abc zab! é 9 ab"), (int.from_bytes(b" abba", "big") << 8) + np.arange(256)]))
    q = np.unique(q)
    order, at = kneser_ney._by_shard(q)
    asked = [(0, k, bytearray(kneser_ney._packed_sorted(q[order][at[k] : at[k + 1]]))) for k in range(kneser_ney.SHARDS) if at[k] < at[k + 1]]
    got = kneser_ney.answers(spark.createDataFrame(asked, "bucket long, shard int, g binary"), model, 1).collect()
    bits = np.concatenate([kneser_ney._unpacked(bytes(r.bits), np.float32) for r in sorted(got, key=lambda r: r.shard)])
    p = dict(zip(q[order].tolist(), (2.0**-bits).tolist()))
    for g, x in p.items():
        assert x == pytest.approx(prob(int(g).to_bytes(6, "big")), rel=1e-4)
    assert sum(x for g, x in p.items() if g >> 8 == int.from_bytes(b" abba", "big")) == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("bucket,lists", [(16 << 20, 256), (12, 2)])
def test_bytes_are_told_apart_and_follow_the_definition(spark, monkeypatch, bucket, lists):
    monkeypatch.setattr(kneser_ney, "BUCKET", bucket)
    monkeypatch.setattr(kneser_ney, "LISTS", lists)
    learn = ["ABBA 12 ABBA", "ABBA ab 12", "λόγος λόγος", "漢字"]
    texts = ["ABBA 12", "CDDC 12", "λόγος", "бгдет", None, "", "ab " * 20]
    model, prob = kneser_ney.train(spark.createDataFrame([(t,) for t in learn], "text string")), brute_kneser_ney(learn)
    got = {r.doc_id: r for r in kneser_ney.score(frame(spark, texts).withColumn("lang", F.lit("x")), model).collect()}
    assert len(got) == len(texts) and got[4].bits is None and got[5].bits is None
    assert got[0].bits < got[1].bits and got[2].bits < got[3].bits
    for i in (0, 1, 2, 3, 6):
        assert got[i].bits == pytest.approx(brute_bits(prob, texts[i]), rel=1e-6) and got[i].n_bytes == len(texts[i].encode())


def test_quality_against_brute_force(spark):
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(2, 12)) + rng.choice(["", " é", " 漢字"]) for _ in range(24)] + ["#!" * 9, None, ""]
    rows = [(i, t, ["aa", "bb", None][i % 3]) for i, t in enumerate(texts)] + [(None, texts[0], "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in range(18)], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("k")).collect()}
    prob = brute_kneser_ney([texts[i] for i, k in marks.items() if k > 0])
    bits = [brute_bits(prob, t) if t else None for _, t, _ in rows]
    levels = defaultdict(list)
    for i, k in marks.items():
        if k == 0:
            for key in (rows[i][2], "all"):
                levels[key].append(int(np.ceil(bits[i] * 1000)))
    cut = {key: sorted(v)[int(np.ceil(0.5 * len(v))) - 1] for key, v in levels.items()}
    assert len(levels) > 1
    got = kneser_ney.quality(df, spark.createDataFrame([(i,) for i in range(18)], "doc_id long"), quantile=0.5).collect()
    by = {(r.doc_id, r.lang): r for r in got}
    for (i, t, lang), b in zip(rows, bits):
        r, level = by[i, lang], cut.get(lang, cut["all"])
        assert r.threshold == pytest.approx(2 ** (level / 1000))
        assert (r.perplexity is None and not r.kept) if b is None else (r.perplexity == pytest.approx(2**b, rel=1e-5) and r.kept == (2**b <= 2 ** (level / 1000)))


def test_thresholds_keep_languages_of_any_name_apart(spark):
    rows = [("*", 9.0)] * 3 + [("aa", 1.0)] * 5 + [(None, 2.0)] * 2
    scored = spark.createDataFrame([(lang, bits, True) for lang, bits in rows] + [("bb", 4.0, False)], "lang string, bits double, trusted boolean")
    got = {(r.whole, r.lang): r.level for r in kneser_ney.thresholds(scored, 0.5).collect()}
    assert got == {(False, "*"): 9000, (False, "aa"): 1000, (False, None): 2000, (True, None): 1000}


def test_quality(spark):
    rng = random.Random(29)
    good = [prose(rng, 60) for _ in range(60)]
    bad = ["".join(rng.choice("#$%&*!|~") for _ in range(200)) for _ in range(5)]
    texts = good + bad + ODD[:2]
    rows = [(i, t, ["aa", "bb", None][i % 3], "x") for i, t in enumerate(texts)] + [(None, good[0], "cc", "x"), (0, good[0], "aa", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in [*range(40), 0, None]], "doc_id long")
    got = kneser_ney.quality(df, trusted, quantile=1.0).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[i] for i in range(40)) >= 35 and not any(kept[i] for i in range(60, 65)) and not kept[65] and not kept[66]
    assert sum(kept[i] for i in range(40, 60)) >= 8
    assert kneser_ney.quality(df.limit(0), trusted).count() == 0
    none = kneser_ney.quality(df, trusted.limit(0)).collect()
    assert all(r.kept == (r.n_bytes > 0) for r in none)
