"""The transducer, the manifest and periodic runs against a library or brute force, and their defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinloom.llm import merkle, periodic, transducer
from clinloom.llm.tokens import public_path

ODD = [None, "", " ", "\n\n", "a", "Ünï çödé — ’x’ 漢字 😀", "tab\there  two\x0b\x0c\r", "x" * 9000, "it's<|endoftext|>we'll <|endof"]
PATH = public_path("word_bpe_49k.json")
#: Names that the operators use, and one with a dot.
NAMES = ["ids", "decoded", "tree", "pos", "n", "node", "block", "_salt", "_part", "_at", "start", "path", "runs", "g", "words", "a.b", "row", "leaf", "root"]


def frame(spark, rows):
    """Documents with columns whose names the operators use too."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in NAMES))


def odd_rows():
    return [(i, t, ["en", None, "", "fr"][i % 4], None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(ODD)]


def store(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# --- 11


def test_transducer_equals_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    v = transducer.vocabulary(PATH)
    enc, dec = transducer.Encoder(v), transducer.Decoder(v)
    letters = [*"aàéïßİǅſKÅ漢한글ᄀ각😀'’.,-_()<|>\t\x0b\x1c\x85\xa0 ̧́̈̊٣½ⅳ019sSrReElLdDtT \n\0", "<|endoftext|>", "<|endof", "'ll", " ", " "]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want, text
        got, at = [], 0
        while at < len(text):
            step = rng.randint(1, 7)
            got.append(enc.feed(text[at : at + step]))
            at += step
        assert np.frombuffer(b"".join([*got, enc.end()]), "<u4").tolist() == want, text
        assert dec.decode(np.array(want)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "the", "漢字", "'", "-'s", "1", "é", "aeiouy'll", "한글"])
def test_unbroken_text_streams_in_bounded_memory(unit):
    from tokenizers import Tokenizer

    v, text = transducer.vocabulary(PATH), unit * (40_000 // len(unit))
    enc, out, held = transducer.Encoder(v), [], 0
    for i in range(0, len(text), 512):
        out.append(enc.feed(text[i : i + 512]))
        held = max(held, len(enc.raw) + len(enc.part) + len(enc.normal) + len(enc.word.held if enc.word else ""))
    out.append(enc.end())
    assert np.frombuffer(b"".join(out), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert held < 4096 + 512 + 4 * v.lookahead + 1024 + 4 * 512


def test_lookahead_is_sufficient_and_computed_from_the_merges():
    rng = random.Random(11)
    for _ in range(150):
        names, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 12)):
            pair = rng.choice(names), rng.choice(names)
            if pair[0] + pair[1] not in names and len(pair[0] + pair[1]) < 9:
                names.append(pair[0] + pair[1])
                merges.append(pair)
        number = {x: k for k, x in enumerate(names)}
        length = {k: len(x) for x, k in number.items()}
        table = {(number[x], number[y]): (r, number[x + y]) for r, (x, y) in enumerate(merges)}
        ahead = transducer.sufficient_lookahead([(number[x], number[y], number[x + y]) for x, y in merges], length)
        for _ in range(20):
            word = [rng.randrange(3) for _ in range(60)]

            def stable(symbols):
                ends = np.cumsum([length[i] for i in transducer.merged(symbols, table)])
                return ends[ends <= 60 - ahead].tolist()

            want = stable(word)
            assert all(stable(word + [rng.randrange(3) for _ in range(rng.randint(1, 20))]) == want for _ in range(6))


def test_long_merges_equal_short_ones():
    v, rng = transducer.vocabulary(PATH), random.Random(3)
    for _ in range(200):
        ids = [v.symbol[rng.choice("etaoin")] for _ in range(rng.randint(1, 60))]
        assert transducer._merged_long(ids, v.merges) == transducer.merged(ids, v.merges)


def test_decoder_holds_unfinished_characters():
    v = transducer.vocabulary(PATH)
    dec = transducer.Decoder(v)
    dec.v = type("V", (), {"piece": ["é".encode()[:1], "é".encode()[1:], b"a", None, b"\xff"], "between": b""})
    assert dec.feed([0]) == "" and dec.feed([1, 2, 3, 9]) == "éa" and dec.feed([4, 0]) == "�" and dec.end() == "�"


def test_op11_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = odd_rows() + [(None, "null id", "en", "s", 1), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1)]
    got = transducer.op11_bpe_transducer(spark, store(frame(spark, rows), tmp_path)).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = transducer.encode_documents(frame(spark, rows), PATH).withColumn("a.b", F.lit(1))
    assert transducer.decode_documents(ids, PATH).columns == ["doc_id", "n_tokens", "a.b", "decoded"]
    assert transducer.encode_documents(frame(spark, rows).limit(0), PATH).count() == 0


# --- 12


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        run = at // 8 * 8
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])
        at //= 8


def brute_manifest(rows):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    of = lambda r, text: sha("".join(part(x) for x in (r[0], r[3], r[2], r[4], text)))
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, of(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    upper = levels([built[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            path = [*siblings(built[k], at), *siblings(upper, j)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = of(r, r[1].translate(lower) if r[1] is not None else None) if hit else leaf
            for before, after in path:
                f = sha(before + f + after)
            out.append((r[0], leaf, built[k][-1][0], upper[-1][0], sha("".join(b + a for b, a in path)), f, f == upper[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_levels", [1, 4])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, block_levels):
    rng = random.Random(4)
    langs = [None, "", "en", "en", "en", "ä", "z", *(f"l{k}" for k in range(9))]
    rows = odd_rows() + [(i + 20, rng.choice(["Some Text", "low", "", None, "Ä B"]), rng.choice(langs), "s", i) for i in range(160)]
    rows += [(None, "null id", "en", "s", 1), (3, "Again", "en", "s", 1), (3, "Again", "en", "s", 1), (3, "Other", "en", "s", 1)]
    # blocks of 8 make several rounds of a small table; workers read the setting from the function they are sent
    monkeypatch.setattr(merkle, "LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**block_levels)
    if block_levels == 4:
        got = merkle.op12_merkle_manifest(spark, store(frame(spark, rows), tmp_path))
        assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    else:
        nodes = [sha(str(k)) for k in range(73)]
        tree = levels(nodes)
        assert [merkle._next(n) for n in (1, 8, 9, 73)] == [1, 1, 2, 10] and [merkle._height(n) for n in (1, 2, 8, 9)] == [0, 1, 1, 1]
        import pyarrow as pa

        block = pa.table({"tree": ["t"] * 8, "pos": range(8, 16), "n": [73] * 8, "node": nodes[8:16]})
        assert merkle._root_of_block(block)["node"][0].as_py() == tree[1][1]
        above = pa.table({"tree": ["t"], "pos": [1], "path": [[{"before": "b", "after": "a"}]], "subroot": ["s"], "root": ["r"]})
        got = merkle._paths_of_block(block, above).to_pylist()
        assert all([(x["before"], x["after"]) for x in r["path"]] == [next(siblings(tree, r["pos"])), ("b", "a")] for r in got)


def test_manifest_of_several_blocks(spark):
    """9,000 leaves are three blocks; the proofs' paths lead to the root."""
    nodes = [sha(str(k)) for k in range(9000)]
    df = spark.createDataFrame([("big" if k < 8999 else "small", k, x) for k, x in enumerate(nodes)], "tree string, k int, node string").repartition(5)
    m = merkle.Manifest(df, ["k"])
    tree = levels(nodes[:8999])
    root = sha(tree[-1][0] + nodes[-1])
    assert m.root() == root
    got = {(r.tree, r.pos): [(x.before, x.after) for x in r.path] for r in m.paths().collect()}
    assert len(got) == 9000 and got["small", 0] == [(tree[-1][0], "")]
    for at in (0, 7, 4095, 4096, 8191, 8998):
        assert got["big", at] == [*siblings(tree, at), ("", nodes[-1])]


def test_manifest_of_no_rows(spark, tmp_path):
    assert merkle.op12_merkle_manifest(spark, store(frame(spark, odd_rows()).limit(0), tmp_path)).count() == 0
    assert merkle.Manifest(spark.createDataFrame([], "tree string, k int, node string"), ["k"]).root() is None


# --- 13


def brute_runs(words):
    out, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(6, 4 * q) and (a, i - a + q) not in seen:
                seen.add((a, i - a + q))
                out.append((a, i - a + q, q))
            i += 1
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        words = []
        while len(words) < rng.randint(0, 120):
            base = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 9))]
            words += (base * rng.randint(1, 8))[: rng.randint(1, 60)] + words[-rng.randint(1, 20) :] * rng.randint(0, 3)
        assert periodic.find_runs(np.array(words, dtype=np.int64)) == brute_runs(words), words


def test_runs_of_long_texts_take_little_work():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periodic.find_runs(np.array(b)) == []  # full of squares and cubes, without a fourth power
    assert periodic.find_runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    assert periodic.find_runs(np.array([*range(50)] * 4 + [7])) == [(0, 200, 50)]


def test_op13_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = odd_rows() + [(i + 20, " \t".join(rng.choice("ab") for _ in range(rng.randint(0, 70))), "en", "s", 1) for i in range(120)]
    rows += [(None, "x " * 7, "en", "s", 1), (3, "y " * 6, "en", "s", 1), (3, "y " * 6, "en", "s", 1)]
    want = []
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        h, n = 1 if i is None else zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            at = g % n
            p = 1 + (n - at) // (3 + g % 8)
            words = [w if k < at else words[at + (k - at) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (1000000 * r[1] // r[2], -r[0], -r[2])) if runs else (None,) * 3
        drop = {k for s, l, q in runs for k in range(s + q, s + l)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), hashlib.sha256(kept).hexdigest()))
    got = periodic.op13_periodic_runs(spark, store(frame(spark, rows), tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[1] for x in want) > 20
    assert periodic.periodic_runs(frame(spark, rows).limit(0)).count() == 0
