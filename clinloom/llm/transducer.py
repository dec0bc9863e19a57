"""Encoding and decoding with a BPE vocabulary as streams: constant memory, tokens emitted once they are stable.

A text is fed piece by piece. It passes four steps, each of which keeps only what the next characters could
still change:

1. added tokens (such as a written end of text): as many characters as their longest text has;
2. the normal form: what follows the last character before which a text may be cut;
3. words: a run of letters or of signs that has not ended, handed on as it grows;
4. merges: the symbols of the word that is open. Symbols further from its end than the merge list's lookahead can
   no longer be changed by any that follow, so their tokens are emitted and forgotten.

The lookahead is computed from the merge list. Let two texts agree up to some place and let f be the
last border up to which their segmentations agree while the merges are applied in order. f moves left only when
the token before it is consumed by a merge (a, b) in one text and not in the other; what then begins at f
is a or ab, so the next merge to consume a token before f has a or ab on its right, or, f staying, one of them on its
left, and it is later in the list. The longest such chain of merges, weighted by what each takes on its left, bounds how
far f moves. Vocabularies where a merge uses a token that is made later, or two merges make one token, are refused.

Decoding goes id by id through the tokens' bytes into a state machine from bytes to text, which holds an unfinished
character back.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.common import in_bounded_batches, quoted, table
from clinloom.llm.tokens import public_path

#: Characters (or ids) of a piece, words whose ids are kept in a worker and their characters, and those of a word that is no longer awaited whole.
PIECE, KEEP_WORDS, KEEP_LENGTH, LONG_WORD = 1 << 16, 400_000, 40, 4096
_SPACE = re.compile("[ \n]")
_NO_MERGE = (1 << 60, 0)
_OPEN: dict[str, Vocabulary] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others in order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


#: The words that such tokenizers tell apart; and the same in text below U+0300, with white space as the library knows it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BELOW_300 = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


class Vocabulary:
    """What a tokenizer's file says: symbols, merges in order, added tokens, the way back to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        bytewise = (pre.get("pretokenizers") or [{}])[-1]
        added = spec.get("added_tokens") or []
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or split.get("type") != "Split"
            or split.get("pattern", {}).get("Regex") != PATTERN
            or not split.get("invert")
            or split.get("behavior") != "Removed"
            or bytewise.get("type") != "ByteLevel"
            or bytewise.get("use_regex")
            or bytewise.get("add_prefix_space")
            or model.get("type") != "BPE"
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            or any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip"))
        ):
            raise ValueError(f"{path}: only vocabularies of words in lower case, with white space dropped, are streamed")
        self._read_model(model)
        self.added = {t["content"]: t["id"] for t in added}
        self.marks = {t[:2] for t in self.added}
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: decoder {self.decoder}")
        # the library's own normal form and classes of characters; all merging is done here
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, list[int]] = {}
        self._token_bytes(model["vocab"])

    def _read_model(self, model: dict) -> None:
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.symbol = {s: vocab[s] for s in byte_symbols()}
        self.last = {s: vocab[s + end] for s in byte_symbols()}
        self.of_byte, self.of_last_byte = ([of[c] for c in byte_symbols()] for of in (self.symbol, self.last))
        length = dict.fromkeys([*self.symbol.values(), *self.last.values()], 1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if x not in length or y not in length or made in length:
                raise ValueError(f"merge {rank} uses a token that is made later, or makes one that is there")
            length[made] = length[x] + length[y]
            self.merges[x, y] = rank, made
        self.lookahead = sufficient_lookahead([(x, y, made) for (x, y), (_, made) in self.merges.items()], length)
        self.length = length

    def _token_bytes(self, vocab: dict[str, int]) -> None:
        """Of every id: the bytes that decoding adds, and where a space comes between tokens."""
        back = {c: b for b, c in enumerate(byte_symbols())}
        of = vocab | self.added
        self.piece: list[bytes | None] = [None] * (max(of.values()) + 1)
        for token, i in of.items():
            shown = self.decoder == "ByteLevel" and all(c in back for c in token)
            self.piece[i] = bytes(back[c] for c in token) if shown else token.encode()
        self.between = b"" if self.decoder else b" "


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols at a text's end that further symbols can change, for merges (left, right, made) in order. Tokens that end before them are stable."""
    # of merges later in the list: the furthest that a chain goes on from a token at the border
    as_right: dict[int, int] = {}
    as_left: dict[int, int] = {}
    most = 0
    for left, right, made in reversed(merges):
        reach = max(as_right.get(left, 0), as_left.get(left, 0), as_right.get(made, 0), as_left.get(made, 0))
        most = max(most, length[left] + reach)
        as_right[right] = max(as_right.get(right, 0), length[left] + reach)
        as_left[left] = max(as_left.get(left, 0), reach)
    return most + 1  # the last symbol differs too where the word ends


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The tokens of a word: the earliest merge first, leftmost first."""
    if len(symbols) > 64:
        return _merged_long(symbols, merges)
    ids, get = list(symbols), merges.get
    steps = [get(pair, _NO_MERGE) for pair in zip(ids, ids[1:])]
    while steps:
        best = min(steps)
        if best is _NO_MERGE:
            break
        k = steps.index(best)
        ids[k] = best[1]
        del ids[k + 1], steps[k]
        if k < len(steps):
            steps[k] = get((ids[k], ids[k + 1]), _NO_MERGE)
        if k:
            steps[k - 1] = get((ids[k - 1], ids[k]), _NO_MERGE)
    return ids


def _merged_long(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same in n log n, with a heap of the pairs and links to the neighbours."""
    n, ids = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue  # a merge in between has changed it
        ids[k], ids[j] = merges[a, b][1], -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y < n and (ids[x], ids[y]) in merges:
                heapq.heappush(heap, (merges[ids[x], ids[y]][0], x, ids[x], ids[y]))
    return [i for i in ids if i >= 0]


class WordStream:
    """Merges of one word whose symbols come in pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, ""

    def feed(self, symbols: str) -> list[int]:
        """The tokens that are stable once these symbols have come too."""
        self.held += symbols
        v, out = self.v, []
        if len(self.held) < 4 * v.lookahead + 1024:
            return out
        ids, stable, at = merged([v.symbol[c] for c in self.held], v.merges), len(self.held) - v.lookahead, 0
        for i in ids:
            if at + v.length[i] > stable:
                break
            at += v.length[i]
            out.append(i)
        self.held = self.held[at:]  # tokens after a border are those of what follows it alone
        return out

    def end(self, symbols: str = "") -> list[int]:
        held, self.held = self.held + symbols, ""
        if not held:
            return []
        return merged([*(self.v.symbol[c] for c in held[:-1]), self.v.last[held[-1]]], self.v.merges)


_JOINS: set[str] = set()


def _joins_backward() -> set[str]:
    """Characters that a canonical composition can draw to what stands before them."""
    if not _JOINS:
        _JOINS.update(chr(c) for c in range(0x1161, 0x1176))
        _JOINS.update(chr(c) for c in range(0x11A8, 0x11C3))
        for c in range(0x110000):
            d = unicodedata.decomposition(chr(c))
            if d and d[0] != "<" and " " in d:
                _JOINS.add(chr(int(d.split()[1], 16)))
    return _JOINS


def _may_cut(c: str) -> bool:
    """Whether a text may be cut before this character and both parts be brought to normal form alone."""
    if c < "\x80":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _joins_backward() and c not in _joins_backward()


class Encoder:
    """Ids of a text that is fed in pieces; end() closes it, and another may follow.

    Memory does not grow with the text, but for a stretch of marks that all belong to one letter.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.raw = ""  # may begin an added token
        self.part = ""  # of a word, or of an unbroken stretch that may not be cut yet
        self.unbroken = False  # whether a stretch without spaces is under way that is not kept whole
        self.normal = ""  # of that stretch: in normal form, not yet told apart into words
        self.word: WordStream | None = None  # its last word, which is open
        self.like = ""  # a character of that word's class

    def feed(self, text: str) -> bytes:
        self.raw += text
        out, m = [], None
        while self._may_hold_added(self.raw) and (m := self.v.find_added.search(self.raw, partial=True)) and not m.partial:
            out += [self._words(self.raw[: m.start()], True), _packed([self.v.added[m[0]]])]
            self.raw, m = self.raw[m.end() :], None
        cut = m.start() if m else len(self.raw)
        done, self.raw = self.raw[:cut], self.raw[cut:]
        return b"".join([*out, self._words(done, False)])

    def end(self) -> bytes:
        rest, self.raw = self.raw, ""
        return self._words(rest, True)

    def encode(self, text: str) -> bytes:
        return b"".join([*(self.feed(text[i : i + PIECE]) for i in range(0, len(text), PIECE)), self.end()])

    def _may_hold_added(self, text: str) -> bool:
        return any(m in text or text.endswith(m[0]) for m in self.v.marks)

    def _words(self, text: str, last: bool) -> bytes:
        """Ids of the words that have ended, and the stable ones of a long one that has not; last: the text ends here."""
        out = []
        if self.unbroken:
            m = _SPACE.search(text)
            if m is None and not last:
                return self._stretch(text, False)
            out.append(self._stretch(text[: m.start()] if m else text, True))
            text, self.unbroken = text[m.end() :] if m else "", False
        text, self.part = self.part + text, ""
        cut = len(text) if last else max(text.rfind(" "), text.rfind("\n"))
        if cut >= 0:
            out.append(self._closed(text[:cut]))
            text = text[cut + 1 :]
        if len(text) > LONG_WORD:
            self.unbroken = True
            out.append(self._stretch(text, False))
        else:
            self.part = text
        return b"".join(out)

    def _closed(self, text: str) -> bytes:
        """Of text that an end, a space, a line end or an added token bounds on both sides."""
        words, known = text.replace("\n", " ").split(" "), self.v.words
        new = {w for w in words if w not in known}
        if not new:
            return b"".join([known[w] for w in words])
        if len(known) + len(new) > KEEP_WORDS:
            known.clear()
            new = set(words)
        got = {w: self._word(w) for w in new}
        known.update((w, ids) for w, ids in got.items() if len(w) <= KEEP_LENGTH)
        return b"".join([got[w] if w in got else known[w] for w in words])

    def _word(self, text: str) -> bytes:
        """Ids of what stands between two spaces."""
        low = text.lower()
        if not text or not text.isascii() and max(max(text), max(low)) >= "\u0300":
            return _packed([i for word, _ in self.v.split(self.v.normal(text)) for i in WordStream(self.v).end(word)]) if text else b""
        # below U+0300 all characters are in normal form and their classes are settled
        ids = []
        for word in _BELOW_300.findall(low):
            got = self.v.runs.get(word)
            if got is None:
                v, data = self.v, word.encode()
                got = merged([*[v.of_byte[b] for b in data[:-1]], v.of_last_byte[data[-1]]], v.merges)
                if len(self.v.runs) > KEEP_WORDS:
                    self.v.runs.clear()
                if len(word) <= KEEP_LENGTH:
                    self.v.runs[word] = got
            ids += got
        return _packed(ids)

    def _stretch(self, text: str, closed: bool) -> bytes:
        """Of a stretch without spaces or line ends that comes in pieces."""
        text = self.part + text
        cut = len(text) if closed else next((k for k in range(len(text) - 1, 0, -1) if _may_cut(text[k])), 0)
        text, self.part = text[:cut], text[cut:]
        text, ids = self.like + self.normal + self.v.normal(text), []
        found = self.v.split(text)
        self.normal = ""
        if self.word:
            word, (_, end) = found.pop(0)
            ids += self.word.feed(word[len(self.like) :])
            if end < len(text) or closed:
                ids += self.word.end()
                self.word, self.like = None, ""
        for word, (start, end) in found:
            if closed or start < len(text) - 3 and end < len(text):
                ids += WordStream(self.v).end(word)
            elif start < len(text) - 3:  # letters or signs: no other kind of word is as long
                self.word, self.like = WordStream(self.v), "a" if text[end - 1].isalpha() else "-"
                ids += self.word.feed(word)
            else:  # may yet become another word, as ' and s do
                self.normal = text[start:]
                break
        return _packed(ids)


class Decoder:
    """Text of ids that are fed in pieces; skips ids that no token has."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.began = vocabulary, False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        piece, n = self.v.piece, len(self.v.piece)
        shown = [piece[i] for i in ids if i < n and piece[i] is not None]
        data = self.v.between.join([b"", *shown] if self.began else shown)
        self.began = self.began or bool(shown)
        return self.text.decode(data)

    def end(self) -> str:
        rest, self.began = self.text.decode(b"", True), False
        self.text.reset()
        return rest

    def decode(self, ids: np.ndarray) -> str:
        return "".join([*(self.feed(ids[i : i + PIECE].tolist()) for i in range(0, len(ids), PIECE)), self.end()])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


def vocabulary(path: str) -> Vocabulary:
    """One a worker and file."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Of documents (doc_id, text): doc_id, n_tokens and ids, as little-endian numbers of 32 bits.

    A null text is an empty one: no ids. Every row gives one row; other columns, whatever their names, are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = Encoder(vocabulary(tokenizer))
        for b in in_bounded_batches(batches, rows=500):
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Add to rows with a column ids the column decoded, their text, in place of ids. Null ids give a null text."""
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", "decoded")]
    # numbered while they pass Python, as their own names may hold dots
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kept)), "decoded string"])

    def run(batches):
        dec = Decoder(vocabulary(tokenizer))
        for b in in_bounded_batches(batches, rows=500):
            texts = [None if i is None else dec.decode(np.frombuffer(i, dtype="<u4")) for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "decoded"])

    rows = encoded.select(*(F.col(quoted(f.name)).alias(f"c{k}") for k, f in enumerate(kept)), "ids")
    return rows.mapInArrow(run, schema).toDF(*(f.name for f in kept), "decoded")


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("word_bpe_49k.json")
    ids = encode_documents(table(spark, sf_dir, "documents"), path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode_documents(ids, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe_transducer": op11_bpe_transducer}
ORACLE_SQL: dict[str, str] = {}
