"""Encoding whole texts with a public tokenizer, with the ids of words that come again kept at hand.

A tokenizer's pre-tokenizer often never joins what stands on two sides of a space or line
end: then a text may be cut there, and each part's ids, with the separator before it, are
the same as within the text. Parts are known again by a 64-bit hash and then compared byte by
byte. Which way a tokenizer's file allows is read from the file; where neither way holds, and
for texts that have two separators in a row, may hold one of the tokenizer's added tokens (such
as the end of a text, written out) or hold a part whose hash another part has, whole texts go through the library.
Where a space belongs to the word that follows, all new parts of a batch are merged side by side, in arrays.
"""

from __future__ import annotations

import json
import os
from array import array
from unicodedata import normalize

import numpy as np
import regex

from clinloom.llm.common import hash_words, kept

#: Parts of texts, and words of letters among them, of which the ids are kept, at most, in a worker: some 250 MB.
KEEP_PARTS, KEEP_WORDS = 1_000_000, 400_000
#: Bytes of parts that are kept, about.
KEEP_BYTES = 64 << 20
PLAIN, SPACED, LINED = 0, 1, 2
LEADS = ("", " ", "\n")
_SALT = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], dtype=np.uint64)
_LETTERS = regex.compile(r"\p{L}+")


def _byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_SYMBOLS = _byte_symbols()

#: Bytes of the longest unit that is merged beside others.
UNIT = 32
_NONE = np.int32(2**31 - 1)
_LETTER, _DIGIT, _MARK, _SPACE, _LINE = 1, 2, 3, 4, 5


def _kinds(cut) -> np.ndarray:
    """Of characters below U+10000 the kind of unit that they stand in, 0 where the library is asked: ASCII, but for an apostrophe, and what the library's cut takes for letters."""
    kinds = np.zeros(1 << 16, dtype=np.uint8)
    shown = "".join(chr(c) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000)
    kinds[[ord(c) for m in _LETTERS.finditer(shown) for c in m.group() if len(cut(f"a{c}b")) == 1]] = _LETTER
    for c in range(33, 127):
        kinds[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    kinds[[ord("'"), 32, 10]] = 0, _SPACE, _LINE
    return kinds


class Merges:
    """The merges of a byte-level vocabulary, for many units at a time: in each the pair that comes first in the file, the leftmost of equal ones, until none is left."""

    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]], cut):
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.by_key = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.by_key]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.id = np.array([vocab[_SYMBOLS.get(b, chr(b))] for b in range(256)] + [-1], dtype=np.int32)
        self.first = self._rank(self.id[:, None], self.id[None, :])  # of two bytes
        self.kinds = _kinds(cut)

    @classmethod
    def of(cls, spec: dict, cut) -> Merges | None:
        m = spec["model"]
        other = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if m.get("type") != "BPE" or any(m.get(k) for k in other) or max(m["vocab"].values()) >= 1 << 16:
            return None
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        whole = all(_SYMBOLS.get(b, chr(b)) in m["vocab"] for b in range(256)) and len(set(pairs)) == len(pairs) > 0
        return cls(m["vocab"], pairs, cut) if whole else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) << 16 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], _NONE)

    def _merge(self, units: np.ndarray) -> np.ndarray:
        """Rows of bytes, filled up with 256, become rows of ids, filled up with -1."""
        ids, rank = self.id[units], self.first[units[:, :-1], units[:, 1:]]
        out, rows, col = np.empty_like(ids), np.arange(len(ids)), np.arange(units.shape[1])
        while len(rows):
            p = rank.argmin(axis=1)
            r = rank[np.arange(len(rows)), p]
            live = r < _NONE
            if not live.all():
                out[rows[~live]] = ids[~live]
                rows, ids, rank, p, r = (x[live] for x in (rows, ids, rank, p, r))
            i = np.arange(len(rows))
            ids[i, p] = self.merged[r]
            ids = np.take_along_axis(ids, np.minimum(col + (col > p[:, None]), len(col) - 1), axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(col[:-1] + (col[:-1] >= p[:, None]), len(col) - 2), axis=1)
            rank[:, -1] = _NONE
            rank[i, p] = self._rank(ids[i, p], ids[i, p + 1])
            i, q = i[p > 0], p[p > 0]
            rank[i, q - 1] = self._rank(ids[i, q - 1], ids[i, q])
        return out

    def encode(self, parts: list[bytes]) -> list[bytes | None]:
        """The ids of parts with their separators before them; None where the library must be asked."""
        size = np.array([len(p) for p in parts], dtype=np.int64)
        blob = b"".join(parts)
        data, upto = np.frombuffer(blob, dtype=np.uint8), np.r_[0, np.cumsum(size)]
        chars = np.frombuffer(blob.decode().encode("utf-32-le"), dtype="<u4")
        kind = self.kinds[np.minimum(chars, 0xFFFF)][np.cumsum((data & 0xC0) != 0x80) - 1]
        # a unit is a run of one kind, with the space before it
        starts = np.ones(len(data), dtype=bool)
        starts[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        starts[upto[:-1][size > 0]] = True
        at = np.flatnonzero(starts)
        n = np.diff(np.r_[at, len(data)])
        odd = np.r_[0, np.cumsum((kind == 0) | (np.repeat(n, n) > UNIT))]
        known = (odd[upto[1:]] == odd[upto[:-1]]) & (size > 0)
        wanted = known[np.searchsorted(upto, at, side="right") - 1]
        ids = np.full(len(data), -1, dtype=np.int32)
        for lo, hi in ((0, 4), (4, 8), (8, 16), (16, UNIT)):
            a, k = (x[wanted & (n > lo) & (n <= hi)] for x in (at, n))
            inside = np.arange(hi) < k[:, None]
            places = (a[:, None] + np.arange(hi))[inside]
            units = np.full(inside.shape, 256, dtype=np.int64)
            units[inside] = data[places]
            ids[places] = self._merge(units)[inside]
        have = ids >= 0
        cuts = (4 * np.r_[0, np.cumsum(have)][upto]).tolist()
        raw = ids[have].astype("<u4").tobytes()
        return [raw[a:b] if k else None for a, b, k in zip(cuts, cuts[1:], known.tolist())]


def _bytes(ids: list[int]) -> bytes:
    """As little-endian numbers of 32 bits."""
    return np.array(ids, dtype="<u4").tobytes() if len(ids) > 64 else array("I", ids).tobytes()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors' cores are all in use
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = self._mode(spec)
        self.merges = Merges.of(spec, self.library.pre_tokenizer.pre_tokenize_str) if self.mode == "leading" else None
        # added tokens are found before a text is cut; these beginnings are alike before and after normal forms and lower-casing
        self.marks = {t["content"][:2] for t in spec.get("added_tokens") or []}
        if any(len(m) < 2 or not m.isascii() or m.isalnum() or any(c.isspace() or c.isalnum() for c in m) for m in self.marks):
            self.mode = "whole"
        if array("I", [1]).tobytes() != b"\x01\0\0\0":
            self.mode = "whole"
        self.clear()

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "leading"  # a space belongs to the word that follows
        parts = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        if parts == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
            return "dropped"  # white space ends a word and is no token
        return "whole"

    def clear(self) -> None:
        self.words: tuple[dict[str, bytes], ...] = ({}, {}, {})
        self.slots: dict[int, int] = {}
        self.used = 0
        self.pool = np.empty(1 << 20, dtype="<u4")
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.raw = np.empty(1 << 22, dtype=np.uint8)  # the parts themselves
        self.raw_used = 0
        self.raw_first = np.zeros(1 << 16, dtype=np.int64)
        self.raw_size = np.zeros(1 << 16, dtype=np.int64)

    def _encode(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, lead: int) -> bytes:
        """Of a word of letters, which is one unit for the tokenizer's model: that is asked directly where only byte symbols and lower case are needed."""
        if self.mode == "leading":
            text = LEADS[lead] + word
            symbols = "Ġ" * (lead == SPACED) + word if word.isascii() else text.encode().decode("latin-1").translate(_SYMBOLS)
        elif word.isascii():
            symbols = word.lower()
        else:
            return self._encode(word)
        return _bytes([t.id for t in self.model.tokenize(symbols)])

    def _part(self, part: str, lead: int) -> bytes:
        known = self.words[lead]
        got = known.get(part)
        if got is not None:
            return got
        if lead == LINED and part and not part[0].isspace():
            return self._part("", LINED) + self._part(part, PLAIN)
        m = _LETTERS.match(part)
        end = m.end() if m else 0
        if end == len(part) and end:
            got = known[part] = self._word(part, lead)
            return got
        # letters, then something else in ASCII: no token and no normal form crosses that border
        if end and part[end] < "\x80" and (part[:end].isascii() or self.mode == "leading" or normalize("NFC", part[:end]).lower().isalpha()):
            head = part[:end]
            got = known.get(head)
            if got is None:
                got = known[head] = self._word(head, lead)
            return got + self._part(part[end:], PLAIN)
        got = self._encode(LEADS[lead] + part)
        if len(part) < 8:
            known[part] = got
        return got

    def _add(self, keys: list[int], raw: list[bytes], leads: list[int]) -> None:
        """Keep new parts and their ids."""
        if self.merges:
            lead = [x.encode() for x in LEADS]
            got = self.merges.encode([lead[k] + p if p else p for p, k in zip(raw, leads)])
            got = [self._encode(LEADS[k] + p.decode()) if g is None else g for g, p, k in zip(got, raw, leads)]
        else:
            got = [self._part(p.decode(), k) for p, k in zip(raw, leads)]
        ids = np.frombuffer(b"".join(got), dtype="<u4")
        n, k = len(self.slots), len(keys)
        while n + k > len(self.first):
            self.first, self.count, self.raw_first, self.raw_size = (np.resize(x, 2 * len(x)) for x in (self.first, self.count, self.raw_first, self.raw_size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        size = np.array([len(g) // 4 for g in got], dtype=np.int64)
        self.count[n : n + k] = size
        self.first[n : n + k] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        while self.raw_used + len(text) > len(self.raw):
            self.raw = np.resize(self.raw, 2 * len(self.raw))
        size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_size[n : n + k] = size
        self.raw_first[n : n + k] = self.raw_used + np.cumsum(size) - size
        self.raw[self.raw_used : self.raw_used + len(text)] = text
        self.raw_used += len(text)
        self.slots.update(zip(keys, range(n, n + k)))

    def _strange(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places of parts that are not the part kept under their hash."""
        size = ends - starts
        odd = [np.flatnonzero(self.raw_size[slot] != size)]
        for lo in range(0, len(starts), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            n = np.where(self.raw_size[slot[part]] == size[part], size[part], 0)
            upto = np.r_[0, np.cumsum(n)]
            at = np.arange(upto[-1])
            here = np.repeat(starts[part] - upto[:-1], n)
            here += at
            kept = np.repeat(self.raw_first[slot[part]] - upto[:-1], n)
            kept += at
            wrong = np.flatnonzero(data[here] != self.raw[kept])
            if len(wrong):
                odd.append(lo + np.searchsorted(upto, wrong, side="right") - 1)
        return np.concatenate(odd)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, as little-endian bytes of 32 bits each; null is empty."""
        if self.mode == "whole":
            return [self._encode(t or "") for t in texts]
        if len(self.slots) > KEEP_PARTS or self.raw_used > KEEP_BYTES:
            self.clear()
        if sum(map(len, self.words)) > KEEP_WORDS:
            self.words = ({}, {}, {})
        raw = [(t or "").encode() for t in texts]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
        # a text ends where the next begins, and at each separator
        begin = np.cumsum(size + 1) - size - 1
        gaps = np.flatnonzero((data == 32) | (data == 10))
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        first = np.searchsorted(starts, begin)
        h = hash_words(data, starts, ends)
        lead = np.zeros(len(starts), dtype=np.int64)
        whole = [i for i, t in enumerate(texts) if t and any(m in t for m in self.marks)]
        if self.mode == "leading":
            lead[1:] = np.where(data[gaps] == 32, SPACED, LINED)
            inner = np.ones(len(starts), dtype=bool)
            inner[first] = False
            lead[~inner] = PLAIN
            h ^= _SALT[lead]
            # an empty part between two separators of one text
            last = np.zeros(len(starts), dtype=bool)
            last[np.r_[first[1:], len(starts)] - 1] = True
            twice = np.flatnonzero((starts == ends) & ~last)
            whole += (np.searchsorted(first, twice, side="right") - 1).tolist()
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = keys.tolist()
        slot = np.array([self.slots.get(k, -1) for k in known], dtype=np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            blob = data.tobytes()
            lo, hi = starts[at[new]].tolist(), ends[at[new]].tolist()
            n = len(self.slots)
            self._add(keys[new].tolist(), [blob[a:b] for a, b in zip(lo, hi)], lead[at[new]].tolist())
            slot[new] = np.arange(n, n + len(new))
        slot = slot[inverse]
        whole += (np.searchsorted(first, self._strange(data, starts, ends, slot), side="right") - 1).tolist()
        count = self.count[slot]
        upto = np.r_[0, np.cumsum(count)]
        ids = self.pool[np.repeat(self.first[slot] - upto[:-1], count) + np.arange(upto[-1])]
        cuts = upto[np.r_[first, len(starts)]].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for i in set(whole):
            out[i] = self._encode(texts[i] or "")
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    known = kept("tokens")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
