"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as one symbol per byte.  Leaf ``i`` of its tree holds the key of the pair that
starts at position ``i``: merge rank first, position second, so the root of the tree is the
leftmost pair of the lowest rank.  A merge changes at most three leaves (the merged symbol's
own pair, its left neighbour's pair and the pair that disappeared); each is a point update that
climbs to the root in logarithmic time.  Encoding ends when the root holds no pair.

Short words of a batch share one numpy array of trees, one row each, and take their merges in
step; long words walk a tree of their own.  Words repeat, so results are kept by word in a
cache of the Python worker that is bounded in bytes and emptied at the end of each task.

Nulls and edge cases: a null text counts as empty; an empty text or one of white space only has
no tokens and decodes to the empty text.  A very long text is encoded whole, as a batch of its own.  Every input row gives one output row, repeated rows and
null ids included; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sensortwin.llm.common import map_rows, texts_of

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words up to this many symbols are merged in step; longer ones one by one.
SHORT = 32
#: Bytes of remembered chunks (about, with what Python adds to each) after which a worker starts afresh.
CACHE_BYTES = 96 << 20
#: Bytes of texts encoded at once: they bound what one call adds to the cache.
SLICE_BYTES = 1 << 20
#: What Python adds to a chunk: three strings and two entries of a dictionary.
_ENTRY = 360
_NONE = np.iinfo(np.int64).max
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
_SPACE = regex.compile(r"\p{White_Space}+")


def tokenizer_file(path: str) -> str:
    """A path as it is; a bare file name is looked up in the public tokenizer package."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, free = [""] * 256, 256
    for b in range(256):
        if b in keep:
            chars[b] = chr(b)
        else:
            chars[b], free = chr(free), free + 1
    return chars


class BPE:
    """Encoder and decoder for a tokenizer file of the kind *lower-cased words with an end-of-word
    suffix*: NFC, lower case, a split pattern whose gaps are dropped, byte symbols, ranked merges."""

    def __init__(self, path: str):
        with open(tokenizer_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pair_keys, self.pair_ranks = pairs[order], order.astype(np.int64)
        self.rank_of = {int(p): r for r, p in reversed(list(enumerate(pairs)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Python's \s also takes U+001C to U+001F, which are no white space in Unicode
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        names = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.number = {i: str(i) for i in self.token}
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file(path))
        self.byte_of = {c: b for b, c in enumerate(chars)}
        #: Latin, Greek and Cyrillic letters, general punctuation and CJK, whose classes are long settled.
        self.common = regex.compile("[\\x00-\\u0370\\u0391-\\u03A1\\u03A3-\\u03CE\\u0400-\\u0481\\u2010-\\u2027\\u2030-\\u205E\\u20AC\\u2122\\u4E00-\\u9FA5]*").fullmatch
        self.forget()

    # -- ranks -----------------------------------------------------------------------------
    def _keys(self, a: np.ndarray, b: np.ndarray, pos: np.ndarray, width: int) -> np.ndarray:
        """rank * width + position of each pair; ``_NONE`` where the pair does not merge."""
        want = a << 32 | b
        at = np.searchsorted(self.pair_keys, want)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at] * width + pos, _NONE)

    # -- merging ---------------------------------------------------------------------------
    def _merge_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """Merge words of at most ``width`` symbols (a power of two), one tree per row."""
        n = len(words)
        sizes = np.array([len(w) for w in words])
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        every = np.arange(n)
        sym[every, sizes - 1] = self.last[raw[every, sizes - 1]]
        nxt = np.tile(np.arange(1, width + 1), (n, 1))
        prv = np.tile(np.arange(-1, width - 1), (n, 1))
        nxt[every, sizes - 1] = width  # the end
        tree = np.full((n, 2 * width), _NONE)
        if width > 1:
            r, p = np.nonzero(np.arange(1, width) < sizes[:, None])
            tree[r, width + p] = self._keys(sym[r, p], sym[r, p + 1], p, width)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2

        def put(rows: np.ndarray, pos: np.ndarray, keys: np.ndarray) -> None:
            at = pos + width
            tree[rows, at] = keys
            while width > 1 and at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        dead = np.zeros((n, width), bool)
        rows = every
        while width > 1:
            rows = rows[tree[rows, 1] != _NONE]
            if not len(rows):
                break
            rank, pos = np.divmod(tree[rows, 1], width)
            gone = nxt[rows, pos]
            after = nxt[rows, gone]
            sym[rows, pos] = self.merged[rank]
            dead[rows, gone] = True
            nxt[rows, pos] = after
            more = after < width
            keys = np.full(len(rows), _NONE)
            keys[more] = self._keys(sym[rows[more], pos[more]], sym[rows[more], after[more]], pos[more], width)
            prv[rows[more], after[more]] = pos[more]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, pos, keys)
            before = prv[rows, pos]
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                put(r, b, self._keys(sym[r, b], sym[r, pos[has]], b, width))
        kept = (np.arange(width) < sizes[:, None]) & ~dead
        flat, ends = sym[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_one(self, word: bytes) -> list[int]:
        """The same for one long word, in plain Python."""
        n, ranks, merged = len(word), self.rank_of, self.merged
        sym = [int(self.first[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def key(i: int, j: int) -> int:
            r = ranks.get(sym[i] << 32 | sym[j])
            return none if r is None else r * width + i

        for i in range(n - 1):
            tree[width + i] = key(i, i + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
                i >>= 1

        while (root := tree[1]) != none:
            rank, i = divmod(root, width)
            gone = nxt[i]
            after = nxt[gone]
            sym[i], sym[gone], nxt[i] = int(merged[rank]), -1, after
            put(gone, none)
            if after < n:
                prv[after] = i
                put(i, key(i, after))
            else:
                put(i, none)
            if prv[i] >= 0:
                put(prv[i], key(prv[i], i))
        return [s for s in sym if s >= 0]

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids and tokens of new chunks into the cache, merging their new words in bulk."""
        split = list(map(self._words, chunks))
        word_ids, word_tokens = self.word_ids, self.word_tokens
        by_width: dict[int, list[str]] = {}
        for w in {w for words in split for w in words if w not in word_ids}:
            n = len(w) if w.isascii() else len(w.encode())
            by_width.setdefault(0 if n > SHORT else 1 << (n - 1).bit_length(), []).append(w)
        number, token = self.number.__getitem__, self.token.__getitem__
        for width, group in by_width.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                raw = [w.encode() for w in part]
                for w, ids in zip(part, self._merge_many(raw, width) if width else map(self._merge_one, raw), strict=True):
                    word_ids[w], word_tokens[w] = i, t = " ".join(map(number, ids)), " ".join(map(token, ids))
                    self.held += len(w) + len(i) + len(t) + _ENTRY
        for c, words in zip(chunks, split, strict=True):
            if len(words) == 1:
                self.ids[c], self.tokens[c] = word_ids[words[0]], word_tokens[words[0]]
                self.held += len(c) + _ENTRY // 2
            else:
                self.ids[c], self.tokens[c] = i, t = " ".join([word_ids[w] for w in words]), " ".join([word_tokens[w] for w in words])
                self.held += len(c) + len(i) + len(t) + _ENTRY

    def _words(self, chunk: str) -> tuple[str, ...] | list[str]:
        """Normalised words of a chunk without white space.  Beyond the common scripts the tokenizer
        file's own normaliser and splitter decide, as their Unicode tables may be older."""
        if chunk.isascii():
            return (chunk.lower(),) if chunk.isalpha() else self.words(chunk.lower())
        if self.common(chunk):
            text = unicodedata.normalize("NFC", chunk)
            if "Σ" in text:  # str.lower() would look at the neighbours of a final sigma
                text = text.replace("Σ", "σ")
            return self.words(text.lower())
        text = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    # -- texts -----------------------------------------------------------------------------
    def _chunks(self, text: str) -> list[str]:
        """Pieces of a text that no token crosses: special tokens and what white space divides."""
        if self.special is None or "<|" not in text:
            return self._spaced(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._spaced(text[at : m.start()])
            out.append(" " + m.group())  # no other chunk holds a space
            at = m.end()
        return out + self._spaced(text[at:])

    @staticmethod
    def _spaced(text: str) -> list[str]:
        # str.split() also divides at U+001C to U+001F, which are no white space in Unicode
        return text.split() if _SEPARATORS.isdisjoint(text) else [c for c in _SPACE.split(text) if c]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) of every text."""
        split = [self._chunks(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.forget()
        known = self.ids
        self._learn(list({c for chunks in split for c in chunks if c not in known}))
        out = []
        for chunks in split:
            ids = " ".join(map(self.ids.__getitem__, chunks))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.tokens.__getitem__, chunks))))
        return out

    def forget(self) -> None:
        self.held = 0
        self.word_ids: dict[str, str] = {}
        self.word_tokens: dict[str, str] = {}
        self.ids = {" " + name: str(i) for name, i in self.specials.items()}
        self.tokens = {" " + name: name for name in self.specials}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a tokenizer file without a decoder asks for."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_TOKENIZER) -> BPE:
    """The encoder of a tokenizer file, one per Python worker."""
    return BPE(path)


def encode(docs: DataFrame, path: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``ids`` (token ids as array) and ``decoded`` (their text)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        rows = load(path).encode_batch(texts_of(batch))
        sizes = np.cumsum([0, *[n for n, _, _ in rows]], dtype=np.int32)
        flat = np.fromstring(" ".join([i for n, i, _ in rows if n]), np.int32, sep=" ")
        return {id_col: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), "decoded": [d for _, _, d in rows]}

    return map_rows(docs.select(id_col, docs[text_col].alias("text")), run, f"`{id_col}` {id_type}, ids array<int>, decoded string",
                    SLICE_BYTES, lambda: load(path).forget())


def digests(docs: DataFrame, path: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token count, SHA-256 of the ids and of the decoded text.  The same
    encoder as :func:`encode`, hashed inside the task so that ids need not leave it."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        rows = load(path).encode_batch(texts_of(batch))
        return {id_col: batch.column(0), "n_tokens": [n for n, _, _ in rows],
                "ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for _, i, _ in rows],
                "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, _, d in rows]}

    return map_rows(docs.select(id_col, docs[text_col].alias("text")), run,
                    f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE_BYTES, lambda: load(path).forget())
