"""Exact, fast token ids for the two public byte-level vocabularies.

Both engines give what the ``tokenizers`` library gives for the same file. They use tiktoken's BPE
core where that is proven equal, and the library itself for everything else:

* a BPE whose every merged token comes out whole when encoded alone ("proper") gives the same
  result whether merges are looked up by pair or by the joined bytes, as any span of a longer word
  goes through the same merges as it does alone until something crosses its border;
  ``tests/llm/test_tokenize.py`` proves properness for both files;
* only texts over characters whose class is the same in all Unicode versions take that way.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# The split patterns of the two vocabularies.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = b"\xff"  # never part of UTF-8: stands for the end of a word
SAFE = re.compile("[\x00-\x1b\x20-\x84\x86-ɏ‐-‧€]*")  # not 1C-1F and 85: kinds of white space differ
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=>?@\\[-`{-~]*)")  # a word, and marks but for ' and <
WORD_MEMO = 600_000


def byte_chars() -> dict[str, int]:
    """The public byte-to-character table of byte-level BPE, by its rule, reversed."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    rest = [b for b in range(256) if b not in set(keep)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def load_model(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict]:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    return whole["model"]["vocab"], merges, whole


class ByteBpe:
    """Byte-level BPE without word ends (byte_bpe_50k.json)."""

    def __init__(self, path: str):
        vocab, merges, whole = load_model(path)
        back = byte_chars()
        enc = lambda t: bytes(back[c] for c in t)
        self.special = [a["content"] for a in whole["added_tokens"]]
        names = set(self.special)
        order = {enc(a + b): i for i, (a, b) in enumerate(merges, 256)}
        ranks = {enc(t): i for t, i in vocab.items() if t not in names}
        self.same_order = all(ranks[t] == i for t, i in order.items())
        if not self.same_order or whole.get("normalizer") or whole["pre_tokenizer"].get("type") != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary in merge order")
        self.core = tiktoken.Encoding("bytes", pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)
        self.exact = Tokenizer.from_file(path)
        self.split = regex.compile("|".join(map(re.escape, self.special))) if self.special else None

    def safe(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        if self.safe(text):
            return self.core.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def parts(self, text: str) -> list[str]:
        """The texts between special strings, which the library takes out first; each is one token."""
        if self.split is None or not any(s in text for s in self.special):
            return [text]
        return self.split.split(text)


class WordBpe(dict):
    """BPE with word ends, lower case, white space dropped (word_bpe_49k.json).

    White space parts words whatever stands around it, so ids are kept by word: a dict from a
    word's UTF-8 bytes to its row in ``start``, ``size`` and ``stop``. The tables are cleared when
    they hold WORD_MEMO words.
    """

    def __init__(self, path: str):
        super().__init__()
        vocab, merges, whole = load_model(path)
        back = byte_chars()
        end = whole["model"]["end_of_word_suffix"]

        def enc(t: str) -> bytes:
            word = t.endswith(end)
            return bytes(back[c] for c in (t[: -len(end)] if word else t)) + MARK * word

        names = {a["content"] for a in whole["added_tokens"]}
        ranks = {bytes([b]) + MARK: b for b in range(256)}
        for i, (a, b) in enumerate(merges):
            ranks[enc(a + b)] = 256 + i
        ids = {r: vocab.get(t) for t, r in ((t, ranks.get(enc(t))) for t in vocab if t not in names) if r is not None}
        n = max(ranks.values()) + 1
        for b in range(256):
            ranks.setdefault(bytes([b]), n + b)
        singles = {enc(t): i for t, i in vocab.items() if t not in names and len(t) == 1}
        ids |= {n + t[0]: i for t, i in singles.items() if t != MARK}
        self.core = tiktoken._tiktoken.CoreBPE(ranks, {}, r"\S+")
        self.ids = np.full(n + 256, -1, np.int64)
        for r, i in ids.items():
            self.ids[r] = i
        self.of = self.ids.tolist()
        self.exact = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.start, self.size, self.stop = array("i"), array("q"), array("i"), array("b")

    def word(self, word: bytes) -> list[int]:
        text = word.decode()
        if m := PLAIN.fullmatch(text):
            low, marks = m[1].lower().encode(), m[2].encode()
            got = self.core.encode_single_piece(low + MARK)
            if marks:
                got = got + self.core.encode_single_piece(marks + MARK)
            of = self.of
            return [of[r] for r in got]
        return self.exact.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        ids = self.word(word)
        self[word] = row = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.stop.append(word[-1:] in b".!?")
        self.flat.extend(ids)
        return row

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 texts -> ids of all one after another; tokens of each text; word lengths; word ends a sentence."""
        if len(self) > WORD_MEMO:
            self.reset()
        words = [t.split() for t in texts]
        n = sum(map(len, words))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, n)
        flat, size, stop = (np.frombuffer(x, k) if len(x) else np.zeros(0, k) for x, k in ((self.flat, np.int32), (self.size, np.int32), (self.stop, np.int8)))
        start = np.frombuffer(self.start, np.int64) if len(self.start) else np.zeros(0, np.int64)
        lens = size[rows].astype(np.int64)
        ends = np.cumsum(lens)
        where = np.arange(int(lens.sum())) + np.repeat(start[rows] - (ends - lens), lens)
        per = np.fromiter(map(len, words), np.int64, len(words))
        at = np.concatenate([[0], np.cumsum(per)])
        cum = np.concatenate([[0], ends])
        return flat[where].astype(np.uint32), cum[at[1:]] - cum[at[:-1]], lens, stop[rows].astype(bool)


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
