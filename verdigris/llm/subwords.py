"""Subword ids by a public tokenizer, encoded once a word and worker; exact because the tokenizer never joins characters across white space."""

from __future__ import annotations

import os
import re

import numpy as np

#: Words (of at most so many bytes) that one worker remembers.
REMEMBERED, REMEMBERED_BYTES = 200_000, 32
#: Words that go to the tokenizer as one text.
TOGETHER = 256
_ENCODERS: dict[str, WordEncoder] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3; two signs among them are none.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and ends words by a mark.

    Such a tokenizer cuts letters from what is neither letter nor digit, so a text's ids are
    those of its words one after another, and a space may be put between a letter or digit and
    a following sign. Words are cut at ASCII white space and there; whatever else is in a word
    is left to the tokenizer. Frequent words are looked up. Others are encoded each time: words
    of letters many at once, told apart by the end mark of their last ids, the rest one by one.
    A text that may name a special token is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.first = np.zeros(REMEMBERED + 2, dtype=np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in order, and where each word's begin."""
        plain = [i for i, w in enumerate(words) if _LETTERS.fullmatch(w)]
        other = sorted(set(range(len(words))).difference(plain))
        parts: list = [None] * len(words)
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        coded = self.encode_batch([b" ".join(words[i] for i in g).decode() for g in groups], add_special_tokens=False)
        for group, one in zip(groups, coded, strict=True):
            ids = np.array(one.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):  # not a tokenizer with end marks
                other = sorted({*other, *group})
                continue
            for i, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                parts[i] = ids[a:b]
        for i, one in zip(other, self.encode_batch([words[i].decode("utf-8", "replace") for i in other], add_special_tokens=False), strict=True):
            parts[i] = np.array(one.ids, dtype=np.uint32)
        first = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=first[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), first

    def _remember(self, words: list[bytes], ids: np.ndarray, first: np.ndarray) -> None:
        slot = len(self.slots)
        if slot >= REMEMBERED:
            return
        at = self.first[slot]
        for k, word in enumerate(words):
            if slot >= REMEMBERED:
                break
            if len(word) > REMEMBERED_BYTES:
                continue
            n = first[k + 1] - first[k]
            if at + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[at : at + n] = ids[first[k] : first[k + 1]]
            at += n
            self.slots[word] = slot
            slot += 1
            self.first[slot] = at

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and where each word's begin (one more entry than words)."""
        get = self.slots.get
        slots = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(slots < 0)
        extra, extra_first = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        if len(new):
            unseen: dict[bytes, int] = {}
            slots[new] = [-1 - unseen.setdefault(words[i], len(unseen)) for i in new.tolist()]
            distinct = list(unseen)
            extra, extra_first = self._encode(distinct)
            self._remember(distinct, extra, extra_first)
        known = slots >= 0
        at = np.where(known, slots, 0)
        back = np.where(known, 0, -1 - slots)
        begin = np.where(known, self.first[at], extra_first[back] + len(self.ids))
        lengths = np.where(known, self.first[at + 1] - self.first[at], extra_first[back + 1] - extra_first[back])
        first = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(lengths, out=first[1:])
        source = np.repeat(begin - first[:-1], lengths)
        source += np.arange(first[-1])
        return (np.concatenate([self.ids, extra]) if len(extra) else self.ids)[source], first

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes between offsets) one after another, and where each text's begin."""
        low = LOWER[data]
        left = _ALNUM[low]
        if len(low):
            left[1:] |= (low[:-1] == 0xC3) & _LATIN[low[1:]]
        cut = np.flatnonzero(left[:-1] & _PUNCTUATION[low[1:]]) + 1
        spaced = np.insert(low, cut, 32).tobytes()
        ends = (offsets + np.searchsorted(cut, offsets)).tolist()
        split = [spaced[a:b].split() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        counts = np.zeros(len(split) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in split], out=counts[1:])
        ids, first = self.words([w for x in split for w in x])
        first = first[counts]
        raw = data.tobytes()
        if b"<|" not in raw:
            return ids, first
        parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if b"<|" in raw[a:b]:
                parts[i] = self.whole(raw[a:b])
        first = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=first[1:])
        return np.concatenate(parts), first


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, with what it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Let go of this worker's encoders; tasks that need none call it."""
    _ENCODERS.clear()


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
