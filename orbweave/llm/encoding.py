"""Token ids of many short texts: each distinct word is encoded once per Python worker.

The vocabulary's pre-tokenizer never lets a token span white space and its normaliser works word by word, so the ids of
a text are the ids of its white-space-separated words, one after another. ``splits_at_space`` proves this for the file
that ``WordEncoder`` is given; where it does not hold, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# the white space of the tokenizer's patterns (Unicode White_Space); str.split() also splits at U+001C to U+001F
WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
MEMO = 500_000  # distinct words remembered in a Python worker, and as many again of those met before them
BLOCK = 200_000  # words of one text that are looked up at once
RUN = 512  # new cores encoded as one text
PARTED = re.compile("([A-Za-zÀ-ÖØ-öø-\\u012f\\u0131-\\u017e]+)([.,;:!?]*)").fullmatch  # without U+0130, which lower-cases to two characters


def splits_at_space(config: dict) -> bool:
    """True if the tokenizer file guarantees that white space is a hard border that leaves no token behind.

    Needed: added tokens take no part of the space around them and hold none; the normaliser only composes, lower-cases
    and squeezes white space; the pre-tokenizer keeps only matches of a pattern none of whose alternatives matches white
    space; nothing is added to the words or around the text.
    """
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in config["added_tokens"])
    norm = config["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = norm["normalizers"] if norm["type"] == "Sequence" else [norm]
    safe = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    pre = config["pre_tokenizer"] or {}
    parts = pre.get("pretokenizers", [])
    split = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    # every alternative names letters, digits or "not white space", or is a literal without space
    pattern = split and all(re.fullmatch(r"'\w+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", x) for x in parts[0]["pattern"]["Regex"].split("|"))
    return bool(added and safe and pattern and config["post_processor"] is None)


def words_of(text: str):
    """The words of a text between white space, lazily for a very long one."""
    if len(text) > 8 * BLOCK or any(c in text for c in SEPARATORS):
        return (m.group() for m in WORD.finditer(text))
    return iter(text.split())


class WordEncoder:
    """Encodes texts with a tokenizer file, each distinct word once; ids come as little-endian unsigned integers.

    A word is a core of letters and the punctuation behind it, which the pre-tokenizer always parts. Cores that are new
    are encoded many at a time, spaced out in one text, and told apart by the vocabulary's end-of-word mark; whenever the
    marks don't add up, or a word has another form, it is encoded alone.
    """

    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = splits_at_space(config)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the words remembered until ``words`` was last full
        self.cores: dict[str, bytes] = {}
        suffix = config["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _alone(self, words: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_cores(self, new: list[str]) -> None:
        runs = [new[i : i + RUN] for i in range(0, len(new), RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(run) or len(ids) != stops[-1]:
                self.cores.update(zip(run, self._alone(run), strict=True))
                continue
            packed, at = ids.tobytes(), 0
            for core, stop in zip(run, (stops * self.dtype.itemsize).tolist(), strict=True):
                self.cores[core] = packed[at:stop]
                at = stop

    def learn(self, words: set[str]) -> None:
        """Add words to ``self.words``."""
        parted, alone = [], []
        for w in words:
            if m := PARTED(w):
                core, tail = m.groups()
                parted.append((w, core.lower(), tail))
            else:
                alone.append(w)
        new = {c for _, c, _ in parted}.difference(self.cores)
        if new:
            if len(self.cores) + len(new) > MEMO:
                self.cores.clear()
                new = {c for _, c, _ in parted}
            self._learn_cores(list(new))
        tails = list({t for _, _, t in parted if t})
        of_tail = dict(zip(tails, self._alone(tails), strict=True))
        for w, core, tail in parted:
            self.words[w] = self.cores[core] + of_tail[tail] if tail else self.cores[core]
        self.words.update(zip(alone, self._alone(alone), strict=True))

    def _ready(self, needed: set[str]) -> None:
        """Have all of ``needed`` in ``self.words``; when that is full, only what was met since it was last full stays."""
        unseen = needed.difference(self.words)
        if not unseen:
            return
        if len(self.words) + len(unseen) > MEMO:
            self.before, self.words = self.words, {}
            unseen = needed
        known = unseen.intersection(self.before)
        self.words.update((w, self.before[w]) for w in known)
        self.learn(unseen.difference(known))

    def pieces(self, text: str | None):
        """The ids of a whole text as byte strings, in order; a very long text is looked up block by block."""
        if not text:
            return
        if not self.by_word:
            yield self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        words = words_of(text)
        while block := list(islice(words, BLOCK)):
            self._ready(set(block))
            yield b"".join(map(self.words.__getitem__, block))

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text))

    def encode(self, texts: list[str | None]):
        """(text's place, its ids) of the texts in order; the words of many short texts are looked up together."""
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, t in enumerate(texts):
            if not self.by_word or (t and len(t) > 8 * BLOCK):
                yield from self._flush(held)
                held, n = [], 0
                yield i, self.pieces(t)
                continue
            words = list(words_of(t)) if t else []
            held.append((i, words))
            n += len(words)
            if n > 2 * BLOCK:
                yield from self._flush(held)
                held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, list[str]]]):
        every: set[str] = set()
        for _, words in held:
            every.update(words)
        self._ready(every)
        for i, words in held:
            yield i, (b"".join(map(self.words.__getitem__, words)),)
