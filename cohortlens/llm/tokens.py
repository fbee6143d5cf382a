"""Token ids of whole texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

END_ID = 1
#: Characters of texts whose unseen words are encoded in one call.
TOGETHER = 1_000_000
_SPECIAL = "<|endoftext|>"
#: Marks that make one piece when they end a word; no apostrophe, which takes letters with it, and no ``<`` or ``|``.
_MARKS = ".,;:!?#$%&*)\"-"
#: Letters that are composed already and that Python lower-cases as the library does.
_LATIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch
_LOADED: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file whose pieces never reach across spaces.

    Words between spaces, tabs and line feeds are encoded once and remembered. Unseen words of a text are
    encoded in one call: runs of letters, with or without one run of marks after them, are told apart by the
    tokens that end a word, all others by a special token between them. Where those letters are Latin-1,
    composing, lower-casing and cutting words by pattern change nothing that Python's ``lower`` and a space
    before the marks don't, so the library is called without these steps. Texts come out exactly as
    ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, special tokens in texts included.
    """

    MOST = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = Tokenizer.from_file(path)
        self.cut.normalizer = None
        self.cut.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator = self.tokenizer.token_to_id(_SPECIAL)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode unseen words in one call: plain ones are cut at their tokens that end a word."""
        latin, wide, rest = ([], [], []), ([], [], []), []
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem.isalpha() and "\u0130" not in w:
                kept, ends, pieces = latin if w.isascii() or _LATIN(stem) else wide
                kept.append(w)
                if len(stem) == len(w):
                    ends.append(1), pieces.append(w)
                else:
                    ends.append(2), pieces.append(f"{stem} {w[len(stem):]}")
            else:
                rest.append(w)
        for tokenizer, (kept, ends, pieces) in ((self.cut, latin), (self.tokenizer, wide)):
            if not kept:
                continue
            text = " ".join(pieces)
            ids = np.array(tokenizer.encode_batch_fast([text.lower() if tokenizer is self.cut else text], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(ends) - 1
            if len(stops) == last[-1] + 1:
                self._keep(kept, ids, np.r_[0, stops[last][:-1]], stops[last])
            else:
                rest += kept
        special = [w for w in rest if "<|" in w]
        rest = [w for w in rest if "<|" not in w]
        if rest:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_SPECIAL} ".join(rest)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            self._keep(rest, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
        for w in special:
            self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        data = ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip((starts * 4).tolist(), (stops * 4).tolist())], strict=True))

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, without an end id."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: Iterable[str | None]) -> list[bytes]:
        """``ids`` of each text. Unseen words of about TOGETHER characters of texts are encoded in one call."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(text.replace("\n", " ").replace("\t", " ").split(" ") if text else [])
            size += len(text) if text else 0
            if size > TOGETHER:
                out += self._look_up(held)
                held, size = [], 0
        return out + self._look_up(held)

    def _look_up(self, texts: list[list[str]]) -> list[bytes]:
        known = self.known
        words = set(chain.from_iterable(texts))
        new = [w for w in words if w not in known]
        if new:
            if len(known) > self.MOST:
                known.clear()
                new = list(words)
            self._learn(new)
        return [b"".join(map(known.__getitem__, t)) for t in texts]


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
