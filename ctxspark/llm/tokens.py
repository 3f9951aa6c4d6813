"""Token ids by the ``tokenizers`` library, each distinct word of a task encoded once.

The vocabulary lowers letters and its pre-tokenizer never joins characters across white space, so the ids of a text are
the ids of its words in order, ASCII letters lowered. A run of plain signs between an ASCII letter or digit and white
space is a word of its own (letters, digits and other characters are separate classes of the pre-tokenizer). A word of
composed Latin letters alone is one pre-token: it goes, in the byte alphabet, straight to the library's BPE model. Every
other word goes through the library's whole encoder, and so does a whole text with ``<|``, which may hold special tokens.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ctxspark.llm.common import split_words

SIGNS_AFTER_WORD, APART = r"([a-z0-9])([.,!?;:|]+)(\s|$)", r"\1 \2\3"


def byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet as a ``str.translate`` table over Latin-1: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class WordEncoder(dict):
    """``encode(texts)`` -> (ids per text, all ids as uint32). As a dict: word -> its number among the known words.

    The known words are forgotten when they exceed ``max_words``: memory is bounded, results don't change.
    """

    def __init__(self, path: str, max_words: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words, self.alphabet = Tokenizer.from_file(path), max_words, byte_alphabet()
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.sizes, self.starts = array("I"), array("q"), array("q")

    def __missing__(self, word: str) -> int:
        if word.isalpha() and max(word) < "ɐ" and "İ" not in word:
            if not word.isascii():
                word_bytes = word.lower().encode().decode("latin-1").translate(self.alphabet)
                ids = [t.id for t in self.model.tokenize(word_bytes)]
            else:
                ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self.starts.append(len(self.flat))
        self.flat.extend(ids)
        self.sizes.append(len(ids))
        self[word] = number = len(self.sizes) - 1
        return number

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), SIGNS_AFTER_WORD, APART)
        bounds, words = split_words(texts, lower=False)
        if not len(words):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        if len(self) > self.max_words:
            self.forget()
        number = np.fromiter(map(self.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        # views, gone before the next word is added
        flat, sizes, starts = (np.frombuffer(x, x.typecode) for x in (self.flat, self.sizes, self.starts))
        at = number[words.indices.to_numpy(zero_copy_only=False)]
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return np.diff(ends[bounds]), ids.astype(np.uint32, copy=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if not len(special):
            return self._plain(texts)
        own = {int(i): self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in special}
        sizes, ids = self._plain(pc.if_else(pc.match_substring(texts, "<|"), "", texts))
        ends = np.cumsum(sizes)
        parts = [np.array(own[i], np.uint32) if i in own else ids[ends[i] - sizes[i]:ends[i]] for i in range(len(texts))]
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker, kept for all its tasks: a word is encoded once per worker and not once per task."""
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
