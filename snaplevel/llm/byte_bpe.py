"""Words of a byte-level BPE vocabulary: how the tokenizers library cuts a text before it merges pairs.

The library merges pairs within a word only, so the ids of a text are those of its words, one after another.
`split` gives these words. Up to U+052F letters, numbers and white space are the same in every Unicode
version in use, and regular expressions cut the text; a text with any other character is cut by the
library's own splitter, whose Unicode tables may be newer than Python's.
"""

from __future__ import annotations

import functools
import json
import re
import threading

import regex

#: The word pattern of this family of vocabularies, alternatives of distinct first characters
#: in another order (letter runs are the most frequent). The first is for Latin-1 text, spelled out.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_TAIL = r"'(?:[stmd]|re|ve|ll)| ?{n}+| ?{o}+|{s}+(?!{x})|{s}+"
LATIN = re.compile(
    f" ?[{_LETTER}]+|"
    + _TAIL.format(n=f"[{_NUMBER}]", o=f"[^{_SPACE}{_LETTER}{_NUMBER}]", s=f"[{_SPACE}]", x=f"[^{_SPACE}]")
)
STABLE = regex.compile(r" ?\p{L}+|" + _TAIL.format(n=r"\p{N}", o=r"[^\s\p{L}\p{N}]", s=r"\s", x=r"\S"))
NOT_LATIN, NOT_STABLE = re.compile("[^\x00-\xff]"), re.compile("[^\x00-ԯ]")


class ByteBPE:
    """A vocabulary file of the tokenizers library of the byte-level kind, without added normalization."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        if not plain or spec.get("normalizer") or odd:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def _words(self, text: str) -> list[str]:
        if not NOT_LATIN.search(text):
            return LATIN.findall(text)
        if not NOT_STABLE.search(text):
            return STABLE.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """The words of a text; a special string is a word of its own."""
        if not self._special or not self._special.search(text):
            return self._words(text)
        words: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            words.extend([part] if k % 2 else self._words(part))
        return words

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pieces(self) -> dict[int, bytes]:
        """The bytes of every id; the printable characters of the file stand for bytes by the family's rule."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = set(self.specials)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        return {
            i: w.encode() if w in special else bytes(byte_of[c] for c in w) for w, i in vocabulary.items()
        }


_lock = threading.Lock()


@functools.cache
def _load(path: str) -> ByteBPE:
    return ByteBPE(path)


def load(path: str) -> ByteBPE:
    """The vocabulary, read once per Python process; one thread each, for Spark runs the tasks in parallel."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with _lock:
        return _load(path)
