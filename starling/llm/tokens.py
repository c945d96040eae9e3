"""Token ids of whole texts by a public vocabulary, with an exact shortcut for Latin text.

The vocabulary file is a parameter and is read where it lies. ``word_bpe``
vocabularies split a normalised text into words and encode each word alone, so
the ids of a text are the ids of its words joined. ``WordEncoder`` encodes the
new words of a batch in one call of a byte-pair encoder made from the same
vocabulary, keeps the ids of words it has met (a bounded cache), and hands every
text outside the shortcut's alphabet to the vocabulary's own library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The vocabulary's word pattern, spelled for code points up to U+017F (letters, numbers, the rest).
LETTERS = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: Texts of these characters normalise by lower-casing alone; U+0130 lower-cases to two characters and U+00AD is left to the library.
OUTSIDE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xac\xae-įı-ſ]|<\|")
#: The byte that stands for a word's end while words are encoded; no text of the shortcut holds it.
END = "\x01"
CACHE_WORDS = 500_000
SAFE_ASCII = bytes([9, 10, 13, *range(0x20, 0x7F)])


def plain(text: str) -> bool:
    """The shortcut holds for this text."""
    if text.isascii():
        return not text.encode().translate(None, SAFE_ASCII) and "<|" not in text
    return not OUTSIDE.search(text)


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on in byte order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters, ranks = byte_letters(), {}
        for word, i in vocabulary.items():
            body = word.removesuffix("</w>") if word != "</w>" else word
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + (END.encode() if body != word else b"")] = i
        self.pairs = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for b, i in ranks.items() if b.endswith(END.encode()) and len(b) > 1]] = True
        self.known: dict[str, bytes] = {}

    def _new(self, chunks: list[str]) -> None:
        """Add chunks (without white space) to the cache."""
        words = [WORD.findall(c) for c in chunks]
        ids = np.array(self.pairs.encode_ordinary("".join([END.join(w) + END for w in words if w])), np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum([len(w) for w in words])
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], last])] * 4
        raw = ids.astype("<u4").tobytes()
        cuts = cuts.tolist()
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null is an empty text."""
        split = [None if not t or not plain(t) else t.lower().split() for t in texts]
        new = set()
        for s in split:
            if s:
                new.update(s)
        new = [w for w in new if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS and self.known:
            self.known.clear()
            new = list({w for s in split if s for w in s})
        if new:
            self._new(new)
        get = self.known.__getitem__
        return [
            b"".join(map(get, s)) if s is not None
            else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b""
            for s, t in zip(split, texts, strict=True)
        ]
