"""Pre-tokens of the two public tokenizers, and what the tokenizer makes of each of them.

Byte-pair encoding never crosses the border of a pre-token, so a text's ids are its pre-tokens' ids one after another.
Texts over the letters and signs of ``SAFE`` are split here by plain character classes; any other text (other scripts,
control characters, strings of special tokens) goes whole to the library, so results are the library's in each case.
A worker keeps what it has met by chunk, the text between two blanks, since chunks hold whole pre-tokens; token counts look
a chunk up in the broadcast table of frequent pre-tokens first. A chunk that it
hasn't met is encoded by tiktoken with the same file's vocabulary as ranks, which costs a fraction of a library call for
each; a pair of neighbours merges in the same order under both, since the file numbers its merges by rank.
"""

from __future__ import annotations

import json
import re
import struct

#: Latin letters and number signs up to U+017F, as Unicode classes them (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
#: U+0130 and U+0149 are left out: their lower case is longer or their normal form differs.
SAFE = re.compile("[\t-\r -~ -įı-ňŊ-ſ–—‘’“-„…€]*")
#: The byte-level pattern of byte_bpe_50k.json over SAFE texts (fixed value).
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)
#: The word pattern of word_bpe_49k.json over SAFE texts in lower case (fixed value).
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: A blank next to other white space: there a pre-token may take in parts of two chunks.
ODD_BLANKS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \xa0")

#: Entries of a worker's cache, and the length from which a chunk isn't kept in it.
CACHE_ENTRIES = 600_000
CACHE_CHARS = 64


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def ranks(path: str, end: bytes) -> dict[bytes, int]:
    """A byte-level vocabulary as ranks, its word ends as the bytes of end. Ids must be the base letters' and then the
    merges' in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    suffix, vocab, merges = model["end_of_word_suffix"] or "", model["vocab"], model["merges"]
    base = len(vocab) - len(merges)
    if any(vocab[a + b] != base + i for i, (a, b) in enumerate(merges)):
        raise ValueError("ids don't follow the order of merges")
    out = {}
    for token, i in vocab.items():
        ends = suffix and token.endswith(suffix)
        out[bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + (end if ends else b"")] = i
    return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cached:
    """Chunk -> value, for chunks of safe texts; ``measure`` gives the values of chunks that aren't known."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.special = special_strings(self.tokenizer)
        self.known: dict = {}

    def safe(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def whole(self, text: str) -> list[int]:
        """The library on the whole text."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def values(self, chunks: list[str]) -> list:
        try:
            return list(map(self.known.__getitem__, chunks))
        except KeyError:
            pass
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        missing = [c for c in set(chunks) if c not in self.known]
        found = dict(zip(missing, self.measure(missing), strict=True))
        self.known.update((c, v) for c, v in found.items() if len(c) <= CACHE_CHARS)
        known = self.known
        return [known[c] if c in known else found[c] for c in chunks]


class ByteLevelCounts(_Cached):
    """Numbers of byte-level tokens. frequent: the first tier, pre-token -> number. A chunk after a blank that is one
    pre-token of the table is answered there; other chunks go through the cache of this worker, the second tier, where
    what is new is encoded. hits counts the chunks of each: table, cache, encoded."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import tiktoken

        super().__init__(path)
        self.frequent = frequent or {}
        self.led = {p[1:]: n for p, n in self.frequent.items() if p[0] == " "}  # by what follows the blank
        self.hits = [0, 0, 0]
        self.coder = tiktoken.Encoding("counts", pat_str=BYTE_LEVEL.pattern, mergeable_ranks=ranks(path, b""), special_tokens={})

    def of_text(self, text: str) -> int:
        """By pre-tokens if the table has them all, else encoded."""
        try:
            return sum(map(self.frequent.__getitem__, BYTE_LEVEL.findall(text)))
        except KeyError:
            return len(self.coder.encode_ordinary(text))

    def measure(self, chunks: list[str]) -> list[int]:
        self.hits[2] += len(chunks)
        self.hits[1] -= len(chunks)
        return [self.of_text(f" {c}") for c in chunks]

    def count(self, text: str) -> int:
        if not self.safe(text):
            return len(self.whole(text))
        if text.endswith(" ") or any(b in text for b in ODD_BLANKS):
            return self.of_text(text)
        chunks = text.split(" ")
        head = chunks.pop(0)
        found = list(map(self.led.get, chunks))
        missing = [c for c, n in zip(chunks, found, strict=True) if n is None] if None in found else []
        self.hits[0] += len(chunks) - len(missing)
        self.hits[1] += len(missing)
        return (self.of_text(head) if head else 0) + sum(filter(None, found)) + sum(self.values(missing))


class WordLevelIds(_Cached):
    """Packed ids of the word-level tokenizer, which drops white space and lower-cases: chunks stand by themselves."""

    #: Stands for a word's end; no safe text has it.
    END = "\0"

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks(path, self.END.encode()), special_tokens={})

    def measure(self, chunks: list[str]) -> list[bytes]:
        end, encode, split = self.END, self.coder.encode_ordinary, WORD_LEVEL.findall
        return [packed(encode(f"{end.join(split(c.lower()))}{end}")) for c in chunks]

    def ids(self, text: str) -> bytes:
        return b"".join(self.values(text.split())) if self.safe(text) else packed(self.whole(text))
