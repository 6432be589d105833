"""Token ids of whole texts, as the `tokenizers` library gives them, each different word encoded once.

Texts of common Latin letters are cut into words, and the words numbered; words not met before are encoded together and
every text gathers the ids of its words.  Words recur, so few are encoded; they are merged by `tiktoken`, from the ranks of
the vocabulary file.  Any other text is cut only where its tokenizer always begins a new word, and its pieces go to
the library through a memo.
"""

from __future__ import annotations

import json
import re
import threading
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

ID = np.dtype("<u4")
MAX_PIECES = 400_000
MAX_WORDS = 250_000

#: Splitting patterns of the two vocabularies (fixed values).
BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LOWER_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: Pieces of these characters split alike under every Unicode version; others go to the library whole.
PLAIN = re.compile(r" ?[\x21-\x7eÀ-įı-ɏ]+")
BEYOND = "ɐ"
#: Texts of these characters are split, lower-cased and normalised alike by every library here.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*")
#: A character that is in no common text; it stands after every word that is to be encoded.
MARK = "\x01"


def _common(kind: str) -> str:
    """The characters of common texts of a Unicode category, for a class of `re`, which is faster than `regex`."""
    both = (chr(c) for c in range(0x21, ord(BEYOND)))
    return "".join(re.escape(c) for c in both if COMMON.fullmatch(c) and regex.fullmatch(rf"\p{{{kind}}}", c))


_L, _N = _common("L"), _common("N")
COMMON_BYTE_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
COMMON_LOWER_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
CHUNK_CHARS = 1 << 21
#: Longer words go to the library, whose time does not grow with their square.
LONG_WORD = 256
ALONE = re.compile(r"(?<=\S)([ \n])(?=\S)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


LETTERS = _byte_letters()
SPACE = LETTERS[0x20]


class _Touching(Exception):
    """White space stands beside a cut, so the cut is not safe."""


class _Memo(dict):
    """A dictionary that works missing values out; when full, it keeps the values used since it last was."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Numbers(dict):
    """Numbers words in the order they are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Words:
    """Ids of numbered words, which are encoded together when they are first met."""

    def __init__(self, path: str, lower: bool, whole: Callable[[str], bytes]):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {ord(letter): b for b, letter in LETTERS.items()}
        ranks = {}
        for token, rank in model["vocab"].items():
            ends = lower and token.endswith("</w>")
            letters = (token.removesuffix("</w>") if ends else token).translate(back)
            if all(ord(c) < 256 for c in letters) and not token.startswith("<|"):
                ranks[letters.encode("latin-1") + (MARK.encode() if ends else b"")] = rank
        merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        if sorted(merged) != merged or min(merged) < 256 * (1 + lower):
            raise ValueError("ids do not follow the order of the merges")
        self.lower, self.whole = lower, whole
        pattern = f"[^{MARK}]+{MARK}" if lower else f"[^{MARK}]+|{MARK}"
        self.merger = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # what ends a word: ids of tokens that do, or the mark itself
        last = np.zeros(max(ranks.values()) + 1, bool)
        last[[r for t, r in ranks.items() if (t.endswith(MARK.encode()) and len(t) > 1 if lower else t == MARK.encode())]] = True
        self.last = last
        self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.ends = _Numbers(), np.empty(0, ID), np.zeros(1, np.int64)

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Encodes the words numbered since it last did."""
        new = list(islice(self.numbers, len(self.ends) - 1, None))
        if not new:
            return
        long = {i: np.frombuffer(self.whole(w), ID) for i, w in enumerate(new) if len(w) > LONG_WORD}
        for i in long:
            new[i] = "a"
        ids = self.merger.encode_to_numpy(MARK.join(new) + MARK).astype(ID)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("words and their ends differ in number")
        if not self.lower:
            ids, ends = ids[~self.last[ids]], ends - np.arange(1, len(ends) + 1)
        if long:
            parts = np.split(ids, ends[:-1])
            for i, found in long.items():
                parts[i] = found
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many there are of each word."""
        first, many = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        before = np.cumsum(many) - many
        return self.ids[np.repeat(first - before, many) + np.arange(many.sum())], many


class Encoder:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit integers, without special tokens.

    The strings of special tokens in a text become special ids, as the library has it, unless `plain_text`
    is set; then they are ordinary text, and no text can give a special id.
    """

    def __init__(self, path: str, plain_text: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_text
        self.model = self.library.model
        self.lower = self.library.normalizer is not None
        self.words = _Memo(self._word, MAX_WORDS)
        self.heads = _Memo(self._head, MAX_PIECES)
        self.tails = _Memo(self._tail, MAX_PIECES)
        self.newline = b"" if self.lower else self._whole("\n")
        self.plain_text = plain_text
        self.table = Words(path, self.lower, self._whole)

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of every text, in turn."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        split = (COMMON_LOWER_WORDS if self.lower else COMMON_BYTE_WORDS).findall
        numbered = []
        for text in texts:
            common = not text or COMMON.fullmatch(text) and (self.plain_text or "<|" not in text)
            numbered.append(self.table.number(split(text.lower() if self.lower else text) if text else []) if common else None)
        self.table.learn()
        words = [n for n in numbered if n is not None]
        ids, many = self.table.gather(np.concatenate(words) if words else np.empty(0, np.int64))
        ends, word, at = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)]), 0, 0
        for text, n in zip(texts, numbered, strict=True):
            if n is None:
                yield np.frombuffer(self.encode(text), ID)
            else:
                word += len(n)
                yield ids[at : ends[word]]
                at = ends[word]
        if len(self.table.numbers) > MAX_WORDS:
            self.table.forget()

    def _whole(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, ID).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            mapped = word.encode().decode("latin-1").translate(LETTERS)
        else:
            mapped = SPACE + word[1:] if word[0] == " " else word
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not PLAIN.fullmatch(piece) or "<|" in piece:
            return self._whole(piece)
        found = LOWER_WORDS.findall(piece.lower()) if self.lower else BYTE_WORDS.findall(piece)
        return b"".join(map(self.words.__getitem__, found))

    def _head(self, piece: str) -> bytes:
        if not self.lower:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Touching
            return self._piece(piece)
        if piece.isalpha() and max(piece) < BEYOND and "İ" not in piece:
            return self.words[piece.lower()]
        if (stem := piece[:-1]).isalpha() and piece[-1] in ".,!?" and max(stem) < BEYOND and "İ" not in stem:
            return self.words[stem.lower()] + self.words[piece[-1]]
        return self._piece(piece) if piece else b""

    def _tail(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) < BEYOND:
            return self.words[" " + piece]
        if (stem := piece[:-1]).isalpha() and piece[-1] in ".,!?" and max(stem) < BEYOND:
            return self.words[" " + stem] + self.words[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Touching
        return self._piece(" " + piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.lower:
            return b"".join(map(self.heads.__getitem__, text.replace("\n", " ").split(" ")))
        try:
            out = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out += (self.newline, self.heads[first])
                out += map(self.tails.__getitem__, rest)
            return b"".join(out[1:])
        except _Touching:
            return self._spaced(text)

    def _spaced(self, text: str) -> bytes:
        """As `encode`, cut only at single spaces and line ends between other characters."""
        first, *rest = ALONE.split(text)
        out = [self._whole(first)]
        for cut, piece in zip(rest[::2], rest[1::2], strict=True):
            out += (self.newline, self._piece(piece)) if cut == "\n" else (self._piece(" " + piece),)
        return b"".join(out)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
_LOCK = threading.Lock()


def encoder(path: str, plain_text: bool = False) -> Encoder:
    """This process's encoder of a vocabulary file; its memo serves all tasks that the process runs."""
    with _LOCK:
        if (path, plain_text) not in _ENCODERS:
            _ENCODERS[path, plain_text] = Encoder(path, plain_text)
        return _ENCODERS[path, plain_text]
