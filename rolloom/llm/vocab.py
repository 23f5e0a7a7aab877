"""Pre-tokens and exact token ids of public tokenizers, worked out once per distinct piece of text.

Both tokenizers split a text into pre-tokens and merge inside each pre-token only,
so a pre-token's ids never depend on its neighbours. Special strings are cut out
first. Pre-tokens of texts within the Latin blocks are found by a pattern (equality
with the library is tested), those of other texts by the library's own pre-tokenizer.
For ids, each Python worker keeps a bounded table from pre-tokens (and from whole words
between blanks) to their ids, and a text's ids are the concatenation of table entries;
texts beyond the Latin blocks or with special strings take the library's whole path.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters below U+0180 by Unicode class; equality with the library is tested on each of them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t-\r \x85\xa0"
#: Texts with any of these take the library's path.
UNUSUAL = re.compile("[^\x00-\x1b\x20-įı-ſ]|<\\|")
BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-įı-ſ]")
#: Those of them that ASCII texts can have.
UNUSUAL_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
UNEVEN_BLANKS = re.compile(rf"[{BLANKS}] (?![^{BLANKS}])|[{BLANKS}][{BLANKS}] ")
BYTE_PIECES = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
WORD_PIECES = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
#: Single marks that often end a word.
MARKS = frozenset(".,;:!?")
#: Entries of a worker's tables; they start anew beyond.
TABLE_SIZE = 125_000
#: Characters of the texts that are worked on together.
SLICE = 4 << 20


def unusual(text: str) -> bool:
    if text.isascii():
        return any(x in text for x in UNUSUAL_ASCII)
    return UNUSUAL.search(text) is not None


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {b: b for b in own}, 0
    for b in range(256):
        if b not in table:
            table[b] = 256 + n
            n += 1
    return table


class Vocabulary:
    """A tokenizers file with tables of what has been seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, object] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= TABLE_SIZE:
                self.pieces.clear()
            mapped = text.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[text] = [t.id for t in self.library.model.tokenize(mapped)]
        return ids

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class BytePieces(Vocabulary):
    """Pre-tokens, and their numbers of tokens, under a byte-level vocabulary whose words carry the blank before them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.bytes = {letter: b for b, letter in ((b, chr(c)) for b, c in self.letters.items())}
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.special = set(added)

    def size(self, piece: str) -> int:
        """Tokens of one pre-token; a special string is one."""
        return 1 if piece in self.special else len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def _whole(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, by the library beyond the Latin blocks."""
        if not BEYOND_LATIN.search(text):
            return BYTE_PIECES.findall(text)
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def of_word(self, word: str) -> list[str]:
        """Pre-tokens of a word that follows a blank."""
        if word.isascii() and word.isalpha():
            return [" " + word]
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= TABLE_SIZE:
                self.words.clear()
            found = self.words[word] = BYTE_PIECES.findall(" " + word)
        return found

    def whole(self, text: str) -> Counter[str]:
        """How often each distinct pre-token occurs in a text, text by text."""
        if self.added is None or "<|" not in text:
            return Counter(self._whole(text))
        return Counter(p for i, part in enumerate(self.added.split(text)) for p in ([part] if i % 2 else self._whole(part)))

    def blocks(self, texts: Iterable[str | None]) -> Iterator[Block]:
        """The texts in order, a bounded number of characters at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text or "") > SLICE:
                yield self._block(held)
                held, size = [], 0
            held.append(text or "")
            size += len(text or "")
        if held:
            yield self._block(held)
        pa.default_memory_pool().release_unused()

    def _block(self, texts: list[str]) -> Block:
        even = [not unusual(t) and not UNEVEN_BLANKS.search(t) for t in texts]
        split = pc.split_pattern(pa.array([t if ok else "" for t, ok in zip(texts, even, strict=True)], pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        at, doc = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(ends))
        # The first word has no blank before it.
        later = np.ones(len(at), bool)
        later[ends[:-1] - ends[0]] = False
        others = [Counter(BYTE_PIECES.findall(t.partition(" ")[0])) if ok else self.whole(t) for t, ok in zip(texts, even, strict=True)]
        return Block(texts, words.dictionary.to_pylist(), at[later], doc[later], others)


class Block(NamedTuple):
    """Some texts: words that follow a blank by their place among the distinct ones, and each text's further pre-tokens."""

    texts: list[str]
    words: list[str]
    at: np.ndarray
    doc: np.ndarray
    others: list[Counter[str]]


class WordEncoder(Vocabulary):
    """Ids under a lower-case vocabulary that drops white space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.hot: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a word, as bytes. Words that come again are kept apart from those met once, which are soon forgotten."""
        ids = self.words.pop(word, None)
        if ids is not None:
            if len(self.hot) >= 2 * TABLE_SIZE:
                self.hot.clear()
            self.hot[word] = ids
            return ids
        if len(self.words) >= TABLE_SIZE:
            self.words.clear()
        ids = self.words[word] = self._worked_out(word)
        return ids

    def _worked_out(self, word: str) -> bytes:
        stem, last = word[:-1], word[-1:]
        if word.isalpha():  # one pre-token
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.library.model.tokenize(mapped)]
        elif last in MARKS and stem.isalpha():  # a word and a mark
            return (self.hot.get(stem) or self.words.get(stem) or self._worked_out(stem)) + array("I", self.piece(last)).tobytes()
        else:
            found = [i for p in WORD_PIECES.findall(word) for i in self.piece(p)]
        return array("I", found).tobytes()

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts within the Latin blocks: words are told apart by Arrow, and each distinct one is worked out once."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        ends = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        get = self.hot.get
        known = [get(w) or self._word(w) for w in words.dictionary.to_pylist()]
        if not known:
            return [np.empty(0, np.uint32)] * len(texts)
        at, sizes = words.indices.to_numpy(), np.fromiter(map(len, known), np.int64, len(known)) // 4
        count = sizes[at]
        stops = np.cumsum(count)
        flat, first = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes
        ids = flat[np.repeat(first[at] - (stops - count), count) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.r_[0, stops][ends - ends[0]]
        return [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            odd = unusual(text)
            if held and (odd or size + len(text) > SLICE):
                yield from self._latin(held)
                held, size = [], 0
            if odd:
                yield np.array(self.by_library(text), np.uint32)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._latin(held)
        pa.default_memory_pool().release_unused()


_open: dict[tuple[type, str], Vocabulary] = {}


def opened(kind: type, path: str) -> Vocabulary:
    """The worker's own instance, kept between tasks."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]
