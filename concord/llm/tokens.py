"""Token ids of whole texts, encoded piecewise.

Both vocabularies used here never merge across the pieces cut below. Texts are
taken in groups: marks after words are set apart, texts are cut at the spaces
and pieces are numbered, all by Arrow; each different piece of a group is encoded
once by the ``tokenizers`` library, and ids of all texts are then gathered with
numpy. What is not a plain word is cut further by pattern. Pieces stay known from group to group in a bounded
cache: when its young half is full, that becomes the old half, and what is
still used moves back. An entry takes about 230 bytes, so ``CACHED`` bounds
a task to some 64 MB, which it gives back when it ends. Long pieces are not kept. A test compares with encoding
whole texts.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from concord.llm.common import ids_of, tokenizer_path

#: White space as the library's patterns have it (Python's own class also holds four control characters).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Letters before a space or a mark are a word of their own in both vocabularies.
WORD = rf"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[{SPACE}.,;:!?]|\Z)"

#: Pieces by vocabulary file: in the first, white space is dropped and always separates; in the
#: second, the last space before a word belongs to it and other white space stands alone.
PIECES = {
    "word_bpe_49k.json": re.compile(rf"{WORD}|[^{SPACE}]+"),
    "byte_bpe_50k.json": re.compile(rf" ?{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
}
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN = re.compile(f"[{LETTERS}]+")
BLANK = re.compile(rf"[{SPACE}]")

#: A mark between a letter or digit and a space is a piece of its own; a sign keeps it apart, another one marks what has no space before it.
MARKS, APART, FIRST = ".,;:!?", "\x01", "\x02"
#: As Arrow has its patterns.
ENDING, ENDING_APART = f"([0-9{LETTERS}])([{MARKS}]) ", f"\\1 {APART}\\2 "
#: A line end without white space beside it, by vocabulary file: a space will do, or it is a piece of its own.
LINE_ENDS = {
    "word_bpe_49k.json": ("\n", " "),
    "byte_bpe_50k.json": (f"([^{SPACE}])\n([^{SPACE}])", f"\\1 {APART}\n {FIRST}\\2"),
}


def spelling() -> dict[int, str]:
    """How byte-level vocabularies spell characters: a printable byte as itself, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of_byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(256)}


#: Plain words as the model of a vocabulary gets them from its normaliser and splitter, with a space before them or not.
SPELT = {
    "word_bpe_49k.json": lambda word, spaced: word.lower().translate(SPELLING),
    "byte_bpe_50k.json": lambda word, spaced: (" " + word if spaced else word).translate(SPELLING),
}
#: Whether white space is part of the tokens; where it is not, it only separates.
SPACED = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}
SPELLING = spelling()
#: Pieces in both halves of the cache, the longest of them, and pieces of a group of texts, which has at most 8 times as many characters.
CACHED, LONGEST, GROUP_PIECES = 280_000, 40, 1_500_000
#: Words that the library is asked for, and pieces whose ids are gathered, at once.
ASKED, GATHERED = 1024, 1 << 17


def caches() -> dict[str, object]:
    """Tokenizers by vocabulary file, kept by the process for the tasks it runs one after another.

    Functions travel to executors by value, so a global of this module would start empty in each task.
    """
    return sys.modules.setdefault("_concord_token_caches", types.ModuleType("_concord_token_caches")).__dict__


class Cache:
    """Two halves of at most ``most`` entries together."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        self.keep_all([key], [value])

    def keep_all(self, keys: Iterable[str], values: Iterable[bytes]) -> None:
        for key, value in zip(keys, values, strict=True):
            if len(key) <= LONGEST:
                if len(self.young) >= self.half:
                    self.young, self.old = {}, self.young
                self.young[key] = value


class Encoder:
    """``encode(text)`` gives the ids of one text, with the end id, as unsigned 32-bit integers; ``many`` those of many."""

    def __init__(self, name: str, end_id: int = 1):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        if path not in caches():
            caches()[path] = Tokenizer.from_file(path)
        self.library, self.known = caches()[path], Cache(CACHED)
        self.pieces, self.spelt, self.spaced = PIECES[name], SPELT[name], SPACED[name]
        self.model, self.line_end = self.library.model, LINE_ENDS[name]
        self.end = np.array([end_id], dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        group, pieces, characters = [], 0, 0
        for text in texts:
            text = text or ""
            # a special token also decides how the space before it is cut
            odd = "<|" in text or APART in text or FIRST in text
            group.append((text, self.encoded(text) if odd else None))
            pieces, characters = pieces + text.count(" ") + 1, characters + len(text)
            if pieces >= GROUP_PIECES or characters >= 8 * GROUP_PIECES:
                yield from self.encode_group(group)
                group, pieces, characters = [], 0, 0
        yield from self.encode_group(group)

    def batches(self, batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int | None, np.ndarray]]:
        """Id and token ids of each document; groups go on from batch to batch."""
        waiting = deque()

        def texts() -> Iterator[str | None]:
            for batch in batches:
                waiting.extend(ids_of(batch))
                yield from batch.text

        for ids in self.many(texts()):
            yield waiting.popleft(), ids

    def encode_group(self, group: list[tuple[str, bytes | None]]) -> Iterator[np.ndarray]:
        """The ids of each text of a group; an odd text comes with its ids."""
        texts = pa.array([FIRST + text if text and odd is None else None for text, odd in group], pa.large_string())
        texts = pc.replace_substring_regex(texts, *self.line_end)
        pieces = pc.split_pattern(pc.replace_substring_regex(texts, ENDING, ENDING_APART), " ")
        upto = np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(), dtype=np.int64)
        named = pieces.flatten().dictionary_encode()
        order = named.indices.to_numpy()
        del texts, pieces
        values = self.chunks(named.dictionary)
        nothing = np.array([v is None for v in values], dtype=bool)
        lengths = np.array([len(v or b"") // 4 for v in values], dtype=np.int64)
        ids = np.frombuffer(b"".join([v or b"" for v in values]), dtype="<u4")
        starts, first, at = np.cumsum(lengths) - lengths, 0, 0
        while first < len(group):
            last = max(first + 1, int(np.searchsorted(upto, at + GATHERED, "right")))
            own, ends = order[at : upto[last - 1]], upto[first:last] - at
            n = lengths[own]
            before = np.concatenate([[0], np.cumsum(n)])
            out = ids[np.repeat(starts[own] - before[:-1], n) + np.arange(before[-1])]
            gaps = np.concatenate([[0], np.cumsum(nothing[own])])[ends]
            start = gap = 0
            for (text, odd), end, gap_upto in zip(group[first:last], before[ends].tolist(), gaps.tolist(), strict=True):
                if odd is not None:
                    yield np.frombuffer(odd + self.end, dtype="<u4")
                elif gap_upto > gap:  # white space meets white space
                    yield np.frombuffer(self.cut(text) + self.end, dtype="<u4")
                else:
                    yield np.frombuffer(out[start:end].tobytes() + self.end, dtype="<u4")
                start, gap = end, gap_upto
            first, at = last, int(upto[last - 1])

    def chunks(self, names: pa.Array) -> list[bytes | None]:
        """As ``chunk`` for different chunks; plain words that are not known go to the library one after another."""
        plain = pc.match_substring_regex(names, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False).tolist()
        names, known = names.to_numpy(zero_copy_only=False).tolist(), self.known
        values = list(map(known.young.get, names))
        new = []
        for i, value in enumerate(values):
            if value is None:
                if plain[i] and names[i] not in known.old:
                    new.append(i)
                else:
                    values[i] = self.chunk(names[i])
        for k in range(0, len(new), ASKED):
            places = new[k : k + ASKED]
            words = [names[i] for i in places]
            tokens = list(map(self.model.tokenize, self.spelt_all(words)))
            ids = array("I", [t.id for own in tokens for t in own]).tobytes()
            ends = list(accumulate([4 * len(own) for own in tokens]))
            found = [ids[start:end] for start, end in zip([0, *ends], ends)]
            known.keep_all(words, found)
            for i, value in zip(places, found, strict=True):
                values[i] = value
        return values

    def spelt_all(self, words: list[str]) -> list[str]:
        """Plain words with a space before them, as the model gets them; letters of ASCII are spelt as they are."""
        if self.spaced:
            return [SPELLING[32] + word if word.isascii() else self.spelt(word, True) for word in words]
        return [word.lower() if word.isascii() else self.spelt(word, True) for word in words]

    def encoded(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, word: str, spaced: bool) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(self.spelt(word, spaced))]).tobytes()

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of what stands between two spaces, with the first of them; None where white space meets white space."""
        ids = self.known.get(chunk)
        if ids is not None:
            return ids
        if PLAIN.fullmatch(chunk):
            ids = self.plain(chunk, True)
        elif chunk[:1] == FIRST:
            return self.cut(chunk[1:])
        elif chunk[:1] == APART:
            ids = self.cut(chunk[1:])
        elif self.spaced and (not chunk or BLANK.match(chunk)):
            return None
        else:
            return self.cut(" " + chunk if self.spaced else chunk)
        self.known.keep(chunk, ids)
        return ids

    def cut(self, text: str) -> bytes:
        """Ids of any text, piece by piece."""
        pieces, get = self.pieces.findall(text), self.known.young.get
        values = map(get, [FIRST + piece for piece in pieces])
        return b"".join([self.piece(p) if v is None else v for p, v in zip(pieces, values)])

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(key := FIRST + piece)
        if ids is None:
            if PLAIN.fullmatch(piece):
                ids = self.plain(piece, False)
            elif self.spaced and PLAIN.fullmatch(piece, 1) and piece[0] == " ":
                ids = self.plain(piece[1:], True)
            else:
                ids = self.encoded(piece)
            self.known.keep(key, ids)
        return ids

    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)
