"""Periodic runs of words: stretches that repeat with a period, at least three times over.

A run is a stretch of consecutive words with smallest period ``q`` and
length >= ``max(24, 3 q)`` that no neighbouring word extends. It is a diagonal:
words match the word ``q`` before them, at least 16 times in a row.

An online sparse dynamic program goes over the words. Each word looks up the
nearest earlier occurrence of itself *in its context* (the last ``g`` words), and
that adds one to the match length of the active lag; a lag that gets nothing
has ended and, if it is long enough, its run is emitted at once. Contexts keep
the program sparse without losing a run:

* lags up to 16 are matched by contexts of 16 words, lags in (g/2, g] by
  contexts of g = 32, 64, ...; a run with such a period has at least g matches
  in a row;
* with a context no shorter than the period, the nearest earlier occurrence
  inside a run lies exactly one smallest period back (two periods of one string
  have a common divisor as period), so other occurrences need no look: a word
  adds to one lag for each context length, whatever its frequency;
* contexts are named exactly: those of 16 words by a hash whose equal
  neighbours are compared word by word, longer ones by pairs of names of their
  halves. Only contexts that recur in their document go on to the next length.

Texts of a task are taken together in groups of about ``GROUP_WORDS`` words, a
document always whole. The work is n log n in the words, in no case n squared.

Defined results: null, empty and blank texts have no words and no runs; a null
``doc_id`` reads back as null and its words stay as they are; rows that repeat
an id or a text are judged each on its own; an empty table gives no rows; only
the named columns are read, so other columns cannot clash. ``collapse`` leaves
null texts and texts without runs untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import ids_of, keyed, schema, words

LEAST, TIMES = 24, 3
#: Words of the shortest context: a run of period q has max(24 - q, 2 q) >= 16 matches in a row.
CONTEXT = 16
GROUP_WORDS = 1 << 19

RUNS = schema(doc_id="long", start="long", length="long", period="long")
DIGEST = schema(
    doc_id="long", n_runs="long", start="long", length="long", period="long", exponent_milli="long",
    runs_sha256="string", collapsed_sha256="string",
)

Run = tuple[int, int, int]  # start, length, period


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs; products wrap around."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def contexts(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the 16-word contexts that recur in their document, ascending, and a name for each."""
    last = len(names) - CONTEXT + 1
    if last < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h, step = names.astype(np.uint64), 1
    while step < CONTEXT:
        h, step = mixed(h[:-step], h[step:]), 2 * step
    inside = np.flatnonzero(doc[:last] == doc[CONTEXT - 1 :])
    key = mixed(h[inside], doc[inside].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key, at = key[order], inside[order]
    same = key[1:] == key[:-1]
    a, b = at[:-1][same], at[1:][same]
    exact = doc[a] == doc[b]
    for i in range(CONTEXT):
        exact &= names[a + i] == names[b + i]
    if not exact.all():  # two contexts share a hash: name all that recur by their words
        some = np.unique(np.concatenate([a, b]))
        full = np.column_stack([doc[some], *[names[some + i] for i in range(CONTEXT)]])
        return some, np.unique(full, axis=0, return_inverse=True)[1].ravel()
    name = np.cumsum(np.r_[0, ~same])
    recurs = np.r_[same, False] | np.r_[False, same]
    at, name = at[recurs], name[recurs]
    order = np.argsort(at)
    return at[order], np.unique(name[order], return_inverse=True)[1].ravel()


def matches(names: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Last word, lag and length of the contexts that match their nearest earlier occurrence, by last word.

    ``names`` are the words of all documents one after another, ``doc`` the number of
    each word's document and ``sizes`` the words by document.
    """
    at, name = contexts(names, doc)
    ends, lags, widths, width, least = [], [], [], CONTEXT, 1
    while len(at):
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        before, here = at[order][:-1][same], at[order][1:][same]
        lag = here - before
        fits = (lag >= least) & (lag <= width) & (TIMES * lag <= sizes[doc[here]])
        ends.append(here[fits] + width - 1)
        lags.append(lag[fits])
        widths.append(np.full(int(fits.sum()), width))
        # contexts of twice the length: both halves recur, and the document has room for their lags
        next_to = np.minimum(np.searchsorted(at, at + width), len(at) - 1)
        both = (at[next_to] == at + width) & (doc[at[next_to]] == doc[at])
        both &= TIMES * (width + 1) <= sizes[doc[at]]
        pair = name[both] * np.int64(len(name) + 1) + name[next_to[both]]
        _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
        recurs = times[name] > 1
        at, name = at[both][recurs], name[recurs]
        least, width = width + 1, 2 * width
    if not ends:
        return (np.zeros(0, dtype=np.int64),) * 3
    ends, lags, widths = np.concatenate(ends), np.concatenate(lags), np.concatenate(widths)
    order = np.argsort(ends, kind="stable")
    return ends[order], lags[order], widths[order]


def diagonals(events: Iterable[tuple[int, int, int]]) -> list[Run]:
    """The online program over one document: (word, lag, context) in word order to runs."""
    active: dict[int, int] = {}  # match length by lag, of lags that matched at the last word
    found: list[Run] = []

    def ended(lags: dict[int, int], at: int) -> None:
        for lag, length in lags.items():
            if length + lag >= max(LEAST, TIMES * lag):
                found.append((at - length - lag + 1, length + lag, lag))

    grown: dict[int, int] = {}
    now = None
    for at, lag, width in events:
        if at != now:
            if now is not None:
                ended(active, now - 1)
                active, grown = grown, {}
                if at != now + 1:
                    ended(active, now)
                    active = {}
            now = at
        grown[lag] = active.pop(lag, width - 1) + 1
    if now is not None:
        ended(active, now - 1)
        ended(grown, now)
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as words, by start and then period."""
    table = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    names = np.fromiter((table[w] for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    ends, lags, widths = matches(names, doc, sizes)
    owners = doc[ends]
    found: list[list[Run]] = [[] for _ in texts]
    for low, high in zip(*edges(owners), strict=True):
        own = int(owners[low])
        part = slice(low, high)
        local = (ends[part] - first[own]).tolist()
        found[own] = diagonals(zip(local, lags[part].tolist(), widths[part].tolist(), strict=True))
    return found


def edges(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where stretches of equal values begin and end."""
    if not len(values):
        return [], []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(values)]


def kept(text: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return text
    stays = np.ones(len(text), dtype=bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [text[i] for i in np.flatnonzero(stays).tolist()]


def repeated(doc_id: int | None, text: list[bytes]) -> list[bytes]:
    """The words of a document in which a tenth of the ids, chosen by checksum, repeat a part to the end."""
    if doc_id is None or not text:
        return text
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    g, n = h // 10, len(text)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return text[:a] + (text[a : a + p] * times)[: n - a]


def groups(batch: pd.DataFrame, change: Callable | None) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """Ids and words of the documents of a batch, in groups of about ``GROUP_WORDS`` words."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(ids_of(batch), batch.text, strict=True):
        own = words(text)
        ids.append(doc_id)
        texts.append(change(doc_id, own) if change else own)
        size += len(own)
        if size >= GROUP_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def runs(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """All runs: doc_id, start, length and period in words. ``change(doc_id, words)`` can give other words."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, texts in groups(batch, change):
                rows = [(i, *r) for i, found in zip(ids, find_runs(texts), strict=True) for r in found]
                yield pd.DataFrame(rows, columns=RUNS.names).astype({"doc_id": "Int64"})

    return docs.select(*keyed("text")).mapInPandas(find, RUNS)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run in their texts cut to its first period; texts with runs get single spaces."""

    @F.pandas_udf(T.StringType())
    def collapsed(texts: pd.Series) -> pd.Series:
        out = texts.astype(object).tolist()
        at = 0
        for _, group in groups(pd.DataFrame({"doc_id": 0, "no_id": False, "text": texts}), None):
            for i, (own, found) in enumerate(zip(group, find_runs(group), strict=True), at):
                if found:
                    out[i] = b" ".join(kept(own, found)).decode("utf-8", "surrogatepass")
            at += len(group)
        return pd.Series(out, dtype=object)

    return docs.select(*[collapsed("text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, change: Callable | None = repeated) -> DataFrame:
    """Per document the number of runs, the run with the greatest exponent, and digests of runs and kept words."""

    def row(doc_id: int | None, text: list[bytes], found: list[Run]) -> tuple:
        best = (None,) * 4
        if found:
            top = found[0]
            for r in found[1:]:  # by start and period, so the first of equal exponents stays
                if r[1] * top[2] > top[1] * r[2]:
                    top = r
            best = (*top, 1000 * top[1] // top[2])
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        return doc_id, len(found), *best, listed, hashlib.sha256(b" ".join(kept(text, found))).hexdigest()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")}
        for batch in batches:
            for ids, texts in groups(batch, change):
                rows = [row(*r) for r in zip(ids, texts, find_runs(texts), strict=True)]
                yield pd.DataFrame(rows, columns=DIGEST.names).astype(kinds)

    return docs.select(*keyed("text")).mapInPandas(find, DIGEST)
