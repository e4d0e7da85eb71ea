"""Quality rules: a linear-chain CRF labels lines, the share of content decides on the document.

Each line with a word gets yes/no features; Viterbi decoding of a chain with
two states marks it content or boilerplate, and a document is kept if at least
``MIN_SHARE`` of its words lie in content lines and the base rules hold. The
chain is trained here, on at most ``per_class`` labelled documents a class
(those with the smallest hash of the id, none of over ``max_lines`` lines):
lines inherit the class of their document, and a Gaussian prior holds the
weights near ``PRIOR``, which is also the model where there are no labels.

Defined results: a null, empty or blank text has no words and fails the base
rules; repeated rows are judged each on its own; whole texts are read at any
length; labels that are null or name no document are ignored; of several
labels of a document the smallest counts; an empty table gives no rows. The
verdict works on one text column, so clashing names cannot occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import give_back, schema, utf8

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MIN_SHARE = 0.5

#: Feature names and prior weights; positive speaks for content.
PRIOR = {
    "any line": 2.0,
    "one to three words": -0.5,
    "ten words or more": 0.5,
    "ends a sentence": 1.0,
    "capital letters only": -2.0,
    "many symbols": -2.0,
    "table bar": -1.0,
    "many exclamation marks": -2.0,
    "half of the words distinct or fewer": -2.0,
    "four fifths of the words distinct or fewer": -0.2,
    "a word fills two fifths": -1.0,
    "many digits": -1.0,
    "very short words": -0.5,
    "very long words": -1.0,
    "equal to an earlier line": -1.5,
    "link or notice": -1.0,
}
FEATURES = len(PRIOR)
#: Prior log potentials of (previous, next) with 0 boilerplate and 1 content.
STEPS = (0.5, -0.5, -0.5, 0.5)
NOTICES = (b"http", b"www.", b"cookie", b"copyright", b"\xc2\xa9")

RESULT = schema(
    n_words="long",
    word_chars="long",
    n_symbols="long",
    n_dup_lines="long",
    n_repeat_words="long",
    base_failed="boolean",
    kept="boolean",
)


def line_mask(line: bytes, words: list[bytes], repeated: bool) -> int:
    """The features of a line as bits, in the order of ``PRIOR``."""
    n, size, different = len(words), len(line), len(set(words))
    yes = (
        True,
        n <= 3,
        n >= 10,
        words[-1][-1:] in b".!?:;\"'" or words[-1][-3:] == b"\xe2\x80\xa6",
        line.isupper(),
        sum(line.count(c) for c in SYMBOLS.encode()) * 20 > size,
        b"|" in words,
        line.count(b"!") * 3 > n,
        n >= 4 and different * 2 <= n,
        n >= 4 and different * 5 <= n * 4,
        n >= 4 and different * 2 <= n and Counter(words).most_common(1)[0][1] * 5 >= n * 2,
        sum(line.count(c) for c in b"0123456789") * 5 > size,
        size < 3 * n,
        size > 14 * n,
        repeated,
        any(x in line.lower() for x in NOTICES),
    )
    return sum(bit << i for i, bit in enumerate(yes))


def lines_of(text: str | None) -> tuple[list[list[bytes]], list[int]]:
    """Words and feature bits of each line that has a word."""
    lines, masks, seen = [], [], set()
    for line in utf8(text).split(b"\n"):
        if words := line.split():
            lines.append(words)
            masks.append(line_mask(line, words, line in seen))
            seen.add(line)
    return lines, masks


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    return covered.count(1)


def decode(masks: list[int], scores: dict[int, float], steps, weights) -> list[int]:
    """Viterbi: the best sequence of states."""
    back, low, high = [], 0.0, 0.0
    for i, mask in enumerate(masks):
        e = scores.get(mask)
        if e is None:
            e = scores[mask] = float(sum(w for k, w in enumerate(weights) if mask >> k & 1))
        if i:
            a, b, c, d = low + steps[0], high + steps[2], low + steps[1], high + steps[3]
            back.append((a < b, c <= d))
            low, high = max(a, b), max(c, d) + e
        else:
            high = e
    state = int(high >= low)
    states = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        states.append(state)
    return states[::-1]


def judge(text: str | None, model, scores: dict[int, float]) -> tuple:
    weights, steps = model
    lines, masks = lines_of(text)
    words = [w for line in lines for w in line]
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    content = 0
    if masks and not failed:
        content = sum(len(line) for line, y in zip(lines, decode(masks, scores, steps, weights), strict=True) if y)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")) if text else 0,
        sum(map(text.count, SYMBOLS)) if text else 0,
        sum(mask >> 14 & 1 for mask in masks),
        repeated,
        failed,
        not failed and content >= MIN_SHARE * len(words),
    )


def verdict(text: Column, model) -> Column:
    """Struct of the base counts and the verdict for each text."""

    @F.pandas_udf(RESULT)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores: dict[int, float] = {}
        for texts in batches:
            yield pd.DataFrame([judge(t, model, scores) for t in texts], columns=RESULT.names)
        give_back()

    return rules(text)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_masks(texts: pd.Series) -> pd.Series:
    return pd.Series([lines_of(t)[1] for t in texts])


def sample(docs: DataFrame, labels: DataFrame, per_class: int, max_lines: int) -> list[tuple[list[int], int]]:
    """Feature bits by line and class of the labelled documents to train on."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").cast("int").alias("quality")).withColumn("at", F.xxhash64("doc_id"))
    chosen = [known.filter(F.col("quality") == q).orderBy("at", "doc_id").limit(per_class) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # per_class bounds it
    # the condition needs the sample's side, so lines of other documents are never looked at
    own = F.when(F.col("quality").isNotNull(), F.col("text"))
    masks = texts.select("at", "doc_id", line_masks(own).alias("masks"), "quality")
    masks = masks.filter((F.size("masks") > 0) & (F.size("masks") <= max_lines))
    return [(r.masks, r.quality) for r in masks.orderBy("at", "doc_id", "masks").limit(2 * per_class).collect()]


def train(rows: list[tuple[list[int], int]], rounds: int = 80, rate: float = 0.15, prior_weight: float = 2.0):
    """Weights and steps of the chain: maximum a posteriori by gradient ascent."""
    start = np.array([*PRIOR.values(), *STEPS])
    theta = start.copy()
    rows = sorted((r for r in rows if r[0]), key=lambda r: -len(r[0]))
    if len({q for _, q in rows}) < 2:
        return tuple(theta[:FEATURES]), tuple(theta[FEATURES:])
    lengths = np.array([len(m) for m, _ in rows])
    truth = np.array([q for _, q in rows])
    x = np.zeros((len(rows), lengths[0]), dtype=np.int64)
    for i, (masks, _) in enumerate(rows):
        x[i, : len(masks)] = masks
    bits = (x[:, :, None] >> np.arange(FEATURES) & 1).astype(float)  # padding has no bit at all
    share = 1 / (lengths * np.where(truth == 1, (truth == 1).sum(), (truth == 0).sum()))
    share *= len(rows) / 2  # both classes and all lengths weigh alike
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    target = np.einsum("dtf,d->f", bits, share * truth)
    moment, speed = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit, jump = bits @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        ahead = np.zeros((len(rows), lengths[0], 2))
        ahead[:, 0, 1] = emit[:, 0]
        for t in range(1, lengths[0]):
            n = active[t]
            ahead[:n, t] = np.logaddexp.reduce(ahead[:n, t - 1, :, None] + jump, axis=1)
            ahead[:n, t, 1] += emit[:n, t]
        behind = np.zeros_like(ahead)
        pairs = np.zeros((2, 2))
        total = np.logaddexp.reduce(ahead[np.arange(len(rows)), lengths - 1], axis=1)
        for t in range(lengths[0] - 1, 0, -1):
            n = active[t]
            after = behind[:n, t].copy()
            after[:, 1] += emit[:n, t]
            joint = ahead[:n, t - 1, :, None] + jump + after[:, None, :]
            pairs += np.einsum("dij,d->ij", np.exp(joint - total[:n, None, None]), share[:n])
            behind[:n, t - 1] = np.logaddexp.reduce(jump + after[:, None, :], axis=2)
        on = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        gradient = np.zeros_like(theta)
        gradient[:FEATURES] = target - np.einsum("dtf,dt,d->f", bits, on, share)
        moves = share * (lengths - 1)
        gradient[FEATURES:] = np.array([moves[truth == 0].sum(), 0, 0, moves[truth == 1].sum()]) - pairs.ravel()
        gradient -= prior_weight * (theta - start)
        moment = 0.9 * moment + 0.1 * gradient
        speed = 0.99 * speed + 0.01 * gradient**2
        theta += rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-9)
    return tuple(theta[:FEATURES].tolist()), tuple(theta[FEATURES:].tolist())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_lines: int = 400):
    return train(sample(docs, labels, per_class, max_lines))


def screen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and the fields of ``verdict``."""
    model = fit(docs, labels)
    return docs.select("doc_id", verdict(F.col("text"), model).alias("r")).select("doc_id", "r.*")
