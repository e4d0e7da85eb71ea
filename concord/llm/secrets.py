"""Secret scan: keyword automaton, anchored patterns at its hits, checksums inside the tokens.

One pass over each text, no shuffle. An Aho-Corasick automaton finds the
keywords that can open a secret; only there an anchored pattern is tried, and
token kinds that carry a checksum must satisfy it. Runs of hex digits have no
keyword: every sixth character is probed instead, as a run of 24 covers four
probes in a row.

Defined results: a null or empty text has no spans; repeated rows are scanned
each on its own; texts of any length are scanned whole; an empty table gives
no rows. The functions work on one text column and leave all others alone, so
clashing names cannot occur. A null ``doc_id`` stays null.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import schema

#: Kinds in the order that breaks ties; the first three are the base kinds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
PATTERNS = {
    "assign": re.compile(
        r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
KEYWORDS = (
    {w: "assign" for w in ASSIGN_WORDS}
    | {"akia": "access", "npm_": "npm", "xprv": "xprv"}
    | {f"gh{c}_": "github" for c in "pousr"}
)
HEX = re.compile(r"[0-9a-f]{24,}")
PROBES = re.compile(r"[0-9a-f]{4,}")
STRIDE = 6

RESULT = schema(n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")


def crc_token(token: str) -> bool:
    """The last 6 of 36 characters are the CRC-32 of the first 30, in base 62."""
    body, check = token[-36:-6], token[-6:]
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_key(token: str) -> bool:
    """Base58Check: the last four bytes are the head of a double SHA-256 of the rest."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return match.end() - match.start() >= 20
    return base58_key(match[0]) if kind == "xprv" else crc_token(match[0])


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """Lower case with every character in its old place; a superset of hits is fine, patterns decide."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    for m in PROBES.finditer(text[STRIDE - 1 :: STRIDE]):
        low, high = m.start() * STRIDE, m.end() * STRIDE + STRIDE - 1
        for run in HEX.finditer(text, low, high):
            yield run.span()


def find_secrets(text: str | None, hits) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span in code points, in order."""
    if not text:
        return []
    near: dict[str, list[int]] = {}
    for last, (size, kind) in hits.iter(ascii_lower(text)):
        near.setdefault(kind, []).append(last - size + 1)
    spans = [(a, KINDS.index("hex"), b) for a, b in hex_runs(text)]
    for kind, starts in near.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (m := PATTERNS[kind].match(text, start)):
                free = m.end()  # a match that fails its check is used up all the same
                if valid(kind, m):
                    spans.append((start, KINDS.index(kind), free))
    return sorted(spans)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@F.pandas_udf(RESULT)
def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of counts, digest of the base spans and all spans of a text column."""
    hits = automaton()
    for texts in batches:
        rows = []
        for text in texts:
            spans = find_secrets(text, hits)
            base = [s for s in spans if s[1] < len(BASE)]
            counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text with each found span replaced by ``[SECRET]``, overlapping spans by one; null stays null."""
    hits = automaton()
    for texts in batches:
        yield pd.Series([redacted(text, find_secrets(text, hits)) for text in texts], dtype=object)


def redacted(text: str | None, spans) -> str | None:
    if not spans:
        return text
    out, at, upto = [], 0, 0
    for start, _, end in spans:
        if start >= upto:
            out += [text[at:start], "[SECRET]"]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per row of ``docs``: its key and the fields of ``report``."""
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col(key), report(text).alias("r")).select(key, "r.*")
