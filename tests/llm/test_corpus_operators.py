"""Operators over the whole corpus, against brute force, round trips and planted cases."""

import collections
import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import components, minhash, mixing, packing, suffix_dedup, token_files, topk, warc
from concord.llm.common import shared_folder, tokenizer_path, words, written
from concord.llm.tokens import Encoder
from llm_cases import SMALL, make_docs, odd, small_docs  # noqa: F401

# --- mixing ---


def plain_targets(sizes):
    """Targets by source: share by weight, cut at three times the size, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


def mix_rows(rng, sources, n):
    return [(i, "w " * rng.randrange(0, 400), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(make_docs, seed):
    rng = random.Random(seed)
    rows = mix_rows(rng, ["a", "a", "a", "a", "b", "é", "Z", None], 400) + [(900 + i, "x y z", "tiny") for i in range(3)]
    rows += [(7, None, "a"), (None, "one two", "b"), (8, "w " * 50, "b"), (8, "w " * 50, "b")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_schedule_spreads_each_source(spark, make_docs):
    """Each slot is used once, ranks are dense, and every stretch of the schedule holds a source's share."""
    docs = make_docs(mix_rows(random.Random(3), ["a", "b", "c"], 300))
    rows = mixing.sized(docs)
    slices = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sources = written(mixing.targets(slices))
    slots = sorted((r.slot, r.sid, r["rank"]) for r in mixing.schedule(sources).collect())
    quota = {r.sid: r.quota for r in sources.collect()}
    assert len({s for s, _, _ in slots}) == len(slots) == sum(quota.values())
    for sid, n in quota.items():
        assert [k for _, s, k in slots if s == sid] == list(range(n))
    half = slots[: len(slots) // 2]
    for sid, n in quota.items():
        assert abs(sum(s == sid for _, s, _ in half) - n / 2) <= 2 + np.log2(len(slots))


def test_reversed_bits(spark):
    rows = spark.range(64).select("id", mixing.reversed_bits(F.col("id"), F.lit(6)).alias("r")).collect()
    assert all(r.r == int(f"{r.id:06b}"[::-1], 2) for r in rows)


def test_mix_without_words(make_docs):
    rows = mixing.mix(make_docs([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixing.mix(make_docs([(1, "x")]).limit(0)).count() == 0


# --- repeats ---


def plain_repeats(rows):
    seen, out = set(), []
    for i, (doc_id, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            part = data[p : p + 100]
            if part in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeats(docs):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=repr)


def awkward_texts(seed, n):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield i, rng.choice(["ab", "a", "abc", "xyz xyz "]) * rng.randrange(1, 120)
        elif kind < 0.7:
            a, noise = rng.randrange(400), lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
            yield i, noise() + base[a : a + rng.randrange(300)] + noise()
        else:
            yield i, "é" * rng.randrange(80) + base[: rng.randrange(500)] + rng.choice(["", "ab"]) * 60


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_brute_force(make_docs, seed):
    rows = list(awkward_texts(seed, 200))
    assert repeats(make_docs(rows)) == plain_repeats(rows)


def test_repeats_on_documents(make_docs, small_docs, odd):
    rows = small_docs + [(1000 + i, t) for i, t in enumerate(odd)] + [(2000 + i, t) for i, t in enumerate(odd)]
    rows += [(None, small_docs[5][1])]
    assert repeats(make_docs(rows)) == plain_repeats(rows)


def test_repeats_in_segments(make_docs, monkeypatch):
    """Long documents are cut into segments; the result is the same."""
    rows = list(awkward_texts(4, 60))
    rows.append((70, "".join(t for _, t in rows)))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    assert repeats(make_docs(rows)) == plain_repeats(rows)


def test_repeated_ids_and_empty_table(spark):
    text = "0123456789" * 3 + "abcdefghij" * 9
    docs = spark.createDataFrame([(5, text), (5, text), (4, text[:100])], "doc_id long, text string").coalesce(1)
    got = repeats(docs)
    assert [(r[0], r[2]) for r in got] == [(4, 0), (5, 100), (5, 120)]
    assert repeats(docs.limit(0)) == []


# --- archives ---


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long").repartition(3)


def test_archives_round_trip(spark):
    long = "<p>é😀" * 200_000
    rows = [(i, f"http://x/{i}\r\nevil: 1", h) for i, h in enumerate(["a" * 100, "a" * 100, "b" * 99, "b" * 99, None, "", long])]
    rows += [(None, None, "a" * 100), (9, "u", "c" * 200), (9, "u", "c" * 200), (10, "u", "c" * 200), (None, "u", "d" * 300), (None, "u", "d" * 300)]
    got = warc.round_trip(pages_of(spark, [(*r, "x", 1) for r in rows])).collect()
    plain = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows]
    assert sorted(tuple(r)[:3] for r in got if r.page_id is not None) == sorted(p for p in plain if p[0] is not None)
    kinds = collections.defaultdict(set)
    for r in got:
        kinds[r.page_id, r.payload_bytes].add((r.record_type, r.refers_to))
    assert kinds[0, 100] == {("response", None)} and kinds[1, 100] == {("revisit", 0)} == kinds[None, 100]
    assert kinds[2, 99] == kinds[3, 99] == kinds[9, 200] == kinds[None, 300] == {("response", None)}
    assert kinds[10, 200] == {("revisit", 9)}
    assert warc.round_trip(pages_of(spark, []).limit(0)).count() == 0


def test_archive_members_stand_alone(spark):
    """One gzip member per record; a damaged byte is found."""
    from pyarrow import BufferReader

    parts = [warc.record(i, "u", "x" * 500 * i, hashlib.sha256(b"x" * 500 * i).hexdigest(), None) for i in range(4)]
    assert all(zlib.decompress(p, 31).startswith(b"WARC/1.1\r\n") for p in parts)
    read = lambda data: [warc.parse(m) for m in warc.members(BufferReader(data))]
    assert [r[0] for r in read(b"".join(parts))] == [0, 1, 2, 3]
    with pytest.raises(warc.DamagedRecord):
        read(b"".join(parts)[:-20])
    raw = zlib.decompress(parts[2], 31).replace(b"xxxx", b"xxyx", 1)
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.DamagedRecord):
        read(gzip.compress(raw) + gzip.flush())


# --- tokens ---


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    def encode(name, texts):
        library = Tokenizer.from_file(tokenizer_path(name))
        return [np.array([*e.ids, 1], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    return encode


NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(encoded, small_docs, odd, name):
    rng = random.Random(6)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "'ll", "!", "1", "23", "日本", "\xa0", "\x1c", "\x85", "é"]
    parts += ["́", "<|endoftext|>", "İ", "Σ", "ς", " \n", "　", "😀", "\r\n", "\x00", "K", "word", "Été.", ",", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += odd + [t for _, t in small_docs]
    own = Encoder(name)
    for text, ids in zip(texts, encoded(name, texts), strict=True):
        assert own(text).tolist() == ids.tolist(), repr(text)


def test_cache_stays_bounded():
    from concord.llm import tokens

    own = Encoder(NAMES[0])
    own.known = tokens.Cache(50)
    first = [own(f"w{i} x{i}").tolist() for i in range(200)]
    assert len(own.known.young) + len(own.known.old) <= 50
    assert first == [own(f"w{i} x{i}").tolist() for i in range(200)]


@pytest.mark.parametrize("name", NAMES)
def test_groups_of_texts_give_the_ids_of_each(encoded, small_docs, odd, name, monkeypatch):
    from concord.llm import tokens

    texts = odd + [t for _, t in small_docs] + ["word. word, (x). !, end.", "a\x01b", "\x02", "x \x01. y"]
    for size in (1, 50, 10**9):
        monkeypatch.setattr(tokens, "GROUP_PIECES", size)
        got = list(Encoder(name).many(texts))
        assert [g.tolist() for g in got] == [ids.tolist() for ids in encoded(name, texts)]


@pytest.mark.parametrize("name", NAMES)
def test_white_space_and_marks_in_any_order(encoded, name):
    rng = random.Random(3)
    parts = ["a", "Bc", "é", "7", ".", ",", "!", "\n", "\n", " ", "\r", "\t", "\u2028", "-", "&&&", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(6000)]
    assert [g.tolist() for g in Encoder(name).many(texts)] == [ids.tolist() for ids in encoded(name, texts)]


@pytest.mark.parametrize("name", NAMES)
def test_a_new_word_costs_no_call_of_its_own(name):
    """What Python does for a word is in loops over many: in op6 and op9 most of the time goes to new words."""
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(100_000 + 7 * i)) for i in range(5000)]
    calls, own = collections.Counter(), Encoder(name)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        list(own.many([" ".join(words[:2500]) + ".\n" + " ".join(words[2500:])]))
    finally:
        sys.setprofile(None)
    assert calls["call"] < 1000


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, 1001, bits) == ids).all()


def test_token_files_hold_every_document(make_docs, encoded, small_docs, odd):
    rows = small_docs + [(5000 + i, t) for i, t in enumerate(odd)] + [(3, "again"), (None, "no id")]
    got = token_files.round_trip(make_docs(rows)).collect()
    ids = encoded(NAMES[0], [t for _, t in rows])
    plain = sorted(((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == plain
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.round_trip(make_docs([(1, "x")]).limit(0)).count() == 0


def test_random_access(spark, make_docs, encoded, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 7)
    texts = ["alpha beta gamma delta " * 3, "", "epsilon"]
    manifest = token_files.write(make_docs(list(enumerate(texts))).coalesce(1), shared_folder(spark)).collect()
    ids = encoded(NAMES[0], texts)
    for row in manifest:
        file = token_files.Reader(row.path)
        assert file.bits == 16
        for doc_id, start, n in zip(file.doc_ids, file.starts, file.lengths, strict=True):
            assert np.concatenate(list(file.ids(int(start), int(n)))).tolist() == ids[doc_id].tolist()


# --- packing ---


def check_packing(rows, got, ids):
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for (doc_id, _), own in zip(rows, ids, strict=True):
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own))
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes()) and r.length > 0
            at += r.length
        assert at == len(own)
    padding = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at if at & (at - 1) else 0
    return padding


#: A packing task over a few MB of words, one in eight of them new, in a process that has packed a little before.
PACKED = """
import random, re
import pandas as pd
from concord.llm import packing

def held():
    found = re.findall(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())
    return sum(map(int, found)) / 1024

class Docs:
    select = lambda self, *columns: self
    mapInPandas = lambda self, work, schema: work

class Task:
    partitionId = staticmethod(lambda: 0)

class Context:
    get = staticmethod(lambda: Task)

packing.keyed, packing.TaskContext = (lambda *others: others), Context
rng = random.Random(3)
word = lambda: "".join(rng.choices("abcdefghij", k=9)) if rng.random() < 0.125 else "word" + "abcdef"[rng.randrange(6)]

def batches(n):
    for i in range(n):
        texts = [" ".join(word() for _ in range(250)) for _ in range(400)]
        yield pd.DataFrame({"doc_id": range(len(texts)), "no_id": False, "text": texts})

for _ in packing.pack(Docs())(batches(1)):
    pass
before = held()
for _ in packing.pack(Docs())(batches(10)):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_packing_task_gives_its_memory_back():
    """Python workers live on after a task: what they kept from it added up over the stages of the pipeline."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", PACKED], cwd=top, capture_output=True, text=True, timeout=300)
    assert float(done.stdout) < 40, (done.stdout, done.stderr)


def test_packing_places_each_id_once(make_docs, encoded, small_docs, odd):
    rows = small_docs + [(5000 + i, t) for i, t in enumerate(odd)] + [(None, "no id here")]
    got = packing.pack(make_docs(rows)).collect()
    assert check_packing(rows, got, encoded(NAMES[1], [t for _, t in rows])) == 0
    whole = packing.pack(make_docs(rows[:5]), with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in whole)
    assert packing.pack(make_docs([(1, "x")]).limit(0)).count() == 0
    assert sum(r.length for r in packing.pack(make_docs([(1, "x y"), (1, "x y")])).collect()) == 6


def test_sum_of_squares_choice():
    """Each placement is the one with the smallest sum of squared counts."""
    rng = random.Random(1)
    packer = packing.Packer(window=20, max_open=10**9)
    for i in range(500):
        size = rng.randint(1, 19)
        before = packer.counts.copy()
        options = {}
        for level in range(0, 21 - size):
            if level and not before[level]:
                continue
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 20:
                after[level + size] += 1
            options[level] = int((after[:20] ** 2).sum())
        packer.place((i, 0, np.zeros(size, "<u4"), size))
        assert int((packer.counts[:20] ** 2).sum()) == min(options.values())
        assert packer.counts[20] == 0 and [len(w) for w in packer.levels[:20]] == packer.counts[:20].tolist()


@pytest.mark.parametrize("most", [3, 10**9])
def test_merging_open_windows(most):
    rng = random.Random(2)
    packer = packing.Packer(window=32, max_open=most)
    docs = {i: np.arange(rng.randint(1, 90), dtype="<u4") + 1000 * i for i in range(300)}
    for i, ids in docs.items():
        packer.add(i, ids)
        assert packer.n_open <= most
    packer.finish()
    for i, ids in docs.items():
        pieces = sorted((start, own) for d, start, _, _, _, _, _, own in packer.done if d == i)
        assert np.concatenate([own for _, own in pieces]).tolist() == ids.tolist()
    fills = collections.Counter()
    for _, _, n, _, _, window, _, _ in packer.done:
        fills[window] += n
    assert all(f == 32 or f & (f - 1) == 0 for f in fills.values())


# --- search ---


def plain_search(rows, k=5):
    ready = [
        (i, v, [int(np.floor(256 * float(x))) for x in e])
        for i, (v, e) in enumerate(rows)
        if e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = []
    for i, v, q in ready:
        if v is None or v % 50:
            continue
        found = [(-sum(a * b for a, b in zip(q, x, strict=False)), w is None, w or 0, j) for j, w, x in ready if j != i]
        out += [(v, n + 1, None if none else w, -s) for n, (s, none, w, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((tuple(r) for r in topk.search(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=24).astype("f4").tolist()) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(9)] + [(100, rows[50][1]), (None, rows[50][1])]
    rows += [(400, None), (450, [None] * 24), (500, [float("nan")] * 24), (550, [float("inf")] * 24), (600, []), (650, [0.5])]
    assert searched(spark, rows) == plain_search(rows)


def test_search_multiplies_blocks_where_bounds_rule_out_little(monkeypatch):
    """Without structure nearly all pairs are left: they are scored by the block, in exact doubles, not pair by pair."""
    rng = np.random.default_rng(3)
    q, x = rng.integers(-256, 256, (40, 64)), rng.integers(-256, 256, (600, 64))
    x[100:120] = x[7]  # ties

    def block(data, first):
        rows = np.arange(first, first + len(data), dtype="<i8")
        return topk.Block(len(data), 64, rows.tobytes(), rows.tobytes(), bytes(len(data)), data.astype("<i8").tobytes())

    pairs, plainly = [], topk.exact
    monkeypatch.setattr(topk, "exact", lambda a, b, small: pairs.append(len(a)) or plainly(a, b, small))
    best = topk.Best(block(q, 10_000), 5)
    for first in (0, 300):
        best.search(block(x[first : first + 300], first))
    scores = q @ x.T
    want = [sorted((-int(s), 0, j, j) for j, s in enumerate(row))[:5] for row in scores]
    assert best.found == want
    assert sum(pairs) <= 2 * 5 * len(q), pairs


def test_search_few_large_and_none(spark):
    assert searched(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])]) == [(0, 1, 1, 256 * 768 + 512 * 1024)]
    assert searched(spark, [(50, [1.0])]) == []
    assert searched(spark, [(1, [1.0])]) == []
    huge = searched(spark, [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])])
    assert [(r[2], r[3]) for r in huge] == [(1, 2**63 - 1), (2, -(2**63))]


# --- near-duplicates ---


def plain_near(rows):
    sets = []
    for _, text in rows:
        w = words(text.translate({c: c + 32 for c in range(65, 91)}) if text else text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, doc_id == least if least is not None else True))
    return sorted(out, key=repr)


def near(docs):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr)


def variants(seed, n, length=60):
    """Copies of a text with ever more words changed: links, chains of links and texts just beyond."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(length)] = f"x{rng.randrange(50)}"
        yield " ".join(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(make_docs, seed):
    rows = list(enumerate([*variants(seed, 150), *variants(seed + 10, 60, 25)]))
    assert near(make_docs(rows)) == plain_near(rows)


def test_large_group_in_cells(make_docs, monkeypatch):
    """Groups over many blocks: every cell of what the stars leave is compared."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SIGNED", 16)
    rows = list(enumerate(variants(5, 160)))
    assert near(make_docs(rows)) == plain_near(rows)


def test_pair_under_a_representative_alike_to_neither(spark):
    """Two near-duplicates that meet only under a third text, as in a large family from one template."""
    sketcher, pair = minhash.Sketcher(), [f"w{i}" for i in range(60)]
    texts = [" ".join(pair[:25] + [f"x{i}" for i in range(40)]), " ".join(pair), " ".join([*pair[:58], "changed", "end"])]
    rows = [sketcher.row(i, t) for i, t in enumerate(texts)]
    signatures = [np.frombuffer(r[3], np.uint8) for r in rows]
    assert minhash.alike(signatures[1][None], signatures[2])[0]
    assert not any(minhash.alike(signatures[0][None], s)[0] for s in signatures[1:])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], minhash.LINKS)
    heads = spark.createDataFrame([(i, bytes(r[3])) for i, r in enumerate(rows)], "node long, signature binary")
    data = [(i, sketcher.shingles(t).tobytes()) for i, t in enumerate(texts)]
    sets = spark.createDataFrame(data, "node long, data binary")
    labels = components.components(spark.createDataFrame([], minhash.LINKS))
    links = minhash.rest_links(pairs, heads, sets, labels).collect()
    assert {frozenset(r) for r in links} == {frozenset((1, 2))}


def family(seed, n, shared=60, own=30):
    """Texts with a common passage and words of their own, alike but no duplicates; each tenth has a near copy."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    for i in range(n):
        text = [*passage, *(f"o{rng.randrange(10**6)}" for _ in range(own))]
        yield " ".join(text)
        if i % 10 == 0:
            text[rng.randrange(shared + own)] = "changed"
            yield " ".join(text)


@pytest.mark.parametrize("shared", [40, 60, 70])
def test_family_that_shares_a_passage(make_docs, shared):
    rows = list(enumerate(family(3, 120, shared)))
    assert near(make_docs(rows)) == plain_near(rows)


def test_family_from_one_template(make_docs):
    """Texts put together from a pool of sentences, every one of which many of them hold, with planted near copies."""
    rng = random.Random(9)
    pool = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(30)]
    texts = [" ".join(rng.sample(pool, 12)) for _ in range(250)]
    texts += [t.replace("w3 ", "w3x ", 1) for t in texts[::25]]
    rows = list(enumerate(texts))
    assert near(make_docs(rows)) == plain_near(rows)


def test_rows_compared_grow_like_the_family(spark, monkeypatch):
    """Members of a family meet by shingles of their own: twice the family gives no more than twice the rows."""
    sketcher, entries = minhash.Sketcher(), []
    for n in (100, 200):
        texts = list(family(4, n))
        sets = spark.createDataFrame([(i, sketcher.shingles(t).tobytes()) for i, t in enumerate(texts)], "node long, data binary")
        nodes = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, label long")
        found = minhash.prefixes(nodes, sets).groupBy("shingle").count().collect()
        assert max(r["count"] for r in found) < 8  # no bucket holds the family
        entries.append(sum(r["count"] for r in found))
    assert 0 < entries[1] <= 2.2 * entries[0]


def test_near_duplicates_on_documents(make_docs, small_docs, odd):
    rows = small_docs + [(1000 + i, t) for i, t in enumerate(odd)] + [(2000 + i, t) for i, t in enumerate(odd)]
    rows += [(None, small_docs[3][1]), (None, "all alone here"), (7, "other text"), (7, "A b C d e F"), (9000, "a B c d E f")]
    assert near(make_docs(rows)) == plain_near(rows)
    assert near(make_docs([(1, "x")]).limit(0)) == []


def test_one_row_of_each_group_stays(make_docs):
    docs = make_docs([(1, "same text"), (1, "same text"), (2, "same text"), (3, None), (3, None)])
    rows = minhash.link_documents(docs).collect()
    assert sorted((r.doc_id, r.stays) for r in rows) == [(1, False), (1, True), (2, False), (3, True), (3, True)]


def test_signature_estimates_similarity():
    sketcher = minhash.Sketcher()
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        both = int(1000 * 2 * share / (1 + share))
        a, b = pool[:1000], pool[1000 - both : 2000 - both]
        equal = (sketcher.signature(a) == sketcher.signature(b)).mean()
        assert abs(equal - share) < 4 * (share * (1 - share) / 160) ** 0.5


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    links += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: m for x, m in least.items() if any(x in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op6_token_files", "op8_minmax", "op2_mixing"])
def test_registered_over_all_rows(spark, name):
    from concord.llm.queries import QUERIES

    assert QUERIES[name](spark, SMALL).count() == 200
