"""Personal data: rules for four kinds, and boosted trees over freely proposed candidates.

Generators propose every span that could be personal data, overlapping ones
too. Spans that pass the rules of a base kind always count. Of the others,
loose forms of addresses and numbers are scored by gradient-boosted trees on
their format and context, and those above a calibrated threshold are added
where they overlap nothing stronger.

The trees are trained here, on candidates of a bounded sample: of the documents
that have any digit, at sign or spelt-out one, and apart from them of those
that have a form of an address or number that is personal data, each time
the ``MOST_DOCS`` with the smallest hash of id and text over the whole corpus;
of their candidates ``MOST_CANDIDATES`` of either label. A few fixed texts of
made-up data (``PRIOR``) always belong to the sample, so that there is
something to learn from in any corpus, however sparse. A candidate is labelled by the
rules of its kind, base or loose, numbers that no pattern covers are negatives,
and so is what fails its rules, unless it overlaps a positive. Half of
the sample calibrates each loose kind on its own candidates: its threshold is the
lowest score from which on at least ``PRECISION`` of them are personal data (and
half of the way down to the next), or, where no score reaches that, the score
that the trees give to that probability.

Scanning and scoring are column expressions in one pass without a shuffle;
the trees become nested conditions. Patterns that scan runs of characters
start at a run's first one, so a text without spaces costs no more than
another.

Defined results: null or empty texts have no spans; repeated rows are scanned
each on its own; texts are scanned whole; an empty table gives no rows; a null
``doc_id`` stays null. All works on one text column, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty

#: Kinds in the order that breaks ties; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_like", "phone_like", "ssn")
KINDS = BASE + ADDED

LOCAL, NAME = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+"
#: A match may start where a run starts or, inside a run, where the match before it ended.
RUN_OF = r"(?:(?<!{0})|\G){0}++"
PATTERNS = {
    "email": RUN_OF.format(LOCAL) + rf"@{NAME}(?:\.{NAME})+",
    "ip": RUN_OF.format("[0-9]") + r"(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else could be personal data.
LOOSE = {
    "email_like": RUN_OF.format(LOCAL) + rf"\x20?(?:\(at\)|\[at\]|@)\x20?{NAME}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{NAME})+",
    "phone_like": r"(?<![0-9A-Za-z.+-])\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: Every run of digits; those that no pattern above covers are not personal data.
NUMBERS = r"[0-9](?:[\x20-]?[0-9])++"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 24
HINTS = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|write|card|visa|account|ssn|social|address|\bip\b)"

MOST_DOCS, MOST_CANDIDATES = 2000, 3000
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
PRECISION, FLOOR = 0.99, 0.9

#: Texts with made-up candidates of each loose kind, as many personal as not.
PRIOR = [
    text.format(100 + i, 210 + 17 * i, 10 + i, 2000 + 37 * i, 101 + 14 * i)
    for i in range(40)
    for text in (
        "please write to person{0} [at] place{2} [dot] org about it",
        "mail first.last{2} (at) house{0}.example any day",
        "and ann_{2}@x{0}(dot)net is hers",
        "so b{0} [at] uni.edu it was",
        "sold {0}x @ 3.{2} and more",
        "won 2{2}@1.{2} there",
        "her ssn {4}-{2}-{3} was on the form",
        "then {4}-{2}-{3} it was",
        "part 9{2}-{2}-{3} of the series",
        "call ({1}) {1}-{3} tonight",
        "tel {1}.{1}.{3} or come by",
        "maybe {1}-{1}-{3} this time",
        "between {2}-{2}-{0} and {2}/{2}/{2}",
        "item {0}-{2}.{2} costs {2}.{2}",
    )
]
#: Documents that hold one of these may hold personal data.
LIKELY = r"[A-Za-z0-9]@[A-Za-z0-9]|[(\[]at[)\]]|\+[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{4}[\x20-][0-9]{4}"

#: Features of a candidate; ``t`` its text, ``before`` and ``after`` its context.
FEATURES = {
    "digits": lambda c: F.length(F.regexp_replace(c["t"], "[^0-9]", "")),
    "characters": lambda c: F.length(c["t"]),
    "letters": lambda c: F.length(F.regexp_replace(c["t"], "[^A-Za-z]", "")),
    "groups": lambda c: F.size(F.split(c["t"], r"[^0-9]+")),
    "dots": lambda c: F.length(F.regexp_replace(c["t"], r"[^.]", "")),
    "hyphens": lambda c: F.length(F.regexp_replace(c["t"], r"[^-]", "")),
    "brackets": lambda c: F.length(F.regexp_replace(c["t"], r"[^()]", "")),
    "spaces": lambda c: F.length(F.regexp_replace(c["t"], r"[^\x20]", "")),
    "first number": lambda c: F.coalesce(F.regexp_extract(c["t"], "[0-9]{1,4}", 0).try_cast("int"), F.lit(-1)),
    "joined before": lambda c: c["before"].rlike(r"[0-9A-Za-z_=\x22-]$").cast("int"),
    "joined after": lambda c: c["after"].rlike(r"^[0-9A-Za-z_\x22-]").cast("int"),
    "hint before": lambda c: c["before"].rlike(HINTS).cast("int"),
    "digits around": lambda c: F.length(F.regexp_replace(F.concat(c["before"], c["after"]), "[^0-9]", "")),
}

SPAN = "array<struct<start:int,end:int,t:string>>"
CHUNK = 500


def located(text: Column, pattern: str) -> Column:
    """Start, end and text of each match, in code points: the lengths of what lies between add up.

    Positions are carried along in chunks, so no long array is copied for each match.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["t"])
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["t"].alias("t")))).alias("out"),
        )

    def chunk(acc: Column, i: Column) -> Column:
        part = F.slice(acc["all"], i, F.lit(CHUNK))
        begun = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(
            F.array(F.aggregate(part, begun, step)),
            acc,
            lambda whole, new: F.struct(
                whole["all"].alias("all"), new["at"].alias("at"), F.concat(whole["out"], new["out"]).alias("out")
            ),
        )

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda t, gap: F.struct(t.alias("t"), gap.alias("gap")))
    begin = F.struct(pairs.alias("all"), F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(starts, begin, chunk, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, t: Column) -> Column:
    """Whether a match of a base pattern meets the rules of its kind."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": t.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": (n >= 14) & (n <= 19) & luhn(digits),
        "phone": (n >= 10) & (n <= 15),
    }[kind]


def plausible(kind: str, t: Column) -> Column:
    """Label of a loose candidate by the rules of its kind; null where they cannot tell."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    return {
        "email_like": t.rlike(r"[A-Za-z]{2}$"),
        "ssn": t.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
        "phone_like": F.when(digits.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), True).when(
            ~F.length(digits).between(10, 15), False
        ),
    }[kind]


def guarded(text: Column, kind: str, spans: Column) -> Column:
    """Spans only where the text has the characters they need: most texts have none."""
    needs = text.rlike(r"@|[(\[]at[)\]]") if "email" in kind else text.rlike("[0-9]")
    return F.when(needs, spans).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["t"].alias("t")
        ),
    )


def base_spans(text: Column, kind: str) -> Column:
    return guarded(text, kind, F.filter(located(text, PATTERNS[kind]), lambda s: passes(kind, s["t"])))


def with_context(text: Column, spans: Column) -> Column:
    def context(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substr(text, low + 1, s["start"] - low)
        after = F.substr(text, s["end"] + 1, F.lit(CONTEXT))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["t"].alias("t"), before.alias("before"), after.alias("after"))

    return F.transform(spans, context)


def features_of(c: Column) -> list[Column]:
    return [make(c).cast("double") for make in FEATURES.values()]


# --- training, on a bounded sample ---


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds (by place in ``KINDS``, or its length) of candidates in the sample."""
    text = F.col("text")
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("at"))

    def smallest(pattern: str) -> DataFrame:
        return hashed.filter(text.rlike(pattern)).select("at").distinct().orderBy("at").limit(MOST_DOCS)

    # 2 * MOST_DOCS hashes at most; texts do not move
    chosen = smallest(r"[0-9@]|[(\[]at[)\]]").union(smallest(LIKELY)).distinct()
    some = hashed.join(F.broadcast(chosen), "at").dropDuplicates(["at"])
    prior = docs.sparkSession.createDataFrame([(t,) for t in PRIOR], "text string")
    some = some.select("text", "at").unionByName(prior.withColumn("at", F.xxhash64("text")))

    def labelled(kind: str, pattern: str) -> Column:
        def row(c: Column) -> Column:
            label = passes(kind, c["t"]) if kind in BASE else plausible(kind, c["t"]) if kind in LOOSE else F.lit(False)
            place = F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS))
            at = (place.alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
            return F.struct(F.array(*features_of(c)).alias("x"), label.alias("y"), *at)

        return F.transform(with_context(text, guarded(text, kind, located(text, pattern))), row)

    def groups(patterns: dict[str, str]) -> Column:
        return F.concat(*[labelled(kind, pattern) for kind, pattern in patterns.items()])

    some = some.withColumn("base", groups(PATTERNS)).withColumn("loose", groups(LOOSE))
    some = some.withColumn("number", apart(labelled("number", NUMBERS), F.concat("base", "loose")))  # what no generator proposes
    some = some.withColumn("loose", apart(F.col("loose"), F.filter("base", lambda c: c["y"])))
    known = F.filter(F.concat("base", "loose", "number"), lambda c: c["y"].isNotNull())
    some = some.withColumn("known", known).withColumn("true", F.filter("known", lambda c: c["y"]))
    false = apart(F.filter("known", lambda c: ~c["y"]), F.col("true"))  # a part of personal data, or more, is no example
    some = some.select("at", F.explode(F.concat("true", false)).alias("c"))
    rows = some.select("c.x", "c.y", "c.kind", F.xxhash64("at", "c.start", "c.x").alias("at"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("at"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= MOST_CANDIDATES).orderBy("at").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return x, np.array([r.y for r in rows], dtype=float), np.array([r.kind for r in rows])


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]):
    """Feature and cut that gain most for gradients ``g`` and curvatures ``h``."""

    def worth(a, b):
        return a * a / (b + 1.0)

    total, best = worth(g.sum(), h.sum()), (1e-9, None, None)
    for f, values in enumerate(cuts):
        for cut in values:
            low = x[:, f] <= cut
            gain = worth(g[low].sum(), h[low].sum()) + worth(g[~low].sum(), h[~low].sum()) - total
            if gain > best[0]:
                best = (gain, f, float(cut))
    return best[1], best[2]


def grow(x, g, h, cuts, depth: int):
    """A tree as (feature, cut, low branch, high branch) or a leaf's value."""
    f, cut = best_split(x, g, h, cuts) if depth else (None, None)
    if f is None:
        return float(RATE * g.sum() / (h.sum() + 1.0))
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], g[low], h[low], cuts, depth - 1), grow(x[~low], g[~low], h[~low], cuts, depth - 1))


def value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, value(low, x), value(high, x))


def train(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> tuple[list, dict[str, float]]:
    """Trees, and for each loose kind the threshold of their summed score."""
    fit = np.arange(len(y)) % 2 == 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1])) for f in range(x.shape[1])]
    trees, score = [], np.zeros(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x[fit], (y - p)[fit], (p * (1 - p))[fit], cuts, DEPTH)
        trees.append(tree)
        score += value(tree, x)
    return trees, {k: threshold(score[~fit & (kind == KINDS.index(k))], y[~fit & (kind == KINDS.index(k))]) for k in ADDED}


def threshold(held: np.ndarray, truth: np.ndarray) -> float:
    """The lowest score from which on ``PRECISION`` of the held-out candidates of a kind are true."""
    order = np.argsort(-held, kind="stable")
    precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
    last = np.r_[np.diff(held[order]) != 0, True][: len(order)]  # equal scores stay together
    good = np.flatnonzero(precise & last)
    if not len(good):
        return float(np.log(PRECISION / (1 - PRECISION)))
    lowest = float(held[order][good[-1]])
    below = float(held[order][good[-1] + 1]) if good[-1] + 1 < len(order) else -np.inf
    return max((lowest + below) / 2, float(np.log(FLOOR / (1 - FLOOR))))


# --- scoring ---


def condition(tree, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(x[f] <= cut, condition(low, x)).otherwise(condition(high, x))


def scored(text: Column, kind: str, model) -> Column:
    """Loose candidates of a kind that score above its threshold; none of a kind without one."""
    trees, thresholds = model
    if kind not in thresholds:
        return F.array().cast(SPAN)

    def kept(c: Column) -> Column:
        x = [c["x"][i] for i in range(len(FEATURES))]
        return sum((condition(t, x) for t in trees), F.lit(0.0)) >= thresholds[kind]

    found = F.transform(
        with_context(text, located(text, LOOSE[kind])),
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["t"].alias("t"), F.array(*features_of(c)).alias("x")
        ),
    )
    plain = F.transform(
        F.filter(found, kept), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["t"].alias("t"))
    )
    return guarded(text, kind, plain)


def apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def joined(spans: Column) -> Column:
    lines = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(lines, ",")


def fit(docs: DataFrame):
    return train(*sample(docs))


def scan(docs: DataFrame, model=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts and digest of the base spans, all spans."""
    model = fit(docs) if model is None else model
    out = docs.select("doc_id", text_or_empty().alias("text"))
    text = F.col("text")
    for order, kind in enumerate(BASE):
        out = out.withColumn(f"s_{kind}", tagged(base_spans(text, kind), kind, order))
    out = out.withColumn("base", F.concat(*[F.col(f"s_{k}") for k in BASE])).withColumn("found", F.col("base"))
    # an address, then an identity number, then any phone: the stricter form goes first
    for kind in ("email_like", "ssn", "phone_like"):
        spans = tagged(apart(scored(text, kind, model), F.col("found")), kind, KINDS.index(kind))
        out = out.withColumn("found", F.concat("found", spans))
    return out.select(
        "doc_id",
        *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
