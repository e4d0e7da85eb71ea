"""Vote operators on hand-made edge cases."""

import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from concord.functions import cleaning
from concord.operators import bits, consensus, joins, pairs, votes
from concord.plans import views
from conftest import as_dict, as_set, records_of, votes_of, wide_of

VOTERS = ["p", "q", "r", "s"]
TABLE = {
    1: {"p": "b", "q": "b", "r": "a", "s": "a"},  # tie: smallest label, or the first voter's
    2: {"q": "c"},  # a single vote
    3: {"p": None, "q": None, "r": None, "s": None},  # every voter failed
    4: {"p": "a", "q": "a", "r": "a", "s": "a"},  # unanimous
    5: {"p": "a", "q": "a", "r": "b"},
    6: {"p": "a", "q": "b", "r": "c"},  # no two agree
}
RECORDS = [1, 2, 3, 4, 5, 6, 7, 8]  # 7 and 8 have no vote at all


@pytest.fixture(scope="module")
def long(spark):
    return votes_of(spark, TABLE).cache()


@pytest.fixture(scope="module")
def wide(spark):
    return wide_of(spark, TABLE, VOTERS).cache()


@pytest.fixture(scope="module")
def listing(spark):
    return records_of(spark, RECORDS)


CONSENSUS = {
    (1, "a", 2, 4, 2),
    (2, "c", 1, 1, 1),
    (3, None, 0, 0, 0),
    (4, "a", 4, 4, 1),
    (5, "a", 2, 3, 2),
    (6, "a", 1, 3, 3),
}
COLUMNS = ["item_id", "majority", "top_votes", "n_votes", "n_labels"]


def test_consensus_long_and_wide(long, wide):
    assert as_set(consensus.consensus(long).select(COLUMNS)) == CONSENSUS
    assert as_set(consensus.with_consensus(wide, VOTERS).select(COLUMNS)) == CONSENSUS


def test_tie_by_first_model(long, wide):
    assert as_dict(consensus.consensus(long, tie="first_model"), "item_id", "majority")[1] == "b"
    assert as_dict(consensus.with_consensus(wide, VOTERS, tie="first_model"), "item_id", "majority")[1] == "b"


@pytest.mark.parametrize("tie", ["label", "first_model"])
def test_judged_long_equals_wide(long, wide, tie):
    columns = ["item_id", "model", "prediction", "n_label", "majority", "top_votes", "n_votes"]
    a = consensus.judge(long, tie).filter("prediction is not null").select(columns)
    b = consensus.judge_wide(wide, VOTERS, tie).filter("prediction is not null").select(columns)
    assert as_set(a) == as_set(b)
    assert a.count() == 15


def test_agreement_rates(long, listing):
    row = consensus.agreement_rates(consensus.consensus(long), listing, strong=4, majority=2).first()
    assert row.asDict() == {"full_pct": 25.0, "strong_pct": 12.5, "majority_pct": 37.5, "mean_votes": 10 / 8}
    strict = consensus.agreement_rates(consensus.consensus(long), listing, full_min_votes=2).first()
    assert strict["full_pct"] == 12.5


def test_histogram_counts_records_without_votes(long, listing):
    assert as_set(consensus.consensus_histogram(consensus.consensus(long), listing)) == {(0, 3), (1, 2), (2, 2), (4, 1)}


def test_bins_at_their_edges(spark, listing):
    columns = "item_id bigint, top_votes bigint, n_votes bigint"
    cons = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 4, 5), (4, 5, 5)], columns)
    bins = as_dict(consensus.consensus_bins(cons, listing.filter("item_id <= 4")), "bin", "n")
    # 0.2 opens the second bin, 0.4 the third, 0.8 the last one, which holds 1.0 too
    assert bins == {"0–20%": 0, "20–40%": 1, "40–60%": 1, "60–80%": 0, "80–100%": 2}
    thousand = spark.createDataFrame([(1, 500, 1), (2, 501, 1), (3, 999, 1), (4, 1000, 1)], columns)
    bins = as_dict(consensus.agreement_bins(thousand, listing.filter("item_id <= 5"), 1000), "bin", "n")
    # 50 is still low, 99.9 still majority; the fifth record has no vote
    assert bins == {"Low (<50%)": 2, "Majority (50-99%)": 2, "Full (100%)": 1}


def test_unanimity(long):
    # a single vote counts as majority, records without votes do not count
    assert as_dict(consensus.unanimity(consensus.consensus(long)), "level", "n") == {
        "Unanimous": 1,
        "Majority": 2,
        "Minority": 2,
    }


def test_divergence_and_unique_votes(long, listing):
    judged = consensus.judge(long)
    divergence = {r.model: (r.n_valid, r.divergence_pct) for r in consensus.divergence(judged).collect()}
    assert divergence["p"] == (4, 25.0)
    assert divergence["q"] == (4, 50.0)
    assert divergence["r"] == (4, 50.0)
    assert divergence["s"] == (2, 0.0)
    unique = as_dict(consensus.unique_vote(judged, listing), "model", "unique_pct")
    assert unique == {"p": 12.5, "q": 25.0, "r": 25.0, "s": 0.0}


def test_families(wide, listing):
    family_of = {"p": "one", "q": "one", "r": "two", "s": "Other"}
    judged = consensus.judge_wide(wide, VOTERS)
    by_model = as_dict(consensus.alignment(judged, listing), "model", "alignment_pct")
    assert by_model == {"p": 37.5, "q": 37.5, "r": 25.0, "s": 25.0}
    families = consensus.family_alignment(judged, listing, family_of, ["one", "two", "none"])
    assert as_dict(families, "family", "alignment_pct") == {"one": 37.5, "two": 25.0, "none": 0.0}
    intra = pairs.intra_family(wide, listing, family_of, ["one", "two", "none"])
    assert as_dict(intra, "family", "intra_pct") == {"one": 37.5, "two": 100.0, "none": 0.0}


def test_pairs_long_equals_wide(long, wide):
    found = as_set(pairs.pair_counts(wide, VOTERS))
    assert ("p", "q", 4, 3) in found
    assert as_set(pairs.pair_counts_long(long)) == {p for p in found if p[2] > 0}


def test_disjoint_voters_agree_zero(spark):
    table = {1: {"p": "a"}, 2: {"q": "a"}}
    matrix = {(r[0], r[1]): r[2] for r in pairs.agreement_matrix(wide_of(spark, table, ["p", "q"]), ["p", "q"]).collect()}
    assert matrix == {("p", "p"): 100.0, ("q", "q"): 100.0, ("p", "q"): 0.0, ("q", "p"): 0.0}


def test_all_rows_diagonal(wide, listing):
    full = {(r[0], r[1]): r[2] for r in pairs.agreement_all_rows(wide, VOTERS, listing).collect()}
    coverage = {(r[0], r[1]): r[2] for r in pairs.agreement_all_rows(wide, VOTERS, listing, "coverage").collect()}
    assert full["p", "p"] == 100.0 and coverage["p", "p"] == 50.0
    assert full["p", "q"] == coverage["q", "p"] == 37.5


def test_label_overlap(long):
    found = {(r.label_a, r.label_b): r.n for r in pairs.label_overlap(long, consensus.top_labels(long, 2)).collect()}
    assert found == {("a", "a"): 4, ("a", "b"): 3, ("b", "a"): 3, ("b", "b"): 3}


def test_dead_voter_and_errors(spark):
    raw = spark.createDataFrame(
        [(1, "p", "cat"), (1, "q", "Error_Model_Load"), (2, "p", "Error_Processing"), (2, "q", "Error_Model_Load")],
        "item_id bigint, model string, raw string",
    )
    clean = raw.select("item_id", "model", cleaning.null_errors(F.col("raw")).alias("prediction"))
    assert as_set(votes.live_votes(clean)) == {(1, "p", "cat"), (2, "p", None)}
    rates = consensus.error_rates(clean, records_of(spark, [1, 2, 3, 4]))
    assert as_set(rates) == {("p", 1, 3, 75.0), ("q", 0, 4, 100.0)}


def test_shares_and_diversity(long, listing):
    share = {r.model: r for r in consensus.top_class_share(long, listing).collect()}
    assert (share["p"].top_label, share["p"].top_count, share["p"].top_share) == ("a", 3, 37.5)
    assert (share["r"].top_label, share["r"].top_count) == ("a", 2)
    assert as_dict(consensus.diversity(long), "model", "n_labels") == {"p": 2, "q": 3, "r": 3, "s": 1}
    assert as_dict(consensus.diversity(long, approx=True), "model", "n_labels")["q"] == 3


def test_widen_and_lengthen_round_trip(spark, long):
    values = {"prediction": ""}
    wide = votes.widen(long, VOTERS, values)
    assert as_set(votes.lengthen(wide, VOTERS, values)) == as_set(long.dropna())
    assert votes.unpivot(wide, VOTERS).count() == 6 * 4
    assert votes.discover_voters(long) == VOTERS
    many = long.crossJoin(long.sparkSession.range(100)).select("item_id", F.concat("model", "id").alias("model"), "prediction")
    assert len(votes.discover_voters(many)) == 100 * len(VOTERS)


def test_unlisted_voters_fail_by_name(long):
    for build in (lambda: votes.widen(long, VOTERS[1:], {"prediction": ""}), lambda: consensus.label_matrix(long, VOTERS[1:])):
        with pytest.raises(PySparkException, match=VOTERS[0]):
            build().collect()


LABELS = ["", "A", "AB", "AC", "B", "É", "Éa", "日本", "日", "Error_x"]


def test_whole_labels_decide(spark):
    """Labels of several letters, empty ones and other scripts, long and wide alike."""
    table = {i: {v: LABELS[(i * 7 + k * (i % 3)) % len(LABELS)] for k, v in enumerate(VOTERS)} for i in range(40)}
    rows = votes_of(spark, table)
    wide = votes.widen(rows, VOTERS, {"prediction": ""})
    for clean in (False, True):
        w = votes.clean(wide, VOTERS) if clean else wide
        long_rows = votes.lengthen(w, VOTERS, {"prediction": ""})
        a = as_set(consensus.with_consensus(w, VOTERS).select("item_id", "majority", "top_votes", "n_labels").filter("majority is not null"))
        b = as_set(consensus.consensus(long_rows).select("item_id", "majority", "top_votes", "n_labels").filter("majority is not null"))
        assert a == b
        for item, majority, top, _ in a:
            given = [x for x in table[item].values() if not (clean and "Error" in x)]
            counts = {x: given.count(x) for x in given}
            assert top == max(counts.values())
            assert majority == min((x for x, n in counts.items() if n == top), key=lambda x: x.encode())


def test_view_keeps_whole_labels(spark, tmp_path):
    flags = [("AB", "FX"), ("AC", "FY"), ("", "日"), ("É", "é")]
    rows = [(i, 1 + i % 7, a, b, 20.0) for i, (a, b) in enumerate(flags)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = as_dict(views.raw_votes(spark, str(tmp_path)), "item_id", "raw_prediction")
    assert got == {i: a + b for i, (a, b) in enumerate(flags)}


def test_stale_votes_do_not_count(spark):
    """Votes of records that left the listing change no rate over the listed records."""
    table = {1: dict.fromkeys(VOTERS, "a"), 2: dict.fromkeys(VOTERS, "b"), 3: dict.fromkeys(VOTERS, "c")}
    listed, wide = records_of(spark, [1]), wide_of(spark, table, VOTERS)
    rows, cons = votes_of(spark, table), consensus.with_consensus(wide, VOTERS)
    judged = consensus.judge_wide(wide, VOTERS)
    rates = consensus.agreement_rates(cons, listed, strong=2, majority=2).first()
    assert (rates.full_pct, rates.strong_pct, rates.mean_votes) == (100.0, 100.0, float(len(VOTERS)))
    assert all((r.n_error, r.error_pct) == (0, 0.0) for r in consensus.error_rates(rows, listed).collect())
    assert as_set(consensus.consensus_histogram(cons, listed)) == {(len(VOTERS), 1)}
    assert sum(r.n for r in consensus.consensus_bins(cons, listed).collect()) == 1
    assert sum(r.n for r in consensus.agreement_bins(cons, listed, len(VOTERS)).collect()) == 1
    for df, column in (
        (consensus.alignment(judged, listed), "alignment_pct"),
        (consensus.unique_vote(judged, listed), "unique_pct"),
        (consensus.top_class_share(rows, listed), "top_share"),
        (pairs.agreement_all_rows(wide, VOTERS, listed), "agreement"),
    ):
        assert all(0 <= r[column] <= 100 for r in df.collect())


def test_upsert_without_rows_and_without_models(spark):
    stored = spark.createDataFrame([(1, "m1", "a"), (1, "m2", "b"), (1, None, None)], "item_id bigint, model string, prediction string")
    none = spark.createDataFrame([], "item_id bigint, prediction string")
    got = joins.upsert_model(stored, none, "m2", records_of(spark, [1]))
    assert as_set(got.select("item_id", "model", "prediction")) == {(1, "m1", "a"), (1, None, None)}


def test_collapse_rejects_unknown_voter(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 1, 3.0), (1, 9, 1.0)], "i bigint, v int, x double")
    args = (F.col("i"), F.col("v"), {1: "m1", 2: "m2"}, {"": F.col("x")})
    assert as_set(votes.collapse(rows.filter("v = 1"), *args)) == {(1, 3.0, None)}
    with pytest.raises(PySparkException, match="not in the given list of voters: 9"):
        votes.collapse(rows, *args).collect()


def test_one_shuffle_for_consensus(spark):
    """The vote view is partitioned by item, so consensus adds no exchange."""
    from concord.plans import views
    from conftest import SMALL

    for df in (
        consensus.consensus(views.clean_votes(spark, SMALL)),
        consensus.with_consensus(views.clean_wide(spark, SMALL), views.MODELS),
        consensus.judge(views.clean_votes(spark, SMALL)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan


def test_votes_meet_the_listing_before_they_are_made_long(spark):
    """A row an item is joined, in the order it has already: no sort of a row a vote."""
    from concord.plans.all_queries import QUERIES
    from conftest import SMALL

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("alignment", "family_alignment", "unique_vote", "upsert_model", "top_class_share", "error_rate", "valid_error"):
            plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            above = plan[: plan.index("Generate explode")]
            assert "Sort [item_id" not in above, (name, above)
            assert "LeftSemi" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vote_tasks_take_a_fixed_share(spark):
    """What a task over votes reads, and so sorts, does not grow with the tables."""
    from concord.plans.all_queries import QUERIES
    from conftest import SMALL

    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for query in ("majority_vote", "pivot_votes", "alignment", "upsert_model"):
            for name in names:
                spark.conf.set(name, "128MB")
            QUERIES[query](spark, SMALL)
            assert [int(spark.conf.get(name)) for name in names] == [16 << 20, 8 << 20], query
    finally:
        for name in names:
            spark.conf.set(name, before[name])


def test_vote_shares_grow_in_number_with_the_table(spark, tmp_path):
    """Spark splits no share of a shuffle, so their number follows the files and not the session alone."""
    from concord.plans.all_queries import QUERIES
    from conftest import SMALL

    spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SMALL}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name in ("family_alignment", "unique_vote", "upsert_model", "pivot_votes"):
            few, many = (QUERIES[name](spark, path) for path in (SMALL, str(tmp_path)))
            plan = many._jdf.queryExecution().executedPlan().toString()
            shares = [int(n) for n in re.findall(r"hashpartitioning\(item_id#\d+L?, (\d+)\)", plan)]
            assert shares and min(shares) >= 24, (name, plan)
            assert sorted(map(str, many.collect())) == sorted(map(str, few.collect())), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_upsert_and_reindex(spark, long):
    fresh = votes_of(spark, {1: {"p": "z"}, 99: {"p": "z"}}).drop("model")
    merged = joins.upsert_model(long, fresh, "p", records_of(spark, [1, 2]))
    assert as_set(merged) == {(1, "p", "z"), (1, "q", "b"), (1, "r", "a"), (1, "s", "a"), (2, "q", "c")}
    table = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "model string, x double")
    assert as_set(joins.reindex(table, "model", ["q", "none", "p"]).select("position", "model", "x")) == {
        (0, "q", 2.0),
        (1, "none", None),
        (2, "p", 1.0),
    }
    assert as_set(joins.intersect_names(table, "model", ["q", "none", "p"]).select("position", "model")) == {(0, "q"), (2, "p")}


def test_priority_fill_and_grid(spark):
    a = spark.createDataFrame([("d", "m", 1.0)], "dataset string, model string, x double")
    b = spark.createDataFrame([("d", "m", 9.0), ("d", "n", 2.0)], "dataset string, model string, x double")
    assert as_set(joins.priority_fill(a, b, ["dataset", "model"])) == {("d", "m", 1.0), ("d", "n", 2.0)}
    datasets = spark.createDataFrame([("d",), ("gone",)], "dataset string")
    assert as_set(joins.task_grid(datasets, ["m", "n"], a)) == {("d", "m"), ("d", "n")}


def many_votes(n_items, n_voters, n_labels, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(-1, n_labels, size=(n_items, n_voters))
    codes[:, : n_voters // 3] = np.where(rng.uniform(size=(n_items, 1)) < 0.7, codes[:, :1], codes[:, : n_voters // 3])
    return codes


def plain_pairs(codes, names):
    out = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            both = (codes[:, i] >= 0) & (codes[:, j] >= 0)
            out[a, b] = (int(both.sum()), int((both & (codes[:, i] == codes[:, j])).sum()))
    return out


def test_agreement_of_three_hundred_voters(spark, monkeypatch):
    monkeypatch.setattr(bits, "BLOCK", 100)
    names = [f"v{i:03d}" for i in range(300)]
    codes = many_votes(450, 300, 7, 1)
    rows = [(i, *[None if c < 0 else f"l{c}" for c in row]) for i, row in enumerate(codes.tolist())]
    wide = spark.createDataFrame(rows, "item_id bigint, " + ", ".join(f"{v} string" for v in names)).repartition(3)
    want = plain_pairs(codes, names)
    counts = pairs.pair_counts(wide, names, own=True)
    assert {(r.model_a, r.model_b): (r.n_both, r.n_same) for r in counts.collect()} == want
    matrix = {(r.model_a, r.model_b): r.agreement for r in pairs.agreement_matrix(wide, names).collect()}
    assert len(matrix) == 300 * 300 and matrix["v005", "v005"] == 100.0
    for (a, b), (both, same) in list(want.items())[:: 97]:
        if a != b:
            assert matrix[a, b] == matrix[b, a] == pytest.approx(100.0 * same / both if both else 0.0)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count_if") == 0 and len(plan) < 100 * 300


def test_agreement_from_the_long_table(spark, monkeypatch):
    monkeypatch.setattr(bits, "BLOCK", 37)
    names = [f"v{i:02d}" for i in range(25)]
    codes = many_votes(300, 25, 3, 2)
    rows = [(i, v, f"l{c}") for i, row in enumerate(codes.tolist()) for v, c in zip(names, row) if c >= 0]
    rows += [(i, "v00", None) for i in range(300, 310)] + [(400, None, "l1")]
    votes = spark.createDataFrame(rows, "item_id bigint, model string, prediction string").repartition(5)
    want = plain_pairs(codes, names)
    got = pairs.pair_counts_long(votes, own=True)
    assert {(r.model_a, r.model_b): (r.n_both, r.n_same) for r in got.collect()} == want
    matrix = {(r.model_a, r.model_b): r.agreement for r in pairs.agreement_matrix_long(votes).collect()}
    for (a, b), (both, same) in want.items():
        assert matrix[a, b] == matrix[b, a] == pytest.approx(100.0 if a == b else 100.0 * same / both)
    assert pairs.pair_counts_long(votes.filter("false")).count() == 0


def test_agreement_without_items(spark):
    wide = wide_of(spark, {}, ["p", "q"])
    assert as_set(pairs.pair_counts(wide, ["p", "q"], own=True)) == {("p", "p", 0, 0), ("p", "q", 0, 0), ("q", "q", 0, 0)}


def test_shared_bits():
    rows = np.random.default_rng(3).uniform(size=(70, 300)) < 0.4
    assert (bits.shared_bits(rows) == rows.astype(int) @ rows.T.astype(int)).all()


def test_consensus_from_changed_counts(spark):
    """One model's votes are replaced, some by failures, some for new items; all others stay unread."""
    table = {i: {"p": "ab"[i % 2], "q": "abc"[i % 3], "r": None if i % 5 == 0 else "b"} for i in range(40)}
    new = {i: "c" if i % 4 else None for i in range(20, 50)}
    after = {i: {**table.get(i, {}), "q": new.get(i)} for i in range(50)}
    after = {i: {m: x for m, x in row.items() if m != "q" or i in new} for i, row in after.items()}
    votes_before, votes_after = votes_of(spark, table), votes_of(spark, {i: r for i, r in after.items() if r})
    counts = consensus.label_counts(votes_before)
    changes = consensus.changed_counts(votes_before.filter("model = 'q'"), votes_of(spark, {i: {"q": x} for i, x in new.items()}))
    got = consensus.updated_consensus(consensus.consensus(votes_before), counts, changes)
    assert as_set(got.select(COLUMNS)) == as_set(consensus.consensus(votes_after).select(COLUMNS))
    whole = consensus.merged_counts(counts, changes)
    assert as_set(whole) == as_set(consensus.label_counts(votes_after))
    assert as_set(consensus.consensus_of_counts(counts).select(COLUMNS)) == as_set(consensus.consensus(votes_before).select(COLUMNS))
