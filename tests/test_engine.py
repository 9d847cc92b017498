"""Operators against hand-worked cases, cell-by-cell loops and conservation rules."""

import math

import numpy as np
import pytest

from seqlake.functions import special
from seqlake.operators import alignment as al
from seqlake.operators import convert, hdp, msa, segments
from seqlake.operators import significance as sig
from seqlake.operators import profiles as pr
from seqlake.sources import formats
from seqlake.streaming import ingest

FIVE = ">one\nACDEF\n>two\nACDQQ\n>three\nWYWYW\n>four\nKKKKK\n>five\nACDEF\n"


@pytest.fixture(scope="module")
def five(spark):
    texts = spark.createDataFrame([("five", FIVE)], "name string, value string")
    return formats.cells(formats.fasta_sequences(texts))


def test_neff_of_worked_example(five):
    got = {r.threshold: r.neff for r in msa.neff(five, [1.0, 0.6]).collect()}
    assert got[1.0] == pytest.approx(4.0)  # one and five are identical
    assert got[0.6] == pytest.approx(3.0)  # two joins them


def test_identical_sequences(spark):
    texts = spark.createDataFrame([("m", ">a\nAAAA\n>b\nAAAA\n>c\nAAAA\n")], "name string, value string")
    own = formats.cells(formats.fasta_sequences(texts))
    assert msa.neff(own, [0.2, 1.0]).select("neff").distinct().first()[0] == pytest.approx(1.0)
    weights = msa.global_weights(own)
    assert {round(r.weight, 9) for r in weights.collect()} == {round(1 / 3, 9)}
    assert {round(r.distinct, 9) for r in msa.column_entropy(own, weights).collect()} == {1.0}


def test_readers_agree(spark):
    stockholm = "# STOCKHOLM 1.0\n#=GS one DE first\none AC.D\ntwo ACWD\n\none EF\ntwo QQ\n//\n"
    own = formats.stockholm_sequences(spark.createDataFrame([("s", stockholm)], "name string, value string")).orderBy("seq_id").collect()
    assert [(r.description, r.residues) for r in own] == [("first", "AC-DEF"), ("two", "ACWDQQ")]


def test_unequal_lengths_fail(spark):
    texts = spark.createDataFrame([("bad", ">a\nAC\n>b\nACD\n")], "name string, value string")
    with pytest.raises(Exception, match="unequal"):
        formats.fasta_sequences(texts).collect()


def test_illegal_residue_fails(spark):
    texts = spark.createDataFrame([("bad", ">a\nA1\n")], "name string, value string")
    with pytest.raises(Exception, match="unrecognised"):
        formats.cells(formats.fasta_sequences(texts)).collect()


def test_purge_keeps_query_and_drops_copies(five):
    kept = {r.seq_id for r in msa.purge(five, 0.9).collect() if r.kept}
    assert 0 in kept and 4 not in kept and {2, 3} <= kept


def test_transitions_sum_to_one(five):
    p = pr.transition_posteriors(msa.transition_counts(five, msa.global_weights(five)))
    sums: dict = {}
    for r in p.collect():
        sums[r.k, r.step[0]] = sums.get((r.k, r.step[0]), 0) + r.p
    assert sums == pytest.approx({(k, s): 1.0 for k in range(6) for s in "MID"})


def test_transitions_of_worked_example(spark):
    """Two sequences over the query's columns 1, 3 and 4: column 2 is an insertion."""
    texts = spark.createDataFrame([("m", ">q\nA-CD\n>s\nAWC-\n")], "name string, value string")
    own = formats.cells(formats.fasta_sequences(texts))
    weights = spark.createDataFrame([("m", 0, 0.25), ("m", 1, 0.75)], "msa_id string, seq_id long, weight double")
    got = {(r.k, r.step): r.w for r in msa.transition_counts(own, weights).collect()}
    # the second sequence ends at column 3, so its gap at the last column counts nowhere
    assert got == {(0, "MM"): 1.0, (1, "MM"): 0.25, (1, "MI"): 0.75, (1, "IM"): 0.75, (2, "MM"): 0.25, (3, "MM"): 0.25}


def test_identities_by_overlap(spark):
    texts = spark.createDataFrame([("m", ">q\nACDEF-\n>s\n--DEWW\n>t\nAC----\n")], "name string, value string")
    got = {(r.i, r.j): (r.matches, r.overlap) for r in msa.identities(formats.cells(formats.fasta_sequences(texts))).collect()}
    assert got == {(0, 1): (2, 3), (0, 2): (2, 2)}


def test_blocks_of_sequences(spark, sf_dir, monkeypatch):
    """Identities and numbers of sequences don't depend on the blocks that are compared."""
    from seqlake.plans.adapters import cells

    own = cells(spark, sf_dir).filter("msa_id < 3")
    result = lambda: (set(map(tuple, msa.identities(own).collect())), {(r.msa_id, r.threshold): round(r.neff, 9) for r in msa.neff(own, [0.1, 0.2]).collect()})
    one = result()
    monkeypatch.setattr(msa, "BLOCK", 7)
    assert result() == one


def plain_purge(rows, identity):
    """Survivors of one pass, by loops over strings; the first is the query."""
    match = [i for i, c in enumerate(rows[0]) if c != "-"]

    def same(a, b):
        both = [(x, y) for x, y in ((a[i], b[i]) for i in match) if "-" not in (x, y) and "X" not in (x, y)]
        return sum(x == y for x, y in both) / len(both) if both else 0.0

    order = sorted(range(1, len(rows)), key=lambda k: -same(rows[0], rows[k]))
    kept = [0]
    for k in order:
        if any(rows[k][i] not in "-X" for i in match) and all(same(rows[k], rows[j]) < identity for j in kept):
            kept.append(k)
    return set(kept)


def test_purge_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    rows = ["".join(rng.choice(list("ACDX-"), 30, p=[0.3, 0.25, 0.25, 0.05, 0.15])) for _ in range(25)]
    rows += [rows[3], rows[4][:15] + rows[5][15:], rows[0]]
    texts = spark.createDataFrame([("m", "".join(f">s{i}\n{r}\n" for i, r in enumerate(rows)))], "name string, value string")
    own = formats.cells(formats.fasta_sequences(texts))
    for identity in (0.4, 0.6, 0.9):
        assert {r.seq_id for r in msa.purge(own, identity).collect() if r.kept} == plain_purge(rows, identity)


def test_thresholds():
    assert msa.parse_thresholds("62%, 0.5,0.62") == [0.5, 0.62]
    with pytest.raises(ValueError):
        msa.parse_thresholds("0,1")


def test_profile_of_an_alignment(spark, five):
    from seqlake.operators import construct

    rows = construct.constructed(five, 0.9, low_complexity=False).orderBy("pos").collect()
    assert [r.aa for r in rows] == list("ACDEF") and {r.n_seqs for r in rows} == {4}  # the copy of the query goes
    assert all(sum(r.trg) == pytest.approx(1, abs=1e-4) and sum(r.bkg) == pytest.approx(1) and len(r.trn) == 9 for r in rows)
    assert [r.trn[0] for r in rows][-1] == 1.0 and all(sum(r.trn[i : i + 3]) == pytest.approx(1) for r in rows for i in (0, 3, 6))


def test_context_coefficients():
    c = pr.context_coefficients()
    assert len(c) == 15 and sum(c) == pytest.approx(1) and c == c[::-1] and c[7] == 0.4


# ------------------------------------------------------------------ alignment


def random_case(seed, m=9, n=7):
    rng = np.random.default_rng(seed)
    trn = lambda k: np.log(rng.dirichlet(np.ones(3), size=(k + 1, 3)).reshape(k + 1, 9))
    return rng.normal(-0.2, 1.0, size=(m, n)), trn(m), trn(n)


def by_cells(s, q, t):
    """The same recurrence, a cell at a time."""
    m, n = s.shape
    z = lambda: np.zeros((m + 1, n + 1))
    mm, mi, im, dn, nd = z(), z(), z(), z(), z()
    best = 0.0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            a, b = q[i - 1], t[j - 1]
            enter = max(mm[i-1, j-1] + a[0] + b[0], mi[i-1, j-1] + a[0] + b[3], im[i-1, j-1] + a[3] + b[0], dn[i-1, j-1] + a[6] + b[0], nd[i-1, j-1] + a[0] + b[6])
            mm[i, j] = max(0.0, enter + s[i-1, j-1])
            mi[i, j] = max(mm[i-1, j] + a[0] + t[j][1], mi[i-1, j] + a[0] + t[j][4])
            im[i, j] = max(mm[i, j-1] + q[i][1] + b[0], im[i, j-1] + q[i][4] + b[0])
            dn[i, j] = max(mm[i-1, j] + a[2], dn[i-1, j] + a[8])
            nd[i, j] = max(mm[i, j-1] + b[2], nd[i, j-1] + b[8])
            best = max(best, mm[i, j])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_local_alignment_matches_loop(seed):
    s, q, t = random_case(seed)
    assert al.local(s, q, t, close_corners=False)[0] == pytest.approx(by_cells(s, q, t))


def test_uniform_profiles_score_nothing():
    s = np.zeros((3, 3)) - 0.002
    q = np.tile(np.log([0.9, 0.05, 0.05, 0.5, 0.5, 1e-9, 0.5, 1e-9, 0.5]), (4, 1))
    assert al.local(s, q, q)[0] == 0.0


def test_single_diagonal():
    s = np.full((6, 6), -2.0)
    np.fill_diagonal(s, 2.0)
    q = np.tile(np.log([0.98, 0.01, 0.01, 0.5, 0.5, 1e-9, 0.5, 1e-9, 0.5]), (7, 1))
    score, end, back = al.local(s, q, q)
    path = al.trace(back, end)
    assert end == (5, 5) and len(path) == 6 and all(step == al.DIAGONAL for _, _, step in path)
    assert al.bonus([2.0] * 6) == pytest.approx(math.sqrt(2 * (5 + 4 + 3 + 2)))
    p, steps = al.maximum_accuracy(s, q, q)
    assert [(y, x) for y, x, _ in steps] == [(i, i) for i in range(6)]
    assert al.strings(steps, "ACDEFG", "ACDEFG", s) == ("ACDEFG", "ACDEFG", "ACDEFG")


@pytest.mark.parametrize("seed", range(4))
def test_match_probabilities(seed):
    s, q, t = random_case(seed, 6, 5)
    f, b = al.forward(s, q, t), al.backward(s, q, t)
    total = np.logaddexp.reduce(f.ravel())
    # total over ends equals total over starts: every alignment is counted once either way
    into = s * 0
    assert np.logaddexp.reduce((into + b).ravel()) == pytest.approx(total, rel=1e-9)
    p = np.exp(f + b - total)
    assert (p.sum(axis=1) <= 1 + 1e-9).all() and (p.sum(axis=0) <= 1 + 1e-9).all()


# --------------------------------------------------------------- significance


def test_symmetric_scores():
    s, p = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    lam = sig.solve_lambda(s, p)
    assert lam == pytest.approx(math.log(3))
    assert sig.solve_k(s, p, lam, sig.relative_entropy(s, p, lam)) == pytest.approx(1 / 3)


def test_lambda_needs_negative_mean():
    assert sig.solve_lambda(np.array([-1.0, 2.0]), np.array([0.5, 0.5])) == -1.0


def test_search_space_shrinks():
    assert 0 < sig.search_space(1000, 10**6, 3000) < 1000 * 10**6
    assert sig.length_adjustment(300, 10**6, 3000) == 0


def test_combined_evalue_falls_with_score():
    low, high = (sig.combined_log_evalue(x, 5.0, 100, 100, 1e6, 0.1, 4.0, 1.6) for x in (10.0, 40.0))
    assert high < low


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert special.hurwitz_zeta(2.0) == pytest.approx(math.pi**2 / 6)
    assert special.polygamma(1, 1.0) == pytest.approx(math.pi**2 / 6)
    assert special.log_gamma_q(1.0, 2.0) == pytest.approx(-2.0)
    assert special.log_gamma_q(0.5, 0.3) == pytest.approx(math.log(math.erfc(math.sqrt(0.3))))
    assert math.exp(special.log_beta_i(2.0, 3.0, 0.4)) == pytest.approx(0.5248)
    assert special.root(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    assert special.log_binomial(5, 2) == pytest.approx(math.log(10))


# ------------------------------------------------------------------ segments


def test_seg_masks_repeats_only():
    code = {c: i for i, c in enumerate("ARNDCQEGHILKMFPSTWYV")}
    low = np.array([code[c] for c in "A" * 12])
    high = np.array([code[c] for c in "ARNDCQEGHILK"])
    assert segments.seg(low) == [(0, 11)]
    assert segments.seg(high) == []


def plain_seg(codes, alphabet, width=12, low=2.2, high=2.5, most=100):
    """The same search with counts made anew for every window."""
    n, down = len(codes), width // 2

    def entropy(part):
        return round(-sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part)), 12)

    def log_p(part):
        counts = [part.count(c) for c in set(part)]
        ways = math.lgamma(len(part) + 1) - sum(math.lgamma(c + 1) for c in counts)
        given = math.lgamma(alphabet + 1) - math.lgamma(alphabet - len(counts) + 1) - sum(math.lgamma(counts.count(c) + 1) for c in set(counts))
        return round(ways + given - len(part) * math.log(alphabet), 9)

    value = {i + down: entropy(codes[i : i + width]) for i in range(n - width + 1)}
    found = []

    def search(left, right):
        at = left + down
        while at <= right - (width - 1 - down):
            if value[at] > low:
                at += 1
                continue
            a = b = at
            while a - 1 >= left + down and value[a - 1] <= high:
                a -= 1
            while b + 1 <= right - (width - 1 - down) and value[b + 1] <= high:
                b += 1
            begin, end = a - down, b + width - 1 - down
            size = end - begin + 1
            spans = range(size, max(0, size - most) if size > most else 0, -1)
            p, _, start, span = min((log_p(codes[x : x + k]), -k, x, k) for k in spans for x in range(begin, end - k + 2))
            if start - left >= width and start > begin:
                search(left, start - 1)
            found.append((start, start + span - 1))
            left = start + span
            at = max(b + 1, left + down)

    search(0, n - 1)
    covered = sorted({i for a, b in found for i in range(a, b + 1)})
    return [(a, b) for a, b in zip([x for x in covered if x - 1 not in covered], [x for x in covered if x + 1 not in covered])]


@pytest.mark.parametrize("seed", range(6))
def test_segments_are_the_plain_ones(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 20, 30), rng.integers(0, 3, 25), rng.integers(0, 20, 15), np.repeat(rng.integers(0, 20), 14), rng.integers(0, 20, 20), rng.integers(4, 6, 130)]
    codes = np.concatenate([parts[i] for i in rng.permutation(len(parts))])
    assert segments.seg(codes) == plain_seg(codes.tolist(), 20)


def test_profile_segments(spark):
    rng = np.random.default_rng(1)
    one = rng.dirichlet(np.ones(20) * 0.1)
    columns = [*rng.dirichlet(np.ones(20) * 0.1, 30), *([one] * 16), *rng.dirichlet(np.ones(20) * 0.1, 30)]
    rows = spark.createDataFrame([(7, i + 1, c.tolist()) for i, c in enumerate(columns)], "profile_id long, pos int, trg array<double>")
    got = segments.seg_profiles(rows).collect()
    assert len(got) == 1 and got[0].profile_id == 7 and got[0].left <= 33 and got[0].right >= 44


def test_merged_intervals(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 8, 9), (1, 2, 2), (2, 5, 5)], "k int, left int, right int")
    assert sorted(tuple(r) for r in segments.merged(rows, "k").collect()) == [(1, 1, 5), (1, 8, 9), (2, 5, 5)]


def test_merged_segments_of_orders_without_a_date(spark, tmp_path):
    """f9_merged_segments: null dates join the run before them, or stay rows of nulls, as in the SQL; equal intervals are one."""
    import duckdb

    from seqlake.plans import registry

    con = duckdb.connect()
    con.execute("SET threads = 1")  # the SQL leaves the order of equal intervals open
    con.execute("""CREATE TABLE orders AS SELECT k AS o_orderkey, c::BIGINT AS o_custkey, d::TIMESTAMP AS o_orderdate FROM (VALUES (1, 1, '1995-01-01'), (2, 1, NULL), (3, 1, '1995-01-31'), (4, 1, '1995-06-01'),
        (5, 1, NULL), (6, 2, NULL), (7, 2, NULL), (8, 3, '1995-02-01'), (9, 3, '1995-02-01'), (10, NULL, '1995-03-01'), (11, NULL, NULL), (12, 4, '1989-12-31'), (13, 4, NULL)) AS v(k, c, d)""")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    mine = sorted((tuple(r) for r in registry.queries()["f9_merged_segments"](spark, str(tmp_path)).collect()), key=key)
    assert mine == sorted(con.execute(registry.oracle_sql()["f9_merged_segments"]).fetchall(), key=key)
    assert len(mine) == 7 and mine.count((2, None, None)) == 2


def test_greedy_classes():
    assert segments.greedy_classes(np.array([[0.0], [10.0], [20.0], [1.0]])).tolist() == [0, 0, 1, 0]


# --------------------------------------------------------------- conversions


def test_pairwise_to_multiple(spark):
    rows = spark.createDataFrame([(0, 1, 1, "AC-D", "ACWD"), (0, 2, 2, "CD", "C-")], "query_id int, target_id int, q_from int, q_aln string, t_aln string")
    got = {r.target_id: r.aligned for r in convert.multiple_alignment(rows).collect()}
    assert got == {1: "ACWD", 2: "-C--"}
    assert convert.conflicting_positions(rows).count() == 0


def test_ss_join_checks_residues(spark):
    own = spark.createDataFrame([(1, 1, "A")], "profile_id int, pos int, aa string")
    good = spark.createDataFrame([(1, 1, "A", "H", 0.10009, 0.2, 0.7)], "profile_id int, pos int, aa string, state string, pc double, pe double, ph double")
    assert convert.with_ss(own, good).first().pc == 1000
    with pytest.raises(Exception, match="differ"):
        convert.with_ss(own, good.replace("A", "W", "aa")).collect()


def test_predictions_and_options(spark):
    texts = spark.createDataFrame([("p", "# head\n  1 A H 0.1 0.2 0.7\n  2 C E 0.1 0.8 0.1\n")], "name string, value string")
    assert [(r.aa, r.state) for r in formats.predictions(texts).orderBy("pos").collect()] == [("A", "H"), ("C", "E")]
    assert formats.options("[OPTIONS]\nEVAL = 5  # cutoff\n", defaults={"NOHITS": "700"}) == {"EVAL": "5", "NOHITS": "700"}


def test_profile_text_stacked(spark):
    row = ("p{}", "d", 1, 3, 2.0, 1, "A", [0.05] * 20, [0.1] * 9, [1.0, 0.0, 0.0], "H")
    rows = spark.createDataFrame([(row[0].format(i), *row[1:]) for i in range(2)], formats.PROFILE)
    whole = "".join(r.value for r in formats.profile_text(rows).orderBy("name").collect())
    back = formats.profiles(spark.createDataFrame([(whole,)], "value string")).orderBy("name").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in rows.orderBy("name").collect()]


def test_mixture_prefers_own_dish():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.3, (40, 3)), rng.normal(4, 0.3, (40, 3))
    prior = hdp.prior_parameters(np.vstack([a, b]))
    dishes = [hdp.dish_parameters(x, *prior) for x in (a, b)]
    order, p = hdp.memberships(np.array([[0.0, 0, 0], [4.0, 4, 4]]), dishes, [40, 40], prior)
    assert order[:, 0].tolist() == [0, 1] and (p.sum(axis=1) <= 1 + 1e-9).all()


def test_mixture_takes_whole_vectors(spark, sf_dir):
    from seqlake.plans import queries

    own = queries.profiles(spark, sf_dir).select("profile_id", "pos", "cv").toPandas().sort_values(["profile_id", "pos"])
    x, ids = np.stack(own["cv"].to_numpy()), own["profile_id"].to_numpy()
    members = [x[ids == i] for i in np.unique(ids)]
    d = x.shape[1]
    prior = (np.mean([m.mean(axis=0) for m in members], axis=0), np.eye(d), 0.1, d + 2.0)
    order, p = hdp.memberships(x, [hdp.dish_parameters(m, *prior) for m in members], [len(m) for m in members], prior, top=1)
    got = queries.k1_mixture(spark, sf_dir).toPandas().sort_values(["profile_id", "pos"])
    assert d == 19 and got["dish"].tolist() == order[:, 0].tolist()
    assert np.allclose(got["p"], p[:, 0], atol=2e-6)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen: list[int] = []
    ingest.ingest(spark, sf_dir, batch.schema, lambda df, _: seen.append(df.count()), str(tmp_path / "ck"), pattern="events.parquet")
    assert sum(seen) == batch.count()


def test_alignment_invariant_to_partitions(spark, sf_dir):
    from seqlake.operators import search
    from seqlake.plans.queries import packed_profiles

    own = packed_profiles(spark, sf_dir).cache()
    one = {tuple(r) for r in search.hits(own, own.coalesce(1)).select("query_id", "target_id", "score").collect()}
    many = {tuple(r) for r in search.hits(own, own.repartition(5)).select("query_id", "target_id", "score").collect()}
    assert one == many


def test_state_weights_are_normalised(five):
    sums: dict = {}
    for r in msa.state_weights(five).collect():
        sums[r.pos] = sum(r.weights)
        assert 1 <= r.n_symbols <= 20 and 1 <= r.n_match <= 5 and r.n_insert == 0
    assert len(sums) == 5 and all(v == pytest.approx(1.0, abs=1e-4) for v in sums.values())


def test_expected_distinct_inverts():
    table = msa.expected_distinct()
    assert table[0] == pytest.approx(1.0) and table == sorted(table)
    assert msa.observations_of(table[6], table) == pytest.approx(7.0)


def test_low_complexity_is_masked(spark):
    texts = spark.createDataFrame([("m", ">a\n" + "A" * 14 + "RNDCQEGHILKMFP" + "\n")], "name string, value string")
    own = msa.without_low_complexity(formats.cells(formats.fasta_sequences(texts)))
    codes = [r.code for r in own.orderBy("pos").collect()]
    assert codes[:12] == [23] * 12 and 23 not in codes[-8:]


def test_scaling_reaches_reference():
    s, p = np.array([-2.0, -1.0, 1.0, 3.0]), np.array([0.5, 0.3, 0.15, 0.05])
    scaled, factor = sig.scaled_scores(s, p)
    assert sig.solve_lambda(scaled, p) == pytest.approx(sig.LAMBDA_REF, rel=0.02) and factor > 0
    assert np.allclose(scaled * sig.SCALE, np.rint(scaled * sig.SCALE))  # in steps of the histogram's unit


def test_search_reports(spark):
    text = "Results from round 1\n>t1 first\n Score = 50.1 bits (118), Expect = 2e-10\nQuery: 3 AC-D 5\nSbjct: 7 ACWD 10\nQuery: 6 EF 7\nSbjct: 11 EF 12\nResults from round 2\n>t1 first\n Score = 60 bits, Expect = e-20\nQuery 1 AC 2\nSbjct 5 AC 6\n>t2\n Score = 9 bits, Expect = 50\nQuery 1 AC 2\nSbjct 5 AC 6\n"
    got = formats.search_reports(spark.createDataFrame([("q", text)], "name string, value string"))
    rows = {(r["round"], r.target): r for r in got.collect()}
    assert set(rows) == {(1, "t1 first"), (2, "t1 first")}
    assert rows[1, "t1 first"].q_aln == "AC-DEF" and rows[1, "t1 first"].t_aln == "ACWDEF" and rows[1, "t1 first"].q_from == 3
    assert formats.last_round(got).count() == 1


def test_results_round_trip(spark, sf_dir, tmp_path):
    from seqlake.plans.queries import b13_json_results, g3_search

    b13_json_results(spark, sf_dir).select("value").write.text(str(tmp_path / "json"))
    found = g3_search(spark, sf_dir).cache()
    assert formats.json_hits(spark, str(tmp_path / "json")).count() == found.count()
    assert formats.plain_results(found.withColumn("evalue", found.score)).count() == found.select("query_id").distinct().count()


def test_lambda_residuals():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(2, 40)
        s, p = np.sort(rng.normal(-0.5, rng.choice([0.1, 1, 3]), n)), rng.dirichlet(np.ones(n) * rng.choice([0.2, 1]))
        lam = sig.solve_lambda(s, p)
        assert lam < 0 or abs((p * np.exp(lam * s)).sum() - 1) < 1e-10


def test_batches_align_like_single_pairs():
    """Targets of different lengths that go through the recurrences together."""
    from seqlake.operators import search

    rng = np.random.default_rng(3)

    def profile(i, n):
        trn = np.log(rng.dirichlet(np.ones(3) * 3, size=(n + 1, 3)).reshape(n + 1, 9) * [1, 0.05, 0.05, 1, 1, 1, 1, 1, 1] + 1e-9)
        return {"id": i, "len": n, "residues": "".join(rng.choice(list("ACDEX"), n)), "trg": rng.dirichlet(np.ones(20) * 0.3, n), "bkg": np.full(20, 0.05), "trn": trn, "eno": 3.0}

    q, targets = profile(0, 40), [profile(i, n) for i, n in enumerate((12, 61, 40, 33, 90), 1)]
    targets.append({**q, "id": 9})
    for realign in (False, True):
        terms = search.Terms(realign=realign)
        many = search.batch_hits(q, targets, 0.0, terms)
        one = [search.pair_hit(q, t, 0.0, terms) for t in targets]
        assert len(many) >= 2
        for a, b in zip(many, [x for x in one if x is not None], strict=True):
            assert [x for x in a if isinstance(x, str)] == [x for x in b if isinstance(x, str)]
            assert [x for x in a if isinstance(x, (int, float))] == pytest.approx([x for x in b if isinstance(x, (int, float))], rel=1e-9, abs=1e-9)


def test_positives_are_counted():
    assert al.positives([0.2, 0.3, -1.0, 2.0]) == 3


def test_unknown_residues_dont_count():
    from seqlake.operators import search

    scores = np.array([[1.0, -2.0], [-3.0, 9.0]])
    assert search.pair_statistics(scores, "AX", "CD")[3:] == (-0.5, -2.0, 1.0)
    assert search.pair_statistics(scores, "XX", "CD")[3:] == (0.0, 0.0, 0.0)


def test_length_adjustment_is_the_fixed_point():
    rng = np.random.default_rng(1)
    for _ in range(300):
        m, n_profiles = int(rng.integers(700, 5000)), int(rng.integers(1, 200))
        n_db = int(rng.integers(n_profiles * 60, n_profiles * 3000) + 700)
        if sig.K_GAPPED * m * n_db < max(m, n_db):
            continue
        ok = [x for x in range(60) if (m - x) * (n_db - n_profiles * x) > 0 and x <= sig.ALPHA / sig.LAMBDA_GAPPED * math.log(sig.K_GAPPED * (m - x) * (n_db - n_profiles * x)) + sig.BETA]
        assert sig.length_adjustment(m, n_db, n_profiles) == max(ok, default=0)


def test_lattice_statistics():
    s, p = np.array([-2.0, 2.0]), np.array([0.75, 0.25])
    lam, _, k = sig.lattice_statistics(s, p)
    assert lam == pytest.approx(math.log(3) / 2) and k == pytest.approx(1 / 3)


def test_linear_algebra():
    from seqlake.functions import linear

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 6, 6)), rng.normal(size=(50, 6, 2))
    assert np.allclose(a @ linear.solve(a, b), b) and np.allclose(linear.inverse(a) @ a, np.eye(6), atol=1e-8)
    sign, log = linear.log_determinant(a)
    assert np.allclose(sign, np.linalg.slogdet(a)[0]) and np.allclose(log, np.linalg.slogdet(a)[1])
    order, low, up = linear.lu(a)
    assert np.allclose(np.take_along_axis(a, order[..., None], axis=-2), low @ up)
    spd = a @ np.swapaxes(a, -1, -2) + np.eye(6)
    assert np.allclose(spd @ linear.cholesky_solve(spd, b), b) and np.allclose(linear.cholesky_log_determinant(spd), np.linalg.slogdet(spd)[1])
    assert np.allclose(linear.kronecker(a[0], b[0]), np.kron(a[0], b[0])) and np.allclose(linear.centring(6) @ b[0], b[0] - b[0].mean(axis=0))


def test_parameter_files():
    from seqlake.sources import tables

    text = "# parameters\n[UNGAPPED]\nLambda = 1.5\nK = 0.2\n[GAPPED_A_1]\nLambda = 0.5\n"
    assert tables.statistics(text) == {"UNGAPPED": {"lambda": 1.5, "k": 0.2}, "GAPPED_A_1": {"lambda": 0.5}}
    with pytest.raises(ValueError):
        tables.triangle("Cardinality = 3\n1 2\n")
    pair = tables.levels({(1, 0): "Cardinality = 2\n1\n2 3\n"})
    assert tables.table_of(pair, [1.0, 5.0], 9.0, 2.0).tolist() == [[1, 2], [2, 3]] and tables.table_of(pair, [1.0, 5.0], 0.5, 2.0) is None
    letters = "ARNDCQEGHILKMFPSTWYV"
    matrix = "# scores\n   " + "  ".join(letters) + "\n" + "".join(f"{a} " + " ".join("2" if a == b else "-2" for b in letters) + "\n" for a in letters)
    ratios = tables.substitution_ratios(matrix)
    assert ratios[0][0] == 2.0 and ratios[0][1] == 0.5 and tables.matrix_named("ONE", {"one": ratios, "two": []}, "two") is ratios
    got = tables.mixture("dim = 2\nkappa = 0.1\n\nmu\n1 2\n\nscale\n1 0\n0 1\n\nscale\n2 0\n0 2\n")
    assert got["dim"] == 2 and got["mu"][0].tolist() == [1, 2] and len(got["scale"]) == 2


def test_query_row_is_inserted(spark):
    pairs = spark.createDataFrame([(0, 1, 2, "C-D", "CWD")], "query_id int, target_id int, q_from int, q_aln string, t_aln string")
    queries = spark.createDataFrame([(0, "ACDE")], "query_id int, residues string")
    rows = convert.query_anchored(pairs, queries)
    assert {r.target_id: r.aligned for r in rows.collect()} == {-1: "AC-DE", 1: "-CWD-"}
    assert convert.aligned_text(rows, 3).first().value == ">query\nAC-\nDE\n>1\n-CW\nD-\n"


def test_rank_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).withColumn("v", F.col("id") * 37 % 101)
    got = [(r.v, r.id, r.n) for r in convert.numbered(rows, [F.desc("v"), F.col("id")], "n").collect()]
    want = sorted(((r * 37 % 101, r) for r in range(200)), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(v, i, k) for k, (v, i) in enumerate(want, 1)]


def test_stockholm_notes(spark):
    text = "# STOCKHOLM 1.0\n#=GF AC PF1\n#=GF DE a family\none ACd.-F\ntwo AC..WF\n#=GC seq_cons ab.\n\none gH\ntwo -H\n#=GC seq_cons cd\n//\none ZZ\n//\n"
    r = formats.stockholm_notes(spark.createDataFrame([("s", text)], "name string, value string")).first()
    assert (r.accession, r.description, r.classes, r.match) == ("PF1", "a family", "ab.cd", [1, 2, 5, 6, 8])


def profile_rows(spark):
    rows = [(f"p{i}", "d", n, 3, 2.0, k + 1, "A", [0.05] * 20, [0.1] * 9, [1.0, 0.0, 0.0], "H") for i, n in enumerate((2, 3, 1)) for k in range(n)]
    return spark.createDataFrame(rows, formats.PROFILE)


def test_database_forms(spark, tmp_path):
    """Text and columns hold the same profiles; the open chain prefers columns, and bad databases are named."""
    rows = profile_rows(spark)
    texts = [r.value for r in formats.database_text(rows).collect()]
    assert texts[0].endswith("PROFS: 3\nSIZE: 6\n") and [t.split("FILE: ")[1][:2] for t in texts[1:]] == ["p1", "p0", "p2"]
    (tmp_path / "a").write_text("".join(texts))
    head = formats.text_header(formats.read_texts(spark, str(tmp_path / "a"))).first()
    assert (head.n_profiles, head.n_positions) == (3, 6)
    want = sorted(tuple(r) for r in rows.collect())
    assert sorted(tuple(r) for r in formats.open_database(spark, str(tmp_path / "a")).collect()) == want
    formats.write_database(rows.filter("name = 'p1'"), str(tmp_path / "b.parquet"))
    assert formats.open_database(spark, str(tmp_path / "b")).count() == 3
    both, bad = formats.open_databases(spark, [str(tmp_path / x) for x in ("b", "a", "none", "a")])
    assert both.count() == 9 and [b[-4:] for b in bad] == ["none"]


def test_full_text_has_every_field(spark):
    from pyspark.sql import functions as F

    rows = profile_rows(spark).withColumn("obs", F.col("trg")).withColumn("information", F.lit(0.5))
    got = {r.name: r.value for r in formats.full_profile_text(rows).collect()}
    assert got["p1"].count("TRG: ") == 3 and got["p1"].count("INF: 0.500000") == 3 and got["p1"].endswith("*\n")


def test_result_documents(spark, sf_dir, tmp_path):
    import json
    import os

    from seqlake.operators import search
    from seqlake.plans.queries import packed_profiles

    own = packed_profiles(spark, sf_dir)
    found = search.top_hits(search.with_evalues(search.hits(own, own), own, 500, 10), cutoff=1e6).cache()
    docs = {r.query_id: json.loads(r.value) for r in formats.result_documents(found, 10, 500, 3, 2).collect()}
    for q, d in docs.items():
        assert d["query"]["query_id"] == q and d["database"] == {"number_of_profiles": 10, "number_of_positions": 500}
        assert len(d["search_summary"]) <= 3 and len(d["search_hits"]) <= 2 and d["search_summary"][0]["target_id"] == q
        a = d["search_hits"][0]["alignment"]
        assert a["aln_length"] == len(a["query_aln"]) and a["evalue"] <= d["search_summary"][-1]["evalue"]
    plain = {r.query_id: r.value for r in formats.plain_documents(found, 10, 500, 3, 2).collect()}
    assert set(plain) == set(docs) and all("Identities = " in v and "Query:      1 " in v for v in plain.values())
    formats.write_documents(formats.result_documents(found, 10, 500), str(tmp_path / "out"))
    assert {x for x in os.listdir(tmp_path / "out") if x.startswith("file=")} == {f"file={q}__{i}.json" for i, q in enumerate(sorted(docs))}


def test_alignment_blocks():
    text = formats.alignment_block("AC-DEF", "AC  E+", "ACWDEY", 3, 7, 4)
    assert text.split("\n") == ["Query:      3 AC-D      5", " " * 14 + "AC  ", "Sbjct:      7 ACWD     10", "", "Query:      6 EF      7", " " * 14 + "E+", "Sbjct:     11 EY     12", ""]


def test_probability_text(spark):
    rows = spark.createDataFrame([(2, 1, 0.25), (0, 0, 0.5)], "bin_a int, bin_b int, p double")
    lines = formats.probability_text(rows).first().value.split("\n")
    assert len(lines) == 42 and lines[0] == "0.500000" and lines[2].split()[1] == "0.250000"


def test_evidence_is_a_product_of_predictives():
    """The probability of a matrix is that of its rows one by one, whatever their order."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3))
    prior = (np.zeros(3), np.eye(3), 0.1, 5.0)
    one = hdp.predictive(x[:1], *prior)[0] + sum(hdp.predictive(x[i : i + 1], *hdp.dish_parameters(x[:i], *prior))[0] for i in range(1, 6))
    assert hdp.log_evidence(x, *prior) == pytest.approx(one) and hdp.log_evidence(x[::-1], *prior) == pytest.approx(one)
    assert hdp.log_predictive(x[4:], x[:4], prior) == pytest.approx(hdp.log_evidence(x, *prior) - hdp.log_evidence(x[:4], *prior))
    assert hdp.log_probability([x[:3], x[3:]], prior)[0] == pytest.approx(hdp.log_evidence(x[:3], *prior) + hdp.log_evidence(x[3:], *prior))


def test_mixing_moves_towards_dishes(spark):
    prior = (np.zeros(2), np.eye(2), 0.1, 4.0)
    dish = hdp.dish_parameters(np.array([[4.0, 4.0], [4.2, 3.8], [3.8, 4.2]]), *prior)
    rows = spark.createDataFrame([(1, 1, [3.0, 3.0])], "profile_id long, pos int, cv array<double>")
    r = hdp.profile_memberships(rows, [dish], [3.0], prior, top=1, mix=0.5).first()
    assert r.dish == [0] and all(3.0 < v < 4.0 for v in r.mixed)


def test_from_alignments_to_hits(spark, tmp_path):
    """Files in, ranked hits out: related alignments find one another, others stay below the threshold."""
    from seqlake.operators import construct

    rng = np.random.default_rng(11)
    letters = list("ARNDCQEGHILKMFPSTWYV")
    families = [rng.choice(letters, 50) for _ in range(3)]

    def alignment(base, n, seed):
        own = np.random.default_rng(seed)
        rows = []
        for _ in range(n):
            row = base.copy()
            at = own.random(50) < 0.25
            row[at] = own.choice(letters, at.sum())
            rows.append("".join(row))
        return "".join(f">s{i}\n{r}\n" for i, r in enumerate(rows))

    for i, base in enumerate(families):
        (tmp_path / f"db{i}.fa").write_text(alignment(base, 12, i))
    (tmp_path / "query.fa").write_text(alignment(families[1], 8, 99))
    queries = formats.alignments(spark, str(tmp_path / "query.fa"))
    database = formats.alignments(spark, [str(tmp_path / f"db{i}.fa") for i in range(3)])
    got = construct.search_alignments(queries, database, cutoff=10.0, low_complexity=False).orderBy("rank").collect()
    assert got[0].query_name == "query.fa" and got[0].target_name == "db1.fa" and got[0].evalue < 1e-3
    assert got[0].q_aln.replace("-", "") in "".join(r.residues for r in queries.filter("seq_id = 0").collect()) and got[0].n_ident > 20
