"""Queries on pairs of profiles cut into blocks, and long pairs row by row."""

import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlake.operators import alignment as al
from seqlake.operators import pairs, scoring, search
from seqlake.plans import pairs as plans
from seqlake.plans import queries, registry


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


def in_blocks(spark, sf_dir, monkeypatch, name):
    """The query's rows with blocks far smaller than the profiles, none of which reaches a worker whole."""
    monkeypatch.setattr(pairs, "BLOCK", 16)
    seen = []
    blocks = pairs.blocks
    monkeypatch.setattr(pairs, "blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    mine = registry.queries()[name](spark, sf_dir).toPandas()
    assert seen and seen[0].agg({"len": "max"}).first()[0] == 16
    return mine


def same_as_sql(spark, sf_dir, monkeypatch, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    theirs = con.execute(registry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(tidy(in_blocks(spark, sf_dir, monkeypatch, name)), tidy(theirs), check_dtype=False, rtol=1e-9, atol=1e-6)


def test_e5_base_scores(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "e5_base_scores")


def test_j8_best_cells(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "j8_best_cells")


def test_h9_histogram(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "h9_histogram")


def test_h10_masked_histogram(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "h10_masked_histogram")


def test_h13_statistics(spark, sf_dir, monkeypatch):
    whole = registry.queries()["h13_statistics"](spark, sf_dir).toPandas()
    pd.testing.assert_frame_equal(tidy(in_blocks(spark, sf_dir, monkeypatch, "h13_statistics")), tidy(whole), rtol=1e-9, atol=1e-5)


def test_h12_expected(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "h12_expected")


def test_h19_scaling(spark, sf_dir, monkeypatch):
    whole = registry.queries()["h19_scaling"](spark, sf_dir).toPandas()
    pd.testing.assert_frame_equal(tidy(in_blocks(spark, sf_dir, monkeypatch, "h19_scaling")), tidy(whole), rtol=1e-9, atol=1e-5)


def test_g20_segment_pairs(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "g20_segment_pairs")


def test_e11_context_scores(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "e11_context_scores")


def test_e13_cluster_scores(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "e13_cluster_scores")


def test_e9_ss_scores(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "e9_ss_scores")


def test_e16_fused_scores(spark, sf_dir, monkeypatch):
    same_as_sql(spark, sf_dir, monkeypatch, "e16_fused_scores")


def made_profile(rng, n: int, number: int) -> dict:
    step = np.log(rng.uniform(0.05, 0.9, (n + 1, 9)))
    cv = rng.normal(size=(n, 19))
    return {
        "id": number, "len": n, "residues": "".join(rng.choice(list("ARNDCQEGHILKMFPSTWYVX"), n)), "trg": rng.dirichlet(np.ones(20) * 0.3, n), "bkg": np.full(20, 0.05), "trn": step, "eno": 5.0,
        "ss": rng.dirichlet(np.ones(3), n), "cv": cv, "norm2": (cv**2).sum(axis=1), "prior": rng.normal(size=n) - 20, "cluster": rng.integers(0, 12, n), "cluster_p": rng.uniform(0.2, 1, n),
    }


#: The searches and what each adds to the base score.
SEARCHES = {"g3_search": scoring.Terms(), "h26_combined_evalues": scoring.Terms(realign=False), "g3_full_search": plans.TERMS}


@pytest.mark.parametrize("name", SEARCHES)
def test_long_pairs_give_the_same_hit(monkeypatch, name):
    rng = np.random.default_rng(len(name))
    for m, n in ((1, 1), (1, 90), (90, 1), (65, 130), (130, 65), (150, 150)):
        q, t = made_profile(rng, m, 1), made_profile(rng, n, 2)
        t["trg"][: min(m, n)] = q["trg"][: min(m, n)]
        whole = search.batch_hits(q, [t], 0.0, SEARCHES[name])
        monkeypatch.setattr(search, "LONG_CELLS", 0)
        rows = search.batch_hits(q, [t], 0.0, SEARCHES[name])
        monkeypatch.undo()
        assert len(whole) == len(rows)
        for a, b in zip(whole, rows):
            assert all(x == pytest.approx(y, rel=1e-6, abs=1e-6) if isinstance(x, float) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("name", SEARCHES)
def test_long_pairs_hold_few_bytes_a_cell(monkeypatch, name):
    """Back pointers take a byte a cell; tables and scores are rows and strips."""
    rng = np.random.default_rng(3)
    q, t = made_profile(rng, 900, 1), made_profile(rng, 900, 2)
    monkeypatch.setattr(search, "LONG_CELLS", 0)
    tracemalloc.start()
    found = search.batch_hits(q, [t], 0.0, SEARCHES[name])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and most < 16 * 900 * 900


@pytest.mark.parametrize("strength", (1.0, 4.0))
def test_b13_posteriors_of_long_pairs_need_no_logarithms(strength):
    """Rows of scaled weights give the probabilities of whole tables, also where weights go far beyond a double."""
    rng = np.random.default_rng(7)
    for m, n, same in ((1, 1, False), (70, 260, False), (300, 130, False), (400, 400, True)):
        q, t = made_profile(rng, m, 1), made_profile(rng, n, 2)
        q["trn"][m // 3 :] = q["trn"][m // 3]
        if same:
            t["trg"] = q["trg"]
        for x in (q, t):  # nothing is inserted or deleted at the ends
            x["trn"][[0, -1]] = [0, -32768, -32768, 0, -32768, -32768, 0, -32768, -32768]
        s = scoring.score_matrices(q, t, scoring.Terms())[0] * strength
        rows = list(al._scaled_posteriors(lambda y0, y1: s[y0:y1].copy(), m, n, q["trn"], t["trn"]))
        whole = al.maximum_accuracy(s, q["trn"], t["trn"])[0]
        np.testing.assert_allclose(np.where(al.corners(m, n), 0.0, rows), whole, atol=1e-8)
    assert strength == 1.0 or al.local(s, q["trn"], t["trn"])[0] > 750  # the last pair's


def test_b13_posteriors_that_do_not_fit_go_by_logarithms(monkeypatch):
    rng = np.random.default_rng(8)
    q, t = made_profile(rng, 90, 1), made_profile(rng, 110, 2)
    t["trg"][:90] = q["trg"]
    t["trn"][50] = -32768.0  # no way past a column
    strip = lambda y0, y1: scoring.score_matrices(search._part(q, y0, y1), t, scoring.Terms())[0]
    with pytest.raises(al._OutOfRange):
        next(al._scaled_posteriors(strip, 90, 110, q["trn"], t["trn"]))
    path = al.accuracy_rows(strip, 90, 110, q["trn"], t["trn"])
    assert path and path == al.maximum_accuracy(strip(0, 90), q["trn"], t["trn"])[1]


def test_b13_long_pairs_are_dealt_out(spark, sf_dir, monkeypatch):
    """Pairs of a few long profiles reach more tasks than there are profiles, and each pair is there once."""
    own = queries.packed_profiles(spark, sf_dir)
    two = own.filter("profile_id < 2")
    whole = {tuple(r) for r in search.hits(own, two).select("query_id", "target_id", "score").collect()}
    monkeypatch.setattr(search, "LONG_CELLS", 0)
    rows = search.hits(own, two).select("query_id", "target_id", "score", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len(whole) and {r[:3] for r in rows} == whole
    assert len({r["task"] for r in rows}) > 2


def test_g3_full_search_state_scores_hold_one_matrix():
    """State scores are one product: no matrix for each pair of states, and the values of the cells one by one."""
    rng = np.random.default_rng(9)
    q, t = rng.dirichlet(np.ones(3), 400), rng.dirichlet(np.ones(3), 500)
    q[0], t[0], t[1] = (1, 0, 0), (0, 0, 1), (0, 1, 0)
    tracemalloc.start()
    made = scoring.ss_matrix(q, t, plans.GRID)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * made.nbytes
    for y, x in ((0, 0), (0, 1), (3, 7), (399, 499)):
        states = sum(q[y, a] * t[x, b] * plans.GRID[10 * a + int(9.999 * q[y, a]), 10 * b + int(9.999 * t[x, b])] for a in range(3) for b in range(3))
        assert made[y, x] == pytest.approx(0.12 * (states + (q[y, 2] + 0.1) * (t[x, 2] + 0.1) / 9 - 0.05), abs=1e-12)


def test_g3_full_search_steps_are_looked_up():
    keys, table = np.arange(-5, 88) / 2, np.arange(93.0)
    values = np.array([-1e9, -2.6, -2.5, -2.26, -2.25, -2.24, 0.0, 0.25, 0.75, 43.4, 43.5, 1e9])
    assert scoring.step_lookup(values, keys, table).tolist() == [0, 0, 0, 0, 1, 1, 5, 5, 7, 92, 92, 92]


def test_o1_multiple_alignment_searches_once(spark, sf_dir):
    """The hits are written before cells, columns and targets are made of them."""
    rows = registry.queries()["o1_multiple_alignment"](spark, sf_dir)
    assert "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    hits = queries.g3_search(spark, sf_dir).filter("aln_len > 0").toPandas()
    found = rows.toPandas().set_index(["query_id", "target_id"])["aligned"]
    assert len(found) == len(hits)
    for h in hits.itertuples():
        assert found[h.query_id, h.target_id].replace("-", "") == h.t_aln.replace("-", "")
