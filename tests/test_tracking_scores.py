"""Tracking scores against published values and brute force."""

import itertools

import numpy as np
import pytest

from tracklake.operators import mot

SCHEMA = "match_id long, frame_id long, {} long, x1 double, y1 double, x2 double, y2 double"


def scenario(name):
    """Ten frames of two players, and what a tracker finds of them."""
    at = lambda k, f: (100.0 * k + f, 50.0, 100.0 * k + f + 40, 150.0)
    truth = [(f, k, *at(k, f)) for f in range(10) for k in (1, 2)]
    found = [(f, 3 - k if name == "idswitch" and f >= 5 else k, *b) for f, k, *b in truth if not (name == "missed" and k == 2 and f >= 3)]
    return truth, found + ([(f, 9, *at(7, f)) for f in range(10)] if name == "falsepos" else [])


@pytest.fixture(scope="module")
def scores(spark):
    names = ["perfect", "idswitch", "falsepos", "missed"]
    truth = [(k, *r) for k, n in enumerate(names) for r in scenario(n)[0]]
    found = [(k, *r) for k, n in enumerate(names) for r in scenario(n)[1]]
    t, f = spark.createDataFrame(truth, SCHEMA.format("truth_id")), spark.createDataFrame(found, SCHEMA.format("found_id"))
    return names, *({r.match_id: r for r in score(t, f, ["match_id"]).collect()} for score in (mot.hota, mot.clear, mot.identity_scores))


@pytest.mark.parametrize("name,hota,mota,idf1,switches,ass", [("perfect", 1.0, 1.0, 1.0, 0, 1.0), ("idswitch", 0.5774, 0.90, 0.5, 2, 0.3333), ("falsepos", 0.8165, 0.50, 0.8, 0, 1.0), ("missed", 0.7382, 0.65, 0.7879, 0, 0.8385)])
def test_published_scenarios(scores, name, hota, mota, idf1, switches, ass):
    names, h, c, i = scores
    k = names.index(name)
    assert (h[k].hota, c[k].mota, i[k].idf1, h[k].ass_a) == pytest.approx((hota, mota, idf1, ass), abs=1e-4) and c[k].id_switches == switches
    assert h[k].loc_a == pytest.approx(1.0) and c[k].motp == pytest.approx(1.0)


def test_assignment_against_all_permutations():
    rng = np.random.RandomState(4)
    for _ in range(200):
        n, m = (int(x) for x in rng.randint(1, 6, 2))
        score = rng.rand(n, m) * (rng.rand(n, m) < 0.7)
        small, big = min(n, m), max(n, m)
        s = score if n <= m else score.T
        best = max(sum(s[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        got = mot.assignment(score)
        assert sum(score[x] for x in got) == pytest.approx(best) and len({r for r, _ in got}) == len({c for _, c in got}) == len(got)


def test_nothing_found(spark):
    t = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 1.0, 1.0)], SCHEMA.format("truth_id"))
    f = spark.createDataFrame([], SCHEMA.format("found_id"))
    assert mot.hota(t, f, ["match_id"]).first().hota == 0 and mot.clear(t, f, ["match_id"]).first().misses == 1 and mot.identity_scores(t, f, ["match_id"]).first().idf1 == 0
