import pytest

from tracewise.operators import recurrent as R
from tracewise.operators.prefix import PREFIX, prefixes


@pytest.mark.parametrize("way", ["plain", "blocks", "segments"])
def test_equals_recurrence(spark, make_log, hot, monkeypatch, way):
    """One block, blocks of a few rows whose end is taken over, and the same with a case cut into segments."""
    import random

    rng = random.Random(4)
    rows = [(f"c{k}", i, "x", rng.choice([0.0, 1.0, -2.5, None])) for k, n in enumerate((60, 3, 1)) for i in range(n)]
    if way != "plain":
        monkeypatch.setattr(R, "REACH", 6)  # blocks of 19 rows for one decay, with weights down to a millionth
    if way == "segments":
        hot(7)
    log = prefixes(make_log(rows, extra="v double"))
    got = {(r.case_id, r[PREFIX]): (r["v~0.5"], r["v~0.9"]) for r in R.states(log, ["v"], (0.5, 0.9), 60 if way == "plain" else None).df.collect()}
    tolerance = 1e-12 if way == "plain" else 5 * 0.5 ** 19  # what older blocks weigh
    for case in ("c0", "c1", "c2"):
        half = tenth = 0.0
        for n, v in enumerate((r[3] or 0.0 for r in rows if r[0] == case), 1):
            half, tenth = 0.5 * half + v, 0.9 * tenth + v
            assert got[case, n] == (pytest.approx(half, abs=tolerance), pytest.approx(tenth, abs=1e-9))


def test_decays_are_checked(make_log):
    with pytest.raises(ValueError):
        R.states(prefixes(make_log([("a", 0, "x")])), [], (1.0,))
