import brute
import pytest

from podium.plans import problems


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_found_as_brute_force(spark, data, n):
    got = [tuple(r) for r in getattr(problems, f"p{n}_found")(spark, data).collect()]
    assert len(got) == len(set(got))
    want = {tuple(int(x) if hasattr(x, "item") else x for x in r) for r in getattr(brute, f"p{n}")(data)}
    extra, lost = set(got) - want, want - set(got)
    assert not extra and not lost, (len(want), sorted(extra, key=str)[:5], sorted(lost, key=str)[:5])
