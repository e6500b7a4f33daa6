"""Rounds of deletion share one reading of the site, and come to what one round of all comes to."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from refscan.plans import cleanup
from refscan.plans.queries import deletable_ids
from refscan.sources import fixtures
from tests.conftest import DATA

NOW = 60


@pytest.fixture(scope="module")
def site(spark):
    """Posts have ids of attachments, too: what is gone holds nothing any more, in whichever round it went."""
    one = fixtures.site(spark, f"{DATA}/sf0.001")
    return replace(one, posts=one.posts.withColumn("id", F.col("id") - 999_999))


@pytest.fixture(scope="module")
def whole(site, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    tallies = list(cleanup.delete_unused(site, folder, deletable_ids(site), NOW, 1000))
    assert len(tallies) == 1
    return came_of(site, folder)


def came_of(site, folder):
    return sorted(map(tuple, cleanup.outcomes(site, folder).select(*cleanup.OUTCOMES.replace(" long", "").replace(" string", "").split(", ")).collect()))


@pytest.fixture
def clock(monkeypatch):
    """A clock that goes on by ten while the site's texts are read, and how often they are."""
    said = {"now": 0.0, "readings": 0}
    read = cleanup.references

    def references(*args):
        said["now"] += 10
        said["readings"] += 1
        return read(*args)

    monkeypatch.setattr(cleanup, "references", references)
    monkeypatch.setattr(cleanup, "monotonic", lambda: said["now"], raising=False)
    return said


def test_one_reading(site, whole, clock, tmp_path):
    tallies = list(cleanup.delete_unused(site, str(tmp_path), deletable_ids(site), NOW, 12))
    assert len(tallies) == -(-len(whole) // 12) > 5 and clock["readings"] == 1
    assert [sum(t.values()) for t in tallies[:-1]] == [12] * (len(tallies) - 1)
    assert came_of(site, str(tmp_path)) == whole


def test_stops_and_other_callers(site, whole, clock, tmp_path):
    """A pause that is longer than a reading, or a round of another caller: the next round reads again."""
    folder, may = str(tmp_path), deletable_ids(site)
    one = cleanup.delete_unused(site, folder, may, NOW, 12)
    next(one)
    next(one)
    clock["now"] += 9
    next(one)
    assert clock["readings"] == 1
    clock["now"] += 2
    next(one)
    assert clock["readings"] == 2
    assert sum(cleanup.delete_round(site, folder, may, NOW, 5).values()) == 5
    assert clock["readings"] == 3
    next(one)
    assert clock["readings"] == 4
    list(cleanup.delete_unused(site, folder, may, NOW, 20))
    assert clock["readings"] == 5
    assert list(one) == [] and clock["readings"] == 5
    assert came_of(site, folder) == whole
