import numpy as np
import pytest

from tallyfold.llm import elias_fano as ef


@pytest.mark.parametrize("top", [5, 1000, 10**9, 2**52])
def test_sequences_round_trip_and_find(top):
    draw = np.random.default_rng(2)
    values = np.unique(draw.integers(0, top, 700)).astype(np.uint64)
    got = ef.EliasFano(ef.EliasFano.encode(values))
    assert (got.get(np.arange(len(values))) == values).all()
    asked = draw.integers(0, top, 500).astype(np.uint64)
    place = {int(v): i for i, v in enumerate(values)}
    assert got.find(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_ranges_of_contexts():
    keys = np.array([3 << ef.SUCCESSOR_BITS | 5, 3 << ef.SUCCESSOR_BITS | 9, 8 << ef.SUCCESSOR_BITS | 1], np.uint64)
    level = ef.TrieLevel(ef.TrieLevel.build(keys, np.array([4, 2, 7])))
    assert [level.range_of(c) for c in (3, 8, 5)] == [(0, 2), (2, 3), (0, 0)]
    assert level.look_up(np.append(keys, np.uint64(3 << ef.SUCCESSOR_BITS | 6))).tolist() == [4, 2, 7, 0]


def test_a_mapped_level(tmp_path):
    keys = np.arange(50, dtype=np.uint64) * np.uint64(3)
    (tmp_path / "level").write_bytes(ef.TrieLevel.build(keys, np.arange(50) + 1))
    assert ef.mapped(str(tmp_path / "level")).look_up(keys).tolist() == list(range(1, 51))
