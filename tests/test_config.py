import pytest

from rolloom.config import PRESETS, RunConfig, strict
from rolloom.functions.arrays import threshold


def test_strict_keys():
    good = {"name": "r", "dataset": "d", "num_samples": 4, "metrics": {"expected_group_size": 4, "pass_at": (1, 4)}}
    assert strict(RunConfig, good).metrics.pass_at == (1, 4)
    with pytest.raises(ValueError, match="unknown keys x"):
        strict(RunConfig, good | {"x": 1})
    with pytest.raises(ValueError, match="missing keys dataset"):
        strict(RunConfig, {k: v for k, v in good.items() if k != "dataset"})
    with pytest.raises(ValueError):
        strict(RunConfig, good | {"num_samples": 2})


def test_thresholds():
    assert threshold("0.5_5") == (0.5, 5.0) and threshold(2.0) == (0.5, 2.0)
    for bad in (True, "x", -1.0):
        with pytest.raises((TypeError, ValueError)):
            threshold(bad)
    assert all(p.threshold is None or threshold(p.threshold) for p in PRESETS.values())
