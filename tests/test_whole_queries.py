"""Queries that once ran at less than the survey's size."""

import inspect
import os

import pytest

from telesift.jobs import detectors, fusion, queries

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name, module, function, want", [("d11_fusion", fusion, "boosted", {"trees": 200, "depth": 6}), ("d12_supervised", fusion, "boosted", {"trees": 300, "depth": 4, "rate": 0.05}), ("d13_evaluator", detectors, "calibrated", {"steps": 200})])
def test_survey_size(spark, monkeypatch, name, module, function, want):
    real = inspect.signature(getattr(module, function))

    def stop(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, SF)
    assert seen.value.args[0] == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["r1_scored_stream", "r2_flag_rate", "r3_sessions", "r4_local_z_stream"])
def test_streams_are_files(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.inputFiles() and out.count() > 0
