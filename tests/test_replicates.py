"""The registered queries run as many replicates as the reference."""

import inspect
from types import SimpleNamespace

import pytest

from siftwell.operators import attribution, hypotheses, report, resample
from siftwell.plans import analysis


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    ("query", "module", "function", "argument", "wanted"),
    [
        ("profile_permutation", resample, "profile_shift", "replicates", 2000), ("reference_shift_test", hypotheses, "reference_shift", "replicates", 2000), ("trained_test", hypotheses, "trained_only", "replicates", 2000),
        ("agreement_test", hypotheses, "agreement_structure", "replicates", 5000), ("bootstrap_coefficients", resample, "bootstrap_counts", "replicates", 1000), ("share_intervals", attribution, "bootstrap_shares", "replicates", 1000),
        ("audit_estimates", report, "audit_estimate", "draws", 2000),
    ],
)
def test_replicates(spark, monkeypatch, query, module, function, argument, wanted):
    signature = inspect.signature(getattr(module, function))

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Reached(bound.arguments[argument])

    monkeypatch.setattr(module, function, stop)
    if query == "audit_estimates":
        monkeypatch.setattr(report, "fit_audit", lambda rows: {"D4": SimpleNamespace()})
    with pytest.raises(Reached) as said:
        getattr(analysis, query)(spark, "/root/testdata/sf0.001")
    assert said.value.args == (wanted,)
