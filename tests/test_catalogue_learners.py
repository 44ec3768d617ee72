"""The catalogue's training queries fit the learners at their full settings, and do all their fits in one call."""

import pytest

from kerbside.catalogue import queries
from kerbside.catalogue import views as V
from kerbside.plans import learners, training
from kerbside.plans.learners import GBT, HIST_GBT

SF = "/root/testdata/sf0.001"
#: Fits that are submitted together: settings, regularised or not, and how many.
WANTED = {
    "train_gbt": [(GBT, "all", 1)], "train_hist_gbt": [(HIST_GBT, "0.5", 1)], "train_horizon": [(GBT, "all", 1)],
    "train_one_horizon": [(GBT, "all", 1)], "train_all_horizons": [(GBT, "all", 3)], "horizon_predictions": [(GBT, "all", 1)],
    "run_predictions": [(GBT, "all", 3)], "refresh_job": [(GBT, "all", 3)], "ablation_calendar": [(HIST_GBT, "0.5", 3)],
    "ablation_weather": [(HIST_GBT, "0.5", 2)], "ablation_road": [(GBT, "all", 2)], "ablation_events": [(GBT, "all", 2)],
    "ablation_all": [(GBT, "all", 6)], "model_comparison": [(HIST_GBT, "0.5", 1), (GBT, "all", 1)], "train_report": [(HIST_GBT, "0.5", 1)],
}


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", sorted(WANTED))
def test_settings(spark, monkeypatch, name):
    def fit_all(train, fits, *rest, **more):
        kinds = [(f.settings, f.per_split) for f in fits]
        raise Seen([(*kind, kinds.count(kind)) for kind in dict.fromkeys(kinds)])

    monkeypatch.setattr(learners, "fit_all", fit_all)
    monkeypatch.setattr(training, "fit_all", fit_all)
    monkeypatch.setattr(queries, "comparison_dataset", lambda spark, sf: V.obs(spark, sf))
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, SF)
    assert seen.value.args[0] == WANTED[name]
