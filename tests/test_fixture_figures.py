"""Figures published with the stand-in view (FIXTURES.md section 3) reproduce exactly."""

import pytest

from exposcope.operators import eda, outliers
from exposcope.operators import timeseries as ts
from exposcope.sources.standin import exposure_clean, exposure_labeled, exposure_raw

FIGURES = {
    "/root/testdata/sf0.001": dict(rows=6000, classes=[55, 1390, 2835, 1397, 323], days=2289,
                                   spikes=62, offset_spikes=34, ports=61, paste=67),
    "/root/testdata/sf0.01": dict(rows=60000, classes=[625, 13807, 28062, 14521, 2985], days=2499,
                                  spikes=55, offset_spikes=0, ports=633, paste=696),
}


@pytest.mark.parametrize("sf", sorted(FIGURES))
def test_published_figures(spark, sf):
    f = FIGURES[sf]
    lab = exposure_labeled(spark, sf)
    dist = {r["risk_score"]: r["count"] for r in eda.risk_distribution(lab).collect()}
    assert [dist[i] for i in range(5)] == f["classes"]
    daily = ts.detect_spikes_offset(ts.detect_spikes(ts.daily_risk(lab)), 1.5).collect()
    assert len(daily) == f["days"]
    assert sum(r["is_spike"] for r in daily) == f["spikes"]
    assert sum(r["is_spike_offset"] for r in daily) == f["offset_spikes"]
    rep = {r["feature"]: r["iqr_outliers"] for r in outliers.outlier_report(
        exposure_clean(spark, sf), ["open_ports_count", "paste_site_mentions"],
        only_flagged=False).collect()}
    assert (rep["open_ports_count"], rep["paste_site_mentions"]) == (f["ports"], f["paste"])


def test_raw_view_figures(spark):
    raw = exposure_raw(spark, "/root/testdata/sf0.01").drop("_o")
    assert raw.count() == 60588
    assert raw.distinct().count() == 60000
    assert raw.filter("cvss_base_score IS NULL").count() == 630
