"""Model plans against numpy and plain loops."""

import numpy as np
import pytest

from tessera.functions import curves as V
from tessera.plans import models as M
from tessera.plans.catalog import QUERIES
from tessera.sources.tables import Tables


def test_spike_engine_equals_a_direct_fit(spark, sf):
    t = Tables(spark, sf)
    rows = M.enriched_weeks(t).toPandas()
    near = rows[rows.zone == 1]
    w = V.ridge_fit(near[list(M.SPIKE_FEATURES)].to_numpy(float), near["share"].to_numpy(float), 1.0)
    got = QUERIES["spike_engine"](spark, sf).toPandas()
    both = got.merge(rows.drop(columns=["share", "zone"]), on=["label", "week_end"])
    want = np.where(both.zone == 1, both[list(M.SPIKE_FEATURES)].to_numpy(float) @ w[:-1] + w[-1], both.base_share)
    assert len(both) == len(rows) and len(got) > len(rows) and np.abs(both["share"] - want).max() < 1e-6 and 0 < (both.zone == 1).sum() < len(both)


def test_seasonal_model_is_the_least_of_its_penalties(spark, sf):
    """The conditions of the minimum hold for every label: gradients are nothing, or of the size of the penalty where a rate changes, or less where it does not."""
    rows = M.share_rows(Tables(spark, sf)).toPandas().merge(QUERIES["share_seasonal"](spark, sf).toPandas(), on=["label", "week_end"])
    for _, g in rows.groupby("label"):
        g = g.sort_values("week_end")
        day, y = np.array([d.toordinal() for d in g.week_end], float), g["share"].to_numpy(float)
        w, fit, penalty = V.trend_fit(day, y)
        assert np.abs(fit - g.seasonal).max() < 1e-6
        scale, x = np.abs(y).max(), V.trend_terms(day, 2)
        slope = x.T @ (x @ w - y) / scale
        slope[-4:] += w[-4:] / scale * penalty.max() * V.CHANGE_SCALE / V.WAVE_SCALE**2
        changes = penalty > 0
        assert np.abs(slope[~changes]).max() < 1e-6
        assert (np.abs(slope[changes]) <= penalty[changes] + 1e-6).all()
        moved = changes & (np.abs(w) > 1e-9 * scale)
        assert np.abs(slope + penalty * np.sign(w))[moved].max(initial=0) < 1e-6


def test_a_bend_is_found():
    day = 730_000 + 7.0 * np.arange(300)
    t = (day - day[0]) / (day[-1] - day[0])
    y = 20 + 5 * t - 12 * np.maximum(t - 0.4, 0) + 2 * np.sin(2 * np.pi * day / 365.25)
    w, fit, penalty = V.trend_fit(day, y)
    assert np.abs(fit - y).max() < 0.2 and w[1] > 3 and w[2:27].sum() < -8
    straight = V.trend_fit(day, 3 + 2 * t)[0]
    assert np.abs(straight[2:27]).max() < 1e-6 and straight[:2] == pytest.approx([3, 2])
    assert len(V.trend_fit(np.array([1.0]), np.array([2.0]))[1]) == 1


def test_backfill_recovers_a_curve_and_goes_on_from_what_is_known():
    t = np.arange(1.0, 31)
    y = 1000 * V.gamma_curve(t, 3.0, 0.5)
    priors, sharpness = np.array([1.0, 0.0]), np.array([0.5, 1.5])
    assert np.allclose(V.backfill(y[:12], priors, sharpness, 0.0, 30), y, rtol=1e-6)
    noisy = y[:12] * (1 + 0.1 * np.sin(np.arange(12)))
    base, bull = (V.backfill(noisy, np.array([0.5, 0.5]), sharpness, 40.0, 60, m) for m in (1.0, 1.1))
    assert np.array_equal(base[:12], noisy) and np.array_equal(bull[:12], noisy) and len(base) == 60
    assert base[12:].min() >= 40 and base[12] < noisy[-1] and np.allclose(bull[12:] - 40, 1.1 * (base[12:] - 40))
    capped = V.backfill(np.array([100.0, 10.0]), priors, sharpness, 50.0, 20)
    assert capped[2:].min() >= 9.5 - 1e-9 and capped[2:].max() <= 10 + 1e-9  # the floor is at most 0.95 of the last known week
    assert np.array_equal(V.backfill(np.zeros(3), priors, sharpness, 0.0, 5), np.zeros(5))


def test_splice_goes_on_from_the_last_known_total():
    out = V.spliced(np.array([[4.0, 4], [2, 2], [1, 1], [1, 0]]), np.array([[9.0, 1], [3, 3]]))
    assert np.array_equal(out, [[9, 1], [3, 3], [1.5, 1.5], [1.5, 0]])


def test_component_curves_keep_what_is_known_and_add_up(spark, sf):
    got = QUERIES["component_curves"](spark, sf).toPandas()
    weeks = Tables(spark, sf).title_weeks.toPandas().sort_values(["title_id", "week_end"])
    weeks["week"] = weeks.groupby("title_id").cumcount() + 1
    both = got.merge(weeks, on=["title_id", "week"])
    assert np.abs(both.total - both.ae.astype(float)).max() < 1e-2 and np.abs(got.total - got.streams - got.sales - got.songs).max() < 1e-2
    assert got.groupby("title_id").week.max().sub(both.groupby("title_id").week.max()).eq(78).all()


def test_end_of_year_series_has_each_week_once(spark, sf):
    got = QUERIES["eoy_series"](spark, sf).toPandas()
    assert not got.duplicated(["title_id", "week_end"]).any() and set(got.source) == {"actual", "bridge", "autoregression"}
    first = got.groupby(["title_id", "source"]).week_end.min().unstack()
    assert (first["bridge"].dropna() > first["actual"][first["bridge"].notna()]).all() and (first["autoregression"].dropna() > first["bridge"].dropna()).all()


def test_archetypes_do_not_depend_on_the_run(spark, sf):
    one, two = (QUERIES["release_archetypes"](spark, sf).toPandas().set_index("title_id").cluster for _ in range(2))
    assert one.sort_index().equals(two.sort_index()) and set(one) == {0, 1, 2, 3}


def test_scorecard_of_a_smooth_title_is_small(spark, sf):
    got = QUERIES["floor_scorecard"](spark, sf).toPandas()
    assert (got.boundary_jump.dropna() >= 0).all() and (got.mape_late4.dropna() >= 0).all() and len(got) > 50


def test_typeahead_equals_a_scan(spark, sf):
    from difflib import SequenceMatcher

    names = {}
    for r in Tables(spark, sf).titles.select("title").collect():
        names[r["title"]] = names.get(r["title"], 0) + 1
    asked = "red wid"
    hits = [x for x in names if all(f" {w}" in f" {x.lower()}" for w in asked.split())] or [x for x in names if asked in x.lower()]
    overlap = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    scores = {x: max(SequenceMatcher(None, x.lower(), asked).ratio(), overlap(x.lower(), asked)) for x in hits}
    want = sorted((x for x in hits if scores[x] >= 0.3), key=lambda x: (-scores[x], -names[x], x))[:20]
    assert [r["title"] for r in QUERIES["typeahead_titles"](spark, sf).collect()] == want and want


def test_snapshot_holds_every_title_week_and_rate(spark, sf):
    import json

    t = Tables(spark, sf)
    rows = QUERIES["boot_snapshot"](spark, sf).collect()
    found = [x for r in rows if r["section"] == "releases" for x in json.loads(r["value"])]
    titles = {r["title_id"]: (r["title"], r["first_sale_date"]) for r in t.titles.collect()}
    assert {x["title_id"]: (x["title"], x.get("first_sale_date")) for x in found} == {k: (a, b and b.isoformat()) for k, (a, b) in titles.items()}
    assert sum(len(json.loads(r["value"])) for r in rows if r["section"] == "weekly") == t.panel.count()
    assert all({"rate", "as_of"} == set(json.loads(r["value"])) for r in rows if r["section"] == "rates")


def test_share_recurrence_step_by_step(spark, sf):
    got = {(r["label"], r["step"]): r["share"] for r in QUERIES["ar_share_forecast"](spark, sf).collect()}
    weeks = Tables(spark, sf).panel.select("label", "week_end", "share").toPandas().sort_values("week_end")
    for label, g in weeks.groupby("label"):
        y = g["share"].to_numpy(float)
        x = np.array([[y[i - 1], y[i - 2], y[i - 3], y[i - 4], 1.0] for i in range(4, len(y))])
        w = np.linalg.solve(x.T @ x + 1e-6 * np.eye(5), x.T @ y[4:])
        past = list(y)
        for step in range(1, 53):
            nxt = 0.5 * (w[:4] @ past[:-5:-1] + w[4]) + 0.5 * y[-8:].mean()
            past.append(min(max(nxt, 0.0), 1.0))
            assert got[label, step] == pytest.approx(past[-1], abs=1e-7)


def least_error(t, y):
    """The least squared error of a curve on a fine grid."""
    peak, a = np.meshgrid(np.linspace(1, 52, 205), np.geomspace(0.01, 3, 120))
    return ((V.gamma_curve(t[:, None, None], peak, a) - y[:, None, None]) ** 2).sum(0).min()


def assert_curves_fit(curves, mean):
    for r in curves.itertuples():
        g = mean[(mean[[c for c in mean.columns if c in ("category", "release_type")]] == [getattr(r, c) for c in mean.columns if c in ("category", "release_type")]).all(axis=1)]
        t, y = g.k.to_numpy(float), g.level.to_numpy(float) / g.level.max()
        assert ((V.gamma_curve(t, r.peak, r.sharpness) - y) ** 2).sum() <= 1.02 * least_error(t, y) + 1e-6


def test_curves_of_kinds_and_channels_have_the_least_error(spark, sf):
    t = Tables(spark, sf)
    kinds = t.titles.select("title_id", "release_type").toPandas()
    weeks = t.title_weeks.toPandas().merge(kinds).sort_values(["title_id", "week_end"])
    weeks["level"], weeks["k"] = weeks.ae.astype(float), weeks.groupby("title_id").cumcount() + 1
    mean = weeks[weeks.k <= 52].groupby(["release_type", "k"], as_index=False)["level"].mean()
    assert_curves_fit(QUERIES["gamma_curves"](spark, sf).toPandas(), mean)
    days = t.daily_fact.groupBy("category", "title_id", "week_end").agg({"ae": "sum"}).toPandas().merge(kinds).sort_values(["category", "title_id", "week_end"])
    days["level"], days["k"] = days["sum(ae)"].astype(float), days.groupby(["category", "title_id"]).cumcount() + 1
    mean = days[days.k <= 52].groupby(["category", "release_type", "k"], as_index=False)["level"].mean()
    got = QUERIES["metric_archetypes"](spark, sf).toPandas()
    assert len(got) == mean[["category", "release_type"]].drop_duplicates().shape[0]
    assert_curves_fit(got, mean)


def test_every_title_is_in_the_cluster_of_the_nearest_centre(spark, sf):
    from tessera.plans.forecast import shape_vectors

    x = shape_vectors(Tables(spark, sf)).toPandas().merge(QUERIES["kmeans_archetypes"](spark, sf).toPandas(), on="title_id").set_index("title_id")
    points, cluster = x[[f"w{k}" for k in range(1, 53)]].to_numpy(), x.cluster.to_numpy()
    centres = np.stack([points[cluster == c].mean(0) for c in range(4)])
    nearest = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
    assert (nearest == cluster).mean() > 0.95 and list(np.argsort(-centres[:, 0], kind="stable")) == [0, 1, 2, 3]


def test_forecasts_of_titles_as_queries(spark, sf):
    """What is known as it is, and the curve of each title's own weeks, priors and floor in three scenarios; when it reaches a volume in all."""
    t = Tables(spark, sf)
    names, sharpness = M.kinds(t)
    known = M.known_weeks(t, 8).toPandas()
    floors = {r["title_id"]: r["floor"] for r in M.peer_floors(t).collect()}
    got = QUERIES["backfill_forecast"](spark, sf).toPandas().set_index("title_id").sort_values("week")
    certified = QUERIES["backtest_certification"](spark, sf).toPandas().set_index("title_id")
    counts = t.titles.groupBy("artist", "release_type").count().toPandas()
    artists = {r["title_id"]: r["artist"] for r in t.titles.collect()}
    for title, g in known.groupby("title_id"):
        g = g.sort_values("k")
        y, mine = g.ae.to_numpy(float), counts[counts.artist == artists[title]].set_index("release_type")["count"]
        priors = np.array([float(mine.get(x, 0)) for x in names])
        for scenario, by in (("bear", 0.9), ("base", 1.0), ("bull", 1.1)):
            assert np.allclose(got.loc[title][scenario], V.backfill(y, priors, sharpness, floors[title], len(y) + 78, by), atol=1e-3)
        if len(y) >= 12:
            path = np.cumsum(V.backfill(y[:8], priors, sharpness, floors[title], len(y)))
            week = lambda total: int(np.argmax(total >= 500_000)) + 1 if total[-1] >= 500_000 else None
            r = certified.loc[title]
            for have, want in ((r.actual_week, week(np.cumsum(y))), (r.expected_week, week(path))):
                assert (have is None or have != have) if want is None else have == want


def test_tails_of_blends_are_between_those_of_archetypes(spark, sf):
    shapes = M.archetype_shapes()[1:]
    shapes = shapes / shapes.sum(0)
    x = M.first_weeks_of(Tables(spark, sf)).toPandas().merge(QUERIES["tail_blends"](spark, sf).toPandas(), on="title_id").merge(QUERIES["join_range_widening"](spark, sf).toPandas(), on="title_id")
    raw = M.archetype_shapes()[1:] @ x[["p0", "p1", "p2", "p3"]].to_numpy().T
    weights = raw / raw.sum(0)
    alpha, mass = np.clip(x.n / 4, 0, 1), x["mass"].to_numpy()
    first = np.clip(np.clip((1 - alpha) * mass * weights[0] + alpha * x.own, 1e-12, mass * 0.999) / mass, 1e-12, 0.999)
    assert len(x) > 100 and np.allclose(x.first_weight, first, atol=1e-7) and np.allclose(x.tenth_weight, weights[9] / (1 - weights[0]) * (1 - first), atol=1e-7)


def test_scenarios_share_a_fit_and_a_row_holds_a_title(spark, sf):
    """Fits of many series on one matrix equal single ones; a title's priors and floor stand beside its weeks once."""
    draw = np.random.default_rng(5)
    curves, sharpness = V.Curves((0.2, 0.5, 1.0)), np.array([0.2, 0.5, 1.0])
    for _ in range(20):
        y, priors = draw.gamma(2.0, 100.0, draw.integers(3, 30)), draw.uniform(0.1, 1, 3)
        basis = curves.basis(len(y), 2)
        assert np.allclose(basis.fit(y), V.nnls(basis.a, y), rtol=1e-9, atol=1e-9)
        for path, by in zip(V.backfills(y, priors, curves, 20.0, 60, (0.9, 1.0)), (0.9, 1.0)):
            assert np.allclose(path, V.backfill(y, priors, sharpness, 20.0, 60, by))
    t = Tables(spark, sf)
    names, _ = M.kinds(t)
    one, weeks = M.known_series(t, 8, names).collect(), M.known_weeks(t, 8).count()
    assert len({r["title_id"] for r in one}) == len(one) and sum(len(r["ae"]) for r in one) == weeks and all(len(r["mix"]) == len(names) for r in one)
