"""Run logs: limits, shifts and tables against NumPy, and what is written against what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.operators import kernels, logs
from lumastack.operators.report import SPECS


def images():
    y, x = np.mgrid[:48, :48]
    blob = lambda dx, dy, a: a * np.exp(-((x - 24 - dx) ** 2 + (y - 22 - dy) ** 2) / 90.0)
    one = {"R": blob(0, 0, 0.9), "G": blob(2, -1, 0.7), "B": blob(-1.5, 0.5, 0.5), "IR": blob(0.5, 0.5, 0.8), "CH4": blob(0, 3, 0.3)}
    return {1: one, 2: {k: one[k] for k in "RGB"}, 3: {"R": one["R"]}}


def channels(spark):
    rows = [(g, f, 48, 48, a.ravel().tolist()) for g, own in images().items() for f, a in own.items()]
    return spark.createDataFrame(rows, "g int, filter string, h int, w int, px array<double>").withColumn("name", F.lit("x")).drop("name").repartition(3)


def whole(group):
    return [n for n, roles in SPECS.items() if set(roles.values()) <= set(images()[group])]


def test_references():
    assert [logs.reference_of(n) for n in ("RGB", "IR-RGB", "CH4-G-IR")] == ["R", "IR", "IR"]


@pytest.mark.parametrize("most", [20.0, 1.0])
def test_shifts_are_against_each_composites_reference(spark, most):
    got = {(r["g"], r["name"], r["filter"]): (r["dx"], r["dy"]) for r in logs.composite_shifts(channels(spark), "g", most).collect()}
    want = {}
    for g in images():
        for name in whole(g):
            ref = logs.reference_of(name)
            for f in set(SPECS[name].values()) - {ref}:
                s = kernels.phase_shift(images()[g][ref], images()[g][f][None])[0, :2]
                want[g, name, f] = (0.0, 0.0) if np.abs(s).max() > most else tuple(s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("mode", ["joint", "independent", "none"])
def test_limits(spark, mode):
    got = {(r["g"], r["name"], r["filter"]): r for r in logs.stretch_limits(channels(spark), "g", mode, 0.01, 0.99).collect()}
    assert {k[:2] for k in got} == {(g, n) for g in images() for n in whole(g)}
    for (g, name, f), r in got.items():
        roles = SPECS[name]
        own = images()[g][f].ravel() if mode == "independent" or roles.get("L") == f else np.concatenate([images()[g][k].ravel() for r_, k in roles.items() if r_ != "L"])
        assert r["mode"] == ("independent" if mode == "joint" and roles.get("L") == f else mode)
        assert (r["plow"], r["phigh"]) == (None, None) if mode == "none" else np.allclose((r["plow"], r["phigh"]), np.quantile(own, (0.01, 0.99)))
    with pytest.raises(ValueError, match="no stretch mode"):
        logs.stretch_limits(channels(spark), "g", "moon", 0.0, 1.0)


def test_log_is_written_and_read_back(spark, tmp_path):
    c = channels(spark)
    gains = spark.createDataFrame([(1, "RGB", 1.23456), (1, "IR-RGB", None)], "g int, name string, gain double")
    log = logs.composite_log(logs.stretch_limits(c, "g", "none", 0.01, 0.99), logs.composite_shifts(c, "g"), gains, "g", "none")
    logs.write_log(log, str(tmp_path / "log"), "g")
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("g=")) == ["g=1", "g=2"]
    back = logs.read_log(spark, str(tmp_path / "log"), "g int", logs.COMPOSITE)
    rows = {(r["g"], r["name"]): r.asDict(recursive=True) for r in back.collect()}
    assert rows == {(r["g"], r["name"]): r.asDict(recursive=True) for r in log.collect()} and len(rows) == 4
    one = rows[1, "IR-RGB"]
    assert one["type"] == "LRGB" and one["saturation_gain"] is None and one["channels"] == {"L": "IR", "R": "R", "G": "G", "B": "B"} and one["alignment"]["IR"] == [0.0, 0.0]
    assert rows[1, "RGB"]["saturation_gain"] == 1.2346 and rows[2, "RGB"]["stretch"]["G"] == {"mode": "none", "plow": None, "phigh": None}


def test_role_table(spark):
    log = spark.createDataFrame([(1, "RGB", {"R": [0.0, 0.0], "G": [0.04, -0.049], "B": [0.26, -1.0]}, 1.5), (1, "IR-RGB", {"IR": [0.0, 0.0], "R": [0.0, 0.05]}, None)], "g int, name string, alignment map<string,array<double>>, saturation_gain double")
    got = {r["filter"]: (r["RGB"], r["IR-RGB"], r["CH4-G-IR"]) for r in logs.role_table(log, "g").collect()}
    assert got == {"R": ("[R] ref", "[R] +0.0,+0.1", "—"), "G": ("[G] ref", "[G] ref", "—"), "B": ("[B] +0.3,-1.0", "[B] ref", "—"), "IR": ("—", "[L] ref", "—"), "Sat": ("1.50×", "—", "—")}
    assert logs.role_table(log.limit(0), "g").count() == 0


def test_stats_beside_the_stack_log(spark):
    scores = spark.createDataFrame([(1, "R", 0.5, True), (1, "R", 0.7, True), (1, "R", 0.1, False), (2, "R", 0.0, True), (3, "R", 0.2, False)], "g int, filter string, score double, included boolean")
    log = spark.createDataFrame([(1, "R", 2), (9, "R", 5)], "g int, filter string, n_stacked long")
    got = {r["g"]: r for r in logs.stack_stats(scores, log, ["g", "filter"]).collect()}
    assert (got[1]["n_included"], got[1]["n_total"], got[1]["n_stacked"]) == (2, 3, 2) and abs(got[1]["stability"] - 1 / (1 + 0.1 / 0.6)) < 1e-12
    assert got[2]["stability"] == 0.5 and got[2]["n_stacked"] is None and got[3]["n_included"] == 0 and got[3]["quality_post"] is None
