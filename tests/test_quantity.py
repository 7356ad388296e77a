"""Hand-computed element formulas."""

import pytest

from kerf.operators import quantity

COLUMNS = "etype string, subtype string, b double, h double, length double, area double, perimeter double, thickness double, treads int, risers int, run double, landing double, storey_height double, slab_thickness double, beam_depth double, net_slab boolean, storey_count int"
BASE = dict(subtype="", b=None, h=None, length=0.0, area=0.0, perimeter=0.0, thickness=None, treads=9, risers=10, run=2.7, landing=0.0, storey_height=3.0, slab_thickness=0.15, beam_depth=None, net_slab=False, storey_count=2)


@pytest.mark.parametrize(
    "row, concrete, formwork, multiplier, note",
    [
        (dict(etype="column", area=0.18, perimeter=1.8), 0.18 * 2.85, 1.8 * 2.85, 2, None),
        (dict(etype="column", area=0.18, perimeter=1.8, net_slab=True, beam_depth=0.5), 0.18 * 3.0, 1.8 * 2.5, 2, None),
        (dict(etype="shear_wall", area=0.5, length=2.0), 0.5 * 2.85, 4 * 2.85, 2, None),
        (dict(etype="beam", b=0.25, h=0.5, length=4.7), 0.25 * 0.35 * 4.7, 0.7 * 4.7, 2, None),
        (dict(etype="beam", b=0.25, h=0.5, length=4.7, net_slab=True), 0.25 * 0.5 * 4.7, 0.95 * 4.7, 2, None),
        (dict(etype="beam", b=0.25, length=4.0, beam_depth=0.45), 0.25 * 0.3 * 4.0, 0.6 * 4.0, 2, "beam_depth_assumed"),
        (dict(etype="beam", b=0.25, length=4.0), 0.0, 0.0, 2, "beam_section"),
        (dict(etype="slab", area=34.98), 34.98 * 0.15, 34.98, 2, None),
        (dict(etype="foundation", subtype="raft", area=42.0, perimeter=26.0, thickness=0.6), 25.2, 15.6, 1, None),
        (dict(etype="foundation", subtype="strip", b=0.6, h=0.8, length=4.0), 1.92, 6.4, 1, None),
        (dict(etype="foundation", subtype="raft", area=42.0), 0.0, 0.0, 1, "raft_thickness"),
        (dict(etype="stair", b=1.2, risers=4), 0.0, 0.0, 2, "stair_riser"),
        (dict(etype="parapet", b=0.2, length=3.0), 0.0, 0.0, 2, "section"),
    ],
)
def test_formulas(spark, row, concrete, formwork, multiplier, note):
    df = spark.createDataFrame([tuple({**BASE, **row}[c.split()[0]] for c in COLUMNS.split(", "))], COLUMNS)
    got = quantity.measure(df).first()
    assert got["concrete"] == pytest.approx(concrete)
    assert got["formwork"] == pytest.approx(formwork)
    assert got["multiplier"] == multiplier
    assert got["note"] == note
    assert got["rebar"] == pytest.approx(concrete * quantity.REBAR_RATIO[row["etype"]])


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 0.12, 10.0), (1, 0.15, 30.0), (1, 0.2, 5.0), (1, None, 99.0)], "p int, t double, w double")
    assert quantity.weighted_median(df, ["p"], "t", "w").first()["t"] == 0.15


def test_inclusion_rule(spark):
    df = spark.createDataFrame([(0.4, False, False), (0.39, False, False), (0.9, True, False), (0.1, False, True)], "confidence double, excluded boolean, manual boolean")
    assert quantity.included(df).count() == 2
