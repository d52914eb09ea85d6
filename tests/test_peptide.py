from collections import Counter

import pytest
from pyspark.sql import functions as F

from ionframe.functions import peptide as p
from ionframe.functions.constants import MASS_TAGS


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head()[0]


def test_decoy_golden(spark):
    decoy = one(spark, F.array_join(p.reverse_decoy(p.residues(F.col("s"))), ""), s="PEPC(UniMod:4)TIDEK")
    assert decoy == "EDITC(UniMod:4)PEPK"


def test_decoy_keeps_composition_and_end(spark):
    s = "ACDM(UniMod:35)EFGHIK"
    tokens, decoy = one(spark, F.struct(p.residues(F.col("s")), p.reverse_decoy(p.residues(F.col("s")))), s=s)
    assert Counter(tokens) == Counter(decoy) and tokens[-1] == decoy[-1]


def test_tags_stay_in_place(spark):
    got = one(spark, F.array_join(p.reverse_decoy_tagged(p.residues(F.col("s")), "mTRAQ"), ""), s="P(mTRAQ-0)EC(UniMod:4)K(mTRAQ-0)")
    assert got == "C(UniMod:4)(mTRAQ-0)EPK(mTRAQ-0)"


def test_leading_modification_is_its_own_token(spark):
    assert one(spark, p.residues(F.col("s")), s="(UniMod:1)PEK") == ["(UniMod:1)", "P", "E", "K"]


def test_nested_brackets(spark):
    assert one(spark, p.residues(F.col("s")), s="M[Oxidation (M)]PK(Acetyl (K))") == ["M[Oxidation (M)]", "P", "K(Acetyl (K))"]


def test_fragment_names(spark):
    r = one(spark, p.split_fragment(F.col("n")), n="y7-H2O_2_iso3")
    assert tuple(r) == ("y", 7, "H2O", 2, 3)
    assert one(spark, p.from_bracket_charge(F.col("n")), n="y7(2+)") == "y7_2"
    assert one(spark, p.from_bracket_charge(F.col("n")), n="y7") == "y7_1"


def test_masses(spark):
    assert one(spark, p.peptide_mz(F.col("s"), F.lit(2)), s="PEPTIDEK") == pytest.approx(464.7347, abs=1e-3)
    y = p.fragment_mz(p.residues(F.col("s")), F.lit("y"), F.lit(2), F.lit(1), F.lit(None).cast("string"))
    assert one(spark, y, s="PEPTIDEK") == pytest.approx(276.1554, abs=1e-3)
    assert one(spark, p.token_mass(F.col("s")), s="C(UniMod:4)") == pytest.approx(160.030648, abs=1e-5)


def test_tag_shift_golden(spark):
    rows = spark.createDataFrame([("PEPTIDEK", 2, 464.7345, "b2_1", 227.1)], "mod_seq string, charge int, prec_mz double, name string, mz double")
    got = {r["channel"]: r for r in p.tag_library(rows, "mTRAQ").collect()}
    assert got["0"]["prec_mz"] - 464.7345 == pytest.approx(140.0949630177)
    assert got["4"]["prec_mz"] - 464.7345 == pytest.approx(144.1020624177)
    assert got["4"]["mz"] - 227.1 == pytest.approx(144.1020624177)
    assert set(got) == set(MASS_TAGS["mTRAQ"][2])


def test_digest(spark):
    got = one(spark, p.digest(F.col("s"), 1, 2, 50), s="MKRPAAKCC")
    assert sorted(got) == sorted(["MK", "RPAAK", "CC", "MKRPAAK", "RPAAKCC"])
    assert one(spark, p.digest(F.col("s")), s="") == []


def test_lists_round_trip(spark):
    assert one(spark, p.split_numbers(p.join_numbers(F.array(F.lit(1.5), F.lit(2.0)))), s=1) == [1.5, 2.0]
