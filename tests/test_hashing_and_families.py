import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.config import Config
from simloom.functions import hashing
from simloom.operators.families import AngleFamily, PrecalculatedFamily, PStableFamily, make_family, save_family, scrambled, scrambled_planes


def both_keys(spark, family, rows):
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "vector_id long, values array<double>")
    fast = {r.vector_id: list(r.keys) for r in family.with_keys(df).collect()}
    slow = {r.vector_id: list(r.keys) for r in df.withColumn("keys", family.expression_keys(F.col("values"))).collect()}
    assert fast == slow
    return fast


def test_pstable_golden_values(spark):
    one = PStableFamily(np.ones((1, 1, 3)), [[10]], [[3]])
    assert both_keys(spark, one, [[1, 1, 1]]) == {0: [923525]}
    two = PStableFamily(np.array([[[1, 1, 1], [2, 2, 2]]]), [[10, 10]], [[3, 3]])
    assert both_keys(spark, two, [[1, 1, 1]]) == {0: [-1803760374]}


def test_angle_keys_are_left_aligned(spark):
    assert both_keys(spark, AngleFamily(np.ones((1, 1, 3))), [[1, 1, 1], [-1, -1, -1], [0, 0, 0]]) == {0: [-2147483648], 1: [0], 2: [0]}
    assert both_keys(spark, AngleFamily(np.array([[[1, 1, 1], [2, 2, 2]]])), [[1, 1, 1]]) == {0: [-1073741824]}


def test_trunc_and_floor_differ_below_zero(spark):
    for rounding, bucket in (("trunc", 0), ("floor", -1)):
        family = PStableFamily(np.ones((1, 1, 1)), [[0]], [[2]], rounding)
        assert family.buckets(np.array([[-1.0]])).item() == bucket
        both_keys(spark, family, [[-1.0], [5.0]])


@pytest.mark.parametrize("name", ["angle", "pStable", "precalculated"])
def test_generated_families_agree_with_expressions(spark, name):
    family = make_family(Config(family=name, tables=3, chain_length=4, dim=8, family_size=5, w=2))
    rows = np.random.default_rng(1).normal(size=(40, 8))
    assert all(len(k) == 3 for k in both_keys(spark, family, rows).values())


def test_missing_and_short_vectors_have_no_keys(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 2.0])], "vector_id long, values array<double>")
    got = {r.vector_id: r.keys for r in AngleFamily(np.ones((2, 1, 2))).with_keys(df).collect()}
    assert got[1] is None and got[2] is None and len(got[3]) == 2
    assert AngleFamily(np.ones((2, 1, 2))).with_keys(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["angle", "pStable"])
def test_families_survive_their_files(spark, tmp_path, name):
    config = Config(family=name, tables=3, chain_length=3, dim=4, family_size=6)
    family = make_family(config)
    save_family(spark, family, str(tmp_path / "f"))
    from dataclasses import replace

    back = make_family(replace(config, method="fromfile", family_file=str(tmp_path / "f") + "/*.txt"), spark)
    x = np.random.default_rng(2).normal(size=(20, 4))
    assert (back.keys(x) == family.keys(x)).all()


def test_precalculated_lines_and_legacy():
    halves = AngleFamily(scrambled_planes(3, 2, 4))
    family = PrecalculatedFamily(halves, [[0, 1], [2, 2]])
    back = PrecalculatedFamily.from_lines(family.lines(), halves.lines(), 2, 2)
    x = np.random.default_rng(3).normal(size=(9, 4))
    assert (back.keys(x) == family.keys(x)).all()
    short = halves.keys(x).view(np.uint32) >> 30
    assert ((family.keys(x).view(np.uint32) >> 28)[:, 0] == (short[:, 0] << 2 | short[:, 1])).all()
    legacy = PrecalculatedFamily(halves, [[0, 1]], legacy=True)
    assert (legacy.keys(x)[:, 0] == halves.keys(x)[:, 1]).all()
    with pytest.raises(ValueError):
        PrecalculatedFamily.from_lines(family.lines(), halves.lines(), 2, 3)


def test_uneven_files_and_unknown_names_are_errors():
    with pytest.raises(ValueError):
        AngleFamily.from_lines(["(0,2,[0,1],[1.0,2.0])"] * 3, 2)
    for wrong in ({"family": "x"}, {"method": "x"}, {"method": "fromfile"}, {"chain_length": 33}, {"family": "precalculated", "chain_length": 3}, {"tables": 0}):
        with pytest.raises(ValueError):
            Config(**wrong)
    with pytest.raises(ValueError):
        Config.from_mapping({"nothing": "1"})
    assert Config.from_mapping({"tables": "3", "threshold": "0.5", "normalize": "true"}) == Config(tables=3, threshold=0.5, normalize=True)


def test_scramble_matches_numpy(spark):
    x = [0, 1, 5, 123456789, 2**31 - 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x long").select(hashing.scramble(F.col("x"))).collect()]
    assert got == scrambled(np.array(x)).tolist()


def test_signed_scramble_matches_a_plain_loop(spark):
    def signed(x):
        return (x + 2**31) % 2**32 - 2**31

    def plain(x):
        for _ in range(2):
            x = signed(((x >> 16) ^ x) * 0x45D9F3B)
        return (x >> 16) ^ x

    x = [-5, -1, 0, 1, 77, 2**31 - 1, -(2**31), 123456789]
    got = [r.h for r in spark.createDataFrame([(v,) for v in x], "x int").select(hashing.scramble_signed(F.col("x")).alias("h")).collect()]
    assert got == [plain(v) for v in x]
