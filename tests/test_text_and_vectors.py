import math

import pytest
from pyspark.sql import functions as F

from quaero.functions import text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, found",
    [
        ("劳动合同？", ["劳", "动", "合", "同"]),
        ("劳动ABC 3.5条é１２ x_y 1.2.3", ["劳", "动", "abc", "3.5", "条", "１２", "x", "y", "1.2", "3"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given, found):
    assert one(spark, text.tokens(F.lit(given).cast("string"))) == found


def test_match_key_folds_only_white_space(spark):
    assert one(spark, text.match_key(F.lit("  a\r\n　 b  "))) == "a b"
    assert one(spark, text.match_key(F.lit("第１条"))) != one(spark, text.match_key(F.lit("第一条")))
    assert one(spark, text.match_key(F.lit("a\\nb"))) == "a\\nb"
    assert one(spark, text.is_blank(F.lit(" 　 \n")))


@pytest.mark.parametrize("said, kind", [("CUDA: no memory", "cuda_oom"), ("Out of memory", "cuda_oom"), ("no bitsandbytes", "missing_bitsandbytes"), ("cuda", "ValueError"), (None, "ValueError")])
def test_error_class(spark, said, kind):
    assert one(spark, text.error_class(F.lit("ValueError"), F.lit(said).cast("string"))) == kind


def test_safe_name(spark):
    assert one(spark, text.safe_name(F.lit("a/b: c.json"))) == "a_b_c.json"


def test_pooling(spark):
    matrix = lambda *rows: F.array(*[F.array(*map(F.lit, map(float, r))) for r in rows])
    assert one(spark, vectors.first_pool(matrix([3, 4], [100, 100]))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.first_pool(matrix([0, 5], [100, 100]))) == pytest.approx([0, 1])
    mask = F.array(F.lit(1), F.lit(1))
    assert one(spark, vectors.mean_pool(matrix([3, 4], [100, 100]), mask)) == pytest.approx([51.5, 52])
    assert one(spark, vectors.mean_pool(matrix([0, 5], [100, 100]), F.array(F.lit(1), F.lit(0)))) == pytest.approx([0, 5])
    assert math.isfinite(one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))))[0])
