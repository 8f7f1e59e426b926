from pyspark.sql import functions as F

from geneloom.functions import columns as C


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def exon(a, b, s):
    return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("strand"))


def test_label_falls_back_on_empty_text(spark):
    names = F.create_map(F.lit("gene"), F.lit("abc"), F.lit("locus_tag"), F.lit("T1"))
    assert value(spark, C.label(names, F.lit("id"))) == "T1"
    assert value(spark, C.label(F.create_map(F.lit("protein_id"), F.lit("")), F.lit("id"))) == "id"
    assert value(spark, C.label(F.create_map(F.lit("x"), F.lit("y")), F.lit("id"))) == "id"


def test_first_values_keep_the_first(spark):
    q = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))))
    assert value(spark, C.first_values(q)) == {"a": "1", "b": "2"}


def test_sequences(spark):
    assert value(spark, C.reverse_complement(F.lit("ATGCNR"))) == "YNGCAT"
    assert value(spark, C.extract(F.lit("AACCGGTT"), F.array(exon(0, 2, 1), exon(4, 6, 1)))) == "AAGG"
    assert value(spark, C.extract(F.lit("AACCGGTT"), F.array(exon(6, 8, -1), exon(0, 2, -1)))) == "AATT"
    assert value(spark, C.translate_codons(F.lit("ATGTAANNNAT"))) == "M*X"
    assert value(spark, C.translate_codons(F.lit("AT"))) == ""


def test_decimals_round_as_exact_values(spark):
    for x in (0.125, 0.375, 1 / 3, 0.005, 1.0):
        assert value(spark, C.fixed_decimals(F.lit(x), 2)) == f"{x:.2f}"


def test_submap_and_ids(spark):
    m = F.create_map(F.lit("Gene"), F.lit("a"), F.lit("note"), F.lit("b"))
    assert value(spark, C.submap(m, ["gene"])) == {"Gene": "a"}
    assert value(spark, C.stable_id(F.lit("x"), F.lit(1))) == value(spark, C.stable_id(F.lit("x"), F.lit(1)))


def test_translation_of_a_long_text_is_linear(spark):
    import time

    began = time.perf_counter()
    rows = spark.createDataFrame([("acgu" * 150_000,)] * 4, "s string").select(C.translate_codons(F.col("s")).alias("p")).collect()
    assert {len(r["p"]) for r in rows} == {200_000} and rows[0]["p"][:4] == "TYVR" and time.perf_counter() - began < 120
