from pyspark.sql import functions as F

from clausemill.functions import shape, text
from clausemill.sources import tables


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalization(spark):
    assert one(spark, text.join_spaced_letters, "see a b c d now") == "see abcd now"
    assert one(spark, text.dehyphenate, "agree-\n ment") == "agreement"
    assert one(spark, text.soft_line_break, "the\nbuyer") == "the buyer"
    assert one(spark, text.whitespace_canon, " a \n\n\n\n b c ") == "a\n\nb c"
    assert one(spark, text.glyph_normalize, "●  item") == " - item"
    assert one(spark, text.fold_diacritics, "délai ёй") == "delai еи"
    assert one(spark, text.html_to_text, "<p>a &amp; b</p><script>x</script>c") == "a & b\nc"
    assert one(spark, lambda c: text.unique_strings(F.split(c, ";")), "10; 21;10;12 ") == ["10", "21", "12"]
    assert one(spark, text.repeated_noise, "aaaaab") == 5


def test_shape(spark):
    assert one(spark, lambda c: shape.clause_ref(c, F.lit(4)), "2.3. Buyer pays") == "2.3"
    assert one(spark, lambda c: shape.clause_ref(c, F.lit(4)), "Section 7 applies") == "7"
    assert one(spark, lambda c: shape.clause_ref(c, F.lit(4)), "No number") == "5"
    assert one(spark, shape.trim_lead, "- 3) Text") == "Text"
    assert one(spark, shape.monetary_signal, "pay 12 percent") is True


def test_record_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "ru")], "doc_id long, language string")
    tables.report_sink(df, str(tmp_path / "out"))
    back = tables.record_scan(spark, str(tmp_path / "out"), "doc_id long")
    assert sorted(r.doc_id for r in back.collect()) == [1, 2]
