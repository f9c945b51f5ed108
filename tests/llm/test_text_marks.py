"""What the near-copy stage reads of a text."""

from pyspark.sql import functions as F

from lecturelab.llm import neardup
from lecturelab.llm.common import table

SF = "/root/testdata/sf0.001"


def test_marks_are_those_of_the_single_functions_and_take_one_worker(spark):
    own = spark.createDataFrame([("",), (None,), (" A  b\n",), ("a B",), ("é \u00a0x y z w v",)], "text string")
    docs = own.unionByName(table(spark, SF, "documents").select("text").limit(60))
    marks = docs.select("text", neardup.text_marks(F.col("text")).alias("_m")).select("text", "_m.*")
    single = [neardup.words_hash(F.col("text")).alias("fp2"), neardup.text_bands(F.col("text")).alias("bands2"), neardup.fingerprint(F.col("text")).alias("sim2")]
    for r in marks.select("*", *single).collect():
        assert (r["fp"], r["bands"], r["sim"]) == (r["fp2"], r["bands2"], r["sim2"])
    one = table(spark, SF, "documents").select(neardup.text_marks(F.col("text")).alias("_m")).select("_m.*")
    assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
