"""The gate of a batch, of a run or of a stream: every document is told its language where it is, not in one cell."""

from docspark import inputs
from docspark.operators import quality
from docspark.plans.ingestion import submissions
from docspark.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_gate_deals_no_text_to_one_cell(spark):
    model = quality.train_language_model(inputs.table(spark, SF, "documents"))
    plan = ingest.gate(submissions(spark, SF), spark.createDataFrame([], ingest.KEYS), model)._jdf.queryExecution().executedPlan().toString()
    assert "cell_row" not in plan and "cell_col" not in plan
