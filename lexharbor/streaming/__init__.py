"""New documents scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexicon, segments


def follow(spark: SparkSession, path: str, schema, lex: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scores of documents in new Parquet files of ``path``, appended to ``out``; each document is whole within its file."""

    def put(batch: DataFrame, number: int) -> None:
        lexicon.score(lexicon.match(segments.tokens(batch), lex), ["doc_id"], batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
