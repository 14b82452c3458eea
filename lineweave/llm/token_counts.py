"""Token counts per document by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.bpe import MEMO, Counter, kept, prove_whole_tokens, tokenizer_json
from lineweave.llm.common import small_batches


def token_counts(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, memo: int = MEMO) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    The driver proves once, through the tokenizer library, which vocabulary strings encode alone as
    one token (a set bounded by the vocabulary). Workers count those pre-tokens directly and merge
    only the others. No shuffle: one scan, one map.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated doc_ids pass through, a row
    each. Texts of any length are counted whole. Further columns of ``docs`` are not read.
    """
    spec = tokenizer_json(tokenizer)
    proven = prove_whole_tokens(spec)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(Counter, spec, proven, memo)
        for batch in batches:
            n = counter.column(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select("doc_id", "text", size.alias("n_bytes")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
