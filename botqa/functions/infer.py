"""U-01: pluggable batch inference.

``infer(df, prompt_col, out_col, client_factory)`` sends the prompt column to
a model client in Arrow batches (``mapInPandas``) and returns the reply text
as a column.  ``client_factory`` is called once per task on the executor and
must return an object with ``complete(prompts: list[str]) -> list[str | None]``
(``None`` = the call failed: the reply stays null, like a failed request).
The HTTP/LLM call itself is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def infer(df: DataFrame, prompt_col: str, out_col: str, client_factory: Callable[[], object],
          batch_size: int = 20) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(it):
        client = client_factory()
        for pdf in it:
            prompts = pdf[prompt_col].tolist()
            replies: list = []
            for i in range(0, len(prompts), batch_size):
                replies.extend(client.complete(prompts[i:i + batch_size]))
            out = pdf.copy()
            out[out_col] = pd.Series(replies, index=pdf.index, dtype=object)
            yield out

    return df.mapInPandas(run, schema)
