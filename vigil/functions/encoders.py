"""Text encoders that turn a text column into an ARRAY<FLOAT> embedding column.

* `hashed_embedding` -- built-in, JVM only: analysed tokens -> HashingTF -> L2 normalise.
* `pandas_encoder`  -- the pluggable hook for a learned sentence encoder: an iterator
  pandas UDF that loads the model once per Python worker and encodes Arrow batches of
  ``batch_size`` texts. The drift operators accept any ARRAY<FLOAT> column, so any encoder
  works with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import analyzed_tokens

DIM = 64


def hashed_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = DIM) -> DataFrame:
    toks = df.withColumn("__tok", analyzed_tokens(text_col))
    tf = HashingTF(numFeatures=dim, inputCol="__tok", outputCol="__tf").transform(toks)
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(tf)
    return unit.withColumn(out_col, vector_to_array("__unit", "float32")).drop("__tok", "__tf", "__unit")


_MODELS: dict[str, Callable] = {}


def pandas_encoder(load: Callable[[], Callable[[list[str]], "object"]], batch_size: int = 16) -> Callable[[Column], Column]:
    """Wrap ``load() -> encode(list[str]) -> 2-D array`` as a column function.

    ``load`` runs once per Python worker process (cached by its qualified name), never per
    row or per batch."""
    key = f"{getattr(load, '__module__', '')}.{getattr(load, '__qualname__', repr(load))}"

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODELS:
            _MODELS[key] = load()
        model = _MODELS[key]
        for texts in batches:
            items = texts.fillna("").tolist()
            out = []
            for i in range(0, len(items), batch_size):
                out.extend([list(map(float, v)) for v in model(items[i : i + batch_size])])
            yield pd.Series(out)

    return encode
