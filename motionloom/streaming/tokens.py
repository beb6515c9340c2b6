"""Changes of tokens on a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def token_changes(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, at, before, fingerprint: each time a track's token differs from the one before it.

    ``tokens``: keys, at, fingerprint as a stream. The state is the last token of each track and its
    time; rows of one batch are taken by ``at``, rows not after the last time are late and passed
    over. The first token of a track is no change.
    """
    keys = list(keys)
    names = [*keys, "at", "before", "fingerprint"]
    text = T.StringType()
    schema = T.StructType([*[tokens.schema[k] for k in keys], tokens.schema["at"], T.StructField("before", text), T.StructField("fingerprint", text)])
    kept = T.StructType([T.StructField("fingerprint", text), tokens.schema["at"]])

    def follow(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, since = state.get if state.exists else (None, None)
        known = state.exists
        rows = sorted(((at, token) for batch in batches for at, token in zip(batch["at"], batch["fingerprint"], strict=True)), key=lambda r: r[0])
        out = []
        for at, token in rows:
            if known and at <= since:
                continue
            if known and token != last:
                out.append((*key, at, last, token))
            last, since, known = token, at, True
        if known:
            state.update((last, since))
        yield pd.DataFrame(out, columns=names)

    return tokens.select(*keys, "at", "fingerprint").groupBy(*keys).applyInPandasWithState(follow, schema, kept, "append", "NoTimeout")
