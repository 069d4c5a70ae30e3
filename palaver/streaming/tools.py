"""The state of tool calls on a stream of log events, by the rule of the batch merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from palaver.operators.merge import tool_states


def stream_tool_state(stream: DataFrame, key: Sequence[str] = ("session_id", "message_id", "call_id")) -> DataFrame:
    """A changelog for update mode: ``tool_states`` of every call that a micro-batch touched.

    The row of a call with the greatest n_observations is what the batch merge says of all observations so far, in
    whatever order they came. State is one row a call, however many observations it has. It is kept for good, since a
    contradiction may come at any time; with a column of a watermarked window in ``key`` Spark drops the
    state of windows that have passed.
    """
    return tool_states(stream, key)
