"""The guard over a stream of actions: the same rows as the batch replay, from keyed state of fixed size.

Actions of an instance have to arrive in the order of `ord`, across triggers; within one they are sorted here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("edit", "test", "diff", "submit", "small_read", "broad", "inspect", "other")
FINAL = KINDS[:4]


def guard_stream(actions: DataFrame, interval: int = 10, grace: int = 5) -> DataFrame:
    """instance, ord, step, notice, tool_step, blocked. actions: (instance, ord, kind, located), a streaming table; other kinds count as `other`."""
    types = dict(actions.dtypes)

    def replay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, known, looked, *tools = state.get if state.exists else (0, False, 0, *[0] * len(KINDS))
        out = []
        for ord_, kind, located in pd.concat(list(batches)).sort_values("ord")[["ord", "kind", "located"]].itertuples(index=False):
            step += 1
            final, which = kind in FINAL, KINDS.index(kind) if kind in KINDS else len(KINDS) - 1
            late = (step >= 45 and not final) or (step >= 40 and not final and kind != "small_read") or (step >= 30 and kind == "broad")
            looks = known and not final and not late
            notice = step in (30, 40, 57) or (step >= 45 and (step - 45) % interval == 0)
            out.append((key[0], ord_, step, notice, tools[which], late or (looks and looked >= grace)))
            looked, known = looked + looks, known or bool(located)
            tools[which] += 1
        state.update((step, known, looked, *tools))
        yield pd.DataFrame(out, columns=["instance", "ord", "step", "notice", "tool_step", "blocked"])

    result = f"instance {types['instance']}, ord {types['ord']}, step int, notice boolean, tool_step int, blocked boolean"
    kept = "step int, known boolean, looked int, " + ", ".join(f"{k} int" for k in KINDS)
    return actions.groupBy("instance").applyInPandasWithState(replay, result, kept, "append", GroupStateTimeout.NoTimeout)
