"""Online clustering of a stream: the same fold as in batch, with live events as state.

A partition of the stream (by `key`, a region or a topic, say) is one timeline; events that the window has left behind
are forgotten. An article too late for any live event begins a new one, it is not dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyloom.functions.text import token_set
from skyloom.operators.cluster import WINDOW_HOURS, Fold

_EVENT = ("first_entities", "first_tokens", "entities", "tokens")
STATE = "n bigint, numbers array<bigint>, last array<bigint>, " + ", ".join(f"{f} array<array<string>>" for f in _EVENT)


def cluster_stream(articles: DataFrame, key: str = "key", window_hours: float = WINDOW_HOURS) -> DataFrame:
    """(key, id, cluster): the event of each article, numbered from 1 in each key.

    articles: a stream of key, id, published_at, title, content_text, entities. In a micro-batch articles are taken in
    the order (published_at, id), so the result is that of the batch fold if articles arrive in order.
    """
    tokens = token_set(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.left(F.coalesce("content_text", F.lit("")), F.lit(500))))
    entities = F.coalesce("entities", F.array().cast("array<string>"))
    rows = articles.select(F.col(key).alias("key"), "id", "published_at", entities.alias("entities"), tokens.alias("tokens"))
    span = dt.timedelta(hours=window_hours)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, n, numbers = Fold(span), 0, []
        if state.exists:
            n, numbers, last, *sets = state.get
            numbers = list(numbers)
            live.restore([dict(zip(_EVENT, (set(x) for x in own))) | {"last": pd.Timestamp(t, unit="us")} for t, *own in zip(last, *sets)])
        new = pd.concat(list(batches), ignore_index=True).sort_values(["published_at", "id"], kind="stable")
        out = []
        for id_, at, e, k in zip(new["id"], new["published_at"], new["entities"], new["tokens"]):
            i = live.add(pd.Timestamp(at), set(e), set(k))
            if i == len(numbers):
                n += 1
                numbers.append(n)
            out.append((group[0], id_, numbers[i]))
        horizon = new["published_at"].max() - span
        kept = [i for i, event in enumerate(live.events) if event["last"] >= horizon]
        events = [live.events[i] for i in kept]
        state.update((n, [numbers[i] for i in kept], [int(e["last"].timestamp() * 1_000_000) for e in events], *[[sorted(e[f]) for e in events] for f in _EVENT]))
        yield pd.DataFrame(out, columns=["key", "id", "cluster"])

    return rows.groupBy("key").applyInPandasWithState(fold, "key string, id bigint, cluster bigint", STATE, "append", GroupStateTimeout.NoTimeout)
