"""Draws that cover all sources, pass by pass, from a stream of requests: the order, the place in it and the pass are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajlake.functions.keyed import drawn
from trajlake.session import importable

#: What a stream of draws needs of its session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DRAWS = "shard long, request long, draw long, pass long, place long, source long, window long"
_LONG = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])


class Coverage(StatefulProcessor):
    """State of a shard: windows of each known source, the order of this pass, and how far it is drawn."""

    def __init__(self, seed: int):
        self.seed = seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", _LONG("source"), _LONG("windows"))
        self.order = handle.getListState("order", _LONG("source"))
        self.cursor = handle.getValueState("cursor", _LONG("turn", "place", "drawn"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        requests = []
        for r in rows:
            if r.source is None:
                requests.append((r.request, r.draws))
            else:
                self.known.updateValue((r.source,), (r.windows,))
        if not requests:
            return
        turn, place, drawn_ = self.cursor.get() if self.cursor.exists() else (-1, 0, 0)
        order = [s[0] for s in self.order.get()] if turn >= 0 else []
        held = {s[0]: w[0] for s, w in self.known.iterator()}
        begun = turn
        for request, draws in sorted(requests):
            for _ in range(draws):
                while True:
                    if place == len(order):
                        turn, place = turn + 1, 0
                        order = self.shuffled(held, turn)
                    source, place = order[place], place + 1
                    if held[source] > 0:
                        break
                window = drawn(self.seed, "window", turn, source) % held[source]
                yield Row(shard=key[0], request=request, draw=drawn_, **{"pass": turn}, place=place - 1, source=source, window=window)
                drawn_ += 1
        if turn != begun:
            self.order.put([(s,) for s in order])
        self.cursor.update((turn, place, drawn_))

    def shuffled(self, held: dict[int, int], turn: int) -> list[int]:
        """The order of a pass.  The first pass meets every source to learn which have a window; later ones have these only."""
        some = [s for s, w in held.items() if turn == 0 or w > 0]
        if not any(held[s] > 0 for s in some):
            raise ValueError("no source has a window")
        return sorted(some, key=lambda s: (drawn(self.seed, "pass", turn, s), s))


def shard_of(source: Column, shards: int, seed: int) -> Column:
    from trajlake.functions.keyed import draw

    return draw(seed, "shard", source) % shards


def draws(sources: DataFrame, requests: DataFrame, seed: int = 7) -> DataFrame:
    """DRAWS for a table or stream of requests (shard, request, draws: how many) from sources (shard, source, windows), which may be a stream
    too.  A shard gives its sources in a hashed order, one after another whatever the requests, and in another order when all had their
    turn; a source without windows gets no draw, one that comes late is drawn from the next pass on.  A restart from the checkpoint goes
    on at the same place.  What a task holds is one shard's sources: take as many shards as that asks for.  A session with streams needs
    STATE_STORE."""
    importable(sources.sparkSession)
    sources.sparkSession.streams.active  # noqa: B018 - starts what looks after state stores, which tables need too
    none = F.lit(None).cast("long")
    asked = requests.select("shard", "request", "draws", none.alias("source"), none.alias("windows"))
    both = sources.select("shard", none.alias("request"), none.alias("draws"), "source", F.col("windows").cast("long").alias("windows")).unionByName(asked)
    return both.groupBy("shard").transformWithState(Coverage(seed), DRAWS, "Append", "None")
