"""Filling containers of fixed capacity with texts, by vector best-fit.

A container has three capacities: tokens, documents, and attention cost. Attention over a container runs in square
tiles, so a text of n tokens costs the square of the tiles it touches, and a container can take the cost of one text
that fills it. Many short texts cost more tiles than tokens, so the limit binds where they gather. Texts are placed in order
of falling length; of all open containers that can take a text under every constraint, it goes to the one whose
weighted residual, after it is placed, has the least norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.session import materialize

#: Texts that are packed together by one task.
GROUP = 8192
#: Containers of a group that are filled less than this are opened again and their texts packed with those of other groups.
FULL = 0.98


@dataclass(frozen=True)
class Limits:
    """Per container: documents and tiles of attention for a capacity in tokens, and the weights of the three residuals.

    There is room for one document in ``tokens_per_document`` tokens, and for the attention of one text of the whole
    capacity, in tiles of a ``tiles``-th of it. So a text that the capacity can take always fits into an empty container.
    """

    tokens_per_document: int = 16
    tiles: int = 16
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)

    def documents(self, capacity: int) -> int:
        return max(1, capacity // self.tokens_per_document)

    def tile(self, capacity: int) -> int:
        return -(-capacity // self.tiles)

    def attention(self, sizes: np.ndarray | int, capacity: int) -> np.ndarray | int:
        """Tiles of a text of so many tokens."""
        touched = -(-sizes // self.tile(capacity))
        return touched * touched


def best_fit(sizes: np.ndarray, capacity: int, limits: Limits) -> np.ndarray:
    """The container, from 0, of each size; sizes fall and none exceeds the capacity."""
    n = len(sizes)
    caps = np.array([capacity, limits.documents(capacity), limits.attention(capacity, capacity)], float)
    scale = np.array(limits.weights) / caps**2
    costs = limits.attention(sizes.astype(np.int64), capacity).tolist()
    left = np.empty((3, n))
    place = np.empty(n, np.int64)
    opened = 0
    names = np.empty(n, np.int64)  # of the containers that are still open
    made = 0
    least, cheapest = (sizes[-1], costs[-1]) if n else (0, 0)
    for i, (size, cost) in enumerate(zip(sizes.tolist(), costs)):
        t, d, a = left[0, :opened], left[1, :opened], left[2, :opened]
        fits = np.flatnonzero((t >= size) & (a >= cost))  # containers without room for a document are closed
        if len(fits):
            norm = scale[0] * (t[fits] - size) ** 2 + scale[1] * (d[fits] - 1.0) ** 2 + scale[2] * (a[fits] - cost) ** 2
            at = int(fits[np.argmin(norm)])
        else:
            at = opened
            left[:, at] = caps
            names[at] = made
            opened, made = opened + 1, made + 1
        place[i] = names[at]
        left[0, at] -= size
        left[1, at] -= 1
        left[2, at] -= cost
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < cheapest:  # nothing fits any more: closed
            opened -= 1
            left[:, at], names[at] = left[:, opened], names[opened]
    return place


def pack(sizes: DataFrame, id_column: str, capacities: list[tuple[int, int]], limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """(capacity_id, container_id, id, piece, start, tokens): every text assigned, for each of ``capacities``.

    ``sizes`` has (id, tokens); ``capacities`` pairs of id and tokens. A text is split only if it exceeds the
    capacity, into whole pieces of that length and a rest. Texts without tokens (null, empty) need no room: one row with a
    null container. Ids may repeat; each row is a text of its own, told apart by nothing. An empty table gives an empty result.

    Rows are spread over groups of about ``group``, each packed by one task on its own, so work and memory of a task
    are bounded and no order over all texts is needed. Groups hang on the place of a row in its partition, not on
    its id, so repeated ids spread like others; ``sizes`` should be a written table, whose partitions stay as they are.
    What a group could not fill (``FULL``) is packed again, in groups of what is left of all, until one group is left or no
    round makes the rest much smaller; so the containers that stay open are not as many as the groups.
    """
    capacities = [(int(k), int(c)) for k, c in capacities if k is not None and c is not None and c > 0]
    kind = dict(sizes.dtypes)[id_column]
    pieces = f"capacity_id int, `{id_column}` {kind}, piece int, start bigint, tokens bigint"
    if not capacities:
        return sizes.sparkSession.createDataFrame([], f"capacity_id int, container_id bigint, `{id_column}` {kind}, piece int, start bigint, tokens bigint")
    room = dict(capacities)
    names = ["capacity_id", id_column, "piece", "start", "tokens"]

    def packer(turn: int):
        def run(key: tuple, items: pa.Table) -> pa.Table:
            capacity = room[key[0].as_py()]
            ids, size = items.column(id_column).combine_chunks(), items.column("tokens").to_numpy()
            order = np.lexsort((items.column("piece").to_numpy(), pc.rank(ids, "ascending").to_numpy(), -size))
            place = best_fit(size[order], capacity, limits)
            used = np.bincount(place, weights=size[order])
            items = items.select(names).take(pa.array(order))
            open_ = pa.array(used[place] < capacity * FULL)
            return items.append_column("container_id", pa.array(place + (key[1].as_py() << 28) + (turn << 56))).append_column("open", open_)

        return run

    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("capacity_id"), F.lit(c).cast("bigint").alias("room")) for k, c in capacities])).alias("c")
    some = sizes.where("tokens > 0").select(id_column, F.col("tokens").cast("bigint").alias("tokens"), wanted)
    cut = some.select("c.capacity_id", id_column, F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.expr("(tokens - 1) div c.room * c.room"), F.col("c.room"))).alias("piece", "start"), "tokens", "c.room")
    rest = cut.select("capacity_id", id_column, "piece", "start", F.least("room", F.col("tokens") - F.col("start")).alias("tokens"))
    count, parts, turn = sizes.count(), [], 0
    while True:
        groups = max(1, -(-count // group))
        sharded = rest.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id(), "capacity_id"), F.lit(groups)).alias("shard"))
        packed = materialize(sharded.groupBy("capacity_id", "shard").applyInArrow(packer(turn), f"{pieces}, container_id bigint, open boolean"), "packed")
        left = packed.where("open")
        most = left.groupBy("capacity_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] if groups > 1 else 0
        if groups == 1 or most * 2 > count:
            parts.append(packed)
            break
        parts.append(packed.where("NOT open"))
        rest, count, turn = left, most, turn + 1
    none = sizes.where("coalesce(tokens, 0) <= 0").select(
        "*", F.explode(F.array(*[F.lit(k) for k, _ in capacities])).alias("capacity_id")
    ).select("capacity_id", F.lit(None).cast("bigint").alias("container_id"), id_column, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("tokens"))
    out = none
    for p in parts:
        out = out.unionByName(p.drop("open"))
    return out


def violations(packed: DataFrame, sizes: DataFrame, id_column: str, capacities: list[tuple[int, int]], limits: Limits = Limits()) -> DataFrame:
    """(rule, capacity_id, n): how often each rule is broken; no rows if none is. Ids must not repeat.

    'tokens', 'documents' and 'attention': containers beyond a capacity; 'lost': texts whose pieces don't make them up, one
    after another; 'split': texts in pieces though the capacity takes them; 'empty': texts without tokens in a container.
    """
    room = F.element_at(F.create_map(*[F.lit(x) for k, c in capacities for x in (k, c)]), F.col("capacity_id"))
    documents = F.element_at(F.create_map(*[F.lit(x) for k, c in capacities for x in (k, limits.documents(c))]), F.col("capacity_id"))
    tile = F.element_at(F.create_map(*[F.lit(x) for k, c in capacities for x in (k, limits.tile(c))]), F.col("capacity_id"))
    touched = F.ceil(F.col("tokens") / tile)
    boxes = packed.where("container_id IS NOT NULL").groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("d"), F.sum(touched * touched).alias("a"))
    all_tiles = F.ceil(room / tile)
    rules = F.array(F.when(F.col("t") > room, "tokens"), F.when(F.col("d") > documents, "documents"), F.when(F.col("a") > all_tiles * all_tiles, "attention"))
    found = boxes.select("capacity_id", F.explode(rules).alias("rule"))
    texts = packed.groupBy("capacity_id", id_column).agg(
        F.sum("tokens").alias("t"), F.count("*").alias("k"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.countDistinct("start").alias("starts"), F.count("container_id").alias("boxes")
    )
    wanted = sizes.select(F.col(id_column), F.coalesce("tokens", F.lit(0)).alias("tokens")).withColumn("capacity_id", F.explode(F.array(*[F.lit(k) for k, _ in capacities])))
    both = texts.join(wanted, ["capacity_id", id_column], "full")
    lost = ~(F.col("t").eqNullSafe(F.col("tokens")) & F.col("end").eqNullSafe(F.col("tokens")) & F.col("starts").eqNullSafe(F.col("k")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / room))
    found = found.unionByName(both.select("capacity_id", F.explode(F.array(F.when(lost, "lost"), F.when(F.col("k") != pieces, "split"), F.when((F.col("tokens") == 0) & (F.col("boxes") > 0), "empty"))).alias("rule")))
    return found.where("rule IS NOT NULL").groupBy("rule", "capacity_id").agg(F.count("*").alias("n"))


def fill(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(capacity_id, containers, tokens, least, fill): how full the containers are on the whole; ``least`` is the
    number of containers below which the tokens alone cannot be held."""
    room = F.element_at(F.create_map(*[F.lit(x) for pair in capacities for x in pair]), F.col("capacity_id"))
    used = packed.where("container_id IS NOT NULL").groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = used.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select("*", F.ceil(F.col("tokens") / room).alias("least"), (F.col("tokens") / (F.col("containers") * room)).alias("fill"))
