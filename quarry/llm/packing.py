"""Problem 7: filling fixed-capacity containers along a space-filling curve.

Documents become hashed word vectors, projected to three dimensions and put on
a Hilbert curve. Range partitions of the curve are packed one by one: a
container takes the next document of the curve and then, again and again, the
largest of the next ``WINDOW`` documents that still fits; nothing but that
window is held in memory. A text larger than
the container is cut into full containers and a rest, which is packed like any
other text; no other text is split.

Sizes are tokens of a public tokenizer whose file is a parameter. Null and
empty texts have no tokens and ride along in a container as empty pieces.
Nothing but (document, size, curve key) is shuffled.
"""

from __future__ import annotations

import base64
import functools
import math
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel as K

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
DIMS, ORDER = 3, 10  #: of the curve: dimensions, bits each
BUCKETS = 256  #: of the hashed word vectors
BUDGET_BLOCK = 200  #: budgets that are packed in one pass
ROWS_PER_TASK = 25_000  #: documents in one range of the curve
WINDOW = 4096  #: documents of the curve that a container may choose from

_PROJECTION = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert(points: np.ndarray, bits: int = ORDER) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows), each coordinate of so many bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        low = (1 << b) - 1
        for i in range(dims):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code over the coordinates
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_ERF = np.vectorize(math.erf, otypes=[float])


def _curve(texts: list[str]) -> np.ndarray:
    h, doc, _, _ = K.words([t.lower() for t in texts])
    counts = np.bincount(doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    at = (0.5 + 0.5 * _ERF(v @ _PROJECTION / math.sqrt(2))) * (1 << ORDER)
    return hilbert(np.minimum(at.astype(np.int64), (1 << ORDER) - 1))


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, curve: size and curve position of every document with an id."""

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for b in batches:
            ids, texts = b.doc_id.to_numpy(), K.filled(b.text)
            for first, some in K.blocks(texts):
                n = [len(enc.encode_ordinary(t)) for t in some]
                yield pd.DataFrame({"doc_id": ids[first : first + len(some)], "n_tokens": n, "curve": _curve(some)})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL").mapInPandas(size, "doc_id long, n_tokens int, curve long")


class Packer:
    """Containers of one capacity, filled from items that arrive in curve order; holds no more than the window of items."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.pool: list[tuple[int, int]] = []  # (size, -place), sorted
        self.waiting: deque[int] = deque()  # places in curve order, packed ones included
        self.items: dict[int, tuple] = {}
        self.places = self.boxes = 0

    def put(self, size: int, item: tuple) -> list[tuple]:
        """(container, *item) of what is packed to make room for one item, none larger than the capacity."""
        done = self._close() if len(self.pool) >= self.window else []
        insort(self.pool, (size, -self.places))  # of equal sizes the first on the curve is chosen
        self.items[self.places] = item
        self.waiting.append(self.places)
        self.places += 1
        return done

    def own(self) -> int:
        """A new container for what fills one alone."""
        self.boxes += 1
        return self.boxes - 1

    def rest(self) -> list[tuple]:
        done = []
        while self.pool:
            done += self._close()
        return done

    def _close(self) -> list[tuple]:
        while self.waiting[0] not in self.items:
            self.waiting.popleft()
        head = self.waiting.popleft()
        size = self.items[head][-1]
        del self.pool[bisect_right(self.pool, (size, -head)) - 1]
        taken, room = [self.items.pop(head)], self.capacity - size
        while self.pool and (at := bisect_right(self.pool, (room, 1))):
            size, place = self.pool.pop(at - 1)
            taken.append(self.items.pop(-place))
            room -= size
        box = self.own()
        return [(box, *x) for x in taken]


_PACKED = "budget_id int, container_id long, doc_id long, piece_no int, start_token int, n_tokens int"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of budget, capacity and curve, packed as they come: memory holds one batch and one window."""
    base = TaskContext.get().partitionId() << 32
    packer, now = None, None

    def frame(budget: int, rows: list[tuple]) -> pd.DataFrame:
        box, doc, piece, start, n = zip(*rows, strict=True)
        return pd.DataFrame({"budget_id": np.int32(budget), "container_id": base + np.array(box, np.int64), "doc_id": doc, "piece_no": np.array(piece, np.int32), "start_token": np.array(start, np.int32), "n_tokens": np.array(n, np.int32)})

    for b in batches:
        for key, some in b.groupby(["budget_id", "capacity_tokens"], sort=True):
            if key != now:
                if packer and (rows := packer.rest()):
                    yield frame(now[0], rows)
                packer, now = Packer(int(key[1])), key
            cap, rows = packer.capacity, []
            for doc, n in zip(some.doc_id.tolist(), some.n_tokens.tolist(), strict=True):
                full = n // cap if n > cap else 0
                rows += [(packer.own(), doc, k, k * cap, cap) for k in range(full)]
                if n > full * cap or not full:
                    rows += packer.put(n - full * cap, (doc, full, full * cap, n - full * cap))
            if rows:
                yield frame(key[0], rows)
    if packer and (rows := packer.rest()):
        yield frame(now[0], rows)


def pack(docs: DataFrame, budgets: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """budget_id, container_id, doc_id, piece_no, start_token, n_tokens: every document in every budget.

    docs: doc_id, n_tokens, curve, which are counted first, so pass a stored
    frame; budgets: budget_id, capacity_tokens (null or non-positive capacities
    are skipped; however many there are, they go in blocks of BUDGET_BLOCK).
    container_id is unique within a budget. Ranges of the curve hold about
    rows_per_task documents each, on any size of input.
    """
    few = [(b.budget_id, b.capacity_tokens) for b in budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0 AND budget_id IS NOT NULL").distinct().orderBy("budget_id", "capacity_tokens").collect()]
    if not few:
        return docs.sparkSession.createDataFrame([], _PACKED)
    n = docs.count()

    def block(some: list[tuple[int, int]]) -> DataFrame:
        sizes = F.array(*[F.struct(F.lit(i).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in some])
        order = ("budget_id", "capacity_tokens", "curve", "doc_id")
        each = docs.select("doc_id", "n_tokens", "curve", F.inline(sizes))
        return each.repartitionByRange(max(1, math.ceil(n * len(some) / rows_per_task)), *order).sortWithinPartitions(*order).mapInPandas(_packed, _PACKED)

    return reduce(DataFrame.unionByName, [block(few[i : i + BUDGET_BLOCK]) for i in range(0, len(few), BUDGET_BLOCK)])


def whole(packing: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, n_docs, overfull, gaps, needless_splits: what an assignment holds, and its faults (all 0 in a right one).

    gaps counts documents whose pieces do not follow one another from token 0;
    needless_splits documents in several pieces that one container could hold.
    """
    by_doc = packing.groupBy("budget_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"), F.countDistinct("start_token").alias("starts"))
    caps = F.broadcast(budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct())
    docs = by_doc.join(caps, "budget_id").groupBy("budget_id").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") != F.col("last")) | (F.col("starts") != F.col("pieces"))).alias("gaps"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("needless_splits"))
    boxes = packing.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(caps, "budget_id").groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    return docs.join(boxes, "budget_id").select("budget_id", "n_docs", "overfull", "gaps", "needless_splits")


def fit(packing: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, containers, tokens, filled: the share of all capacity that is used."""
    by = packing.groupBy("budget_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return by.join(budgets.select("budget_id", "capacity_tokens"), "budget_id").select("budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
