"""Best-fit decreasing packing of token sequences into fixed windows.

Documents are cut into full windows and a remainder. Best-fit decreasing looks at nothing but lengths,
and of these there are at most ``window`` different ones. So the exact plan for a whole corpus comes
from the table of counts by length: pieces of one length go, many at a time, to runs of windows that
are alike. A segment tree over the remaining capacities finds the tightest open windows. The plan is
a table of runs whose size depends on ``window`` only (at most three new runs of windows per length,
each visited by at most 64 lengths, as different lengths in one window add up to at most ``window``).

The same plan over what one task holds fills most windows without padding where the texts are tokenised. These
are done; only the pieces of the other windows move, to the windows of the plan over the whole corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, stage
from millrace.llm.tokens import encoder
from millrace.operators.scan import running_sum

WINDOW = 2048
#: Ids that a task holds to fill windows with, 4 bytes each, and rows that it hands over at once. They bound its memory.
HELD, ROWS_AT_ONCE = 8_000_000, 1000
PIECE = ("offset", "length", "doc_id", "start", "doc_tokens")
ROWS = f"n_tokens long, ids binary, pieces array<struct<{', '.join(f'{name}: bigint' for name in PIECE)}>>"
RUNS = "length long, first_rank long, n long, per long, window_id long, at long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut each into full windows and a remainder; staged.

    One row per piece: ``piece_id``, ``doc_id``, ``start``, ``length``, ``doc_tokens`` and ``ids`` as
    little-endian unsigned 32-bit numbers. A NULL text counts as empty, and every document has at
    least its end id. Equal rows are different documents. Other columns are left out.
    """
    return _as_pieces(tokenised(docs, tokenizer, end_id, window, held=0))


def _as_pieces(rows: DataFrame) -> DataFrame:
    """Rows of one piece as a table of pieces."""
    p = F.col("pieces")[0]
    fields = [p[name].alias(name) for name in ("doc_id", "start", "doc_tokens")]
    return rows.select(F.col("row_id").alias("piece_id"), F.col("n_tokens").alias("length"), *fields, "ids")


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """Tokenise ``docs`` and fill windows on the spot, so that few ids have to move; staged.

    One row per sequence without padding, and one per piece that is in none: ``row_id``, ``n_tokens``, ``ids`` and
    ``pieces``. A task holds pieces of about ``held`` ids, packs them best-fit decreasing and lets go of all: what it
    leaves in windows that are not full has rows of its own, for the plan over the whole corpus.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        rows, waiting, n_waiting = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    piece = (min(window, total - at), doc_id, at, total, ids[4 * at : 4 * (at + window)])
                    if piece[0] == window or not held:
                        rows.append([piece])
                    else:
                        waiting.append(piece)
                        n_waiting += piece[0]
                if n_waiting >= held > 0:
                    rows += _fill(waiting, window)
                    waiting, n_waiting = [], 0
                if len(rows) >= ROWS_AT_ONCE:
                    yield from _batches(rows)
                    rows = []
        yield from _batches(rows + _fill(waiting, window))

    rows = docs.select(*columns_of(docs, doc_id="long", text="string")).mapInArrow(fill, ROWS)
    return stage(rows.withColumn("row_id", F.monotonically_increasing_id()), "pieces", compression="zstd")


def _fill(waiting: list[tuple], window: int) -> list[list[tuple]]:
    """The pieces as lists in order of their place: those of a full window together, each other one by itself."""
    by_length, windows = defaultdict(list), defaultdict(list)
    for piece in waiting:
        by_length[piece[0]].append(piece)
    # Runs come by falling length, so a window's pieces come in the order of their places.
    for length, rank, n, per, first, _ in plan_runs({k: len(v) for k, v in by_length.items()}, window):
        for j in range(n):
            windows[first + j // per].append(by_length[length][rank + j])
    out = []
    for parts in windows.values():
        out += [parts] if sum(p[0] for p in parts) == window else [[p] for p in parts]
    return out


def _batches(rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), ROWS_AT_ONCE):
        some = rows[k : k + ROWS_AT_ONCE]
        flat = [p for parts in some for p in parts]
        offsets = [at for parts in some for at in accumulate((p[0] for p in parts[:-1]), initial=0)]
        columns = [offsets, *([p[i] for p in flat] for i in range(4))]
        places = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(PIECE))
        ends = pa.array(accumulate(map(len, some), initial=0), pa.int32())
        ids = pa.array([b"".join(p[4] for p in parts) for parts in some], pa.binary())
        used = pa.array([sum(p[0] for p in parts) for parts in some], pa.int64())
        yield pa.RecordBatch.from_arrays([used, ids, pa.ListArray.from_arrays(ends, places)], ["n_tokens", "ids", "pieces"])


class Tightest:
    """Segment tree over capacities 0 to ``top``: which of them have open windows."""

    def __init__(self, top: int):
        self._leaves = 1 << top.bit_length()
        self._any = bytearray(2 * self._leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        node = self._leaves + capacity
        self._any[node] = is_open
        while node := node >> 1:
            self._any[node] = self._any[2 * node] or self._any[2 * node + 1]

    def at_least(self, capacity: int) -> int | None:
        """The smallest capacity with an open window that is no smaller than ``capacity``."""
        node = self._leaves + capacity
        while not self._any[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node + (not self._any[2 * node])
        return node - self._leaves


def plan_runs(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts`` pieces by length.

    A run (length, first_rank, n, per, window_id, at) puts the piece of rank first_rank + j, j < n,
    into window window_id + j div per, at position at + (j mod per) * length.
    """
    tree, open_runs, runs, windows = Tightest(window), defaultdict(list), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_runs[capacity].append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                capacity, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.mark(capacity, False)
            per = capacity // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, window - capacity))
                put(capacity - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                runs.append((length, rank, left, left, first, window - capacity))
                put(capacity - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(capacity, first, n)
    return runs


def layout(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Place each piece: ``piece_id``, ``sequence_id`` and ``offset`` (gapless from 0 in a sequence)."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for length, n in zip(batch["length"], batch["n"], strict=True):
                counts[int(length)] += int(n)
        yield pd.DataFrame(plan_runs(counts, window), columns=["length", "first_rank", "n", "per", "window_id", "at"])

    narrow = cut.select("piece_id", "length")
    # One row per length, at most ``window`` of them.
    counts = narrow.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    runs = stage(counts.coalesce(1).mapInPandas(plan, RUNS), "runs")
    ranked = running_sum(narrow, ["length"], [F.col("piece_id")], {"upto": F.lit(1).cast("long")})
    ranked = ranked.withColumn("rank", F.col("upto") - 1)
    step = F.col("rank") - F.col("first_rank")
    # The runs' size is bound by ``window``, whatever the corpus.
    placed = ranked.join(F.broadcast(runs), "length").where((step >= 0) & (step < F.col("n")))
    return placed.select(
        "piece_id",
        (F.col("window_id") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"),
    )


def sequences(cut: DataFrame, placed: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``n_tokens``, ``ids`` (padded) and ``pieces``, what lies where.

    A sequence is padded to ``window``, unless it ends at a power of two. ``pieces`` holds (offset, length, doc_id,
    start, doc_tokens, piece_id) in order. Ids move once, to their sequence, where the staged table of places is small
    enough for Spark to broadcast it, and twice otherwise. A sequence gathers at most ``window`` ids.
    """
    places = stage(placed, "places")
    whole = F.struct(*PIECE, "piece_id", "ids")
    grouped = cut.join(places, "piece_id").groupBy("sequence_id").agg(F.array_sort(F.collect_list(whole)).alias("parts"))
    used = F.aggregate("parts.length", F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    pieces_of = F.transform("parts", lambda x: x.dropFields("ids"))
    joined = grouped.select("sequence_id", used.alias("n_tokens"), ids.alias("ids"), pieces_of.alias("pieces"))
    one = F.lit(int(pad_id).to_bytes(4, "little").hex())
    padding = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(window - F.col("n_tokens")).cast("int")
    return joined.withColumn("ids", F.concat("ids", F.unhex(F.repeat(one, padding))))


def read_pieces(packed: DataFrame) -> DataFrame:
    """The pieces of written ``sequences``, each with the checksum of its ids as they lie in its sequence."""
    each = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", 4 * F.col("p.offset").cast("int") + 1, 4 * F.col("p.length").cast("int"))
    return each.select(
        "p.doc_id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset"
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, pad_id: int = 0, window: int = WINDOW, held: int = HELD
) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text): the written ``sequences``. An empty table gives no sequences.

    Windows that a task fills without padding stay where it wrote them. The pieces of all others, from all tasks,
    are packed by one plan. A sequence is numbered by the row of its first piece.
    """
    rows = tokenised(docs, tokenizer, end_id, window, held)
    cut = _as_pieces(rows.where(F.col("n_tokens") < window))
    planned = stage(sequences(cut, layout(cut, window), pad_id, window), "sequences", compression="zstd")
    places = F.transform("pieces", lambda x: x.dropFields("piece_id"))
    planned = planned.select(F.col("pieces")[0]["piece_id"].alias("sequence_id"), "n_tokens", "ids", places.alias("pieces"))
    full = rows.where(F.col("n_tokens") == window).select(F.col("row_id").alias("sequence_id"), "n_tokens", "ids", "pieces")
    return full.unionByName(planned)


def ids_of(ids: bytes) -> np.ndarray:
    """Ids of a binary ``ids`` value."""
    return np.frombuffer(ids, "<u4")
