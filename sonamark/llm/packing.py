"""Best-fit packing of documents into token sequences, with conflicts.

A bin holds CAPACITY tokens. It carries a bitmap of the sources and one of the duplicate clusters in it; a document whose source or
cluster is in a bin already does not go there. Items come in descending size. Bins are kept in the order of their residual room; the search starts
at the first bin with enough room, the tightest, and goes on to the next larger one until a bin has no conflict. If there is none,
a new bin opens. A document longer than a bin fills whole bins with its first fragments; what remains is packed as an item.

Documents are dealt at random (by hash) to groups of about GROUP rows, whatever their source, and each group is packed in a
task of its own; a hot source is spread over all groups. Packing loses at most a partly filled bin tail for each group.

A null text has no tokens and still gets a place. A null source conflicts with nothing. Repeated rows are of one cluster, so
they are in different bins. Ties of size go by id (nulls last), then cluster. A very long text fills bins of its own. An empty table gives no rows. Input
columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .token_counts import count_tokens

CAPACITY, GROUP = 4096, 4000


class Bins:
    """Bins by their residual room, those of one room in the order they were opened. Each room knows how many of its bins hold a source or a cluster, so
    a room whose bins all conflict is passed over at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # with a bin, ascending
        self.of_room: dict[int, list[int]] = {}
        self.holding: dict[tuple[int, str, int], int] = {}  # (room, kind, bit) -> bins
        self.bits: list[dict[str, int]] = []  # the two bitmaps of each bin
        self.items: list[list[tuple[str, int]]] = []  # what each bin's bitmaps are made of

    def fits(self, b: int, own: list[tuple[str, int]]) -> bool:
        return not any(self.bits[b][kind] & bit for kind, bit in own)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Puts an item (its bits, 0 for none) into the tightest bin that fits and has no conflict: (bin, offset in it)."""
        own = [x for x in (("source", source), ("cluster", cluster)) if x[1]]
        for room in self.rooms[bisect_left(self.rooms, size) :]:
            bins = self.of_room[room]
            if any(self.holding.get((room, *x), 0) == len(bins) for x in own):
                continue
            b = next((b for b in bins if self.fits(b, own)), None)
            if b is not None:
                self.move(b, room, -1)
                break
        else:
            b, room = len(self.bits), self.capacity
            self.bits.append({"source": 0, "cluster": 0})
            self.items.append([])
        for kind, bit in own:
            self.bits[b][kind] |= bit
        self.items[b] += own
        self.move(b, room - size, 1)
        return b, self.capacity - room

    def move(self, b: int, room: int, step: int) -> None:
        """Puts a bin to those of a room (1), or takes it away (-1)."""
        bins = self.of_room.setdefault(room, [])
        if step > 0:
            if not bins:
                insort(self.rooms, room)
            insort(bins, b)
        else:
            del bins[bisect_left(bins, b)]
            if not bins:
                del self.rooms[bisect_left(self.rooms, room)]
        for x in self.items[b]:
            self.holding[room, *x] = self.holding.get((room, *x), 0) + step


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "doc_id", "cluster"], ascending=[False, True, True], kind="stable", na_position="last")
    bits: dict[str, dict] = {"source": {}, "cluster": {}}
    bit = lambda kind, v: 0 if v is None or v != v else 1 << bits[kind].setdefault(v, len(bits[kind]))
    bins, full, out = Bins(capacity), 0, []
    items = []
    for doc_id, source, cluster, n in zip(rows["doc_id"], rows["source"], rows["cluster"], rows["n_tokens"]):
        whole, rest = divmod(int(n), capacity)
        for k in range(whole):
            out.append((doc_id, k, full, 0, capacity))
            full += 1
        if rest or not whole:
            items.append((rest, doc_id, whole, bit("source", source), bit("cluster", cluster)))
    for size, doc_id, k, source, cluster in sorted(items, key=lambda x: -x[0]):
        b, at = bins.place(size, source, cluster)
        out.append((doc_id, k, full + b, at, size))
    return pd.DataFrame({"group": rows["group"].iloc[0], **dict(zip(("doc_id", "fragment", "bin", "start", "n_tokens"), map(list, zip(*out))))}).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per fragment: doc_id, fragment, group, bin (within its group), start (in the bin), n_tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = (F.col(source_col).cast("string").alias("source"), F.xxhash64(lower_ascii(text)).alias("cluster"))
    sized = written(count_tokens(docs, None, id_col, text_col, extra).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "cluster", "n_tokens"), "sized")
    groups = max(1, -(-sized.count() // group))
    # Dealt by the id and a row number, as copies and null ids must spread as well.
    dealt = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(lambda rows: pack_group(rows, capacity), "group int, doc_id long, fragment int, bin int, start int, n_tokens int").select("doc_id", "fragment", "group", "bin", "start", "n_tokens")
