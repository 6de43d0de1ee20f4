"""Best-fit packing by bin completion: few sequences, found by branch and bound.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into groups of
some thousands, every group getting the same mixture of lengths, and each group is packed
by itself: a best-fit-decreasing packing is the first incumbent, then sequences are
completed one by one around the largest piece left, trying only fillings that no other
filling dominates and giving up a branch once the space it has wasted rules out beating
the incumbent. What the groups fill badly is dealt and packed again, over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import free_names, group_count, store
from hazeline.llm.pieces import token_pieces

CAPACITY = 2048
#: Pieces that are packed together.
GROUP_PIECES = 4096
#: Steps of the search for each piece of a group, after which the incumbent stands.
STEPS_PER_PIECE = 60
#: Pieces of one length that are numbered together.
NUMBERED_ROWS = 1 << 18
#: A sequence is loose when this share of it, or more, is free.
LOOSE_SHARE = 1 / 16
#: Loose sequences are packed again as long as that saves this share of them.
LEAST_SAVED = 0.01


class Lengths:
    """A multiset of lengths with fast search: counts, and a bit for each length present.

    ``steps`` is how many more fillings a search may look at.
    """

    def __init__(self, lengths: list[int], capacity: int):
        self.count = [0] * (capacity + 1)
        self.bits = 0
        self.steps = 0
        for n in lengths:
            self.add(n)

    def add(self, n: int) -> None:
        self.count[n] += 1
        self.bits |= 1 << n

    def drop(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def at_most(self, n: int) -> int:
        """Largest length present that is no longer than ``n``; 0 if none."""
        return max((self.bits & ((1 << (n + 1)) - 1)).bit_length() - 1, 0) if n > 0 else 0

    def at_least(self, n: int) -> int:
        """Smallest length present of ``n`` or more; 0 if none."""
        high = self.bits >> n
        return n + (high & -high).bit_length() - 1 if high else 0


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each length, longest first, goes into the fullest sequence that has room."""
    free = Lengths([], capacity)
    by_free: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        room = free.at_least(n)
        if room:
            own = by_free[room].pop()
            free.drop(room)
        else:
            own, room = [], capacity
            bins.append(own)
        own.append(n)
        if room > n:
            by_free.setdefault(room - n, []).append(own)
            free.add(room - n)
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A number of sequences that no packing can beat: by volume, and by pieces over half."""
    total = sum(lengths)
    best = -(-total // capacity)
    large = sum(n > capacity // 2 for n in lengths)
    return max(best, large)


def quick_fillings(left: Lengths, room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Some fillings of ``room`` that waste at most ``waste``, fullest first.

    Where pieces are short against the room, the longest fill it down to three of them;
    the last three are enumerated.
    """
    prefix: list[int] = []
    while (longest := left.at_most(room)) and longest * 3 < room:
        left.drop(longest)
        prefix.append(longest)
        room -= longest
    for own in last_fillings(left, room, waste):
        for n in prefix:
            left.add(n)
        yield (*prefix, *own)
        for n in prefix:
            left.drop(n)
    for n in prefix:
        left.add(n)


def last_fillings(left: Lengths, room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with up to three lengths that waste at most ``waste``.

    Fullest first. A single length that fills a space dominates every other filling of that
    space or less, so the search ends with it.
    """
    for lost in range(min(waste, room) + 1):
        space = room - lost
        if space == 0:
            yield ()
            return
        if left.count[space]:
            yield (space,)
            return
        first = left.at_most(space - 1)
        while first * 2 >= space and left.steps > 0:
            left.steps -= 1
            rest = space - first
            if left.count[rest] > (rest == first):
                yield (first, rest)
            first = left.at_most(first - 1)
        first = left.at_most(space - 2)
        while first * 3 >= space and left.steps > 0:
            left.steps -= 1
            rest = space - first
            second = left.at_most(min(first, rest - 1))
            while second * 2 >= rest and left.steps > 0:
                left.steps -= 1
                third = rest - second
                need = 1 + (third == second) + (third == first)
                if left.count[third] >= need and left.count[second] > (second == first):
                    yield (first, second, third)
                second = left.at_most(second - 1)
            first = left.at_most(first - 1)
        if left.at_most(space) == 0:
            # nothing fits any more: the space is lost whatever comes
            if room <= waste:
                yield ()
            return


def all_fillings(left: Lengths, room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` that wastes at most ``waste``, of any number of lengths.

    Lengths are taken longest first; an empty filling counts where nothing fits.
    """
    n = left.at_most(room)
    if not n:
        if room <= waste:
            yield ()
        return
    chosen: list[int] = []
    while left.steps > 0:
        left.steps -= 1
        if n:
            left.drop(n)
            chosen.append(n)
            room -= n
            n = left.at_most(min(room, n))
            if n:
                continue
            if room <= waste and not dominated(left, chosen, room):
                for own in chosen:
                    left.add(own)
                yield tuple(chosen)
                for own in chosen:
                    left.drop(own)
        if not chosen:
            return
        last = chosen.pop()
        left.add(last)
        room += last
        n = left.at_most(last - 1)
    for own in chosen:
        left.add(own)


def dominated(unused: Lengths, own: list[int], free: int) -> bool:
    """Whether an unused length fits as well, or in place of one or two shorter ones of ``own``."""
    kinds = sorted(set(own))
    if unused.at_most(free) or any(unused.at_most(n + free) > n for n in kinds):
        return True
    for i, first in enumerate(kinds):
        for second in kinds[i:]:
            unused.steps -= 1
            if (second > first or own.count(first) > 1) and unused.at_most(first + second + free) >= first + second:
                return True
    return False


def complete_bins(lengths: list[int], capacity: int, steps_per_piece: int = STEPS_PER_PIECE) -> list[list[int]]:
    """Packs ``lengths`` (1..capacity); never worse than best fit decreasing.

    Quick fillings are searched first; where they end without a better packing, all
    undominated ones are. The result is a best one if the steps last.
    """
    incumbent = best_fit_decreasing(lengths, capacity)
    bound, total = least_bins(lengths, capacity), sum(lengths)
    steps = steps_per_piece * len(lengths)
    fillings = quick_fillings
    while len(incumbent) > bound and steps > 0:
        allowed = (len(incumbent) - 1) * capacity - total
        left = Lengths(lengths, capacity)
        left.steps = steps
        stack: list[tuple[int, Iterator[tuple[int, ...]], int]] = []
        chosen: list[list[int]] = []
        found, slack = False, allowed

        def descend() -> bool:
            """Opens a sequence around the largest length left; true when none is left."""
            largest = left.at_most(capacity)
            if not largest:
                return True
            left.drop(largest)
            stack.append((largest, fillings(left, capacity - largest, slack), slack))
            chosen.append([])
            return False

        found = descend()
        while stack and not found and left.steps > 0:
            left.steps -= 1
            largest, options, had = stack[-1]
            for n in chosen[-1][1:]:
                left.add(n)
            slack = had
            filling = next(options, None)
            if filling is None:
                left.add(largest)
                stack.pop()
                chosen.pop()
                continue
            for n in filling:
                left.drop(n)
            chosen[-1] = [largest, *filling]
            slack = had - (capacity - largest - sum(filling))
            found = descend()
        steps = left.steps
        if found:
            incumbent = [own for own in chosen if own]
        elif fillings is quick_fillings:
            fillings = all_fillings
        else:
            break
    return incumbent


def sequence_places(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each length its sequence (from 0) and its offset there."""
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[i], []).append(i)
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for number, own in enumerate(complete_bins(lengths, capacity)):
        at = 0
        for n in own:
            i = waiting[n].pop()
            sequence[i], offset[i] = number, at
            at += n
    return sequence, offset


def deal_by_length(pieces: DataFrame, group_pieces: int, group: str) -> tuple[DataFrame, int]:
    """Adds ``group``: pieces ordered by length are dealt round, so that all groups hold alike lengths.

    The order within a length is that of hashed parts of at most about ``NUMBERED_ROWS``
    rows, which are numbered apart; where a part begins is taken from the parts' mean size,
    so that a group may get a few pieces more or less. Counts by length, as many as there
    are lengths, go through the driver.
    """
    counts = sorted(tuple(r) for r in pieces.groupBy("length").count().collect())
    rows, before = [], 0
    for length, n in counts:
        parts = group_count(n, NUMBERED_ROWS)
        rows.append((length, before, parts, n / parts))
        before += n
    groups = group_count(before, group_pieces)
    of, first, parts, mean, row, part = free_names([*pieces.columns, group], "of", "first", "parts", "mean", "row", "part")
    starts = pieces.sparkSession.createDataFrame(rows, f"`{of}` long, `{first}` long, `{parts}` long, `{mean}` double")
    placed = (
        pieces.withColumn(row, F.monotonically_increasing_id())
        .join(F.broadcast(starts), F.col("length") == F.col(of))
        .withColumn(part, F.pmod(F.xxhash64(row), F.col(parts)))
    )
    number = F.row_number().over(Window.partitionBy("length", part).orderBy(row))
    place = F.col(first) + F.floor(F.col(part) * F.col(mean)) + number
    return placed.withColumn(group, F.pmod(place, F.lit(groups))).select(*(f"`{c}`" for c in pieces.columns), group), groups


def pack_groups(pieces: DataFrame, capacity: int, group_pieces: int, base: int, free: str) -> tuple[DataFrame, int]:
    """One round: pieces with sequence_id, offset and how much of the sequence is ``free``; and the number of groups."""
    (group,) = free_names([*pieces.columns, free], "group")
    dealt, groups = deal_by_length(pieces, group_pieces, group)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        sequence, offset = sequence_places(lengths, capacity)
        space = [capacity] * (max(sequence) + 1)
        for number, n in zip(sequence, lengths, strict=True):
            space[number] -= n
        start = (base + key[0].as_py()) << 32
        out = table.drop_columns([group])
        out = out.append_column("sequence_id", pa.array([start + n for n in sequence], pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64()))
        return out.append_column(free, pa.array([space[n] for n in sequence], pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = dealt.groupBy(group).applyInArrow(run, f"{fields}, sequence_id long, offset long, `{free}` long")
    return store(packed, "packed"), groups


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    Sequences are filled without gaps from offset 0. Groups are dealt by length and place,
    so no key, however frequent, fills a group. Loose sequences of all groups are packed
    again until too little is saved, or until their volume or their pieces over half a
    sequence show that nothing can be. Sequence numbers are unique but not consecutive.
    An empty input gives no rows; columns sequence_id and offset of the input are replaced.
    """
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    columns = [f"`{c}`" for c in own]
    (free,) = free_names(own, "free")
    least = max(1, int(capacity * LOOSE_SHARE))
    loose = F.col(free) >= least
    packed, base = pack_groups(pieces.select(*columns), capacity, group_pieces, 0, free)
    settled = []
    while True:
        volume, large, sequences = packed.where(loose).agg(F.sum("length"), F.count_if(F.col("length") > capacity // 2), F.count_if(F.col("offset") == 0)).first()
        if sequences <= max(-(-(volume or 0) // capacity), large):
            break
        again, groups = pack_groups(packed.where(loose).select(*columns), capacity, group_pieces, base, free)
        base += groups
        saved = sequences - again.where(F.col("offset") == 0).count()
        if saved > 0:
            settled.append(packed.where(~loose))
            packed = again
        if saved < LEAST_SAVED * sequences:
            break
    for part in settled:
        packed = packed.unionByName(part)
    return packed.drop(free)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and offset (columns of ``token_pieces``).

    Null and empty texts are one piece of one id. Documents with equal ids or texts each
    keep their own pieces. Very long texts are tokenized in slices and cut.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=False)
    return pack_pieces(store(pieces, "pieces"), capacity)
