"""Removal of repeated lines, also of those that differ in one word, by a deletion-neighbourhood join.

A line is its sequence of lower-cased words. Its deletion neighbourhood is the line itself and
each variant without one word. Two lines are within one word edit of each other just when they have a
variant in common: the same words after deletion at the same place (a replaced word), or
one line equal to a variant of the other (an added or dropped word). Variants travel as hashes of the
remaining words with the deleted place, so an equal pair has its edit distance verified by the place and the
length; each line meets only the earliest line of a variant, never all of them.

Full neighbourhoods are as large as the text. A line within one edit of another shares
with it either its first or its last half (the edit lies in the other), so halves are compared
first, and only lines whose half occurs in a different line emit variants. That drops no pair.

As in ``substring``, documents are dealt into groups, the text is shuffled once, groups send
each distinct hash once and get their answers in the order of what they sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlake.llm.packing import bits, dealt, from_bits, from_planes, planes, table_of
from stormlake.llm.words import Words, mixed

#: shorter lines are neither removed nor compared
MIN_WORDS = 8
GROUP_BYTES = 6 << 20
_STEP = 0xD1342543DE82EF95
_STEPS = (_STEP, 0xAF251AF3B0F025B5)
_LAST = np.iinfo(np.int64).max


def _running(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse, modulo 2**64."""
    out = []
    for value in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n + 1, value, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(out)


class _Lines:
    """The lines of at least ``min_words`` words of one group's documents that have a key."""

    def __init__(self, keys: pa.Array, texts: pa.Array, min_words: int):
        self.words = words = Words(texts, "spaced", lower=True)
        self.hashes = words.hashes()
        keyed = keys.is_valid().to_numpy(zero_copy_only=False)
        breaks = np.flatnonzero(words.raw == 10)
        row = words.row_of_word()
        number = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, words.offsets[row])
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(row))
        kept = (end - begin >= min_words) & keyed[row[begin]]
        self.begin, self.end = begin[kept], end[kept]
        self.row, self.number = row[self.begin], number[self.begin]
        self.key = keys.fill_null(0).to_numpy()[self.row]
        self.size = self.end - self.begin
        self.sums, self.powers = [], []
        for base in _STEPS:
            power, inverse = _running(base, len(self.hashes))
            sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(self.hashes * power[: len(self.hashes)], out=sums[1:])
            self.sums.append(sums)
            self.powers.append((power, inverse))
        self.digest = self.stretch(self.begin, self.end, 0)
        self.second = self.stretch(self.begin, self.end, 1)

    def stretch(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words from ``begin`` to ``end``."""
        sums, (_, inverse) = self.sums[which], self.powers[which]
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))

    def order(self) -> np.ndarray:
        """Lines from the earliest on: by key, then place in the document."""
        return np.lexsort((self.number, self.key))

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, line)`` of first and last stretches of half a line.

        Of two lines one edit apart the shorter has ``m`` words, and the first or last ``m // 2``
        words of both are equal. ``m`` is a line's own length or one less.
        """
        lines = np.arange(len(self.begin))
        out, owners = [], []
        half, less = self.size // 2, (self.size - 1) // 2
        for length, mask in ((half, np.ones(len(lines), bool)), (less, less != half)):
            for side in (0, 1):
                b, e = self.begin[mask], self.end[mask]
                b, e = (b, b + length[mask]) if side == 0 else (e - length[mask], e)
                out.append(mixed(self.stretch(b, e) ^ np.uint64(side + 1)))
                owners.append(lines[mask])
        return np.concatenate(out), np.concatenate(owners)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(hash, place, line)`` of the neighbourhood of some lines; place 0 is the line itself,
        ``i + 1`` the one without word ``i``."""
        sizes = self.size[lines]
        line = np.repeat(lines, sizes)
        begin, end = self.begin[line], self.end[line]
        place = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums, (_, inverse) = self.sums[0], self.powers[0]
        at = begin + place
        with np.errstate(over="ignore"):
            left = sums[at] - sums[begin]
            right = (sums[end] - sums[at + 1]) * inverse[1] if len(line) else sums[:0]
            hashes = mixed((left + right) * inverse[begin] + (end - begin - 1).astype(np.uint64))
        return (
            np.concatenate([self.digest[lines], hashes]), np.concatenate([np.zeros(len(lines), np.int64), place + 1]),
            np.concatenate([lines, line]),
        )


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal rows of some sorted columns: where each begins, and every row's group."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


class _Sent:
    """What a group sends in one round: distinct entries in the order of their hashes, each with its earliest line."""

    def __init__(self, lines: _Lines, line: np.ndarray, *columns: np.ndarray):
        rank = np.empty(len(lines.begin), dtype=np.int64)
        rank[lines.order()] = np.arange(len(rank))
        order = np.lexsort((rank[line], *columns[::-1]))
        begins, group = _firsts(*(c[order] for c in columns))
        self.columns = [c[order][begins] for c in columns]
        self.line = line[order][begins]
        self.back = np.empty(len(order), dtype=np.int64)
        self.back[order] = group

    def rows(self, kind: int, chunk: int, n: int, lines: _Lines, extra: dict[str, np.ndarray]) -> list[dict]:
        out = []
        for bucket, own in enumerate(dealt(self.columns[0], n)):
            if len(own):
                row = {"kind": kind, "bucket": bucket, "chunk": chunk, "size": len(own), "hashes": planes(self.columns[0][own])}
                row |= {"keys": planes(lines.key[self.line[own]]), "numbers": planes(lines.number[self.line[own]].astype(np.int32))}
                row |= {name: planes(values[own]) for name, values in extra.items()}
                out.append(row)
        return out


_SENT = {
    "kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int32(), "size": pa.int32(), "hashes": pa.binary(),
    "keys": pa.binary(), "numbers": pa.binary(), "seconds": pa.binary(), "places": pa.binary(), "several": pa.binary(),
}
_SENT_SQL = (
    "kind int, bucket int, chunk int, size int, hashes binary, keys binary, numbers binary, seconds binary, "
    "places binary, several binary"
)
_REPLY = {
    "kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int32(), "flags": pa.binary(), "keys": pa.binary(), "numbers": pa.binary(),
}
_REPLY_SQL = "kind int, bucket int, chunk int, flags binary, keys binary, numbers binary"
_LINE, _HALF, _VARIANT = 0, 1, 2


def _rows(rows: list[dict], kinds: dict) -> pa.Table:
    return table_of({c: ([r.get(c) for r in rows], kind) for c, kind in kinds.items()})


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [from_planes(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _replies(kind: int, bucket: int, table: pa.Table, flags: np.ndarray, keys=None, numbers=None) -> list[dict]:
    """A row for each group that has a flag, with the values of its flagged entries."""
    out, begin = [], 0
    for chunk, size in zip(table.column("chunk").to_pylist(), table.column("size").to_pylist()):
        own = flags[begin : begin + size]
        if own.any():
            row = {"kind": kind, "bucket": bucket, "chunk": chunk, "flags": bits(own)}
            if keys is not None:
                row |= {"keys": planes(keys[begin : begin + size][own]), "numbers": planes(numbers[begin : begin + size][own])}
            out.append(row)
        begin += size
    return out


def _answered(sent: _Sent, kind: int, n: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags, keys and line numbers that the buckets answered for what a group had sent."""
    flags = np.zeros(len(sent.line), dtype=bool)
    keys, numbers = np.full(len(flags), _LAST), np.zeros(len(flags), dtype=np.int32)
    rows = [r for r in replies.to_pylist() if r["kind"] == kind]
    parts = dealt(sent.columns[0], n) if rows else []
    for row in rows:
        own = parts[row["bucket"]]
        own = own[from_bits(row["flags"], len(own))]
        flags[own] = True
        if row["keys"] is not None:
            keys[own], numbers[own] = from_planes(row["keys"], np.int64), from_planes(row["numbers"], np.int32)
    return flags, keys, numbers


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """``docs`` with its text rebuilt, and ``n_lines``, ``n_removed`` and ``removed_lines``.

    A line of at least ``min_words`` words is removed when an earlier one, by integer key and
    place, has the same words or differs by one word added, dropped or replaced. That is judged on the input. ASCII letters compare
    without case, white space only separates words. Lines end with ``\\n``; the
    kept ones are joined by it unchanged. A null text stays null without lines, an empty one is one
    empty line. A row without a key is unchanged and removes nothing. Rows that repeat a key have the order of their
    lines' places; neither of two lines of the same key and place removes the other. Columns
    of the input named like one of the three are replaced; all others stay.
    """
    added = ["n_lines", "n_removed", "removed_lines"]
    columns = [c for c in docs.columns if c not in added]
    key_at, text_at = f"_{columns.index(key)}", f"_{columns.index(text)}"
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)))
    size = rows.agg(F.sum(F.octet_length(text_at))).first()[0] or 0
    n = max(1, -(-size // group_bytes))
    groups = rows.withColumn("chunk", F.pmod(F.xxhash64(key_at, text_at), F.lit(n)).cast("int"))

    def lines_of(table: pa.Table) -> _Lines:
        keys = table.column(key_at).combine_chunks().cast(pa.int64())
        return _Lines(keys, table.column(text_at).combine_chunks(), min_words)

    def first_round(lines: _Lines) -> tuple[_Sent, _Sent, np.ndarray, np.ndarray]:
        whole = _Sent(lines, np.arange(len(lines.begin)), lines.digest, lines.second)
        h, owner = lines.halves()
        halves = _Sent(lines, owner, h)
        low = np.full(len(halves.line), np.iinfo(np.uint64).max, dtype=np.uint64)
        high = np.zeros(len(halves.line), dtype=np.uint64)
        np.minimum.at(low, halves.back, lines.digest[owner])
        np.maximum.at(high, halves.back, lines.digest[owner])
        return whole, halves, low, (low != high).astype(np.uint8)

    def send_lines(chunk, table):
        lines, number = lines_of(table), chunk[0].as_py()
        whole, halves, digest, several = first_round(lines)
        sent = whole.rows(_LINE, number, n, lines, {"seconds": whole.columns[1]})
        sent += halves.rows(_HALF, number, n, lines, {"seconds": digest, "several": several})
        for row in sent:
            if row["kind"] == _HALF:
                del row["keys"], row["numbers"]
        return _rows(sent, _SENT)

    def meet_lines(bucket, table):
        whole = table.filter(pa.array(np.asarray(table.column("kind")) == _LINE))
        halves = table.filter(pa.array(np.asarray(table.column("kind")) == _HALF))
        out = []
        if whole.num_rows:
            h, second = _column(whole, "hashes", np.uint64), _column(whole, "seconds", np.uint64)
            keys, numbers = _column(whole, "keys", np.int64), _column(whole, "numbers", np.int32)
            order = np.lexsort((numbers, keys, second, h))
            begins, group = _firsts(h[order], second[order])
            back = np.empty(len(order), dtype=np.int64)
            back[order] = group
            shared = np.diff(np.append(begins, len(order)))[back] > 1
            out += _replies(_LINE, bucket[0].as_py(), whole, shared, keys[order][begins][back], numbers[order][begins][back])
        if halves.num_rows:
            h, digest = _column(halves, "hashes", np.uint64), _column(halves, "seconds", np.uint64)
            several = _column(halves, "several", np.uint8).astype(bool)
            _, back = np.unique(h, return_inverse=True)
            low = np.full(back.max() + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
            high, any_several = np.zeros(len(low), dtype=np.uint64), np.zeros(len(low), dtype=bool)
            np.minimum.at(low, back, digest)
            np.maximum.at(high, back, digest)
            any_several[back[several]] = True
            out += _replies(_HALF, bucket[0].as_py(), halves, ((low != high) | any_several)[back])
        return _rows(out, _REPLY)

    def second_round(lines: _Lines, replies: pa.Table):
        """Earliest line of the same words for every line, and the variants that are sent."""
        whole, halves, _, _ = first_round(lines)
        _, keys, numbers = _answered(whole, _LINE, n, replies)
        own_key, own_number = lines.key[whole.line], lines.number[whole.line]
        sooner = (keys < own_key) | ((keys == own_key) & (numbers < own_number))
        keys, numbers = np.where(sooner, keys, own_key)[whole.back], np.where(sooner, numbers, own_number)[whole.back]
        later = (keys < lines.key) | ((keys == lines.key) & (numbers < lines.number))
        met, _, _ = _answered(halves, _HALF, n, replies)
        _, owner = lines.halves()
        candidate = np.zeros(len(lines.begin), dtype=bool)
        candidate[owner[met[halves.back]]] = True
        h, place, line = lines.variants(np.flatnonzero(candidate & ~later))
        return later, _Sent(lines, line, h, place), line

    def send_variants(chunk, table, replies):
        if not table.num_rows or not replies.num_rows:
            return _rows([], _SENT)
        lines = lines_of(table)
        _, variants, _ = second_round(lines, replies)
        return _rows(variants.rows(_VARIANT, chunk[0].as_py(), n, lines, {"places": variants.columns[1].astype(np.int32)}), _SENT)

    def meet_variants(bucket, table):
        h, place = _column(table, "hashes", np.uint64), _column(table, "places", np.int32)
        keys, numbers = _column(table, "keys", np.int64), _column(table, "numbers", np.int32)
        rank = np.empty(len(h), dtype=np.int64)
        by_order = np.lexsort((numbers, keys))
        rank[by_order] = np.arange(len(h))
        order = np.lexsort((rank, place, h))
        begins, slot = _firsts(h[order], place[order])
        _, group = _firsts(h[order])
        n_groups = group[-1] + 1
        none = len(h)
        lines_first, variants_first = np.full(n_groups, none), np.full(n_groups, none)
        ranks, is_line = rank[order], place[order] == 0
        np.minimum.at(lines_first, group[is_line], ranks[is_line])
        np.minimum.at(variants_first, group[~is_line], ranks[~is_line])
        slot_first = ranks[begins][slot]
        best = np.minimum(slot_first, np.where(is_line, variants_first[group], lines_first[group]))
        found = np.empty(len(h), dtype=np.int64)
        found[order] = best
        at = by_order[np.minimum(found, len(h) - 1)]
        sooner = (keys[at] < keys) | ((keys[at] == keys) & (numbers[at] < numbers))
        return _rows(_replies(_VARIANT, bucket[0].as_py(), table, sooner, keys[at], numbers[at]), _REPLY)

    names = [*columns, *added]
    schema = T.StructType(
        [T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(columns)]
        + [T.StructField(added[0], T.IntegerType()), T.StructField(added[1], T.IntegerType()), T.StructField(added[2], T.ArrayType(T.IntegerType()))]
    )

    def cut(chunk, table, replies):
        lines = lines_of(table)
        removed, variants, line = second_round(lines, replies)
        _, keys, numbers = _answered(variants, _VARIANT, n, replies)
        # what a group sent once may stand for several of its lines
        sent_key, sent_number = lines.key[variants.line], lines.number[variants.line]
        own = (keys > sent_key) | ((keys == sent_key) & (numbers >= sent_number))
        keys, numbers = np.where(own, sent_key, keys)[variants.back], np.where(own, sent_number, numbers)[variants.back]
        sooner = (keys < lines.key[line]) | ((keys == lines.key[line]) & (numbers < lines.number[line]))
        removed[line[sooner]] = True
        texts, counts, gone = [], [], []
        by_row: dict[int, list[int]] = {}
        for row, number in zip(lines.row[removed].tolist(), lines.number[removed].tolist()):
            by_row.setdefault(row, []).append(number)
        for row, value in enumerate(table.column(text_at).to_pylist()):
            own_lines = [] if value is None else value.split("\n")
            drop = sorted(by_row.get(row, []))
            counts.append(len(own_lines))
            gone.append(drop)
            left = set(drop)
            texts.append(value if not drop else "\n".join(x for i, x in enumerate(own_lines) if i not in left))
        out = table.drop_columns(["chunk"]).set_column(table.column_names.index(text_at), text_at, pa.array(texts, pa.string()))
        out = out.append_column(added[0], pa.array(counts, pa.int32()))
        out = out.append_column(added[1], pa.array([len(x) for x in gone], pa.int32()))
        return out.append_column(added[2], pa.array(gone, pa.list_(pa.int32())))

    sent = groups.groupBy("chunk").applyInArrow(send_lines, _SENT_SQL)
    met = sent.groupBy("bucket").applyInArrow(meet_lines, _REPLY_SQL)
    variants = groups.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(send_variants, _SENT_SQL)
    near = variants.groupBy("bucket").applyInArrow(meet_variants, _REPLY_SQL)
    replies = met.unionByName(near)
    result = groups.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(cut, schema)
    return result.toDF(*names)
