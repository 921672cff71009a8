"""Line dedup by a segment-partition edit join.

A line goes if an earlier line, in the order of doc_id and place, has the same text or is within `edits` insertions,
deletions or substitutions of code points.  Lines shorter than `shortest` code points always stay.

Each distinct line of length L is cut into edits + 1 segments of nearly equal length.  If two lines are within `edits`,
some segment of the shorter one stands unchanged in the longer one, near its place.  So a line is indexed by its own
segments and probes, for each length from L - edits to L, the substrings of itself that could be segments of a line of
that length: those whose start is off by no more edits than the segments before and after leave.  Index and probe entries
are hashes of (length, segment, substring); equal ones give candidate pairs, which are verified by the banded
bit-parallel edit distance: one machine word holds the 2 * edits + 1 diagonals, and a batch of pairs runs side by side.

Index and probe entries are dealt by their value to the tasks that pair them, 12 rows of two numbers for each line (with two
edits); nothing of them is broadcast or sent to the driver.  Equal lines are told by a 64-bit hash.  An entry that is frequent
within one run of lines (FREQUENT of about RUN) is marked: its rows are dealt by line rather than by entry, so that
no task gets all lines of one entry, and the mark tells the entry's own task to pass on what other runs sent there.

Entries that are marked or on which more than LIGHT pairs meet are not paired where they are dealt.  Each of their lines is
first verified against the earliest line that the entry lets it meet; a line that is near it goes, whatever else it meets.
The lines of an entry are then compared in tiles of at most 2 * TILE rows inside a task, by length and by counts of code point
pairs (an edit changes four of them at most), and only pairs that pass, with a line not known to go, are listed and verified.

Defined cases: null texts stay null, empty texts stay empty; rows that repeat both id and text are decided alike, and so
counted as one; a null id comes first, and texts of one id in the order of a hash; blanks count as text; lines are ended by
a line feed only.  Other columns pass through, but for n_chars, which is counted again where lines went.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, in_arrow, slices, small, unnamed
from .textbytes import PIECE, mix, powers, utf8

RUN, FREQUENT, HELD = 1 << 15, 16, 1 << 16
LIGHT, TILE, BUCKETS = 256, 2048, 64
#: Kinds of entry rows, in the low bits of their code: the mark of a frequent entry, an index entry (which is a probe too), a probe, and both dealt by line.
MARK, INDEX, PROBE, FAR_INDEX, FAR_PROBE = range(5)
_KEY = "_row_key"


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    length = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(length)])


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of some lengths; the later segments are the longer ones."""
    base, longer = length // (edits + 1), length % (edits + 1)
    first_long = edits + 1 - longer
    return i * base + np.maximum(0, i - first_long), base + (i >= first_long)


def line_spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(data, text, place, begin, end): the bytes of a batch and its lines in order; a null text has no lines."""
    data, offsets = utf8(column)
    feed = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, "right") - 1])
    begin = np.concatenate([offsets[:-1], feed + 1])
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end = np.where(last, offsets[owner + 1], np.append(begin[1:], 0) - 1) if len(owner) else begin
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    if column.null_count:
        there = column.is_valid().to_numpy(zero_copy_only=False)[owner]
        owner, place, begin, end = owner[there], place[there], begin[there], end[there]
    return data, owner, place, begin, end


def line_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, edits: int | None = None):
    """(h, length, index, probe) of lines: a hash, the code points, and with `edits` the entries.

    index has the shape (lines, edits + 1) and probe (lines, probes); a line probes its own index entries too, so these are not
    repeated in probe, where 0 stands for one out of bounds.  The lines are worked on in runs of about a megabyte.
    """
    n, parts = len(begin), []
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, begin[at] + PIECE, "right")))
        parts.append(_hash_run(data[begin[at] : end[to - 1]], begin[at:to] - begin[at], end[at:to] - begin[at], edits))
        at = to
    if not parts:
        parts = [_hash_run(data[:0], begin, end, edits)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hash_run(data: np.ndarray, begin: np.ndarray, end: np.ndarray, edits: int | None):
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where code points begin
    base = np.searchsorted(lead, begin)
    length = np.searchsorted(lead, end) - base
    h = mix((total[end] - total[begin]) * down[begin] + length.astype(np.uint64))
    if edits is None:
        return h, length

    def hashed(start, size, l, i):
        a, b = lead[base + start], lead[base + start + size]
        return mix(mix((total[b] - total[a]) * down[a]) + l.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))

    index = [hashed(*segment(length, i, edits), length, i) for i in range(edits + 1)]
    probe = []
    for shorter in range(edits + 1):
        l = length - shorter
        for i in range(edits + 1):
            start, size = segment(np.maximum(l, 0), i, edits)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for off in range(low, high + 1):
                if shorter == off == 0:
                    continue
                at = start + off
                ok = (l > edits) & (at >= 0) & (at + size <= length)
                probe.append(np.where(ok, hashed(np.where(ok, at, 0), np.where(ok, size, 0), l, i), np.uint64(0)))
    return h, length, np.stack(index, axis=1), np.stack(probe, axis=1)


def entries(texts: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, probe) of some lines."""
    data, _, _, begin, end = line_spans(pa.array(texts, pa.string()))
    return line_hashes(data, begin, end, edits)[2:]


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair is within `edits`, by the banded bit-parallel edit distance."""
    a, a_at = code_points(left)
    b, b_at = code_points(right)
    m, n = np.diff(a_at), np.diff(b_at)
    distance = np.full(len(m), edits, np.int64)
    one, width = np.uint64(1), 2 * edits + 1
    band = np.uint64((1 << width) - 1)
    up = np.full(len(m), ((1 << (edits + 1)) - 1) << edits, np.uint64)  # +1 steps down the first column
    down = np.zeros(len(m), np.uint64)
    live = np.flatnonzero(np.abs(m - n) <= edits)
    a = np.append(a, np.uint32(0))
    for j in range(int(n.max(initial=0))):
        live = live[n[live] > j]
        if not len(live):
            break
        sign, same = b[b_at[live] + j], np.zeros(len(live), np.uint64)
        for k in range(width):  # bit k is row j + 1 - edits + k
            row = j - edits + k
            ok = (row >= 0) & (row < m[live])
            same |= (ok & (a[np.where(ok, a_at[live] + row, 0)] == sign)).astype(np.uint64) << np.uint64(k)
        vp, vn = up[live], down[live]
        diagonal = ((((same & vp) + vp) ^ vp) | same | vn) & band
        hp, hn = (vn | ~(diagonal | vp)) & band, diagonal & vp
        bottom = j + 1 + edits <= m[live]
        place = np.clip(m[live] - (j + 1) + edits, 0, width - 1).astype(np.uint64)
        step = np.where(bottom, 1 - (diagonal >> np.uint64(width - 1) & one).astype(np.int64), (hp >> place & one).astype(np.int64) - (hn >> place & one).astype(np.int64))
        distance[live] += step
        shifted = diagonal >> one
        up[live], down[live] = (hn | ~(shifted | hp)) & band, shifted & hp
    # lines of fewer code points than the band begin on the last row: the first column already is the distance to it
    start = np.minimum(m, edits)
    return (np.abs(m - n) <= edits) & (distance - edits + start <= edits)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with a hash of id and text, which names a row."""
    return docs.withColumn(_KEY, F.xxhash64(F.col(id_col), F.col(text_col)))


def counting_lines(batch: pa.RecordBatch, text_col: str, shortest: int):
    """(data, text, place, begin, end) of the lines of a batch that may count: a line has no more code points than bytes."""
    data, text, place, begin, end = line_spans(batch.column(text_col))
    long = end - begin >= shortest
    return data, text[long], place[long], begin[long], end[long]


def line_places(docs: DataFrame, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, place, h) of the lines that count."""

    def run(batches):
        for batch in slices(batches, text_col):
            data, text, place, begin, end = counting_lines(batch, text_col, shortest)
            h, length = line_hashes(data, begin, end)
            counts = length >= shortest
            text = pa.array(text[counts])
            made = [pa.array(place[counts].astype(np.int32)), pa.array(h[counts].view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), *made], ["doc_id", "row_key", "place", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).select(id_col, _KEY, text_col).transform(in_arrow, run, f"doc_id {kind}, row_key long, place int, h long")


def line_entries(docs: DataFrame, edits: int, shortest: int, text_col: str) -> DataFrame:
    """(code, h): a row for each entry of each distinct line of a run of lines; the code is entry and kind (see MARK)."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, index, probe = (np.concatenate(x) for x in zip(*held, strict=True))
        h, once = np.unique(h, return_index=True)
        entry = np.concatenate([index[once], probe[once]], axis=1)
        kind = np.broadcast_to(np.where(np.arange(entry.shape[1]) < index.shape[1], INDEX, PROBE), entry.shape)
        line = np.broadcast_to(np.arange(len(h))[:, None], entry.shape)[entry != 0]
        entry, kind = entry[entry != 0] >> np.uint64(3), kind[entry != 0]
        values, of, count = np.unique(entry, return_inverse=True, return_counts=True)
        far, marks = count[of] >= FREQUENT, values[count >= FREQUENT]
        code = np.concatenate([entry << np.uint64(3) | (kind + (FAR_INDEX - INDEX) * far).astype(np.uint64), marks << np.uint64(3)])
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.concatenate([h[line], marks]).view(np.int64))], ["code", "h"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches, text_col):
            data, _, _, begin, end = counting_lines(batch, text_col, shortest)
            h, length, index, probe = line_hashes(data, begin, end, edits)
            counts = length >= shortest
            held.append((h[counts], index[counts], probe[counts]))
            if sum(len(x[0]) for x in held) > RUN:
                yield sent(held)
                held = []
        if held:
            yield sent(held)

    return docs.select(text_col).transform(in_arrow, run, "code long, h long")


def meetings(entries: DataFrame) -> DataFrame:
    """(entry, x, y): pairs x < y of lines that meet on an entry (entry null), and the lines x of crowded entries, y 1 if x only probes."""
    kind = F.col("code").bitwiseAND(F.lit(7))
    dealt = entries.repartition(F.when(kind >= FAR_INDEX, F.col("h")).otherwise(F.shiftright("code", 3))).sortWithinPartitions("code")

    def rows(entry: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        first = pa.nulls(len(x), pa.int64()) if entry is None else pa.array(entry)
        return pa.RecordBatch.from_arrays([first, pa.array(x), pa.array(y)], ["entry", "x", "y"])

    def crowded(entry: np.ndarray, kind: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        lines = kind != MARK
        return rows(entry[lines], h[lines], ((kind == PROBE) | (kind == FAR_PROBE))[lines].astype(np.int64))

    def paired(entry: np.ndarray, kind: np.ndarray, h: np.ndarray):
        """What becomes of whole entries; the rows of an entry are in the order of their kinds."""
        first = np.concatenate([[0], np.flatnonzero(entry[1:] != entry[:-1]) + 1])
        size = np.diff(np.append(first, len(entry)))
        total = lambda which: np.add.reduceat((kind == which).astype(np.int64), first)
        indexed = total(INDEX)
        pairs = indexed * (indexed - 1) // 2 + indexed * total(PROBE)
        full = np.repeat((pairs > LIGHT) | (total(MARK) > 0), size) | (kind >= FAR_INDEX)
        yield crowded(entry[full], kind[full], h[full])
        last = np.repeat(first + indexed + total(PROBE), size)  # without marks, index entries and probes come first
        live, far, out = np.flatnonzero((kind == INDEX) & ~full & (np.repeat(pairs, size) > 0)), 1, []
        while len(live := live[live + far < last[live]]):
            a, b = h[live], h[live + far]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])
            far += 1
        if out:
            yield rows(None, *np.unique(np.concatenate(out, axis=1), axis=1))

    def run(batches):
        held, passed = None, None
        for batch in batches:
            code, h = (batch.column(c).to_numpy() for c in ("code", "h"))
            if held is not None:
                code, h = np.concatenate([held[0], code]), np.concatenate([held[1], h])
            entry, kind = code >> 3, code & 7
            if passed is not None and len(entry) and (more := int(np.searchsorted(entry, passed, "right"))):
                yield crowded(entry[:more], kind[:more], h[:more])
                code, h, entry, kind = code[more:], h[more:], entry[more:], kind[more:]
            if not len(code):
                held = None
                continue
            cut = int(np.searchsorted(entry, entry[-1]))
            if cut:
                yield from paired(entry[:cut], kind[:cut], h[:cut])
            held = code[cut:], h[cut:]
            if len(held[0]) > HELD:  # far more than LIGHT pairs
                passed, held = entry[-1], None
                yield crowded(entry[cut:], kind[cut:], h[cut:])
        if held is not None:
            yield from paired(held[0] >> 3, held[0] & 7, held[1])

    return dealt.transform(in_arrow, run, "entry long, x long, y long")


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def leader_pairs(heavy: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b), a < b: each line of an entry and the earliest line that it meets there, if that is earlier."""
    rows = heavy.join(firsts.select("h", "first"), "h")
    own = F.struct("first", "h")
    leads = durable(rows.groupBy("entry").agg(F.min(own).alias("any"), F.min(F.when(~F.col("probes"), own)).alias("indexed")))
    lead = F.when(F.col("probes"), F.col("indexed")).otherwise(F.col("any"))
    later = rows.join(small(leads), "entry").withColumn("lead", lead).where(F.col("lead.first") < F.col("first"))
    return ordered(later.withColumn("y", F.col("lead.h")), "h", "y")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(h, n, counts binary): the length of a line and how often pairs of code points fall on each of BUCKETS, 255 at most."""

    def run(batches):
        for batch in slices(batches, "line"):
            data, at = code_points(batch.column("line").to_pylist())
            lines = len(at) - 1
            owner = np.repeat(np.arange(lines), np.diff(at))
            slot = (data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(26)
            inside = owner[1:] == owner[:-1]
            total = np.bincount((owner[1:] * BUCKETS + slot)[inside], minlength=lines * BUCKETS)
            blob = np.minimum(total, 255).astype(np.uint8).reshape(lines, BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(np.diff(at)), pa.array([x.tobytes() for x in blob], pa.binary())], ["h", "n", "counts"])

    return texts.transform(in_arrow, run, "h long, n long, counts binary")


def tile_pairs(lines: DataFrame, counts: DataFrame, gone: DataFrame, edits: int) -> DataFrame:
    """(a, b), a < b, of the lines of an entry whose lengths and counts may be within `edits`, unless both are in `gone`."""
    tiles = F.ceil(F.col("own") / TILE).cast("int")
    rows = lines.join(lines.groupBy("entry").agg(F.count(F.lit(1)).alias("own")), "entry").withColumn("tiles", tiles)
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    known = durable(counts.join(gone.withColumn("gone", F.lit(True)), "h", "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    rows = rows.select("entry", "h", "probes", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).join(known, "h")
    rows = rows.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j", "n", "h")

    def pairs(x: dict[str, np.ndarray]) -> np.ndarray:
        out, live, far = [], np.arange(len(x["h"])), 1
        while len(live := live[live + far < len(x["h"])]):
            live = live[x["n"][live + far] - x["n"][live] <= edits]  # lengths ascend: none further passes either
            other = live + far
            ok = ~(x["gone"][live] & x["gone"][other]) & ~(x["probes"][live] & x["probes"][other]) & ((x["i"][live] == x["j"][live]) | (x["tile"][live] != x["tile"][other]))
            a, b = live[ok], other[ok]
            ok = np.abs(x["counts"][a] - x["counts"][b]).sum(axis=1) <= 4 * edits
            out.append(np.stack([x["h"][a[ok]], x["h"][b[ok]]]))
            far += 1
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("entry", "i", "j", "tile", "h", "n", "gone", "probes")}
            x["counts"] = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            cut = np.flatnonzero((x["entry"][1:] != x["entry"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])) + 1
            edge = [0, *cut]
            for begin, end in zip(edge[:-1], edge[1:], strict=True):
                a, b = pairs({c: v[begin:end] for c, v in x.items()})
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["x", "y"])
            held = {c: v[edge[-1] :] for c, v in x.items()}
        if held is not None:
            a, b = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["x", "y"])

    return ordered(rows.transform(in_arrow, run, "x long, y long"), "x", "y")


def near_lines(docs: DataFrame, distinct: DataFrame, edits: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of distinct lines within `edits`: all pairs but, on crowded entries, some whose later line goes by another one."""
    firsts = distinct.select("h", "first")
    where = lambda rows: rows.distinct().join(firsts, "h").select("h", "first.row_key", "first.place")
    met = durable(meetings(line_entries(docs, edits, shortest, text_col)))
    light = met.where(F.col("entry").isNull()).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    passed = met.where(F.col("entry").isNotNull())
    crowded = durable(passed.groupBy("entry").agg(F.min("y").alias("least")).where("least = 0").select("entry"))  # the others have probes only
    n_crowded = crowded.count()
    if not n_crowded:
        pairs, links = durable(light), None
    else:
        heavy = passed.join(small(crowded, n_crowded), "entry").groupBy("entry", F.col("x").alias("h")).agg((F.min("y") > 0).alias("probes"))
        heavy = durable(heavy)
        texts = durable(texts_of(docs, where(heavy.select("h")), id_col, text_col))
        links = durable(verified(leader_pairs(heavy, firsts), texts, edits))
        order = links.join(firsts.select(F.col("h").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("h").alias("b"), F.col("first").alias("fb")), "b")
        gone = order.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct()
        pairs = durable(light.union(tile_pairs(heavy, pair_counts(texts), gone, edits)).distinct())
    near = verified(pairs, texts_of(docs, where(pairs.select(F.explode(F.array("a", "b")).alias("h"))), id_col, text_col), edits)
    return near if links is None else near.union(links).distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, line) of the lines `wanted` (h, row_key, place), read from the documents that hold them."""
    by_row = durable(wanted.groupBy(F.col("row_key").alias("w_key")).agg(F.collect_list(F.struct("place", "h")).alias("places")))
    lines = by_row.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]  # a row has as many places as its text has lines
    held = keyed(docs, id_col, text_col).join(small(by_row, lines), F.col(_KEY) == F.col("w_key")).select(text_col, "places")

    def run(batches):
        for batch in slices(batches, text_col):
            found = [(p["h"], parts[p["place"]]) for text, places in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) for parts in [text.split("\n")] for p in places]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([line for _, line in found], pa.string())], ["h", "line"])

    return held.transform(in_arrow, run, "h long, line string").dropDuplicates(["h"])


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs whose lines are within `edits`."""

    def run(batches):
        for batch in slices(batches, "x"):
            near = within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), edits)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").transform(in_arrow, run, "a long, b long")


def judged_lines(docs: DataFrame, edits: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """(h, f_key, f_place, near) of the distinct lines of which a copy goes: f_* is the first place, near whether that goes too."""
    first = F.struct("doc_id", "row_key", "place")
    found = line_places(docs, shortest, id_col, text_col)
    # rows that repeat id and text repeat (row_key, place); such lines go nowhere by themselves
    many = (F.max("row_key") != F.min("row_key")) | (F.max("place") != F.min("place"))
    distinct = durable(found.groupBy("h").agg(F.min(first).alias("first"), many.alias("many")))
    firsts = distinct.select("h", "first", "many")
    near = near_lines(docs, distinct, edits, shortest, id_col, text_col)
    both = near.union(near.select("b", "a")).toDF("h", "other").join(firsts.select(F.col("h").alias("other"), F.col("first").alias("earliest")), "other")
    earlier = both.groupBy("h").agg(F.min("earliest").alias("earliest"))
    judged = firsts.join(earlier, "h", "left").withColumn("near", F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)))
    return judged.where(F.col("near") | F.col("many")).select("h", F.col("first.row_key").alias("f_key"), F.col("first.place").alias("f_place"), "near")


def _rebuilt(batch: pa.RecordBatch, names: list[str], text_col: str, gone, spans) -> pa.RecordBatch:
    """The batch's columns `names` without the lines marked in `gone`, and n_lines, n_dropped."""
    data, text, place, begin, end = spans
    n = batch.num_rows
    lines, dropped = np.bincount(text, minlength=n), np.bincount(text[gone], minlength=n)
    column = batch.column(text_col)
    if dropped.any():
        raw, texts = data.tobytes(), column.to_pylist()
        first = np.searchsorted(text, np.arange(n + 1))
        for i in np.flatnonzero(dropped):
            own = range(first[i], first[i + 1])
            texts[i] = b"\n".join(raw[begin[k] : end[k]] for k in own if not gone[k]).decode()
        column = pa.array(texts, pa.string())
    made = {"n_lines": pa.array(lines.astype(np.int32)), "n_dropped": pa.array(dropped.astype(np.int32)), text_col: column}
    return pa.RecordBatch.from_arrays([made.get(c, batch.column(c) if c in batch.schema.names else None) for c in names], names)


def dedup(docs: DataFrame, edits: int = 2, shortest: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the lines that repeat an earlier one taken out of the text, and n_lines, n_dropped (int).

    Other columns may have any names; n_lines and n_dropped replace columns of these names, and n_chars follows the text.
    """
    plain, names = unnamed(docs.drop("n_lines", "n_dropped"))
    out = _deduped(plain, edits, max(shortest, edits + 1), names[id_col], names[text_col]).toDF(*names, "n_lines", "n_dropped")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def _deduped(docs: DataFrame, edits: int, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """`dedup` of a table whose columns have plain names."""
    judged = durable(judged_lines(docs, edits, shortest, id_col, text_col))
    names = [*docs.columns, "n_lines", "n_dropped"]
    own = [c for c in docs.columns if c != text_col]
    shape = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns], "n_lines int, n_dropped int"])
    rows = keyed(docs, id_col, text_col)
    if judged.count() <= BROADCAST_ROWS:
        table = judged.toPandas().sort_values("h")
        known = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("h", "f_key", "f_place", "near")))

        def run(batches):
            keys, f_key, f_place, near = known.value
            for batch in slices(batches, text_col):
                spans = line_spans(batch.column(text_col))
                data, text, place, begin, end = spans
                gone, long = np.zeros(len(text), bool), np.flatnonzero(end - begin >= shortest)
                h, length = line_hashes(data, begin[long], end[long])
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                if len(keys):
                    key = np.asarray(batch.column(_KEY))[text[long]]
                    is_first = (key == f_key[at]) & (place[long] == f_place[at])
                    gone[long] = (length >= shortest) & (keys[at] == h) & (near[at] | ~is_first)
                yield _rebuilt(batch, names, text_col, gone, spans)

        out = rows.select(*own, text_col, _KEY).transform(in_arrow, run, shape)
    else:
        lines = line_places(docs, shortest, id_col, text_col).select("row_key", "place", "h").join(judged, "h")
        is_first = (F.col("row_key") == F.col("f_key")) & (F.col("place") == F.col("f_place"))
        gone_places = lines.where(F.col("near") | ~is_first).groupBy(F.col("row_key").alias("_g_key")).agg(F.collect_set("place").alias("_gone"))

        def run(batches):
            for batch in slices(batches, text_col):
                spans = line_spans(batch.column(text_col))
                gone, first = np.zeros(len(spans[1]), bool), np.searchsorted(spans[1], np.arange(batch.num_rows))
                for i, places in enumerate(batch.column("_gone").to_pylist()):
                    if places:
                        gone[first[i] + np.array(places)] = True
                yield _rebuilt(batch, names, text_col, gone, spans)

        out = rows.join(gone_places, F.col(_KEY) == F.col("_g_key"), "left").select(*own, text_col, "_gone").transform(in_arrow, run, shape)
    return out


def keep(docs: DataFrame, edits: int = 2, shortest: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`dedup` with the columns of `docs`, without the documents all of whose lines went."""
    plain, names = unnamed(docs)
    if "n_chars" in names:
        plain, names["n_chars"] = plain.withColumnRenamed(names["n_chars"], "n_chars"), "n_chars"
    left = dedup(plain, edits, shortest, names[id_col], names[text_col]).where("n_dropped = 0 or n_dropped < n_lines")
    return left.select(*names.values()).toDF(*docs.columns)
