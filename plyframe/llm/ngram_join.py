"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word n-grams columns of an incidence matrix; entry (x, y) of its product with its transpose is the
overlap of x and y.  Two sets link when 100 * overlap >= percent * union, so sizes bound the overlap that is needed.

1. Equal sets are one row of the matrix (a *node*); all counts below are of nodes.
2. Columns are ordered rare first by a document-frequency sketch of fixed size (any order gives the same result).  A pair
   that links must meet in the first columns of both rows, whose number follows from the sizes, so only that block of
   columns is multiplied at first: rows that share a column meet in blocks of at most BLOCK by BLOCK rows, and a pair is
   dropped whose sizes, whose places in the two rows (even if all columns before are shared) or whose parities (128 bits that
   each n-gram flips one of: rows differ in as many n-grams as bits, at least) leave too little overlap.
   The partial overlaps of the block are summed by pair and bounded once more, by the places of the last shared column
   too; then the remaining columns of the surviving pairs are multiplied.
3. Families of near copies would meet in all pairs.  Rows in a column of HEAVY rows and more are therefore first clustered:
   each goes with its whole row to two buckets, drawn by smallest hash from its heavy columns, and is multiplied with the
   bucket's leaders only (rows no leader has linked so far).  Links found there are true links; step 2 then leaves
   out pairs that are already connected and columns all of whose rows are.
4. Links are closed to components by stars; no link, component or fingerprint is collected.

Node ids are 64-bit hashes of the whole set, n-grams are compared by 64-bit hashes.

Defined cases: texts without words (null, empty, blank) are empty sets and link with nothing; a text of fewer words than
n is one n-gram; repeated rows and ids are rows of their own, linked if their sets are; a component's id is its smallest
doc_id (null only if all are null); other columns pass through `distinct_documents` and are ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_arrow, slices, small, unnamed
from .components import components
from .textbytes import mix, shingles, utf8, words

HEAVY, BLOCK, BUCKET_NGRAMS, SKETCH_BITS, LANES = 64, 1024, 2_000_000, 22, 64
_ROWS = 1 << 16


@dataclass(frozen=True)
class Bounds:
    """What a similarity of percent / 100 asks of sizes: integer arithmetic throughout."""

    percent: int

    def least(self, n):
        """The overlap that a set of n needs with any larger or equal one."""
        return -(-self.percent * n // 100)

    def overlap(self, n, m):
        """The overlap that sets of n and m need."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def first(self, n):
        """Columns of the first block of a row, as the larger one of a pair."""
        return n - self.least(n) + 1

    def first_small(self, n):
        """Columns of the first block of a row, as the smaller one of a pair."""
        return n - self.overlap(n, n) + 1


def node_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sets(column: pa.Array, n: int) -> list[np.ndarray]:
    data, offsets = utf8(column)
    word, first = words(data, offsets)
    return [shingles(word[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)]


def frequency_sketch(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """For each value of the leading SKETCH_BITS bits of an n-gram's hash, how often it occurs (at most 255 from one task)."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in slices(batches, text_col):
            found = [np.zeros(0, np.uint64), *sets(batch.column(text_col), n)]
            at, count = np.unique(np.concatenate(found) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            at = at.astype(np.int64)
            total[at] = np.minimum(total[at] + np.minimum(count, 255), 255)
        blobs = [packed(x) for x in total.astype(np.uint8).reshape(-1, _ROWS)]
        rows = np.flatnonzero([len(x) > 0 for x in blobs])
        lane = np.full(len(rows), TaskContext.get().partitionId() % LANES, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(lane), pa.array([blobs[i] for i in rows], pa.binary())], ["rows", "lane", "counts"])

    def packed(x: np.ndarray) -> bytes:
        """The counts of a block, or where that is shorter the places and counts that are not 0."""
        at = np.flatnonzero(x)
        return x.tobytes() if 3 * len(at) >= _ROWS else at.astype(np.uint16).tobytes() + x[at].tobytes()

    def first(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_ROWS, np.uint32)
        for x in group["counts"]:
            if len(x) == _ROWS:
                total += np.frombuffer(x, np.uint8)
            else:
                n = len(x) // 3
                total[np.frombuffer(x[: 2 * n], np.uint16)] += np.frombuffer(x[2 * n :], np.uint8)
        return pd.DataFrame({"rows": [group["rows"].iloc[0]], "lane": [0], "counts": [total.tobytes()]})

    def second(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32) for x in group["counts"])
        return pd.DataFrame({"rows": [group["rows"].iloc[0]], "lane": [0], "counts": [total.astype(np.uint32).tobytes()]})

    shape = "rows int, lane int, counts binary"
    parts = docs.select(text_col).transform(in_arrow, run, shape).groupBy("rows", "lane").applyInPandas(first, shape)
    out = np.zeros((1 << SKETCH_BITS) // _ROWS * _ROWS, np.uint32)
    for row in parts.groupBy("rows").applyInPandas(second, shape).toPandas().itertuples():
        out[row.rows * _ROWS : (row.rows + 1) * _ROWS] = np.frombuffer(row.counts, np.uint32)
    return out


def parities(s: np.ndarray) -> tuple[int, int]:
    """Whether an even or odd number of a set's n-grams falls on each of 128 bits: sets differ in as many n-grams as bits, at least."""
    own = (s >> np.uint64(6)) & np.uint64(1)
    flip = lambda part: int(np.bitwise_xor.reduce(np.uint64(1) << (part & np.uint64(63)), initial=np.uint64(0)).view(np.int64))
    return flip(s[own == 0]), flip(s[own == 1])


def first_columns(docs: DataFrame, sketch: np.ndarray, n: int, bounds: Bounds, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(doc_id, node, n, bits, bits2, tokens) of each document: its set's id (null if empty), size, parities and first block of columns.

    With `row_col`, a long column, also that as row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        count = shared.value
        for batch in slices(batches, text_col):
            node, size, bits, tokens = [], [], [], []
            for s in sets(batch.column(text_col), n):
                node.append(node_of(s) if len(s) else None)
                size.append(len(s))
                bits.append(parities(s))
                order = np.lexsort((s, count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                tokens.append(s[order[: bounds.first(len(s)) if len(s) else 0]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
            more = [batch.column(row_col)] if row_col else []
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *[pa.array([b[i] for b in bits], pa.int64()) for i in (0, 1)], lists, *more], ["doc_id", "node", "n", "bits", "bits2", "tokens", "row"][: 6 + len(more)])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, node long, n long, bits long, bits2 long, tokens array<long>" + (", row long" if row_col else "")
    return docs.select(id_col, text_col, *([row_col] if row_col else [])).transform(in_arrow, run, shape)


def rows_of(docs: DataFrame, owners: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, row binary): the whole sets of the nodes `wanted`, computed again from one document (least) of each."""
    chosen = durable(owners.join(wanted.distinct(), "node").select("node", F.col("least").alias("own_id")))
    ids = chosen.select("own_id").distinct()
    texts = docs.select(F.col(id_col), text_col).join(small(ids), F.col(id_col).eqNullSafe(F.col("own_id"))).select(text_col)

    def run(batches):
        for batch in slices(batches, text_col):
            found = [s for s in sets(batch.column(text_col), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "row"])

    return texts.transform(in_arrow, run, "node long, row binary").join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])


def cluster(percent: int):
    """Links of one bucket of rows: each row that no leader has linked so far leads, and is multiplied with all rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        rows = [np.frombuffer(r, np.uint64) for r in group["row"]]
        node, size = group["node"].to_numpy(), np.array([len(r) for r in rows])
        _, column = np.unique(np.concatenate(rows), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        linked, u, v = np.zeros(len(node), bool), [], []
        for lead in np.argsort(size, kind="stable"):
            if linked[lead]:
                continue
            mark = np.zeros(column.max() + 1, np.int64)
            mark[column[starts[lead] : starts[lead] + size[lead]]] = 1
            overlap = np.add.reduceat(mark[column], starts)
            hit = 100 * overlap >= percent * (size + size[lead] - overlap)
            hit[lead] = False
            linked |= hit
            u.append(node[hit])
            v.append(np.full(hit.sum(), node[lead]))
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    return run


def heavy_links(docs: DataFrame, owners: DataFrame, heavy: DataFrame, n: int, bounds: Bounds, id_col: str, text_col: str) -> DataFrame:
    """True links (u, v) between rows of heavy columns (node, h, total), enough to connect most of each family."""
    pick = lambda seed: F.min_by(F.struct("h", "total"), F.xxhash64("h", F.lit(seed)))
    picked = heavy.groupBy("node").agg(F.array(pick(1), pick(2)).alias("picks"))
    picked = picked.select("node", F.posexplode("picks").alias("lane", "p")).select("node", "lane", "p.h", "p.total")
    parts = F.ceil(F.col("total") / BUCKET_NGRAMS)
    picked = durable(picked.withColumn("part", F.pmod(F.xxhash64("node", "lane"), parts)).select("node", "lane", "h", "part"))
    rows = rows_of(docs, owners, picked.select("node"), n, id_col, text_col)
    return picked.join(rows, "node").groupBy("lane", "h", "part").applyInPandas(cluster(bounds.percent), "u long, v long")


def partial_products(columns: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b, na, nb, shared) of the pairs of unconnected rows, a the smaller, that the first block leaves possible."""
    mixed = columns.groupBy("h").agg(F.count(F.lit(1)).alias("own"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("h", "own")
    mixed = durable(mixed)
    blocks = F.ceil(F.col("own") / BLOCK).cast("int")
    rows = columns.join(mixed, "h").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("h", "i", "j", "block", "n", "node", "pos", "comp", "bits", "bits2").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "node")

    def pairs(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = (x["h"][1:] != x["h"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        out, live, far = [], np.arange(len(group)), 1
        while len(live := live[live + far < len(group)]):
            live = live[group[live] == group[live + far]]
            live = live[100 * x["n"][live] >= bounds.percent * x["n"][live + far]]  # sizes ascend: none further passes either
            a, b = live, live + far
            ok = (x["comp"][a] != x["comp"][b]) & (x["node"][a] != x["node"][b]) & ((x["i"][a] == x["j"][a]) | (x["block"][a] != x["block"][b]))
            ok &= x["pos"][a] < bounds.first_small(x["n"][a])
            seen, room = np.minimum(x["pos"][a], x["pos"][b]), np.minimum(x["n"][a] - x["pos"][a], x["n"][b] - x["pos"][b])
            ok &= seen + room >= bounds.overlap(x["n"][a], x["n"][b])  # at any shared column, of all that may lie before it and from it on
            apart = sum(np.bitwise_count((x[c][a] ^ x[c][b]).view(np.uint64)).astype(np.int64) for c in ("bits", "bits2"))
            ok &= x["n"][a] + x["n"][b] - apart >= 2 * bounds.overlap(x["n"][a], x["n"][b])
            out.append(np.stack([a[ok], b[ok], room[ok]]))
            far += 1
        a, b, room = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x["node"][a]), pa.array(x["node"][b]), pa.array(x["n"][a]), pa.array(x["n"][b]), pa.array(room)], ["a", "b", "na", "nb", "room"])

    def run(batches):
        held = None
        for batch in batches:
            x = {name: np.asarray(batch.column(name)) for name in batch.schema.names}
            if held is not None:
                x = {name: np.concatenate([held[name], x[name]]) for name in x}
            last = np.flatnonzero((x["h"] != x["h"][-1]) | (x["i"] != x["i"][-1]) | (x["j"] != x["j"][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = {name: v[cut:] for name, v in x.items()}
            if cut:
                yield pairs({name: v[:cut] for name, v in x.items()})
        if held is not None:
            yield pairs(held)

    found = rows.transform(in_arrow, run, "a long, b long, na long, nb long, room long").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"), F.min("room").alias("room"))
    needed = F.ceil(F.lit(bounds.percent) * (F.col("na") + F.col("nb")) / F.lit(100 + bounds.percent))
    rest = F.greatest(F.ceil(F.lit(2 * bounds.percent) * F.col("na") / F.lit(100 + bounds.percent)), F.ceil(F.lit(bounds.percent) * F.col("nb") / F.lit(100))) - 1
    # room is that of the last shared column: beyond the shared ones no more can follow than lie behind it
    return found.where((F.col("shared") + rest >= needed) & (F.col("shared") + F.col("room") - 1 >= needed)).drop("room")


def full_products(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) among candidate pairs, by their whole rows."""

    def run(batches):
        for batch in batches:
            hit = []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                overlap = int((both[1:] == both[:-1]).sum())
                hit.append(100 * overlap >= percent * (len(a) + len(b) - overlap))
            yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    with_b = pairs.select("a", "b").join(rows.select(F.col("node").alias("b"), F.col("row").alias("y")), "b")
    both = with_b.join(rows.select(F.col("node").alias("a"), F.col("row").alias("x")), "a")
    return both.select("a", "b", "x", "y").transform(in_arrow, run, "u long, v long")


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc_id, node, n_shingles, component_id) of every document, and links (u, v) between nodes.

    The links connect each component; between rows that they connect, further links are not listed.
    With `row_col` it is (keys, roots) instead: (node, doc_id, row, copies) of the distinct rows with words, and (node, root).
    """
    bounds = Bounds(percent)
    all_rows = durable(first_columns(docs, frequency_sketch(docs, n, text_col), n, bounds, id_col, text_col, row_col))
    members = all_rows.select("doc_id", "node", "n")
    # one row per node before any join on it: a node of many equal documents is then no hot key
    owners = durable(members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least")))
    nodes = durable(all_rows.where(F.col("node").isNotNull()).select("node", "n", "bits", "bits2", "tokens").dropDuplicates(["node"]))
    entries = nodes.select("node", "n", F.posexplode("tokens").alias("pos", "h"))
    # written before they are joined, so that both sides of a join are dealt anew and a hot column can be split
    shared = durable(entries.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1"))
    heavy, links = shared.where(F.col("m") >= HEAVY).select("h", "total"), None
    if n_heavy := heavy.count():
        links = durable(heavy_links(docs, owners, entries.join(small(heavy, n_heavy), "h"), n, bounds, id_col, text_col))
        nodes = nodes.join(small(components(links)), "node", "left").withColumn("comp", F.coalesce("root", "node"))
    else:
        nodes = nodes.withColumn("comp", F.col("node"))
    columns = nodes.select("node", "n", "bits", "bits2", "comp", F.posexplode("tokens").alias("pos", "h")).join(shared.select("h"), "h")
    columns = durable(columns)
    pairs = durable(partial_products(columns, bounds))
    rows = rows_of(docs, owners, pairs.select(F.explode(F.array("a", "b")).alias("node")), n, id_col, text_col)
    found = durable(full_products(pairs, rows, percent))
    links = found if links is None else found.unionByName(links)
    by_node = owners.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if row_col:
        # equal rows are one, with their number, and nodes meet their root by one row each: no hot key
        keys = durable(all_rows.where(F.col("node").isNotNull()).groupBy("node", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies")))
        return keys, by_node.select("node", "root")
    ids = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    component = durable(by_node.join(ids, "root").select("node", "component_id"))
    named = members.join(component, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return named.select("doc_id", "node", F.col("n").alias("n_shingles"), "component_id"), links


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """One row of `docs` of each component: that of the smallest doc_id (nulls last), of these the one of the smallest hash.

    Rows equal to it in all columns stay beside it only if `repeats`; texts without words stay.
    """
    plain, names = unnamed(docs)
    keyed = plain.withColumn("_row", F.xxhash64(*plain.columns))
    keys, roots = join(keyed, n, percent, names[id_col], names[text_col], "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "copies")).alias("first")
    by_node = keys.groupBy("node").agg(first)
    kept = by_node.join(roots, "node").groupBy("root").agg(F.min("first").alias("first"))
    kept = durable(kept.select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_key"), F.col("first.copies").alias("_copies")))
    same = lambda left, right: (left["_row"] == right["_key"]) & left[names[id_col]].eqNullSafe(right["_id"])
    gone = keys.select(F.col("doc_id").alias(names[id_col]), F.col("row").alias("_row"))
    gone = durable(gone.join(kept, same(gone, kept), "left_anti").select(F.col(names[id_col]).alias("_id"), F.col("_row").alias("_key")))
    left = keyed.join(small(gone), same(keyed, gone), "left_anti")
    several = durable(kept.where("_copies > 1").select("_id", "_key"))
    count = 0 if repeats else several.count()
    if count:
        once = left.join(small(several, count), same(left, several), "left_semi").dropDuplicates(["_row", names[id_col]])
        left = left.join(small(several, count), same(left, several), "left_anti").unionByName(once)
    return left.drop("_row").toDF(*docs.columns)
