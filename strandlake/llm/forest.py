"""Operator 7: near-duplicate documents by a MinHash LSH forest with exact verification.

Documents are sets of ``ngram``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text
with fewer words but one at least is one shingle).  Two documents are linked if their texts
are equal or the Jaccard similarity of their sets is ``threshold`` or more; classes are the
connected components of links.

1. Equal texts become one node.  A node's signature is ``trees`` labels of ``depth`` MinHash
values.  2. The labels of each tree, sorted, are a prefix trie: a scan of the sorted labels
tells for every label the longest prefix that it shares with another one (its matched
prefix), and the longest that more than ``crowd`` share.  3. Each node begins with whole labels
and shortens them one value at a time, tree by tree, until a partner at the threshold shares a
prefix with it in some tree with probability ``target``.  A tree whose shorter prefix is
crowded keeps the longer one, and the others are shortened further instead, so common
boilerplate makes no large buckets; if all trees are crowded (large groups of copies), the
crowded prefixes are taken after all.  4. The prefixes that some node has come to are the
buckets: every node under one is in it, whatever its own lengths.  5. Rows of a bucket are
sorted by range, so one that very many share spans several tasks; a scan ties each row to
leaders with a similar signature, which makes stars instead of pairs.  Leaders are not
capped.  6. Components of those ties are the candidate classes, cut into blocks bounded in
rows and bytes.  7. Inside a block all pairs are compared exactly, as one matrix product over
shared shingles; a block returns, for each node, the number of its links and its least
partner - never pairs.  8. Components of verified links are the result.

A row is tied to every leader of its buckets that agrees in ``TIE`` of the signature, and is a
leader itself unless one agrees in ``LEADER``.  So if x follows leader l and y agrees with x in
TIE + 1 - LEADER (0.65, four standard deviations below the threshold of 0.8) or more, y is
tied to l too: no partner is lost by the ties.

Special cases: null texts count as empty; texts without words are only linked to equal
texts; repeated rows are copies of each other; a null identifier is never the least of its
class unless all are null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, ship, slices, small, stage, text_bytes, text_hash, without_rows
from strandlake.llm.components import connected_components
from strandlake.llm.words import mix, split_words

#: Nodes in a chunk of a candidate class, and shingles (8 bytes each); a block compares two chunks.
CHUNK, CHUNK_SHINGLES = 768, 2 << 20
#: Signature agreement from which a row needs no leader of its own, and from which it is tied to one.
LEADER, TIE = 0.9, 0.55
#: Nodes that may share a prefix before it counts as crowded.
CROWD = 256


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix that finds a pair at the threshold with probability ``target``."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


def shingles(column: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, first) of each text, in order, repeats included."""
    words = split_words(column)
    h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = words.lengths()
    count = np.where(n >= ngram, n - ngram + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    size = np.repeat(np.minimum(n, ngram), count)
    prime = np.uint64(0x9E3779B97F4A7C15)
    acc = size.astype(np.uint64)
    for k in range(ngram):
        inside = size > k
        word = h[np.where(inside, begin + k, 0)] if len(h) else acc
        acc = np.where(inside, acc * prime + word, acc)
    return mix(acc), first


def signatures(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """uint16 MinHash values (texts x count) of texts with a shingle; ``first`` without empty texts."""
    rng = np.random.default_rng(20260101)
    a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, np.uint64)
    out = np.empty((len(first) - 1, count), np.uint16)
    group = max(1, len(first) - 1)
    at = 0
    while at < len(first) - 1:  # some texts at a time, to stay in the cache
        end = int(np.searchsorted(first, first[at] + 65536, "right")) - 1
        end = min(max(end, at + 1), group)
        part, starts = hashes[first[at] : first[end]], first[at:end] - first[at]
        for k in range(count):
            out[at:end, k] = (mix(np.minimum.reduceat((part ^ b[k]) * a[k], starts)) & np.uint64(0xFFFF)).astype(np.uint16)
        at = end
    return out


def shortened(crowded: np.ndarray, depth: int, threshold: float, target: float) -> np.ndarray:
    """Prefix lengths (nodes x trees) from the longest crowded prefix of each label.

    Lengths fall level by level and tree by tree, from ``depth`` on, where the shorter prefix
    is not crowded, until the probability that a partner at the threshold shares one of them
    reaches ``target``.  Where that never happens the same goes on among the crowded ones.
    """
    n, trees = crowded.shape
    threshold = min(threshold, 1 - 1e-9)
    out = np.full((n, trees), depth, np.int64)
    missed = np.full(n, trees * np.log1p(-(threshold**depth)))  # log of the probability to share none
    goal = np.log1p(-target)
    for free in (True, False):
        for level in range(depth - 1, 0, -1):
            gain = np.log1p(-(threshold**level)) - np.log1p(-(threshold ** np.arange(depth + 1.0)[1:]))
            for t in range(trees):
                go = (missed > goal) & (out[:, t] > level)
                if free:
                    go &= crowded[:, t] < level
                missed[go] += gain[out[go, t] - 1]
                out[go, t] = level
    return out


def scan_trie(trees: np.ndarray, labels: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """(matched, crowded) prefix lengths of sorted labels (rows x depth).

    The runs at either end may go on in other tasks: they count as shared, whatever their length.
    """
    n, depth = labels.shape
    same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
    same = np.where(trees[1:] == trees[:-1], same, -1)
    matched, crowded = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(1, depth + 1):
        starts = np.concatenate([[0], np.flatnonzero(same < level) + 1])
        sizes = np.diff(np.append(starts, n))
        shared = sizes > 1
        shared[[0, -1]] = True
        matched[np.repeat(shared, sizes)] = level
        crowded[np.repeat(sizes > crowd, sizes)] = level
    return matched, crowded


class _Run:
    """Rows of one bucket: ties each to the leaders with similar signatures."""

    def __init__(self, key: bytes, width: int):
        self.key, self.ids = key, []
        self.sigs = np.empty((8, width), np.uint16)

    def add(self, nid: int, sig: np.ndarray) -> list[int]:
        n = len(self.ids)
        like = (self.sigs[:n] == sig).mean(axis=1) if n else np.zeros(0)
        ties = [self.ids[i] for i in np.flatnonzero(like >= TIE)]
        if not n or like.max() < LEADER:
            if n == len(self.sigs):
                self.sigs = np.concatenate([self.sigs, np.empty_like(self.sigs)])
            self.sigs[n] = sig
            self.ids.append(nid)
        return [t for t in ties if t != nid]


def _ties(rows: DataFrame, width: int) -> DataFrame:
    """Ties ``a, b`` of the sorted rows ``key, nid, sig``: each node of a task and the least one it is tied to there, over all buckets.

    Ties are joined inside the task, so a task returns a row for a node at most, however many
    leaders it agrees with.  ``open`` rows (``key`` set, no ``b``) name a node of a task's first and last bucket,
    which other tasks may hold too: all leaders of such a bucket are tied.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first_key = None, None
        parent: dict[int, int] = {}
        at: list[bytes] = []
        who: list[int] = []

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def join(x: int, y: int) -> None:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)

        def close() -> None:
            for x in run.ids[1:]:
                join(x, run.ids[0])
            at.append(run.key), who.append(run.ids[0])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, width)
            for k, i, s in zip(keys, ids, sigs, strict=True):
                if run is None or run.key != k:
                    if run is not None and run.key == first_key:
                        close()
                    run = _Run(k, width)
                    first_key = k if first_key is None else first_key
                for t in run.add(i, s):
                    join(i, t)
        if run is not None:
            close()
            tied = [(x, find(x)) for x in list(parent)]
            tied = [(x, r) for x, r in tied if x != r]
            a, b = zip(*tied, strict=True) if tied else ((), ())
            for i in range(0, len(a), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_pydict({"key": pa.nulls(len(a[part]), pa.binary()), "a": pa.array(a[part], pa.int64()), "b": pa.array(b[part], pa.int64())})
            yield pa.RecordBatch.from_pydict({"key": pa.array(at, pa.binary()), "a": pa.array(who, pa.int64()), "b": pa.nulls(len(at), pa.int64())})

    return rows.mapInArrow(scan, "key binary, a long, b long")


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``comp, i, j, chunk, nid, n, s`` sorted by block to ``nid, links, root``: exact comparison of all pairs of a block."""

    share = Fraction(threshold).limit_denominator(1 << 20)

    def compare(block: list[tuple]) -> tuple[list, list, list]:
        i, j = block[0][1], block[0][2]
        seen: dict[int, tuple] = {x[4]: x for x in block}  # repeated rows of one text
        items = sorted(seen.values(), key=lambda x: (x[3], x[4]))
        ids, chunk = [x[4] for x in items], np.array([x[3] for x in items])
        copies = np.array([x[5] for x in items], np.float64)
        sets = [np.frombuffer(x[6], np.uint64) for x in items]
        sizes = np.array([len(s) for s in sets], np.int64)
        m = len(items)
        _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(m), sizes)
        column = np.cumsum(count > 1) - 1
        shared = count[where] > 1
        doc, col = doc[shared], column[where[shared]]
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        common = np.zeros((m, m), np.int64)
        step = max(64, (8 << 20) // max(1, m))
        total = int(col[-1]) + 1 if len(col) else 0
        for c in range(0, total, step):
            a, z = np.searchsorted(col, [c, c + step])
            held = np.zeros((m, min(step, total - c)), np.float32)
            held[doc[a:z], col[a:z] - c] = 1
            common += np.rint(held @ held.T).astype(np.int64)  # a strip is below 2^24 wide, so its counts are exact
        linked = share.denominator * common >= share.numerator * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= chunk[:, None] != chunk[None, :]
        links = linked @ copies
        root = np.arange(m)
        while True:  # least node reached, by propagation inside the block
            least = np.where(linked, root[None, :], m).min(axis=1)
            new = np.minimum(root, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        keep = np.flatnonzero(linked.any(axis=1))
        return [ids[k] for k in keep], [int(links[k]) for k in keep], [ids[root[k]] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush():
            got = pa.RecordBatch.from_pydict({"nid": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})
            for x in out:
                x.clear()
            return got

        def done():
            if len(block) > 1:
                for x, y in zip(out, compare(block), strict=True):
                    x += y

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and block[0][:3] != row[:3]:
                    done()
                    block = []
                block.append(row)
            yield flush()
        done()
        yield flush()

    return rows.mapInArrow(run, "nid long, links long, root long")


def _buckets(nodes: DataFrame, trees: int, depth: int, threshold: float, target: float, crowd: int, scratch: Scratch) -> DataFrame:
    """``key, nid``: the buckets of the forest, each a tree's number and a prefix, with two nodes or more under it."""
    size = 2 * depth
    each = f"explode(sequence(0, {trees - 1})) as t"
    labels = nodes.filter("sig is not null").selectExpr("nid", "sig", each).selectExpr("t", f"substring(sig, t * {size} + 1, {size}) as label", "nid")
    labels = labels.repartitionByRange("t", "label", "nid").sortWithinPartitions("t", "label")

    def found(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nid, t = (np.concatenate([np.asarray(b.column(k)) for b in got]) for k in (2, 0))
        rows = np.concatenate([text_bytes(b.column(1))[0] for b in got]).reshape(-1, size)
        matched, crowded = scan_trie(t, rows.view("<u2"), crowd)
        keep = np.flatnonzero(matched > 0)
        for a in range(0, len(keep), 1 << 16):
            k = keep[a : a + (1 << 16)]
            label = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows[k]))])
            yield pa.RecordBatch.from_arrays([pa.array(nid[k]), pa.array(t[k].astype(np.int32)), label, pa.array(matched[k].astype(np.int32)), pa.array(crowded[k].astype(np.int32))], names=["nid", "t", "label", "matched", "crowded"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for batch in batches:
            if batch.num_rows:
                got.append(batch)
                n += batch.num_rows
            if n >= 1 << 20:  # the runs at the cut count as shared, as those at the ends of a task do
                yield from found(got)
                got, n = [], 0
        if got:
            yield from found(got)

    matched = scratch.stage(labels.mapInArrow(scan, "nid long, t int, label binary, matched int, crowded int"), "forest-matched")

    # nodes without a crowded prefix among the lengths that they would come to all have the same lengths
    cold = [int(x) for x in shortened(np.zeros((1, trees), np.int64), depth, threshold, target)[0]]
    full = matched.filter(F.col("crowded") >= min(cold)).select("nid").distinct().withColumn("hot", F.lit(True))
    hot = scratch.stage(full, "forest-hot")
    at = F.element_at(F.array(*[F.lit(x) for x in cold]), F.col("t") + 1)
    plain = matched.join(small(hot), "nid", "left_anti").select("nid", "t", "label", "matched", at.alias("d"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            worst = np.zeros((len(rows), trees), np.int64)
            for i, row in enumerate(rows):
                for x in row:
                    worst[i, x["t"]] = x["crowded"]
            lengths = shortened(worst, depth, threshold, target)
            flat = [(n, x["t"], x["label"], x["matched"], int(lengths[i, x["t"]])) for i, (n, row) in enumerate(zip(batch.column(0).to_pylist(), rows, strict=True)) for x in row]
            n, t, label, m, d = zip(*flat, strict=True) if flat else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(t, pa.int32()), pa.array(label, pa.binary()), pa.array(m, pa.int32()), pa.array(d, pa.int32())], names=["nid", "t", "label", "matched", "d"])

    told = matched.join(small(hot), "nid").groupBy("nid").agg(F.collect_list(F.struct("t", "label", "matched", "crowded")).alias("x"))  # a row for each tree at most
    chosen = plain.unionByName(told.mapInArrow(choose, "nid long, t int, label binary, matched int, d int"))
    chosen = scratch.stage(chosen, "forest-chosen")

    # a bucket is named by its tree and prefix; all nodes under it are in it, each in its shortest bucket of a tree
    key = lambda d: F.concat(F.unhex(F.lpad(F.hex(F.col("t").cast("long")), 4, "0")), F.expr(f"substring(label, 1, 2 * {d})"))
    asked = chosen.filter("matched >= d").select("nid", "t", "d", key("d").alias("key"))
    if not hot.staged_rows:  # one length for each tree: a node is in its own bucket only
        return asked.select("key", "nid")
    lengths = sorted((r.t, r.d) for r in asked.select("t", "d").distinct().collect())  # trees x depth at most
    if not lengths:
        return asked.select("key", "nid").limit(0)
    per_tree = F.create_map(*[x for t in sorted({t for t, _ in lengths}) for x in (F.lit(t), F.array(*[F.lit(d) for u, d in lengths if u == t]))])
    wanted = scratch.stage(asked.select("key").distinct(), "forest-wanted-keys")
    under = chosen.withColumn("c", F.explode(F.try_element_at(per_tree, F.col("t")))).filter("c <= matched").select("nid", "t", "c", key("c").alias("key"))
    under = under.join(small(wanted), "key", "left_semi")
    return under.groupBy("nid", "t").agg(F.min_by("key", "c").alias("key")).select("key", "nid")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, trees: int = 20, depth: int = 8, target: float = 0.999, crowd: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, class_key, text_hash, text_hash2`` of every row.

    ``class_id`` is the least identifier of the class, ``class_key`` a number of its own, ``n_links`` the number of other rows
    linked to the row, copies included.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    width = trees * depth
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            hashes, first = shingles(batch.column(3), ngram)
            full = np.diff(first) > 0
            sigs = signatures(hashes, np.concatenate([first[:-1][full], first[-1:]]), width)
            column: list[bytes | None] = [None] * batch.num_rows
            for at, s in zip(np.flatnonzero(full).tolist(), sigs, strict=True):
                column[at] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(column, pa.binary()), pa.array(np.diff(first))], names=["doc_id", "h1", "h2", "sig", "size"])

    signed = rows.mapInArrow(sign, "doc_id long, h1 long, h2 long, sig binary, size long")
    nodes = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = scratch.stage(nodes.withColumn("nid", F.monotonically_increasing_id()), "forest-nodes")

    # ties of the buckets' rows
    entries = scratch.stage(_buckets(nodes, trees, depth, threshold, target, CROWD if crowd is None else crowd, scratch), "forest-entries")
    met = scratch.stage(entries.select("nid").distinct(), "forest-met")
    sigs = scratch.stage(nodes.join(small(met), "nid", "left_semi").select("nid", "sig"), "forest-signatures")
    entries = entries.join(small(sigs, 50_000), "nid").select("key", "nid", "sig").repartitionByRange("key", "nid").sortWithinPartitions("key", "nid")
    ties = scratch.stage(_ties(entries, width), "forest-ties")
    ends = ties.filter("b is null")
    ends = ends.join(ends.groupBy("key").agg(F.min("a").alias("m")), "key").select("a", F.col("m").alias("b"))
    edges = ties.filter("b is not null").select("a", "b").unionByName(ends).filter("a <> b")

    # candidate classes in blocks
    candidates = scratch.stage(connected_components(edges).withColumnRenamed("node", "nid").withColumnRenamed("component", "comp"), "forest-candidates")
    joined = candidates.join(nodes.select("nid", "h1", "h2", "least", "n", "size"), "nid")
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES), F.lit(1)).cast("int")
    sizes = scratch.stage(joined.groupBy("comp").agg(parts.alias("chunks")), "forest-sizes")
    wanted = joined.join(small(sizes), "comp").withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int")).drop("size")
    wanted = scratch.stage(wanted, "forest-wanted")
    found = rows.join(small(wanted), ["h1", "h2"]).filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("comp", "chunks", "chunk", "nid", "n", "t")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            hashes, first = shingles(batch.column(5), ngram)
            sets = [np.unique(hashes[a:z]).tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=["comp", "chunks", "chunk", "nid", "n", "s"])

    sets = found.mapInArrow(shingle, "comp long, chunks int, chunk int, nid long, n long, s binary")
    blocks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("comp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "nid", "n", "s")
    blocks = blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    verified = scratch.stage(_verify(blocks, threshold), "forest-verified")

    classes = connected_components(verified.select(F.col("nid").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("nid").agg(F.sum("links").alias("links"))
    best = classes.withColumnRenamed("node", "nid").join(links, "nid").join(nodes.select("nid", "least"), "nid")
    best = scratch.stage(best, "forest-classes")
    ids = scratch.stage(best.groupBy("component").agg(F.min("least").alias("class_least")), "forest-class-ids")
    best = best.join(small(ids), "component").select("nid", "component", "class_least", "links")
    final = nodes.select("nid", "h1", "h2", "least", "n").join(best, "nid", "left")
    final = final.select("h1", "h2", F.coalesce("class_least", "least").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "nid").alias("class_key"))
    final = scratch.stage(final, "forest-final")
    scratch.drop(final)
    out = rows.select("doc_id", "h1", "h2").join(final, ["h1", "h2"])
    return out.select("doc_id", "class_id", "n_links", "class_key", F.col("h1").alias("text_hash"), F.col("h2").alias("text_hash2"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that with the least identifier; all columns stay."""
    found = stage(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "forest-rows")
    names = found.groupBy("class_key", "doc_id", "text_hash", "text_hash2").agg(F.count("*").alias("c"))
    # a missing identifier is the last choice
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "text_hash2")
    best = stage(names.withColumn("rank", rank).groupBy("class_key").agg(F.min(F.struct("rank", "c")).alias("b")).select("class_key", F.col("b.rank.doc_id").alias("best_id"), F.col("b.rank.text_hash").alias("best_hash"), F.col("b.c").alias("best_c")), "forest-best")
    gone = names.join(best, "class_key").filter(~(F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))))
    kept = without_rows(docs, gone, id_col, text_col)
    twice = best.filter("best_c > 1").select(F.col("best_id").alias("__id"), F.col("best_hash").alias("__hash"))
    if twice.isEmpty():
        return kept
    twice = small(stage(twice, "forest-twice"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash(F.col(text_col)) == F.col("__hash"))
    number = F.row_number().over(Window.partitionBy(F.col(id_col), text_hash(F.col(text_col))).orderBy(F.lit(1)))
    again = kept.join(twice, same, "left_semi").withColumn("__n", number).filter("__n = 1").select(*docs.columns)
    return kept.join(twice, same, "left_anti").unionByName(again)
