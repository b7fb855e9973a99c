"""N-gram Jaccard join of all documents with themselves, by prefix trees.

A document's set has its distinct shingles of WORDS words (a shorter text: one of all its words). The global
order of shingles: those that few documents have, by hash, before those that many have. Documents with equal sets are one class, and
the join is between classes; a class goes by the least id of its documents.

1. One scan gives each document's class and counts all shingles by the first bits of their hashes, in cells of which one has about
   MEAN. A cell with at least SMALL, and four times the mean, is frequent, and so are its shingles: none that is can be missed, and those that share its
   cell only stand later in the order. A bit a cell is broadcast, 2**CELLS at most.
2. A class's prefix is its first n - ceil(s n) + 1 shingles; two classes that link share one. Prefixes go to buckets of shingles as packed
   arrays; the entries of a shingle that more than SLICE classes hold are dealt to several buckets. Shingles of one class end there.
   Up to SMALL classes (or MANY, or the bound of cells, if the shingle isn't frequent; so no such shingle exceeds it) give pairs, PAIRS at a time,
   whose shared shingles are counted; more, and those of dealt shingles, are only tied to the least of them. A pair whose overlap can't reach the bound is dropped:
   after the last shared shingle of their prefixes, the one whose prefix ends first has only what follows its prefix, and the other at most
   what follows that shingle; and up to where the first prefix ends they share what was counted (and perhaps frequent shingles), beyond
   it no more than the counts of both sets' shingles in each of BINS ranges of hashes allow. Other pairs and the ties make families:
   whatever links is in one family.
3. Each set goes once to its family's task. There each set is first compared with TRIED sets that were last met in its
   prefix, which connects most copies. Sets whose prefix shares a shingle with another component's go to a trie, ordered by how many of them have a shingle,
   so common beginnings are long; each (but those of the largest component) runs down it, below those children of the root where sets are that
   it may link with by counts of their tokens in WIDTH ranges, sharing the
   overlap of common beginnings and leaving subtrees that belong to its own component or whose remaining lengths can't reach the bound.
   Families of more than CELL shingles are cut by set size into blocks of about CELL, joined block by block where sizes allow a link.
4. The links found, which connect whatever is linked, make the components.

Sets and classes are compared by 63- and 64-bit hashes; a false equality among 10**9 classes has a chance of about 3 %,
of which a length check is part.

Defined cases: null and wordless texts have empty sets, link with nothing and are their own component; documents
without an id link with nothing and have no component; repeated rows are reported each; rows of one id with different texts have the
component of their text each, where texts that are the least id's of their class are joined by that id. ``one_of_each`` keeps columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import fetched, fresh, redealt, stored
from .graph import components

WORDS = 5
SIMILARITY = (80, 100)
#: Shingles that a cell of counts has on average, the most bits of a cell's number, and those of it within a range of cells
MEAN, CELLS, RANGE = 16, 27, 16
SMALL = 64
MANY = 512
#: Pairs that a task holds at once
PAIRS = 1 << 18
#: Classes that have a shingle, for each bucket it is dealt to
SLICE = 100_000
#: Branchings of a trie that are walked one by one
STEPS = 3
#: Sets that each is compared with before the trie
TRIED = 4
#: Ranges of tokens whose counts bound what two sets share, in a family's task
WIDTH = 128
CELL = 4_000_000
BINS = 64
FLUSH = 750_000
#: Cells that a task holds at once
HELD = 4_000_000
BUCKET = 1_000_000
_LOW = np.uint64((1 << 63) - 1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit shingle hashes of each text, sorted, in a row, and where each text's begin."""
    t = bw.words(buf, offs, bw.SPACED)
    h = bw.hashes(t.buf, t.starts, t.ends, True)
    n = t.counts
    owner = t.owner()
    out, who = [], []
    if len(h) >= k:
        g = bw.chain(*[h[i : len(h) - k + 1 + i] for i in range(k)])
        ok = owner[: len(g)] == owner[k - 1 :]
        out.append(g[ok])
        who.append(owner[: len(g)][ok])
    for m in range(1, k):  # whole texts of fewer words
        at = t.first[:-1][n == m]
        if len(at):
            out.append(bw.chain(*[h[at + i] for i in range(m)], np.full(len(at), m, np.uint64)))
            who.append(np.flatnonzero(n == m))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    g, d = np.concatenate(out) & _LOW, np.concatenate(who)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
    g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(len(offs)))


def classes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each set, size included."""
    with np.errstate(over="ignore"):
        return bw.chain(bw.sums(bw.mix(g + np.uint64(7)), first), bw.sums(bw.mix(g ^ np.uint64(0x94D049BB133111EB)), first), np.diff(first).astype(np.uint64))


def _need(a, b, s):
    """Least overlap of linked sets of sizes a and b: p/q of their union."""
    p, q = s
    return -(-p * (a + b) // (p + q))


def _own(a, s):
    return -(-s[0] * a // s[1])


def histograms(g: np.ndarray, first: np.ndarray) -> pa.Array:
    """How many of each set's shingles are in each range of hashes, as 32-bit numbers."""
    who = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.bincount(who * BINS + (g >> np.uint64(57)).astype(np.int64), minlength=(len(first) - 1) * BINS).reshape(-1, BINS)
    return pa.array([row.tobytes() for row in counts.astype("<u4")], pa.binary())


def packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers of cells in a range and their counts, byte by byte place and compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.ravel() for x in (np.diff(cells, prepend=0).astype("<u2"), n.astype("<u4"))]
    return pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, m: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 6 * m, "zstd", asbytes=True), np.uint8)
    gap, n = (np.ascontiguousarray(x.reshape(-1, m).T).view(kind).ravel().astype(np.int64) for x, kind in ((planes[: 2 * m], "<u2"), (planes[2 * m :], "<u4")))
    return np.cumsum(gap), n


class Trie:
    """Path-compressed prefix tree of sorted sequences, as arrays; a node comes before those below it, and so do its tokens."""

    def __init__(self, seqs: list[np.ndarray], labels: np.ndarray):
        self.seqs = seqs
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        # nodes: parent, depth, segment of the sequence of one set below, set that ends here
        parent, depth, seg, leaf = [-1], [0], [(0, 0, 0)], [-1]
        stack = [0]
        last: np.ndarray | None = None
        for i in order:
            s = seqs[i]
            common = 0
            if last is not None:
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                common = int(differ[0]) if len(differ) else m
            top = None
            while depth[stack[-1]] > common:
                top = stack.pop()
            if depth[stack[-1]] < common:  # split the edge to top
                who, a, _ = seg[top]
                parent.append(stack[-1])
                depth.append(common)
                seg.append((who, a, common))
                leaf.append(-1)
                parent[top], seg[top] = len(parent) - 1, (who, common, seg[top][2])
                stack.append(len(parent) - 1)
            parent.append(stack[-1])
            depth.append(len(s))
            seg.append((i, common, len(s)))
            leaf.append(i)
            stack.append(len(parent) - 1)
            last = s
        kids: list[list[int]] = [[] for _ in parent]
        for v in range(1, len(parent)):
            kids[parent[v]].append(v)
        # nodes are numbered anew, each before those below it, and a tour enters and leaves each
        order, tour, todo = [], [], [0]
        number = [0] * len(parent)
        while todo:
            v = todo.pop()
            if v < 0:
                tour.append(v)
                continue
            number[v] = len(order)
            order.append(v)
            tour.append(number[v])
            todo.append(~number[v])
            todo.extend(reversed(kids[v]))
        n = len(order)
        tour = np.array(tour)
        self.enters, self.tour = tour >= 0, np.where(tour >= 0, tour, ~tour)
        self.first, self.last = np.flatnonzero(self.enters), np.zeros(n, np.int64)
        self.last[self.tour[~self.enters]] = np.flatnonzero(~self.enters)
        self.below = (self.last - self.first + 1) // 2  # nodes of each subtree, with its root
        up = np.array([-1 if parent[v] < 0 else number[parent[v]] for v in order])
        self.depth, self.leaf = np.array(depth)[order], np.array(leaf)[order]
        size = np.array([seg[v][2] - seg[v][1] for v in order])
        self.size, self.edge = size, np.append(np.cumsum(size) - size, size.sum())
        self.flat = np.concatenate([seqs[seg[v][0]][seg[v][1] : seg[v][2]] for v in order] + [np.zeros(0, np.int64)])
        ends = np.flatnonzero(self.leaf >= 0)
        #: sizes of the sets below, their labels' bounds, and the child of the root that each set is under
        self.least, self.most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        self.low, self.high = np.full(n, 1 << 60), np.full(n, -1)
        self.least[ends] = self.most[ends] = self.depth[ends]
        self.low[ends] = self.high[ends] = labels[self.leaf[ends]]
        for v in range(n - 1, 0, -1):
            u = up[v]
            self.least[u], self.most[u] = min(self.least[u], self.least[v]), max(self.most[u], self.most[v])
            self.low[u], self.high[u] = min(self.low[u], self.low[v]), max(self.high[u], self.high[v])
        heads = np.flatnonzero(up == 0)
        self.top = np.zeros(len(seqs), np.int64)
        self.top[self.leaf[ends]] = heads[np.searchsorted(heads, ends, "right") - 1] if len(heads) else 0
        count = np.array([len(kids[v]) for v in order])
        self.child_at, self.child_n = np.cumsum(count) - count, count
        self.child = np.array([number[c] for v in order for c in kids[v]], np.int64)

    def overlaps(self, probe: np.ndarray, mark: np.ndarray, at: np.ndarray, s: tuple[int, int], own, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets below the nodes ``at`` that may link with a sequence, with their overlaps. mark: 1 at its tokens;
        now: the component of each label; subtrees of the component ``own`` alone are left out.

        The first STEPS branchings are walked, leaving subtrees by bounds; what is left is summed along the tour in one go.
        """
        n = len(probe)
        lowest, highest = _own(n, s), s[1] * n // s[0]
        found, counts = [], []
        part = np.zeros(len(at), np.int64)
        for _ in range(STEPS):
            ok = (self.most[at] >= lowest) & (self.least[at] <= highest) & ~((self.low[at] == self.high[at]) & (now[self.low[at]] == own))
            at, part = at[ok], part[ok]
            if not len(at):
                break
            c = self.size[at]
            run = np.concatenate([[0], np.cumsum(mark[self.flat[_ranges(self.edge[at], c)]])])
            part = part + run[np.cumsum(c)] - run[np.cumsum(c) - c]
            depth, last = self.depth[at], self.flat[np.maximum(self.edge[at] + c - 1, 0)]
            rest = np.where(c > 0, n - np.searchsorted(probe, last, "right"), n)  # of the probe's tokens, those beyond this node
            size = np.clip(depth + rest, np.maximum(self.least[at], lowest), np.minimum(self.most[at], highest))  # where the bound is easiest to reach
            ok = part + np.minimum(size - depth, rest) >= _need(n, size, s)
            at, part = at[ok], part[ok]
            end = self.leaf[at] >= 0
            found.append(self.leaf[at[end]])
            counts.append(part[end])
            c = self.child_n[at]
            part, at = np.repeat(part, c), self.child[_ranges(self.child_at[at], c)]
        if len(at):
            nodes = _ranges(at, self.below[at])
            c = self.size[nodes]
            stop = np.cumsum(c)
            run = np.concatenate([[0], np.cumsum(mark[self.flat[_ranges(self.edge[at], self.edge[at + self.below[at]] - self.edge[at])]])])
            weight = np.zeros(len(self.leaf), np.int64)
            weight[nodes] = run[stop] - run[stop - c]
            steps = _ranges(self.first[at], 2 * self.below[at])
            enters = self.enters[steps]
            path = np.cumsum(np.where(enters, weight[self.tour[steps]], -weight[self.tour[steps]]))[enters]  # in order of the nodes
            path += np.repeat(part, self.below[at])
            end = self.leaf[nodes] >= 0
            found.append(self.leaf[nodes[end]])
            counts.append(path[end])
        return (np.concatenate(found), np.concatenate(counts)) if found else (np.zeros(0, np.int64),) * 2


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def forest(sets: list[np.ndarray], side: np.ndarray, s: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect whatever is linked. side: 0 and 1 for the blocks of a cell (pairs between them count), or all 2."""
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    cut = np.cumsum(size) - size
    seqs = [ids[a : a + n] for a, n in zip(cut, size)]
    before = [q[: n - _own(n, s) + 1] for q, n in zip(seqs, size)]
    root = np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def link(i: int, j: int) -> bool:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
        return a != b

    latest = np.full(len(names), -1)
    for i in np.argsort(size, kind="stable").tolist():
        met = latest[before[i]]
        who, n = np.unique(met[met >= 0], return_counts=True)
        for j in who[np.argsort(-n, kind="stable")[:TRIED]].tolist():
            if find(i) != find(j) and len(np.intersect1d(seqs[i], seqs[j], assume_unique=True)) >= _need(int(size[i]), int(size[j]), s):
                link(i, j)
        latest[before[i]] = i

    label = np.array([find(i) for i in range(len(sets))])
    token = np.concatenate(before)
    who = np.repeat(np.arange(len(sets)), [len(b) for b in before])
    order = np.lexsort((label[who], token))
    token, who = token[order], who[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    mixed = np.minimum.reduceat(label[who], first) != np.maximum.reduceat(label[who], first)
    some = np.repeat(mixed, np.diff(np.append(first, len(token))))
    who = who[some]
    if not len(who):
        return out
    used = np.unique(who)
    often = np.bincount(np.concatenate([seqs[i] for i in used]), minlength=len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((np.arange(len(names)), -often))] = np.arange(len(names))
    ranked = [np.sort(rank[seqs[i]]) for i in used]
    t = Trie(ranked, label[used])
    spread = np.bincount(np.repeat(np.arange(len(used)), size[used]) * WIDTH + np.concatenate([seqs[i] for i in used]) % WIDTH, minlength=len(used) * WIDTH).reshape(-1, WIDTH)
    spread = spread.astype(np.uint8 if spread.max() < 256 else np.int64)
    # a link between components has an end outside of the largest one, so that one's sets needn't run
    largest = np.bincount(label[used]).argmax() if (side == 2).all() else -1
    now = np.arange(len(sets))
    mark = np.zeros(len(names), np.int64)
    for k, i in enumerate(used.tolist()):
        if side[i] == 1 or label[i] == largest:
            continue
        able = np.flatnonzero(now[label[used]] != now[label[i]])
        able = able[(size[used[able]] >= _own(size[i], s)) & (s[0] * size[used[able]] <= s[1] * size[i])]
        able = able[np.minimum(spread[able], spread[k]).sum(1, dtype=np.int64) >= _need(size[i], size[used[able]], s)]
        if not len(able):
            continue
        nodes = np.unique(t.top[able])
        mark[ranked[k]] = 1
        got, n = t.overlaps(ranked[k], mark, nodes, s, now[label[i]], now)
        mark[ranked[k]] = 0
        hit = used[got[n >= _need(size[i], size[used[got]], s)]]
        for j in hit[side[hit] != 0].tolist():
            if link(i, j):
                a, b = now[label[i]], now[label[j]]
                now[now == max(a, b)] = min(a, b)
    return out


def _pairs_of(t: np.ndarray, u: np.ndarray, n: np.ndarray, at_: np.ndarray, code: np.ndarray, dealt: np.ndarray, s, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From sorted entries of shingle, class, its size, the shingle's place in it, a code, and whether the shingle is dealt to several buckets: parts of
    pairs of classes with what they have (shared shingles, sizes, last shared places, codes), at last ties (class, least class) with nothing. Shingles of
    ``least`` classes are frequent."""
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    count = np.diff(np.append(first, len(t)))
    hot = (count > np.where(t[first] >> np.uint64(63), SMALL, max(SMALL, MANY, least))) | dealt[first]
    for c in np.unique(count[~hot]):
        at = first[(count == c) & ~hot]
        if c == 1:
            continue
        i, j = np.triu_indices(int(c), 1)
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            rows = at[k : k + step, None]
            a, b = (rows + i).ravel(), (rows + j).ravel()
            ok = s[1] * np.minimum(n[a], n[b]) >= s[0] * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            order = np.lexsort((u[b], u[a]))
            a, b = a[order], b[order]
            if not len(a):
                continue
            new = np.flatnonzero(np.append(True, (u[a][1:] != u[a][:-1]) | (u[b][1:] != u[b][:-1])))
            x, y = a[new], b[new]
            has = np.stack([np.diff(np.append(new, len(a))), n[x], n[y], np.maximum.reduceat(at_[a], new), np.maximum.reduceat(at_[b], new), code[x], code[y]], 1)
            yield np.stack([u[x], u[y]], 1), has
    hot = np.repeat(hot, count)
    if hot.any():
        least = np.repeat(np.minimum.reduceat(u, first), count)
        yield np.unique(np.stack([u[hot], least[hot]], 1), axis=0), np.zeros((0, 7), np.int64)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    s = similarity
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(max(int(size // (6 * MEAN)).bit_length(), RANGE), CELLS)

    def scan(batches):
        def flush(parts):
            _, one = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
            sets = [x for p in parts for x in p[0]]
            return summed(np.concatenate([sets[i] for i in one]) >> np.uint64(63 - bits))

        def summed(cell, n=None):
            cell = cell.astype(np.uint32)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
            return cell[first], np.diff(np.append(first, len(cell))) if n is None else np.add.reduceat(n[order], first)

        def told(some):
            cell, n = summed(*(np.concatenate(x) for x in zip(*some)))
            edge = np.searchsorted(cell, np.arange((1 << bits - RANGE) + 1) << RANGE)
            full = np.flatnonzero(np.diff(edge))
            data = [packed(cell[edge[r] : edge[r + 1]] & ((1 << RANGE) - 1), n[edge[r] : edge[r + 1]]) for r in full]
            none = np.zeros(len(full), np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.array(np.diff(edge)[full]), pa.array(full), pa.array(none), pa.array(data, pa.binary())], ["doc_id", "n", "h", "kind", "bins"])

        parts, held, some = [], 0, []
        for b in bw.chunks(batches, "text"):
            g, first = shingle_sets(*bw.flat(b.column(1)), words)
            c = classes(g, first)
            keys = b.column(0)
            made = pa.RecordBatch.from_arrays([keys, pa.array(np.diff(first)), pa.array(c.view(np.int64)), pa.array(np.ones(len(c), np.int64)), histograms(g, first)], ["doc_id", "n", "h", "kind", "bins"])
            yield made
            parts.append(([g[first[i] : first[i + 1]] for i in range(len(c))], c))
            held += len(g)
            if held > FLUSH:
                some.append(flush(parts))
                parts, held = [], 0
                if sum(len(x[0]) for x in some) > HELD:
                    yield told(some)
                    some = []
        if held:
            some.append(flush(parts))
        if some:
            yield told(some)

    scanned = stored(base.mapInArrow(scan, "doc_id long, n long, h long, kind long, bins binary"), "sets")
    members = scanned.where("kind = 1").select("doc_id", "n", F.col("h").alias("class"), "bins")
    total = members.agg(F.sum("n").alias("t")).first()["t"] or 0
    least = max(SMALL, -(-4 * total >> bits))

    def frequent(key, table):
        sums = np.zeros(1 << RANGE, np.int64)
        for data, m in zip(table["bins"].to_pylist(), table["n"].to_pylist()):
            cell, n = unpacked(data, m)
            sums[cell] += n
        many = np.flatnonzero(sums >= max(least, SLICE))
        packs = np.packbits(sums >= least, bitorder="little").tobytes()
        return pa.table({"h": pa.array([key[0].as_py()]), "bits": pa.array([packs], pa.binary()), "many": pa.array([many.astype("<i8").tobytes()], pa.binary()), "n": pa.array([sums[many].astype("<i8").tobytes()], pa.binary())})

    told = fetched(scanned.where("kind = 0").select("h", "n", "bins").groupBy("h").applyInArrow(frequent, "h long, bits binary, many binary, n binary"))
    flags = np.zeros((1 << bits - RANGE, (1 << RANGE) // 8), np.uint8)
    many, slices = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.argsort(told["h"]):
        h, row, cells, n = (told[c][i] for c in ("h", "bits", "many", "n"))
        flags[h] = np.frombuffer(row, np.uint8)
        many.append(np.frombuffer(cells, "<i8") + (int(h) << RANGE))
        slices.append(np.minimum(1 + np.frombuffer(n, "<i8") // SLICE, 1 << 30))
    often = spark.sparkContext.broadcast((flags.ravel(), np.concatenate(many), np.concatenate(slices).astype(np.int32)))
    several = bool((often.value[2] > 1).any())
    buckets = max(8, int(-(-total * (1 - s[0] / s[1]) // BUCKET)))

    def ordered(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The global order as numbers, and to how many buckets each shingle is dealt."""
        flags, many, slices = often.value
        cell = (g >> np.uint64(63 - bits)).astype(np.int64)
        known = flags[cell >> 3] >> (cell & 7).astype(np.uint8) & 1
        deal = np.ones(len(g), np.int32)
        if len(many):
            at = np.minimum(np.searchsorted(many, cell), len(many) - 1)
            deal = np.where(many[at] == cell, slices[at], deal)
        return g | known.astype(np.uint64) << np.uint64(63), deal

    def prefixes(batches):
        def flush(parts):
            t, u, n, r, z, d = (np.concatenate([p[i] for p in parts]) for i in range(6))
            where = (bw.mix(t + u % d.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((u, t, where))
            t, u, n, r, z, d, where = t[order], u[order], n[order], r[order], z[order], d[order], where[order]
            keep = np.append(True, (t[1:] != t[:-1]) | (u[1:] != u[:-1]))
            t, u, n, r, z, d, where = t[keep], u[keep], n[keep], r[keep], z[keep], d[keep], where[keep]
            edge = np.searchsorted(where, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(full), *(pa.array([x[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()) for x in (t, u, n.astype("<u4"), r.astype("<u4"), z.astype("<u4"), (d > 1).astype("u1")))], ["bucket", "t", "u", "n", "r", "z", "d"])

        parts, held = [], 0
        for b in bw.chunks(batches, "text"):
            g, first = shingle_sets(*bw.flat(b.column(1)), words)
            c, n = classes(g, first), np.diff(first)
            who = np.repeat(np.arange(len(n)), n)
            g, deal = ordered(g)
            order = np.lexsort((g, who))
            g, deal = g[order], deal[order]
            place = np.arange(len(g)) - first[:-1][who]
            take = place < (n - _own(n, s) + 1)[who]
            # the code: how many shingles are frequent, and in how many whole ranges of hashes the prefix has all others
            often_ = bw.sums((g >> np.uint64(63)).astype(np.int64), first)
            some = np.flatnonzero(n)
            end = g[first[:-1][some] + (n - _own(n, s))[some]]
            whole = np.zeros(len(n), np.int64)
            whole[some] = np.where(end >> np.uint64(63), BINS, (end >> np.uint64(57)) & np.uint64(63)).astype(np.int64)
            code = np.minimum(often_, (1 << 24) - 1) << 7 | whole
            parts.append((g[take], c[who[take]], n[who[take]], place[take], code[who[take]], deal[take]))
            held += int(take.sum())
            if held > FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    names = ["u", "v", "c", "a", "b", "ra", "rb", "za", "zb", "tie", "t"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        of = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        t, u, d = of("t", "<u8"), of("u", "<u8"), of("d", "u1").astype(bool)
        n, r, z = (of(c, "<u4").astype(np.int64) for c in ("n", "r", "z"))
        order = np.lexsort((u, t))
        t, u, n, r, z, d = t[order], u[order], n[order], r[order], z[order], d[order]
        keep = np.append(True, (t[1:] != t[:-1]) | (u[1:] != u[:-1]))
        t, u, d = t[keep], u[keep], d[keep]

        def row(pairs, has, tie, shingle):
            cols = [*pairs.view(np.int64).T, *has.T, np.full(len(pairs), tie), shingle]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names)

        for pairs, has in _pairs_of(t, u, n[keep], r[keep], z[keep], d, s, least):
            tie = not len(has)
            yield row(pairs, np.zeros((len(pairs), 7), np.int64) if tie else has, int(tie), np.zeros(len(pairs), np.int64))
        at = np.flatnonzero(d & np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        yield row(np.stack([u[at], u[at]], 1), np.zeros((len(at), 7), np.int64), 2, t[at].view(np.int64))  # the least here of each dealt shingle

    filled = base.where("doc_id is not null")
    met = filled.mapInArrow(prefixes, "bucket long, t binary, u binary, n binary, r binary, z binary, d binary").groupBy("bucket").applyInArrow(meet, ", ".join(f"{x} long" for x in names))
    met = stored(met, "met") if several else met
    p, q = s
    after = f"greatest(least(ceil({p} * a / {q}D) - 1, b - rb - 1), least(ceil({p} * b / {q}D) - 1, a - ra - 1))"
    enough = F.expr(f"c + {after} >= ceil({p} * (a + b) / {p + q}D)")
    counted = met.where("tie < 2").groupBy("u", "v").agg(F.sum("c").alias("c"), *[F.max(x).alias(x) for x in ("a", "b", "ra", "rb", "za", "zb", "tie")])
    likely = stored(counted.where((F.col("tie") == 1) | enough), "pairs")
    # one row a class, written: a semi-join of an aggregate would be moved below it, to all documents of a class
    reps = stored(members.where("doc_id is not null and n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("bins").alias("bins")), "classes")
    used = likely.where("tie = 0").select(F.explode(F.array("u", "v")).alias("class")).distinct()
    bins = stored(reps.select("class", "bins").join(used, "class", "left_semi"), "bins")

    @F.pandas_udf("long")
    def beyond(c: pd.Series, za: pd.Series, zb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        """The most that two sets can share."""
        za, zb = za.to_numpy(np.int64), zb.to_numpy(np.int64)
        h, k = (np.frombuffer(b"".join(v), "<u4").reshape(-1, BINS).astype(np.int64) for v in (x, y))
        whole = np.minimum(za & 127, zb & 127)
        least = np.where(np.arange(BINS) >= whole[:, None], np.minimum(h, k), 0).sum(1)
        return pd.Series(c.to_numpy(np.int64) + np.minimum(za >> 7, zb >> 7) + least)

    one, two = bins.select(F.col("class").alias("u"), F.col("bins").alias("x")), bins.select(F.col("class").alias("v"), F.col("bins").alias("y"))
    able = likely.where("tie = 0").join(one, "u").join(two, "v").where(beyond("c", "za", "zb", "x", "y") >= F.expr(f"ceil({p} * (a + b) / {p + q}D)"))
    near = likely.where("tie = 1").select("u", "v").unionByName(able.select("u", "v"))
    if several:  # ties between the buckets of a dealt shingle
        heads = met.where("tie = 2").select("t", "u").distinct()
        near = near.unionByName(heads.join(heads.groupBy("t").agg(F.min("u").alias("v")), "t").select("u", "v"))
    family = components(near.select("u", "v"), "families").select(F.col("node").alias("class"), F.col("component").alias("family"))
    grouped = family.join(reps.select("class", "doc_id", "n"), "class")
    # blocks: a family's shingles in order of set size, and by hash among equal sizes; sums by size come first, so no family is in one task
    sums = grouped.groupBy("family", "n").agg(F.sum("n").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = redealt(sums.withColumn("before", before), "family", "n")
    within = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / float(1 << 20) * F.col("own")
    placed = stored(grouped.join(sums, ["family", "n"]).withColumn("block", F.floor((F.col("before") + within) / CELL).cast("long")).drop("own", "before"), "placed")
    blocks = placed.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("family", F.col("block").alias("block2"), F.col("low").alias("low2"))
    cells = blocks.join(other, "family").where(f"block = block2 or (block < block2 and {q} * high >= {p} * low2)").select("family", "block", "block2")
    inside = cells.select("family", F.col("block").alias("own"), "block", "block2", F.when(F.col("block") == F.col("block2"), 2).otherwise(0).alias("side"))
    across = cells.where("block < block2").select("family", F.col("block2").alias("own"), "block", "block2", F.lit(1).alias("side"))
    seated = redealt(inside.unionByName(across), "family", "own")
    seats = placed.select("doc_id", "class", "family", F.col("block").alias("own")).join(seated, ["family", "own"])

    def sets(batches):
        for b in bw.chunks(batches, "text"):
            g, first = shingle_sets(*bw.flat(b.column(b.schema.get_field_index("text"))), words)
            same = classes(g, first).view(np.int64) == b.column(b.schema.get_field_index("class")).to_numpy()
            g, _ = ordered(g)
            data = pa.array([np.sort(g[first[i] : first[i + 1]]).tobytes() for i in range(len(first) - 1)], pa.binary())
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "class", "family", "block", "block2", "side")]
            yield pa.RecordBatch.from_arrays([*cols, data], ["doc_id", "class", "family", "block", "block2", "side", "data"]).filter(pa.array(same))

    def linked(key, table):
        _, one = np.unique(table["class"].to_numpy(), return_index=True)
        data, ids = table["data"].to_pylist(), table["doc_id"].to_numpy()[one]
        found = forest([np.frombuffer(data[i], "<u8") for i in one], table["side"].to_numpy()[one], s)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})

    given = filled.join(seats, "doc_id").select("text", "doc_id", "class", "family", "block", "block2", "side").mapInArrow(sets, "doc_id long, class long, family long, block long, block2 long, side int, data binary")
    links = given.groupBy("family", "block", "block2").applyInArrow(linked, "u long, v long")
    groups = components(links, "links")
    named = reps.join(groups, reps["doc_id"] == groups["node"], "left").select("class", F.coalesce("component", "doc_id").alias("component_id"))
    own = members.select("doc_id", F.col("n").alias("n_shingles"), "class")
    joined = own.where("n_shingles > 0 and doc_id is not null").join(redealt(named, "class"), "class").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(own.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document of each component that has the least id, with its columns; of rows with that id the one with the least text (then the
    least of all its columns as JSON). Rows without an id stay."""
    own = fresh("kept", docs.columns)
    kept = join(docs, key, text, **options).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    found = docs.where(F.col(key).isNotNull()).join(kept, F.col(key).cast("long") == F.col(own), "left_semi")
    again = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(own)).agg(F.count("*").alias("n")).where("n > 1").select(own)
    if not again.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        many = stored(found.join(again, F.col(key) == F.col(own), "left_semi"), "repeated")
        least = many.groupBy(F.col(key).alias(own)).agg(F.min_by(whole, F.struct(F.coalesce(F.col(text), F.lit("")), F.to_json(whole))).alias("row")).select("row.*")
        found = found.join(again, F.col(key) == F.col(own), "left_anti").unionByName(least)
    return found.unionByName(docs.where(F.col(key).isNull()))
