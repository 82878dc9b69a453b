"""What single edits change, from matrices of whole graphs, in Arrow batches.

With R the reflexive closure of a graph, x gains by any addition u->v below it what v reaches and x doesn't, whatever u is:
row x of one product of R with its complement.  Sums over the changed probes of all additions are products with R again.
Deletions go through path counts.  No changed element is ever a row, and no path either: matrices are closed from the edges.
Rows of graphs go to their part as compressed messages, sorted by graph, with each name once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of the matrices that are held at a time, and rows read before graphs are worked off.
CELLS, ROWS = 1 << 18, 50_000

#: Rows that a task packs at a time, and what they become.
PACKED, MESSAGE = 1 << 20, "part int, graphs int, size int, rows binary"

DOWN, UP, FAR_DOWN, FAR_UP, COMBINED = "direct_downstream", "direct_upstream", "transitive_downstream", "transitive_upstream", "combined_impact"


def f1_after(add: bool, gold: np.ndarray, k: np.ndarray) -> np.ndarray:
    """F1 of answers of ``gold`` elements that lost or gained ``k``."""
    kept = gold if add else gold - k
    observed = gold + k if add else gold - k
    precision = np.where(observed > 0, kept / np.maximum(observed, 1), np.where(gold > 0, 0.0, 1.0))
    recall = np.where(gold > 0, kept / np.maximum(gold, 1), 1.0)
    both = precision + recall
    return np.where(both > 0, 2 * precision * recall / np.where(both > 0, both, 1.0), 0.0)


def closed(edge: np.ndarray, real: np.ndarray, primes: tuple) -> tuple:
    """Of stacked acyclic graphs: reflexive closures, path counts modulo each of ``primes``, longest paths that end in each node.

    From the highest level down, the row of a node is the sum of the rows of its direct successors.  A cycle raises.
    Sums of residues are exact in doubles, up to 4 million nodes a graph.
    """
    size, n = edge.shape[:2]
    level = np.zeros((size, n), np.int64)
    for _ in range(n + 1):
        before, level = level, np.where(edge, level[:, :, None] + 1, 0).max(1)
        if (before == level).all():
            break
    else:
        raise ValueError("a graph has a cycle")
    order, at, ones = np.argsort(-level, 1, kind="stable"), np.arange(size), edge.astype(np.float64)
    rows = np.zeros((size, n, 1 + len(primes), n))
    for i in range(n):
        x = order[:, i]
        row = np.matmul(ones[at, x][:, None, :], rows.reshape(size, n, -1)).reshape(size, -1, n)
        row[:, 0] = np.minimum(row[:, 0], 1.0)
        for j, q in enumerate(primes, 1):
            row[:, j] %= q
        row[at, :, x] = real[at, x][:, None]
        rows[at, x] = row
    return np.ascontiguousarray(rows[:, :, 0]), tuple(rows[:, :, j].astype(np.int64) for j in range(1, 1 + len(primes))), level


class Stack:
    """Graphs of up to ``n`` nodes each as stacked matrices; missing nodes are rows and columns of zeros."""

    def __init__(self, real, edge, keys, primes):
        reach, self.counts, self.level = closed(edge, real, primes)
        self.real, self.reach, self.edge, self.keys = real, reach, edge, keys
        self.near = np.matmul(reach, keys) > 0  # what is reached, and its foreign-key children
        size = {DOWN: edge.sum(2), UP: edge.sum(1), FAR_DOWN: reach.sum(2) - 1, FAR_UP: reach.sum(1) - 1, COMBINED: self.near.sum(2) - 1}
        self.gold = {o: np.where(real, x, 0).astype(np.float64) for o, x in size.items()}
        gold = self.gold
        self.cases = {
            "forward": gold[DOWN] > 0, "reverse": gold[UP] > 0, "transitive": gold[FAR_DOWN] > gold[DOWN],
            "combined_impact": (gold[COMBINED] > gold[FAR_DOWN]) & (gold[DOWN] > 0), "multi_source": gold[UP] >= 3,
        }

    def where(self, operation: str, rule: str) -> np.ndarray:
        """The anchors of ``operation`` whose probes a group counts by ``rule``."""
        return {"all": self.real, "away": self.real, "empty": self.real & (self.gold[operation] == 0)}[rule] if rule in ("all", "away", "empty") else self.cases[rule]

    def probes(self, rule: str, operations: list[str]) -> np.ndarray:
        n = self.real.sum(1)
        if rule == "own":
            return np.full(len(n), 2)
        return len(operations) * (n - 1) if rule == "away" else sum(self.where(o, rule).sum(1) for o in operations)

    def direct(self, add: bool, operation: str, rule: str, g, u, v) -> tuple:
        """Hits, changed elements and F1 of the one direct probe of each edit."""
        end = u if operation == DOWN else v
        hit = np.ones(len(g)) if rule == "own" else self.where(operation, rule)[g, end].astype(np.float64)
        return hit, hit, hit * f1_after(add, self.gold[operation][g, end], 1.0)

    def additions(self, groups: list) -> tuple:
        """``g, u, v`` of all admissible additions, and for each group three numbers of each."""
        r, miss = self.reach, 1.0 - self.reach
        real = self.real[:, :, None] & self.real[:, None, :]
        g, u, v = np.nonzero(real & ~self.edge & (self.level[:, :, None] < self.level[:, None, :]))
        turned = r.transpose(0, 2, 1)
        near = self.near.astype(np.float64)
        k = {FAR_DOWN: np.matmul(miss, turned), COMBINED: np.matmul(1.0 - near, near.transpose(0, 2, 1)), FAR_UP: np.matmul(turned, miss)}  # at x, v; x, v; u, y
        cells = {}
        for o, x in k.items():
            cells[o] = (x > 0).astype(np.float64), x, (x > 0) * f1_after(True, self.gold[o][:, None, :] if o == FAR_UP else self.gold[o][:, :, None], x)
        out = []
        for _, rule, operations in groups:
            sums = [np.zeros(len(g)) for _ in range(3)]
            for o in operations:
                if o in (DOWN, UP):
                    parts = self.direct(True, o, rule, g, u, v)
                else:
                    w = self.where(o, rule).astype(np.float64)
                    parts = [np.matmul(c * w[:, None, :], turned) if o == FAR_UP else np.matmul(turned, c * w[:, :, None]) for c in cells[o]]
                    parts = [(p - c if rule == "away" else p)[g, u, v] for p, c in zip(parts, cells[o], strict=True)]
                sums = [s + p for s, p in zip(sums, parts, strict=True)]
            out.append(sums)
        return g, u, v, out

    def deletions(self, groups: list, primes: tuple) -> Iterator[tuple]:
        """The same of all edges, some at a time."""
        every = np.nonzero(self.edge)
        step = max(1, CELLS // (self.keys.shape[1] * self.keys.shape[2]))
        for at in range(0, len(every[0]), step):
            g, u, v = (x[at : at + step] for x in every)
            r = self.reach[g]
            e, a, b = np.nonzero((self.reach[g, :, u] > 0)[:, :, None] & (self.reach[g, v, :] > 0)[:, None, :])
            all_through = np.ones(len(e), bool)
            for p, q in zip(self.counts, primes, strict=True):
                all_through &= p[g[e], a, u[e]] * p[g[e], v[e], b] % q == p[g[e], a, b]
            e, a, b = e[all_through], a[all_through], b[all_through]
            lost = np.zeros(r.shape)
            lost[e, a, b] = 1.0
            near = (np.matmul(r - lost, self.keys[g]) > 0).sum(2)
            k = {FAR_DOWN: lost.sum(2), FAR_UP: lost.sum(1), COMBINED: self.near[g].sum(2) - near}
            one = np.arange(len(g))
            out = []
            for _, rule, operations in groups:
                sums = [np.zeros(len(g)) for _ in range(3)]
                for o in operations:
                    if o in (DOWN, UP):
                        parts = self.direct(False, o, rule, g, u, v)
                    else:
                        w = self.where(o, rule)[g] & (k[o] > 0)
                        if rule == "away":
                            w[one, v if o == FAR_UP else u] = False
                        parts = w.sum(1), (w * k[o]).sum(1), (w * f1_after(False, self.gold[o][g], k[o])).sum(1)
                    sums = [s + p for s, p in zip(sums, parts, strict=True)]
                out.append(sums)
            yield g, u, v, out


def stacks(t: pa.Table, primes: tuple) -> Iterator[tuple]:
    """Stacks of the graphs in ``t``, graphs of like sizes together, with the names of graphs and nodes.

    ``t`` has all nodes of whole graphs as rows (node, node) of ``dist`` 0, their edges with 1, and foreign keys as rows
    (parent, child) without it.  Longer paths may be there and are not read.
    """
    coded = t.column("graph_id").combine_chunks().dictionary_encode()
    graph, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    src, dst = (t.column(c).to_numpy().astype(np.int64) for c in ("src", "dst"))
    dist = t.column("dist").fill_null(-1).to_numpy()
    of = lambda g, x: (g << 32) + (x + (1 << 31))
    node = np.unique(of(graph[dist == 0], src[dist == 0]))
    n = np.bincount(node >> 32, minlength=len(names))
    first = np.concatenate([[0], np.cumsum(n)])
    place = lambda g, x: np.searchsorted(node, of(g, x)) - first[g]
    from_node = np.isin(of(graph, src), node)
    step = (dist == 1) & from_node & np.isin(of(graph, dst), node)
    eg, es, ed = graph[step], src[step], dst[step]
    es, ed = place(eg, es), place(eg, ed)
    key = (dist < 0) & from_node
    kg, kp, child = graph[key], src[key], of(graph[key], dst[key])
    inside = np.isin(child, node)
    other = np.unique(child[~inside])  # children that are no nodes
    extra = np.bincount(other >> 32, minlength=len(names))
    before = np.concatenate([[0], np.cumsum(extra)])
    kc = np.where(inside, np.searchsorted(node, child) - first[kg], n[kg] + np.searchsorted(other, child) - before[kg])
    kp = place(kg, kp)
    width = n + extra
    order = np.lexsort((width, n))
    at = 0
    while at < len(order):
        end = at + 1
        most, wide = int(n[order[at]]), int(width[order[at]])
        while end < len(order):
            m, w = max(most, int(n[order[end]])), max(wide, int(width[order[end]]))
            if (end + 1 - at) * m * w > CELLS:
                break
            most, wide, end = m, w, end + 1
        chosen = order[at:end]
        at = end
        if not most:
            continue
        local = np.full(len(names), -1)
        local[chosen] = np.arange(len(chosen))
        size = (len(chosen), most, most)
        i, j = local[eg] >= 0, local[kg] >= 0
        edge = np.zeros(size, bool)
        edge[local[eg[i]], es[i], ed[i]] = True
        keys = np.zeros((len(chosen), most, wide))
        # each node counts as a child of its own; other columns than nodes' begin after a graph's own nodes
        real = np.arange(most)[None, :] < n[chosen][:, None]
        keys[:, np.arange(most), np.arange(most)] = real
        keys[local[kg[j]], kp[j], kc[j]] = 1.0
        ids = np.zeros(size[:2], np.int64)
        own = local[node >> 32] >= 0
        flat = node[own]
        ids[local[flat >> 32], (np.flatnonzero(own) - first[flat >> 32])] = (flat & ((1 << 32) - 1)) - (1 << 31)
        yield names.take(pa.array(chosen)), ids, Stack(real, edge, keys, primes)


def tallied(t: pa.Table, groups: list, primes: tuple) -> Iterator[pa.RecordBatch]:
    for names, ids, s in stacks(t, primes):
        probes = [s.probes(rule, operations) for _, rule, operations in groups]
        parts = [(True, *s.additions(groups)), *((False, *x) for x in s.deletions(groups, primes))]
        for add, g, u, v, sums in parts:
            columns = [names.take(pa.array(g)), pa.array(np.full(len(g), add)), pa.array(ids[g, u].astype(np.int32)), pa.array(ids[g, v].astype(np.int32))]
            labels = ["graph_id", "add", "u", "v"]
            for i, (hits, k, f1) in enumerate(sums):
                columns += [pa.array(probes[i][g].astype(np.int64)), pa.array(np.rint(hits).astype(np.int64)), pa.array(np.rint(k).astype(np.int64)), pa.array(np.asarray(f1, np.float64))]
                labels += [f"p{i}", f"d{i}", f"k{i}", f"f{i}"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)


def tally(groups: list, primes: tuple):
    """A function for ``mapInArrow`` over rows in the order of ``graph_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            codes = t.column("graph_id").combine_chunks().dictionary_encode().indices.to_numpy()
            start = int(np.searchsorted(codes, codes[-1]))  # the last graph may go on
            if start:
                yield from tallied(t.slice(0, start), groups, primes)
            held = t.slice(start).to_batches()
        if held:
            yield from tallied(pa.Table.from_batches(held).combine_chunks(), groups, primes)

    return run


def _messages(t: pa.Table) -> pa.RecordBatch:
    """A row for each part: graphs, bytes, and compressed: rows and letters of each graph, ``src``, ``dst`` and ``dist`` of each row, names."""
    t = t.sort_by([("part", "ascending"), ("graph_id", "ascending")])
    part, coded = t.column("part").to_numpy(), t.column("graph_id").combine_chunks().dictionary_encode()
    graph, names = coded.indices.to_numpy(), [x.encode() for x in coded.dictionary.to_pylist()]  # in the order of the rows, since a graph is of one part
    count, letters = np.bincount(graph).astype("<i4"), np.array([len(x) for x in names], "<i4")
    src, dst, dist = (t.column(c).fill_null(-1).to_numpy().astype("<i4") for c in ("src", "dst", "dist"))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    graphs, sizes, texts = [], [], []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        g, h = graph[a], graph[b - 1] + 1
        text = b"".join([x.tobytes() for x in (count[g:h], letters[g:h], src[a:b], dst[a:b], dist[a:b])] + names[g:h])
        graphs.append(h - g)
        sizes.append(len(text))
        texts.append(pa.compress(text, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(graphs, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["part", "graphs", "size", "rows"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows ``graph_id, src, dst, dist, part`` as ``MESSAGE``, one for each part of ``PACKED`` rows or some more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield _messages(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _messages(pa.Table.from_batches(held))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all messages in the order of ``graph_id``; foreign keys have ``dist`` -1."""
    found = []
    for batch in batches:
        for graphs, size, rows in zip(*(batch.column(c).to_pylist() for c in ("graphs", "size", "rows")), strict=True):
            text = pa.decompress(rows, size, "zstd", asbytes=True)
            count, letters = np.frombuffer(text, "<i4", 2 * graphs).reshape(2, graphs)
            n = int(count.sum())
            numbers = np.frombuffer(text, "<i4", 3 * n, 8 * graphs).reshape(3, n)
            end = np.concatenate([[0], np.cumsum(letters)]).astype(np.int32)
            names = pa.StringArray.from_buffers(graphs, pa.py_buffer(end.tobytes()), pa.py_buffer(text[8 * graphs + 12 * n :]))
            found.append(pa.Table.from_arrays([names.take(pa.array(np.repeat(np.arange(graphs), count))), *map(pa.array, numbers)], names=["graph_id", "src", "dst", "dist"]))
    if found:
        yield from pa.concat_tables(found).sort_by("graph_id").combine_chunks().to_batches(max_chunksize=ROWS)


def tally_packed(groups: list, primes: tuple):
    """``tally`` over the messages of whole parts."""
    each = tally(groups, primes)
    return lambda batches: each(unpacked(batches))
