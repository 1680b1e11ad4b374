"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct ``k``-word shingles (64-bit hashes).  Sets whose Jaccard similarity reaches
``percent`` / 100 are linked; groups are the connected components of the links.

Signatures.  Size bands [L, R] overlap so that any two linkable sets share a band.  Within a band such sets
differ in at most H = 2R(100-p)/(100+p) elements.  The feature domain is partitioned by hash into n1 first-level
parts, of which fewer than n1 can differ in two or more elements; each is partitioned again into three, and the subsets of two
of three are enumerated: if a first-level part differs in one element at most, some pair of its thirds agrees whole.  A
signature is the hash of what a set has in such a pair.  n1 exceeds what the pigeonhole needs by a slack, which lets every set
leave out its thinnest signatures (few elements, shared by chance): it emits those with at least t elements, t being the
largest value at which fewer first-level parts than the slack allows have a thinner one.  The agreeing signature that the argument
finds for the set with the larger t is emitted by both, so no linkable pair is lost, whatever the sizes.

Join.  Signatures travel as sorted arrays (see common.packed_exchange's notes).  A batch sends the signatures of a set once,
however many of its documents have it, so copies are combined before the exchange.  Documents of one set have one
representative.  The representatives that share a signature are a group; groups with the same members are one.  In a group two
sets may be linked only if the counts of their elements by hash cells (about 8 elements a cell) differ by no more than the linkable sets of their sizes can: this
bound is exact, so it drops no link, and it drops nearly all pairs that share a passage only.  A spanning forest of the pairs
that remain ties the group together; clusters are the components of all ties.  In a cluster of more than one block every set is first
compared with the cluster's first set: those linked with it need no comparison with each other.  Then representatives are dealt
into blocks of about ``BLOCK``, and blocks are compared with blocks exactly (sizes of intersections as a sparse product), giving a
spanning forest of the links: copies are never expanded into pairs.  Groups too are dealt into blocks (``GROUP``), so neither a group nor
a cluster is one task.

Defined cases: null and empty texts and those without words have an empty set and link with nothing; fewer than k words are one
shingle; rows that repeat a doc_id are one document, linked by what any of them links, and each get a row;
a null doc_id is a document after all others, and is null in the result; an empty table gives an empty result; only doc_id and
text are read; a ``percent`` below 50 or above 100 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import (
    NULL_ID,
    PACKED,
    bitmap_filter,
    bound_batches,
    bucket_bounds,
    by_bucket,
    components,
    expand,
    expand_sorted,
    gram_hashes,
    ids_of,
    join_group,
    mix,
    packed_batch,
    release,
    squeeze,
    squeeze_sorted,
    stored,
    text_chunks,
    text_size,
    word_hashes,
)

#: Ratio of neighbouring bands' upper bounds; share of first-level parts beyond what the pigeonhole needs.
BAND_RATIO, SLACK = 1.4, 0.12
#: Elements of a set in a cell of its count sketch, about; sketches have a power of two of cells, LEAST_CELLS at least.
PER_CELL, LEAST_CELLS = 8, 32
#: Members of a block of a group, about, whose sketches are compared.
GROUP = 2048
#: Documents of a comparison block, about; signatures of a batch and of a bucket, about.
BLOCK, BATCH_SIGNATURES, BUCKET_SIGNATURES = 96, 500_000, 1_000_000


# --- sets -----------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within a text; set size of each text)."""
    words, counts = word_hashes(data, off, lower=True)
    n = len(counts)
    edge = np.concatenate(([0], np.cumsum(counts)))
    grams = gram_hashes(words, k)
    row = np.repeat(np.arange(n), counts)[: len(grams)]
    inside = np.arange(len(grams)) + k <= edge[1:][row]
    value, row = grams[inside], row[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([int(gram_hashes(words[edge[r] : edge[r + 1]], int(counts[r]))[0]) for r in short], np.uint64)
        value, row = np.concatenate((value, mix(whole + np.uint64(1)))), np.concatenate((row, short))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.bincount(row[keep], minlength=n)


# --- signatures -----------------------------------------------------------------------------


_UPPERS: list[int] = [1]


def _upper(i: int) -> int:
    """Largest set of band i."""
    while len(_UPPERS) <= i:
        _UPPERS.append(max(_UPPERS[-1] + 1, int(_UPPERS[-1] * BAND_RATIO)))
    return _UPPERS[i]


def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, first-level parts that the pigeonhole needs, first-level parts) of the bands of a set size.  The larger of two
    linkable sets is in (R below, R] of one band, the other is then at least percent of R below + 1: it is in that band too."""
    _upper(0)
    while _UPPERS[-1] < size:
        _upper(len(_UPPERS))
    i = int(np.searchsorted(_UPPERS, size))
    out = []
    while 100 * size >= percent * ((_upper(i - 1) if i else 0) + 1):
        need = 2 * _upper(i) * (100 - percent) // (100 + percent) // 2 + 1
        out.append((i, need, need + (max(1, int(need * SLACK)) if need > 1 else 0)))
        i += 1
    return out


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row of its set), for sets given one after the other.

    A pair of thirds without an element would be shared by all who have none there.  Where two thirds are empty, the third's
    content and its content less each one element stand for that pair: sets that differ in one element there share one of them."""
    edge = np.concatenate(([0], np.cumsum(sizes)))
    plan: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        for band in bands(int(size), percent):
            plan.setdefault(band, []).append(rows)
    sigs, owners = [], []
    for (band, need, n1), found in plan.items():
        rows = np.sort(np.concatenate(found))
        n, cells = sizes[rows], 3 * n1
        index = np.arange(int(n.sum())) + np.repeat(edge[rows] - (np.cumsum(n) - n), n)
        v = values[index]
        cell = np.repeat(np.arange(len(rows), dtype=np.int64) * cells, n) + (mix(v ^ np.uint64(0xA5A5 + band)) % np.uint64(cells)).astype(np.int64)
        total = len(rows) * cells
        m = mix(v + np.uint64(band))
        count = np.bincount(cell, minlength=total).reshape(-1, 3)
        low = np.bincount(cell, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(cell, (m >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        content = (low + (high << np.uint64(32))).reshape(-1, 3)
        tag = np.tile(mix(np.arange(n1, dtype=np.uint64) + np.uint64(band << 32)), len(rows))
        whole = count.sum(1)
        lone = (count > 0).sum(1) <= 1  # parts with two empty thirds
        pairs = np.stack([count[:, 0] + count[:, 1], count[:, 0] + count[:, 2], count[:, 1] + count[:, 2]], 1)
        sums = np.stack([content[:, 0] + content[:, 1], content[:, 0] + content[:, 2], content[:, 1] + content[:, 2]], 1)
        sig = mix(sums + tag[:, None] * np.array([3, 5, 7], np.uint64))
        thin = np.where(lone, whole - 1, pairs.min(1)).reshape(len(rows), n1)
        least = np.maximum(np.sort(thin, 1)[:, n1 - need], 1 if n1 == 1 else 0)  # at most n1 - need parts have a thinner one
        part_least = np.repeat(least, n1)
        strong = (pairs >= part_least[:, None]) & (pairs > 0)
        part, which = np.nonzero(strong)
        sigs.append(sig[part, which])
        owners.append(rows[part // n1])
        all_ = content.sum(1, dtype=np.uint64)
        part = np.flatnonzero(lone & (whole >= part_least))
        sigs.append(mix(all_[part] + tag[part] * np.uint64(11)))
        owners.append(rows[part // n1])
        part = cell // 3
        less = lone[part] & (whole[part] - 1 >= part_least[part])
        part = part[less]
        sigs.append(mix(all_[part] - m[less] + tag[part] * np.uint64(11)))
        owners.append(rows[part // n1])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def sketch_cells(sizes: np.ndarray) -> np.ndarray:
    """Cells of the sketches of sets of these sizes: linkable sizes differ by one doubling at most."""
    need = np.maximum(sizes, 1) / PER_CELL
    return (1 << np.ceil(np.log2(np.maximum(need, LEAST_CELLS))).astype(np.int64)).astype(np.int64)


# --- the join -------------------------------------------------------------------------------


def _send(k: int, percent: int, n_buckets: int):  # noqa: ANN202
    """Rows of a batch: bucket -1 with (doc_id, set size, 128-bit digest of the set), and slices of signatures."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sent: set[tuple[int, int]] = set()  # digests of the batch's sets
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            sig, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            sent.clear()
            waiting = 0
            order = np.argsort(sig, kind="stable")
            sig, doc = sig[order], doc[order]
            edge = bucket_bounds(sig, n_buckets)
            for i, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if y > x:
                    ids, code = np.unique(doc[x:y], return_inverse=True)
                    code = code.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                    head = np.array([y - x, len(ids)], np.int64).tobytes()
                    a, b, c = squeeze_sorted(sig[x:y]), squeeze(code), squeeze(np.diff(ids, prepend=np.int64(0)))
                    yield packed_batch([("", i, 0, np.array([len(a), len(b)], np.int64).tobytes() + head, a + b + c)])

        for rb in batches:
            ids = ids_of(rb["doc_id"])
            for i, j, data, off in text_chunks(rb["text"], 8192):
                values, sizes = shingle_sets(data, off, k)
                edge = np.concatenate(([0], np.cumsum(sizes)))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(s)), dtype=np.uint64))) for s in (1, 2)]
                two = [s[edge[1:]] - s[edge[:-1]] for s in sums]
                cells = sketch_cells(sizes)
                base = np.cumsum(cells) - cells
                cell = np.repeat(base, sizes) + (mix(values + np.uint64(77)) & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
                sketch = np.minimum(np.bincount(cell, minlength=int(cells.sum())), 255).astype(np.uint8)
                rows = np.stack([ids[i:j].view(np.uint64), sizes.astype(np.uint64), *two], 1)
                yield packed_batch([("", -1, 0, sketch.tobytes(), np.ascontiguousarray(rows).tobytes())])
                new = np.zeros(j - i, bool)
                for r, digest in enumerate(zip(two[0].tolist(), two[1].tolist(), strict=True)):
                    if sizes[r] and digest not in sent:
                        sent.add(digest)
                        new[r] = True
                fresh = np.flatnonzero(new)
                sig, row = signatures(values[np.repeat(new, sizes)], sizes[fresh], percent)
                if len(sig):
                    held.append((sig, ids[i + fresh[row]]))
                    waiting += len(sig)
                if waiting >= BATCH_SIGNATURES:
                    yield from flush()
        if held:
            yield from flush()

    return step


JOINED = "kind int, a long, b long, h1 long, h2 long, sketch binary"


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (doc_id, set size, digest, sketch) of each document.  Kind 1: (group, doc_id) of documents that share a signature of a
    bucket; a group is named by its members."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    names = ["kind", "a", "b", "h1", "h2", "sketch"]

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            sig, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
            sig, doc = sig[new], doc[new]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            name = np.add.reduceat(mix(doc.view(np.uint64)), first) + mix(size.astype(np.uint64))
            big = np.flatnonzero(size > 1)
            _, one = np.unique(name[big], return_index=True)
            big = big[one]
            n = size[big]
            at = np.arange(int(n.sum())) + np.repeat(first[big] - (np.cumsum(n) - n), n)
            none = pa.nulls(len(at), pa.int64())
            yield pa.record_batch([pa.array(np.ones(len(at), np.int32)), pa.array(np.repeat(name[big], n).view(np.int64)), pa.array(doc[at]), none, none, pa.nulls(len(at), pa.binary())], names)

    for rb in batches:
        for i in range(rb.num_rows):
            bucket, raw = rb["bucket"][i].as_py(), rb["payload"][i].as_py()
            if bucket < 0:
                x = np.frombuffer(raw, np.int64).reshape(-1, 4)
                edge = np.concatenate(([0], np.cumsum(sketch_cells(x[:, 1]))))
                sketch, cols = rb["state"][i].as_py(), [pa.array(np.ascontiguousarray(x[:, k])) for k in range(4)]
                yield pa.record_batch([pa.array(np.zeros(len(x), np.int32)), *cols, pa.array([sketch[p:q] for p, q in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names)
                continue
            if bucket != now:
                yield from flush()
                now = bucket
            la, lb = np.frombuffer(rb["state"][i].as_py(), np.int64, 2)
            ids = np.cumsum(expand(raw[la + lb :]))
            held.append((expand_sorted(raw[:la]), ids[expand(raw[la : la + lb])]))
    yield from flush()


def _ties(percent: int):  # noqa: ANN202
    """(a, b): a spanning forest of the pairs that may be linked, of each block of a group or, where two blocks meet (sides 0 and 1),
    between the two.  Rows (g, x, y, side, rep, size, sketch) come sorted by (g, x, y)."""

    def near(a: int, n: np.ndarray, x: list[np.ndarray], others: np.ndarray) -> np.ndarray:
        """Of the others those that may be linked with a.  A sketch with twice the cells is folded."""
        m, c = n[others], len(x[a])
        fits = 100 * np.minimum(n[a], m) >= percent * np.maximum(n[a], m)
        room = (100 - percent) * (n[a] + m)
        out = np.zeros(len(others), bool)
        cells = np.array([len(x[o]) for o in others])
        for w in (c // 2, c, 2 * c):
            at = np.flatnonzero(fits & (cells == w))
            for k in range(0, len(at), 4096):
                some = at[k : k + 4096]
                y = np.stack([x[o] for o in others[some]])
                one = x[a]
                if w < c:
                    one = one[:w] + one[w:]
                elif w > c:
                    y = y[:, :c] + y[:, c:]
                out[some] = (100 + percent) * np.abs(y - one).sum(1, dtype=np.int64) <= room[some]
        return out

    def forest(ids: np.ndarray, n: np.ndarray, x: list[np.ndarray], side: np.ndarray, out: list) -> None:
        left = np.arange(len(ids))  # breadth first: each document is compared with those not reached yet
        two = side.max() > side.min()
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                others = left[side[left] != side[i]] if two else left
                found = others[near(i, n, x, others)]
                left = np.setdiff1d(left, found, assume_unique=True)
                queue.extend(found)
                out.append(np.stack([ids[found], np.full(len(found), ids[i])], 1))

    def pairs_of_two(a: np.ndarray, n: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
        """Of the pairs (a, a + 1) those that may be linked, compared by number of cells."""
        b = a + 1
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        ca, cb = (np.array([len(x[i]) for i in v], np.int64) for v in (a, b))
        a, b = np.where(ca <= cb, a, b), np.where(ca <= cb, b, a)
        ca, cb = np.minimum(ca, cb), np.maximum(ca, cb)
        keep = [np.zeros(0, np.int64)]
        for c in np.unique(ca):
            for w in (c, 2 * c):
                at = np.flatnonzero((ca == c) & (cb == w))
                for k in range(0, len(at), 4096):
                    some = at[k : k + 4096]
                    p, q = (np.stack([x[i] for i in v[some]]) for v in (a, b))
                    if w > c:
                        q = q[:, :c] + q[:, c:]
                    close = (100 + percent) * np.abs(p - q).sum(1, dtype=np.int64) <= (100 - percent) * (n[a[some]] + n[b[some]])
                    keep.append(np.minimum(a, b)[some[close]])
        return np.concatenate(keep)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, bx, by, side, ids, n = (np.zeros(0, np.int64) for _ in range(6))
        x: list[np.ndarray] = []

        def work(new: np.ndarray, ids: np.ndarray, n: np.ndarray, side: np.ndarray, x: list[np.ndarray]) -> pa.RecordBatch:
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(new)))
            hit = pairs_of_two(first[size == 2], n, x)
            out = [np.stack([ids[hit + 1], ids[hit]], 1)]
            for f, k in zip(first[size > 2], size[size > 2], strict=True):
                forest(ids[f : f + k], n[f : f + k], x[f : f + k], side[f : f + k], out)
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            cols = ((g, "g"), (bx, "x"), (by, "y"), (side, "side"), (ids, "rep"), (n, "n_shingles"))
            g, bx, by, side, ids, n = (np.concatenate((k, rb[c].to_numpy(zero_copy_only=False))) for k, c in cols)
            x += [np.frombuffer(v, np.uint8).astype(np.int16) for v in rb["sketch"].to_pylist()]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            yield work(new[:last], ids[:last], n[:last], side[:last], x[:last])
            g, bx, by, side, ids, n, x = g[last:], bx[last:], by[last:], side[last:], ids[last:], n[last:], x[last:]
        yield work(np.arange(len(g)) == 0, ids, n, side, x)

    return step


def _block_links(percent: int):  # noqa: ANN202
    """Rows (cluster, x, y, side, id, set) sorted by (cluster, x, y): links between the blocks x and y of a cluster."""

    def forest(rows: list[tuple[int, int, bytes]], same: bool) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        ids = np.array([r[1] for r in rows])
        side = np.array([r[0] for r in rows])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        column = np.cumsum(new) - 1
        often = np.bincount(column)
        keep = often[column] > 1
        column, owner = column[keep], owner[keep]
        _, column = np.unique(column, return_inverse=True)
        width = int(column.max()) + 1 if len(column) else 0
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, width, 8192):  # a dense product by strips of shingles; exact below 2**24
            some = (column >= a) & (column < a + 8192)
            m = np.zeros((len(sets), min(8192, width - a)), np.float32)
            m[owner[some], column[some] - a] = 1
            common += m @ m.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None] - common
        linked = np.triu(100 * common >= percent * union, 1)
        if not same:
            linked &= side[:, None] != side[None]
        root = list(range(len(sets)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            p, q = find(int(x)), find(int(y))
            if p != q:
                root[p] = q
                out.append((int(ids[x]), int(ids[y])))
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for rb in batches:
            for c, x, y, s, i, v in zip(*(rb[n].to_pylist() for n in ("cluster", "x", "y", "side", "id", "shingles")), strict=True):
                if (c, x, y) != now:
                    if len(rows) > 1:
                        out += forest(rows, now[1] == now[2])
                    now, rows = (c, x, y), []
                rows.append((s, i, v))
        if len(rows) > 1:
            out += forest(rows, now[1] == now[2])
        e = np.array(out, np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])

    return step


def _first_links(percent: int):  # noqa: ANN202
    """Rows (id, shingles, first): whether a set is linked with its cluster's first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            hit = []
            for a, b in zip(rb["shingles"], rb["first"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([rb["cluster"], rb["id"], rb["shingles"], pa.array(hit, pa.bool_())], ["cluster", "id", "shingles", "linked"])

    return step


def meetings(rows: DataFrame, blocks: Column, key: Column, linked: Column | None = None, open_blocks: Column | None = None) -> DataFrame:
    """rows once for each pair of blocks (x <= y) that their own block takes part in, with side.  Rows that are ``linked`` among themselves
    are in blocks of their own, numbered after the ``open_blocks`` first ones, and do not meet each other."""
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    if linked is None:
        dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    else:
        others = F.when(linked, open_blocks).otherwise(blocks)
        mine = F.when(linked, open_blocks + F.pmod(F.xxhash64(key), blocks - open_blocks)).otherwise(F.pmod(F.xxhash64(key), open_blocks)).cast("int")
        dealt = rows.withColumn("_own", mine).where(others > 0).withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
    return dealt.withColumns({"x": F.least("_own", "_other"), "y": F.greatest("_own", "_other"), "side": (F.col("_own") <= F.col("_other")).cast("int")}).drop("_own", "_other")


def _sets_of(k: int):  # noqa: ANN202
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, data, off in text_chunks(rb["text"], 8192):
                values, sizes = shingle_sets(data, off, k)
                edge = np.concatenate(([0], np.cumsum(sizes)))
                sets = [values[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                part = rb.slice(i, j - i)
                yield pa.record_batch([part["cluster"], part["blocks"], part["id"], pa.array(sets, pa.binary())], ["cluster", "blocks", "id", "shingles"])

    return step


def groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100: sketches of linkable sets are at most one doubling apart")
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, size = text_size(docs)
    n_buckets = max(parts, size // 8 // BUCKET_SIGNATURES)  # a partition takes several, one after the other
    sent = docs.select("doc_id", "text").mapInArrow(_send(k, percent, n_buckets), PACKED)
    joined = stored(by_bucket(sent, parts).sortWithinPartitions("bucket").mapInArrow(_join, JOINED), "joined")
    sets = joined.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_shingles"), "h1", "h2", "sketch")
    # documents of one set are one representative: the smallest
    full = sets.where("n_shingles > 0")
    alike = stored(full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "alike")
    nodes = stored(join_group(full, alike, ["h1", "h2"], "n").select("id", "rep", "n_shingles", "sketch").distinct(), "nodes")
    members = joined.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("id")).distinct()
    groups_ = stored(members.join(nodes, "id").select("g", "rep", "n_shingles", "sketch").distinct(), "groups")
    large = stored(groups_.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > GROUP), "large")
    # groups of more than one block are few: at most one in GROUP rows of the table is such a group's name
    small = bitmap_filter(groups_, "g", large.select("g"), keep=False)
    many = bitmap_filter(groups_, "g", large.select("g")).join(large, "g", "left")
    one = small.unionByName(many.where("m IS NULL").drop("m")).withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(0)})
    split = meetings(many.where("m IS NOT NULL"), F.ceil(F.col("m") / GROUP).cast("int"), F.col("rep")).drop("m")
    met = one.unionByName(split).repartition(parts, "g", "x", "y").sortWithinPartitions("g", "x", "y", "rep")
    ties = stored(met.mapInArrow(_ties(percent), "a long, b long").distinct(), "ties")
    found = components(ties)
    cluster = stored(found.select(F.col("node").alias("id"), F.col("component").alias("cluster")).unionByName(found.select(F.col("component").alias("id"), F.col("component").alias("cluster")).distinct()), "clusters")
    reps = stored(cluster.groupBy("cluster").agg(F.count("*").alias("m")).select("cluster", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "reps")
    chosen = stored(join_group(cluster, reps, ["cluster"], "m").select("cluster", "blocks", "id").distinct(), "chosen")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("id"), "text")
    texts = bitmap_filter(texts, "id", chosen.select("id")).join(chosen, "id").select("cluster", "blocks", "id", "text")
    sets_of = stored(texts.mapInArrow(_sets_of(k), "cluster long, blocks int, id long, shingles binary"), "sets")
    pairs = [meetings(sets_of.where("blocks = 1").drop("blocks"), F.lit(1), F.col("id"))]
    # a cluster is named by its least set: the first
    rest = sets_of.where("blocks > 1")
    first = rest.where("id = cluster").groupBy("cluster").agg(F.min("shingles").alias("first"), F.min("blocks").alias("blocks"))
    # the first set goes to each block of its cluster, so that no task has a whole cluster
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    compared = stored(rest.join(first, ["cluster", "salt"]).where("id != cluster OR shingles != first").select("cluster", "id", "shingles", "first").mapInArrow(_first_links(percent), "cluster long, id long, shingles binary, linked boolean"), "first")
    left = compared.groupBy("cluster").agg(F.count("*").alias("n"), F.ceil(F.count_if(~F.col("linked")) / BLOCK).cast("int").alias("open"), F.ceil(F.count_if("linked") / BLOCK).cast("int").alias("done"))
    left = stored(left.where("open > 0"), "left")  # in the others every set is linked with the first
    pairs.append(meetings(join_group(compared, left, ["cluster"], "n").drop("n"), F.col("open") + F.col("done"), F.col("id"), F.col("linked"), F.col("open")).drop("open", "done", "linked"))
    pairs = pairs[0].unionByName(pairs[1])
    links = pairs.repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "id").mapInArrow(_block_links(percent), "a long, b long")
    links = links.unionByName(compared.where("linked").select(F.col("id").alias("a"), F.col("cluster").alias("b")))
    # members of one set as links to their representative, then everything together
    links = stored(links.unionByName(nodes.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "links")
    release(alike, nodes, groups_, large, ties, cluster, reps, chosen, sets_of, compared, left)
    final = components(links)
    release(links)
    found = sets.join(final, sets["id"] == final["node"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    null = F.lit(int(NULL_ID))
    return found.select(F.nullif("id", null).alias("doc_id"), "n_shingles", F.nullif("component", null).alias("component_id"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest doc_id (nulls last; ties by a hash of the text).  A document is
    a doc_id with a text: texts that share a doc_id, or have none, are judged each on its own; rows that repeat both stay or go
    together."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = groups(docs.select(key.alias("doc_id"), "text"), k, percent).where("doc_id != component_id").select(F.col("doc_id").alias("_nj_key"), F.col("component_id").alias("c")).distinct()
    member = stored(found.unionByName(found.select(F.col("c").alias("_nj_key"), "c").distinct()), "members")
    ids = bitmap_filter(docs.select(key.alias("_nj_key"), "doc_id"), "_nj_key", member.select("_nj_key")).distinct()
    named = stored(member.join(ids, "_nj_key").withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "_nj_key")), "named")
    best = stored(named.groupBy("c").agg(F.min("order").alias("best"), F.count("*").alias("n")), "best")
    gone = stored(join_group(named, best, ["c"], "n").where("order != best").select("_nj_key"), "gone")
    release(member, named, best)
    names = docs.columns
    keyed = docs.withColumn("_nj_key", key)
    return keyed.join(gone, "_nj_key", "left_anti").select(*names)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
