"""N-gram Jaccard join by parity sketches.

A text's shingles flip bits of a sketch: a shingle chooses a cell of 64 bits and
a bit in it.  Two sketches of one layout then differ in at most as many bits as
the shingle sets differ in elements, and one differing shingle changes one cell.
For the join a cell is named by the XOR of its shingles' whole hashes, which the
same argument holds for, and which unlike texts share only where they share the
cell's shingles.
Texts meet in layouts by size band; where Jaccard similarity is at least s, sets
of sizes a and b differ in at most (1-s)/(1+s) (a+b) elements, so of one cell
more than that at least one is equal (pigeonhole).  Spare cells make up for poor
ones, with no more than one shingle (or none), which many unlike texts share: with
e spare cells a linked pair has e + 1 equal cells, and whether a cell is poor
depends on its shingles alone, so a text sends its poor cells only if it has more
than e of them.

1. Texts with equal sets are one class (by 128 bits of hash sums); only classes
   are joined.  Each has a number, and one text of it is stored.
2. Cells (hash, class) are dealt by hash; those that stand in one class only go.
3. *Likely links.*  In a sixteenth of the cells, chosen by hash, each class meets
   the cell's leader; each class is verified against the two leaders that share
   most of these cells with it.  Components of the links follow.
4. *All other links.*  Cells whose classes lie in one component go.  A class of
   which fewer cells are left, in a layout, than a linked pair shares can't have a
   link to another component: it goes too.  Of the others only the rarest cells
   stay, one more than a linked pair may miss (a prefix in one order of all cells).
   There, sketches folded by XOR to ``BITS`` bits for each allowed difference are
   compared (folding can only bring sketches closer, so a distance beyond the bound
   forbids a link); of the pairs whose distance allows a link, those that would
   join components (a forest in each cell, not all pairs) are verified.  The step
   repeats, with more forests each time, until no untested pair is left.

Verification compares the sets themselves (of 64-bit shingle hashes).  In the end
each pair that shares a cell lies in one component, or its sketches forbid a link,
or its sets were compared; so no component is lost.

A full cell of classes that stay unlike is cut into blocks of ``BLOCK``, compared
two by two in tasks of their own: memory is bounded and no pair leaves a task that
its sketches refute, but comparisons grow with the square of such a cell.

Defined results: null, empty and word-less texts have the empty set, link with
nothing and are their own component; rows with one id are one node; rows with a
null id take part in links like others, and their component is null only if no
text in it has an id; very long texts have more cells, and nothing else changes;
columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.llm import graph
from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bits of a folded sketch for each allowed difference.
BITS = 8
#: Classes of a block of a full cell; rows of a group of small cells, and how many classes a small cell has.
BLOCK, TOGETHER, SMALL = 4096, 20_000, 64
#: So many 8-byte keys, at most, are broadcast.
MOST_KEYS = 1 << 18
#: Layouts of more cells than MANY show every SAMPLED-th cell, by hash, to the search for likely links.
SAMPLED, MANY = 16, 64


class Layouts:
    """Size bands and the number of cells of each."""

    def __init__(self, similarity: Fraction):
        self.s = similarity
        bounds = [1]
        while bounds[-1] < 1 << 34:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * 1.25)))
        self.bounds = np.array(bounds, np.int64)
        self.differ = np.array([int((1 - self.s) / (1 + self.s) * 2 * (b - 1)) for b in bounds[1:]], np.int64)
        plans = [self._spare(int(d), int(b)) for d, b in zip(self.differ, bounds)]
        self.spare = np.array([e for e, _ in plans], np.int64)
        self.poor = np.array([low for _, low in plans], np.int64)
        self.cells = self.differ + 1 + self.spare
        self.words = np.minimum(self.cells, (BITS * self.differ + 128 + 63) // 64)

    @staticmethod
    def _spare(differ: int, size: int) -> tuple[int, int]:
        """How many spare cells a layout has, and up to how many shingles a cell is poor: one if few enough
        spare cells allow it (cells fill as by a Poisson law)."""
        for low in (1, 0):
            spare = 3
            for _ in range(30):
                mean = 0.9 * size / (differ + 1 + spare)
                share = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(low + 1))
                spare = min(3 + math.ceil(1.4 * (differ + 1 + spare) * share), differ + 4)
            if spare <= 3 + 0.45 * differ:
                return spare, low
        return 3 + differ // 4, 0

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def of(self, n: np.ndarray):
        """(which text, layout) of every layout a text of n shingles takes part in."""
        low = self.band(np.maximum(n, 1))
        high = self.band(np.maximum((n * self.s.denominator) // self.s.numerator, 1))
        count = np.where(n > 0, high - low + 1, 0)
        which = np.repeat(np.arange(len(n)), count)
        layout = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        use = self.differ[layout] > 0  # else only equal sets link, and those are one class
        return which[use], layout[use]

    def _entries(self, h: np.ndarray, base: np.ndarray, which: np.ndarray, layout: np.ndarray):
        """Each (text, layout)'s shingles with the places of their cells, and where each one's cells begin."""
        cells = self.cells[layout]
        at = np.concatenate(([0], np.cumsum(cells)))
        count = np.diff(base)[which]
        entry = np.repeat(np.arange(len(which)), count)
        own = h[tk.ranges(base[which], count)]
        return own, at[entry] + ((own >> U64(8)) % cells[entry].astype(np.uint64)).astype(np.int64), at

    def sums(self, h: np.ndarray, base: np.ndarray, which: np.ndarray, layout: np.ndarray):
        """Of each (text, layout), end to end: the XOR of the hashes of each cell's shingles, their number, and where its cells begin."""
        own, place, at = self._entries(h, base, which, layout)
        out = np.zeros(at[-1], np.uint64)
        np.bitwise_xor.at(out, place, tk.mix(own ^ U64(0x2545F4914F6CDD1D)))
        return out, np.bincount(place, minlength=at[-1]), at

    def sketches(self, h: np.ndarray, base: np.ndarray, which: np.ndarray, layout: np.ndarray):
        """Cells as bits: each shingle flips one of its cell's 64."""
        own, place, at = self._entries(h, base, which, layout)
        out = np.zeros(at[-1], np.uint64)
        np.bitwise_xor.at(out, place, U64(1) << (own & U64(63)))
        return out, at

    def folded(self, sketch: np.ndarray, at: np.ndarray, layout: np.ndarray):
        """Sketches (as from ``sketches``) folded to ``words`` of their layout, and where each begins."""
        words = self.words[layout]
        to = np.concatenate(([0], np.cumsum(words)))
        out = np.zeros(to[-1], np.uint64)
        entry = np.repeat(np.arange(len(layout)), np.diff(at))
        np.bitwise_xor.at(out, to[entry] + (np.arange(len(entry)) - at[entry]) % words[entry], sketch)
        return out, to


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each text's begin."""
    n = len(offs) - 1
    buf = LOWER[buf]
    starts, ends, doc = tk.word_spans(buf, offs)
    h = tk.span_hash(buf, starts, ends)
    if len(h) >= k:
        at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
        g, own = tk.gram_hash(h, k)[at], doc[at]
    else:
        g, own = h[:0], doc[:0]
    words = np.bincount(doc, minlength=n)
    for m in range(1, k):  # a text of fewer words is one shingle
        few = np.flatnonzero(words == m)
        if len(few):
            first = np.searchsorted(doc, few)
            g = np.concatenate((g, tk.mix(tk.gram_hash(h, m)[first] + U64(m))))
            own = np.concatenate((own, few))
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])))
        g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(n + 1))


def keys_of(h: np.ndarray, base: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums over its elements."""
    out = np.zeros((len(base) - 1, 2), np.uint64)
    for j, v in enumerate((tk.mix(h), tk.mix(h ^ U64(0x5BF03635D1F2A7C9)))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
        out[:, j] = total[base[1:]] - total[base[:-1]]
    raw = out.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


KEYED = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("text", pa.string())])
CELLS = pa.schema([("mark", pa.int64()), ("cid", pa.int64()), ("tag", pa.int32())])
SHARED = pa.schema([*CELLS, ("m", pa.int32()), ("leader", pa.int64())])
SHARED_SQL = "mark long, cid long, tag int, m int, leader long"
MIXED = pa.schema([*CELLS, ("comp", pa.int64()), ("m", pa.int32())])
MIXED_SQL = "mark long, cid long, tag int, comp long, m int"
SKETCHES = pa.schema([("cid", pa.int64()), ("layout", pa.int32()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])
PAIRS = pa.schema([("mark", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])
#: tag: the layout, and how many equal cells (of those sent) a linked pair has at least
LAYOUT, NEED = 24, (1 << 24) - 1


def keyed(k: int):
    """(id, key of the set, its size, text); of an empty set no text."""

    def run(batches):
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs):
                h, base = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                n = np.diff(base)
                text = batch.column("text").slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(keys_of(h, base), pa.binary()), pa.array(n), text], schema=KEYED)

    return run


def cells_of(layouts: Layouts, k: int):
    """(mark, class, tag) of each cell that a class sends."""

    def run(batches):
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            cid = batch.column("cid").to_numpy()
            for lo, hi in tk.slices(offs, 1 << 19):
                h, base = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                which, layout = layouts.of(np.diff(base))
                value, held, at = layouts.sums(h, base, which, layout)
                entry = np.repeat(np.arange(len(which)), np.diff(at))
                poor = held <= layouts.poor[layout][entry]
                n_poor = np.bincount(entry[poor], minlength=len(which))
                few = n_poor <= layouts.spare[layout]
                sends = ~(poor & few[entry])
                need = np.minimum(layouts.spare[layout] + 1 - np.where(few, n_poor, 0), NEED)
                mark = tk.mix(value + tk.mix((layout[entry] << 32).astype(np.uint64) + (np.arange(len(entry)) - at[entry]).astype(np.uint64)))[sends]
                entry = entry[sends]
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(cid[lo + which[entry]]), pa.array((layout << LAYOUT | need)[entry].astype(np.int32))], schema=CELLS)

    return run


def shared_cells(layouts: Layouts):
    """Of one partition's cells, those of several classes, with their number of classes and, for likely links, a leader."""

    def run(batches):
        table = rp.gathered(batches, CELLS)
        mark, cid, tag = (rp.column(table, c) for c in CELLS.names)
        order = np.lexsort((tk.mix(cid.view(np.uint64) ^ tk.mix(mark.view(np.uint64))), mark))
        first = np.flatnonzero(np.concatenate(([True], mark[order][1:] != mark[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        m = np.diff(np.append(first, len(order)))
        run_ = np.repeat(np.arange(len(first)), m)
        keep = m[run_] > 1
        at, lead, m = order[keep], order[first[run_[keep]]], m[run_[keep]]
        shows = (layouts.cells[tag[at] >> LAYOUT] <= MANY) | (mark[at] % SAMPLED == 0)
        out = pa.table([pa.array(mark[at]), pa.array(cid[at]), pa.array(tag[at]), pa.array(m.astype(np.int32)), pa.array(cid[lead], mask=~shows)], schema=SHARED)
        yield from out.to_batches()

    return run


def mixed_cells(batches):
    """Of one partition's cells, those whose classes lie in several components."""
    table = rp.gathered(batches, MIXED)
    mark, comp = rp.column(table, "mark"), rp.column(table, "comp")
    order = np.lexsort((comp, mark))
    a, c = mark[order], comp[order]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(a)))
    keep = np.repeat(c[first] != c[first + size - 1], size)
    out = table.take(pa.array(order[keep]))
    yield from out.set_column(4, "m", pa.array(np.repeat(size, size)[keep].astype(np.int32))).to_batches()


def rarest_cells(batches):
    """Of each class and layout, the rarest cells, one more than a linked pair may miss; none if there are too few for a link."""
    table = rp.gathered(batches, MIXED)
    mark, cid, tag, m = (rp.column(table, c) for c in ("mark", "cid", "tag", "m"))
    order = np.lexsort((mark, m, tag, cid))
    c, t = cid[order], tag[order]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(c)))
    place = np.arange(len(c)) - np.repeat(first, size)
    keep = place < np.repeat(size, size) - (t & NEED) + 1
    yield from table.take(pa.array(order[keep])).to_batches()


def sketches_of(layouts: Layouts, k: int):
    """Folded sketches of each class, one for each layout it takes part in."""

    def run(batches):
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs, 1 << 19):
                h, base = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                n = np.diff(base)
                which, layout = layouts.of(n)
                folded, to = layouts.folded(*layouts.sketches(h, base, which, layout), layout)
                lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(folded.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(lo, hi - lo).take(pa.array(which)), pa.array(layout.astype(np.int32)), pa.array(n[which]), lists], schema=SKETCHES)

    return run


def _candidates(table: pa.Table, s: Fraction) -> list[np.ndarray]:
    """Of many small cells' classes, sorted by cell: the cells with a pair of different components whose sketches allow a link,
    as positions of their rows."""
    cell, comp, n = (rp.column(table, c) for c in ("mark", "comp", "n"))
    sketch = table.column("sketch").combine_chunks()
    flat, at = sketch.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(sketch.value_lengths().to_numpy().astype(np.int64))))
    hit = np.zeros(len(cell), bool)
    for step in range(1, len(cell)):
        i = np.flatnonzero(cell[:-step] == cell[step:])
        if not len(i):
            break
        i = i[(comp[i] != comp[i + step]) & (np.minimum(n[i], n[i + step]) * s.denominator >= np.maximum(n[i], n[i + step]) * s.numerator)]
        if not len(i):
            continue
        length = at[i + 1] - at[i]
        inner = tk.ranges(np.zeros(len(i), np.int64), length)
        d = np.add.reduceat(np.bitwise_count(flat[np.repeat(at[i], length) + inner] ^ flat[np.repeat(at[i + step], length) + inner]).astype(np.int64), np.cumsum(length) - length)
        hit[i[d * (s.denominator + s.numerator) <= (n[i] + n[i + step]) * (s.denominator - s.numerator)]] = True
    cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    some = np.add.reduceat(hit, cuts[:-1], dtype=np.int64) > 0
    return [np.arange(x, y) for x, y in zip(cuts[:-1][some], cuts[1:][some])]


def _forests(s: Fraction, width: int):
    """For groups of many small cells, or of one full cell (or two of its blocks)."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("pair")[0].as_py() >= 0:
            return rp.rows(PAIRS, _forest(table, s, width))
        table = table.sort_by([("mark", "ascending"), ("cid", "ascending")])
        return rp.rows(PAIRS, [row for at in _candidates(table, s) for row in _forest(table.take(pa.array(at)), s, width)])

    return run


def _forest(table: pa.Table, s: Fraction, width: int) -> list[tuple]:
    """Of one cell's classes (or two blocks of them): pairs, least distance first, that would join different
    components, where the sketches allow a link; ``width`` such forests, and whether more pairs are left."""
    table = table.sort_by([("cid", "ascending")])
    cid, n, block = (rp.column(table, c) for c in ("cid", "n", "block"))
    _, comp = np.unique(rp.column(table, "comp"), return_inverse=True)
    sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cid), -1)
    pair, cell = table.column("pair")[0].as_py(), table.column("mark")[0].as_py()
    two, more, found = pair >= 0 and pair >> 32 != pair & 0xFFFFFFFF, False, []
    for i in range(len(cid) - 1):
        ok = (comp[i + 1 :] != comp[i]) & (np.minimum(n[i], n[i + 1 :]) * s.denominator >= np.maximum(n[i], n[i + 1 :]) * s.numerator)
        if two:
            ok &= block[i + 1 :] != block[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            d = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1, dtype=np.int64)
            ok = d * (s.denominator + s.numerator) <= (n[i] + n[at]) * (s.denominator - s.numerator)
            at, d = at[ok], d[ok]
            order = np.lexsort((d, comp[at]))
            last, many = -1, 0
            for j, x in zip(at[order].tolist(), d[order].tolist()):
                if comp[j] != last:
                    last, many = comp[j], 0
                if many < width:  # the nearest of each other component
                    found.append((x, i, j))
                    many += 1
                else:
                    more = True
    out, found = [], sorted(found)
    for _ in range(width):
        up, left = list(range(int(comp.max()) + 1)), []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for e in found:
            x, y = top(comp[e[1]]), top(comp[e[2]])
            if x == y:
                left.append(e)
            else:
                up[x] = y
                out.append((cell, int(cid[e[1]]), int(cid[e[2]])))
        found = left
        if not left:
            break
    more |= bool(found)
    return [(*row, more) for row in out]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: Fraction | str = "4/5", chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    s = Fraction(similarity)
    layouts = Layouts(s)
    docs = rp.whole(docs, id_col, text_col)
    parts = rp.places_of(docs, chunk_bytes)
    sets = docs.mapInArrow(keyed(k), "id long, key binary, n long, text string")
    with graph.Tables(docs, parts) as tables:
        # empty sets link with nothing: names of their own keep them apart, and from meeting in one task
        members = tables.result(sets.select("id", F.when(F.col("n") > 0, F.col("key")).otherwise(F.concat(F.lit("id "), F.coalesce("id", F.lit(0)).cast("string")).cast("binary")).alias("key"), "n"))
        own = sets.where("n > 0").groupBy("key").agg(F.first("text").alias("text"), F.min("id").alias("id"))
        classes = tables.keep(own.select(F.monotonically_increasing_id().alias("cid"), "key", "id", "text"))
        cells = classes.select("cid", "text").mapInArrow(cells_of(layouts, k), "mark long, cid long, tag int")
        shared = tables.keep(cells.repartition(parts, "mark").mapInArrow(shared_cells(layouts), SHARED_SQL))

        # likely links: leaders that share most of the cells that are shown
        shown = F.element_at(F.array(*[F.lit(int(c) if c <= MANY else math.ceil(c / SAMPLED)) for c in layouts.cells]), F.shiftright("tag", LAYOUT) + 1)
        met = shared.where("leader IS NOT NULL AND leader <> cid").groupBy("cid", "leader", "tag").agg(F.count(F.lit(1)).alias("m"))
        met = met.where(F.col("m") * 3 >= shown).withColumn("at", F.struct("m", "leader"))
        top = met.groupBy("cid").agg(F.max("at").alias("one"), F.max_by("at", F.struct("m", F.xxhash64("leader"))).alias("two"))
        first = top.select("cid", F.explode(F.array("one.leader", "two.leader")).alias("other"))
        likely = tables.small(first.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct())
        tested = tables.keep(_verify(classes, likely, k, s))
        # rows of one id are one node
        ids = tables.small(members.where("id IS NOT NULL AND n > 0").join(classes.select("key", "cid"), "key").select("id", "cid"))
        least = ids.groupBy("id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a <> z").select("id", "a")
        same = tables.small(ids.join(least, "id").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())

        def labels_of(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
            """(class, component) of all linked classes; to what is known, new links only add links between components."""
            ends = links if labels is None else _renamed(links, labels)
            found = graph.components(ends, tables).select(F.col("node").alias("cid"), F.col("component").alias("comp"))
            if labels is None:
                return tables.small(found)
            found = tables.small(found)
            known = labels.union(found.select("cid", F.col("cid").alias("comp"))).distinct()
            moved = found.select(F.col("cid").alias("comp"), F.col("comp").alias("_to"))
            return tables.small(known.join(moved, "comp", "left").select("cid", F.coalesce("_to", "comp").alias("comp")))

        def placed(cells: DataFrame, labels: DataFrame) -> DataFrame:
            return cells.drop("comp").join(labels, "cid", "left").select("mark", "cid", "tag", F.coalesce("comp", "cid").alias("comp"), "m")

        # cells that hold several components, until no pair is left to test
        labels = labels_of(tested.where("linked").select("a", "b").union(same))
        mixed = placed(shared, labels).repartition(parts, "mark").mapInArrow(mixed_cells, MIXED_SQL)
        left = tables.keep(mixed.repartition(parts, "cid").mapInArrow(rarest_cells, MIXED_SQL))
        tables.drop(shared)
        wanted = left.select("cid").distinct()
        sketches = tables.keep(classes.select("cid", "text").join(wanted, "cid", "left_semi").mapInArrow(sketches_of(layouts, k), "cid long, layout int, n long, sketch array<long>"))
        width = 4
        while True:
            todo = placed(left, labels)
            mixed = todo.groupBy("mark").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n_cell")).where("x <> y").select("mark", "n_cell")
            rest = tables.keep(todo.drop("m").join(mixed, "mark").withColumn("layout", F.shiftright("tag", LAYOUT)).drop("tag"))
            if not (n_rest := rest.count()):
                break
            pairs = tables.keep(_pairs(rest, sketches, s, width, math.ceil(n_rest / TOGETHER)))
            new = tables.small(pairs.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
            now = tables.keep(_verify(classes, new, k, s))
            n_new = now.count()
            if n_new:
                tested = tested.unionByName(now)
                labels = labels_of(now.where("linked").select("a", "b"), labels)
            again = pairs.where("more").select("mark").distinct()
            if not n_new and again.isEmpty():
                break
            # a cell whose pairs were all tested has nothing more to give; one with a refuted pair may have others
            refuted = pairs.join(now.where("NOT linked"), ["a", "b"], "left_semi").select("mark")
            left = tables.small(left.join(again.union(refuted).distinct(), "mark", "left_semi"))
            width *= 4
        least = placed(classes.select(F.lit(0).alias("mark"), "cid", F.lit(0).alias("tag"), F.lit(0).alias("m")), labels).join(classes.select("cid", "key", "id"), "cid")
        names = least.groupBy("comp").agg(F.min("id").alias("component_id"))
        named = tables.result(least.join(names, "comp").select("key", "component_id"))
    return members.join(named, "key", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _renamed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between classes as links between their components."""
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("comp").alias(f"_{c}"))
    return links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))


def _pairs(rest: DataFrame, sketches: DataFrame, s: Fraction, width: int, groups: int) -> DataFrame:
    """Pairs of classes to verify; many small cells make one group, a full cell's blocks meet two by two."""
    n_blocks = F.ceil(F.col("n_cell") / BLOCK).cast("long")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("cid", "mark"), n_blocks))
    other = F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda j: F.shiftleft(F.least(j, F.col("block")), 32) + F.greatest(j, F.col("block")))
    small = F.col("n_cell") <= SMALL
    rest = rest.withColumn("pair", F.explode(F.when(small, F.array(F.lit(-1).cast("long"))).otherwise(other))).withColumn("group", F.when(small, F.pmod(F.xxhash64("mark"), F.lit(groups))).otherwise(F.col("mark")))
    rest = rest.join(sketches, ["cid", "layout"]).select("group", "pair", "mark", "cid", "n", "comp", "block", "sketch")
    return rest.groupBy("group", "pair").applyInArrow(_forests(s, width), "mark long, a long, b long, more boolean")


def _verify(classes: DataFrame, pairs: DataFrame, k: int, s: Fraction) -> DataFrame:
    """The pairs (a, b) with ``linked``: whether their sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    if wanted.count() <= MOST_KEYS:  # else all texts are dealt by class
        classes = classes.join(F.broadcast(wanted), "cid", "left_semi")
    texts = lambda c: classes.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(texts("a"), "a").join(texts("b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def test(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                (ha, ba), (hb, bb) = (shingles(*tk.pack(part.column(c)), k) for c in ("text_a", "text_b"))
                linked = []
                for i in range(part.num_rows):
                    x, y = ha[ba[i] : ba[i + 1]], hb[bb[i] : bb[i + 1]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(same > 0 and same * s.denominator >= (len(x) + len(y) - same) * s.numerator)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], schema=schema)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long, linked boolean")
