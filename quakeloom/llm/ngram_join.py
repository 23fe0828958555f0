"""Exact Jaccard links between documents' word n-grams, by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._graph import components
from quakeloom.llm._scale import ROW, bucket, drop_rows, keep, lean, mark_buckets, materialise, numbered, working_tables
from quakeloom.llm._text import NONSPACE, mix, signed, slabs, word_hashes

#: Counters of the rarity table, by the leading bits of a shingle's hash: 1 MB whatever the data.
COUNTERS = 1 << 18
_SHIFT = np.uint64(64 - 18)
#: Signatures that propose groups, and the minima in each.
BANDS, MINIMA = 4, 3
_STRETCHES = 16
#: Members or queries read together when a group is opened.
BLOCK = 64

_PLACE = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD6, 0xA24BAED4963EE406, 0x9FB21C651E98DF24, 0xD6E8FEB86659FD92, 0xC2B2AE3D27D4EB4E)]
_ROW = np.array(_PLACE[:MINIMA])
_SEEDS = mix(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``size`` consecutive words; fewer words are one shingle."""
    w, at = word_hashes(buf, offs, NONSPACE)
    n = len(w)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled[: max(0, n - j)] += w[j:] * (_PLACE[j % len(_PLACE)] + np.uint64(2 * (j // len(_PLACE))))
    rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j])
            yield h
        else:
            yield w[:0]


def _least_overlap(n, m, percent: int):
    """Least common shingles of linked sets of n and m: percent * (n + m) / (100 + percent), rounded up."""
    return -(-(percent * (n + m)) // (100 + percent))


def _count(size: int):
    """Documents to one task's shingle counters, in stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, buf, offs in slabs(batch.column(0)):
                found = list(shingle_sets(buf, offs, size))
                counts += np.bincount((np.concatenate(found) >> _SHIFT).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        part = COUNTERS // _STRETCHES
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(_STRETCHES, TaskContext.get().partitionId() // 512), pa.int64()),
                pa.array(np.arange(_STRETCHES), pa.int64()),
                pa.array([counts[k * part : (k + 1) * part].tobytes() for k in range(_STRETCHES)], pa.binary()),
            ],
            names=["tasks", "stretch", "counts"],
        )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // _STRETCHES, np.uint64)
    for raw in table["counts"]:
        total += np.frombuffer(raw.as_buffer(), np.uint32)
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table(
        {"tasks": pa.array([0], pa.int64()), "stretch": table["stretch"][:1], "counts": pa.array([total.tobytes()], pa.binary())}
    )


def _rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall on each counter; added up 512 tasks at a time."""
    ddl = "tasks long, stretch long, counts binary"
    parts = docs.select("text").mapInArrow(lean(_count(size)), ddl).groupBy("stretch", "tasks").applyInArrow(_add, ddl)
    table = parts.groupBy("stretch").applyInArrow(_add, ddl).toArrow().sort_by("stretch")
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["counts"]]) if len(table) else np.zeros(COUNTERS, np.uint32)


def _common_in_prefix(percent: int) -> int:
    """Shingles that the prefixes of two linked, different sets must have in common, at least.

    Such sets share at least percent / (100 - percent) shingles, and prefixes of n - least overlap + k
    hold k of them for any k up to that; three leave few pairs that meet by chance.
    """
    return max(1, min(3, percent // max(1, 100 - percent)))


def _describe(size: int, percent: int, shared):
    """Documents to set size, set hashes, group signatures, mean rarity, and the necessary prefix in order of rarity."""
    common = _common_in_prefix(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for lo, hi, buf, offs in slabs(batch.column(1)):
                n, a, b, keys, rare, prefix = [], [], [], [], [], []
                for s in shingle_sets(buf, offs, size):
                    n.append(len(s))
                    if not len(s):
                        a.append(0), b.append(0), keys.append([]), rare.append(0.0), prefix.append([])
                        continue
                    a.append(int(s.sum(dtype=np.uint64)))
                    b.append(int(np.bitwise_xor.reduce(mix(s))))
                    least = np.array([mix(s ^ x).min() for x in _SEEDS]).reshape(BANDS, MINIMA)
                    keys.append(signed(mix((least * _ROW).sum(axis=1, dtype=np.uint64))).tolist())
                    c = counts[(s >> _SHIFT).astype(np.int64)]
                    rare.append(float((1.0 / c).mean()))
                    need = len(s) - -(-percent * len(s) // 100) + common
                    prefix.append(signed(s[np.lexsort((s, c))[:need]]).tolist())
                u64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        u64(a),
                        u64(b),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(rare, pa.float64()),
                        pa.array(prefix, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "a", "b", "keys", "rare", "prefix"],
                )

    return run


def _meet(percent: int):
    """Postings sorted by (token, grp) to pairs of different groups that share a prefix token and may hold a link.

    A group's rows of a token are one: its least and greatest set size and the most shingles that may
    stand before and after the token. The last token of a batch waits for the next batch.
    """

    def pairs(token, grp, least, most, before, follow) -> Iterator[pa.RecordBatch]:
        for d in range(1, len(token)):
            i = np.flatnonzero(token[:-d] == token[d:])
            if not len(i):
                break
            j = i + d
            fits = (100 * most[j] >= percent * least[i]) & (100 * most[i] >= percent * least[j])
            room = np.minimum(before[i], before[j]) + 1 + np.minimum(follow[i], follow[j])
            room = room >= _least_overlap(least[i], least[j], percent)
            i, j = i[fits & room], j[fits & room]
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(grp[i], grp[j])), pa.array(np.maximum(grp[i], grp[j]))], names=["g", "h"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                token, grp, n, pos = (batch.column(k).to_numpy() for k in range(4))
                rows = [token, grp, n, n, pos, n - pos - 1]
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                new = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))
                rows = [
                    rows[0][new],
                    rows[1][new],
                    np.minimum.reduceat(rows[2], new),
                    np.maximum.reduceat(rows[3], new),
                    np.maximum.reduceat(rows[4], new),
                    np.maximum.reduceat(rows[5], new),
                ]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                held = [x[cut:] for x in rows]
                rows = [x[:cut] for x in rows]
            else:
                rows, held = held or [np.zeros(0, np.int64)] * 6, None
            shared = np.zeros(len(rows[0]) + 1, bool)
            shared[1:-1] = rows[0][1:] == rows[0][:-1]
            several = shared[1:] | shared[:-1]
            yield from pairs(*(x[several] for x in rows))

    return run


def _and_end(batches):
    yield from batches
    yield None


def _both_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of the texts x and y of each row (a, b, x, y)."""
    sets = [[s for _, _, buf, offs in slabs(batch.column(k)) for s in shingle_sets(buf, offs, size)] for k in (2, 3)]
    return zip(*sets, strict=True)


def _verify(size: int, percent: int):
    """Pairs with both texts to those that have ``percent`` of their union in common, with the sizes of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(_both_sets(batch, size)):
                common[k] = len(np.intersect1d(x, y, assume_unique=True))
                union[k] = len(x) + len(y) - common[k]
            alike = (common > 0) & (100 * common >= percent * union)
            kept = batch.filter(pa.array(alike))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(common[alike]), pa.array(union[alike])], names=["a", "b", "both", "either"])

    return run


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of document ids with the texts x and y."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = mark_buckets(docs, bucket(F.col("doc_id")), needed, "needed").filter("needed").select("doc_id", "text")
    # the ids of representatives are distinct unless the table repeats an id; then any of its texts may speak for it
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _alike(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) of document ids those alike by ``percent``: a, b, and the sizes of intersection (both) and union (either)."""
    return _with_texts(pairs, docs).select("a", "b", "x", "y").mapInArrow(lean(_verify(size, percent)), "a long, b long, both long, either long")


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) of document ids those whose texts are linked."""
    return _alike(pairs, docs, size, percent).select("a", "b")


def _differences(size: int, percent: int, shared):
    """(node a, pivot b, both texts) to a, its set size n, whether it is linked to the pivot, and its difference from it.

    The difference holds the shingles in one of the two sets only, rarest first. A place in it from
    which a linked partner's common shingles can no longer begin is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            n, linked, total, kept = [], [], [], []
            for x, y in _both_sets(batch, size):
                d = np.setxor1d(x, y, assume_unique=True)
                d = d[np.lexsort((d, counts[(d >> _SHIFT).astype(np.int64)]))]
                least = max(1, -(-(len(d) - (100 - percent) * len(x) // percent) // 2))
                n.append(len(x))
                linked.append(len(d) <= _most_apart(len(x), len(y), percent))
                total.append(len(d))
                kept.append(signed(d[: max(0, len(d) - least + 1)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), pa.array(total, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                names=["a", "b", "n", "linked", "total", "difference"],
            )

    return run


def _most_apart(n, m, percent: int):
    """Most shingles that linked sets of n and m do not share: (100 - percent) * (n + m) / (100 + percent), rounded down."""
    return (100 - percent) * (n + m) // (100 + percent)


def _meet_inside(percent: int):
    """Differences' shingles sorted by (grp, token) to pairs of nodes of different components that may be linked.

    Sets at distances p and q from a pivot, whose differences have c shingles in common, are p + q - 2c
    apart. So linked ones have c at least (p + q - most apart) / 2, and the first of these stands where
    at least that many follow in both. Where that is none, both are linked to the pivot itself.
    """

    def pairs(grp, token, comp, node, n, total, pos) -> Iterator[pa.RecordBatch]:
        i, d = np.arange(len(grp)), 0
        while len(i):
            d += 1
            i = i[i + d < len(grp)]
            i = i[(token[i] == token[i + d]) & (grp[i] == grp[i + d])]
            j = i + d
            least = np.maximum(1, -(-(total[i] + total[j] - _most_apart(n[i], n[j], percent)) // 2))
            ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            ok &= np.minimum(total[i] - pos[i], total[j] - pos[j]) >= least
            if ok.any():
                x, y = node[i[ok]], node[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is None:
                rows, held = held, None
            elif batch.num_rows:
                rows = [batch.column(k).to_numpy() for k in range(7)]
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                cut = int(((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])).argmax())  # the last shingle may go on
                rows, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            else:
                continue
            if rows is not None:
                yield from pairs(*rows)

    return run


def _inside(grouped: DataFrame, links: DataFrame, docs: DataFrame, size: int, percent: int, counts) -> DataFrame:
    """Links (a, b) inside groups that ``links`` do not yet connect as a whole, so that none is missing there.

    A group's members are compared by their differences from its most central node: they have few
    shingles in common with each other's, where their whole sets have nearly all.
    """
    own = _grouped(grouped.withColumnRenamed("grp", "family"), components(links)).withColumnRenamed("grp", "comp")
    lead = own.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("rare", "node", "comp")).alias("p"))
    lead = lead.filter("lo <> hi").select("family", F.col("p.node").alias("pivot"), F.col("p.comp").alias("pivot_comp"))
    star = own.join(lead, "family").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "comp", "pivot_comp", F.col("family").alias("grp"))
    star = materialise(star, "stars")
    ddl = "a long, b long, n long, linked boolean, total long, difference array<long>"
    texts = _with_texts(star.select("a", "b"), docs).select("a", "b", "x", "y")
    apart = materialise(texts.mapInArrow(lean(_differences(size, percent, counts)), ddl), "differences")
    label = F.when(F.col("linked"), F.col("pivot_comp")).otherwise(F.col("comp"))
    rows = (
        apart.join(star.drop("b"), "a")
        .select("grp", label.alias("comp"), F.col("a").alias("node"), "n", "total", F.posexplode("difference").alias("pos", "token"))
        .select("grp", "token", "comp", "node", "n", "total", F.col("pos").cast("long").alias("pos"))
    )
    met = rows.repartition("grp", "token").sortWithinPartitions("grp", "token").mapInArrow(lean(_meet_inside(percent)), "a long, b long").distinct()
    near = apart.filter("linked").select("a", "b")
    return near.unionByName(_linked(materialise(met, "met-inside"), docs, size, percent))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the least id reachable by links.

    A document's set is its distinct shingles of ``size`` words (white space apart, A-Z folded); two
    documents are linked when ``100 * intersection >= percent * union``.

    1. Equal sets are one node. 2. Nodes whose least shingles agree under several orders are proposed
    as a group; each is verified against the group's most central node, the one of the most common
    shingles, and what is similar, if not linked, forms the groups of the matrix. Links inside a group
    are found by the members' differences from its central node. 3. The matrix holds each group's
    union of necessary prefix shingles, rarest first over all documents; groups that share one, with
    sizes and places that leave room for enough common shingles, may hold a link. Of those, central
    nodes are verified first; 4. if groups of several nodes are still apart, each node of the smaller
    is a query: the shingles it has in common with the other group's whole union bound its overlap with
    every member, and only groups whose bound reaches the threshold are opened and verified.

    Links between different components are complete: none is lost by a cap. No group is gathered: all
    steps are joins and pre-aggregated groupings by shingle, node or group.

    Ids are integers, or text of them; other text is an error.
    Null or wordless text has an empty set, no links, and its own id. Null ids never link. Rows that
    repeat an id are one document if their texts are equal; else each text is a node under that id, and
    what any of them is linked to is reached through it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_rarity(base, size))
    ddl = "doc_id long, n long, a long, b long, keys array<long>, rare double, prefix array<long>"
    described = materialise(base.mapInArrow(lean(_describe(size, percent, counts)), ddl), "shingled")
    sets = described.filter("n > 0 and doc_id is not null")
    nodes = materialise(
        sets.groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "keys", "rare")).alias("x"))
        .select("n", "a", "b", F.col("x.doc_id").alias("node"), F.col("x.keys").alias("keys"), F.col("x.rare").alias("rare")),
        "nodes",
    )

    proposed = nodes.select("node", "n", "rare", F.posexplode("keys").alias("band", "key"))
    loose = max(1, 2 * percent - 100)  # what two documents have in common at least that are linked to a third
    central = proposed.groupBy("band", "key").agg(F.min(F.struct("rare", "node", "n")).alias("c"))
    pairs = (
        proposed.join(central, ["band", "key"])
        .filter("node <> c.node and 100 * least(n, c.n) >= {0} * greatest(n, c.n)".format(loose))
        .select(F.col("node").alias("a"), F.col("c.node").alias("b"))
        .distinct()
    )
    alike = materialise(_alike(materialise(pairs, "proposed"), base, size, loose), "alike")
    links = alike.filter(f"100 * both >= {percent} * either").select("a", "b")

    grouped = _grouped(nodes, components(alike.select("a", "b")))
    links = materialise(links.unionByName(_inside(grouped, links, base, size, percent, counts)), "links")
    postings = (
        described.select("doc_id", "prefix")
        .join(grouped.select(F.col("node").alias("doc_id"), "n", "grp"), "doc_id")
        .select(F.posexplode("prefix").alias("pos", "token"), "n", "grp")
        .select("token", "grp", "n", F.col("pos").cast("long").alias("pos"))
    )
    spread = postings.repartition("token").sortWithinPartitions("token", "grp")
    met = spread.mapInArrow(lean(_meet(percent)), "g long, h long").groupBy("g", "h").agg(F.count("*").alias("shared"))
    met = materialise(met.filter(F.col("shared") >= _common_in_prefix(percent)).select("g", "h"), "groups-met")

    pivots = grouped.groupBy("grp").agg(F.min(F.struct("rare", "node", "n")).alias("p"), F.count("*").alias("members"))
    pivots = materialise(pivots.select("grp", F.col("p.node").alias("pivot"), F.col("p.n").alias("n"), "members"), "pivots")
    ends = met.join(pivots.select(F.col("grp").alias("g"), F.col("pivot").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma")), "g").join(
        pivots.select(F.col("grp").alias("h"), F.col("pivot").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb")), "h"
    )
    ends = materialise(ends, "ends")
    by_pivot = ends.filter("100 * least(na, nb) >= {0} * greatest(na, nb)".format(percent)).select("a", "b").distinct()
    links2 = materialise(links.unionByName(_linked(materialise(by_pivot, "by-pivot"), base, size, percent)), "links")

    grouped2 = _grouped(nodes, components(links2))
    root = grouped.select("grp", "node").join(grouped2.select("node", F.col("grp").alias("root")), "node").groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    apart = materialise(
        ends.filter("ma > 1 or mb > 1")
        .join(root.select(F.col("grp").alias("g"), F.col("lo").alias("lg"), F.col("hi").alias("hg")), "g")
        .join(root.select(F.col("grp").alias("h"), F.col("lo").alias("lh"), F.col("hi").alias("hh")), "h")
        .filter("not (lg = hg and lh = hh and lg = lh)")
        .select(F.when(F.col("ma") <= F.col("mb"), F.col("g")).otherwise(F.col("h")).alias("small"), F.when(F.col("ma") <= F.col("mb"), F.col("h")).otherwise(F.col("g")).alias("large")),
        "apart",
    )
    links3 = links2.unionByName(_open(apart, grouped, base, size, percent))

    final = _grouped(nodes, components(links3)).select("n", "a", "b", F.col("grp").alias("component"))
    out = described.select("doc_id", "n", "a", "b").join(final, ["n", "a", "b"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _grouped(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with grp: the least node of the component that links make, itself if none."""
    return materialise(nodes.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root", "keys"), "grouped")


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slabs(batch.column(1)):
                sets = [signed(s) for s in shingle_sets(buf, offs, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"]
                )

    return run


def _search(percent: int):
    """(block of queries, block of an opened group's members) to linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for queries, members in zip(batch.column(0), batch.column(1), strict=True):
                ids = members.values.field("node").to_numpy()
                sets = members.values.field("tokens")
                n = np.diff(sets.offsets.to_numpy())
                tokens, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(ids)), n)
                for q in queries:
                    own = q["tokens"].values.to_numpy()
                    own = np.sort(own)
                    k = np.searchsorted(own, tokens)
                    k[k == len(own)] = 0
                    common = np.bincount(owner[own[k] == tokens], minlength=len(ids))
                    hit = np.flatnonzero((common > 0) & (100 * common >= percent * (n + len(own) - common)))
                    a += [q["node"].as_py()] * len(hit)
                    b += ids[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _open(apart: DataFrame, grouped: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (query node, member): queries are the nodes of ``small``, which may reach into the group ``large``.

    An opened group is read in blocks of about ``BLOCK`` members by blocks of about ``BLOCK`` queries,
    so neither a whole group nor a row for each pair is ever made.
    """
    groups = apart.select(F.explode(F.array("small", "large")).alias("grp")).distinct()
    members = materialise(grouped.join(groups, "grp", "left_semi").select("node", "grp").distinct(), "members")
    texts = mark_buckets(docs, bucket(F.col("doc_id")), members.select("node"), "needed").filter("needed")
    texts = texts.select(F.col("doc_id").alias("node"), "text").join(members.select("node"), "node", "left_semi")
    tokens = texts.mapInArrow(lean(_shingles(size)), "node long, tokens array<long>").join(members, "node")
    # a repeated id keeps each of its different texts
    tokens = tokens.select("node", "grp", F.size("tokens").cast("long").alias("n"), "tokens", F.xxhash64("tokens").alias("content"))
    tokens = materialise(tokens.dropDuplicates(["node", "content"]).drop("content"), "tokens")

    queries = apart.join(tokens.select(F.col("grp").alias("small"), F.col("node").alias("q"), F.col("n").alias("nq"), "tokens"), "small")
    matrix = tokens.join(apart.select(F.col("large").alias("grp")).distinct(), "grp", "left_semi")
    matrix = matrix.select(F.col("grp").alias("large"), F.explode("tokens").alias("token")).distinct()
    bound = (
        queries.select("q", "nq", "large", F.explode("tokens").alias("token"))
        .join(matrix, ["large", "token"])
        .groupBy("q", "nq", "large")
        .agg(F.count("*").alias("most"))
        .filter(f"100 * most >= {percent} * nq")
        .select("q", "large")
    )
    size_of = members.groupBy("grp").agg(F.count("*").alias("members"))
    asked = bound.groupBy("large").agg(F.count("*").alias("asking"))
    part = lambda col, n: F.pmod(F.xxhash64(col), F.ceil(F.col(n) / BLOCK))
    blocks_q = (
        bound.join(asked, "large").join(tokens.select(F.col("node").alias("q"), "tokens"), "q")
        .groupBy("large", part("q", "asking").alias("block_q"))
        .agg(F.collect_list(F.struct(F.col("q").alias("node"), "tokens")).alias("queries"))
    )
    blocks_m = (
        tokens.join(asked.select(F.col("large").alias("grp")), "grp", "left_semi").join(size_of, "grp")
        .groupBy(F.col("grp").alias("large"), part("node", "members").alias("block_m"))
        .agg(F.collect_list(F.struct("node", "tokens")).alias("members"))
    )
    return blocks_q.join(blocks_m, "large").select("queries", "members").mapInArrow(lean(_search(percent)), "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component only, that with the least id; columns as they were. Wordless documents stay.

    Rows are the documents, whatever ids they share; a null id comes before all others, of equal ids the first row stays.
    """
    rows = numbered(docs)
    with working_tables(docs.sparkSession):
        found = materialise(jaccard_components(rows, ROW, text_col, size, percent), "components")
        ids = rows.select(F.col(ROW).alias("doc_id"), F.col(id_col).alias("id"))
        kept = found.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("doc_id"))
        gone = keep(found.select("doc_id").join(kept, "doc_id", "left_anti"), "near-dropped")
    return drop_rows(rows, gone)
