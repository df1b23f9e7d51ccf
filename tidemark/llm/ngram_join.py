"""N-gram Jaccard join (operator 7): chosen-path join over word shingles.

Documents with equal shingle sets are one class.  In each run a class chooses
those of its shingles whose hash under the run is below ``1 / (threshold *
size)``: 1.25 on average at 0.8, and two sets with that similarity share one or
more of them on average.  A chosen shingle is a bucket.  Buckets of at most
``SMALL`` classes are compared; those with more are split again by the shingles
chosen under the bucket's own path, and so on, until they are small, or ``DEPTH``
is reached, or a bucket keeps half of the one it comes from: then its classes
are mostly alike, no path tells them apart, and it is compared in blocks.  Runs
are repeated until a pair at the threshold meets with probability ``recall`` in
two steps (see ``recall_at`` for more of them).

Buckets are compared by sketches of ``BINS`` bytes with a slack of many standard
deviations, and only the edges of a spanning forest leave a task.  The clusters
these give are candidates.  One of many blocks without a bucket that holds half
of it is a chain of texts that are only a little alike: its buckets are compared
exactly, which parts it.  Then all pairs of a cluster are compared exactly, in
blocks, so that a cluster of near copies never fills one task and no pair is
emitted.

Defined results: see ``words.shingles`` for words and short texts; a text
without words links with nothing; each row gives a row; rows with one id are one
document (of texts that differ, the one with the least digest); a null id has no
class and no links; ids may be of any type that has an order; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import Numbered, components, forest
from tidemark.llm.scratch import Scratch, fresh
from tidemark.llm.url_filter import bloom_words, fitting_blocks, may_hold
from tidemark.llm.words import mix, shingles

#: Bytes of a sketch; classes of a bucket that is not split again; sketches in a block.
BINS, SMALL, BUCKET = 128, 64, 1024
#: Paths at most that are known to be large without meeting.
FREQUENT = 4096
#: Steps of a path at most; share of a bucket that no further step would split.
DEPTH, DENSE = 6, 0.5
#: Classes and shingles in a block of the exact comparison.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Sketches that agree in less than this share below the threshold are not looked at: 5 standard deviations.
SLACK = 0.18
COLUMNS = 8192


def _meets(depth: int) -> float:
    """Chance that a pair at the threshold shares a path of ``depth`` steps in one run: it shares a chosen shingle with 1 - 1/e, and so on below it."""
    out = 1.0
    for _ in range(depth):
        out = 1 - math.exp(-out)
    return out


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold meets in two steps."""
    return math.ceil(math.log(1 - recall) / math.log(1 - _meets(2)))


def recall_at(depth: int, runs: int) -> float:
    """Chance that a pair at the threshold meets where buckets are split down to ``depth``."""
    return 1 - (1 - _meets(depth)) ** runs


def _seed(n: int) -> np.uint64:
    return np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def chosen(own: np.ndarray, path: np.uint64, threshold: float) -> np.ndarray:
    """Paths one step on from ``path``."""
    hashes = mix(own ^ path)
    most = min((1 << 64) - 1, int((1 << 64) / (threshold * len(own))))
    return mix(own[hashes <= np.uint64(most)] + path)


def sketch(own: np.ndarray) -> bytes:
    """One-permutation MinHash: a byte of the least hash in each bin, 0 for an empty bin."""
    out = np.zeros(BINS, np.uint8)
    spread = mix(own ^ np.uint64(0xA5A5))
    order = np.argsort(spread)[::-1]
    spread = spread[order]
    out[((spread ^ (spread >> np.uint64(23))) & np.uint64(BINS - 1)).astype(np.int64)] = (spread >> np.uint64(8)).astype(np.uint8) | np.uint8(1)
    return out.tobytes()


def alike(sketches: np.ndarray, least: float):
    """Says which sketches agree with one in a share of ``least`` of the bins that either has."""

    def linked(i, rest):
        a, b = sketches[i], sketches[rest]
        return ((a == b) & (a != 0)).sum(1) >= least * ((a != 0) | (b != 0)).sum(1)

    return linked


_SETS = "id long, digest binary, set binary, size int, sketch binary, paths array<long>, deep array<long>, parents array<long>"


def _sets(k: int, threshold: float, runs: int):
    def run(batches):
        for batch in batches:
            rows = []
            known: dict[bytes, tuple] = {}
            for text in batch.column(1):
                own = shingles(text.as_py(), k)
                if not len(own):
                    rows.append((None, 0, None, None, None, None))
                    continue
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                row = known.get(digest)
                if row is None:
                    first, deep, parents = [], [], []
                    for r in range(runs):
                        for path in chosen(own, _seed(r), threshold):
                            first.append(path)
                            more = chosen(own, path, threshold)
                            deep.append(more)
                            parents += [path] * len(more)
                    flat = lambda x: np.array(x, np.uint64).view(np.int64)
                    row = known[digest] = (digest, len(own), sketch(own), flat(first), flat(np.concatenate(deep)) if deep else flat([]), flat(parents))
                rows.append(row)
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["id", "digest", "set", "size", "sketch", "paths", "deep", "parents"])

    return run


_BUCKETS = pa.schema([("path", pa.int64()), ("members", pa.list_(pa.int64()))])


def _buckets(most: int):
    """From (path, node) sorted by path: a row of the members of each bucket with 2 to ``most``; of a larger one a row for each member."""

    def run(batches):
        path, held, large, out = None, [], False, []

        def end():
            if len(held) > 1 and not large:
                out.append((path, held))

        for batch in batches:
            paths, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = paths[1:] == paths[:-1]
            for i in np.flatnonzero(np.r_[True, same] | np.r_[same, True]).tolist():
                if paths[i] != path:
                    end()
                    path, held, large = int(paths[i]), [], False
                if held and not large and held[-1] == nodes[i]:
                    continue
                if large:
                    out.append((path, [int(nodes[i])]))
                elif len(held) == most:
                    out += [(path, [x]) for x in [*held, int(nodes[i])]]
                    large = True
                else:
                    held.append(int(nodes[i]))
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], schema=_BUCKETS)
                    out = []
        end()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], schema=_BUCKETS)

    return run


def _frequent(most: int):
    """Paths that are in a batch more than ``most`` times, each once for a task."""

    def run(batches):
        found: set[int] = set()
        for batch in batches:
            paths, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            found.update(paths[counts > most].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["path"])

    return run


def met(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of (path, node): members of those with at most ``most``, and (path, node) of larger ones.

    The members of a bucket that holds a good part of all rows would fill a task
    only to learn that it is large.  Such paths show in single batches, and the
    rows of at most ``FREQUENT`` of them stay where they are.
    """
    rows = rows.select("path", "node")
    often = rows.select("path").mapInArrow(_frequent(most), "path long").groupBy("path").count().orderBy(F.desc("count"), "path").limit(FREQUENT)
    large = [r["path"] for r in often.collect()]
    known = F.expr(f"path IN ({', '.join(f'{p}L' for p in large)})") if large else F.lit(False)
    rest, here = rows.filter(~known), rows.filter(known)
    found = rest.repartition("path").sortWithinPartitions("path", "node").mapInArrow(_buckets(most), "path long, members array<long>")
    return found.filter(F.size("members") > 1).select("members"), found.filter(F.size("members") == 1).select("path", F.col("members")[0].alias("node")).unionByName(here)


def block_pairs(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own block is in: columns ``one``, ``two``, ``own``.

    A group of ``n`` blocks becomes ``n (n + 1) / 2`` tasks' worth of rows; none holds more than two blocks.
    """
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    return rows.select("*", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")).drop("other", blocks)


def _grouped(batches, n_keys: int):
    """Rows of sorted batches as lists of values, by their first ``n_keys`` columns."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for values in zip(*columns, strict=True):
            values = [v.as_py() for v in values]
            own = tuple(values[:n_keys])
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(values[n_keys:])
    if rows:
        yield key, rows


def _edges(least: float):
    """Forest edges between classes of a bucket, or of two blocks of one, whose sketches are alike."""

    def run(batches):
        out = []
        for _, rows in _grouped(batches, 3):
            nodes = [r[0] for r in rows]
            sketches = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, BINS)
            out += [(nodes[i], nodes[j]) for i, j in forest(alike(sketches, least), len(nodes))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices, some columns at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    fresh = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    if not len(column):
        return out
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _links(threshold: float):
    """For two blocks of a cluster: the weight of each class's links, and forest edges (``other``)."""

    def run(batches):
        for (_, one, two), rows in _grouped(batches, 3):
            # A class whose row is repeated in several batches or partitions was sent for each.
            rows = list({r[0]: r for r in rows}.values())
            nodes = [r[0] for r in rows]
            weight = np.array([r[1] for r in rows], np.int64)
            own = np.array([r[2] for r in rows])
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets], np.float64)
            shared = common(sets).astype(np.float64)
            # Compared without a division, so that a similarity of exactly the threshold counts.
            linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if one != two:  # pairs within a block have a task of their own
                linked &= own[:, None] != own[None, :]
            weights = linked @ weight
            found = np.flatnonzero(weights).tolist()
            edges = forest(lambda i, rest: linked[i, rest], len(nodes))  # noqa: B023
            a = [nodes[i] for i in found] + [nodes[i] for i, _ in edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(found) + [nodes[j] for _, j in edges], pa.int64()), pa.array([int(weights[i]) for i in found] + [0] * len(edges), pa.int64())], ["node", "other", "links"])

    return run


def _deeper(k: int, threshold: float):
    """(path, node, parent) one step on from the large buckets of each class."""

    def run(batches):
        for batch in batches:
            rows = []
            for node, parents, text, digest in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = shingles(text.as_py(), k)
                if not len(own) or hashlib.blake2b(own.tobytes(), digest_size=16).digest() != digest.as_py():
                    continue
                for parent in parents.as_py():
                    rows += [(path, node.as_py(), parent) for path in chosen(own, np.int64(parent).view(np.uint64), threshold).view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["path", "node", "parent"])

    return run


def _with_texts(wanted: DataFrame, nodes: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """``wanted`` (by ``node``) with each class's ``set`` and the ``text`` of its node.

    A blocked Bloom filter of the nodes, of bounded size, keeps most texts that are not wanted out of the shuffle.
    """
    own = scratch.table(wanted.join(nodes.select("node", "set"), "node"))
    blocks = fitting_blocks(own.count())
    words = bloom_words(own, "node", blocks).scalar()  # a subquery: the words are not part of the plan
    few = base.filter(may_hold(words, F.col("id"), blocks))
    return own.hint("shuffle_merge").join(few, F.col("node") == F.col("id")).drop("id")


def _buckets_of(nodes: DataFrame, base: DataFrame, k: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of small buckets, and (path, node) of those that no path splits further."""
    small, large = met(nodes.select("node", F.explode("paths").alias("path")), SMALL)
    small, large = scratch.table(small), scratch.table(large)
    dense = large.limit(0)
    for depth in range(2, DEPTH + 1):
        if large.isEmpty():
            break
        if depth == 2:  # the second step was taken with the first
            steps = nodes.select("node", F.explode(F.arrays_zip("deep", "parents")).alias("d")).select("node", F.col("d.deep").alias("to"), F.col("d.parents").alias("path"))
            split = large.join(steps, ["node", "path"]).select(F.col("to").alias("path"), "node", F.col("path").alias("parent"))
        else:
            asked = large.groupBy("node").agg(F.collect_list("path").alias("parents"))
            split = _with_texts(asked, nodes, base, scratch).select("node", "parents", "text", "set").mapInArrow(_deeper(k, threshold), "path long, node long, parent long").distinct()
        split = scratch.table(split)
        found, more = met(split, SMALL)
        small, more = small.unionByName(scratch.table(found)), scratch.table(more)
        before = large.groupBy(F.col("path").alias("parent")).agg(F.count("*").alias("before"))
        after = more.groupBy("path").agg(F.count("*").alias("after"))
        stays = after.join(split.select("path", "parent").distinct(), "path").join(before, "parent").filter(F.col("after") > DENSE * F.col("before")).select("path").distinct()
        dense = dense.unionByName(scratch.table(more.join(stays, "path", "left_semi")))
        large = scratch.table(more.join(stays, "path", "left_anti"))
    return small, dense.unionByName(large)


def _compared(members: DataFrame, nodes: DataFrame, base: DataFrame, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Exact links (see ``_links``) of the members (group, node) of groups, block by block."""
    members = members.join(nodes.select("node", "copies", "size"), "node")
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    placed = block_pairs(members.join(sizes, "group"), "group", "blocks").groupBy("node", "copies").agg(F.collect_list(F.struct("group", "one", "two", "own")).alias("tasks"))

    def again(batches):
        for batch in batches:
            rows, seen = [], set()
            for node, copies, tasks, text, digest in zip(*(batch.column(i) for i in range(5)), strict=True):
                values = shingles(text.as_py(), k).tobytes()
                if node.as_py() in seen or hashlib.blake2b(values, digest_size=16).digest() != digest.as_py():
                    continue
                seen.add(node.as_py())
                for t in tasks.as_py():
                    rows.append((t["group"], t["one"], t["two"], node.as_py(), copies.as_py(), t["own"], values))
                    if len(rows) > 500:
                        yield _sent(rows)
                        rows = []
            yield _sent(rows)

    sent = _with_texts(placed, nodes, base, scratch).select("node", "copies", "tasks", "text", "set").mapInArrow(again, "group long, one int, two int, node long, copies long, own int, shingles binary")
    return sent.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two", "node").mapInArrow(_links(threshold), "node long, other long, links long")


def _edges_of(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b"))


def _parted(clusters: DataFrame, buckets: DataFrame, nodes: DataFrame, base: DataFrame, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The clusters, with chains parted: those of several blocks of which no bucket holds half are those of exact links in their buckets."""
    large = clusters.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    members = scratch.table(buckets.join(clusters.join(large, "component"), "node"))
    if members.isEmpty():
        return clusters
    most = members.groupBy("component", "n", "path").count().groupBy("component", "n").agg(F.max("count").alias("most"))
    chains = scratch.table(most.filter(F.col("most") < DENSE * F.col("n")).select("component"))
    if chains.isEmpty():
        return clusters
    own = members.join(chains, "component").select(F.col("path").alias("group"), "node")
    linked = scratch.table(_compared(own, nodes, base, k, threshold, scratch))
    return scratch.table(clusters.join(chains, "component", "left_anti").select("node", "component").unionByName(components(_edges_of(linked), scratch)))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """One row for each row: id, ``class_id`` (least id that links reach), ``copy_of`` (least id with the same shingles), ``n_links`` (other documents with a similarity of ``threshold`` or more)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = Numbered(rows, scratch)
    found = _joined(numbered.rows, threshold, k, recall, scratch)
    out = numbered.back(found, ["class_id", "copy_of"])
    return out.select(F.col("id").alias(id_col), "class_id", "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _joined(base: DataFrame, threshold: float, k: int, recall: float, scratch: Scratch) -> DataFrame:
    """``id``, ``class_id``, ``copy_of`` and ``n_links`` of each long id of the rows (id, text)."""
    base = base.filter(F.col("id").isNotNull())
    sets = scratch.table(base.select("id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")).mapInArrow(_sets(k, threshold, runs_for(recall)), _SETS))
    ids = scratch.table(sets.groupBy("id").agg(F.min(F.struct("digest", "set")).alias("s")).select("id", "s.set"))
    classes = ids.filter(F.col("set").isNotNull()).groupBy("set").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    # Of a class its least id stands for it; its row has all that equal sets share.
    nodes = scratch.table(classes.join(sets.filter(F.col("set").isNotNull()), (classes.node == sets.id) & (classes.set == sets.set)).select("node", classes.set, "copies", "size", "sketch", "paths", "deep", "parents").dropDuplicates(["node"]))

    small, dense = _buckets_of(nodes, base, k, threshold, scratch)
    # Equal buckets are compared once.
    lists = small.groupBy("members").count().select(F.xxhash64("members", F.lit("list")).alias("path"), F.explode("members").alias("node"))
    buckets = scratch.table(lists.withColumn("blocks", F.lit(1).cast("long")).unionByName(dense.join(dense.groupBy("path").agg(F.ceil(F.count("*") / BUCKET).alias("blocks")), "path")).select("path", "node", "blocks"))
    compared = block_pairs(buckets, "path", "blocks").join(nodes.select("node", "sketch"), "node").select("path", "one", "two", "node", "sketch")
    edges = compared.repartition("path", "one", "two").sortWithinPartitions("path", "one", "two", "node").mapInArrow(_edges(threshold - SLACK), "a long, b long")
    clusters = _parted(scratch.table(components(edges, scratch)), buckets.select("path", "node"), nodes, base, k, threshold, scratch)

    linked = scratch.table(_compared(clusters.select(F.col("component").alias("group"), "node"), nodes, base, k, threshold, scratch))
    links = linked.filter(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(_edges_of(linked), scratch)

    told = classes.join(links, "node", "left").join(groups, "node", "left").select("set", F.col("node").alias("copy_of"), F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return ids.join(told, "set", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """The documents, with all their columns, that are the least id of their group; of rows with one id the one with the text that was compared stays, all with a null id do."""
    links = ngram_join(docs, id_col, text_col, threshold, k, recall)
    head, order = fresh(docs, "head", "order")
    heads = links.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias(head)).distinct()
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    kept = docs.join(heads, F.col(id_col) == F.col(head), "left_semi").withColumn(order, first).filter(F.col(order) == 1).drop(order)
    return kept.unionByName(docs.filter(F.col(id_col).isNull())).select(docs.columns)


def _sent(rows):
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["group", "one", "two", "node", "copies", "own", "shingles"])
