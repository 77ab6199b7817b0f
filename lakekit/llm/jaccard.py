"""Operator 10, joining documents whose sets of word n-grams have a Jaccard similarity of at least 0.8.

MinHash signatures form a forest of prefix tries, one for each run of hash functions. A set asks each tree for the others
under its longest prefix. That alone misses too many pairs at the threshold, so a set shortens prefixes, one tree at a
time, until a pair at the threshold shares one with the target recall. It first shortens where that adds the fewest sets for
the recall gained: a set in a crowded part of one tree keeps a long prefix there and makes up for it in others.
Documents under a node that is asked for meet; their signatures tell which of them may be close, and these become
components of candidates. Inside a component all pairs are verified exactly from their n-gram sets.

Only distinct sets take part; copies are counted. No pair is ever a row: a node sends a spanning forest of its likely
pairs, and a component's task sends, for each set, its number of links and a spanning forest of the verified links.
Nodes and components beyond a fixed size are dealt out as pairs of shares, so that no task holds more than two shares.

Cases: a text of fewer words than n is one gram of all its words; null texts and texts without words have no links and
each is a class of its own; rows of equal id are judged one by one and a null id counts as no id, so a class of null ids
only has a null class id; an empty table gives no rows; other columns are ignored, or handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.llm.blocks import as_table, pack, ranges, split_by, unpack
from lakekit.llm.columns import named
from lakekit.llm.components import components, salted
from lakekit.llm.memory import tidy
from lakekit.llm.textblocks import ALNUM, Piece, mix, pieces
from lakekit.session import scratch_path
from lakekit.storage import delete_path

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 5
RECALL = 0.99999
BLOCK_BYTES = 6 << 20
#: Sets in a share of a node or a component, and rows or bytes to a bucket of small ones.
NODE_SHARE, SET_SHARE = 8192, 512
NODE_BUCKET_ROWS, SET_BUCKET_BYTES = 50_000, 8 << 20
#: Rows of nodes that a task chooses prefixes from.
CHOICE_BUCKET_ROWS = 400_000
#: Tasks that the rows of one class or component are spread over in a join.
SALTS = 16
#: Standard deviations by which a signature may underrate a pair at the threshold.
_SLACK = 5.5
_RARE = 32
_FACTORS = (np.random.default_rng(20).integers(0, 1 << 31, 4096, dtype=np.int64) * 2 + 1).astype(np.uint32)
_OFFSETS = np.random.default_rng(21).integers(0, 1 << 32, 4096, dtype=np.int64).astype(np.uint32)


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with the target recall, if all trees use it."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def choose_levels(sizes: np.ndarray, threshold: float, depth: int, recall: float) -> np.ndarray:
    """By how much each set shortens its prefix in each tree.

    ``sizes`` (sets, trees, levels) says how many sets are under the prefixes of length ``depth``, ``depth - 1`` and so on.
    A pair at the threshold is missed by a tree with a chance of one minus the threshold to the power of the length, so
    the logarithms of these chances add up, and prefixes are shortened until the sum reaches the recall.
    """
    n, trees, levels = sizes.shape
    worth = -np.log(1 - threshold ** np.arange(depth, depth - levels, -1.0))
    gain = np.diff(worth)
    missing = -np.log(max(1 - recall, 1e-300)) - trees * worth[0]
    if levels == 1 or missing <= 0:
        return np.zeros((n, trees), dtype=np.int64)
    # Sets met for the recall gained; a step never comes before the one that it follows.
    price = np.maximum.accumulate(np.diff(sizes, axis=2) / gain, axis=2).reshape(n, -1)
    order = np.argsort(price, axis=1, kind="stable")
    reached = np.cumsum(np.tile(gain, trees)[order], axis=1)
    steps = np.minimum((reached < missing).sum(axis=1) + 1, trees * (levels - 1))
    taken = np.zeros((n, trees * (levels - 1)), dtype=bool)
    np.put_along_axis(taken, order, np.arange(trees * (levels - 1)) < steps[:, None], axis=1)
    return taken.reshape(n, trees, levels - 1).sum(axis=2)


def _choose(table: pa.Table, trees: int, threshold: float, depth: int, levels: int, recall: float) -> pa.Table:
    """The nodes that the sets of a bucket ask for, among those that hold several sets."""
    sets, own = np.unique(np.array(table.column("set").to_pylist(), dtype="S32"), return_inverse=True)
    place, n, node = (table.column(c).to_numpy() for c in ("place", "n", "node"))
    sizes = np.ones((len(sets), trees * levels), dtype=np.int64)
    sizes[own, place] = n
    chosen = choose_levels(sizes.reshape(-1, trees, levels), threshold, depth, recall)
    asked = chosen[own, place // levels] == place % levels
    return pa.table([pa.array(np.unique(node[asked]))], ["node"])


def least_agreement(threshold: float, n: int) -> float:
    """The share of equal signature values below which a pair cannot be at the threshold, but for chance."""
    return threshold - _SLACK * (threshold * (1 - threshold) / n) ** 0.5


class _Sets:
    """The n-gram sets of a piece's texts: distinct hashes in the order of the texts."""

    def __init__(self, text: pa.Array, n: int):
        piece = Piece(text, lower=True).split(ALNUM)
        words = piece.word_hashes()
        grams, at = piece.gram_hashes(words, n)
        doc = [piece.doc[at]]
        hashes = [grams]
        # A short text is one gram.
        for size in range(1, n):
            grams, at = piece.gram_hashes(words, size)
            short = piece.counts[piece.doc[at]] == size
            doc.append(piece.doc[at][short])
            hashes.append(grams[short])
        doc, hashes = np.concatenate(doc), np.concatenate(hashes)
        _, first = np.unique(mix(hashes, doc.astype(np.uint64)), return_index=True)
        first = first[np.argsort(doc[first], kind="stable")]
        self.grams = hashes[first]
        self.size = np.bincount(doc[first], minlength=piece.n_docs)
        self.begin = np.cumsum(self.size) - self.size

    def keys(self) -> list[str | None]:
        """128 bits that tell sets apart, whatever the order of their grams; None for empty sets."""
        parts = [self._each(np.add, mix(self.grams, np.uint64(seed)), np.uint64) for seed in (1, 2)]
        return [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(*parts, self.size, strict=True)]

    def signatures(self, n: int) -> np.ndarray:
        low = (self.grams >> np.uint64(17)).astype(np.uint32)
        out = np.zeros((len(self.size), n), dtype=np.uint32)
        for j in range(n):
            value = low * _FACTORS[j]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value += _OFFSETS[j]
            value ^= value >> np.uint32(13)
            out[:, j] = self._each(np.minimum, value, np.uint32)
        return out

    def _each(self, function: np.ufunc, values: np.ndarray, kind: type) -> np.ndarray:
        out, full = np.zeros(len(self.size), dtype=kind), np.flatnonzero(self.size)
        if len(full):
            out[full] = function.reduceat(values, self.begin[full])
        return out


def _sign(table: pa.Table, n: int, trees: int, depth: int, least: int) -> pa.Table:
    """A row for each distinct text: its set, the set's size, its copies, trie nodes, and a byte of each hash.

    A tree's nodes are those of its prefixes from the longest down to ``least`` hashes.
    """
    h, copies, text = unpack(table, np.add)
    sets, sizes, nodes, sketches = [], [], [], []
    for lo, hi in pieces(text, 1 << 21):
        own = _Sets(text.slice(lo, hi - lo), n)
        signature = own.signatures(trees * depth)
        sets += own.keys()
        sizes.append(own.size)
        sketches += [row.tobytes() for row in (signature & 0xFF).astype(np.uint8)]
        node = []
        for tree in range(trees):
            key, path = np.full(hi - lo, tree, dtype=np.uint64), []
            for d in range(depth):
                key = mix(key, signature[:, tree * depth + d].astype(np.uint64))
                path.append(key.view(np.int64))
            node += path[: least - 2 if least > 1 else None : -1]
        nodes += list(np.stack(node, axis=1))
    columns = [pa.array(h, pa.string()), pa.array(sets, pa.string()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())]
    columns += [pa.array(copies), pa.array(nodes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
    return pa.table(columns, ["h", "set", "size", "copies", "nodes", "sketch"])


def _deal(rows: DataFrame, key: str, member: str, n: str, share: int, buckets: int) -> DataFrame:
    """Add task, i and j: a key of at most ``share`` rows is one unit in a bucket of many, a larger one is units of
    two shares each, of which every pair meets in one."""
    shares = F.ceil(F.col(n) / share).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(member), shares)).withColumn(
        "other", F.explode(F.sequence(F.lit(0), shares - 1))
    )
    dealt = dealt.withColumn("i", F.least("own", "other").cast("int")).withColumn("j", F.greatest("own", "other").cast("int"))
    unit = F.when(shares == 1, F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(F.xxhash64(key, "i", "j"))
    return dealt.withColumn("own", F.col("own").cast("int")).withColumn("task", unit)


class _Forest:
    """A spanning forest of the pairs that are given."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)


def _likely(table: pa.Table, least: float) -> pa.Table:
    """For the nodes of a bucket, a spanning forest of the pairs whose signatures agree enough."""
    table = table.sort_by([("node", "ascending"), ("i", "ascending"), ("j", "ascending"), ("set", "ascending")])
    node, i, j, own = (table.column(c).to_numpy() for c in ("node", "i", "j", "own"))
    sets = table.column("set").to_pylist()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(sets), -1)
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    last = np.append(first[1:], len(node))
    hub = np.repeat(first, last - first)
    edges = set()
    need = least * sketch.shape[1]
    close = np.concatenate([(sketch[a : a + 8192] == sketch[hub[a : a + 8192]]).sum(axis=1) >= need for a in range(0, len(hub), 8192)])
    # A set like its node's first one is joined to it; only the others are held against all.
    edges.update((sets[hub[x]], sets[x]) for x in np.flatnonzero(close & (hub != np.arange(len(hub)))))
    for start in np.unique(hub[~close]):
        end = last[np.searchsorted(first, start)]
        members = sketch[start:end]
        forest = _Forest(end - start)
        for x in np.flatnonzero(~close[start:end]):
            for a in range(0, len(members), 8192):
                for y in np.flatnonzero((members[a : a + 8192] == members[x]).sum(axis=1) >= need):
                    forest.join(int(x), int(y) + a)
        edges.update((sets[start + forest.root(x)], sets[start + x]) for x in range(end - start) if forest.root(x) != x)
    return as_table(list(edges), ["a", "b"], [pa.string(), pa.string()])


def intersections(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many grams each two of ``n`` sets share. Grams that occur in the same sets are counted as one with a weight."""
    order = np.argsort(grams, kind="stable")
    sorted_grams, who = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1]]))
    count = np.diff(np.append(first, len(who)))
    code = np.add.reduceat(mix(who.astype(np.uint64), np.uint64(7)), first)
    shared = np.flatnonzero(count > 1)
    _, kind, weight = np.unique(np.stack([code[shared], count[shared].astype(np.uint64)]), axis=1, return_index=True, return_counts=True)
    first, count = first[shared[kind]], count[shared[kind]]
    out = np.zeros((n, n))
    rare = np.flatnonzero(count <= _RARE)
    if len(rare):
        place, size = ranges(first[rare], count[rare]), count[rare]
        group, factor, member = np.repeat(np.arange(len(rare)), size), np.repeat(weight[rare], size), who[place]
        for gap in range(1, int(size.max())):
            both = np.flatnonzero(group[gap:] == group[:-gap])
            out += np.bincount(member[both] * n + member[both + gap], weights=factor[both], minlength=n * n).reshape(n, n)
    often = np.flatnonzero(count > _RARE)
    out = out + out.T
    for at in range(0, len(often), 2048):
        some = often[at : at + 2048]
        matrix = np.zeros((n, len(some)), dtype=np.float32)
        matrix[who[ranges(first[some], count[some])], np.repeat(np.arange(len(some)), count[some])] = 1
        out += (matrix * weight[some].astype(np.float32)) @ matrix.T
    np.fill_diagonal(out, 0)
    return out


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """For the components of a bucket: each set's verified links, and a spanning forest of them."""
    table = table.sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending"), ("set", "ascending")])
    component, i, j, own = (np.array(table.column(c).to_pylist()) for c in ("component", "i", "j", "own"))
    sets, copies = table.column("set").to_pylist(), table.column("copies").to_numpy()
    grams = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
    first = np.flatnonzero(np.concatenate([[True], (component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    rows = []
    for start, end in zip(first, np.append(first[1:], len(sets)), strict=True):
        some = grams[start:end]
        size = np.array([len(g) for g in some])
        n = end - start
        both = intersections(np.concatenate(some), np.repeat(np.arange(n), size), n)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if i[start] != j[start]:
            # The unit of two shares answers for pairs across them; pairs within one have a unit of their own.
            linked &= own[start:end][:, None] != own[start:end][None, :]
        documents, others = (linked * copies[start:end][None, :]).sum(axis=1), linked.sum(axis=1)
        near = np.where(others > 0, np.argmax(linked, axis=1), -1)
        forest = _Forest(n)
        for x in range(n):
            if near[x] >= 0:
                forest.join(x, int(near[x]))
        # Trees of first neighbours may still be parts of one component.
        for x in range(n):
            for y in np.flatnonzero(linked[x, :x]) if others[x] else ():
                forest.join(x, int(y))
        for x in range(n):
            if others[x]:
                rows.append((sets[start + x], sets[start + forest.root(x)], int(documents[x]), int(others[x])))
    return as_table(rows, ["set", "root", "documents", "sets"], [pa.string(), pa.string(), pa.int64(), pa.int64()])


def join_similar(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    scratch: str | None = None,
) -> DataFrame:
    """``documents`` as struct ``row`` with text_hash, class, class_id, class_size, n_links and n_set_links.

    ``class`` names the class (null for a text without words, which stands alone), ``class_id`` is the least id among documents that are linked, directly or through others; ``n_links`` counts the
    documents at the threshold or above, copies included, ``n_set_links`` the different sets among them. The result reads
    tables that are written below ``scratch``, a folder of its own in the shared one unless given.
    """
    scratch = scratch or scratch_path(documents.sparkSession, "jaccard")
    shortest, n_hashes = prefix_depth(threshold, trees, depth, recall), trees * depth
    levels = depth - shortest + 1
    rows = documents.select(
        F.struct(*(named(c) for c in documents.columns)).alias("row"),
        named(doc_id).alias("id"),
        F.coalesce(named(text), F.lit("")).alias("text"),
    ).withColumn("h", F.md5("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("h"), F.lit(total // BLOCK_BYTES + 1))
    packed = pack(rows.select("h", "text", F.lit(1).cast("long").alias("value"), block.alias("block")), np.add)

    # 1. A row for each distinct text.
    schema = "h string, set string, size long, copies long, nodes array<long>, sketch binary"
    signed = packed.groupBy("block").applyInArrow(lambda table: tidy(_sign, table, words, trees, depth, shortest), schema)
    signed = _kept(signed, f"{scratch}/signed", schema)
    full = signed.where("set IS NOT NULL")
    sets = full.groupBy("set").agg(
        F.min("h").alias("h"), F.sum("copies").alias("copies"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch")
    )
    sets = _kept(sets, f"{scratch}/sets", "set string, h string, copies long, nodes array<long>, sketch binary")

    # 2. Sets that meet under a node that one of them asks for, and which of them are likely pairs.
    members = sets.select("set", F.posexplode("nodes").alias("place", "node"))
    crowded = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    met = _kept(members.join(crowded, "node"), f"{scratch}/nodes", "node long, set string, place int, n long")
    n_met = met.count()
    bucket = F.pmod(F.xxhash64("set"), F.lit(n_met // CHOICE_BUCKET_ROWS + 1))
    asked = met.groupBy(bucket.alias("bucket")).applyInArrow(
        lambda table: tidy(_choose, table, trees, threshold, depth, levels, recall), "node long"
    )
    wanted = met.join(asked.distinct(), "node", "left_semi").select("node", "set", "n")
    dealt = _deal(wanted.join(sets.select("set", "sketch"), "set"), "node", "set", "n", NODE_SHARE, n_met // NODE_BUCKET_ROWS + 1)
    least = least_agreement(threshold, n_hashes)
    likely = dealt.select("task", "node", "i", "j", "own", "set", "sketch").groupBy("task").applyInArrow(
        lambda table: tidy(_likely, table, least), "a string, b string"
    )
    candidates = components(likely, scratch)

    # 3. Exact similarities within each component of likely pairs.
    crowd = candidates.groupBy("label").agg(F.count("*").alias("n"))
    wanted = candidates.join(crowd, "label").join(sets, F.col("node") == F.col("set")).select("set", "h", "copies", F.col("label").alias("component"), "n")
    wanted = _kept(wanted, f"{scratch}/candidates", "set string, h string, copies long, component string, n long")
    wanted_at = wanted.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(total // BLOCK_BYTES + 1)))
    found = packed.groupBy("block").cogroup(wanted_at.groupBy("block")).applyInArrow(
        lambda texts, asked: tidy(_grams, texts, asked, words), "set string, copies long, component string, n long, grams binary"
    )
    dealt = _deal(found, "component", "set", "n", SET_SHARE, total // SET_BUCKET_BYTES + 1)
    verified = dealt.select("task", "component", "i", "j", "own", "set", "copies", "grams").groupBy("task").applyInArrow(
        lambda table: tidy(_verify, table, threshold), "set string, root string, documents long, sets long"
    )
    verified = _kept(verified, f"{scratch}/links", "set string, root string, documents long, sets long")
    links = verified.groupBy("set").agg(F.sum("documents").alias("documents"), F.sum("sets").alias("sets"))
    classes = components(verified.select(F.col("set").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "set")

    # 4. Back to the documents.
    by_text = signed.join(links, "set", "left").join(classes, "set", "left").select(
        "h", "set", F.coalesce("label", "set").alias("class"), "documents", "sets"
    )
    own = rows.select("row", "id", "h").join(by_text, "h")
    copies = sets.select("set", "copies")
    # Texts without words stand alone, each row by itself.
    heads = own.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    # From a table of its own, so that the join below may split the rows of a large class.
    heads = _kept(heads, f"{scratch}/classes", f"class string, class_id {own.schema['id'].dataType.simpleString()}, class_size long")
    done = own.join(heads, "class", "left").join(copies, "set", "left")
    return done.select(
        "row",
        F.col("h").alias("text_hash"),
        "class",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("documents", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("sets", F.lit(0)).cast("long").alias("n_set_links"),
    )


def _kept(frame: DataFrame, folder: str, schema: str) -> DataFrame:
    """The frame as a table in the shared folder."""
    names = [f.split()[0] for f in schema.split(", ")]
    frame.select(*names).write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(schema).parquet(folder)


def _grams(texts: pa.Table, asked: pa.Table, n: int) -> pa.Table:
    """The n-gram sets of the texts that are asked for."""
    rows = []
    if texts.num_rows and asked.num_rows:
        h, _, text = unpack(texts, np.add)
        place = {x: i for i, x in enumerate(h)}
        wanted = asked.to_pylist()
        text = text.take(pa.array([place[w["h"]] for w in wanted], pa.int64()))
        for lo, hi in pieces(text):
            own = _Sets(text.slice(lo, hi - lo), n)
            for k, w in enumerate(wanted[lo:hi]):
                grams = own.grams[own.begin[k] : own.begin[k] + own.size[k]]
                rows.append((w["set"], w["copies"], w["component"], w["n"], grams.astype("<u8").tobytes()))
    return as_table(rows, ["set", "copies", "component", "n", "grams"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()])


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every class, with its own columns: the least id, then the least MD5 of the text; of equal rows, one.

    Classes are found from ids and texts alone; the decisions then meet the rows, whose texts travel once. What the join
    wrote on its way goes when the decisions are written.
    """
    spark = documents.sparkSession
    scratch = scratch_path(spark, "jaccard")
    light = documents.select(named(doc_id).alias("id"), named(text).alias("text"))
    found = join_similar(light, "id", "text", **options, scratch=scratch).where("class_size > 1").select("row.id", "text_hash", "class")
    members = found.groupBy("id", "text_hash", "class").agg(F.count("*").alias("n"))
    first = F.struct(F.col("id").isNull(), "id", "text_hash")
    winners = members.groupBy("class").agg(F.min(first).alias("first"))
    decided = salted(members, winners, "class", F.xxhash64("id", "text_hash"), SALTS).select(
        F.col("id").alias("own_id"), F.col("text_hash").alias("own_h"), (F.col("first") == first).alias("wins"), "n"
    )
    types = light.schema["id"].dataType.simpleString()
    decided = _kept(decided, scratch_path(spark, "decisions"), f"own_id {types}, own_h string, wins boolean, n long")
    delete_path(spark, scratch)
    rows = documents.select(
        F.struct(*(named(c) for c in documents.columns)).alias("row"),
        named(doc_id).alias("id"),
        F.md5(F.coalesce(named(text), F.lit(""))).alias("h"),
    )
    # The decisions have no bound, so they are never broadcast, however small a table is.
    met = rows.join(decided.hint("merge"), rows["h"].eqNullSafe(decided["own_h"]) & rows["id"].eqNullSafe(decided["own_id"]), "left")
    alone = met.where("wins IS NULL OR (wins AND n = 1)").select("row.*")
    several = met.where("wins AND n > 1").groupBy("id", "h").agg(F.first("row").alias("row"))
    return alone.union(several.select("row.*"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class of near copies and the number of links of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_similar(documents).select(F.col("row.doc_id").alias("doc_id"), "class_id", "class_size", "n_links", "n_set_links")
