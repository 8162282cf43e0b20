"""Prefix trie of conversations: which turns conversations share from their start.

Turns become 64-bit dictionary ids, conversations rows of ids, and the sorted rows are dealt to
range shards.  Each shard builds ternary search trees, balanced by inserting medians first, and
one backward pass over their nodes adds up members, children, leaves and savings.  Only the nodes
on the paths of a shard's first and last row can stand in other shards too: these boundary nodes
are merged by their path, and their totals handed to their ancestors, in a few grouped joins.

Conversations longer than a segment are cut: a later segment is a row of its own under the
digest of all that comes before it, so no row grows with a conversation.  A segment that no other
conversation shares is a chain and needs no tree.  Shared ones are built deepest first; there
are as many rounds as the deepest shared turn has segments before it, one for most tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollframe.llm.work import written
from rollframe.operators.indexing import running_totals


@dataclass(frozen=True)
class TrieParams:
    """segment: turns of a row at most; shard_turns: turns that a shard holds, about;
    ends_run: conversations in one row of a list of ends, at most."""

    segment: int = 512
    shard_turns: int = 100_000
    ends_run: int = 1024


@dataclass(frozen=True)
class PrefixTrie:
    """nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends),
    one per distinct sequence of first turns; conv_id, the smallest member, and depth name a node.
    ends: the conversations that stop there, ascending; null where they are in ``runs``.
    runs: (conv_id, depth, ends), the longer lists in pieces, each ascending and apart."""

    nodes: DataFrame
    runs: DataFrame


# ------------------------------------------------------------------------------- turns

def encoded_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, id, bytes): turns numbered from 1 in each conversation, in the order of the
    turn number, null first, ties by their id; the dictionary id of (role, text), null as empty;
    the text's UTF-8 bytes.  Rows without a conversation id are left out.

    An id is the 64-bit hash of its entry; the dictionary is checked by SHA-256 for entries that
    share one, and hashed anew with another seed if there are any."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    entry = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(entry).alias("entry"),
        F.octet_length(text).cast("bigint").alias("bytes"), role.alias("role"), text.alias("text"))
    seed = 0
    while True:
        t = written(rows.select("conv", "turn", F.xxhash64(F.lit(seed), "role", "text").alias("id"), "bytes", "entry"), "turns")
        clash = t.groupBy("id").agg(F.min("entry").alias("a"), F.max("entry").alias("b")).where("a <> b")
        if clash.isEmpty():
            break
        seed += 1
    t = running_totals(t.drop("entry"), ["conv", "turn", "id"], {"at": F.lit(1)})
    t = written(t.select("conv", "at", "id", "bytes"), "numbered")
    first = t.groupBy("conv").agg(F.min("at").alias("first"))
    return t.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), "id", "bytes")


def conversation_lengths(turns: DataFrame) -> DataFrame:
    """(conv, n) of :func:`encoded_turns`."""
    return turns.groupBy("conv").agg(F.max("pos").alias("n"))


def spliced(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilds every conversation c on the beginning of another: the first h turns of conversation
    c - c % group (all if fewer, none if it is not there), then its own after the first h, with
    h = crc32(decimal c) % most.  Gives (conv, pos, id, bytes) and the lengths (conv, n);
    a conversation left without turns has length 0 and no turns."""
    turns = written(turns, "spliced-from")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("bigint")
    heads = (turns.where((F.col("conv") % group == 0) & (F.col("pos") < most))
             .groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("head")))
    c = conversation_lengths(turns).select("conv", F.col("n").alias("own"), h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    c = c.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:bigint,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    c = written(c.select("conv", "h", head.alias("head"), F.size(head).cast("bigint").alias("taken"),
                         (F.size(head) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint").alias("n")), "spliced")
    own = (turns.join(c.select("conv", "h", "taken"), "conv").where("pos > h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "bytes"))
    return c.select("conv", F.explode("head").alias("t")).select("conv", "t.*").unionByName(own), c.select("conv", "n")


# ---------------------------------------------------------------------------- segments

def _segments(turns: DataFrame, lengths: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(conv, n, seg, ids, sizes, key, next_key) and the last segment that two conversations
    share.  A conversation of n turns has segments 0 to n div size, the last one empty where n is a
    multiple.  key: digest of the turns before the segment, empty for segment 0; next_key: of the
    one after, null without one.  ``shared`` says whether others have the key."""
    seg = F.floor((F.col("pos") - 1) / size)
    rows = turns.groupBy("conv", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("t"))
    rows = rows.join(lengths, "conv").select("conv", "n", "seg", F.col("t.id").alias("ids"), F.col("t.bytes").alias("sizes"))
    none = F.array().cast("array<bigint>")
    stops = lengths.where(F.col("n") % size == 0).select("conv", "n", F.floor(F.col("n") / size).alias("seg"), none.alias("ids"), none.alias("sizes"))
    rows = written(rows.unionByName(stops), "segments")
    null = F.lit(None).cast("string")
    if not (rows.agg(F.max("seg")).first()[0] or 0):
        return rows.select("*", F.lit("").alias("key"), null.alias("next_key"), F.lit(True).alias("shared")), 0
    # sums of hashes that have the segment's number in them: the order counts, and a sum needs no list
    order = W.partitionBy("conv").orderBy("seg")
    long = rows.where(F.col("n") >= size)
    key = F.concat_ws(":", F.col("seg").cast("string"), *[
        F.sum(F.xxhash64(F.lit(k), "seg", "ids").cast("decimal(38,0)")).over(order.rowsBetween(W.unboundedPreceding, -1)).cast("string")
        for k in (1, 2)])
    long = long.withColumn("key", F.when(F.col("seg") == 0, "").otherwise(key))
    long = long.withColumn("next_key", F.lead("key").over(order))
    rows = rows.where(F.col("n") < size).select("*", F.lit("").alias("key"), null.alias("next_key")).unionByName(long)
    often = rows.where("seg > 0").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.lit(True).alias("many"))
    rows = rows.join(often, "key", "left").withColumn("shared", F.coalesce("many", F.col("seg") == 0)).drop("many")
    rows = written(rows, "keyed")
    return rows, rows.where("shared").agg(F.max("seg")).first()[0]


def _chains(rows: DataFrame, size: int) -> DataFrame:
    """Nodes of the segments that belong to one conversation alone."""
    at = F.col("seg") * size + F.col("i") + 1
    stop = at == F.col("n")
    return (rows.where(~F.col("shared")).select("conv", "n", "seg", F.posexplode("ids").alias("i", "id"))
            .select(F.col("conv").alias("conv_id"), at.alias("depth"), F.col("conv").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
                    F.when(stop, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
                    F.lit(0).cast("bigint").alias("saved_tokens"),
                    F.when(stop, F.array("conv")).otherwise(F.array().cast("array<bigint>")).alias("ends")))


# ------------------------------------------------------------------------------- trees

class TernaryTree:
    """Ternary search tree of id sequences: node 0 is the root; ``lower`` and ``higher`` lead to
    siblings, ``inside`` to the children.  A node's number is above its parent's."""

    def __init__(self):
        self.ids, self.sizes, self.parent, self.depth = [0], [0], [-1], [0]
        self.lower, self.higher, self.inside = [-1], [-1], [-1]

    def _new(self, parent: int, turn: int, size: int) -> int:
        self.ids.append(turn)
        self.sizes.append(size)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.lower, self.higher, self.inside):
            links.append(-1)
        return len(self.ids) - 1

    def insert(self, turns: list[int], sizes: list[int]) -> int:
        """The node of the sequence's last turn."""
        ids, node = self.ids, 0
        for turn, size in zip(turns, sizes):
            links, at, below = self.inside, node, self.inside[node]
            while below >= 0 and ids[below] != turn:
                links = self.lower if turn < ids[below] else self.higher
                at, below = below, links[below]
            if below < 0:
                below = links[at] = self._new(node, turn, size)
            node = below
        return node

    def insert_sorted(self, rows: list[tuple[list[int], list[int]]]) -> list[int]:
        """Inserts sorted sequences, the median first, then the medians of both halves, and so
        on: siblings form balanced trees."""
        found, halves = [0] * len(rows), [(0, len(rows))]
        while halves:
            lo, hi = halves.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                found[mid] = self.insert(*rows[mid])
                halves += [(mid + 1, hi), (lo, mid)]
        return found


_OUT = ("kind string, node binary, parent binary, path array<binary>, conv_id bigint, depth bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, bytes bigint, more_children bigint, more_leaves bigint, "
        "more_saved bigint, n_ends bigint, ends array<bigint>")
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("path", pa.list_(pa.binary())),
    *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "bytes",
                                "more_children", "more_leaves", "more_saved", "n_ends")], ("ends", pa.list_(pa.int64()))])


def _step(digest: bytes, turn: int) -> bytes:
    return hashlib.blake2b(digest + turn.to_bytes(8, "little", signed=True), digest_size=16).digest()


def _group_rows(key: str, rows: dict, first: bool, last: bool, base: int, run: int):
    """Result rows of one key's tree.  ``rows``: columns of the key's rows in order; ``first`` /
    ``last``: whether the shard's first / last row is among them."""
    ids, sizes, convs = rows["ids"], rows["sizes"], rows["conv"]
    starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    tree = TernaryTree()
    at = tree.insert_sorted([(ids[i], sizes[i]) for i in starts])
    n = len(tree.ids)
    members, least = [0] * n, [None] * n
    below, ends = {}, {}
    for node, lo, hi in zip(at, starts, [*starts[1:], len(ids)]):
        members[node], least[node] = hi - lo, min(convs[lo:hi])
        stop = [c for c, e in zip(convs[lo:hi], rows["stops"][lo:hi]) if e]
        if stop:
            ends[node] = stop
        # conversations that go on behind the segment agree on what follows their node
        goes = max(range(lo, hi), key=lambda i: rows["more_children"][i])
        below[node] = tuple(rows[c][goes] for c in ("more_children", "more_leaves", "more_saved"))
    # nodes that other shards may have as well: the root, and the paths of the shard's outer rows
    edge = {0: hashlib.blake2b(key.encode(), digest_size=16).digest()}
    paths = {0: [edge[0]]}
    for node in ([at[0]] if first else []) + ([at[-1]] if last else []):
        path = []
        while node not in edge:
            path.append(node)
            node = tree.parent[node]
        for node in reversed(path):
            above = tree.parent[node]
            edge[node] = _step(edge[above], tree.ids[node])
            paths[node] = [*paths[above], edge[node]]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    none = (0, 0, 0)
    for node in range(n - 1, -1, -1):
        up = tree.parent[node]
        if node not in edge:
            more = below.get(node, none)
            children[node] += more[0]
            leaves[node] += more[1] if children[node] else 1
            saved[node] += more[2] + (members[node] - 1) * tree.sizes[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
        if up >= 0:
            members[up] += members[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]
    for node in range(n):
        stop = ends.get(node, [])
        depth, up = base + tree.depth[node], tree.parent[node]
        inner = node not in edge
        long = not inner or len(stop) > run
        if inner:
            yield ("node", None, edge.get(up), None, least[node], depth, None if up in edge else least[up], members[node], children[node],
                   leaves[node], saved[node], None, None, None, None, len(stop), None if long else stop)
        else:
            yield ("edge", edge[node], edge.get(up), paths[node], least[node], depth, None, members[node], children[node], leaves[node],
                   saved[node], tree.sizes[node], *below.get(node, none), len(stop), None)
        if long:
            for i in range(0, len(stop), run):
                yield ("run", edge.get(node), None, None, least[node], depth, None, None, None, None, None, None, None, None, None, None, stop[i:i + run])


def _shard(base: int, run: int):
    """Trees of a range shard: sorted rows in, nodes, boundary nodes and lists of ends out."""
    def build(batches):
        cols = {c: [] for c in ("key", "conv", "stops", "more_children", "more_leaves", "more_saved", "ids", "sizes")}
        for b in batches:
            for c in cols:
                cols[c].extend(b.column(c).to_pylist())
        keys = cols.pop("key")
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
            rows = {c: v[lo:hi] for c, v in cols.items()}
            for row in _group_rows(keys[lo], rows, lo == 0, hi == len(keys), base, run):
                out.append(row)
                if len(out) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return build


def _merged_edges(edges: DataFrame, top: bool) -> DataFrame:
    """Boundary nodes of all shards as one row each, with whole totals: what the shards found
    inside is added up, and every node's own share is handed to all nodes on its path."""
    e = edges.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("bytes").alias("bytes"),
        F.max("more_children").alias("more_children"), F.max("more_leaves").alias("more_leaves"), F.max("more_saved").alias("more_saved"),
        F.sum("n_ends").alias("n_ends"), F.first("parent").alias("parent"), F.first("path").alias("path"), F.first("depth").alias("depth"))
    e = written(e, "boundary")
    kids = e.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    e = e.join(kids, "node", "left").na.fill(0, ["kids"])
    root = F.col("parent").isNull()
    children = F.col("inner") + F.col("more_children") + F.col("kids")
    # a later segment's root is the last node of the segment before, which counts its own share itself
    leaf = (children == 0) & (~root | F.lit(top))
    e = e.select("*", children.alias("n_children"),
                 (F.col("n_leaves") + F.col("more_leaves") + F.when(leaf, 1).otherwise(0)).alias("own_leaves"),
                 (F.col("saved") + F.col("more_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"))
    e = written(e, "boundary-own")
    total = (e.select(F.explode("path").alias("node"), "own_leaves", "own_saved").groupBy("node")
             .agg(F.sum("own_leaves").alias("all_leaves"), F.sum("own_saved").alias("all_saved")))
    above = e.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = e.join(total, "node").join(above, "parent", "left")
    return written(out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                              F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), "n_ends"), "boundary-nodes")


def _level(rows: DataFrame, level: int, roots: DataFrame | None, params: TrieParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, runs, roots) of one segment number's rows.  roots: totals below each key, for the
    segment before."""
    size = params.segment
    goes = F.col("n") > (level + 1) * size
    alone = F.when(goes, 1).otherwise(0).cast("bigint")
    zero = F.lit(0).cast("bigint")
    if roots is None:
        more = [alone.alias("more_children"), alone.alias("more_leaves"), zero.alias("more_saved")]
    else:
        rows = rows.join(roots, "next_key", "left")
        more = [F.coalesce("below_children", alone).alias("more_children"), F.coalesce("below_leaves", alone).alias("more_leaves"),
                F.coalesce("below_saved", zero).alias("more_saved")]
    stops = (F.col("n") <= (level + 1) * size) & ((F.col("n") > level * size) | (F.lit(level == 0)))
    rows = written(rows.select("key", "conv", "ids", "sizes", stops.alias("stops"), *more), "level")
    weight = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, -(-weight // params.shard_turns))
    dealt = rows.repartitionByRange(shards, "key", "ids", "conv").sortWithinPartitions("key", "ids", "conv")
    out = written(dealt.mapInArrow(_shard(level * size, params.ends_run), _OUT), "shards")
    edges = _merged_edges(out.where("kind = 'edge'"), level == 0)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    name = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("edge_conv"))
    inner = (out.where("kind = 'node'").join(name, "parent", "left").withColumn("parent_conv_id", F.coalesce("edge_conv", "parent_conv_id"))
             .withColumnRenamed("saved", "saved_tokens"))
    own = edges if level == 0 else edges.where("parent is not null")
    own = own.withColumn("ends", F.when(F.col("n_ends") == 0, F.array().cast("array<bigint>")))
    runs = out.where("kind = 'run'").select(F.col("node").alias("of"), "conv_id", "depth", "ends")
    name = edges.select(F.col("node").alias("of"), F.col("conv_id").alias("edge_conv"))
    runs = runs.join(name, "of", "left").select(F.coalesce("edge_conv", "conv_id").alias("conv_id"), "depth", "ends")
    below = edges.where("parent is null").select("node", F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"),
                                                 F.col("saved_tokens").alias("below_saved"))
    return inner.select(*cols).unionByName(own.select(*cols)), runs, below


def prefix_trie(turns: DataFrame, lengths: DataFrame | None = None, params: TrieParams = TrieParams()) -> PrefixTrie:
    """The trie of ``turns(conv, pos, id, bytes)`` (:func:`encoded_turns`).

    A node's savings are, over its subtree, (members - 1) times the bytes of the node's last
    text: what is read once instead of once per member.  ``lengths(conv, n)`` may name
    conversations without turns; they are members of the root alone.  No conversation gives no node,
    not even a root.  Equal conversations are members of the same nodes and all stop at the last.

    Rows are dealt by (turns, conversation), so equal conversations, however many, and a first turn
    that a third of all share, lie in as many shards as they fill; no shard or row holds more than
    its bound, and lists of ends come in bounded pieces.
    """
    lengths = conversation_lengths(turns) if lengths is None else lengths
    rows, last = _segments(turns, lengths, params.segment)
    nodes, runs, roots = [_chains(rows, params.segment)], [], None
    for level in range(last or 0, -1, -1):
        n, r, below = _level(rows.where((F.col("seg") == level) & F.col("shared")), level, roots, params)
        nodes.append(n)
        runs.append(r)
        if level:
            keys = rows.where((F.col("seg") == level) & F.col("shared")).select(F.col("key").alias("next_key")).distinct()
            named = _named_roots(keys)
            roots = written(named.join(below, "node").drop("node"), "roots")
    all_nodes, all_runs = nodes[0], runs[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    return PrefixTrie(all_nodes, all_runs)


def _named_roots(keys: DataFrame) -> DataFrame:
    """``keys(next_key)`` with the digest that names the key's root in the shards."""
    def digest(batches):
        for b in batches:
            names = [hashlib.blake2b(k.encode(), digest_size=16).digest() for k in b.column("next_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("next_key"), pa.array(names, pa.binary())], ["next_key", "node"])

    return keys.mapInArrow(digest, "next_key string, node binary")


def ends_digests(trie: PrefixTrie) -> DataFrame:
    """``trie.nodes`` with ``ends_sha256`` for ``ends``: lower-case SHA-256 hex of the decimal ids
    that stop there, ascending, joined by commas.  Long lists are read as a stream of their
    sorted pieces, so a list is never in memory whole."""
    def stream(batches):
        node, state, done = None, None, []
        for b in batches:
            for conv, depth, ends in zip(b.column("conv_id").to_pylist(), b.column("depth").to_pylist(), b.column("ends").to_pylist()):
                text = ",".join(map(str, ends)).encode()
                if (conv, depth) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text)
        if node:
            done.append((*node, state.hexdigest()))
            conv, depth, digest = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest)], ["conv_id", "depth", "long_sha256"])

    pieces = trie.runs.withColumn("lead", F.get("ends", F.lit(0))).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "lead")
    long = pieces.select("conv_id", "depth", "ends").mapInArrow(stream, "conv_id bigint, depth bigint, long_sha256 string")
    short = F.sha2(F.array_join(F.col("ends").cast("array<string>"), ","), 256)
    out = trie.nodes.join(long, ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("long_sha256", short)).drop("ends", "long_sha256")
