"""Conversation prefix trie by vertical bitmaps (operator 11).

A conversation is a sequence of turns (role, text); every distinct sequence of its first d turns is a node at depth d, and
the conversations that start with it are its members. What conversations share is what a prefix cache saves. The steps:

1. Each conversation becomes a list of 128-bit turn digests and lengths; texts go no further.
2. Conversations are range-partitioned by id and cut into shards of at most ``SHARD`` conversations. A shard holds a
   vertical index: a bitset of its conversations for every (position, turn). Depth first, a node's bitset meets the postings of the
   next position: every non-empty intersection is a child, its population count the members, the bits of conversations
   that are over the list of its ends. Shards are cut by number, so a first turn that a third of all conversations share
   is spread over all shards and no group meets in one place.
3. Nodes of different shards meet by the digest of their path. The smallest member of a node *owns* it; a conversation owns
   the nodes from some depth down to its last turn. So counts of children and leaves and the tokens
   saved in a subtree are sums over members, each shard adds its own by the same depth-first walk with one bitset of owners a depth,
   and the second meeting only adds numbers up.
4. The ends of a node come as one sorted piece a shard and are hashed in order, piece by piece.

Both meetings combine one row per node and shard. One conversation's digests (24 bytes a turn) are held by one task.

Cases: a null id is no conversation; null roles and texts are empty; turns are ordered by number, null first, ties by role, then text;
rows that repeat are turns of their own; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm.tables import arrow_map, stored

SHARD, SHARD_TURNS = 2048, 1 << 18
ROOT = hashlib.md5(b"").digest()


def sequences(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, keys, sizes): the turn digests and code points of the texts of every conversation, in order."""
    rows = conversations.select(F.col(f"`{id_col}`").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    turns = rows.where("conv_id is not null").select("conv_id", F.row_number().over(order).alias("n"), digest.alias("key"), F.char_length("text").cast("long").alias("size"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "key", "size"))).alias("t"))
    return listed.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def with_shared_starts(seqs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % block and goes on after its own first h;
    h = crc32(decimal c) % most."""
    c = F.col("conv_id")
    cut = lambda x, h: F.slice(x, F.lit(1), h)
    base = seqs.where(c % block == 0).select(c.alias("base"), cut("keys", F.lit(most - 1)).alias("base_keys"), cut("sizes", F.lit(most - 1)).alias("base_sizes"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    x = seqs.withColumn("base", c - c % block).withColumn("h", h).join(base, "base", "left")

    def rebuilt(own: str, shared: str, kind: str) -> Column:
        return F.concat(F.coalesce(cut(shared, F.col("h")), F.array().cast(kind)), F.slice(own, F.col("h") + 1, F.size(own)))

    return x.select("conv_id", rebuilt("keys", "base_keys", "array<binary>").alias("keys"), rebuilt("sizes", "base_sizes", "array<bigint>").alias("sizes"))


def _shards(batches: Iterator[pa.RecordBatch], shard: int, shard_turns: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition in shards of bounded size."""
    held, turns = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if held and (len(held) >= shard or turns + len(row[1]) > shard_turns):
                yield held
                held, turns = [], 0
            held.append(row)
            turns += len(row[1])
    if held:
        yield held


def _walk(rows: list[tuple]) -> Iterator[tuple]:
    """(place of the parent or -1, depth, path digest, parent's digest, members, ends) of every node of a shard, parents first."""
    postings: dict[tuple, int] = {}
    over: dict[int, int] = {}
    for i, row in enumerate(rows):
        bit = 1 << i
        for at, key in enumerate(row[1]):
            postings[at, key] = postings.get((at, key), 0) | bit
        over[len(row[1])] = over.get(len(row[1]), 0) | bit
    stack = [((1 << len(rows)) - 1, 0, ROOT, None, -1)]
    place = 0
    while stack:
        members, depth, path, above, parent = stack.pop()
        ends = members & over.get(depth, 0)
        yield parent, depth, path, above, members, ends
        left = members ^ ends
        while left:
            turn = rows[(left & -left).bit_length() - 1][1][depth]
            child = left & postings[depth, turn]
            stack.append((child, depth + 1, hashlib.md5(path + turn).digest(), path, place))
            left ^= child
        place += 1


def _ids(rows: list[tuple], bits: int) -> Iterator:
    while bits:
        low = bits & -bits
        yield rows[low.bit_length() - 1][0]
        bits ^= low


def _first(rows: list[tuple], bits: int):
    return rows[(bits & -bits).bit_length() - 1][0]


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _members(id_type: pa.DataType, shard: int, shard_turns: int):
    """First walk: smallest member, members and ends of every node of a shard."""
    schema = pa.schema([("path", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("conv_id", id_type), ("n_convs", pa.int64()), ("n_ends", pa.int64())])

    def nodes(batches):
        for rows in _shards(batches, shard, shard_turns):
            for _, depth, path, above, members, ends in _walk(rows):
                yield path, above, depth, _first(rows, members), members.bit_count(), ends.bit_count()

    return lambda batches: _out(nodes(batches), schema)


def _sums(id_type: pa.DataType, shard: int, shard_turns: int):
    """Second walk: what a shard's members add to every node."""
    schema = pa.schema([("path", pa.binary()), ("first", id_type), ("depth", pa.int64()), ("parent", id_type), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])

    def nodes(batches):
        for rows in _shards(batches, shard, shard_turns):
            owners: dict[int, int] = {}
            leaves = 0
            for i, (_, keys, _, top, _, leaf) in enumerate(rows):
                for depth in range(len(keys) + 1 if top is None else top, len(keys) + 1):
                    owners[depth] = owners.get(depth, 0) | 1 << i
                leaves |= bool(leaf) << i
            out, saved, parents = [], [], []
            for parent, depth, path, _, members, ends in _walk(rows):
                first = (members & -members).bit_length() - 1
                own = members & owners.get(depth, 0)
                over = None  # the parent's smallest member, told by the owner's shard
                if own and depth:
                    conv, _, _, top, above, _ = rows[own.bit_length() - 1]
                    over = conv if depth > top else above
                saved.append(rows[first][2][depth - 1] * (members.bit_count() - own.bit_count()) if depth else 0)
                parents.append(parent)
                out.append((path, rows[first][0], depth, over, members.bit_count(), (members & owners.get(depth + 1, 0)).bit_count(),
                            (members & leaves).bit_count(), ",".join(map(str, _ids(rows, ends))) if ends else None))
            for i in range(len(out) - 1, 0, -1):
                saved[parents[i]] += saved[i]
            for row, s in zip(out, saved):
                yield (*row[:7], s, row[7])

    return lambda batches: _out(nodes(batches), schema)


def _merge(id_type: pa.DataType):
    """Nodes from their rows of all shards, sorted by path and first member; ends are hashed as they come."""
    schema = pa.schema([("conv_id", id_type), ("depth", pa.int64()), ("parent_conv_id", id_type), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])

    def nodes(batches):
        last = None

        def node():
            return conv, depth, parent, *sums, digest.hexdigest()

        for batch in batches:
            for path, first, d, over, *adds, ends in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if path != last:
                    if last is not None:
                        yield node()
                    last, conv, depth, parent, sums, digest, comma = path, first, d, None, [0] * 4, hashlib.sha256(), ""
                parent = over if parent is None else parent
                sums = [a + b for a, b in zip(sums, adds)]
                if ends is not None:
                    digest.update((comma + ends).encode())
                    comma = ","
        if last is not None:
            yield node()

    return lambda batches: _out(nodes(batches), schema)


def prefix_trie(seqs: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, keys, sizes; ids unique and not null)."""
    from pyspark.sql.pandas.types import to_arrow_type

    seqs = stored(seqs)
    kind = seqs.schema["conv_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    dealt = lambda x: x.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    found = arrow_map(dealt(seqs), _members(arrow, shard, shard_turns), f"path binary, above binary, depth long, conv_id {name}, n_convs long, n_ends long")
    nodes = stored(found.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("above"),
                                             (F.sum("n_convs") == F.sum("n_ends")).alias("leaf")))
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above")).alias("top"), F.max("leaf").alias("leaf"))
    over = nodes.select(F.col("path").alias("above"), F.col("conv_id").alias("over"))
    owned = owned.select("conv_id", F.col("top.depth").alias("top"), F.col("top.above").alias("above"), "leaf").join(over, "above", "left").select("conv_id", "top", "over", "leaf")
    told = dealt(seqs.join(owned, "conv_id", "left").select("conv_id", "keys", "sizes", "top", "over", "leaf"))
    parts = arrow_map(told, _sums(arrow, shard, shard_turns),
                      f"path binary, first {name}, depth long, parent {name}, n_convs long, n_children long, n_leaves long, saved long, ends string")
    return arrow_map(parts.repartition("path").sortWithinPartitions("path", "first"), _merge(arrow),
                     f"conv_id {name}, depth long, parent_conv_id {name}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
