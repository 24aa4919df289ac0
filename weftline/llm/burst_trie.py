"""Prefix trie of conversations, built as burst tries over shards of suffix containers.

A turn is named by a 128-bit digest of its role and text, a conversation by the digests of
its turns in one binary value, so that a prefix of turns is a prefix of bytes. Equal
conversations are one sequence with a weight. All sequences start in the container of the
root. A container of more than `cap` sequences bursts: the turns that all of them share
become a chain of the trie's head (found from the smallest and largest sequence alone), and
the rest is dealt into containers by the next turn. Containers that are small enough are
sorted and swept into nodes with a stack of open nodes; heads are then summed from the
containers below them, last burst first.

Bounds: one container of `cap` sequences and the turn digests of one conversation (16 bytes
a turn) in a task; hot heads are split by adaptive joins and partial sums. Bursts take as
many rounds as there are branchings on the way to the deepest oversized container.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import materialise, spread

CAP = 4096        # sequences of a container that is swept in one task
SHARE_EVERY = 100  # a conversation opens with turns of the conversation at this multiple
SHARE_UP_TO = 6    # and with fewer of them than this
ID = 16            # bytes of a turn's digest
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = (
    "top boolean, up binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation's first turns taken from its group's first one.

    With h = crc32(decimal conv_id) % 6 the first h turns come from conversation
    conv_id - conv_id % 100 (all it has if fewer, none if it is absent), then come the
    conversation's own turns after its first h. `path` holds the turns' digests, `sizes`
    their lengths in code points. Turns follow `turn`, null first; turns of one number follow
    their role, then their digest; repeated rows are repeated turns. A null role or text is
    empty. Rows without conv_id belong to no conversation. Other columns are not read.
    """
    turn = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    named = turn.select(
        "conv_id", "turn", "role", F.substring(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * ID).alias("id"),
        F.char_length("text").cast("bigint").alias("size"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size")))
    own = materialise(
        named.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")), "trie-own"
    )
    head = own.filter(F.col("conv_id") % SHARE_EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARE_UP_TO).alias("opening"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE_EVERY).join(head, "base", "left").withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string")) % SHARE_UP_TO).cast("int")
    )
    turns = F.concat(F.coalesce(F.expr("slice(opening, 1, h)"), F.expr("slice(turns, 1, 0)")), F.expr("slice(turns, h + 1, size(turns))"))
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"), F.col("turns.size").alias("sizes")
    )


def _member_digests(batches):
    """Rows sorted by (key, conv_id) -> (key, n, conv_id, ends): members are hashed as they stream by."""
    key, state, n, first, out = None, None, 0, 0, []

    def flush():
        batch = pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())]))
        out.clear()
        return batch

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key:
                if n:
                    out.append({"key": key, "n": n, "conv_id": first, "ends": state.hexdigest()})
                key, state, n, first = k, hashlib.sha256(str(c).encode()), 1, c
            else:
                state.update(b",%d" % c)
                n += 1
        if len(out) > 4096:
            yield flush()
    if n:
        out.append({"key": key, "n": n, "conv_id": first, "ends": state.hexdigest()})
    yield flush()


def _sequences(conversations: DataFrame) -> DataFrame:
    """Distinct conversations (path, sizes, n, conv_id, ends)."""
    keyed = materialise(rebuilt(conversations).withColumn("key", F.substring(F.unhex(F.sha2("path", 256)), 1, ID)), "trie-rebuilt")
    members = spread(keyed.select("key", "conv_id"), "key").sortWithinPartitions("key", "conv_id")
    counted = members.mapInArrow(_member_digests, "key binary, n bigint, conv_id bigint, ends string")
    paths = keyed.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    return paths.join(counted, "key").drop("key")


def _shared_turns(low, high):
    """How many turns the two paths open with in common."""
    turn = lambda path: f"substring({path}, {ID} * i - {ID - 1}, {ID})"
    k = f"least(length({low}), length({high})) div {ID}"
    differs = f"array_position(transform(sequence(1, {k}), i -> {turn(low)} = {turn(high)}), false)"
    return F.expr(f"CASE WHEN {k} = 0 THEN 0 WHEN {differs} = 0 THEN {k} ELSE {differs} - 1 END").cast("int")


def _sweep(batches):
    """Containers sorted by (node, path) -> their nodes, parents closing after their children.

    An open node is [depth, size, members, smallest, leaves, saved, ends, children's rows].
    """
    stack, node, up, path, out = [], None, None, b"", []

    def close():
        depth, size, n, conv, leaves, saved, ends, below = stack.pop()
        row = [conv, depth, None, n, len(below), leaves or 1, saved + (n - 1) * size, ends]
        for child in below:
            child[2] = conv
            out.append([False, None, *child])
        if stack:
            over = stack[-1]
            over[2] += n
            over[3] = conv if over[3] is None else min(over[3], conv)
            over[4] += row[5]
            over[5] += row[6]
            over[7].append(row)
        else:
            out.append([True, up, *row])

    def flush():
        names = [f.split()[0] for f in _NODE.split(", ")]
        kinds = [pa.bool_(), pa.binary(), *[pa.int64()] * 7, pa.string()]
        columns = list(zip(*out)) if out else [[]] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("node", "up", "at", "path", "sizes", "n", "conv_id", "ends"))):
            new, above, at, p, sizes, n, conv, ends = row
            if new != node:
                while stack:
                    close()
                node, up, path = new, above, p
                stack.append([at, sizes[at - 1] if at else 0, 0, None, 0, 0, EMPTY, []])
            else:
                same, limit = at, min(len(p), len(path)) // ID
                while same < limit and p[same * ID:same * ID + ID] == path[same * ID:same * ID + ID]:
                    same += 1
                while stack[-1][0] > same:
                    close()
                path = p
            for depth in range(stack[-1][0] + 1, len(p) // ID + 1):
                stack.append([depth, sizes[depth - 1], 0, None, 0, 0, EMPTY, []])
            stack[-1][2] += n
            stack[-1][3] = conv if stack[-1][3] is None else min(conv, stack[-1][3])
            stack[-1][6] = ends
        if len(out) > 8192:
            yield flush()
    while stack:
        close()
    yield flush()


def _burst(active: DataFrame, cap: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Burst oversized containers until none is left: (heads of each round, small containers)."""
    heads, small = [], []
    while True:
        sizes = active.groupBy("node").agg(
            F.count("*").alias("rows"), F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("sizes", "path").alias("low_sizes"),
            F.first("up").alias("up"), F.first("at").alias("at"),
        )
        big = materialise(
            sizes.filter(F.col("rows") > cap).withColumn("end", _shared_turns("low", "high"))
            .select("node", "up", "at", "end", F.expr("slice(low_sizes, greatest(at, 1), end - greatest(at, 1) + 1)").alias("chain")), "trie-heads"
        )
        if big.isEmpty():
            return heads, [*small, active]
        marked = materialise(active.join(big.select("node", "end"), "node", "left"), "trie-burst")
        small.append(marked.filter("end IS NULL").drop("end"))
        ends = marked.filter(F.length("path") == ID * F.col("end")).select("node", F.col("n").alias("end_n"), F.col("conv_id").alias("end_conv"), F.col("ends").alias("end_sha"))
        heads.append(big.join(ends, "node", "left"))
        below = marked.filter(F.length("path") > ID * F.col("end"))
        active = below.select(
            F.unhex(F.md5(F.concat("node", F.expr(f"substring(path, {ID} * end + 1, {ID})")))).alias("node"), F.col("node").alias("up"), (F.col("end") + 1).alias("at"),
            "path", "sizes", "n", "conv_id", "ends",
        )


def _sums(kids: DataFrame) -> DataFrame:
    """Children's rows (up, n, conv, leaves, saved) added up per parent."""
    return kids.groupBy("up").agg(
        F.sum("kids").alias("kids"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def _roll_up(heads: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """Heads with their members, smallest conversation, leaves and savings, last burst first.

    `saved` is what lies below the chain's last node; `all_saved` adds the chain's own turns.
    """
    below = materialise(_sums(tops.filter("up IS NOT NULL").select(
        "up", F.lit(1).alias("kids"), F.col("n_convs").alias("n"), F.col("conv_id").alias("conv"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
    )), "trie-below")
    done, deeper = [], None
    for head in reversed(heads):
        kids = below if deeper is None else _sums(below.unionByName(deeper.select("up", F.lit(1).alias("kids"), "n", "conv", "leaves", F.col("all_saved").alias("saved"))))
        summed = head.join(kids.withColumnRenamed("up", "node"), "node").select(
            "node", "up", "at", "end", F.coalesce(F.col("chain"), F.array().cast("array<bigint>")).alias("chain"), "kids", "leaves", "saved",
            (F.col("n") + F.coalesce("end_n", F.lit(0))).alias("n"), F.least("conv", "end_conv").alias("conv"), F.coalesce("end_sha", F.lit(EMPTY)).alias("ends"),
        )
        total = F.aggregate("chain", F.lit(0).cast("bigint"), lambda a, x: a + x)
        deeper = materialise(summed.withColumn("all_saved", F.col("saved") + (F.col("n") - 1) * total), "trie-rolled")
        done.append(deeper)
    return done


def _head_nodes(rolled: DataFrame) -> DataFrame:
    """One row per node of the heads' chains, in the columns of the sweep."""
    # the root has no turn: its chain starts with a size of nothing
    chain = F.when(F.col("at") == 0, F.concat(F.array(F.lit(0).cast("bigint")), "chain")).otherwise(F.col("chain"))
    each = rolled.select("*", F.posexplode(chain).alias("i", "size")).withColumn("depth", (F.col("at") + F.col("i")).cast("bigint"))
    onward = Window.partitionBy("node").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one conversation's turns at most
    last = F.col("depth") == F.col("end")
    return each.select(
        (F.col("i") == 0).alias("top"), F.when(F.col("i") == 0, F.col("up")).alias("up"), F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("i") > 0, F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.sum("size").over(onward)).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, cap: int = CAP) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see `rebuilt`).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, members but one times the code
    points of the node's last text), ends_sha256 (over the decimal conv_ids of the members
    that end here, ascending, comma-joined). Conversations without turns end at the root.
    An empty table has no nodes, not even a root. `cap` decides where nodes are made, not which.
    """
    root = F.unhex(F.md5(F.lit("")))
    start = materialise(
        _sequences(conversations).select(root.alias("node"), F.lit(None).cast("binary").alias("up"), F.lit(0).alias("at"), "path", "sizes", "n", "conv_id", "ends"), "trie-sequences"
    )
    heads, small = _burst(start, cap)
    swept = []
    for containers in small:
        swept.append(spread(containers, "node").sortWithinPartitions("node", "path").mapInArrow(_sweep, _NODE))
    nodes = swept[0]
    for more in swept[1:]:
        nodes = nodes.unionByName(more)
    if not heads:
        return nodes.drop("top", "up")
    nodes = materialise(nodes, "trie-swept")
    rolled = _roll_up(heads, nodes.filter("top"))
    above = rolled[0]
    for more in rolled[1:]:
        above = above.unionByName(more)
    every = nodes.unionByName(_head_nodes(above))
    parents = above.select(F.col("node").alias("up"), F.col("conv").alias("up_conv"))
    return every.join(parents, "up", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
